"""Step 2 queries: scalar features (F1-F8), windows (W1-W17), packs (K1-K7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import packs, rolling as R, series
from ..operators.frames import Frames
from ..schema import BASE_FEATURES, CPU, DISK, HOST, LABEL, MEM, METRIC_COLUMNS, SAMPLE, TS
from ..sources.metrics import load_metrics
from . import sqlwin as Q
from .registry import query, rounded
from .sqlbase import calendar_sql, m

IDS = [HOST, SAMPLE, TS]
IDS_SQL = 'host_id, sample_id, "timestamp"'
CPU_S, MEM_S, DISK_S = "cpu_percent", "memory_percent", "disk_usage_percent"


def _win(df, cols_fn, lookback=0, lookahead=0):
    """Run window columns ``cols_fn()`` over the chunked series of ``df``."""
    def build(p):
        return p.select(*IDS, series.RN, series.CHUNK, series.HALO, *cols_fn())
    return series.apply(df, build, lookback, lookahead)


def _sql(select_list: str, doubles, src="metrics", extra_ctes=()):
    return rounded(m(f"SELECT {IDS_SQL}, {select_list} FROM {src}", *extra_ctes), doubles)


# ------------------------------------------------------------------ F1-F8
_SCALAR_SQL = m(f"""
SELECT host_id, sample_id, {calendar_sql(cyclical=True)},
  cpu_percent / (memory_percent + 0.001::DOUBLE) AS cpu_memory_ratio,
  cpu_percent / (memory_percent + 1.0::DOUBLE) AS cpu_memory_ratio_plus1,
  memory_percent / (disk_usage_percent + 0.001::DOUBLE) AS memory_disk_ratio,
  cpu_percent * 0.6::DOUBLE + memory_percent * 0.3::DOUBLE + disk_usage_percent * 0.1::DOUBLE AS system_load_index,
  (cpu_percent + memory_percent) / 2 AS system_load,
  CAST(cpu_percent > 80 AND memory_percent < 20 AS INTEGER) AS high_cpu_low_memory,
  CAST(memory_percent > 90 AS INTEGER) AS memory_pressure,
  CAST(disk_usage_percent > 90 AS INTEGER) AS disk_pressure,
  CAST(cpu_percent > 80 AS INTEGER) + CAST(memory_percent > 80 AS INTEGER) + CAST(disk_usage_percent > 80 AS INTEGER) AS resource_pressure,
  CAST(cpu_percent > 80 AS INTEGER) + CAST(memory_percent > 85 AS INTEGER) + CAST(disk_usage_percent > 90 AS INTEGER) AS failure_pressure
FROM metrics""")


@query("scalar_features", sql=rounded(_SCALAR_SQL, [
    "hour_sin", "hour_cos", "cpu_memory_ratio", "cpu_memory_ratio_plus1", "memory_disk_ratio",
    "system_load_index", "system_load"]))
def q_scalar_features(spark, sf_dir):
    mt = load_metrics(spark, sf_dir)
    return mt.select(
        HOST, SAMPLE, *S.calendar_columns(cyclical=True),
        S.cpu_memory_ratio(0.001).alias("cpu_memory_ratio"),
        S.cpu_memory_ratio(1.0).alias("cpu_memory_ratio_plus1"),
        S.memory_disk_ratio(0.001).alias("memory_disk_ratio"),
        S.system_load_index().alias("system_load_index"),
        S.system_load().alias("system_load"),
        *S.pressure_flags(),
        S.resource_pressure(S.DETECTOR_PRESSURE_LIMITS).alias("resource_pressure"),
        S.resource_pressure(S.FAILURE_PRESSURE_LIMITS).alias("failure_pressure"))


# ------------------------------------------------------------------ W1-W4
MEAN_KS = (5, 6, 10, 12, 20)


@query("rolling_mean", sql=_sql(", ".join(f"{Q.mean(CPU_S, k)} AS cpu_rolling_mean_{k}" for k in MEAN_KS),
                                [f"cpu_rolling_mean_{k}" for k in MEAN_KS]))
def q_rolling_mean(spark, sf_dir):
    return _win(load_metrics(spark, sf_dir),
                lambda: [R.rolling_mean(CPU, k).alias(f"cpu_rolling_mean_{k}") for k in MEAN_KS],
                lookback=max(MEAN_KS) - 1)


STD_KS = (5, 6, 10, 12)


@query("rolling_std", sql=_sql(", ".join(
    f"{Q.std(c, k)} AS {n}_rolling_std_{k}" for c, n in ((CPU_S, "cpu"), (MEM_S, "memory")) for k in STD_KS),
    [f"{n}_rolling_std_{k}" for n in ("cpu", "memory") for k in STD_KS]))
def q_rolling_std(spark, sf_dir):
    return _win(load_metrics(spark, sf_dir),
                lambda: [R.rolling_std(c, k).alias(f"{n}_rolling_std_{k}")
                         for c, n in ((CPU, "cpu"), (MEM, "memory")) for k in STD_KS],
                lookback=max(STD_KS) - 1)


MINMAX_KS = (5, 12)


@query("rolling_min_max", sql=_sql(", ".join(
    f"{Q.mn(CPU_S, k)} AS cpu_rolling_min_{k}, {Q.mx(CPU_S, k)} AS cpu_rolling_max_{k}" for k in MINMAX_KS),
    [f"cpu_rolling_{s}_{k}" for k in MINMAX_KS for s in ("min", "max")]))
def q_rolling_min_max(spark, sf_dir):
    def cols():
        out = []
        for k in MINMAX_KS:
            out += [R.rolling_min(CPU, k).alias(f"cpu_rolling_min_{k}"),
                    R.rolling_max(CPU, k).alias(f"cpu_rolling_max_{k}")]
        return out
    return _win(load_metrics(spark, sf_dir), cols, lookback=max(MINMAX_KS) - 1)


Q_KS = (5, 10, 20)


@query("rolling_quantile", sql=_sql(", ".join(
    f"{Q.quant(CPU_S, k, 0.25)} AS cpu_rolling_25p_{k}, {Q.quant(CPU_S, k, 0.75)} AS cpu_rolling_75p_{k}"
    for k in Q_KS), [f"cpu_rolling_{p}_{k}" for k in Q_KS for p in ("25p", "75p")]))
def q_rolling_quantile(spark, sf_dir):
    """Quartiles of three trailing frames, each sorted once."""
    fr = Frames([CPU], Q_KS)

    def build(p):
        cols = [fr.quantile(CPU, k, q).alias(f"cpu_rolling_{n}_{k}") for k in Q_KS for n, q in (("25p", 0.25), ("75p", 0.75))]
        return fr.attach(p).select(*IDS, series.RN, series.CHUNK, series.HALO, *cols)
    return series.apply(load_metrics(spark, sf_dir), build, lookback=max(Q_KS) - 1)


def _w5_names():
    return [f"{c}_rolling_{s}_{k}" for c in BASE_FEATURES for k in packs.ENHANCED_WINDOWS
            for s in ("mean", "std", "min", "max", "25p", "75p")]


def _w5_sql_list():
    out = []
    for c in BASE_FEATURES:
        for k in packs.ENHANCED_WINDOWS:
            out += [f"{Q.mean(c, k)} AS {c}_rolling_mean_{k}", f"{Q.std(c, k)} AS {c}_rolling_std_{k}",
                    f"{Q.mn(c, k)} AS {c}_rolling_min_{k}", f"{Q.mx(c, k)} AS {c}_rolling_max_{k}",
                    f"{Q.quant(c, k, 0.25)} AS {c}_rolling_25p_{k}",
                    f"{Q.quant(c, k, 0.75)} AS {c}_rolling_75p_{k}"]
    return out


@query("multi_window_stats", sql=_sql(", ".join(_w5_sql_list()), _w5_names()))
def q_multi_window_stats(spark, sf_dir):
    """6 statistics x 3 windows x 5 metrics from one sorted frame each."""
    fr = Frames(BASE_FEATURES, packs.ENHANCED_WINDOWS)

    def build(p):
        cols = []
        for c in BASE_FEATURES:
            for k in packs.ENHANCED_WINDOWS:
                cols += [fr.mean(c, k).alias(f"{c}_rolling_mean_{k}"),
                         fr.std(c, k).alias(f"{c}_rolling_std_{k}"),
                         fr.min(c, k).alias(f"{c}_rolling_min_{k}"),
                         fr.max(c, k).alias(f"{c}_rolling_max_{k}"),
                         fr.quantile(c, k, 0.25).alias(f"{c}_rolling_25p_{k}"),
                         fr.quantile(c, k, 0.75).alias(f"{c}_rolling_75p_{k}")]
        return fr.attach(p).select(*IDS, series.RN, series.CHUNK, series.HALO, *cols)
    return series.apply(load_metrics(spark, sf_dir), build, lookback=max(packs.ENHANCED_WINDOWS) - 1)


# ------------------------------------------------------------------ W6-W9
@query("rate_of_change", sql=_sql(", ".join(
    f"{Q.roc(c, n)} AS {c}_roc_{n}" for c in BASE_FEATURES for n in (1, 5)),
    [f"{c}_roc_{n}" for c in BASE_FEATURES for n in (1, 5)]))
def q_rate_of_change(spark, sf_dir):
    return _win(load_metrics(spark, sf_dir),
                lambda: [R.rate_of_change(c, n).alias(f"{c}_roc_{n}") for c in BASE_FEATURES for n in (1, 5)],
                lookback=5)


@query("acceleration", sql=_sql(", ".join(f"{Q.accel(c)} AS {c}_acceleration" for c in BASE_FEATURES),
                                [f"{c}_acceleration" for c in BASE_FEATURES]))
def q_acceleration(spark, sf_dir):
    return _win(load_metrics(spark, sf_dir),
                lambda: [R.acceleration(c).alias(f"{c}_acceleration") for c in BASE_FEATURES], lookback=2)


@query("volatility", sql=_sql(
    f"{Q.vol(CPU_S, 10)} AS cpu_volatility_10, {Q.vol(MEM_S, 10)} AS memory_volatility_10, "
    f"{Q.vol(CPU_S, 12, 1e-8, False)} AS cpu_volatility_12, {Q.vol(MEM_S, 12, 1e-8, False)} AS memory_volatility_12",
    ["cpu_volatility_10", "memory_volatility_10", "cpu_volatility_12", "memory_volatility_12"]))
def q_volatility(spark, sf_dir):
    return _win(load_metrics(spark, sf_dir), lambda: [
        R.volatility(CPU, 10).alias("cpu_volatility_10"), R.volatility(MEM, 10).alias("memory_volatility_10"),
        R.volatility(CPU, 12, 1e-8, False).alias("cpu_volatility_12"),
        R.volatility(MEM, 12, 1e-8, False).alias("memory_volatility_12")], lookback=11)


@query("rolling_trend", sql=rounded(m(
    f"SELECT {IDS_SQL}, " + ", ".join(f"{Q.trend(c)} AS {c}_trend" for c in BASE_FEATURES)
    + f" FROM (SELECT *, {Q.rn_col()} FROM metrics) t"), [f"{c}_trend" for c in BASE_FEATURES]))
def q_rolling_trend(spark, sf_dir):
    return _win(load_metrics(spark, sf_dir),
                lambda: [R.rolling_trend(c, 10).alias(f"{c}_trend") for c in BASE_FEATURES], lookback=9)


# ------------------------------------------------------------------ W10-W13
@query("zscore", sql=_sql(", ".join(
    f"{Q.zscore(c)} AS {c}_zscore, {Q.zscore(c, True)} AS {c}_zscore_robust" for c in BASE_FEATURES),
    [f"{c}_zscore{s}" for c in BASE_FEATURES for s in ("", "_robust")]))
def q_zscore(spark, sf_dir):
    def build(p):
        j = R.with_host_stats(p, BASE_FEATURES)
        cols = []
        for c in BASE_FEATURES:
            cols += [R.zscore(c).alias(f"{c}_zscore"), R.zscore(c, robust=True).alias(f"{c}_zscore_robust")]
        return j.select(*IDS, series.RN, series.CHUNK, series.HALO, *cols)
    return series.apply(load_metrics(spark, sf_dir), build)


LAGS = (1, 2, 3, 6, 12)


@query("lag_features", sql=_sql(", ".join(
    f"{Q.lag(c, n)} AS {s}_lag_{n}" for n in LAGS for c, s in ((CPU_S, "cpu"), (MEM_S, "memory"))),
    [f"{s}_lag_{n}" for n in LAGS for s in ("cpu", "memory")]))
def q_lag_features(spark, sf_dir):
    return _win(load_metrics(spark, sf_dir), lambda: [
        R.lag(c, n).alias(f"{s}_lag_{n}") for n in LAGS for c, s in ((CPU, "cpu"), (MEM, "memory"))],
        lookback=max(LAGS))


@query("lead_target", sql=_sql(", ".join(
    f"{Q.lead(c, 72)} AS {s}_future_72" for c, s in ((CPU_S, "cpu"), (MEM_S, "memory"), (DISK_S, "disk"))),
    ["cpu_future_72", "memory_future_72", "disk_future_72"]))
def q_lead_target(spark, sf_dir):
    return _win(load_metrics(spark, sf_dir), lambda: [
        R.lead(c, 72).alias(f"{s}_future_72") for c, s in ((CPU, "cpu"), (MEM, "memory"), (DISK, "disk"))],
        lookahead=72)


@query("future_max", sql=_sql(", ".join(
    f"{Q.future_max(c, 24)} AS future_max_{s}" for c, s in ((CPU_S, "cpu"), (MEM_S, "memory"), (DISK_S, "disk"))),
    ["future_max_cpu", "future_max_memory", "future_max_disk"]))
def q_future_max(spark, sf_dir):
    return _win(load_metrics(spark, sf_dir), lambda: [
        R.future_max(c, 24).alias(f"future_max_{s}") for c, s in ((CPU, "cpu"), (MEM, "memory"), (DISK, "disk"))],
        lookahead=24)


# ------------------------------------------------------------------ W14
def gappy(df):
    """Metrics with data-driven holes: cpu missing where disk > 90, memory
    missing where memory < 45 (about 10 % each)."""
    return df.select(HOST, SAMPLE, TS,
                     F.when(F.col(DISK) <= 90, F.col(CPU)).alias(CPU),
                     F.when(F.col(MEM) >= 45, F.col(MEM)).alias(MEM))


_GAPPY_SQL = """
gappy AS (SELECT host_id, sample_id, "timestamp",
  CASE WHEN disk_usage_percent <= 90 THEN cpu_percent END AS cpu_percent,
  CASE WHEN memory_percent >= 45 THEN memory_percent END AS memory_percent FROM metrics)"""


@query("fill_gaps", sql=rounded(m(
    f"SELECT {IDS_SQL}, {Q.filled(CPU_S, 'ffill,bfill,zero')} AS cpu_ffill, "
    f"{Q.filled(MEM_S, 'ffill,bfill,zero')} AS memory_ffill, "
    f"{Q.filled(CPU_S, 'bfill,ffill')} AS cpu_bfill, {Q.filled(MEM_S, 'bfill,ffill')} AS memory_bfill, "
    f"coalesce(cpu_percent, 0.0::DOUBLE) AS cpu_zero FROM gappy", _GAPPY_SQL),
    ["cpu_ffill", "memory_ffill", "cpu_bfill", "memory_bfill", "cpu_zero"]))
def q_fill_gaps(spark, sf_dir):
    g = gappy(load_metrics(spark, sf_dir)).select(
        *IDS, F.col(CPU).alias("cpu_ffill"), F.col(MEM).alias("memory_ffill"),
        F.col(CPU).alias("cpu_bfill"), F.col(MEM).alias("memory_bfill"), F.col(CPU).alias("cpu_zero"))
    g = R.fill_gaps(g, ["cpu_ffill", "memory_ffill"], "ffill,bfill,zero")
    g = R.fill_gaps(g, ["cpu_bfill", "memory_bfill"], "bfill,ffill")
    return g.fillna(0.0, subset=["cpu_zero"])


# ------------------------------------------------------------------ W15
_RESAMPLE_HOST_SQL = m("""
SELECT host_id, bucket, samples,
  coalesce(cpu_percent, last_value(cpu_percent IGNORE NULLS) OVER w) AS cpu_percent,
  coalesce(memory_percent, last_value(memory_percent IGNORE NULLS) OVER w) AS memory_percent,
  coalesce(disk_usage_percent, last_value(disk_usage_percent IGNORE NULLS) OVER w) AS disk_usage_percent
FROM (
  SELECT c.host_id, c.bucket, coalesce(a.samples, 0) AS samples, a.cpu_percent, a.memory_percent, a.disk_usage_percent
  FROM (SELECT host_id, unnest(generate_series(min(b), max(b), INTERVAL 1 DAY)) AS bucket
        FROM (SELECT host_id, date_trunc('day', "timestamp") AS b FROM metrics) x GROUP BY host_id) c
  LEFT JOIN (SELECT host_id, date_trunc('day', "timestamp") AS bucket, avg(cpu_percent) AS cpu_percent,
                    avg(memory_percent) AS memory_percent, avg(disk_usage_percent) AS disk_usage_percent,
                    count(*) AS samples
             FROM metrics GROUP BY ALL) a
  ON a.host_id = c.host_id AND a.bucket = c.bucket
) g
WINDOW w AS (PARTITION BY host_id ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")


@query("resample", sql=rounded(_RESAMPLE_HOST_SQL, [CPU_S, MEM_S, DISK_S]))
def q_resample(spark, sf_dir):
    """W15 per host on a 1-day grid (hosts sample about every 11 hours)."""
    return R.resample(load_metrics(spark, sf_dir), "1 day", [CPU, MEM, DISK]).select(
        HOST, "bucket", "samples", CPU, MEM, DISK)


FLEET_GRID_SQL = """
fleet_grid AS (
  SELECT bucket AS "timestamp", samples,
    coalesce(cpu_percent, last_value(cpu_percent IGNORE NULLS) OVER w) AS cpu_percent,
    coalesce(memory_percent, last_value(memory_percent IGNORE NULLS) OVER w) AS memory_percent,
    coalesce(disk_usage_percent, last_value(disk_usage_percent IGNORE NULLS) OVER w) AS disk_usage_percent
  FROM (
    SELECT c.bucket, coalesce(a.samples, 0) AS samples, a.cpu_percent, a.memory_percent, a.disk_usage_percent
    FROM (SELECT unnest(generate_series(min(date_trunc('hour', "timestamp")), max(date_trunc('hour', "timestamp")), INTERVAL 1 HOUR)) AS bucket FROM metrics) c
    LEFT JOIN (SELECT date_trunc('hour', "timestamp") AS bucket, avg(cpu_percent) AS cpu_percent,
                      avg(memory_percent) AS memory_percent, avg(disk_usage_percent) AS disk_usage_percent,
                      count(*) AS samples FROM metrics GROUP BY 1) a ON a.bucket = c.bucket
  ) g
  WINDOW w AS (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)"""


def fleet_grid(metrics):
    """Fixture 2.2: fleet mean per hour, calendar filled, forward filled."""
    return (R.resample(metrics, "1 hour", [CPU, MEM, DISK], key=None)
            .withColumnRenamed("bucket", TS))


@query("fleet_grid", sql=rounded(m('SELECT * FROM fleet_grid', FLEET_GRID_SQL), [CPU_S, MEM_S, DISK_S]))
def q_fleet_grid(spark, sf_dir):
    return fleet_grid(load_metrics(spark, sf_dir)).select(TS, "samples", CPU, MEM, DISK)


# ------------------------------------------------------------------ W16-W17
SEQ_FEATURES = [CPU, MEM]


@query("sequence_windows", sql=rounded(m(f"""
SELECT host_id, sample_id, "timestamp", is_anomaly, CAST(step AS INTEGER) AS step,
       step_sample_id, step_cpu_percent, step_memory_percent
FROM (
  SELECT host_id, sample_id, "timestamp", is_anomaly,
         unnest(range(0, 10)) AS step, unnest(ids) AS step_sample_id,
         unnest(cpus) AS step_cpu_percent, unnest(mems) AS step_memory_percent
  FROM (
    SELECT host_id, sample_id, "timestamp", is_anomaly, rn,
           list(sample_id) OVER f AS ids, list(cpu_percent) OVER f AS cpus,
           list(memory_percent) OVER f AS mems
    FROM (SELECT *, {Q.rn_col()} FROM metrics) t
    WINDOW f AS ({Q.PART} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)
  ) s WHERE rn >= 10
) u"""), ["step_cpu_percent", "step_memory_percent"]))
def q_sequence_windows(spark, sf_dir):
    seqs = R.sequence_windows(load_metrics(spark, sf_dir), SEQ_FEATURES, 10)
    return R.explode_sequences(seqs, SEQ_FEATURES)


def _frame_range(v):
    return float(v.max() - v.min())


@query("rolling_apply", sql=_sql(f"{Q.mx(CPU_S, 10)} - {Q.mn(CPU_S, 10)} AS cpu_range_10", ["cpu_range_10"]))
def q_rolling_apply(spark, sf_dir):
    """W17 with a user function (range of the frame) as a window pandas UDF."""
    out = R.rolling_apply(load_metrics(spark, sf_dir), CPU, 10, _frame_range, "cpu_range_10")
    return out.select(*IDS, "cpu_range_10")


# ------------------------------------------------------------------ K1-K7
def _pack_sql(inner_cols: list[tuple[str, str]], fill: str | None, ids=IDS_SQL + ", is_anomaly",
              int_cols=(), src="metrics", extra_ctes=(), where=""):
    """inner: (expr, name) list; outer applies the fill to DOUBLE columns."""
    inner = ", ".join(f"{e} AS {n}" for e, n in inner_cols)
    names = [n for _, n in inner_cols]
    if fill:
        outer = ", ".join(n if n in int_cols else f"{Q.filled(n, fill)} AS {n}" for n in names)
    else:
        outer = ", ".join(names)
    body = (f"SELECT {ids}, {outer} FROM (SELECT {ids}, {inner} "
            f"FROM (SELECT *, {Q.rn_col()} FROM {src}) t0) t1 {where}")
    return rounded(m(body, *extra_ctes), [n for n in names if n not in int_cols])


CAL_INT = ("hour", "day_of_week", "is_weekend")


def _cal(cyclical=False):
    out = [('CAST(hour("timestamp") AS INTEGER)', "hour"),
           ('CAST(isodow("timestamp") - 1 AS INTEGER)', "day_of_week"),
           ('CAST(isodow("timestamp") - 1 >= 5 AS INTEGER)', "is_weekend")]
    if cyclical:
        out += [('sin(2 * pi() * hour("timestamp") / 24.0::DOUBLE)', "hour_sin"),
                ('cos(2 * pi() * hour("timestamp") / 24.0::DOUBLE)', "hour_cos")]
    return out


def _k1_cols():
    cols = [(c, c) for c in BASE_FEATURES]
    for c in BASE_FEATURES:
        cols += [(Q.mean(c, 5), f"{c}_rolling_mean_5"), (Q.std(c, 5), f"{c}_rolling_std_5"),
                 (Q.roc(c), f"{c}_roc"), (Q.zscore(c), f"{c}_zscore")]
    return cols + _cal()


@query("features_basic", sql=_pack_sql(_k1_cols(), "bfill,ffill", int_cols=CAL_INT))
def q_features_basic(spark, sf_dir):
    return packs.features_basic(load_metrics(spark, sf_dir))


def _k2_cols():
    cols = [(c, c) for c in BASE_FEATURES]
    for c in BASE_FEATURES:
        for k in packs.ENHANCED_WINDOWS:
            cols += [(Q.mean(c, k), f"{c}_rolling_mean_{k}"), (Q.std(c, k), f"{c}_rolling_std_{k}"),
                     (Q.mn(c, k), f"{c}_rolling_min_{k}"), (Q.mx(c, k), f"{c}_rolling_max_{k}"),
                     (Q.quant(c, k, 0.25), f"{c}_rolling_25p_{k}"), (Q.quant(c, k, 0.75), f"{c}_rolling_75p_{k}")]
        cols += [(Q.roc(c, 1), f"{c}_roc_1"), (Q.roc(c, 5), f"{c}_roc_5"), (Q.accel(c), f"{c}_acceleration"),
                 (Q.vol(c, 10), f"{c}_volatility")]
    cols += [(f"{CPU_S} / ({MEM_S} + 0.001::DOUBLE)", "cpu_memory_ratio"),
             (f"{MEM_S} / ({DISK_S} + 0.001::DOUBLE)", "memory_disk_ratio"),
             (f"{CPU_S} * 0.6::DOUBLE + {MEM_S} * 0.3::DOUBLE + {DISK_S} * 0.1::DOUBLE", "system_load_index")]
    cols += [(Q.trend(c), f"{c}_trend") for c in BASE_FEATURES]
    cols += _cal(True)
    cols += [(f"CAST({CPU_S} > 80 AND {MEM_S} < 20 AS INTEGER)", "high_cpu_low_memory"),
             (f"CAST({MEM_S} > 90 AS INTEGER)", "memory_pressure"),
             (f"CAST({DISK_S} > 90 AS INTEGER)", "disk_pressure")]
    return cols


K2_INT = CAL_INT + ("high_cpu_low_memory", "memory_pressure", "disk_pressure")


@query("features_enhanced", sql=_pack_sql(_k2_cols(), "ffill,bfill,zero", int_cols=K2_INT))
def q_features_enhanced(spark, sf_dir):
    return packs.features_enhanced(load_metrics(spark, sf_dir))


def _k3_cols():
    cols = [(c, c) for c in BASE_FEATURES]
    for c in BASE_FEATURES:
        cols += [(Q.mean(c, 5), f"{c}_rolling_mean_5"), (Q.std(c, 5), f"{c}_rolling_std_5"),
                 (Q.roc(c), f"{c}_roc"), (Q.zscore(c, True), f"{c}_zscore")]
    cols += _cal()
    cols += [(f"{CPU_S} / ({MEM_S} + 1.0::DOUBLE)", "cpu_memory_ratio"),
             (f"({CPU_S} + {MEM_S}) / 2", "system_load")]
    return cols


@query("features_robust", sql=_pack_sql(_k3_cols(), "ffill,bfill,zero", int_cols=CAL_INT))
def q_features_robust(spark, sf_dir):
    return packs.features_robust(load_metrics(spark, sf_dir))


def _k4_cols():
    cols = [(c, c) for c in METRIC_COLUMNS] + _cal(True)
    for c in BASE_FEATURES:
        cols += [(Q.mean(c, 5), f"{c}_rolling_mean_5"), (Q.std(c, 5), f"{c}_rolling_std_5"),
                 (Q.mn(c, 5), f"{c}_rolling_min_5"), (Q.mx(c, 5), f"{c}_rolling_max_5"),
                 (Q.roc(c), f"{c}_roc")]
    cols += [(f"{CPU_S} / ({MEM_S} + 1.0::DOUBLE)", "cpu_memory_ratio"),
             (f"{CPU_S} * 0.6::DOUBLE + {MEM_S} * 0.3::DOUBLE + {DISK_S} * 0.1::DOUBLE", "system_load_index"),
             (f"CAST({CPU_S} > 80 AS INTEGER) + CAST({MEM_S} > 80 AS INTEGER) + CAST({DISK_S} > 80 AS INTEGER)",
              "resource_pressure")]
    return cols


@query("features_temporal", sql=_pack_sql(_k4_cols(), "ffill,bfill,zero", int_cols=CAL_INT + ("resource_pressure",)))
def q_features_temporal(spark, sf_dir):
    return packs.features_temporal(load_metrics(spark, sf_dir))


def _k5_sql(src="metrics", h=72, extra=()):
    cols = [(CPU_S, CPU_S), (MEM_S, MEM_S), (DISK_S, DISK_S)] + _cal(True)
    for n in packs.FORECAST_LAGS:
        cols += [(Q.lag(CPU_S, n), f"cpu_lag_{n}"), (Q.lag(MEM_S, n), f"memory_lag_{n}")]
    cols += [(Q.mean(CPU_S, 6), "cpu_rolling_mean_6"), (Q.std(CPU_S, 6), "cpu_rolling_std_6"),
             (Q.mean(MEM_S, 6), "memory_rolling_mean_6")]
    cols += [(Q.lead(CPU_S, h), f"cpu_future_{h}"), (Q.lead(MEM_S, h), f"memory_future_{h}"),
             (Q.lead(DISK_S, h), f"disk_future_{h}")]
    names = [n for _, n in cols]
    where = "WHERE " + " AND ".join(f"{n} IS NOT NULL" for n in names)
    return _pack_sql(cols, None, ids=IDS_SQL, int_cols=CAL_INT, src=src, extra_ctes=extra, where=where)


@query("features_forecast", sql=_k5_sql())
def q_features_forecast(spark, sf_dir):
    return packs.features_forecast(load_metrics(spark, sf_dir), 72)


@query("features_forecast_12", sql=_k5_sql(h=12))
def q_features_forecast_12(spark, sf_dir):
    """K5 at a horizon of 12 rows, which more hosts of the small tables reach."""
    return packs.features_forecast(load_metrics(spark, sf_dir), 12)


def _k6_cols():
    cols = _cal() + [(CPU_S, CPU_S), (MEM_S, MEM_S), (DISK_S, DISK_S)]
    cols += [(Q.mean(CPU_S, 12), "cpu_rolling_mean_12"), (Q.std(CPU_S, 12), "cpu_rolling_std_12"),
             (Q.mx(CPU_S, 12), "cpu_rolling_max_12"), (Q.mean(MEM_S, 12), "memory_rolling_mean_12"),
             (Q.std(MEM_S, 12), "memory_rolling_std_12"), (Q.mx(MEM_S, 12), "memory_rolling_max_12"),
             (Q.roc(CPU_S), "cpu_roc_1"), (Q.roc(MEM_S), "memory_roc_1"),
             (Q.vol(CPU_S, 12, 1e-8, False), "cpu_volatility"), (Q.vol(MEM_S, 12, 1e-8, False), "memory_volatility"),
             (f"CAST({CPU_S} > 80 AS INTEGER) + CAST({MEM_S} > 85 AS INTEGER) + CAST({DISK_S} > 90 AS INTEGER)",
              "resource_pressure")]
    return cols


@query("features_failure", sql=_pack_sql(_k6_cols(), "zero", ids=IDS_SQL, int_cols=CAL_INT + ("resource_pressure",)))
def q_features_failure(spark, sf_dir):
    return packs.features_failure(load_metrics(spark, sf_dir))


def _k7_cols():
    cols = [(c, c) for c in METRIC_COLUMNS]
    for c in BASE_FEATURES:
        cols += [(Q.mean(c, 5), f"{c}_rolling_mean_5"), (Q.std(c, 5), f"{c}_rolling_std_5"),
                 (Q.roc(c), f"{c}_roc")]
    return cols + [('CAST(hour("timestamp") AS INTEGER)', "hour")]


@query("features_debug", sql=_pack_sql(_k7_cols(), "ffill,bfill,zero", int_cols=("hour",)))
def q_features_debug(spark, sf_dir):
    return packs.features_debug(load_metrics(spark, sf_dir))
