"""Feature packs K1-K7: the trainers' feature sets as one window stage each.

Each pack is one ``select`` over a chunked host series: every frame shares
the partition (host, chunk) and order ``_rn``, so Spark plans one Exchange
and one Sort for all rolling columns of a pack.  Fill rules run afterwards
with per-chunk carries (``rolling.fill_gaps``).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..schema import (BASE_FEATURES, CPU, DISK, HOST, LABEL, MEM,
                      METRIC_COLUMNS, SAMPLE, TS)
from . import rolling as R
from . import series
from .frames import Frames

ID_COLUMNS = [HOST, SAMPLE, TS]


def _ids(df: DataFrame) -> list[str]:
    return ID_COLUMNS + ([LABEL] if LABEL in df.columns else [])


def _complete(df: DataFrame, cols: Sequence[str]) -> bool:
    """True if no value of ``cols`` is missing: one aggregate over the input
    columns.  Then the only NULLs of a pack are known beforehand."""
    gaps = df.select(F.max(F.greatest(*[F.col(c).isNull() for c in dict.fromkeys(cols)])).alias("gap")).first()["gap"]
    return not gaps


def _second(std, c: str, zero: bool):
    """A deviation whose first row is filled: backward filling takes that of the
    second row, which is |x2 - x1| / sqrt(2) for every frame size."""
    filled = F.coalesce(std, F.abs(R.lead(c, 1) - F.col(c)) / F.sqrt(F.lit(2.0)))
    return F.coalesce(filled, F.lit(0.0)) if zero else filled


def _stds(whole: bool, zero: bool):
    """The pack's ``rolling_std``.  In a complete table only a host's first row
    has none, and nothing else of a pack can be filled; the fill is then part of
    the expression.  Otherwise the pack is filled column by column."""
    return (lambda c, k: _second(R.rolling_std(c, k), c, zero)) if whole else R.rolling_std


def _finish(df: DataFrame, features: list[str], fill: str | None, ids: list[str], whole: bool = False) -> DataFrame:
    if fill and not whole:
        df = R.fill_gaps(df, features, fill)
    return df.select(*ids, *features)


def features_basic(df: DataFrame, base: Sequence[str] = BASE_FEATURES, whole: bool | None = None) -> DataFrame:
    """K1: base + mean5, std5, roc, zscore per metric + hour, dow, weekend (28).
    Fill: backward then forward."""
    ids = _ids(df)
    whole = _complete(df, [TS, *base]) if whole is None else whole
    std = _stds(whole, zero=False)

    def build(p):
        j = R.with_host_stats(p, base)
        cols = [F.col(c) for c in base]
        for c in base:
            cols += [R.rolling_mean(c, 5).alias(f"{c}_rolling_mean_5"),
                     std(c, 5).alias(f"{c}_rolling_std_5"),
                     R.rate_of_change(c, 1).alias(f"{c}_roc"),
                     R.zscore(c).alias(f"{c}_zscore")]
        cols += S.calendar_columns()
        return j.select(*ids, series.RN, series.CHUNK, series.HALO, *cols)

    out = series.apply(df, build, lookback=4, keep_position=True)
    feats = [c for c in out.columns if c not in ids + [series.RN, series.CHUNK]]
    return _finish(out, feats, "bfill,ffill", ids, whole)


ENHANCED_WINDOWS = (5, 10, 20)


def features_enhanced(df: DataFrame, base: Sequence[str] = BASE_FEATURES,
                      windows: Sequence[int] = ENHANCED_WINDOWS, whole: bool | None = None) -> DataFrame:
    """K2: 131 columns - per metric 6 statistics x 3 windows, roc 1 / 5,
    acceleration, volatility, trend; ratios; 5 time columns; 3 flags.
    Fill: forward, backward, then 0."""
    ids = _ids(df)
    lookback = max(max(windows) - 1, 9, 5)
    whole = _complete(df, [TS, *base]) if whole is None else whole
    fr = Frames(base, [*windows, 10])

    def build(p):
        trends = [R.rolling_trend(c, 10).alias(f"{c}_trend") for c in base]
        ahead = [R.lead(c, 1).alias(f"_next_{c}") for c in base] if whole else []
        f = fr.attach(p, *trends, *ahead)

        def std(c, k):
            if not whole:
                return fr.std(c, k)
            return F.coalesce(fr.std(c, k), F.abs(F.col(f"_next_{c}") - F.col(c)) / F.sqrt(F.lit(2.0)), F.lit(0.0))

        cols = [F.col(c) for c in base]
        for c in base:
            for k in windows:
                cols += [fr.mean(c, k).alias(f"{c}_rolling_mean_{k}"),
                         std(c, k).alias(f"{c}_rolling_std_{k}"),
                         fr.min(c, k).alias(f"{c}_rolling_min_{k}"),
                         fr.max(c, k).alias(f"{c}_rolling_max_{k}"),
                         fr.quantile(c, k, 0.25).alias(f"{c}_rolling_25p_{k}"),
                         fr.quantile(c, k, 0.75).alias(f"{c}_rolling_75p_{k}")]
            cols += [fr.rate_of_change(c, 1).alias(f"{c}_roc_1"),
                     fr.rate_of_change(c, 5).alias(f"{c}_roc_5"),
                     fr.acceleration(c).alias(f"{c}_acceleration"),
                     fr.volatility(c, 10).alias(f"{c}_volatility")]
        cols += [S.cpu_memory_ratio(0.001).alias("cpu_memory_ratio"),
                 S.memory_disk_ratio(0.001).alias("memory_disk_ratio"),
                 S.system_load_index().alias("system_load_index")]
        cols += [F.col(f"{c}_trend") for c in base]
        cols += S.calendar_columns(cyclical=True)
        cols += S.pressure_flags()
        return f.select(*ids, series.RN, series.CHUNK, series.HALO, *cols)

    out = series.apply(df, build, lookback=lookback, keep_position=True)
    feats = [c for c in out.columns if c not in ids + [series.RN, series.CHUNK]]
    return _finish(out, feats, "ffill,bfill,zero", ids, whole)


def features_robust(df: DataFrame, base: Sequence[str] = BASE_FEATURES, whole: bool | None = None) -> DataFrame:
    """K3 (30): mean5, std5, roc, zscore (0 for constant series) per metric,
    calendar, cpu / (memory + 1), (cpu + memory) / 2."""
    ids = _ids(df)
    whole = _complete(df, [TS, *base]) if whole is None else whole
    std = _stds(whole, zero=True)

    def build(p):
        j = R.with_host_stats(p, base)
        cols = [F.col(c) for c in base]
        for c in base:
            cols += [R.rolling_mean(c, 5).alias(f"{c}_rolling_mean_5"),
                     std(c, 5).alias(f"{c}_rolling_std_5"),
                     R.rate_of_change(c, 1).alias(f"{c}_roc"),
                     R.zscore(c, robust=True).alias(f"{c}_zscore")]
        cols += S.calendar_columns()
        cols += [S.cpu_memory_ratio(1.0).alias("cpu_memory_ratio"),
                 S.system_load().alias("system_load")]
        return j.select(*ids, series.RN, series.CHUNK, series.HALO, *cols)

    out = series.apply(df, build, lookback=4, keep_position=True)
    feats = [c for c in out.columns if c not in ids + [series.RN, series.CHUNK]]
    return _finish(out, feats, "ffill,bfill,zero", ids, whole)


def features_temporal(df: DataFrame, base: Sequence[str] | None = None, whole: bool | None = None,
                      keep_position: bool = False) -> DataFrame:
    """K4 (40 with the seven metrics, 38 with five): base, 5 time columns,
    mean / std / min / max of 5 rows and roc per metric, ratio (eps 1),
    load index, pressure count (80 / 80 / 80).  The live sequence scorer
    uses this same function (one definition for training and serving).
    ``keep_position`` keeps ``_rn`` for a following step along the series."""
    ids = _ids(df)
    base = list(base) if base is not None else [c for c in METRIC_COLUMNS if c in df.columns]
    whole = _complete(df, [TS, *base, *BASE_FEATURES]) if whole is None else whole
    std = _stds(whole, zero=True)

    def build(p):
        cols = [F.col(c) for c in base]
        cols += S.calendar_columns(cyclical=True)
        for c in BASE_FEATURES:
            cols += [R.rolling_mean(c, 5).alias(f"{c}_rolling_mean_5"),
                     std(c, 5).alias(f"{c}_rolling_std_5"),
                     R.rolling_min(c, 5).alias(f"{c}_rolling_min_5"),
                     R.rolling_max(c, 5).alias(f"{c}_rolling_max_5"),
                     R.rate_of_change(c, 1).alias(f"{c}_roc")]
        cols += [S.cpu_memory_ratio(1.0).alias("cpu_memory_ratio"),
                 S.system_load_index().alias("system_load_index"),
                 S.resource_pressure(S.DETECTOR_PRESSURE_LIMITS).alias("resource_pressure")]
        return p.select(*ids, series.RN, series.CHUNK, series.HALO, *cols)

    out = series.apply(df, build, lookback=4, keep_position=True)
    feats = [c for c in out.columns if c not in ids + [series.RN, series.CHUNK]]
    return _finish(out, feats, "ffill,bfill,zero", ids + [series.RN] if keep_position else ids, whole)


FORECAST_LAGS = (1, 2, 3, 6, 12)
FORECAST_FEATURES = (["hour", "day_of_week", "is_weekend", "hour_sin", "hour_cos"]
                     + [f"{m}_lag_{n}" for n in FORECAST_LAGS for m in ("cpu", "memory")]
                     + ["cpu_rolling_mean_6", "cpu_rolling_std_6", "memory_rolling_mean_6"])
FORECAST_TARGETS = ("cpu", "memory", "disk")


def features_forecast(df: DataFrame, horizon: int = 72, drop_incomplete: bool = True) -> DataFrame:
    """K5: 18 model inputs (5 time, 10 lags, 3 rolling) and the three
    targets ``{cpu,memory,disk}_future_{h}``; rows with any NULL dropped."""
    ids = [HOST, SAMPLE, TS]

    def build(p):
        cols = [F.col(CPU), F.col(MEM), F.col(DISK)]
        cols += S.calendar_columns(cyclical=True)
        for n in FORECAST_LAGS:
            cols += [R.lag(CPU, n).alias(f"cpu_lag_{n}"), R.lag(MEM, n).alias(f"memory_lag_{n}")]
        cols += [R.rolling_mean(CPU, 6).alias("cpu_rolling_mean_6"),
                 R.rolling_std(CPU, 6).alias("cpu_rolling_std_6"),
                 R.rolling_mean(MEM, 6).alias("memory_rolling_mean_6")]
        cols += [R.lead(CPU, horizon).alias(f"cpu_future_{horizon}"),
                 R.lead(MEM, horizon).alias(f"memory_future_{horizon}"),
                 R.lead(DISK, horizon).alias(f"disk_future_{horizon}")]
        return p.select(*ids, series.RN, series.CHUNK, series.HALO, *cols)

    out = series.apply(df, build, lookback=max(FORECAST_LAGS), lookahead=horizon)
    return R.drop_null_rows(out) if drop_incomplete else out


FAILURE_FEATURES = ["hour", "day_of_week", "is_weekend", CPU, MEM, DISK,
                    "cpu_rolling_mean_12", "cpu_rolling_std_12", "cpu_rolling_max_12",
                    "memory_rolling_mean_12", "memory_rolling_std_12", "memory_rolling_max_12",
                    "cpu_roc_1", "memory_roc_1", "cpu_volatility", "memory_volatility",
                    "resource_pressure"]


def failure_feature_columns() -> list:
    return [*S.calendar_columns(), F.col(CPU), F.col(MEM), F.col(DISK),
            R.rolling_mean(CPU, 12).alias("cpu_rolling_mean_12"),
            R.rolling_std(CPU, 12).alias("cpu_rolling_std_12"),
            R.rolling_max(CPU, 12).alias("cpu_rolling_max_12"),
            R.rolling_mean(MEM, 12).alias("memory_rolling_mean_12"),
            R.rolling_std(MEM, 12).alias("memory_rolling_std_12"),
            R.rolling_max(MEM, 12).alias("memory_rolling_max_12"),
            R.rate_of_change(CPU, 1).alias("cpu_roc_1"),
            R.rate_of_change(MEM, 1).alias("memory_roc_1"),
            R.volatility(CPU, 12, eps=1e-8, null_as_zero=False).alias("cpu_volatility"),
            R.volatility(MEM, 12, eps=1e-8, null_as_zero=False).alias("memory_volatility"),
            S.resource_pressure(S.FAILURE_PRESSURE_LIMITS).alias("resource_pressure")]


def features_failure(df: DataFrame) -> DataFrame:
    """K6: the failure model's 17 inputs; remaining NULLs (std of a single
    row) become 0, as the trainer does before fitting."""
    def build(p):
        return p.select(HOST, SAMPLE, TS, series.RN, series.CHUNK, series.HALO,
                        *failure_feature_columns())
    out = series.apply(df, build, lookback=11)
    return out.na.fill(0.0, subset=FAILURE_FEATURES)


def features_debug(df: DataFrame, whole: bool | None = None) -> DataFrame:
    """K7 (23): seven metrics, mean5 / std5 / roc per base metric, hour.
    Fill: forward, backward, then 0."""
    ids = _ids(df)
    whole = _complete(df, [TS, *METRIC_COLUMNS]) if whole is None else whole
    std = _stds(whole, zero=True)

    def build(p):
        cols = [F.col(c) for c in METRIC_COLUMNS]
        for c in BASE_FEATURES:
            cols += [R.rolling_mean(c, 5).alias(f"{c}_rolling_mean_5"),
                     std(c, 5).alias(f"{c}_rolling_std_5"),
                     R.rate_of_change(c, 1).alias(f"{c}_roc")]
        cols.append(S.hour().alias("hour"))
        return p.select(*ids, series.RN, series.CHUNK, series.HALO, *cols)

    out = series.apply(df, build, lookback=4, keep_position=True)
    feats = [c for c in out.columns if c not in ids + [series.RN, series.CHUNK]]
    return _finish(out, feats, "ffill,bfill,zero", ids, whole)
