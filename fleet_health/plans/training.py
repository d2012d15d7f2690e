"""Step 5 queries: labels, sampling, class profile, evaluation
(L1-L7, L9, L11, G1-G4, E1-E8, M7, N2, N3, N6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import labels as L
from ..operators.scaling import standardize
from ..schema import BASE_FEATURES, CPU, DISK, HOST, LABEL, MEM, METRIC_COLUMNS, SAMPLE, TS
from ..sources.metrics import load_metrics, load_scored, load_votes
from . import sqlwin as Q
from .features import FLEET_GRID_SQL, fleet_grid
from .registry import query, rounded
from .sqlbase import METRICS, SCORED, VOTES, m, with_ctes

_MD = ["cpu_percent", "memory_percent", "memory_used_gb", "memory_available_gb",
       "disk_usage_percent", "disk_used_gb", "disk_free_gb"]


def U(expr: str, salt: int) -> str:
    """SQL twin of ``labels.unit_hash``."""
    return f"(CAST(CAST('0x' || substr(md5(CAST({expr} AS VARCHAR) || '|{salt}'), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0)"


POS_SQL = """pos AS (SELECT * EXCLUDE (is_anomaly), row_number() OVER (PARTITION BY host_id ORDER BY "timestamp", sample_id) AS rn,
  count(*) OVER (PARTITION BY host_id) AS n FROM metrics)"""


# ------------------------------------------------------------------ L1
@query("will_fail_label", sql=rounded(m(f"""
SELECT host_id, sample_id, "timestamp", future_max_cpu, future_max_memory, future_max_disk,
  CAST(future_max_cpu > 95 OR future_max_memory > 98 OR future_max_disk > 99 AS INTEGER) AS will_fail
FROM (SELECT host_id, sample_id, "timestamp", {Q.future_max('cpu_percent', 24)} AS future_max_cpu,
        {Q.future_max('memory_percent', 24)} AS future_max_memory,
        {Q.future_max('disk_usage_percent', 24)} AS future_max_disk FROM metrics) t
WHERE future_max_cpu IS NOT NULL AND future_max_memory IS NOT NULL AND future_max_disk IS NOT NULL"""),
    ["future_max_cpu", "future_max_memory", "future_max_disk"]))
def q_will_fail_label(spark, sf_dir):
    out = L.will_fail_label(load_metrics(spark, sf_dir))
    return out.select(HOST, SAMPLE, TS, "future_max_cpu", "future_max_memory", "future_max_disk", "will_fail")


# ------------------------------------------------------------------ L2, N3
_L2_SQL = m(f"""
SELECT p.host_id, p.sample_id, p."timestamp",
  CASE WHEN k.kind = 0 THEN 90.0::DOUBLE + 10.0::DOUBLE * k.uu ELSE p.cpu_percent END AS cpu_percent,
  CASE WHEN k.kind = 1 THEN 95.0::DOUBLE + 5.0::DOUBLE * k.uu ELSE p.memory_percent END AS memory_percent,
  CASE WHEN h.hits IS NOT NULL THEN p.memory_used_gb * pow(1.5::DOUBLE, h.hits) ELSE p.memory_used_gb END AS memory_used_gb,
  p.memory_available_gb,
  CASE WHEN k.kind = 2 THEN 95.0::DOUBLE + 5.0::DOUBLE * k.uu ELSE p.disk_usage_percent END AS disk_usage_percent,
  p.disk_used_gb, p.disk_free_gb, CAST(k.kind IS NOT NULL AS INTEGER) AS is_anomaly
FROM pos p
LEFT JOIN picks k USING (host_id, rn)
LEFT JOIN (SELECT host_id, rn, count(*) AS hits FROM
           (SELECT host_id, unnest(range(rn, rn + 6)) AS rn FROM picks WHERE kind = 1) x GROUP BY ALL) h USING (host_id, rn)""",
    POS_SQL, f"""picks AS (SELECT host_id, rn, CAST(floor({U('sample_id', 2)} * 3) AS INTEGER) AS kind, {U('sample_id', 3)} AS uu
  FROM (SELECT *, row_number() OVER (PARTITION BY host_id ORDER BY {U('sample_id', 1)}, sample_id) AS pr
        FROM pos WHERE rn - 1 >= 10 AND rn - 1 <= n - 10) t WHERE pr <= least(50, n // 20))""")


@query("inject_point_anomalies", sql=rounded(_L2_SQL, _MD))
def q_inject_point_anomalies(spark, sf_dir):
    return L.inject_point_anomalies(load_metrics(spark, sf_dir), cap=L.POINT_CAP)


# ------------------------------------------------------------------ L3
def _l3_factor(metric: str) -> str:
    parts = []
    for ki, k in enumerate(L.GRADUAL_KINDS):
        for (mm, lo, hi, _cap, _used) in L.GRADUAL_RULES[k][1]:
            if mm == metric:
                parts.append(f"WHEN kind = {ki} THEN {lo}::DOUBLE + {hi - lo}::DOUBLE * "
                             f"{U("pid || ':' || i", 11 + 2 + ki)}")
    return "CASE " + " ".join(parts) + " ELSE 1.0::DOUBLE END"


def _l3_metric(metric: str, name: str | None = None) -> str:
    parts = []
    for ki, k in enumerate(L.GRADUAL_KINDS):
        for (mm, _lo, _hi, cap, _used) in L.GRADUAL_RULES[k][1]:
            if mm == metric:
                parts.append(f"WHEN f.kind = {ki} THEN least(p.{metric} * f.m_{metric}, {cap}::DOUBLE)")
    return f"CASE {' '.join(parts)} ELSE p.{metric} END AS {name or metric}"


_ROWS_CASE = "CASE kind " + " ".join(
    f"WHEN {ki} THEN {L.GRADUAL_RULES[k][0]}" for ki, k in enumerate(L.GRADUAL_KINDS)) + " END"

_L3_SQL = m(f"""
SELECT p.host_id, p.sample_id, p."timestamp", {_l3_metric('cpu_percent')}, {_l3_metric('memory_percent')},
  CASE WHEN f.kind = 1 THEN p.memory_used_gb * f.m_memory_percent ELSE p.memory_used_gb END AS memory_used_gb,
  p.memory_available_gb, {_l3_metric('disk_usage_percent')},
  CASE WHEN f.kind = 2 THEN p.disk_used_gb * f.m_disk_usage_percent ELSE p.disk_used_gb END AS disk_used_gb,
  p.disk_free_gb, CAST(f.kind IS NOT NULL AS INTEGER) AS is_anomaly
FROM pos p LEFT JOIN fac f USING (host_id, rn)""", POS_SQL, f"""
picks AS (SELECT host_id, rn AS p, sample_id AS pid, pr, CAST(floor({U('sample_id', 12)} * 5) AS INTEGER) AS kind
  FROM (SELECT *, row_number() OVER (PARTITION BY host_id ORDER BY {U('sample_id', 11)}, sample_id) AS pr
        FROM pos WHERE rn - 1 >= 20 AND rn - 1 <= n - 20) t WHERE pr <= least(200, n // 25))""", f"""
hits AS (SELECT host_id, pr, kind, pid, i, p + i AS rn FROM (SELECT *, unnest(range(0, {_ROWS_CASE})) AS i FROM picks) h)""", f"""
rowk AS (SELECT host_id, rn, arg_min(kind, pr) AS kind FROM hits GROUP BY ALL)""", f"""
fac AS (SELECT h.host_id, h.rn, r.kind, product({_l3_factor('cpu_percent')}) AS m_cpu_percent,
  product({_l3_factor('memory_percent')}) AS m_memory_percent,
  product({_l3_factor('disk_usage_percent')}) AS m_disk_usage_percent
  FROM (SELECT h0.*, h0.kind AS hk FROM hits h0) h JOIN rowk r ON r.host_id = h.host_id AND r.rn = h.rn
  WHERE h.hk = r.kind GROUP BY h.host_id, h.rn, r.kind)""")


@query("inject_gradual_anomalies", sql=rounded(_L3_SQL.replace("WHEN kind =", "WHEN h.kind ="), _MD))
def q_inject_gradual_anomalies(spark, sf_dir):
    return L.inject_gradual_anomalies(load_metrics(spark, sf_dir), cap=L.GRADUAL_CAP)


# ------------------------------------------------------------------ L4, L5, L6, L9, L11
@query("class_distribution", sql=rounded(m("""
SELECT is_anomaly, count(*) AS count, count(*) / (SELECT count(*) FROM metrics) AS ratio,
  (SELECT count(*) FROM metrics) AS total FROM metrics GROUP BY is_anomaly"""), ["ratio"]))
def q_class_distribution(spark, sf_dir):
    return L.class_distribution(load_metrics(spark, sf_dir))


@query("stratified_split", sql=m(f"""
SELECT host_id, sample_id, is_anomaly,
  row_number() OVER (PARTITION BY is_anomaly ORDER BY {U('sample_id', 42)}, sample_id)
    <= floor(count(*) OVER (PARTITION BY is_anomaly) * 0.2 + 0.5) AS is_test
FROM metrics"""))
def q_stratified_split(spark, sf_dir):
    return L.stratified_split(load_metrics(spark, sf_dir), 0.2, 42).select(HOST, SAMPLE, LABEL, "is_test")


@query("time_ordered_split", sql=m("""
SELECT host_id, sample_id, "timestamp",
  row_number() OVER (PARTITION BY host_id ORDER BY "timestamp", sample_id)
    > count(*) OVER (PARTITION BY host_id) - floor(count(*) OVER (PARTITION BY host_id) * 0.2 + 0.5) AS is_test
FROM metrics"""))
def q_time_ordered_split(spark, sf_dir):
    return L.time_ordered_split(load_metrics(spark, sf_dir), 0.2).select(HOST, SAMPLE, TS, "is_test")


@query("random_undersample", sql=rounded(m(f"""
SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY is_anomaly ORDER BY {U('sample_id', 42)}, sample_id) AS r
  FROM metrics) t WHERE r <= (SELECT min(c) FROM (SELECT count(*) AS c FROM metrics GROUP BY is_anomaly) x)"""), _MD))
def q_random_undersample(spark, sf_dir):
    return L.random_undersample(load_metrics(spark, sf_dir), 42)


@query("balanced_class_weights", sql=rounded(m("""
SELECT host_id, sample_id, is_anomaly, (SELECT count(*) FROM metrics)
  / ((SELECT count(DISTINCT is_anomaly) FROM metrics) * count(*) OVER (PARTITION BY is_anomaly)) AS weight
FROM metrics"""), ["weight"]))
def q_balanced_class_weights(spark, sf_dir):
    return L.balanced_class_weights(load_metrics(spark, sf_dir)).select(HOST, SAMPLE, LABEL, "weight")


@query("standardize", sql=rounded(m("SELECT host_id, sample_id, " + ", ".join(
    f"coalesce(({c} - (SELECT avg({c}) FROM metrics)) / nullif((SELECT stddev_pop({c}) FROM metrics), 0), 0.0::DOUBLE) AS {c}"
    for c in BASE_FEATURES) + " FROM metrics"), BASE_FEATURES))
def q_standardize(spark, sf_dir):
    """L7 with population std (the trainers' scaler), constant -> 0."""
    return standardize(load_metrics(spark, sf_dir), BASE_FEATURES, keep=[HOST, SAMPLE])


# ------------------------------------------------------------------ G1-G4
_G1_COLS = [f"{c}_{s}" for c in (CPU, MEM, DISK) for s in ("mean", "std", "min", "25", "50", "75", "max")]


@query("describe_by_class", sql=rounded(m("SELECT is_anomaly, count(*) AS count, " + ", ".join(
    f"avg({c}) AS {c}_mean, stddev_samp({c}) AS {c}_std, min({c}) AS {c}_min, quantile_cont({c}, 0.25) AS {c}_25, "
    f"quantile_cont({c}, 0.5) AS {c}_50, quantile_cont({c}, 0.75) AS {c}_75, max({c}) AS {c}_max"
    for c in (CPU, MEM, DISK)) + " FROM metrics GROUP BY is_anomaly"), _G1_COLS))
def q_describe_by_class(spark, sf_dir):
    return E.describe_by_class(load_metrics(spark, sf_dir))


@query("separability_check", sql=m(" UNION ALL ".join(
    f"SELECT '{c}' AS metric, min({c}) FILTER (WHERE is_anomaly = 1) AS anomaly_min, "
    f"max({c}) FILTER (WHERE is_anomaly = 0) AS normal_max, "
    f"coalesce(min({c}) FILTER (WHERE is_anomaly = 1) > 1.5 * max({c}) FILTER (WHERE is_anomaly = 0), false) AS too_obvious "
    f"FROM metrics" for c in (CPU, MEM, DISK))))
def q_separability_check(spark, sf_dir):
    return E.separability_check(load_metrics(spark, sf_dir))


@query("anomaly_adequacy", sql=m("""
SELECT CAST(count_if(is_anomaly = 1) AS BIGINT) AS anomalies, count_if(is_anomaly = 1) < 20 AS insufficient FROM metrics"""))
def q_anomaly_adequacy(spark, sf_dir):
    return E.anomaly_adequacy(load_metrics(spark, sf_dir))


@query("class_histogram", sql=rounded(m("""
SELECT is_anomaly, bin, lo + bin * w AS bin_low, lo + (bin + 1) * w AS bin_high, count(*) AS count,
  count(*) / (nc * w) AS density
FROM (SELECT d.is_anomaly, r.lo, r.nc, (r.hi - r.lo) / r.b AS w,
        CAST(coalesce(least(floor((d.cpu_percent - r.lo) / nullif((r.hi - r.lo) / r.b, 0)), r.b - 1), 0) AS INTEGER) AS bin
      FROM metrics d JOIN (SELECT is_anomaly, min(cpu_percent) AS lo, max(cpu_percent) AS hi, count(*) AS nc,
                                  CASE is_anomaly WHEN 0 THEN 20 ELSE 10 END AS b FROM metrics GROUP BY is_anomaly) r
      USING (is_anomaly)) t
GROUP BY is_anomaly, bin, lo, nc, w"""), ["bin_low", "bin_high", "density"]))
def q_class_histogram(spark, sf_dir):
    return E.class_histogram(load_metrics(spark, sf_dir))


# ------------------------------------------------------------------ E1-E6, M7
def _votes_with_ensemble(spark, sf_dir):
    v = load_votes(spark, sf_dir)
    return v.select("*", E.vote_ensemble(["pred_a", "pred_b"]).alias("vote_ab"),
                    E.vote_ensemble(["pred_a", "pred_b", "pred_c"]).alias("vote_abc"))


_VOTES2 = """votes2 AS (SELECT *, CAST(round_even((pred_a + pred_b) / 2.0, 0) AS INTEGER) AS vote_ab,
  CAST(round_even((pred_a + pred_b + pred_c) / 3.0, 0) AS INTEGER) AS vote_abc FROM votes)"""
_MODELS = ["pred_a", "pred_b", "pred_c", "vote_ab", "vote_abc"]
_SCORE_COLS = ["precision", "recall", "f1", "specificity", "fpr", "accuracy"]


def _eval_sql(models=_MODELS):
    parts = []
    for p in models:
        parts.append(f"""SELECT '{p}' AS model, CAST(count_if({p} = 0 AND truth = 0) AS BIGINT) AS tn,
  CAST(count_if({p} = 1 AND truth = 0) AS BIGINT) AS fp, CAST(count_if({p} = 0 AND truth = 1) AS BIGINT) AS fn,
  CAST(count_if({p} = 1 AND truth = 1) AS BIGINT) AS tp FROM votes2""")
    return " UNION ALL ".join(parts)


_SCORES_SQL = """
SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM (
SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall,
  coalesce(tn / nullif(tn + fp, 0), 0.0) AS specificity, coalesce(fp / nullif(fp + tn, 0), 0.0) AS fpr,
  coalesce((tp + tn) / nullif(tn + fp + fn + tp, 0), 0.0) AS accuracy
FROM ({inner}) c) s"""


@query("vote_ensemble", sql=with_ctes("SELECT host_id, sample_id, vote_ab, vote_abc FROM votes2", VOTES, _VOTES2))
def q_vote_ensemble(spark, sf_dir):
    """M7: half-even rounded mean of member votes."""
    return _votes_with_ensemble(spark, sf_dir).select(HOST, SAMPLE, "vote_ab", "vote_abc")


@query("evaluate_predictions", sql=rounded(with_ctes(_SCORES_SQL.format(inner=_eval_sql()), VOTES, _VOTES2),
                                           _SCORE_COLS))
def q_evaluate_predictions(spark, sf_dir):
    """E1, E2, E3, E5 for three members and two ensembles."""
    return E.evaluate_predictions(_votes_with_ensemble(spark, sf_dir), _MODELS, "truth")


@query("model_leaderboard", sql=rounded(with_ctes(
    "SELECT *, row_number() OVER (ORDER BY f1 DESC, model) AS rank FROM ("
    + _SCORES_SQL.format(inner=_eval_sql()) + ") z", VOTES, _VOTES2), _SCORE_COLS))
def q_model_leaderboard(spark, sf_dir):
    """Ranked by F1."""
    res = E.evaluate_predictions(_votes_with_ensemble(spark, sf_dir), _MODELS, "truth")
    return E.model_leaderboard(res, "f1")


@query("classification_report", sql=rounded(with_ctes("""
SELECT class, precision, recall, f1, support FROM (
  SELECT '0' AS class, p0 AS precision, r0 AS recall, f0 AS f1, s0 AS support FROM k
  UNION ALL SELECT '1', p1, r1, f1, s1 FROM k
  UNION ALL SELECT 'accuracy', NULL, NULL, acc, s0 + s1 FROM k
  UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, s0 + s1 FROM k
  UNION ALL SELECT 'weighted avg', coalesce((p0 * s0 + p1 * s1) / nullif(s0 + s1, 0), 0.0),
    coalesce((r0 * s0 + r1 * s1) / nullif(s0 + s1, 0), 0.0), coalesce((f0 * s0 + f1 * s1) / nullif(s0 + s1, 0), 0.0), s0 + s1 FROM k
) u""", VOTES, _VOTES2, """
c AS (""" + _eval_sql(["pred_a"]) + """)""", """
k AS (SELECT *, coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0.0) AS f0, coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0.0) AS f1 FROM (
  SELECT coalesce(tn / nullif(tn + fn, 0), 0.0) AS p0, coalesce(tn / nullif(tn + fp, 0), 0.0) AS r0,
    coalesce(tp / nullif(tp + fp, 0), 0.0) AS p1, coalesce(tp / nullif(tp + fn, 0), 0.0) AS r1,
    tn + fp AS s0, tp + fn AS s1, coalesce((tp + tn) / nullif(tn + fp + fn + tp, 0), 0.0) AS acc FROM c) x)"""),
    ["precision", "recall", "f1"]))
def q_classification_report(spark, sf_dir):
    """E4 for member ``pred_a``."""
    return E.classification_report(_votes_with_ensemble(spark, sf_dir), "pred_a", "truth")


# ------------------------------------------------------------------ E7, N6
@query("forecast_error", sql=rounded(m("""
SELECT avg(abs(f_cpu - a_cpu)) AS cpu_mae, sqrt(avg((f_cpu - a_cpu) * (f_cpu - a_cpu))) AS cpu_rmse, count(f_cpu - a_cpu) AS cpu_n,
  avg(abs(f_mem - a_mem)) AS memory_mae, sqrt(avg((f_mem - a_mem) * (f_mem - a_mem))) AS memory_rmse, count(f_mem - a_mem) AS memory_n,
  avg(abs(f_disk - a_disk)) AS disk_mae, sqrt(avg((f_disk - a_disk) * (f_disk - a_disk))) AS disk_rmse, count(f_disk - a_disk) AS disk_n
FROM (SELECT least(100.0::DOUBLE, g.cpu_percent + 7.5::DOUBLE) AS f_cpu, least(100.0::DOUBLE, g.memory_percent + 5.0::DOUBLE) AS f_mem,
        least(100.0::DOUBLE, g.disk_usage_percent + 2.5::DOUBLE) AS f_disk,
        a.cpu_percent AS a_cpu, a.memory_percent AS a_mem, a.disk_usage_percent AS a_disk
      FROM fleet_grid g JOIN fleet_grid a ON a."timestamp" = g."timestamp" + INTERVAL 6 HOUR) t""", FLEET_GRID_SQL),
    [f"{r}_{k}" for r in ("cpu", "memory", "disk") for k in ("mae", "rmse")]))
def q_forecast_error(spark, sf_dir):
    """E7 with N6: the 6 h heuristic band midpoint against the fleet grid
    value 6 hours later (self equi-join on the grid time)."""
    g = fleet_grid(load_metrics(spark, sf_dir))
    fc = g.select(F.col(TS).alias("_t"), F.least(F.lit(100.0), F.col(CPU) + 7.5).alias("f_cpu"),
                  F.least(F.lit(100.0), F.col(MEM) + 5.0).alias("f_mem"),
                  F.least(F.lit(100.0), F.col(DISK) + 2.5).alias("f_disk"))
    act = g.select((F.col(TS) - F.expr("INTERVAL 6 HOURS")).alias("_t"), F.col(CPU).alias("a_cpu"),
                   F.col(MEM).alias("a_mem"), F.col(DISK).alias("a_disk"))
    j = fc.join(act, "_t")
    return E.forecast_error(j, {"cpu": ("f_cpu", "a_cpu"), "memory": ("f_mem", "a_mem"), "disk": ("f_disk", "a_disk")})


# ------------------------------------------------------------------ E8
@query("failure_precision", sql=rounded(m(f"""
SELECT CAST(count_if(pred = 1 AND will_fail = 1) AS BIGINT) AS tp, CAST(count_if(pred = 1 AND will_fail = 0) AS BIGINT) AS fp,
  coalesce(count_if(pred = 1 AND will_fail = 1) / nullif(count_if(pred = 1), 0), 0.0) AS failure_precision
FROM (SELECT CAST(anomaly_probability > 0.5 AS INTEGER) AS pred,
        CAST({Q.future_max('cpu_percent', 24)} > 95 OR {Q.future_max('memory_percent', 24)} > 98
             OR {Q.future_max('disk_usage_percent', 24)} > 99 AS INTEGER) AS will_fail,
        {Q.future_max('cpu_percent', 24)} AS fmc FROM scored) t WHERE fmc IS NOT NULL""", SCORED),
    ["failure_precision"]))
def q_failure_precision(spark, sf_dir):
    """Precision of p > 0.5 against the 2-hour failure label."""
    lab = L.will_fail_label(load_scored(spark, sf_dir)).withColumn(
        "pred", (F.col("anomaly_probability") > 0.5).cast("int"))
    tp = F.count_if((F.col("pred") == 1) & (F.col("will_fail") == 1))
    fp = F.count_if((F.col("pred") == 1) & (F.col("will_fail") == 0))
    return lab.agg(tp.alias("tp"), fp.alias("fp"),
                   F.coalesce(F.try_divide(tp.cast("double"), (tp + fp).cast("double")), F.lit(0.0))
                   .alias("failure_precision"))
