"""Step 3/4 queries: risk and report operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import risk as K
from ..operators import alerts as A
from ..operators import reports as RP
from ..operators.rollups import RollupStore
from ..schema import CPU, DISK, HOST, MEM, SAMPLE, TS
from ..session import checkpoint_path
from ..sources import tables
from ..sources.metrics import load_metrics, load_scored, table
from .registry import query, rounded
from .sqlbase import METRICS, SCORED, m, with_ctes

# SQL fragments mirroring functions.risk -----------------------------------
CR = ("CASE WHEN cpu_percent > 85 THEN 'high' WHEN cpu_percent > 70 THEN 'medium' ELSE 'low' END")
MR = ("CASE WHEN memory_percent > 90 THEN 'high' WHEN memory_percent > 75 THEN 'medium' ELSE 'low' END")
DR = ("CASE WHEN disk_usage_percent > 95 THEN 'high' WHEN disk_usage_percent > 80 THEN 'medium' ELSE 'low' END")
OVERALL = (f"CASE WHEN 'high' IN ({CR}, {MR}, {DR}) THEN 'high' "
           f"WHEN 'medium' IN ({CR}, {MR}, {DR}) THEN 'medium' ELSE 'low' END")
TTF = ("CAST(480.0::DOUBLE * least("
       "CASE WHEN cpu_percent > 85 THEN 0.3::DOUBLE WHEN cpu_percent > 70 THEN 0.6::DOUBLE END, "
       "CASE WHEN memory_percent > 90 THEN 0.4::DOUBLE WHEN memory_percent > 75 THEN 0.7::DOUBLE END, "
       "CASE WHEN disk_usage_percent > 95 THEN 0.5::DOUBLE WHEN disk_usage_percent > 80 THEN 0.8::DOUBLE END"
       ") AS INTEGER)")
SCORE = ("(least(cpu_percent / 100.0::DOUBLE, 1.0::DOUBLE) * 0.4::DOUBLE"
         " + least(memory_percent / 100.0::DOUBLE, 1.0::DOUBLE) * 0.35::DOUBLE"
         " + least(disk_usage_percent / 100.0::DOUBLE, 1.0::DOUBLE) * 0.25::DOUBLE)")
LATEST = """latest AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY host_id
  ORDER BY "timestamp" DESC, sample_id DESC) AS r FROM metrics) t WHERE r = 1)"""


def _band_sql(col, lo, hi, name):
    return (f"least(100.0::DOUBLE, {col} + {float(lo)}::DOUBLE) AS {name}_low, "
            f"least(100.0::DOUBLE, {col} + {(lo + hi) / 2.0}::DOUBLE) AS {name}_mid, "
            f"least(100.0::DOUBLE, {col} + {float(hi)}::DOUBLE) AS {name}_high")


def _latest(spark, sf_dir):
    return tables.latest_sample(load_metrics(spark, sf_dir))


# ------------------------------------------------------------------ R1-R6, R29, R30
@query("risk_levels", sql=rounded(m(f"""
SELECT host_id, sample_id, {CR} AS cpu_risk, {MR} AS memory_risk, {DR} AS disk_risk,
  {OVERALL} AS overall_risk, {TTF} AS time_to_failure,
  floor({SCORE} * 1000.0 + 0.5) / 1000.0 AS risk_score,
  CASE WHEN {SCORE} > 0.7 THEN 'high' WHEN {SCORE} > 0.4 THEN 'medium' ELSE 'low' END AS score_risk_level,
  CASE WHEN {SCORE} > 0.7 THEN '2-4 hours' WHEN {SCORE} > 0.4 THEN '6-12 hours' ELSE '12+ hours' END AS failure_window
FROM metrics"""), ["risk_score"]))
def q_risk_levels(spark, sf_dir):
    """R1-R6 for every sample."""
    mt = load_metrics(spark, sf_dir)
    cr, mr, dr = K.component_risk(CPU), K.component_risk(MEM), K.component_risk(DISK)
    s = K.risk_score()
    return mt.select(HOST, SAMPLE, cr.alias("cpu_risk"), mr.alias("memory_risk"), dr.alias("disk_risk"),
                     K.overall_risk(cr, mr, dr).alias("overall_risk"),
                     K.time_to_failure().alias("time_to_failure"),
                     K.risk_score_rounded().alias("risk_score"), K.score_risk_level(s).alias("score_risk_level"),
                     K.failure_window(s).alias("failure_window"))


@query("format_ttf", sql=m(f"""
SELECT host_id, sample_id, ttf AS time_to_failure,
  CASE WHEN ttf IS NULL OR ttf = 0 THEN 'No imminent failure'
       WHEN ttf < 60 THEN CAST(ttf AS VARCHAR) || ' minutes'
       WHEN ttf % 60 > 0 THEN CAST(ttf // 60 AS VARCHAR) || 'h ' || CAST(ttf % 60 AS VARCHAR) || 'm'
       ELSE CAST(ttf // 60 AS VARCHAR) || 'h' END AS time_to_failure_text
FROM (SELECT host_id, sample_id, {TTF} AS ttf FROM metrics) t"""))
def q_format_ttf(spark, sf_dir):
    """R29 over R3."""
    mt = load_metrics(spark, sf_dir).select(HOST, SAMPLE, K.time_to_failure().alias("time_to_failure"))
    return mt.select("*", K.format_ttf(F.col("time_to_failure")).alias("time_to_failure_text"))


@query("risk_labels", sql=m(f"""
SELECT host_id, sample_id, lvl AS overall_risk,
  CASE lvl WHEN 'low' THEN 'Low Risk' WHEN 'medium' THEN 'Medium Risk' WHEN 'high' THEN 'High Risk'
           ELSE 'System Optimal' END AS risk_label,
  CASE lvl WHEN 'low' THEN 'System stable' WHEN 'medium' THEN 'Monitor closely'
           WHEN 'high' THEN 'Immediate attention needed' ELSE 'Optimal performance' END AS risk_description
FROM (SELECT host_id, sample_id, {OVERALL} AS lvl FROM metrics) t"""))
def q_risk_labels(spark, sf_dir):
    """R30 over R2."""
    mt = load_metrics(spark, sf_dir)
    cr, mr, dr = K.component_risk(CPU), K.component_risk(MEM), K.component_risk(DISK)
    lv = K.overall_risk(cr, mr, dr)
    lab, desc = K.risk_label(lv)
    return mt.select(HOST, SAMPLE, lv.alias("overall_risk"), lab.alias("risk_label"),
                     desc.alias("risk_description"))


# ------------------------------------------------------------------ R11-R14
_R11_DOUBLES = [f"{s}_{h}_{p}" for s, h in (("cpu", "1h"), ("memory", "1h"), ("cpu", "6h"), ("memory", "6h"),
                                            ("disk", "6h")) for p in ("low", "mid", "high")]


@query("heuristic_forecast_band", sql=rounded(with_ctes(f"""
SELECT host_id, sample_id, "timestamp", cpu_percent, memory_percent, disk_usage_percent,
  {_band_sql('cpu_percent', -5, 10, 'cpu_1h')}, {_band_sql('memory_percent', -3, 8, 'memory_1h')},
  {_band_sql('cpu_percent', -10, 25, 'cpu_6h')}, {_band_sql('memory_percent', -5, 15, 'memory_6h')},
  {_band_sql('disk_usage_percent', 0, 5, 'disk_6h')},
  CASE WHEN cpu_percent > 80 THEN 0.1::DOUBLE ELSE 0.02::DOUBLE END AS anomaly_probability_1h,
  CASE WHEN cpu_percent > 70 THEN 'increasing' ELSE 'stable' END AS trend_1h,
  CASE WHEN cpu_percent > 85 THEN 0.3::DOUBLE WHEN cpu_percent > 70 THEN 0.1::DOUBLE ELSE 0.02::DOUBLE END AS failure_probability_6h,
  CASE WHEN cpu_percent > 80 THEN 'Increase monitoring' ELSE 'Normal operation' END AS recommended_action_6h
FROM latest""", METRICS, LATEST), _R11_DOUBLES + [CPU, MEM, DISK, "anomaly_probability_1h", "failure_probability_6h"]))
def q_heuristic_forecast_band(spark, sf_dir):
    return RP.heuristic_forecast_band(_latest(spark, sf_dir))


_R12 = [("cpu", "cpu_percent", "1h", -5, 8), ("cpu", "cpu_percent", "3h", -8, 15), ("cpu", "cpu_percent", "6h", -10, 20),
        ("memory", "memory_percent", "1h", -3, 6), ("memory", "memory_percent", "3h", -5, 12),
        ("memory", "memory_percent", "6h", -8, 18), ("disk", "disk_usage_percent", "6h", 0, 3)]


@query("resource_forecast_band", sql=rounded(with_ctes(
    'SELECT host_id, sample_id, "timestamp", cpu_percent, memory_percent, disk_usage_percent, '
    + ", ".join(_band_sql(c, lo, hi, f"{s}_{h}") for s, c, h, lo, hi in _R12) + " FROM latest", METRICS, LATEST),
    [f"{s}_{h}_{p}" for s, _, h, _, _ in _R12 for p in ("low", "mid", "high")] + [CPU, MEM, DISK]))
def q_resource_forecast_band(spark, sf_dir):
    return RP.resource_forecast_band(_latest(spark, sf_dir))


_ANOM = ("concat_ws(' | ', "
         "CASE WHEN cpu_percent > 90 THEN 'CPU usage critically high' WHEN cpu_percent > 80 THEN 'CPU usage elevated' END, "
         "CASE WHEN memory_percent > 95 THEN 'Memory usage critically high' WHEN memory_percent > 85 THEN 'Memory usage elevated' END, "
         "CASE WHEN disk_usage_percent > 98 THEN 'Disk space critically low' WHEN disk_usage_percent > 90 THEN 'Disk space low' END)")
_RECS = ("CASE WHEN cpu_percent > 80 OR memory_percent > 85 OR disk_usage_percent > 90 THEN concat_ws(' | ', "
         "CASE WHEN cpu_percent > 80 THEN 'Consider optimizing CPU-intensive processes | Monitor application performance' END, "
         "CASE WHEN memory_percent > 85 THEN 'Check for memory leaks in applications | Consider adding more RAM if pattern persists' END, "
         "CASE WHEN disk_usage_percent > 90 THEN 'Clean up temporary files and logs | Consider archiving old data' END) "
         "ELSE 'System operating within normal parameters | Continue regular monitoring' END")


@query("prediction_report", sql=rounded(with_ctes(f"""
SELECT host_id, sample_id, "timestamp", {OVERALL} AS overall_risk, {TTF} AS time_to_failure,
  {CR} AS cpu_risk, {MR} AS memory_risk, {DR} AS disk_risk,
  least(100.0::DOUBLE, cpu_percent + 2.5::DOUBLE) AS cpu_1h,
  least(100.0::DOUBLE, memory_percent + 2.5::DOUBLE) AS memory_1h,
  CASE WHEN cpu_percent > 80 THEN 0.1::DOUBLE ELSE 0.02::DOUBLE END AS anomaly_probability_1h,
  CASE WHEN cpu_percent > 70 THEN 'increasing' ELSE 'stable' END AS trend_1h,
  least(100.0::DOUBLE, cpu_percent + 7.5::DOUBLE) AS cpu_6h,
  least(100.0::DOUBLE, memory_percent + 5.0::DOUBLE) AS memory_6h,
  least(100.0::DOUBLE, disk_usage_percent + 2.5::DOUBLE) AS disk_6h,
  CASE WHEN cpu_percent > 85 THEN 0.3::DOUBLE WHEN cpu_percent > 70 THEN 0.1::DOUBLE ELSE 0.02::DOUBLE END AS failure_probability_6h,
  CASE WHEN cpu_percent > 80 THEN 'Increase monitoring' ELSE 'Normal operation' END AS recommended_action_6h,
  {_ANOM} AS anomalies_detected, {_RECS} AS recommendations
FROM latest""", METRICS, LATEST), ["cpu_1h", "memory_1h", "anomaly_probability_1h", "cpu_6h", "memory_6h",
                                   "disk_6h", "failure_probability_6h"]))
def q_prediction_report(spark, sf_dir):
    """R13 (flattened): nested per-host prediction record."""
    return RP.flatten_prediction_report(RP.prediction_report(_latest(spark, sf_dir)))


@query("failure_risk_report", sql=rounded(with_ctes(f"""
SELECT host_id, sample_id, "timestamp",
  CASE WHEN {SCORE} > 0.7 THEN 'high' WHEN {SCORE} > 0.4 THEN 'medium' ELSE 'low' END AS overall_risk_level,
  floor({SCORE} * 1000.0 + 0.5) / 1000.0 AS risk_score,
  CASE WHEN {SCORE} > 0.7 THEN '2-4 hours' WHEN {SCORE} > 0.4 THEN '6-12 hours' ELSE '12+ hours' END AS time_to_potential_failure,
  coalesce(nullif(concat_ws(' | ', CASE WHEN cpu_percent > 75 THEN 'CPU' END, CASE WHEN memory_percent > 80 THEN 'Memory' END,
           CASE WHEN disk_usage_percent > 85 THEN 'Disk' END), ''), 'None') AS most_at_risk_components,
  coalesce(nullif(concat_ws(' | ', CASE WHEN cpu_percent > 75 THEN 'Monitor CPU-intensive processes' END,
           CASE WHEN memory_percent > 80 THEN 'Check memory allocation' END,
           CASE WHEN disk_usage_percent > 85 THEN 'Clean up disk space' END), ''), 'Continue normal monitoring') AS preventive_actions,
  0.92::DOUBLE AS confidence
FROM latest""", METRICS, LATEST), ["risk_score", "confidence"]))
def q_failure_risk_report(spark, sf_dir):
    """R14 (lists joined with ' | ')."""
    r = RP.failure_risk_report(_latest(spark, sf_dir))
    return r.withColumn("most_at_risk_components", F.array_join("most_at_risk_components", " | ")) \
            .withColumn("preventive_actions", F.array_join("preventive_actions", " | "))


# ------------------------------------------------------------------ R15, R16, R31
@query("fallback_forecast", sql=rounded(with_ctes("""
SELECT h.host_id,
  CASE WHEN c.host_id IS NULL THEN 'unknown'
       WHEN c.memory_percent > 90 OR c.cpu_percent > 90 THEN 'high'
       WHEN c.memory_percent > 85 OR c.cpu_percent > 80 THEN 'medium' ELSE 'low' END AS overall_risk,
  CASE WHEN c.host_id IS NOT NULL THEN 0.7::DOUBLE END AS confidence, true AS fallback_mode,
  CASE WHEN c.host_id IS NOT NULL THEN (CASE WHEN cpu_percent > 85 THEN 'high' WHEN cpu_percent > 70 THEN 'medium' ELSE 'low' END) END AS cpu_risk,
  CASE WHEN c.host_id IS NOT NULL THEN (CASE WHEN memory_percent > 90 THEN 'high' WHEN memory_percent > 75 THEN 'medium' ELSE 'low' END) END AS memory_risk,
  CASE WHEN c.host_id IS NOT NULL THEN (CASE WHEN disk_usage_percent > 95 THEN 'high' WHEN disk_usage_percent > 80 THEN 'medium' ELSE 'low' END) END AS disk_risk
FROM (SELECT DISTINCT user_id AS host_id FROM events) h
LEFT JOIN (SELECT * FROM latest WHERE "timestamp" > (SELECT max("timestamp") FROM metrics) - INTERVAL 24 HOURS) c
  ON c.host_id = h.host_id""", METRICS, LATEST), ["confidence"]))
def q_fallback_forecast(spark, sf_dir):
    """Hosts without a sample in the last 24 h fall back to 'unknown'."""
    mt = load_metrics(spark, sf_dir)
    hosts = table(spark, sf_dir, "events").select(F.col("user_id").alias(HOST)).distinct()
    current = tables.latest_sample(tables.metrics_history(mt, hours=24, cap=1))
    return RP.fallback_forecast(hosts, current)


@query("system_insights", sql=with_ctes("""
SELECT host_id, sample_id, "timestamp", rr AS realtime_risk,
  coalesce(nullif(concat_ws(' | ', CASE WHEN memory_percent > 85 THEN 'High memory usage detected' END,
    CASE WHEN cpu_percent > 80 THEN 'Elevated CPU usage' END), ''), 'System operating within normal parameters') AS insights,
  CASE rr WHEN 'high' THEN 'Critical Attention Needed' WHEN 'medium' THEN 'Monitor Closely' ELSE 'Stable Operation' END AS status_text
FROM (SELECT *, CASE WHEN memory_percent > 90 OR cpu_percent > 90 OR disk_usage_percent > 95 THEN 'high'
                     WHEN memory_percent > 85 OR cpu_percent > 80 OR disk_usage_percent > 90 THEN 'medium'
                     ELSE 'low' END AS rr FROM latest) t""", METRICS, LATEST))
def q_system_insights(spark, sf_dir):
    """R16 real-time risk + R31 insights and status text."""
    return RP.system_insights(_latest(spark, sf_dir))


# ------------------------------------------------------------------ R17-R19
@query("forecast_alerts", sql=rounded(m("""
SELECT host_id, sample_id, "timestamp", level, title, message, predicted_value, '6 hours' AS time_horizon, confidence
FROM (
  SELECT host_id, sample_id, "timestamp", 0.85::DOUBLE AS confidence,
         unnest([CASE WHEN cpu_6h > 90 THEN {'level': 'warning', 'title': 'CPU Usage Forecast Alert',
                      'message': 'CPU usage predicted to reach ' || CAST(floor(cpu_6h * 10.0 + 0.5) / 10.0 AS VARCHAR) || '% in 6 hours. Consider optimizing workloads.', 'predicted_value': cpu_6h} END,
                 CASE WHEN memory_6h > 85 THEN {'level': 'warning', 'title': 'Memory Usage Forecast Alert',
                      'message': 'Memory usage predicted to reach ' || CAST(floor(memory_6h * 10.0 + 0.5) / 10.0 AS VARCHAR) || '% in 6 hours. Monitor for memory leaks.', 'predicted_value': memory_6h} END,
                 CASE WHEN disk_6h > 90 THEN {'level': 'critical', 'title': 'Disk Space Forecast Alert',
                      'message': 'Disk usage predicted to reach ' || CAST(floor(disk_6h * 10.0 + 0.5) / 10.0 AS VARCHAR) || '% in 6 hours. Free up disk space immediately.', 'predicted_value': disk_6h} END], recursive := true)
  FROM (SELECT host_id, sample_id, "timestamp",
          least(100.0::DOUBLE, cpu_percent + 25.0::DOUBLE) AS cpu_6h,
          least(100.0::DOUBLE, memory_percent + 15.0::DOUBLE) AS memory_6h,
          least(100.0::DOUBLE, disk_usage_percent + 5.0::DOUBLE) AS disk_6h FROM metrics) f
) t WHERE level IS NOT NULL"""), ["predicted_value", "confidence"]))
def q_forecast_alerts(spark, sf_dir):
    """R17 over the upper 6 h band of R11 for every sample (confidence 0.85)."""
    mt = load_metrics(spark, sf_dir)
    fc = mt.select(HOST, SAMPLE, TS,
                   F.least(F.lit(100.0), F.col(CPU) + 25.0).alias("cpu_6h"),
                   F.least(F.lit(100.0), F.col(MEM) + 15.0).alias("memory_6h"),
                   F.least(F.lit(100.0), F.col(DISK) + 5.0).alias("disk_6h"),
                   F.lit(0.85).alias("confidence"))
    return RP.forecast_alerts(fc)


_R18_SQL = """
r18 AS (SELECT host_id, sample_id, "timestamp", anomaly_probability AS failure_probability,
  anomaly_probability > 0.5 AS will_fail,
  CASE WHEN anomaly_probability > 0.5 THEN anomaly_probability ELSE 1.0::DOUBLE - anomaly_probability END AS confidence,
  '2 hours' AS time_horizon,
  CASE WHEN anomaly_probability < 0.3 THEN 'low' WHEN anomaly_probability < 0.7 THEN 'medium' ELSE 'high' END AS risk_level
FROM scored)"""


@query("failure_prediction_report", sql=rounded(m("SELECT * FROM r18", SCORED, _R18_SQL),
                                                ["failure_probability", "confidence"]))
def q_failure_prediction_report(spark, sf_dir):
    """R18 on the ``scored`` fixture's probability."""
    sc = load_scored(spark, sf_dir).withColumnRenamed("anomaly_probability", "failure_probability")
    return RP.failure_prediction_report(sc)


@query("failure_alerts", sql=rounded(m("""
SELECT host_id, sample_id, "timestamp",
  CASE WHEN crit THEN 'critical' ELSE 'warning' END AS level,
  CASE WHEN crit THEN 'IMMINENT SYSTEM FAILURE PREDICTED' ELSE 'Potential System Issue Detected' END AS title,
  CASE WHEN crit THEN 'High probability (' || CAST(floor(failure_probability * 100.0 * 10.0 + 0.5) / 10.0 AS VARCHAR) || '%) of system failure within ' || time_horizon || '. Take immediate action.'
       ELSE 'Moderate probability (' || CAST(floor(failure_probability * 100.0 * 10.0 + 0.5) / 10.0 AS VARCHAR) || '%) of system issues within ' || time_horizon || '. Monitor closely.' END AS message,
  failure_probability AS probability, time_horizon, confidence
FROM (SELECT *, risk_level = 'high' AND failure_probability > 0.8 AS crit,
             risk_level = 'medium' AND failure_probability > 0.5 AS warn FROM r18) t
WHERE crit OR warn""", SCORED, _R18_SQL), ["probability", "confidence"]))
def q_failure_alerts(spark, sf_dir):
    """R19 (probabilities in (0.7, 0.8] raise none, as in the reference)."""
    sc = load_scored(spark, sf_dir).withColumnRenamed("anomaly_probability", "failure_probability")
    return RP.failure_alerts(RP.failure_prediction_report(sc))


# ------------------------------------------------------------------ G5, G8, R20-R23
_TAIL = """tail AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY host_id
  ORDER BY "timestamp" DESC, sample_id DESC) AS r FROM metrics) t WHERE r <= {n})"""


@query("health_window", sql=rounded(m("""
SELECT host_id, avg(cpu_percent) AS avg_cpu, avg(memory_percent) AS avg_memory, count(*) AS window_samples
FROM tail GROUP BY host_id""", _TAIL.format(n=10)), ["avg_cpu", "avg_memory"]))
def q_health_window(spark, sf_dir):
    return RP.health_window(load_metrics(spark, sf_dir), 10)


@query("serving_window_stats", sql=rounded(m("""
SELECT host_id, avg(cpu_percent) AS cpu_mean_12, stddev_samp(cpu_percent) AS cpu_std_12,
  max(cpu_percent) AS cpu_max_12, avg(memory_percent) AS memory_mean_12,
  stddev_samp(memory_percent) AS memory_std_12, max(memory_percent) AS memory_max_12
FROM tail GROUP BY host_id""", _TAIL.format(n=12)),
    ["cpu_mean_12", "cpu_std_12", "cpu_max_12", "memory_mean_12", "memory_std_12", "memory_max_12"]))
def q_serving_window_stats(spark, sf_dir):
    return RP.serving_window_stats(load_metrics(spark, sf_dir), 12)


@query("usage_status", sql=m("""
SELECT host_id, sample_id,
  CASE WHEN cpu_percent >= 80 THEN 'critical' WHEN cpu_percent >= 60 THEN 'warning' ELSE 'normal' END AS cpu_status,
  CASE WHEN memory_percent >= 80 THEN 'critical' WHEN memory_percent >= 60 THEN 'warning' ELSE 'normal' END AS memory_status,
  CASE WHEN disk_usage_percent >= 90 THEN 'critical' WHEN disk_usage_percent >= 80 THEN 'warning' ELSE 'normal' END AS disk_status,
  round(greatest(0.0::DOUBLE, 100.0::DOUBLE - (cpu_percent * 0.3::DOUBLE + memory_percent * 0.2::DOUBLE)), 6) + 0.0 AS health_score,
  CASE WHEN h >= 80 THEN 'normal' WHEN h >= 60 THEN 'warning' ELSE 'critical' END AS health_status
FROM (SELECT *, greatest(0.0::DOUBLE, 100.0::DOUBLE - (cpu_percent * 0.3::DOUBLE + memory_percent * 0.2::DOUBLE)) AS h
      FROM metrics) t"""))
def q_usage_status(spark, sf_dir):
    """R21 statuses + R20 (c) current health with its colour band."""
    mt = load_metrics(spark, sf_dir)
    h = RP.health_score_current()
    return mt.select(HOST, SAMPLE, K.usage_status(CPU).alias("cpu_status"),
                     K.usage_status(MEM).alias("memory_status"), K.usage_status(DISK).alias("disk_status"),
                     h.alias("health_score"), K.health_status(h).alias("health_status"))


def _chart_sql(n: int, minutes: int) -> str:
    """SQL of a chart of ``n`` buckets of ``minutes``."""
    return CHART_SQL.replace("INTERVAL 55 MINUTE", f"INTERVAL {(n - 1) * minutes} MINUTE").replace("INTERVAL 5 MINUTE", f"INTERVAL {minutes} MINUTE")


CHART_SQL = rounded(m("""
SELECT host_id, bucket,
  cpu_percent AS cpu_current, avg(cpu_percent) OVER h AS cpu_avg, max(cpu_percent) OVER h AS cpu_max,
  min(cpu_percent) OVER h AS cpu_min, abs(cpu_percent - lag(cpu_percent) OVER w) AS cpu_delta,
  CASE WHEN lag(cpu_percent) OVER w IS NULL THEN NULL WHEN cpu_percent > lag(cpu_percent) OVER w THEN 'up' ELSE 'down' END AS cpu_direction,
  CASE WHEN cpu_percent >= 85 THEN 'critical' WHEN cpu_percent >= 70 THEN 'warning' ELSE 'normal' END AS cpu_status,
  memory_percent AS memory_current, avg(memory_percent) OVER h AS memory_avg, max(memory_percent) OVER h AS memory_max,
  min(memory_percent) OVER h AS memory_min, abs(memory_percent - lag(memory_percent) OVER w) AS memory_delta,
  CASE WHEN lag(memory_percent) OVER w IS NULL THEN NULL WHEN memory_percent > lag(memory_percent) OVER w THEN 'up' ELSE 'down' END AS memory_direction,
  CASE WHEN memory_percent >= 90 THEN 'critical' WHEN memory_percent >= 75 THEN 'warning' ELSE 'normal' END AS memory_status,
  disk_usage_percent AS disk_current, avg(disk_usage_percent) OVER h AS disk_avg, max(disk_usage_percent) OVER h AS disk_max,
  min(disk_usage_percent) OVER h AS disk_min, abs(disk_usage_percent - lag(disk_usage_percent) OVER w) AS disk_delta,
  CASE WHEN lag(disk_usage_percent) OVER w IS NULL THEN NULL WHEN disk_usage_percent > lag(disk_usage_percent) OVER w THEN 'up' ELSE 'down' END AS disk_direction,
  CASE WHEN disk_usage_percent >= 95 THEN 'critical' WHEN disk_usage_percent >= 80 THEN 'warning' ELSE 'normal' END AS disk_status
FROM (
  SELECT host_id, bucket,
    coalesce(cpu_percent, last_value(cpu_percent IGNORE NULLS) OVER f) AS cpu_percent,
    coalesce(memory_percent, last_value(memory_percent IGNORE NULLS) OVER f) AS memory_percent,
    coalesce(disk_usage_percent, last_value(disk_usage_percent IGNORE NULLS) OVER f) AS disk_usage_percent
  FROM (
    SELECT c.host_id, c.bucket, b.cpu_percent, b.memory_percent, b.disk_usage_percent
    FROM (SELECT host_id, unnest(generate_series(max(bucket) - INTERVAL 55 MINUTE, max(bucket), INTERVAL 5 MINUTE)) AS bucket
          FROM buckets GROUP BY host_id) c
    LEFT JOIN buckets b ON b.host_id = c.host_id AND b.bucket = c.bucket
    UNION ALL
    SELECT host_id, NULL::TIMESTAMP AS bucket, cpu_percent, memory_percent, disk_usage_percent FROM (
      SELECT b.*, row_number() OVER (PARTITION BY b.host_id ORDER BY b.bucket DESC) AS r
      FROM buckets b JOIN (SELECT host_id, max(bucket) AS mb FROM buckets GROUP BY host_id) x
        ON x.host_id = b.host_id AND b.bucket < x.mb - INTERVAL 55 MINUTE) y WHERE r = 1
  ) g
  WINDOW f AS (PARTITION BY host_id ORDER BY bucket NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
) v
WHERE bucket IS NOT NULL
WINDOW w AS (PARTITION BY host_id ORDER BY bucket), h AS (PARTITION BY host_id)
QUALIFY row_number() OVER (PARTITION BY host_id ORDER BY bucket DESC) = 1""",
    """buckets AS (SELECT host_id, time_bucket(INTERVAL 5 MINUTE, "timestamp") AS bucket, avg(cpu_percent) AS cpu_percent,
       avg(memory_percent) AS memory_percent, avg(disk_usage_percent) AS disk_usage_percent FROM metrics GROUP BY ALL)"""),
    [f"{s}_{k}" for s in ("cpu", "memory", "disk") for k in ("current", "avg", "max", "min", "delta")])


@query("chart_series", sql=CHART_SQL)
def q_chart_series(spark, sf_dir):
    """R23 for the 1 h range (12 x 5-minute buckets): latest point per host."""
    return RP.chart_series(load_metrics(spark, sf_dir), "1h")


def _rollups(spark, sf_dir):
    """The tree of roll-ups, filled in three batches by time."""
    mt = load_metrics(spark, sf_dir)
    store = RollupStore(spark, checkpoint_path(spark, f"rollups/{uuid.uuid4().hex[:12]}"))
    lo, hi = mt.agg(F.percentile_approx(F.unix_micros(F.col(TS).cast("timestamp")), [0.4, 0.8])).first()[0]
    t = F.unix_micros(F.col(TS).cast("timestamp"))
    for i, part in enumerate((t < lo, (t >= lo) & (t < hi), t >= hi)):
        store.add(mt.filter(part), i)
    return store


def _register_charts():
    for name, (n, period) in RP.CHART_RANGES.items():
        def run(spark, sf_dir, n=n, period=period):
            return RP.chart_of_buckets(_rollups(spark, sf_dir).buckets(period), n, period)
        run.__name__ = f"q_chart_rollup_{name}"
        run.__doc__ = f"R23 for the {name} range ({n} x {period}) from the roll-up tree."
        query(f"chart_rollup_{name}", sql=_chart_sql(n, int(period.split()[0])))(run)


_register_charts()


@query("rollup_summary", sql=rounded(m("""
SELECT host_id, count(*) AS samples, avg(cpu_percent) AS avg_cpu_percent, avg(memory_percent) AS avg_memory_percent,
  avg(disk_usage_percent) AS avg_disk_usage_percent, max(cpu_percent) AS max_cpu_percent, max(memory_percent) AS max_memory_percent,
  max(disk_usage_percent) AS max_disk_usage_percent, arg_max(cpu_percent, ("timestamp", sample_id)) AS last_cpu_percent,
  arg_max(memory_percent, ("timestamp", sample_id)) AS last_memory_percent,
  arg_max(disk_usage_percent, ("timestamp", sample_id)) AS last_disk_usage_percent
FROM metrics GROUP BY host_id"""), [f"{a}_{c}" for a in ("avg", "max", "last") for c in ("cpu_percent", "memory_percent", "disk_usage_percent")]))
def q_rollup_summary(spark, sf_dir):
    """A host's totals and latest values from the hourly level alone."""
    return _rollups(spark, sf_dir).summary()
