"""Step 1 queries: table reads, projections, and the minimum end-to-end slice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import risk as K
from ..functions import scalar as S
from ..schema import CPU, DISK, HOST, LABEL, MEM, MEM_USED, SAMPLE, TS
from ..sources import tables
from ..sources.metrics import load_metrics
from .registry import query, rounded
from .sqlbase import m

# ---------------------------------------------------------------- flagship


def host_risk_snapshot(metrics: DataFrame, k: int = 5) -> DataFrame:
    """Latest sample of every host with trailing statistics and risk.

    Only the last ``k`` rows of a host feed its latest row's ``k``-row
    frames, so the top-k read (partial WindowGroupLimit before the shuffle)
    runs first and the windows work on at most ``k`` rows per host.
    """
    tail = tables.last_n_per_host(metrics, k, "_r")
    w = Window.partitionBy(HOST).orderBy(TS, SAMPLE)
    frame = w.rowsBetween(-(k - 1), 0)
    prev = F.lag(CPU, 1).over(w)
    feats = tail.select(
        HOST, SAMPLE, TS, CPU, MEM, DISK, "_r",
        F.avg(CPU).over(frame).alias(f"cpu_rolling_mean_{k}"),
        F.stddev_samp(CPU).over(frame).alias(f"cpu_rolling_std_{k}"),
        F.max(CPU).over(frame).alias(f"cpu_rolling_max_{k}"),
        F.avg(MEM).over(frame).alias(f"memory_rolling_mean_{k}"),
        F.coalesce(F.try_divide(F.col(CPU) - prev, prev), F.lit(0.0)).alias("cpu_roc"),
    ).filter(F.col("_r") == 1).drop("_r")
    cr, mr, dr = K.component_risk(CPU), K.component_risk(MEM), K.component_risk(DISK)
    return feats.select(
        "*", cr.alias("cpu_risk"), mr.alias("memory_risk"), dr.alias("disk_risk"),
        K.overall_risk(cr, mr, dr).alias("overall_risk"),
        K.risk_score_rounded().alias("risk_score"),
        K.time_to_failure().alias("time_to_failure"))


_SNAPSHOT_SQL = m("""
SELECT host_id, sample_id, "timestamp", cpu_percent, memory_percent, disk_usage_percent,
       cpu_rolling_mean_5, cpu_rolling_std_5, cpu_rolling_max_5, memory_rolling_mean_5, cpu_roc,
       cpu_risk, memory_risk, disk_risk,
       CASE WHEN 'high' IN (cpu_risk, memory_risk, disk_risk) THEN 'high'
            WHEN 'medium' IN (cpu_risk, memory_risk, disk_risk) THEN 'medium' ELSE 'low' END AS overall_risk,
       floor((least(cpu_percent / 100.0::DOUBLE, 1.0::DOUBLE) * 0.4::DOUBLE
           + least(memory_percent / 100.0::DOUBLE, 1.0::DOUBLE) * 0.35::DOUBLE
           + least(disk_usage_percent / 100.0::DOUBLE, 1.0::DOUBLE) * 0.25::DOUBLE) * 1000.0 + 0.5) / 1000.0 AS risk_score,
       CAST(480.0::DOUBLE * least(
            CASE WHEN cpu_percent > 85 THEN 0.3::DOUBLE WHEN cpu_percent > 70 THEN 0.6::DOUBLE END,
            CASE WHEN memory_percent > 90 THEN 0.4::DOUBLE WHEN memory_percent > 75 THEN 0.7::DOUBLE END,
            CASE WHEN disk_usage_percent > 95 THEN 0.5::DOUBLE WHEN disk_usage_percent > 80 THEN 0.8::DOUBLE END)
            AS INTEGER) AS time_to_failure
FROM (
  SELECT *,
    CASE WHEN cpu_percent > 85 THEN 'high' WHEN cpu_percent > 70 THEN 'medium' ELSE 'low' END AS cpu_risk,
    CASE WHEN memory_percent > 90 THEN 'high' WHEN memory_percent > 75 THEN 'medium' ELSE 'low' END AS memory_risk,
    CASE WHEN disk_usage_percent > 95 THEN 'high' WHEN disk_usage_percent > 80 THEN 'medium' ELSE 'low' END AS disk_risk
  FROM (
    SELECT host_id, sample_id, "timestamp", cpu_percent, memory_percent, disk_usage_percent,
      avg(cpu_percent) OVER w5 AS cpu_rolling_mean_5,
      stddev_samp(cpu_percent) OVER w5 AS cpu_rolling_std_5,
      max(cpu_percent) OVER w5 AS cpu_rolling_max_5,
      avg(memory_percent) OVER w5 AS memory_rolling_mean_5,
      coalesce((cpu_percent - lag(cpu_percent) OVER w) / nullif(lag(cpu_percent) OVER w, 0), 0.0::DOUBLE) AS cpu_roc,
      row_number() OVER (PARTITION BY host_id ORDER BY "timestamp" DESC, sample_id DESC) AS r
    FROM metrics
    WINDOW w AS (PARTITION BY host_id ORDER BY "timestamp", sample_id),
           w5 AS (PARTITION BY host_id ORDER BY "timestamp", sample_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)
  ) a WHERE r = 1
) b""")


@query("host_risk_snapshot", sql=rounded(_SNAPSHOT_SQL, [
    "cpu_percent", "memory_percent", "disk_usage_percent", "cpu_rolling_mean_5",
    "cpu_rolling_std_5", "cpu_rolling_max_5", "memory_rolling_mean_5", "cpu_roc", "risk_score"]))
def q_host_risk_snapshot(spark, sf_dir):
    """Minimum slice: adapter -> W1/W2/W3/W6 -> R1-R4 -> S7, one row per host."""
    return host_risk_snapshot(load_metrics(spark, sf_dir))


# ------------------------------------------------------------- S3 - S8

@query("table_stats", sql=m("""
SELECT host_id, count(*) AS samples, max("timestamp") AS latest
FROM metrics GROUP BY ROLLUP (host_id)"""))
def q_table_stats(spark, sf_dir):
    return tables.table_stats(load_metrics(spark, sf_dir))


_METRIC_DOUBLES = ["cpu_percent", "memory_percent", "memory_used_gb", "memory_available_gb",
                   "disk_usage_percent", "disk_used_gb", "disk_free_gb"]


@query("latest_n_samples", sql=rounded(m("""
SELECT * FROM (SELECT * FROM metrics ORDER BY "timestamp" DESC, sample_id DESC LIMIT 5000) t
ORDER BY "timestamp", sample_id"""), _METRIC_DOUBLES))
def q_latest_n_samples(spark, sf_dir):
    return tables.latest_n_samples(load_metrics(spark, sf_dir), 5000)


@query("metrics_history", sql=rounded(m("""
SELECT * EXCLUDE (r) FROM (
  SELECT *, row_number() OVER (PARTITION BY host_id ORDER BY "timestamp" DESC, sample_id DESC) AS r
  FROM metrics WHERE "timestamp" > (SELECT max("timestamp") FROM metrics) - INTERVAL 24 HOURS
) t WHERE r <= 288"""), _METRIC_DOUBLES))
def q_metrics_history(spark, sf_dir):
    return tables.metrics_history(load_metrics(spark, sf_dir), hours=24, cap=288)


@query("latest_sample", sql=rounded(m("""
SELECT * EXCLUDE (r) FROM (
  SELECT *, row_number() OVER (PARTITION BY host_id ORDER BY "timestamp" DESC, sample_id DESC) AS r
  FROM metrics) t WHERE r = 1"""), _METRIC_DOUBLES))
def q_latest_sample(spark, sf_dir):
    return tables.latest_sample(load_metrics(spark, sf_dir))


@query("last_n_per_host", sql=rounded(m("""
SELECT * FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY host_id ORDER BY "timestamp" DESC, sample_id DESC) AS INTEGER) AS recency_rank
  FROM metrics) t WHERE recency_rank <= 20"""), _METRIC_DOUBLES))
def q_last_n_per_host(spark, sf_dir):
    return tables.last_n_per_host(load_metrics(spark, sf_dir), 20)


# ------------------------------------------------------------- P1 - P5

@query("bytes_to_gb", sql=m("""
SELECT host_id, sample_id, memory_used_bytes, round(memory_used_bytes / 1073741824.0::DOUBLE, 2) + 0.0 AS memory_used_gb
FROM (SELECT host_id, sample_id, CAST(floor(memory_used_gb * 1073741824.0::DOUBLE) AS BIGINT) AS memory_used_bytes FROM metrics) t"""))
def q_bytes_to_gb(spark, sf_dir):
    mt = load_metrics(spark, sf_dir)
    b = mt.select(HOST, SAMPLE, F.floor(F.col(MEM_USED) * F.lit(1073741824.0)).cast("long").alias("memory_used_bytes"))
    return b.select("*", S.bytes_to_gb("memory_used_bytes").alias("memory_used_gb"))


@query("select_features", sql=rounded(m("""
SELECT * EXCLUDE ("timestamp", is_anomaly) FROM metrics"""), _METRIC_DOUBLES))
def q_select_features(spark, sf_dir):
    mt = load_metrics(spark, sf_dir)
    return mt.select(*S.select_features(mt))


@query("filter_class", sql=rounded(m("""
SELECT * FROM metrics WHERE is_anomaly = 1"""), _METRIC_DOUBLES))
def q_filter_class(spark, sf_dir):
    return load_metrics(spark, sf_dir).filter(F.col(LABEL) == 1)


@query("clamp_percent", sql=m("""
SELECT host_id, sample_id,
       greatest(0.0::DOUBLE, least(100.0::DOUBLE, cpu_percent * 1.5::DOUBLE - 20.0::DOUBLE)) AS cpu_scaled_clamped
FROM metrics"""))
def q_clamp_percent(spark, sf_dir):
    mt = load_metrics(spark, sf_dir)
    return mt.select(HOST, SAMPLE, S.clamp_percent(F.col(CPU) * 1.5 - 20.0).alias("cpu_scaled_clamped"))


ALIGN_NAMES = ["cpu_percent", "hour", "memory_percent", "cpu_rolling_mean_5", "disk_usage_percent"]


@query("align_features", sql=m("""
SELECT host_id, sample_id, cpu_percent, CAST(hour("timestamp") AS DOUBLE) AS hour, memory_percent,
       0.0::DOUBLE AS cpu_rolling_mean_5, disk_usage_percent
FROM metrics"""))
def q_align_features(spark, sf_dir):
    mt = load_metrics(spark, sf_dir).withColumn("hour", S.hour())
    return S.align_features(mt, ALIGN_NAMES, keep=[HOST, SAMPLE])
