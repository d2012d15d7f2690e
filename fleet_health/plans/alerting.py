"""Step 4 queries: alert semantics (T4-T10), alert store (R24-R28, G6, G7),
health and summaries (R20, R22), as-of snapshot (N5)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import risk as K
from ..operators import alerts as A
from ..operators import reports as RP
from ..operators.alert_store import AlertStore
from ..schema import CPU, DISK, HOST, MEM, MEM_USED, SAMPLE, TS
from ..session import checkpoint_path, materialize
from ..sources.metrics import load_metrics, load_scored
from . import sqlwin as Q
from .registry import query, rounded
from .sqlbase import METRICS, SCORED, m, with_ctes

# ------------------------------------------------------------------ fixtures
T10_SQL = """
t10 AS (SELECT * FROM (
  SELECT m.*, unnest([
    CASE WHEN cpu_percent > 90 THEN {'level': 'warning', 'title': 'High CPU Usage',
      'message': 'CPU usage is consistently high: ' || CAST(floor(cpu_percent * 100.0 + 0.5) / 100.0 AS VARCHAR) || '%', 'confidence': 0.7::DOUBLE} END,
    CASE WHEN memory_percent > 85 THEN {'level': 'critical', 'title': 'High Memory Usage',
      'message': 'Memory usage is critically high: ' || CAST(floor(memory_percent * 100.0 + 0.5) / 100.0 AS VARCHAR) || '%', 'confidence': 0.9::DOUBLE} END
  ], recursive := true) FROM metrics m) x WHERE level IS NOT NULL)"""

ALERTS_SQL = """
alerts AS (SELECT row_number() OVER (ORDER BY "timestamp", host_id, title) AS alert_id,
  host_id, sample_id, "timestamp", level, title, message, confidence, false AS resolved,
  NULL::TIMESTAMP AS resolved_at, cpu_percent, memory_percent, disk_usage_percent, memory_used_gb FROM t10)"""

RESOLUTIONS_SQL = """
resolutions AS (
  SELECT alert_id, "timestamp" + INTERVAL 10 MINUTE AS resolved_at FROM alerts WHERE alert_id % 3 = 0
  UNION ALL SELECT -1 AS alert_id, (SELECT max("timestamp") FROM metrics) AS resolved_at)"""

RESOLVED_SQL = """
resolved AS (SELECT a.* REPLACE (a.resolved OR r.rat IS NOT NULL AS resolved, coalesce(a.resolved_at, r.rat) AS resolved_at)
  FROM alerts a LEFT JOIN (SELECT alert_id, max(resolved_at) AS rat FROM resolutions GROUP BY alert_id) r USING (alert_id))"""

ALERT_CTES = (METRICS, T10_SQL, ALERTS_SQL)
RESOLVED_CTES = ALERT_CTES + (RESOLUTIONS_SQL, RESOLVED_SQL)


def t10(spark, sf_dir):
    return A.threshold_alerts(load_metrics(spark, sf_dir))


def alerts_fixture(spark, sf_dir):
    return A.create_alerts(t10(spark, sf_dir))


def resolutions_fixture(alerts, metrics):
    """Fixture 2.5: every third alert resolved 10 minutes later, plus one
    event for an id that does not exist (-1)."""
    res = alerts.filter(F.col("alert_id") % 3 == 0).select(
        "alert_id", (F.col(TS) + F.expr("INTERVAL 10 MINUTES")).alias("resolved_at"))
    unknown = metrics.agg(F.lit(-1).cast("long").alias("alert_id"), F.max(TS).alias("resolved_at"))
    return res.unionByName(unknown)


def resolved_fixture(spark, sf_dir):
    al = alerts_fixture(spark, sf_dir)
    return A.resolve_alerts(al, resolutions_fixture(al, load_metrics(spark, sf_dir)))


def _flat(alerts):
    return alerts.select(*[c for c in alerts.columns if c != "system_metrics"],
                         *[F.col(f"system_metrics.{c}").alias(c) for c in (CPU, MEM, DISK, MEM_USED)])


_ALERT_DOUBLES = ["confidence", "cpu_percent", "memory_percent", "disk_usage_percent", "memory_used_gb"]
_METRIC_DOUBLES = ["cpu_percent", "memory_percent", "memory_used_gb", "memory_available_gb",
                   "disk_usage_percent", "disk_used_gb", "disk_free_gb"]


# ------------------------------------------------------------------ T10, R25, R26, R24, P3
@query("threshold_alerts", sql=rounded(with_ctes("SELECT * FROM t10", METRICS, T10_SQL),
                                       _METRIC_DOUBLES + ["confidence"]))
def q_threshold_alerts(spark, sf_dir):
    return t10(spark, sf_dir)


@query("create_alert", sql=rounded(with_ctes("SELECT * FROM alerts", *ALERT_CTES), _ALERT_DOUBLES))
def q_create_alert(spark, sf_dir):
    """Running ids, defaults, snapshot (flattened)."""
    return _flat(alerts_fixture(spark, sf_dir))


@query("resolve_alerts", sql=rounded(with_ctes("SELECT * FROM resolved", *RESOLVED_CTES), _ALERT_DOUBLES))
def q_resolve_alerts(spark, sf_dir):
    return _flat(resolved_fixture(spark, sf_dir))


@query("unknown_resolutions", sql=with_ctes(
    "SELECT r.* FROM resolutions r ANTI JOIN alerts a USING (alert_id)", *RESOLVED_CTES[:-1]))
def q_unknown_resolutions(spark, sf_dir):
    al = alerts_fixture(spark, sf_dir)
    return A.unknown_resolutions(al, resolutions_fixture(al, load_metrics(spark, sf_dir)))


@query("alerts_store_list", sql=rounded(with_ctes(
    "SELECT * FROM (SELECT * FROM resolved WHERE NOT resolved ORDER BY alert_id DESC LIMIT 50) t ORDER BY alert_id",
    *RESOLVED_CTES), _ALERT_DOUBLES))
def q_alerts_store_list(spark, sf_dir):
    return _flat(A.alerts_store_list(resolved_fixture(spark, sf_dir), 50, resolved=False))


@query("filter_alerts", sql=rounded(with_ctes(
    "SELECT * FROM resolved WHERE level = 'critical' AND NOT resolved", *RESOLVED_CTES), _ALERT_DOUBLES))
def q_filter_alerts(spark, sf_dir):
    """P3 filter_level + filter_unresolved."""
    r = resolved_fixture(spark, sf_dir)
    return _flat(r.filter((F.col("level") == "critical") & ~F.col("resolved")))


# ------------------------------------------------------------------ G6, G7, R27, R28
@query("alert_counts", sql=with_ctes("""
SELECT host_id, count(*) AS total_alerts, CAST(count_if(level = 'critical') AS BIGINT) AS critical_alerts,
  CAST(count_if(level = 'warning') AS BIGINT) AS warning_alerts, CAST(count_if(NOT resolved) AS BIGINT) AS active_alerts
FROM resolved GROUP BY ROLLUP (host_id)""", *RESOLVED_CTES))
def q_alert_counts(spark, sf_dir):
    return A.alert_counts(resolved_fixture(spark, sf_dir))


@query("severity_counts", sql=with_ctes("""
SELECT CAST(count_if(level = 'critical') AS BIGINT) AS critical, CAST(count_if(level = 'warning') AS BIGINT) AS high,
  CAST(count_if(level NOT IN ('critical', 'warning')) AS BIGINT) AS medium, count(*) AS total FROM alerts""", *ALERT_CTES))
def q_severity_counts(spark, sf_dir):
    return A.severity_counts(alerts_fixture(spark, sf_dir))


@query("alert_outlook", sql=with_ctes("""
SELECT alert_id,
  CASE WHEN cpu_percent IS NULL OR cpu_percent = 0 THEN NULL ELSE floor(least(100.0::DOUBLE, cpu_percent + 5.0::DOUBLE) * 10.0 + 0.5) / 10.0 END AS cpu_1h,
  CASE WHEN memory_percent IS NULL OR memory_percent = 0 THEN NULL ELSE floor(least(100.0::DOUBLE, memory_percent + 3.0::DOUBLE) * 10.0 + 0.5) / 10.0 END AS memory_1h,
  CASE WHEN cpu_percent IS NULL OR cpu_percent = 0 THEN NULL ELSE floor(least(100.0::DOUBLE, cpu_percent + 15.0::DOUBLE) * 10.0 + 0.5) / 10.0 END AS cpu_6h,
  CASE WHEN memory_percent IS NULL OR memory_percent = 0 THEN NULL ELSE floor(least(100.0::DOUBLE, memory_percent + 10.0::DOUBLE) * 10.0 + 0.5) / 10.0 END AS memory_6h
FROM alerts""", *ALERT_CTES))
def q_alert_outlook(spark, sf_dir):
    """R27 over the alert snapshot."""
    a = _flat(alerts_fixture(spark, sf_dir))
    return a.select("alert_id", K.alert_outlook(CPU, 5).alias("cpu_1h"), K.alert_outlook(MEM, 3).alias("memory_1h"),
                    K.alert_outlook(CPU, 15).alias("cpu_6h"), K.alert_outlook(MEM, 10).alias("memory_6h"))


@query("alert_text_tags", sql=with_ctes("""
SELECT alert_id, message,
  CASE WHEN contains(message, 'Memory') THEN 'Memory usage elevated | High memory consumption pattern'
       WHEN contains(message, 'CPU') THEN 'CPU usage critically high | Processor overload detected'
       WHEN contains(message, 'Disk') THEN 'Disk space low | Storage capacity warning'
       ELSE 'System performance degradation' END AS anomalies_detected,
  coalesce(nullif(concat_ws(' | ',
    CASE WHEN contains(message, 'Memory') THEN 'Check for memory leaks in applications | Consider adding more RAM if pattern persists | Monitor application memory allocation | Restart memory-intensive services' END,
    CASE WHEN contains(message, 'CPU') THEN 'Optimize CPU-intensive processes | Check for runaway processes | Consider load balancing | Scale horizontally if needed' END,
    CASE WHEN contains(message, 'Disk') THEN 'Clean up temporary files and logs | Archive old data to cold storage | Monitor disk I/O performance | Consider storage expansion' END), ''),
    'Continue monitoring system performance') AS recommendations
FROM alerts""", *ALERT_CTES))
def q_alert_text_tags(spark, sf_dir):
    t = A.alert_text_tags(alerts_fixture(spark, sf_dir))
    return t.select("alert_id", "message", F.array_join("anomalies_detected", " | ").alias("anomalies_detected"),
                    F.array_join("recommendations", " | ").alias("recommendations"))


# ------------------------------------------------------------------ R20, R22
@query("health_score", sql=with_ctes("""
SELECT h.host_id,
  CASE WHEN t.avg_cpu IS NULL THEN 100.0::DOUBLE ELSE floor(greatest(0.0::DOUBLE, 100.0::DOUBLE
       - (t.avg_cpu * 0.3::DOUBLE + t.avg_mem * 0.2::DOUBLE + coalesce(a.active, 0) * 5)) * 10.0 + 0.5) / 10.0 END AS health_score,
  CAST(greatest(0, 100 - coalesce(a.active, 0) * 10) AS BIGINT) AS health_score_alerts,
  round(greatest(0.0::DOUBLE, 100.0::DOUBLE - (l.cpu_percent * 0.3::DOUBLE + l.memory_percent * 0.2::DOUBLE)), 6) + 0.0 AS health_score_current
FROM (SELECT DISTINCT host_id FROM metrics) h
LEFT JOIN (SELECT host_id, avg(cpu_percent) AS avg_cpu, avg(memory_percent) AS avg_mem FROM tail GROUP BY host_id) t USING (host_id)
LEFT JOIN (SELECT host_id, CAST(count_if(NOT resolved) AS BIGINT) AS active FROM resolved GROUP BY host_id) a USING (host_id)
LEFT JOIN (SELECT * FROM tail WHERE r = 1) l USING (host_id)""", *RESOLVED_CTES,
    """tail AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY host_id ORDER BY "timestamp" DESC, sample_id DESC) AS r
       FROM metrics) x WHERE r <= 10)"""))
def q_health_score(spark, sf_dir):
    """R20 variants per host: (a) history + active alerts, (b) alerts only,
    (c) current sample."""
    mt = load_metrics(spark, sf_dir)
    hw = RP.health_window(mt, 10)
    active = resolved_fixture(spark, sf_dir).groupBy(HOST).agg(F.count_if(~F.col("resolved")).alias("_active"))
    from ..sources import tables
    latest = tables.latest_sample(mt).select(HOST, CPU, MEM)
    hosts = mt.select(HOST).distinct()
    j = hosts.join(hw, HOST, "left").join(active, HOST, "left").join(latest, HOST, "left")
    act = F.coalesce(F.col("_active"), F.lit(0).cast("long"))
    return j.select(HOST, RP.health_score_history(F.col("avg_cpu"), F.col("avg_memory"), act).alias("health_score"),
                    RP.health_score_alerts(act).alias("health_score_alerts"),
                    RP.health_score_current().alias("health_score_current"))


@query("analytics_summary", sql=with_ctes("""
SELECT c.host_id,
  CASE WHEN t.avg_cpu IS NULL THEN 100.0::DOUBLE ELSE floor(greatest(0.0::DOUBLE, 100.0::DOUBLE
       - (t.avg_cpu * 0.3::DOUBLE + t.avg_mem * 0.2::DOUBLE + coalesce(a.active_alerts, 0) * 5)) * 10.0 + 0.5) / 10.0 END AS health_score,
  coalesce(a.total_alerts, 0) AS total_alerts, coalesce(a.critical_alerts, 0) AS critical_alerts,
  coalesce(a.warning_alerts, 0) AS warning_alerts, coalesce(a.active_alerts, 0) AS active_alerts,
  c.metrics_collected
FROM (SELECT host_id, count(*) AS metrics_collected FROM metrics GROUP BY ROLLUP (host_id)) c
LEFT JOIN (SELECT host_id, avg(cpu_percent) AS avg_cpu, avg(memory_percent) AS avg_mem FROM tail GROUP BY ROLLUP (host_id)) t
  ON c.host_id IS NOT DISTINCT FROM t.host_id
LEFT JOIN (SELECT host_id, count(*) AS total_alerts, CAST(count_if(level = 'critical') AS BIGINT) AS critical_alerts,
             CAST(count_if(level = 'warning') AS BIGINT) AS warning_alerts, CAST(count_if(NOT resolved) AS BIGINT) AS active_alerts
           FROM resolved GROUP BY ROLLUP (host_id)) a ON c.host_id IS NOT DISTINCT FROM a.host_id""", *RESOLVED_CTES,
    """tail AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY host_id ORDER BY "timestamp" DESC, sample_id DESC) AS r
       FROM metrics) x WHERE r <= 10)"""))
def q_analytics_summary(spark, sf_dir):
    """R22 per host plus the fleet row (host NULL)."""
    return RP.analytics_summary(load_metrics(spark, sf_dir), resolved_fixture(spark, sf_dir))


# ------------------------------------------------------------------ N5
@query("asof_snapshot", sql=rounded(with_ctes("""
SELECT a.alert_id, a.host_id, a.eval_ts AS "timestamp", m.cpu_percent AS snapshot_cpu_percent,
  m.memory_percent AS snapshot_memory_percent, m.disk_usage_percent AS snapshot_disk_usage_percent,
  m.sample_id AS snapshot_sample_id
FROM (SELECT alert_id, host_id, "timestamp" + INTERVAL 90 MINUTE AS eval_ts FROM alerts) a
ASOF LEFT JOIN metrics m ON a.host_id = m.host_id AND a.eval_ts >= m."timestamp" """, *ALERT_CTES),
    ["snapshot_cpu_percent", "snapshot_memory_percent", "snapshot_disk_usage_percent"]))
def q_asof_snapshot(spark, sf_dir):
    """Alerts evaluated 90 minutes after their sample, paired with the
    host's latest sample at or before that time."""
    al = alerts_fixture(spark, sf_dir).select(
        "alert_id", HOST, (F.col(TS) + F.expr("INTERVAL 90 MINUTES")).alias(TS))
    return A.asof_snapshot(al, load_metrics(spark, sf_dir))


# ------------------------------------------------------------------ T4-T9
TP_SELECT = f"""
SELECT host_id, sample_id, "timestamp",
  CASE WHEN rn < 10 THEN 'Unknown pattern'
       WHEN first_list <> '' THEN first_list
       WHEN level_list <> '' THEN level_list ELSE 'Complex temporal pattern' END AS temporal_pattern
FROM (
  SELECT *, concat_ws(' | ',
      CASE WHEN cs > 0.5 THEN 'Rising CPU trend' WHEN cs < -0.5 THEN 'Falling CPU trend' END,
      CASE WHEN ms > 0.3 THEN 'Memory leak pattern' END,
      CASE WHEN sd > 15 THEN 'CPU volatility' END) AS first_list,
    concat_ws(' | ', CASE WHEN cpu_percent > 90 THEN 'High CPU load' END,
      CASE WHEN memory_percent > 90 THEN 'High memory usage' END) AS level_list
  FROM (
    SELECT *, regr_slope(cpu_percent, CAST(rn AS DOUBLE)) OVER f AS cs,
      regr_slope(memory_percent, CAST(rn AS DOUBLE)) OVER f AS ms, stddev_samp(cpu_percent) OVER f AS sd
    FROM (SELECT *, {Q.rn_col()} FROM metrics) t
    WINDOW f AS ({Q.PART} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) u
) v"""


@query("temporal_pattern", sql=m(TP_SELECT))
def q_temporal_pattern(spark, sf_dir):
    return A.temporal_pattern(load_metrics(spark, sf_dir)).select(HOST, SAMPLE, TS, "temporal_pattern")


COUNTED_SQL = f"""
counted AS (SELECT *, CASE WHEN anomaly_probability < 0.3 THEN 0 ELSE rn - coalesce(last_value(
    CASE WHEN anomaly_probability < 0.3 THEN rn END IGNORE NULLS) OVER (PARTITION BY host_id ORDER BY rn
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) END AS consecutive
  FROM (SELECT *, {Q.rn_col()} FROM scored) t)"""


@query("consecutive_count", sql=rounded(m(
    'SELECT host_id, sample_id, "timestamp", anomaly_probability, consecutive FROM counted', SCORED, COUNTED_SQL),
    ["anomaly_probability"]))
def q_consecutive_count(spark, sf_dir):
    return A.consecutive_count(load_scored(spark, sf_dir)).select(
        HOST, SAMPLE, TS, "anomaly_probability", "consecutive")


def _cooldown_sql(gated: bool, days: int = 2, extra_ctes=(), final: str | None = None):
    src = "(SELECT * FROM scored WHERE anomaly_probability > 0.5)" if gated else "scored"
    counted = COUNTED_SQL.replace("FROM scored) t)", f"FROM {src} s0) t)")
    final = final or """
SELECT host_id, sample_id, "timestamp", round(anomaly_probability, 6) + 0.0 AS anomaly_probability, consecutive,
  CASE WHEN anomaly_probability > 0.8 THEN 'CRITICAL' ELSE 'WARNING' END AS level
FROM cand JOIN chain USING (host_id, cpos)"""
    return "WITH RECURSIVE " + ",".join((METRICS, SCORED, counted, f"""
cand AS (SELECT *, row_number() OVER (PARTITION BY host_id ORDER BY "timestamp", sample_id) AS cpos FROM counted
  WHERE anomaly_probability > 0.5 AND (consecutive >= 3 OR anomaly_probability > 0.8))""", f"""
nxt AS (SELECT c.host_id, c.cpos, (SELECT min(c2.cpos) FROM cand c2 WHERE c2.host_id = c.host_id
  AND c2."timestamp" >= c."timestamp" + INTERVAL {days} DAY) AS next_pos FROM cand c)""", """
chain(host_id, cpos) AS (SELECT host_id, cpos FROM cand WHERE cpos = 1
  UNION ALL SELECT n.host_id, n.next_pos FROM chain ch JOIN nxt n ON n.host_id = ch.host_id AND n.cpos = ch.cpos
  WHERE n.next_pos IS NOT NULL)""", *extra_ctes)) + final


def _cooldown(spark, sf_dir, gated):
    out = A.alert_cooldown(load_scored(spark, sf_dir), cooldown="2 days", gate_before_count=gated)
    return out.select(HOST, SAMPLE, TS, "anomaly_probability", "consecutive", "level")


@query("alert_cooldown", sql=_cooldown_sql(False))
def q_alert_cooldown(spark, sf_dir):
    """T5 + T6 on ``scored`` with a 2-day cooldown (samples are hours apart)."""
    return _cooldown(spark, sf_dir, False)


@query("alert_cooldown_gated", sql=_cooldown_sql(True))
def q_alert_cooldown_gated(spark, sf_dir):
    """T6 as written: only rows with p > 0.5 reach the counter."""
    return _cooldown(spark, sf_dir, True)


def _emitted_with_text(spark, sf_dir):
    sc = A.temporal_pattern(load_scored(spark, sf_dir))
    return A.alert_message(A.alert_cooldown(sc, cooldown="2 days"))


def _num(c, n=2):
    f = float(10 ** n)
    return f"CAST(floor({c} * {f} + 0.5) / {f} AS VARCHAR)"


_MESSAGE_FINAL = f"""
SELECT c.host_id, c.sample_id, c."timestamp", CASE WHEN c.anomaly_probability > 0.8 THEN 'CRITICAL' ELSE 'WARNING' END AS level,
  concat_ws(chr(10),
    (CASE WHEN c.anomaly_probability > 0.8 THEN 'CRITICAL' ELSE 'WARNING' END) || ' - SYSTEM ANOMALY DETECTED',
    'Temporal Analysis: ' || coalesce(tp.temporal_pattern, 'Unknown pattern'),
    'Confidence: ' || {_num('c.anomaly_probability * 100.0', 1)} || '%',
    'Consecutive anomalies: ' || CAST(c.consecutive AS VARCHAR),
    'Detection time: ' || strftime(c."timestamp", '%Y-%m-%d %H:%M:%S'),
    'CPU Usage: ' || {_num('c.cpu_percent')} || '%',
    'Memory Usage: ' || {_num('c.memory_percent')} || '%',
    'Disk Usage: ' || {_num('c.disk_usage_percent')} || '%',
    'Memory Used: ' || {_num('c.memory_used_gb')} || ' GB',
    'Recommended Actions: {"; ".join(A.RECOMMENDED_ACTIONS)}') AS message
FROM cand c JOIN chain USING (host_id, cpos) JOIN tp USING (sample_id)"""


@query("alert_message", sql=_cooldown_sql(False, extra_ctes=(f"tp AS ({TP_SELECT})",), final=_MESSAGE_FINAL))
def q_alert_message(spark, sf_dir):
    """Alert text for every emitted alert (pattern, confidence, count, state)."""
    return _emitted_with_text(spark, sf_dir).select(HOST, SAMPLE, TS, "level", "message")


@query("alert_log", sql=rounded(with_ctes("""
SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY host_id ORDER BY "timestamp" DESC, sample_id DESC) AS r
  FROM t10) x WHERE r <= 100""", METRICS, T10_SQL), _METRIC_DOUBLES + ["confidence"]))
def q_alert_log(spark, sf_dir):
    """Newest 100 log entries per host."""
    return A.alert_log(t10(spark, sf_dir), 100)


@query("alert_route", sql=_cooldown_sql(False, extra_ctes=(f"tp AS ({TP_SELECT})",), final=(
    "SELECT *, 'email' AS channel, 'System Anomaly Detected' AS subject FROM (" + _MESSAGE_FINAL + ") z")))
def q_alert_route(spark, sf_dir):
    """Email outbox rows for the emitted alerts."""
    return A.alert_route(_emitted_with_text(spark, sf_dir).select(HOST, SAMPLE, TS, "level", "message"), "email")


# ------------------------------------------------------------------ R25, R26 as a store
@query("alert_store_upserts", sql=rounded(with_ctes("SELECT * FROM resolved", *RESOLVED_CTES), _ALERT_DOUBLES))
def q_alert_store_upserts(spark, sf_dir):
    """R25 + R26 in place: alerts in one batch, their resolutions in a second,
    which rewrites the buckets it touches; equals ``resolve_alerts``."""
    al = materialize(alerts_fixture(spark, sf_dir))
    store = AlertStore(spark, checkpoint_path(spark, f"alerts/{uuid.uuid4().hex[:12]}"), al.schema, 16)
    store.upsert(al, 0)
    store.upsert(resolutions_fixture(al, load_metrics(spark, sf_dir)), 1)
    return _flat(store.alerts())
