"""Alerting: temporal pattern, consecutive count, cooldown, messages, routing,
threshold alerts, and the alert store (T4-T10, R24-R28, G6, G7, N5).

Batch operators here are the exact twins of the streaming state machine in
:mod:`fleet_health.streaming.stateful`; both follow SURVEY §2.10's rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import round_half_up
from ..schema import CPU, DISK, HOST, MEM, MEM_USED, SAMPLE, TS
from . import rolling as R
from . import series
from .series import CHUNK, HALO, RN

# --- fixed values ------------------------------------------------------
PATTERN_RULES = {"cpu_rising": 0.5, "cpu_falling": -0.5, "memory_leak": 0.3,
                 "cpu_volatility": 15.0, "cpu_high": 90.0, "memory_high": 90.0}
PATTERN_TEXTS = {"cpu_rising": "Rising CPU trend", "cpu_falling": "Falling CPU trend",
                 "memory_leak": "Memory leak pattern", "cpu_volatility": "CPU volatility",
                 "cpu_high": "High CPU load", "memory_high": "High memory usage",
                 "none": "Complex temporal pattern", "unknown": "Unknown pattern"}
RESET_BELOW = 0.3          # probability that resets the consecutive count
ALERT_ABOVE = 0.5          # probability that makes a row anomalous
HIGH_ABOVE = 0.8           # immediate alert / critical level
CONSECUTIVE_THRESHOLD = 3
COOLDOWN = "300 seconds"
RECOMMENDED_ACTIONS = ("Review system logs for errors", "Check for resource leaks",
                       "Monitor application performance", "Consider scaling resources")
THRESHOLD_ALERTS = (  # metric, above, level, title, message prefix, confidence
    (CPU, 90, "warning", "High CPU Usage", "CPU usage is consistently high: ", 0.7),
    (MEM, 85, "critical", "High Memory Usage", "Memory usage is critically high: ", 0.9))
SEVERITY_OF_LEVEL = {"critical": "critical", "warning": "high"}  # else medium
TEXT_TAG_ANOMALIES = (("Memory", ("Memory usage elevated", "High memory consumption pattern")),
                      ("CPU", ("CPU usage critically high", "Processor overload detected")),
                      ("Disk", ("Disk space low", "Storage capacity warning")))
TEXT_TAG_DEFAULT_ANOMALY = "System performance degradation"
TEXT_TAG_RECOMMENDATIONS = (
    ("Memory", ("Check for memory leaks in applications", "Consider adding more RAM if pattern persists",
                "Monitor application memory allocation", "Restart memory-intensive services")),
    ("CPU", ("Optimize CPU-intensive processes", "Check for runaway processes",
             "Consider load balancing", "Scale horizontally if needed")),
    ("Disk", ("Clean up temporary files and logs", "Archive old data to cold storage",
              "Monitor disk I/O performance", "Consider storage expansion")))
TEXT_TAG_DEFAULT_RECOMMENDATION = "Continue monitoring system performance"
MESSAGE_TEXTS = {"title": " - SYSTEM ANOMALY DETECTED", "pattern": "Temporal Analysis: ", "confidence": "Confidence: ",
                 "consecutive": "Consecutive anomalies: ", "time": "Detection time: ", "cpu": "CPU Usage: ", "memory": "Memory Usage: ",
                 "disk": "Disk Usage: ", "memory_used": "Memory Used: ", "actions": "Recommended Actions: "}
ALERT_CHANNELS = ("console", "email", "slack")
EMAIL_SUBJECT = "System Anomaly Detected"
# ------------------------------------------------------------------------


def num_text(c: Column, places: int = 2) -> Column:
    """A metric as text: rounded half up, shortest decimal form."""
    return round_half_up(c, places).cast("string")


def pct_text(p: Column) -> Column:
    """A probability as percent text with one decimal, e.g. 0.8333 -> 83.3%."""
    return F.concat(round_half_up(p * 100.0, 1).cast("string"), F.lit("%"))


# ------------------------------------------------------------------ T4
def temporal_pattern(df: DataFrame, length: int = 10) -> DataFrame:
    """Add ``temporal_pattern`` from the last ``length`` samples (raw units)."""
    def build(p):
        f = series.rows(-(length - 1), 0)
        x = F.col(RN).cast("double")
        cs = F.regr_slope(F.col(CPU), x).over(f)
        ms = F.regr_slope(F.col(MEM), x).over(f)
        sd = F.stddev_samp(CPU).over(f)
        r = PATTERN_RULES
        first = F.filter(F.array(
            F.when(cs > r["cpu_rising"], F.lit(PATTERN_TEXTS["cpu_rising"]))
             .when(cs < r["cpu_falling"], F.lit(PATTERN_TEXTS["cpu_falling"])),
            F.when(ms > r["memory_leak"], F.lit(PATTERN_TEXTS["memory_leak"])),
            F.when(sd > r["cpu_volatility"], F.lit(PATTERN_TEXTS["cpu_volatility"]))),
            lambda v: v.isNotNull())
        level = F.filter(F.array(
            F.when(F.col(CPU) > r["cpu_high"], F.lit(PATTERN_TEXTS["cpu_high"])),
            F.when(F.col(MEM) > r["memory_high"], F.lit(PATTERN_TEXTS["memory_high"]))),
            lambda v: v.isNotNull())
        chosen = F.when(F.size(first) > 0, first).when(F.size(level) > 0, level) \
                  .otherwise(F.array(F.lit(PATTERN_TEXTS["none"])))
        text = F.when(F.col(RN) < length, F.lit(PATTERN_TEXTS["unknown"])) \
                .otherwise(F.array_join(chosen, " | "))
        return p.select("*", text.alias("temporal_pattern"))
    return series.apply(df, build, lookback=length - 1)


# ------------------------------------------------------------------ T5
def consecutive_count(df: DataFrame, p: str = "anomaly_probability",
                      reset_below: float = RESET_BELOW, keys=(HOST,),
                      name: str = "consecutive") -> DataFrame:
    """Running count of rows since the last reset (p < ``reset_below``):
    0 on a reset row, else position minus the position of the last reset.
    The "last reset" is a forward fill, carried across chunks."""
    keys = list(keys)
    pos = series.with_chunks(series.with_position(df, keys=keys)).drop(HALO)
    pos = pos.withColumn("_reset_rn", F.when(F.col(p) < reset_below, F.col(RN)))
    filled = R.fill_gaps(pos, ["_reset_rn"], "ffill", keys=keys)
    cnt = F.when(F.col(p) < reset_below, F.lit(0)).otherwise(
        F.col(RN) - F.coalesce(F.col("_reset_rn"), F.lit(0))).cast("long")
    return filled.withColumn(name, cnt).drop("_reset_rn", RN, CHUNK)


# ------------------------------------------------------------------ T6
def alert_candidates(df: DataFrame, p: str = "anomaly_probability",
                     threshold: int = CONSECUTIVE_THRESHOLD, gate_before_count: bool = False,
                     keys=(HOST,)) -> DataFrame:
    """Rows that would alert without a cooldown: p > 0.5 and (count >= 3
    or p > 0.8).  ``gate_before_count`` reproduces the as-written order
    where only rows with p > 0.5 reach the counter."""
    base = df.filter(F.col(p) > ALERT_ABOVE) if gate_before_count else df
    counted = consecutive_count(base, p, keys=keys)
    return counted.filter((F.col(p) > ALERT_ABOVE)
                          & ((F.col("consecutive") >= threshold) | (F.col(p) > HIGH_ABOVE)))


def _next_allowed(cand: DataFrame, cooldown: str, keys: list[str]) -> DataFrame:
    """For each candidate (position ``_cpos``), the position of the first
    candidate at or after its time + cooldown (as-of via a backward fill
    over candidates and probe rows, probes sorting first on equal time)."""
    probes = cand.select(*keys, (F.col(TS) + F.expr(f"INTERVAL {cooldown}")).alias(TS),
                         F.lit(0).alias("_kind"), F.col(SAMPLE), F.col("_cpos").alias("_from"),
                         F.lit(None).cast("long").alias("_target"))
    targets = cand.select(*keys, TS, F.lit(1).alias("_kind"), SAMPLE,
                          F.lit(None).cast("long").alias("_from"), F.col("_cpos").alias("_target"))
    u = probes.unionByName(targets)
    u = series.with_chunks(series.with_position(u, keys=keys, order=[TS, "_kind", SAMPLE])).drop(HALO)
    u = R.fill_gaps(u, ["_target"], "bfill", keys=keys)
    return (u.filter(F.col("_kind") == 0)
             .select(*keys, F.col("_from").alias("_pos"), F.col("_target").alias("_next")))


def alert_cooldown(df: DataFrame, p: str = "anomaly_probability", cooldown: str = COOLDOWN,
                   threshold: int = CONSECUTIVE_THRESHOLD, gate_before_count: bool = False,
                   keys=(HOST,), checkpoint: bool = True) -> DataFrame:
    """Alerts emitted under the greedy cooldown rule (T5 + T6).

    Emission is order dependent (a candidate is suppressed when it follows
    the last *emitted* alert by less than ``cooldown``).  The emitted rows of
    a key form the chain first candidate -> next allowed candidate -> ...;
    the chain is found by pointer doubling (R <- R u J(R), J <- J o J), so
    each round is two equi-joins on unique candidate positions and the
    number of rounds is log2 of the longest chain.  No key is ever
    gathered in one task.
    """
    keys = list(keys)
    cand = alert_candidates(df, p, threshold, gate_before_count, keys)
    cand = series.with_position(cand, keys=keys).withColumnRenamed(RN, "_cpos")
    if checkpoint:
        cand = cand.checkpoint()
    jump = _next_allowed(cand, cooldown, keys)
    reached = cand.filter(F.col("_cpos") == 1).select(*keys, "_cpos")
    while True:
        if checkpoint:
            jump = jump.checkpoint()
            reached = reached.checkpoint()
        step = (reached.join(jump.withColumnRenamed("_pos", "_cpos"), keys + ["_cpos"])
                       .filter(F.col("_next").isNotNull())
                       .select(*keys, F.col("_next").alias("_cpos")))
        if checkpoint:
            step = step.checkpoint()
        if step.isEmpty():
            break
        reached = reached.unionByName(step)
        a, b = jump.alias("a"), jump.alias("b")
        jump = (a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
                       + [F.col("a._next") == F.col("b._pos")], "left")
                 .select(*[F.col(f"a.{k}") for k in keys], F.col("a._pos"),
                         F.col("b._next").alias("_next")))
    out = cand.join(reached, keys + ["_cpos"]).drop("_cpos")
    return out.withColumn("level", F.when(F.col(p) > HIGH_ABOVE, "CRITICAL").otherwise("WARNING"))


# ------------------------------------------------------------------ T7-T9
def alert_message(alerts: DataFrame, p: str = "anomaly_probability") -> DataFrame:
    """Alert text: level, pattern, confidence, count, time and current state."""
    t = {k: F.lit(v) for k, v in MESSAGE_TEXTS.items()}
    lines = [
        F.concat(F.col("level"), t["title"]),
        F.concat(t["pattern"], F.coalesce(F.col("temporal_pattern"), F.lit(PATTERN_TEXTS["unknown"]))),
        F.concat(t["confidence"], pct_text(F.col(p))),
        F.concat(t["consecutive"], F.col("consecutive").cast("string")),
        F.concat(t["time"], F.date_format(TS, "yyyy-MM-dd HH:mm:ss")),
        F.concat(t["cpu"], num_text(F.col(CPU)), F.lit("%")),
        F.concat(t["memory"], num_text(F.col(MEM)), F.lit("%")),
        F.concat(t["disk"], num_text(F.col(DISK)), F.lit("%")),
        F.concat(t["memory_used"], num_text(F.col(MEM_USED)), F.lit(" GB")),
        F.concat(t["actions"], F.lit("; ".join(RECOMMENDED_ACTIONS))),
    ]
    return alerts.withColumn("message", F.concat_ws("\n", *lines))


def alert_log(alerts: DataFrame, keep: int = 100, keys=(HOST,)) -> DataFrame:
    """The newest ``keep`` log entries per key (the in-memory view)."""
    w = Window.partitionBy(*keys).orderBy(F.col(TS).desc(), F.col(SAMPLE).desc())
    return alerts.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= keep).drop("_r")


def alert_route(alerts: DataFrame, method: str = "console") -> DataFrame:
    """Outbox rows for a delivery channel; delivery itself happens outside Spark."""
    if method not in ALERT_CHANNELS:
        raise ValueError(f"unknown alert method {method!r}")
    subject = F.lit(EMAIL_SUBJECT) if method == "email" else F.lit(None).cast("string")
    return alerts.select("*", F.lit(method).alias("channel"), subject.alias("subject"))


# ------------------------------------------------------------------ T10
def threshold_alerts(metrics: DataFrame) -> DataFrame:
    """Rule alerts per sample: cpu > 90 warning, memory > 85 critical."""
    items = []
    for m, above, level, title, prefix, conf in THRESHOLD_ALERTS:
        items.append(F.when(F.col(m) > above, F.struct(
            F.lit(level).alias("level"), F.lit(title).alias("title"),
            F.concat(F.lit(prefix), num_text(F.col(m)), F.lit("%")).alias("message"),
            F.lit(conf).alias("confidence"))))
    ex = F.explode(F.filter(F.array(*items), lambda x: x.isNotNull())).alias("_a")
    keep = [c for c in metrics.columns]
    return metrics.select(*keep, ex).select(*keep, "_a.*")


# ------------------------------------------------------------------ R25
def assign_ids(df: DataFrame, order=(TS, HOST, "title"), name: str = "alert_id") -> DataFrame:
    """Running id 1..n in ``order`` without a single-task global sort and
    without a hot hour: positions come from even ranges of ``order``."""
    return series.global_position(df, list(order), name)


def create_alerts(raw: DataFrame, snapshot_cols=(CPU, MEM, DISK, MEM_USED)) -> DataFrame:
    """Alert records: running id, defaults (warning, '', 0.0), unresolved,
    and a snapshot struct of the metrics at alert time."""
    with_ids = assign_ids(raw)
    return with_ids.select(
        "alert_id", HOST, SAMPLE, TS,
        F.coalesce(F.col("level"), F.lit("warning")).alias("level"),
        F.coalesce(F.col("title"), F.lit("")).alias("title"),
        F.coalesce(F.col("message"), F.lit("")).alias("message"),
        F.coalesce(F.col("confidence"), F.lit(0.0)).alias("confidence"),
        F.lit(False).alias("resolved"),
        F.lit(None).cast("timestamp_ntz").alias("resolved_at"),
        F.struct(*[F.col(c) for c in snapshot_cols]).alias("system_metrics"))


# ------------------------------------------------------------------ R26
def resolve_alerts(alerts: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Mark alerts resolved from (alert_id, resolved_at) events; the latest
    event per id wins.  Resolutions are aggregated per id before the join."""
    latest = resolutions.groupBy("alert_id").agg(F.max("resolved_at").alias("_at"))
    j = alerts.join(latest, "alert_id", "left")
    return j.withColumn("resolved", F.col("resolved") | F.col("_at").isNotNull()) \
            .withColumn("resolved_at", F.coalesce(F.col("resolved_at"), F.col("_at"))).drop("_at")


def unknown_resolutions(alerts: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Resolution events naming no existing alert ("Alert not found")."""
    return resolutions.join(alerts.select("alert_id"), "alert_id", "left_anti")


# ------------------------------------------------------------------ R24
def alerts_store_list(alerts: DataFrame, limit: int = 50, resolved: bool = False) -> DataFrame:
    """Unresolved alerts (all with ``resolved=True``), the last ``limit`` by id."""
    a = alerts if resolved else alerts.filter(~F.col("resolved"))
    return a.orderBy(F.col("alert_id").desc()).limit(limit).orderBy("alert_id")


# ------------------------------------------------------------------ G6, G7
def alert_counts(alerts: DataFrame, per_host: bool = True) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("total_alerts"),
            F.count_if(F.col("level") == "critical").alias("critical_alerts"),
            F.count_if(F.col("level") == "warning").alias("warning_alerts"),
            F.count_if(~F.col("resolved")).alias("active_alerts")]
    return alerts.rollup(HOST).agg(*aggs) if per_host else alerts.agg(*aggs)


def severity(level: Column) -> Column:
    out = F.lit("medium")
    for lv, sev in reversed(list(SEVERITY_OF_LEVEL.items())):
        out = F.when(level == lv, F.lit(sev)).otherwise(out)
    return out


def severity_counts(alerts: DataFrame) -> DataFrame:
    s = severity(F.col("level"))
    return alerts.agg(F.count_if(s == "critical").alias("critical"),
                      F.count_if(s == "high").alias("high"),
                      F.count_if(s == "medium").alias("medium"),
                      F.count(F.lit(1)).alias("total"))


# ------------------------------------------------------------------ R28
def alert_text_tags(alerts: DataFrame) -> DataFrame:
    """Anomaly texts from the first keyword found (Memory, CPU, Disk; case
    sensitive) and recommendations from every keyword found."""
    msg = F.coalesce(F.col("message"), F.lit(""))
    anomalies = F.array(F.lit(TEXT_TAG_DEFAULT_ANOMALY))
    for kw, texts in reversed(TEXT_TAG_ANOMALIES):
        anomalies = F.when(msg.contains(kw), F.array(*[F.lit(t) for t in texts])).otherwise(anomalies)
    recs = F.flatten(F.filter(F.array(*[
        F.when(msg.contains(kw), F.array(*[F.lit(t) for t in texts]))
        for kw, texts in TEXT_TAG_RECOMMENDATIONS]), lambda x: x.isNotNull()))
    recs = F.when(F.size(recs) == 0, F.array(F.lit(TEXT_TAG_DEFAULT_RECOMMENDATION))).otherwise(recs)
    return alerts.select("*", anomalies.alias("anomalies_detected"), recs.alias("recommendations"))


# ------------------------------------------------------------------ N5
def asof_snapshot(events: DataFrame, samples: DataFrame, cols=(CPU, MEM, DISK),
                  keys=(HOST,), prefix: str = "snapshot_") -> DataFrame:
    """As-of join: each event row gets the latest sample of its key at or
    before its time.  Both sides are unioned and sorted once per key chunk;
    the sample (as one struct) is forward filled onto event rows (samples
    sort before events at equal time), so no pair of rows is ever formed."""
    keys = list(keys)
    cols = list(cols)
    ev_cols = list(events.columns)
    snap_type = F.struct(*[F.lit(None).cast("double").alias(c) for c in cols],
                         F.lit(None).cast("long").alias(SAMPLE))
    ev = events.select(*ev_cols, F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_sid"),
                       F.when(F.lit(False), snap_type).alias("_snap"))
    sm = samples.select(*keys, TS, F.lit(0).alias("_kind"), F.col(SAMPLE).alias("_sid"),
                        F.struct(*[F.col(c).cast("double").alias(c) for c in cols],
                                 F.col(SAMPLE).alias(SAMPLE)).alias("_snap"))
    u = ev.unionByName(sm, allowMissingColumns=True)
    u = series.with_chunks(series.with_position(u, keys=keys, order=[TS, "_kind", "_sid"])).drop(HALO)
    u = R.fill_gaps(u, ["_snap"], "ffill", keys=keys)
    return u.filter(F.col("_kind") == 1).select(
        *ev_cols, *[F.col(f"_snap.{c}").alias(f"{prefix}{c}") for c in cols + [SAMPLE]])
