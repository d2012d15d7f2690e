"""Per-host reports: predictions, failure risk, health, summaries, charts
(R11-R23, R29-R31, G5, G8).  Each report starts from the latest sample or
a bounded tail per host (top-k with a partial limit before the shuffle),
so report cost does not grow with a host's history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import risk as K
from ..functions.scalar import round_half_up
from ..schema import CPU, DISK, HOST, MEM, SAMPLE, TS
from ..sources import tables
from .alerts import pct_text


def _levels():
    cr, mr, dr = K.component_risk(CPU), K.component_risk(MEM), K.component_risk(DISK)
    return cr, mr, dr, K.overall_risk(cr, mr, dr)


# ------------------------------------------------------------------ R11/R12
def heuristic_forecast_band(latest: DataFrame) -> DataFrame:
    """1 h and 6 h bands (low / mid / high of the reference's random
    draw), probabilities, trend and action."""
    cols = []
    for horizon, bands in (("1h", K.HOURLY_BANDS), ("6h", K.SIX_HOUR_BANDS)):
        for m, (lo, hi) in bands.items():
            short = m.split("_")[0]
            a, b, c = K.band(m, lo, hi)
            cols += [a.alias(f"{short}_{horizon}_low"), b.alias(f"{short}_{horizon}_mid"),
                     c.alias(f"{short}_{horizon}_high")]
    cols += [K.hourly_anomaly_probability().alias("anomaly_probability_1h"),
             K.hourly_trend().alias("trend_1h"),
             K.six_hour_failure_probability().alias("failure_probability_6h"),
             K.recommended_action().alias("recommended_action_6h")]
    return latest.select(HOST, SAMPLE, TS, CPU, MEM, DISK, *cols)


def resource_forecast_band(latest: DataFrame) -> DataFrame:
    """1 / 3 / 6 h cpu and memory bands, 6 h disk band."""
    cols = []
    for m, hs in K.RESOURCE_BANDS.items():
        short = m.split("_")[0]
        for horizon, (lo, hi) in hs.items():
            a, b, c = K.band(m, lo, hi)
            cols += [a.alias(f"{short}_{horizon}_low"), b.alias(f"{short}_{horizon}_mid"),
                     c.alias(f"{short}_{horizon}_high")]
    return latest.select(HOST, SAMPLE, TS, CPU, MEM, DISK, *cols)


# ------------------------------------------------------------------ R13/R14
def prediction_report(latest: DataFrame) -> DataFrame:
    """One nested row per host - component and overall risk, time to
    failure, hourly / 6 h bands, current anomalies, recommendations."""
    cr, mr, dr, overall = _levels()
    bands = heuristic_forecast_band(latest)
    b = {c: F.col(c) for c in bands.columns}
    return bands.select(
        HOST, SAMPLE, TS, CPU, MEM, DISK,
        overall.alias("overall_risk"), K.time_to_failure().alias("time_to_failure"),
        F.create_map(F.lit("cpu_performance"), cr, F.lit("memory_usage"), mr,
                     F.lit("disk_io"), dr).alias("component_risks"),
        F.struct(b["cpu_1h_mid"].alias("cpu_usage"), b["memory_1h_mid"].alias("memory_usage"),
                 b["anomaly_probability_1h"].alias("anomaly_probability"),
                 b["trend_1h"].alias("trend")).alias("next_1_hour"),
        F.struct(b["cpu_6h_mid"].alias("cpu_usage"), b["memory_6h_mid"].alias("memory_usage"),
                 b["disk_6h_mid"].alias("disk_usage"),
                 b["failure_probability_6h"].alias("failure_probability"),
                 b["recommended_action_6h"].alias("recommended_action")).alias("next_6_hours"),
        K.current_anomalies().alias("anomalies_detected"),
        K.recommendations().alias("recommendations"))


def flatten_prediction_report(rep: DataFrame) -> DataFrame:
    return rep.select(
        HOST, SAMPLE, TS, "overall_risk", "time_to_failure",
        F.col("component_risks")["cpu_performance"].alias("cpu_risk"),
        F.col("component_risks")["memory_usage"].alias("memory_risk"),
        F.col("component_risks")["disk_io"].alias("disk_risk"),
        F.col("next_1_hour.cpu_usage").alias("cpu_1h"), F.col("next_1_hour.memory_usage").alias("memory_1h"),
        F.col("next_1_hour.anomaly_probability").alias("anomaly_probability_1h"),
        F.col("next_1_hour.trend").alias("trend_1h"),
        F.col("next_6_hours.cpu_usage").alias("cpu_6h"), F.col("next_6_hours.memory_usage").alias("memory_6h"),
        F.col("next_6_hours.disk_usage").alias("disk_6h"),
        F.col("next_6_hours.failure_probability").alias("failure_probability_6h"),
        F.col("next_6_hours.recommended_action").alias("recommended_action_6h"),
        F.array_join("anomalies_detected", " | ").alias("anomalies_detected"),
        F.array_join("recommendations", " | ").alias("recommendations"))


FAILURE_RISK_CONFIDENCE = 0.92


def failure_risk_report(latest: DataFrame) -> DataFrame:
    """Risk score (3 places), level, failure window, components, actions."""
    score = K.risk_score()
    return latest.select(
        HOST, SAMPLE, TS,
        K.score_risk_level(score).alias("overall_risk_level"),
        round_half_up(score, 3).alias("risk_score"),
        K.failure_window(score).alias("time_to_potential_failure"),
        K.at_risk_components().alias("most_at_risk_components"),
        K.preventive_actions().alias("preventive_actions"),
        F.lit(FAILURE_RISK_CONFIDENCE).alias("confidence"))


# ------------------------------------------------------------------ R15/R16
FALLBACK_CONFIDENCE = 0.7


def fallback_forecast(hosts: DataFrame, latest: DataFrame) -> DataFrame:
    """Every known host gets a risk; hosts without a current sample get
    'unknown'.  ``hosts`` is (host_id); ``latest`` one sample per host."""
    j = hosts.join(latest.select(HOST, CPU, MEM, DISK), HOST, "left")
    has = F.col(CPU).isNotNull() | F.col(MEM).isNotNull()
    risk = (F.when(~has, "unknown")
             .when((F.col(MEM) > 90) | (F.col(CPU) > 90), "high")
             .when((F.col(MEM) > 85) | (F.col(CPU) > 80), "medium").otherwise("low"))
    return j.select(HOST, risk.alias("overall_risk"),
                    F.when(has, F.lit(FALLBACK_CONFIDENCE)).alias("confidence"),
                    F.lit(True).alias("fallback_mode"),
                    F.when(has, K.component_risk(CPU)).alias("cpu_risk"),
                    F.when(has, K.component_risk(MEM)).alias("memory_risk"),
                    F.when(has, K.component_risk(DISK)).alias("disk_risk"))


# ------------------------------------------------------------------ R17-R19
FORECAST_ALERT_RULES = (  # forecast column, above, level, title, text before / after the value
    ("cpu_6h", 90, "warning", "CPU Usage Forecast Alert", "CPU usage predicted to reach ",
     "% in 6 hours. Consider optimizing workloads."),
    ("memory_6h", 85, "warning", "Memory Usage Forecast Alert", "Memory usage predicted to reach ",
     "% in 6 hours. Monitor for memory leaks."),
    ("disk_6h", 90, "critical", "Disk Space Forecast Alert", "Disk usage predicted to reach ",
     "% in 6 hours. Free up disk space immediately."))


def forecast_alerts(forecasts: DataFrame, confidence_col: str = "confidence") -> DataFrame:
    """Alerts from 6-hour forecasts (columns cpu_6h, memory_6h, disk_6h)."""
    items = [F.when(F.col(c) > above, F.struct(
        F.lit(level).alias("level"), F.lit(title).alias("title"),
        F.concat(F.lit(pre), round_half_up(F.col(c), 1).cast("string"), F.lit(post)).alias("message"),
        F.col(c).alias("predicted_value"))) for c, above, level, title, pre, post in FORECAST_ALERT_RULES]
    keep = [HOST, SAMPLE, TS]
    ex = F.explode(F.filter(F.array(*items), lambda x: x.isNotNull())).alias("_a")
    return forecasts.select(*keep, F.col(confidence_col).alias("confidence"), ex) \
                    .select(*keep, "_a.*", F.lit("6 hours").alias("time_horizon"), "confidence")


FAILURE_HORIZON = "2 hours"


def failure_prediction_report(scored: DataFrame, p: str = "failure_probability") -> DataFrame:
    """Probability, will_fail (p > .5), confidence, horizon, level."""
    pc = F.col(p)
    return scored.select(HOST, SAMPLE, TS, pc.alias("failure_probability"),
                         (pc > 0.5).alias("will_fail"),
                         F.when(pc > 0.5, pc).otherwise(F.lit(1.0) - pc).alias("confidence"),
                         F.lit(FAILURE_HORIZON).alias("time_horizon"),
                         K.probability_risk_level(pc).alias("risk_level"))


def failure_alerts(report: DataFrame) -> DataFrame:
    """High level and p > .8 -> critical; medium and p > .5 -> warning;
    (.7, .8] stays without alert as in the reference."""
    p, lv = F.col("failure_probability"), F.col("risk_level")
    crit = (lv == "high") & (p > 0.8)
    warn = (lv == "medium") & (p > 0.5)
    level = F.when(crit, "critical").when(warn, "warning")
    title = F.when(crit, "IMMINENT SYSTEM FAILURE PREDICTED").when(warn, "Potential System Issue Detected")
    msg = F.when(crit, F.concat(F.lit("High probability ("), pct_text(p), F.lit(") of system failure within "),
                                F.col("time_horizon"), F.lit(". Take immediate action."))) \
           .when(warn, F.concat(F.lit("Moderate probability ("), pct_text(p), F.lit(") of system issues within "),
                                F.col("time_horizon"), F.lit(". Monitor closely.")))
    return report.filter(crit | warn).select(
        HOST, SAMPLE, TS, level.alias("level"), title.alias("title"), msg.alias("message"),
        F.col("failure_probability").alias("probability"), "time_horizon", "confidence")


# ------------------------------------------------------------------ G5, G8, R20-R22
def health_window(metrics: DataFrame, n: int = 10) -> DataFrame:
    """Mean cpu and memory over each host's last ``n`` samples."""
    tail = tables.last_n_per_host(metrics, n, "_r")
    return tail.groupBy(HOST).agg(F.avg(CPU).alias("avg_cpu"), F.avg(MEM).alias("avg_memory"),
                                  F.count(F.lit(1)).alias("window_samples"))


def serving_window_stats(metrics: DataFrame, n: int = 12) -> DataFrame:
    """Tail mean / std / max per host over the last ``n`` samples."""
    tail = tables.last_n_per_host(metrics, n, "_r")
    return tail.groupBy(HOST).agg(
        F.avg(CPU).alias(f"cpu_mean_{n}"), F.stddev_samp(CPU).alias(f"cpu_std_{n}"),
        F.max(CPU).alias(f"cpu_max_{n}"), F.avg(MEM).alias(f"memory_mean_{n}"),
        F.stddev_samp(MEM).alias(f"memory_std_{n}"), F.max(MEM).alias(f"memory_max_{n}"))


def health_score_history(avg_cpu, avg_mem, active):
    """R20 (a): 100 - (.3 cpu10 + .2 mem10 + 5 active), floor 0, 1 place;
    100 without history."""
    s = F.greatest(F.lit(0.0), F.lit(100.0) - (avg_cpu * 0.3 + avg_mem * 0.2 + active * 5))
    return F.when(avg_cpu.isNull(), F.lit(100.0)).otherwise(round_half_up(s, 1))


def health_score_alerts(active):
    """R20 (b): max(0, 100 - 10 x active alerts)."""
    return F.greatest(F.lit(0), F.lit(100) - active * 10)


def health_score_current():
    """R20 (c): max(0, 100 - (.3 cpu + .2 mem)) of the current sample."""
    return F.greatest(F.lit(0.0), F.lit(100.0) - (F.coalesce(F.col(CPU), F.lit(0.0)) * 0.3
                                                  + F.coalesce(F.col(MEM), F.lit(0.0)) * 0.2))


def analytics_summary(metrics: DataFrame, alerts: DataFrame, n: int = 10) -> DataFrame:
    """Health score, alert counts and samples collected per host plus a
    fleet row (host NULL) via ``rollup``.  Three partial aggregates joined
    on the (small) per-host result."""
    tail = tables.last_n_per_host(metrics, n, "_r")
    health = tail.rollup(HOST).agg(F.avg(CPU).alias("_cpu"), F.avg(MEM).alias("_mem"))
    counts = metrics.rollup(HOST).agg(F.count(F.lit(1)).alias("metrics_collected"))
    from .alerts import alert_counts
    ac = alert_counts(alerts)
    j = (counts.join(health, counts[HOST].eqNullSafe(health[HOST]), "left").drop(health[HOST])
               .join(ac, counts[HOST].eqNullSafe(ac[HOST]), "left").drop(ac[HOST]))
    z = F.lit(0).cast("long")
    j = j.select(HOST, "metrics_collected", "_cpu", "_mem",
                 *[F.coalesce(F.col(c), z).alias(c) for c in
                   ("total_alerts", "critical_alerts", "warning_alerts", "active_alerts")])
    return j.select(HOST, health_score_history(F.col("_cpu"), F.col("_mem"), F.col("active_alerts"))
                    .alias("health_score"),
                    "total_alerts", "critical_alerts", "warning_alerts", "active_alerts",
                    "metrics_collected")


# ------------------------------------------------------------------ R23
CHART_RANGES = {"5m": (5, "1 minute"), "15m": (15, "1 minute"), "1h": (12, "5 minutes")}


def chart_series(metrics: DataFrame, time_range: str = "1h") -> DataFrame:
    """The last n buckets of each host's grid ending at its newest
    bucket, with current / avg / max / min, delta to the previous point,
    direction and chart status per metric.

    Only n + 1 values per host are needed: the means of buckets inside the
    window and the latest bucket before it (carried forward), both found
    with partial aggregates; the per-host window then sees n + 1 rows."""
    n, period = CHART_RANGES[time_range]
    b = F.window(TS, period).start.cast("timestamp_ntz")
    means = metrics.groupBy(HOST, b.alias("bucket")).agg(
        F.avg(CPU).alias(CPU), F.avg(MEM).alias(MEM), F.avg(DISK).alias(DISK))
    return chart_of_buckets(means, n, period)


def chart_of_buckets(means: DataFrame, n: int, period: str) -> DataFrame:
    """R23 from the means of each host's buckets of ``period``."""
    from ..operators.rolling import _period_micros
    pm = _period_micros(period)
    last = means.groupBy(HOST).agg(F.max("bucket").alias("_last"))
    start = F.col("_last") - F.expr(f"INTERVAL {(n - 1) * pm // 1_000_000} SECONDS")
    m2 = means.join(last, HOST).withColumn("_start", start)
    inside = m2.filter(F.col("bucket") >= F.col("_start"))
    before = (m2.filter(F.col("bucket") < F.col("_start")).groupBy(HOST)
                .agg(F.max_by(F.struct(CPU, MEM, DISK), "bucket").alias("_b")))
    cal = last.select(HOST, F.explode(F.sequence(
        F.col("_last") - F.expr(f"INTERVAL {(n - 1) * pm // 1_000_000} SECONDS"), F.col("_last"),
        F.expr(f"INTERVAL {period}"))).alias("bucket"))
    g = cal.join(inside.select(HOST, "bucket", CPU, MEM, DISK), [HOST, "bucket"], "left") \
           .join(before, HOST, "left")
    w = Window.partitionBy(HOST).orderBy("bucket")
    wf = w.rowsBetween(Window.unboundedPreceding, 0)
    vals = [F.coalesce(F.col(c), F.last(c, ignorenulls=True).over(wf), F.col(f"_b.{c}")).alias(c)
            for c in (CPU, MEM, DISK)]
    g = g.select(HOST, "bucket", *vals)
    wa = Window.partitionBy(HOST)
    out = []
    short = {CPU: "cpu", MEM: "memory", DISK: "disk"}
    for c in (CPU, MEM, DISK):
        s = short[c]
        prev = F.lag(c, 1).over(w)
        out += [F.col(c).alias(f"{s}_current"), F.avg(c).over(wa).alias(f"{s}_avg"),
                F.max(c).over(wa).alias(f"{s}_max"), F.min(c).over(wa).alias(f"{s}_min"),
                F.abs(F.col(c) - prev).alias(f"{s}_delta"),
                F.when(prev.isNull(), F.lit(None)).when(F.col(c) > prev, "up").otherwise("down")
                 .alias(f"{s}_direction"),
                K.usage_status(c, K.CHART_STATUS_LIMITS).alias(f"{s}_status")]
    r = F.row_number().over(Window.partitionBy(HOST).orderBy(F.col("bucket").desc()))
    return g.select(HOST, "bucket", *out, r.alias("_r")).filter(F.col("_r") == 1).drop("_r")


# ------------------------------------------------------------------ R29-R31
INSIGHT_TEXTS = {"memory": "High memory usage detected", "cpu": "Elevated CPU usage",
                 "normal": "System operating within normal parameters"}
STATUS_TEXTS = {"high": "Critical Attention Needed", "medium": "Monitor Closely",
                "other": "Stable Operation"}


def system_insights(latest: DataFrame) -> DataFrame:
    """Insight texts and status text per host from the latest sample."""
    ins = F.filter(F.array(F.when(F.col(MEM) > 85, F.lit(INSIGHT_TEXTS["memory"])),
                           F.when(F.col(CPU) > 80, F.lit(INSIGHT_TEXTS["cpu"]))), lambda x: x.isNotNull())
    ins = F.when(F.size(ins) == 0, F.array(F.lit(INSIGHT_TEXTS["normal"]))).otherwise(ins)
    rr = K.realtime_risk()
    status = F.when(rr == "high", STATUS_TEXTS["high"]).when(rr == "medium", STATUS_TEXTS["medium"]) \
              .otherwise(STATUS_TEXTS["other"])
    return latest.select(HOST, SAMPLE, TS, rr.alias("realtime_risk"),
                         F.array_join(ins, " | ").alias("insights"), status.alias("status_text"))
