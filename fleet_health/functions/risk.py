"""Rule-based risk, forecast-band and text expressions (R1-R12, R16, R21,
R27-R31).  Pure Catalyst expressions over one row; no UDFs.

Fixed values that must equal the reference's rules (thresholds, texts,
factors) are stated together in the tables below.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CPU, DISK, MEM
from .scalar import round_half_up

# --- fixed values ------------------------------------------------------
# component risk: (high above, medium above) per metric
COMPONENT_RISK_LIMITS = {CPU: (85, 70), MEM: (90, 75), DISK: (95, 80)}
# time to failure: base minutes; (limit, factor) pairs per metric, tested in order
TTF_BASE_MINUTES = 480
TTF_FACTORS = {CPU: ((85, 0.3), (70, 0.6)), MEM: ((90, 0.4), (75, 0.7)),
               DISK: ((95, 0.5), (80, 0.8))}
# risk score weights
RISK_WEIGHTS = {CPU: 0.4, MEM: 0.35, DISK: 0.25}
# at-risk components and preventive actions: limit, component, action
AT_RISK_RULES = ((CPU, 75, "CPU", "Monitor CPU-intensive processes"),
                 (MEM, 80, "Memory", "Check memory allocation"),
                 (DISK, 85, "Disk", "Clean up disk space"))
# current anomalies: metric, critical above, text, elevated above, text
ANOMALY_RULES = ((CPU, 90, "CPU usage critically high", 80, "CPU usage elevated"),
                 (MEM, 95, "Memory usage critically high", 85, "Memory usage elevated"),
                 (DISK, 98, "Disk space critically low", 90, "Disk space low"))
# recommendations: metric, limit, two texts
RECOMMENDATION_RULES = (
    (CPU, 80, "Consider optimizing CPU-intensive processes", "Monitor application performance"),
    (MEM, 85, "Check for memory leaks in applications", "Consider adding more RAM if pattern persists"),
    (DISK, 90, "Clean up temporary files and logs", "Consider archiving old data"))
DEFAULT_RECOMMENDATIONS = ("System operating within normal parameters", "Continue regular monitoring")
# heuristic forecast bands (low, high offsets added to the current value)
HOURLY_BANDS = {CPU: (-5, 10), MEM: (-3, 8)}
SIX_HOUR_BANDS = {CPU: (-10, 25), MEM: (-5, 15), DISK: (0, 5)}
RESOURCE_BANDS = {CPU: {"1h": (-5, 8), "3h": (-8, 15), "6h": (-10, 20)},
                  MEM: {"1h": (-3, 6), "3h": (-5, 12), "6h": (-8, 18)},
                  DISK: {"6h": (0, 3)}}
# real-time risk (UI): high above, medium above
REALTIME_RISK_LIMITS = {MEM: (90, 85), CPU: (90, 80), DISK: (95, 90)}
# usage status: critical at or above, warning at or above
USAGE_STATUS_LIMITS = {CPU: (80, 60), MEM: (80, 60), DISK: (90, 80)}
CHART_STATUS_LIMITS = {CPU: (85, 70), MEM: (90, 75), DISK: (95, 80)}
HEALTH_STATUS_LIMITS = (80, 60)
RISK_LABELS = {"low": ("Low Risk", "System stable"),
               "medium": ("Medium Risk", "Monitor closely"),
               "high": ("High Risk", "Immediate attention needed"),
               "stable": ("System Optimal", "Optimal performance")}
UNKNOWN_RISK_LABEL = RISK_LABELS["stable"]
# ------------------------------------------------------------------------

_LEVEL_ORD = {"low": 0, "medium": 1, "high": 2}


def component_risk(metric: str) -> Column:
    hi, med = COMPONENT_RISK_LIMITS[metric]
    c = F.col(metric)
    return F.when(c > hi, "high").when(c > med, "medium").otherwise("low")


def overall_risk(*levels: Column) -> Column:
    """Worst of the component levels."""
    ords = [F.when(l == "high", 2).when(l == "medium", 1).otherwise(0) for l in levels]
    g = F.greatest(*ords)
    return F.when(g == 2, "high").when(g == 1, "medium").otherwise("low")


def time_to_failure() -> Column:
    """Minutes = 480 x the smallest triggered factor; NULL if none."""
    factors = []
    for m, ((l1, f1), (l2, f2)) in TTF_FACTORS.items():
        c = F.col(m)
        factors.append(F.when(c > l1, F.lit(f1)).when(c > l2, F.lit(f2)))
    return (F.lit(float(TTF_BASE_MINUTES)) * F.least(*factors)).cast("int")


def risk_score_rounded() -> Column:
    """Risk score rounded to 3 places (as reported)."""
    return round_half_up(risk_score(), 3)


def risk_score() -> Column:
    s = None
    for m, w in RISK_WEIGHTS.items():
        t = F.least(F.col(m) / F.lit(100.0), F.lit(1.0)) * F.lit(w)
        s = t if s is None else s + t
    return s


def score_risk_level(score: Column) -> Column:
    return F.when(score > 0.7, "high").when(score > 0.4, "medium").otherwise("low")


def probability_risk_level(p: Column) -> Column:
    return F.when(p < 0.3, "low").when(p < 0.7, "medium").otherwise("high")


def failure_window(score: Column) -> Column:
    return (F.when(score > 0.7, "2-4 hours").when(score > 0.4, "6-12 hours")
            .otherwise("12+ hours"))


def _present(items: list[Column]) -> Column:
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def at_risk_components() -> Column:
    a = _present([F.when(F.col(m) > lim, F.lit(name)) for m, lim, name, _ in AT_RISK_RULES])
    return F.when(F.size(a) == 0, F.array(F.lit("None"))).otherwise(a)


def preventive_actions() -> Column:
    a = _present([F.when(F.col(m) > lim, F.lit(act)) for m, lim, _, act in AT_RISK_RULES])
    return F.when(F.size(a) == 0, F.array(F.lit("Continue normal monitoring"))).otherwise(a)


def current_anomalies() -> Column:
    return _present([F.when(F.col(m) > hi, F.lit(t1)).when(F.col(m) > lo, F.lit(t2))
                     for m, hi, t1, lo, t2 in ANOMALY_RULES])


def recommendations() -> Column:
    a = F.flatten(F.filter(F.array(*[
        F.when(F.col(m) > lim, F.array(F.lit(t1), F.lit(t2)))
        for m, lim, t1, t2 in RECOMMENDATION_RULES]), lambda x: x.isNotNull()))
    return F.when(F.size(a) == 0, F.array(*[F.lit(t) for t in DEFAULT_RECOMMENDATIONS])).otherwise(a)


def band(metric: str, lo: float, hi: float) -> tuple[Column, Column, Column]:
    """Deterministic low / mid / high of ``min(100, current + U(lo, hi))``."""
    c = F.col(metric)
    return (F.least(F.lit(100.0), c + F.lit(float(lo))),
            F.least(F.lit(100.0), c + F.lit((lo + hi) / 2.0)),
            F.least(F.lit(100.0), c + F.lit(float(hi))))


def hourly_anomaly_probability() -> Column:
    return F.when(F.col(CPU) > 80, F.lit(0.1)).otherwise(F.lit(0.02))


def six_hour_failure_probability() -> Column:
    return F.when(F.col(CPU) > 85, F.lit(0.3)).when(F.col(CPU) > 70, F.lit(0.1)).otherwise(F.lit(0.02))


def hourly_trend() -> Column:
    return F.when(F.col(CPU) > 70, "increasing").otherwise("stable")


def recommended_action() -> Column:
    return F.when(F.col(CPU) > 80, "Increase monitoring").otherwise("Normal operation")


def realtime_risk() -> Column:
    """UI risk: high / medium / low from the latest sample; no sample -> stable."""
    hi = None
    med = None
    for m, (h, md) in REALTIME_RISK_LIMITS.items():
        hi = (F.col(m) > h) if hi is None else hi | (F.col(m) > h)
        med = (F.col(m) > md) if med is None else med | (F.col(m) > md)
    present = F.col(CPU).isNotNull() | F.col(MEM).isNotNull() | F.col(DISK).isNotNull()
    return (F.when(~present, "stable").when(F.coalesce(hi, F.lit(False)), "high")
            .when(F.coalesce(med, F.lit(False)), "medium").otherwise("low"))


def usage_status(metric: str, limits=None) -> Column:
    crit, warn = (limits or USAGE_STATUS_LIMITS)[metric]
    c = F.col(metric)
    return F.when(c >= crit, "critical").when(c >= warn, "warning").otherwise("normal")


def health_status(score: Column) -> Column:
    good, fair = HEALTH_STATUS_LIMITS
    return F.when(score >= good, "normal").when(score >= fair, "warning").otherwise("critical")


def format_ttf(minutes: Column) -> Column:
    """< 60 -> "N minutes"; else "Hh Mm" or "Hh"; NULL / 0 -> "No imminent failure"."""
    m = minutes.cast("long")
    h = F.floor(m / 60).cast("long")
    r = F.pmod(m, F.lit(60))
    return (F.when(m.isNull() | (m == 0), F.lit("No imminent failure"))
            .when(m < 60, F.concat(m.cast("string"), F.lit(" minutes")))
            .when(r > 0, F.concat(h.cast("string"), F.lit("h "), r.cast("string"), F.lit("m")))
            .otherwise(F.concat(h.cast("string"), F.lit("h"))))


def risk_label(level: Column) -> tuple[Column, Column]:
    lab = F.lit(UNKNOWN_RISK_LABEL[0])
    desc = F.lit(UNKNOWN_RISK_LABEL[1])
    for k, (l, d) in reversed(list(RISK_LABELS.items())):
        lab = F.when(level == k, F.lit(l)).otherwise(lab)
        desc = F.when(level == k, F.lit(d)).otherwise(desc)
    return lab, desc


def alert_outlook(metric: str, add: float) -> Column:
    """min(100, value + add) rounded to 1 place; NULL for a missing or 0 value."""
    c = F.col(metric)
    return F.when(c.isNull() | (c == 0), F.lit(None).cast("double")).otherwise(
        round_half_up(F.least(F.lit(100.0), c + F.lit(float(add))), 1))
