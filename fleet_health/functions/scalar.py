"""Row-level expressions: projections, calendar, ratios, flags.

All are Catalyst expressions, so they fuse into whole-stage codegen with
the scan and with each other.
"""

from __future__ import annotations

import math
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import CPU, DISK, LABEL, MEM, TS


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_up(c, places: int) -> Column:
    """Round half up as floor(x * 10^n + 0.5) / 10^n: plain IEEE arithmetic,
    so every engine returns the same double (used for reported figures)."""
    f = float(10 ** places)
    return F.floor(col(c) * F.lit(f) + F.lit(0.5)) / F.lit(f)


# ----------------------------------------------------------------- P1-P5
def bytes_to_gb(c) -> Column:
    """bytes / 1024^3 rounded to 2 places."""
    return F.round(col(c) / F.lit(float(1024 ** 3)), 2)


def select_features(df: DataFrame, exclude: Iterable[str] = (TS, LABEL)) -> list[str]:
    """All columns except ``exclude``, in table order."""
    ex = set(exclude)
    return [c for c in df.columns if c not in ex]


def clamp_percent(c) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), col(c)))


def align_features(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Columns ``names`` in that exact order; missing -> 0.0, NULL -> 0."""
    have = set(df.columns)
    cols = [F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) if n in have
            else F.lit(0.0).alias(n) for n in names]
    return df.select(*keep, *cols)


# ----------------------------------------------------------------- F1-F8
def hour(ts=TS) -> Column:
    return F.hour(col(ts))


def day_of_week(ts=TS) -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(col(ts))


def is_weekend(ts=TS) -> Column:
    return (F.weekday(col(ts)) >= 5).cast("int")


def calendar_columns(ts=TS, cyclical: bool = False) -> list[Column]:
    out = [hour(ts).alias("hour"), day_of_week(ts).alias("day_of_week"),
           is_weekend(ts).alias("is_weekend")]
    if cyclical:
        out += [hour_sin(ts).alias("hour_sin"), hour_cos(ts).alias("hour_cos")]
    return out


def hour_sin(ts=TS) -> Column:
    return F.sin(F.lit(2 * math.pi) * hour(ts) / F.lit(24.0))


def hour_cos(ts=TS) -> Column:
    return F.cos(F.lit(2 * math.pi) * hour(ts) / F.lit(24.0))


def cpu_memory_ratio(eps: float = 0.001) -> Column:
    return F.try_divide(F.col(CPU), F.col(MEM) + F.lit(eps))


def memory_disk_ratio(eps: float = 0.001) -> Column:
    return F.try_divide(F.col(MEM), F.col(DISK) + F.lit(eps))


def system_load_index() -> Column:
    return F.col(CPU) * 0.6 + F.col(MEM) * 0.3 + F.col(DISK) * 0.1


def system_load() -> Column:
    return (F.col(CPU) + F.col(MEM)) / 2


def pressure_flags() -> list[Column]:
    return [((F.col(CPU) > 80) & (F.col(MEM) < 20)).cast("int").alias("high_cpu_low_memory"),
            (F.col(MEM) > 90).cast("int").alias("memory_pressure"),
            (F.col(DISK) > 90).cast("int").alias("disk_pressure")]


# Fixed limits of the two pressure counts (detector / failure model).
DETECTOR_PRESSURE_LIMITS = (80, 80, 80)
FAILURE_PRESSURE_LIMITS = (80, 85, 90)


def resource_pressure(limits=DETECTOR_PRESSURE_LIMITS) -> Column:
    """Number of metrics above their limit (cpu, memory, disk)."""
    c, m, d = limits
    return ((F.col(CPU) > c).cast("int") + (F.col(MEM) > m).cast("int")
            + (F.col(DISK) > d).cast("int"))
