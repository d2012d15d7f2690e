"""Feature scaling."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def standardize(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = (),
                suffix: str = "") -> DataFrame:
    """Zero mean, unit (population) variance per column; a constant column
    maps to 0.  All means and deviations are one row from one aggregate over
    ``df``, read as a scalar subquery, so no join is needed."""
    stats = df.agg(F.struct(*[f(c).alias(f"{n}{i}") for i, c in enumerate(cols)
                              for n, f in (("mean", F.avg), ("std", F.stddev_pop))]).alias("_s")).scalar()
    out = [F.coalesce(F.try_divide(F.col(c) - stats[f"mean{i}"], stats[f"std{i}"]), F.lit(0.0)).alias(f"{c}{suffix}")
           for i, c in enumerate(cols)]
    return df.select(*keep, *out)
