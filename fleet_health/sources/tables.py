"""Table-level reads of the metrics store.

Top-n-per-host reads use ``row_number() <= n`` over a per-host window:
Spark plans this with a partial ``WindowGroupLimit`` before the shuffle,
so each map task forwards at most ``n`` rows per host and a hot host
never reaches one reducer whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import HOST, SAMPLE, TS


def table_stats(df: DataFrame, per_host: bool = True) -> DataFrame:
    """COUNT(*) and MAX(timestamp); per host plus a fleet row (host NULL)."""
    aggs = [F.count(F.lit(1)).alias("samples"), F.max(TS).alias("latest")]
    if per_host:
        return df.rollup(HOST).agg(*aggs)
    return df.agg(*aggs)


def latest_n_samples(df: DataFrame, n: int = 5000) -> DataFrame:
    """Newest ``n`` rows of the table, returned oldest first (TakeOrdered)."""
    newest = df.orderBy(F.col(TS).desc(), F.col(SAMPLE).desc()).limit(n)
    return newest.orderBy(TS, SAMPLE)


def last_n_per_host(df: DataFrame, n: int, rank_col: str = "recency_rank") -> DataFrame:
    """The newest ``n`` samples of every host; ``recency_rank`` 1 = newest."""
    w = Window.partitionBy(HOST).orderBy(F.col(TS).desc(), F.col(SAMPLE).desc())
    return (df.withColumn(rank_col, F.row_number().over(w))
              .filter(F.col(rank_col) <= n))


def latest_sample(df: DataFrame) -> DataFrame:
    """Most recent reading per host (a partial aggregate; skew safe)."""
    cols = [c for c in df.columns if c != HOST]
    last = F.max_by(F.struct(*cols), F.struct(F.col(TS), F.col(SAMPLE)))
    return df.groupBy(HOST).agg(last.alias("_s")).select(HOST, "_s.*")


def metrics_history(df: DataFrame, hours: int = 24, cap: int = 288,
                    now=None) -> DataFrame:
    """Rows newer than now - ``hours`` (now = newest timestamp of the table
    unless given), at most the newest ``cap`` per host, oldest first.  On the
    table that ``append_metrics`` writes, the day partitions are filtered too."""
    # "now" is a scalar subquery: computed once, then a literal in the filter
    now_col = df.agg(F.max(TS)).scalar() if now is None else F.lit(now)
    since = now_col - F.expr(f"INTERVAL {int(hours)} HOURS")
    recent = df.filter(F.col(TS) > since)
    if "date" in df.columns:
        recent = recent.filter(F.col("date") >= F.to_date(since))
    return last_n_per_host(recent, cap, "_r").drop("_r")
