"""Multi-resolution roll-ups as mergeable states.

Each batch of samples becomes states (rows, sums, least, greatest, last) of the
finest buckets, and each coarser level is merged from the level below, never
from the samples.  States of several batches merge in the same way when they
are read, so late samples need no rewrite, and a report of any range reads the
coarsest level that fits it.  A batch has its own folders and replaces them when
it is written again; ``compact`` merges the batches so far into one.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CPU, DISK, HOST, MEM, SAMPLE, TS

LEVELS = ("1 minute", "5 minutes", "1 hour")
METRICS = (CPU, MEM, DISK)
_LAST = f"struct<{TS}:timestamp_ntz,{SAMPLE}:bigint,{CPU}:double,{MEM}:double,{DISK}:double>"
STATE = (f"{HOST} bigint, bucket timestamp_ntz, samples bigint, "
         + ", ".join(f"{c}_n bigint, {c}_sum double, {c}_min double, {c}_max double" for c in METRICS) + f", last {_LAST}")


def states_of(samples: DataFrame, level: str = LEVELS[0]) -> DataFrame:
    """States of the samples' buckets."""
    return samples.groupBy(HOST, F.window(TS, level).start.cast("timestamp_ntz").alias("bucket")).agg(
        F.count(F.lit(1)).alias("samples"),
        *[f(c).alias(f"{c}_{n}") for c in METRICS for n, f in (("n", F.count), ("sum", F.sum), ("min", F.min), ("max", F.max))],
        F.max(F.struct(TS, SAMPLE, *METRICS)).alias("last"))


def merged(states: DataFrame, level: str | None = None) -> DataFrame:
    """States with the same bucket merged; with ``level`` into its wider buckets."""
    bucket = F.window("bucket", level).start.cast("timestamp_ntz").alias("bucket") if level else F.col("bucket")
    return states.groupBy(HOST, bucket).agg(
        F.sum("samples").alias("samples"),
        *[f(f"{c}_{n}").alias(f"{c}_{n}") for c in METRICS for n, f in (("n", F.sum), ("sum", F.sum), ("min", F.min), ("max", F.max))],
        F.max("last").alias("last"))


def means(states: DataFrame) -> DataFrame:
    return states.select(HOST, "bucket", *[F.try_divide(f"{c}_sum", f"{c}_n").alias(c) for c in METRICS])


class RollupStore:
    """The levels' states below ``path``, by batch."""

    def __init__(self, spark: SparkSession, path: str, levels=LEVELS):
        self.spark, self.path, self.levels = spark, path, tuple(levels)

    def _folder(self, level: str, batch) -> str:
        return os.path.join(self.path, level.replace(" ", "_"), f"batch={batch}")

    def add(self, samples: DataFrame, batch: int) -> None:
        """One batch (also as ``foreachBatch``): the finest level from the samples,
        each coarser one from the level below as written."""
        below = None
        for level in self.levels:
            state = states_of(samples, level) if below is None else merged(below, level)
            state.write.mode("overwrite").parquet(self._folder(level, batch))
            below = self.spark.read.schema(STATE).parquet(self._folder(level, batch))

    def read(self, level: str) -> DataFrame:
        """The states of a level, all batches merged."""
        return merged(self.spark.read.schema(STATE).parquet(os.path.join(self.path, level.replace(" ", "_"))))

    def compact(self, path: str) -> "RollupStore":
        """All batches as batch 0 of a new store."""
        out = RollupStore(self.spark, path, self.levels)
        for level in self.levels:
            self.read(level).write.mode("overwrite").parquet(out._folder(level, 0))
        return out

    def level_for(self, period: str) -> str:
        """The coarsest level whose buckets make up ``period``."""
        from .rolling import _period_micros
        fits = [level for level in self.levels if _period_micros(period) % _period_micros(level) == 0]
        if not fits:
            raise ValueError(f"no level divides {period}")
        return max(fits, key=_period_micros)

    def buckets(self, period: str) -> DataFrame:
        """Means of buckets of ``period`` by host."""
        level = self.level_for(period)
        states = self.read(level)
        return means(states if level == period else merged(states, period))

    def summary(self) -> DataFrame:
        """Per host: samples, means over all time and the latest values, from the coarsest level."""
        s = self.read(self.levels[-1])
        return s.groupBy(HOST).agg(
            F.sum("samples").alias("samples"),
            *[F.try_divide(F.sum(f"{c}_sum"), F.sum(f"{c}_n")).alias(f"avg_{c}") for c in METRICS],
            *[F.max(f"{c}_max").alias(f"max_{c}") for c in METRICS], F.max("last").alias("last")).select(
            HOST, "samples", *[f"avg_{c}" for c in METRICS], *[f"max_{c}" for c in METRICS],
            *[F.col(f"last.{c}").alias(f"last_{c}") for c in METRICS])
