"""Reading the metrics table and deriving it from the given event tables.

The driver's test data has no telemetry table, so every fixture below is a
projection of ``events`` (FIXTURES.md §2): one sample per event, host =
user.  All derivations are single ``select`` projections, so they stay
inside one scan stage and Parquet column pruning reads only the event
columns used.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import (CPU, DISK, DISK_FREE, DISK_USED, HOST, LABEL, MEM,
                      MEM_AVAIL, MEM_USED, SAMPLE, TS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("double")


def _metric_columns() -> list[Column]:
    mem = F.least(F.lit(100.0), F.lit(40.0) + F.lit(0.6) * _k())
    disk = (F.lit(30) + (F.col("event_id") * 7 + F.col("user_id") * 13) % 71).cast("double")
    return [
        F.col("user_id").alias(HOST),
        F.col("event_id").alias(SAMPLE),
        F.col("ts").alias(TS),
        F.least(F.col("value"), F.lit(100.0)).alias(CPU),
        mem.alias(MEM),
        (F.lit(0.16) * mem).alias(MEM_USED),
        (F.lit(16.0) - F.lit(0.16) * mem).alias(MEM_AVAIL),
        disk.alias(DISK),
        (F.lit(5.12) * disk).alias(DISK_USED),
        (F.lit(512.0) - F.lit(5.12) * disk).alias(DISK_FREE),
        ((F.col("event_type") == "error") & (F.col("value") > 60)).cast("int").alias(LABEL),
    ]


def metrics_from_events(events: DataFrame) -> DataFrame:
    """Fixture adapter: one telemetry sample per ``events`` row."""
    return events.select(*_metric_columns())


def scored_from_events(events: DataFrame) -> DataFrame:
    """Fixture ``scored``: metrics + anomaly_probability = least(1, value/120)."""
    return events.select(
        *_metric_columns(),
        F.least(F.lit(1.0), F.col("value") / F.lit(120.0)).alias("anomaly_probability"))


def votes_from_events(events: DataFrame) -> DataFrame:
    """Fixture ``votes``: three 0/1 member predictions and the truth."""
    disk = (F.lit(30) + (F.col("event_id") * 7 + F.col("user_id") * 13) % 71).cast("double")
    return events.select(
        F.col("user_id").alias(HOST),
        F.col("event_id").alias(SAMPLE),
        F.col("ts").alias(TS),
        (F.col("value") > 80).cast("int").alias("pred_a"),
        (_k() > 90).cast("int").alias("pred_b"),
        (disk > 95).cast("int").alias("pred_c"),
        ((F.col("event_type") == "error") & (F.col("value") > 60)).cast("int").alias("truth"),
    )


def load_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics_from_events(table(spark, sf_dir, "events"))


def load_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_from_events(table(spark, sf_dir, "events"))


def load_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes_from_events(table(spark, sf_dir, "events"))
