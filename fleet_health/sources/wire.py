"""Wire format (S1), file sinks (S2) and CSV exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import FLEET_WIRE_SCHEMA, HOST, METRIC_COLUMNS, SAMPLE, TS


def encode_samples(metrics: DataFrame) -> DataFrame:
    """One JSON text per sample (``value``), ISO timestamp with microseconds."""
    st = F.struct(F.col(HOST), F.col(SAMPLE),
                  F.date_format(TS, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(TS),
                  *[F.col(c) for c in METRIC_COLUMNS])
    return metrics.select(F.to_json(st).alias("value"))


def decode_samples(text: DataFrame, col: str = "value", with_quarantine: bool = False):
    """JSON text -> typed samples.  Malformed texts (unparseable, or missing
    host, id or timestamp) are not failures: they go to a quarantine frame
    (``with_quarantine=True`` returns ``(good, bad)``)."""
    parsed = text.select(F.col(col).alias("_raw"),
                         F.from_json(F.col(col), FLEET_WIRE_SCHEMA, {"mode": "PERMISSIVE"}).alias("_s"))
    ts = F.try_to_timestamp(F.col(f"_s.{TS}")).cast("timestamp_ntz")
    ok = F.col(f"_s.{HOST}").isNotNull() & F.col(f"_s.{SAMPLE}").isNotNull() & ts.isNotNull()
    good = parsed.filter(ok).select(F.col(f"_s.{HOST}").alias(HOST), F.col(f"_s.{SAMPLE}").alias(SAMPLE),
                                    ts.alias(TS), *[F.col(f"_s.{c}").alias(c) for c in METRIC_COLUMNS])
    if not with_quarantine:
        return good
    bad = parsed.filter(~F.coalesce(ok, F.lit(False))).select(
        F.col("_raw").alias("value"),
        F.when(F.col("_s").isNull(), "unparseable").otherwise("missing field").alias("reason"))
    return good, bad


def append_metrics(df: DataFrame, path: str) -> None:
    """Append samples to the table at ``path``, partitioned by day so
    time-range reads prune partitions."""
    df.withColumn("date", F.to_date(F.col(TS))).write.mode("append").partitionBy("date").parquet(path)


def read_metrics_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_training_csv(df: DataFrame, path: str) -> None:
    """CSV with header (timestamp as ISO text)."""
    df.write.mode("overwrite").option("header", True).option("timestampNTZFormat",
                                                              "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(path)


def read_training_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """CSV with header and a declared schema (no inference)."""
    return (spark.read.schema(schema).option("header", True)
            .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(path))
