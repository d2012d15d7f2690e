"""An alert store that is updated in place.

Alerts are kept by bucket of their id.  A batch of changes (new alerts, later
resolutions) rewrites only the buckets it touches, each as a new version; a
manifest of one row per bucket says which version holds.  A batch that is tried
again starts from the manifest before it and writes the same version, so it
counts once (``foreachBatch``).  Readers of an older manifest keep its files.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

ID = "alert_id"


class AlertStore:
    """``schema`` is that of an alert, with ``alert_id``, ``level``, ``resolved`` and ``resolved_at``."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, buckets: int = 64):
        self.spark, self.path, self.schema, self.buckets = spark, path, schema, buckets

    def _bucket(self):
        return F.pmod(F.xxhash64(ID), F.lit(self.buckets)).cast("int")

    def manifest(self, before: int | None = None) -> dict[int, int]:
        """Version of each bucket (at most ``buckets`` entries), as of the last batch or that before ``before``."""
        path = os.path.join(self.path, "manifest")
        try:
            m = self.spark.read.schema("bucket int, version bigint, batch bigint").parquet(path)
        except Exception as e:  # noqa: BLE001 - nothing written yet
            if "PATH_NOT_FOUND" in str(e):
                return {}
            raise
        if before is not None:
            m = m.filter(F.col("batch") < before)
        last = m.groupBy("bucket").agg(F.max("version").alias("version"))
        return {r.bucket: r.version for r in last.collect()}

    def _files(self, versions: dict[int, int]) -> DataFrame:
        paths = [os.path.join(self.path, "alerts", f"version={v}", f"bucket={b}") for b, v in sorted(versions.items())]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def upsert(self, changes: DataFrame, batch: int) -> list[int]:
        """Applies a batch: a row with a known id may resolve it and changes nothing
        else, one with a new id is added if it is a whole alert (has a level).
        Returns the buckets rewritten."""
        names = self.schema.names
        ch = changes.select(*[F.col(c) if c in changes.columns else F.lit(None).cast(self.schema[c].dataType).alias(c) for c in names]).withColumn("_b", self._bucket())
        touched = sorted(r[0] for r in ch.select("_b").distinct().collect())  # at most ``buckets``
        if not touched:
            return []
        held = self.manifest(before=batch)
        old = self._files({b: held[b] for b in touched if b in held})
        rest = [c for c in names if c not in (ID, "resolved", "resolved_at")]
        both = old.withColumn("_new", F.lit(0)).unionByName(ch.select(*names).withColumn("_new", F.lit(1)))
        whole = F.when(F.col("level").isNotNull(), F.struct(F.col("_new"), *rest))
        now = both.groupBy(ID).agg(F.min(whole).alias("_a"), F.max("resolved_at").alias("resolved_at"),
                                   F.max(F.coalesce("resolved", F.lit(False))).alias("_r"))
        now = now.filter("_a is not null").select(
            ID, *[F.col(f"_a.{c}").alias(c) for c in rest],
            (F.col("_r") | F.col("resolved_at").isNotNull()).alias("resolved"), "resolved_at")
        path = os.path.join(self.path, "alerts", f"version={batch}")
        now.select(*names, self._bucket().alias("bucket")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        written = self.spark.read.schema(StructType([*self.schema.fields, StructField("bucket", IntegerType())])).parquet(path)
        kept = sorted(r[0] for r in written.select("bucket").distinct().collect())
        (self.spark.createDataFrame([(b, batch) for b in kept], "bucket int, version bigint").coalesce(1)
         .write.mode("overwrite").parquet(os.path.join(self.path, "manifest", f"batch={batch}")))
        return kept

    def alerts(self) -> DataFrame:
        """The store as the last batch left it."""
        return self._files(self.manifest())
