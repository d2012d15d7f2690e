"""Small pieces the operators of this subpackage share."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# ASCII white space and its complement, as the operators' contracts name them
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared folder of ``spark.checkpoint.dir``."""
    return os.path.join(ensure_checkpoint_dir(spark), "llm", f"{name}-{uuid.uuid4().hex}")


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and go on from the
    written table: lineage ends there, and a lost executor costs a reread."""
    path = path or work_dir(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def hex_lower(binary: Column) -> Column:
    return F.lower(F.hex(binary))


def numbered(df: DataFrame, keys: list[str], order: list[str], counts: dict, bucket_rows: int = 20_000) -> DataFrame:
    """Adds ``_rank``, 0 .. n-1 within the (single) key, in a fixed order.
    ``counts`` (key value: rows; few values) splits a key into hash buckets of
    about ``bucket_rows`` rows, so no task sorts a whole hot key; offsets come
    from the buckets' counts.  Rows equal in ``order`` may change places."""
    key = keys[0]
    h = F.xxhash64(*order)
    split = [(k, n // bucket_rows + 1) for k, n in counts.items() if n > bucket_rows]
    buckets = F.lit(1)
    if split:
        buckets = F.coalesce(F.create_map(*[F.lit(x) for kn in split for x in kn])[F.col(key)], F.lit(1))
    b = df.withColumn("_h", h).withColumn("_b", F.pmod("_h", buckets.cast("long")))
    held = b.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("_n"))
    offsets = held.select(key, "_b", F.coalesce(F.sum("_n").over(
        Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    inside = F.row_number().over(Window.partitionBy(key, "_b").orderBy("_h", *order))
    return (b.join(offsets, [key, "_b"]).withColumn("_rank", F.col("_o") + inside - 1).drop("_h", "_b", "_o"))


class Masked:
    """``docs`` under plain column names (c0, c1, ...), so that no name of an
    operator can clash with one of the table; ``back`` gives the names again."""

    def __init__(self, docs: DataFrame):
        self.names = docs.columns
        self.df = docs.toDF(*[f"c{i}" for i in range(len(self.names))])

    def of(self, name: str) -> str:
        """The plain name; of names that differ in case only the exact one, else the first."""
        same = [i for i, n in enumerate(self.names) if n == name] or [
            i for i, n in enumerate(self.names) if n.lower() == name.lower()]
        return f"c{same[0]}"

    def has(self, name: str) -> bool:
        return name in self.names

    def back(self, df: DataFrame, *more: str) -> DataFrame:
        """The table's columns and ``more``, which take the place of columns so named."""
        own = [F.col(f"c{i}").alias(n) for i, n in enumerate(self.names) if n not in more]
        return df.select(*own, *more)

    def with_length(self, df: DataFrame) -> DataFrame:
        """``df`` with ``n_chars``, if the table has it, following the text."""
        if not (self.has("n_chars") and self.has("text")):
            return df
        c = self.of("n_chars")
        return df.withColumn(c, F.length(self.of("text")).cast(df.schema[c].dataType))
