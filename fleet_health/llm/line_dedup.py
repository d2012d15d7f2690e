"""Repeated lines across documents by levelled sorted runs (built-in functions only).

The documents' line hashes are taken in one pass over the texts.  They are then
worked off in batches of ascending ids, as in a store that grows by batches:

- a batch keeps each hash's smallest id (a partial aggregate, so a line that a
  third of all documents hold collapses before the shuffle), merge-anti-joins
  the runs written so far, and writes what is new as a run of its own;
- a run is a table bucketed by hash and sorted in its buckets, so the join
  reads it in order and without a shuffle;
- when ``fan_out`` runs stand at a level they are compacted into one run of
  the next level, so a batch meets O(log batches) runs.

As batches ascend by id, the run entry of a hash is (hash, smallest id).  A
document loses the lines whose hash belongs to another id.

A line's key is the line with ASCII white space stripped at both ends and A-Z
lower-cased; its hash is the 128-bit MD5 of the key.  Only keys of at least
``min_chars`` code points count.

Defined results: null and empty texts are one empty line.  Rows with the same
id are parts of one document: a key found only among them stays.  A null id is
one document that sorts last.  Ids are compared as their type is.  Repeated rows are judged alike.  An empty table
gives an empty result.  Columns other than id and text are only passed through.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .common import SPACE_CHARS, Masked, stored, text_of, work_dir

MIN_CHARS = 10
BATCHES = 4
FAN_OUT = 2
CUT_IDS = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    s = F.btrim(line, F.lit(SPACE_CHARS))
    # lower() also changes other letters, so it serves pure ASCII only
    return F.when(F.octet_length(s) == F.length(s), F.lower(s)).otherwise(F.translate(s, UPPER, LOWER))


def line_hashes(lines: Column, min_chars: int) -> Column:
    """One entry per line: the hash of its key in hex, null where the key is short."""
    return F.transform(F.transform(lines, line_key), lambda k: F.when(F.length(k) >= min_chars, F.md5(k)))


class _Runs:
    """The runs of one store, by level; each is a bucketed, sorted table."""

    def __init__(self, spark, fan_out: int):
        self.spark, self.fan_out = spark, fan_out
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name, self.dir, self.n, self.levels = f"line_runs_{uuid.uuid4().hex[:12]}", work_dir(spark, "line_runs"), 0, {}

    def write(self, df: DataFrame) -> str:
        self.n += 1
        name = f"{self.name}_{self.n}"
        (df.repartition(self.buckets, "hash").write.bucketBy(self.buckets, "hash").sortBy("hash")
         .option("path", f"{self.dir}/{self.n}").saveAsTable(name))
        return name

    def add(self, df: DataFrame, level: int = 0) -> None:
        self.levels.setdefault(level, []).append(self.write(df))
        while len(full := self.levels.get(level, [])) >= self.fan_out:
            up = self.write(self.all(full))
            self.drop(full)
            self.levels[level] = []
            level += 1
            self.levels.setdefault(level, []).append(up)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.table(name)

    def all(self, names) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.read(t) for t in names])

    def names(self) -> list[str]:
        return [t for k in sorted(self.levels, reverse=True) for t in self.levels[k]]

    def drop(self, names) -> None:
        for t in names:  # the files stay in the shared folder
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")


def _cuts(lines: DataFrame, batches: int) -> list:
    """Ids between the batches: quantiles, of ids without arithmetic those of
    about ``CUT_IDS`` ids chosen by hash and ordered as their type is."""
    if isinstance(lines.schema["doc_id"].dataType, NumericType):
        return lines.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    some = lines.select("doc_id").filter("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(CUT_IDS)
    ids = [r.doc_id for r in some.orderBy("doc_id").collect()]
    return [ids[len(ids) * i // batches] for i in range(1, batches)] if ids else []


def owners(lines: DataFrame, batches: int = BATCHES, fan_out: int = FAN_OUT) -> DataFrame:
    """``lines`` (``doc_id``, ``hash``) to (``hash``, ``owner``, ``is_null``):
    the smallest id that holds it, null last."""
    spark = lines.sparkSession
    cuts = _cuts(lines, batches)
    batch = F.lit(0)
    for c in sorted(set(cuts)):
        batch = batch + F.when(F.col("doc_id") > F.lit(c), F.lit(1)).otherwise(F.lit(0))
    n = len(set(cuts)) + 1
    batch = F.when(F.col("doc_id").isNull(), F.lit(n)).otherwise(batch)
    nulls = 0 if lines.filter("doc_id is null").limit(1).count() == 0 else 1
    runs = _Runs(spark, fan_out)
    for b in range(n + nulls):
        new = lines.filter(batch == b).groupBy("hash").agg(F.min("doc_id").alias("owner"))
        for t in runs.names():
            new = new.join(runs.read(t).select("hash"), "hash", "left_anti")
        runs.add(new)
    out = stored(runs.all(runs.names()), "line_owners")
    runs.drop(runs.names())
    return out


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        min_chars: int = MIN_CHARS, batches: int = BATCHES, fan_out: int = FAN_OUT) -> DataFrame:
    """``docs`` with the text's repeated lines gone, and ``n_lines`` (before)
    and ``n_dropped``.  A text that loses nothing stays as it is (null too); a
    text that loses all lines becomes empty.  ``n_chars`` follows the text."""
    m = Masked(docs)
    id_, text_ = m.of(id_col), m.of(text_col)
    text = text_of(text_)
    lines = m.df.select(F.col(id_).alias("doc_id"), F.xxhash64(text).alias("text_key"),
                        F.posexplode(line_hashes(F.split(text, "\n", -1), min_chars)).alias("pos", "hash"))
    lines = stored(lines.filter("hash is not null").withColumn("hash", F.unhex("hash")), "line_hashes")
    own = owners(lines.select("doc_id", "hash"), batches, fan_out)
    lost = (lines.join(own, "hash").filter(~F.col("owner").eqNullSafe(F.col("doc_id")))
            .groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("pos")).alias("lost")))
    out = m.df.withColumn("key", F.xxhash64(text))
    out = out.join(lost, F.col(id_).eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("text_key")), "left")
    # what stays lies between the lost positions
    out = out.withColumn("lines", F.split(text, "\n", -1)).withColumn("n_lines", F.size("lines").cast("long"))
    gaps = F.arrays_zip(F.concat(F.array(F.lit(0)), F.transform("lost", lambda p: p + 1)).alias("a"),
                        F.concat(F.col("lost"), F.array(F.size("lines"))).alias("b"))
    kept = F.flatten(F.transform(gaps, lambda g: F.slice(F.col("lines"), g["a"] + 1, g["b"] - g["a"])))
    out = (out.withColumn("n_dropped", F.coalesce(F.size("lost"), F.lit(0)).cast("long"))
           .withColumn(text_, F.when(F.col("lost").isNotNull(), F.array_join(kept, "\n")).otherwise(F.col(text_))))
    return m.back(m.with_length(out), "n_lines", "n_dropped")
