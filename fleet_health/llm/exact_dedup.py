"""Exact duplicates by a tree merge of sorted digest runs (built-in functions only).

Every input partition is one run: its texts' digests, sorted and without
repeats (a sort aggregate).  In each round ``fan_in`` neighbouring runs are
merged into one, again by sorting on the digest, and for each digest the
merged run retains the best row and the number of rows.  After
``ceil(log_fan_in(runs))`` rounds one logical run is left, spread over the
cluster by digest.  The way back hands the winner from each merged run to the
``fan_in`` runs it came from, so no key ever joins more than ``fan_in`` rows
above the leaves, and in a leaf no more than one partition's rows: a text that
a third of all rows share is no hot key in either direction.

The key of a text is its SHA-256 digest together with the length and a second,
independent hash of the normalised text: rows merge only where all three
agree, which is checked anew at every level.

Defined results: a null text counts as empty, and all empty texts are equal.
A null id sorts after every other id.  Rows that repeat an id are rows of
their own: they count in ``group_size`` and exactly one row of a group is
kept.  An empty table gives an empty result.  Columns other than id and text
are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, hex_lower, stored, text_of

KEY = ["digest", "norm_len", "check"]
FAN_IN = 16
# monotonically_increasing_id keeps the partition number above this bit
_PARTITION_BIT = 33


def _best(columns) -> F.Column:
    return F.min(columns).alias("best")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     fan_in: int = FAN_IN) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``keep_id``, ``group_size``,
    ``kept``, ``text_sha256``.  Of equal texts (white space aside) the one with
    the most code points stays, then the smallest id."""
    bits = max(1, fan_in.bit_length() - 1)
    text = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    norm = text.select("doc_id", F.length("text").alias("len"),
                       F.regexp_replace("text", SPACE + "+", "").alias("norm"))
    rows = stored(norm.select(
        "doc_id", F.monotonically_increasing_id().alias("row_id"), "len",
        F.unhex(F.sha2("norm", 256)).alias("digest"), F.length("norm").alias("norm_len"),
        F.xxhash64("norm").alias("check")), "digests")
    rows = rows.withColumn("run", F.shiftright("row_id", _PARTITION_BIT))
    last = rows.agg(F.max("run")).first()[0] or 0

    order = F.struct((-F.col("len")).alias("neg_len"), F.col("doc_id").isNull().alias("no_id"),
                     F.col("doc_id").alias("doc_id"), F.col("row_id").alias("row_id"))
    level = stored(rows.groupBy("run", *KEY).agg(_best(order), F.count(F.lit(1)).alias("n")), "runs")
    levels = [level]
    while last > 0:
        last >>= bits
        merged = (level.withColumn("run", F.shiftright("run", bits))
                  .groupBy("run", *KEY).agg(_best(F.col("best")), F.sum("n").alias("n")))
        level = stored(merged, "runs")
        levels.append(level)

    won = levels.pop()
    while levels:
        below = levels.pop().select("run", *KEY, F.shiftright("run", bits).alias("up"))
        won = (below.join(won.withColumnRenamed("run", "up"), ["up", *KEY])
               .select("run", *KEY, "best", "n"))
    return rows.join(won, ["run", *KEY]).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("row_id") == F.col("best.row_id")).alias("kept"),
        hex_lower(F.col("digest")).alias("text_sha256"))
