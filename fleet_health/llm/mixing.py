"""Mixing sources to target weights by Sainte-Lague apportionment (built-in functions only).

1. One pass counts each row's words; the small table (id, source, size) is
   stored and everything else works on it.
2. Targets: sources in code point order (null last) weigh 5, 2, 1, repeating,
   and share all words.  A target stops at ``max_epochs`` times its source's
   size; the excess is shared again by weight.  The sources are sorted by the
   level at which they stop, so one pass of running sums finds the final level.
3. Quotas: the mix has ``round(total / block_words)`` blocks of equal size,
   dealt over ``shards`` output shards.  For each shard's end the divisor
   method gives every source its integer number of blocks among the first m:
   all blocks whose quotient target / (2j - 1) is surely high enough are counted
   by division, and the few that are left (at most two a source) are ranked by
   quotient.  The method is house-monotone, so differences of neighbouring ends
   are the shards' quotas.
4. Selection: a source's rows stand in a seeded order and its words form one
   line.  The quota's words are dealt as whole passes over the line and then a
   cyclic run of blocks from a seeded start, so rows stay whole except where the
   run begins or ends.  The positions are exact running sums: the rows of a
   source are counted in hash buckets of bounded size first, so a source with a
   third of all rows is never sorted in one task.

Defined results: a null text has size 0.  Rows of size 0 are never taken.  A
null source is a source of its own and comes last.  Repeated rows are rows of
their own.  An empty table gives an empty result.  Columns other than id,
source and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Masked, stored, text_of

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BLOCK_WORDS = 16
SHARDS = 8
SEED = "mix-1"
SPACED_WORD = r"[\x20\x09-\x0D]*" + WORD
# rows of one source that one task sorts, on average
BUCKET_ROWS = 5_000


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: ``source``, ``rank``, ``source_size``, ``n_rows``,
    ``target``.  ``sizes`` has ``source`` and ``size``.  The windows run over
    one row per source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("rank", F.row_number().over(by_name))
    w = F.element_at(F.array(*[F.lit(x).cast("long") for x in weights]),
                     (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", w).withColumn("cap", F.col("source_size") * max_epochs)
    everything = Window.partitionBy(F.lit(0))
    before = (Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), "rank")
              .rowsBetween(Window.unboundedPreceding, -1))
    per = (per.withColumn("total", F.sum("source_size").over(everything))
           .withColumn("weights", F.sum("weight").over(everything))
           .withColumn("caps_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
           .withColumn("weights_before", F.coalesce(F.sum("weight").over(before), F.lit(0))))
    stops = (F.col("cap") * (F.col("weights") - F.col("weights_before"))
             <= F.col("weight") * (F.col("total") - F.col("caps_before")))
    per = per.withColumn("stops", stops)
    open_words = F.col("total") - F.sum(F.when(F.col("stops"), F.col("cap")).otherwise(F.lit(0))).over(everything)
    open_weight = F.sum(F.when(F.col("stops"), F.lit(0)).otherwise(F.col("weight"))).over(everything)
    target = F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(
        (F.col("weight") * open_words).cast("double") / open_weight.cast("double"))
    return per.withColumn("target", target).select("source", "rank", "source_size", "n_rows", "total", "target")


def shard_quotas(targets: DataFrame, block_words: int = BLOCK_WORDS, shards: int = SHARDS,
                 max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source``, ``rank``, ``shard`` (0-based), ``start``, ``end``: the
    source's blocks number ``start`` .. ``end - 1`` go to the shard."""
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    t = (targets.withColumn("n_sources", n)
         .withColumn("blocks", F.round(F.col("total") / F.lit(block_words)).cast("long"))
         .select("*", F.explode(F.sequence(F.lit(1), F.lit(shards))).alias("k"))
         .withColumn("m", F.floor(F.col("blocks") * F.col("k") / F.lit(shards)).cast("long")))
    # a divisor under which no more than m blocks are given, and one under which no fewer are
    seats = lambda m: F.floor(F.col("target") * m / F.col("total") + 0.5).cast("long")
    low = F.when(F.col("m") > F.col("n_sources"), seats(F.col("m") - F.col("n_sources"))).otherwise(F.lit(0).cast("long"))
    high = seats(F.col("m") + F.col("n_sources")) + 1
    t = (t.withColumn("low", F.when(F.col("total") > 0, low).otherwise(F.lit(0).cast("long")))
         .withColumn("high", F.when(F.col("total") > 0, high).otherwise(F.lit(0).cast("long")))
         .withColumn("left", F.col("m") - F.sum("low").over(Window.partitionBy("k"))))
    tried = (t.filter((F.col("high") > F.col("low")) & (F.col("target") > 0))
             .select("rank", "k", "left", "target", F.explode(F.sequence(F.col("low") + 1, F.col("high"))).alias("j"))
             .withColumn("place", F.row_number().over(
                 Window.partitionBy("k").orderBy((F.col("target") / (2 * F.col("j") - 1)).desc(), "rank", "j")))
             .filter(F.col("place") <= F.col("left"))
             .groupBy("rank", "k").agg(F.count(F.lit(1)).alias("more")))
    line = F.ceil(F.col("source_size") / F.lit(block_words)).cast("long")
    cum = (t.join(tried, ["rank", "k"], "left")
           .withColumn("end", F.least(F.col("low") + F.coalesce("more", F.lit(0)), line * max_epochs)))
    prev = F.lag("end", 1, 0).over(Window.partitionBy("rank").orderBy("k"))
    return (cum.withColumn("start", prev)
            .select("source", "rank", (F.col("k") - 1).alias("shard"), F.col("start").cast("long"), F.col("end").cast("long")))


def _source_rank(targets: DataFrame) -> DataFrame:
    return targets.select(F.col("source").alias("_s"), "rank", "source_size", "target", "n_rows")


def positions(sizes: DataFrame, targets: DataFrame, seed: str = SEED, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds ``rank``, ``source_size``, ``target`` and ``at``: the words of the
    same source before this row in the seeded order.  A hash prefix splits each
    source into buckets of about ``bucket_rows`` rows; the order follows the
    hash, so bucket totals give exact offsets."""
    key = F.sha2(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256)
    r = sizes.join(_source_rank(targets), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    r = r.withColumn("key", key)
    # 28 bits of the hash, scaled to the number of buckets of the source
    head = F.conv(F.substring("key", 1, 7), 16, 10).cast("long")
    buckets = F.floor(F.col("n_rows") / F.lit(bucket_rows)).cast("long") + 1
    r = r.withColumn("bucket", F.floor(head * buckets / F.lit(1 << 28)).cast("long"))
    held = r.groupBy("rank", "bucket").agg(F.sum("size").alias("words"))
    offsets = held.select("rank", "bucket", F.coalesce(F.sum("words").over(
        Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    inside = (Window.partitionBy("rank", "bucket").orderBy("key", "doc_id", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    return (r.join(offsets, ["rank", "bucket"])
            .withColumn("at", F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
            .drop("bucket", "offset", "key", "n_rows"))


def plan_mix(sizes: DataFrame, block_words: int = BLOCK_WORDS, shards: int = SHARDS,
             max_epochs: int = MAX_EPOCHS, seed: str = SEED, weights=WEIGHTS) -> DataFrame:
    """``sizes`` (``doc_id``, ``source``, ``size`` and more columns) with
    ``source_size``, ``target``, ``whole`` (times the whole row is taken),
    ``pieces`` (array of (start, words): further parts of the row taken) and
    ``taken`` (all words taken)."""
    targets = stored(source_targets(sizes, weights, max_epochs), "targets")
    quotas = stored(shard_quotas(targets, block_words, shards, max_epochs), "quotas")
    seeded = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), F.lit("start"), F.coalesce("source", F.lit("null"))), 256), 1, 12),
                    16, 10).cast("long")
    line = F.ceil(F.col("source_size") / F.lit(block_words)).cast("long")
    some = F.col("source_size") > 0
    zero = F.lit(0).cast("long")
    total = (quotas.groupBy("rank").agg(F.max("end").alias("quota")).join(targets.select("rank", "source_size", "source"), "rank")
             .withColumn("words", F.least(F.col("quota") * block_words, F.col("source_size") * max_epochs))
             .withColumn("passes", F.when(some, F.floor(F.col("words") / F.col("source_size"))).otherwise(zero).cast("long"))
             .withColumn("lo", F.when(some, F.pmod(seeded, line) * block_words).otherwise(zero))
             .select("rank", "passes", "lo", (F.col("lo") + F.col("words") - F.col("passes") * F.col("source_size")).alias("hi"),
                     F.col("source_size").alias("turn")))
    r = positions(sizes, targets, seed).join(total, "rank")
    end = F.col("at") + F.col("size")
    # the cyclic run [lo, hi), and the same run one turn earlier
    a1, b1 = F.greatest("lo", "at"), F.least(F.col("hi"), end)
    a2, b2 = F.greatest(F.col("lo") - F.col("turn"), F.col("at")), F.least(F.col("hi") - F.col("turn"), end)
    piece = lambda a, b: F.when(b > a, F.struct((a - F.col("at")).alias("start"), (b - a).alias("words")))
    r = (r.withColumn("pieces", F.filter(F.array(piece(a1, b1), piece(a2, b2)), lambda x: x.isNotNull()))
         .withColumn("whole", F.when(F.col("size") > 0, F.col("passes")).otherwise(F.lit(0).cast("long"))))
    got = F.aggregate("pieces", F.lit(0).cast("long"), lambda s, x: s + x["words"])
    return r.withColumn("taken", F.col("whole") * F.col("size") + got).drop("rank", "passes", "lo", "hi", "turn", "at")


def word_count(col: str = "text") -> Column:
    return F.regexp_count(text_of(col), F.lit(WORD)).cast("long")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                **params) -> DataFrame:
    """The mix's share of every row: ``doc_id``, ``source``, ``size``,
    ``source_size``, ``target``, ``taken``, ``whole``, ``pieces``."""
    sizes = stored(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                               word_count(text_col).alias("size")), "sizes")
    return plan_mix(sizes, **params)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    source_col: str = "source", **params) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each time a
    document is taken whole, and one for each further part of it, whose text
    holds just the words taken (white space before a word goes with it)."""
    m = Masked(docs)
    text_ = m.of(text_col)
    base = stored(m.df.withColumn("row", F.monotonically_increasing_id()), "mix_input")
    sizes = stored(base.select(F.col(m.of(id_col)).alias("doc_id"), F.col(m.of(source_col)).alias("source"),
                               word_count(text_).alias("size"), "row"), "sizes")
    plan = plan_mix(sizes, **params).filter("taken > 0").select("row", "size", "whole", "pieces")
    whole = F.transform(F.sequence(F.lit(1).cast("long"), F.col("whole")),
                        lambda _: F.struct(F.lit(0).cast("long").alias("start"), F.col("size").alias("words")))
    parts = F.concat(F.when(F.col("whole") > 0, whole).otherwise(F.array().cast("array<struct<start:bigint,words:bigint>>")),
                     F.col("pieces"))
    out = base.join(plan, "row").select("*", F.explode(parts).alias("part"))
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col(text_), F.lit(SPACED_WORD), F.lit(0)),
                               (F.col("part.start") + 1).cast("int"), F.col("part.words").cast("int")), "")
    out = out.withColumn(text_, F.when(F.col("part.words") == F.col("size"), F.col(text_)).otherwise(cut))
    return m.back(m.with_length(out))
