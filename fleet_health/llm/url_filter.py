"""URL rules by a sort-merge range join (built-in functions only).

A host is written backwards by labels, each label ended by a separator
("org" + sep + "example" + sep), so that a host rule and all its subdomains are
one interval of keys, and intervals are nested or disjoint.  Below a rule's
host its path prefixes are intervals in the same way.  ``sweep`` joins points
to such intervals: intervals and points are sorted together over range
partitions, and a running window keeps the stack of open intervals, one slot
for each nesting depth.  The last interval of a depth that began at or before
a point is the only one of that depth that can still be open there, so a slot
per depth is the whole stack; what is open where a partition begins comes from
a summary of one row per partition.

The first sweep runs over the distinct hosts, the second over the distinct
(rule host, path) pairs of hosts that have rules, so a host with a third of
all rows is one point of the first sweep.  Joining back is a plain equi-join.

Defined results: a null url, or one without "://", has an empty host and path
and fits no rule.  Of the rules that fit, the one with the longest host + path
wins, then the one with the longer host, then the first by code points; where
allow and block rules repeat the same host and path, block wins.  Rules with a
null or empty host are ignored; a null path counts as empty.  Hosts of rules
are lower-cased.  Repeated rows stay repeated, an empty table gives an empty
result, and columns other than id and url are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

# sorts before every character that a host or path may hold
SEP = "\x01"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DEFAULT_VERDICT = "allow"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), SEP), F.lit(SEP))


def sweep(points: DataFrame, intervals: DataFrame, depths: int) -> DataFrame:
    """``points`` (distinct ``key``) with ``stack``: the keys of the intervals
    (distinct ``key``, ``depth`` 1 .. ``depths``) that are open there, that is
    all that are a prefix of the point's key."""
    events = (intervals.select("key", F.col("depth").cast("int"), F.lit(False).alias("point"))
              .unionByName(points.select("key", F.lit(0).alias("depth"), F.lit(True).alias("point"))))
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = stored(events.repartitionByRange(parts, "key").withColumn("chunk", F.spark_partition_id()), "sweep")
    slots = [f"s{d}" for d in range(1, depths + 1)]
    at = lambda d: F.when(F.col("depth") == d, F.col("key"))
    ends = chunks.groupBy("chunk").agg(*[F.max(at(d)).alias(f"s{d}") for d in range(1, depths + 1)])
    # one row per range partition
    before = Window.partitionBy(F.lit(0)).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select("chunk", *[F.max(s).over(before).alias("c" + s) for s in slots])
    run = Window.partitionBy("chunk").orderBy("key", "point").rowsBetween(Window.unboundedPreceding, 0)
    seen = (chunks.join(F.broadcast(carry), "chunk")
            .select("key", "point", *[F.coalesce(F.last(at(d), ignorenulls=True).over(run), F.col(f"cs{d}")).alias(f"s{d}")
                                      for d in range(1, depths + 1)])
            .filter("point"))
    is_open = lambda s: F.col(s).isNotNull() & F.col("key").startswith(F.col(s))
    return seen.select("key", F.filter(F.array(*[F.when(is_open(s), F.col(s)) for s in slots]),
                                       lambda x: x.isNotNull()).alias("stack"))


def _ruled(rules: DataFrame) -> DataFrame:
    r = rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    return (r.filter("host is not null and host != ''").groupBy("host", "path")
            .agg(F.max("verdict").alias("verdict"))  # "block" sorts after "allow"
            .withColumn("host_key", host_key(F.col("host")))
            .withColumn("key", F.concat("host_key", F.lit(SEP + "/"), "path")))


def _host_intervals(rules: DataFrame) -> DataFrame:
    return rules.select(F.col("host_key").alias("key"), (F.size(F.split("host", r"\.", -1))).alias("depth")).distinct()


def _path_intervals(rules: DataFrame) -> DataFrame:
    """Depth of a path rule: how many path rules of the same host it begins
    with, itself included; found by its prefixes of the lengths that occur."""
    lengths = rules.groupBy("host_key").agg(F.collect_set(F.length("path")).alias("lengths"))
    own = rules.select("host_key", "path", "key").join(lengths, "host_key")
    prefix = own.select("key", "host_key", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n"), "path")
    prefix = prefix.select("key", "host_key", F.substring("path", F.lit(1), F.col("n")).alias("path"))
    hit = prefix.join(rules.select("host_key", "path"), ["host_key", "path"])
    return hit.groupBy("key").agg(F.count(F.lit(1)).alias("depth"))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
               default: str = DEFAULT_VERDICT) -> DataFrame:
    """One row per row of ``pages``: ``page_id``, ``host``, ``path``, ``rule``
    (host + path of the rule that wins, else null), ``verdict``.  ``rules``
    has ``host``, ``path``, ``verdict`` (allow or block)."""
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"),
                        path_of(F.col(url_col)).alias("path"))
    ruled = stored(_ruled(rules), "rules")
    hosts, paths = stored(_host_intervals(ruled), "host_rules"), stored(_path_intervals(ruled), "path_rules")
    depth = hosts.agg(F.max("depth")).first()[0]
    if depth is None:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    path_depth = paths.agg(F.max("depth")).first()[0]

    points = rows.filter("host != ''").select("host").distinct().withColumn("key", host_key(F.col("host")))
    points = stored(points, "hosts")
    stacks = sweep(points.select("key").distinct(), hosts, depth).filter(F.size("stack") > 0)
    host_rules = points.join(stacks, "key").select("host", F.explode("stack").alias("host_key"))

    places = rows.select("host", "path").filter("host != ''").distinct()
    tried = stored(places.join(host_rules, "host").withColumn("key", F.concat("host_key", F.lit(SEP + "/"), "path")), "tried")
    found = sweep(tried.select("key").distinct(), paths, path_depth).filter(F.size("stack") > 0)
    found = found.select("key", F.element_at("stack", -1).alias("rule_key"))
    named = ruled.select(F.col("key").alias("rule_key"), F.col("host").alias("rule_host"),
                         F.concat("host", "path").alias("rule"), "verdict")
    fits = tried.join(found, "key").join(named, "rule_key")
    # labels may hold any character: the exact rule
    fits = fits.filter((F.col("host") == F.col("rule_host")) | F.col("host").endswith(F.concat(F.lit("."), F.col("rule_host"))))
    order = F.struct((-F.length("rule")).alias("a"), (-F.length("rule_host")).alias("b"), F.col("rule").alias("rule"),
                     F.col("verdict").alias("verdict"))
    best = fits.groupBy("host", "path").agg(F.min(order).alias("best"))
    return (rows.join(best, ["host", "path"], "left")
            .select("page_id", "host", "path", F.col("best.rule").alias("rule"),
                    F.coalesce("best.verdict", F.lit(default)).alias("verdict")))


def rules_frame(spark, rules) -> DataFrame:
    """A rules table from (verdict, host, path) triples, without Python on the executors."""
    one = [F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules]
    if not one:
        return spark.range(0).select(*[F.lit("").alias(c) for c in ("verdict", "host", "path")])
    return spark.range(1).select(F.inline(reduce(F.concat, [F.array(x) for x in one])))
