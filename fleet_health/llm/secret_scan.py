"""Secret scans with an incremental blob ledger (built-in functions only).

Every version of every file (here: every row's text) is a blob, addressed by
the SHA-256 of its text.  The ledger is a Parquet table in the shared folder
with a row for each (blob, rule at its version) that has been scanned and the
spans found.  A scan takes the versions' distinct blobs, leaves out the pairs
that the ledger holds, runs only the rules that are new to a blob, appends, and
joins the findings back to all paths.  A ledger opened again at its path, also by
another session, goes on where it stopped.  A new rule version is a new key, so it
alone is run over old blobs.

Positions are in code points, the end exclusive.  They follow from the text
between the matches (``split``) and the matches (``regexp_extract_all``): both
walk the leftmost non-overlapping matches.  The two run only on texts in which
the rule's pattern occurs.

Defined results: a null text counts as empty and has no spans.  Repeated rows
and null ids are paths of their own.  An empty table gives an empty result.
Columns other than id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hex_lower, stored, text_of, work_dir


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched leftmost and without overlaps; a match stays if
    its ``group`` has at least ``min_chars`` code points.  ``sieve`` is a
    pattern that each text with such a match contains."""

    kind: str
    version: int
    pattern: str
    group: int
    min_chars: int
    sieve: str
    base: bool = True

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


def either_case(words: str) -> str:
    """The letters of a pattern in either case (ASCII only, in every engine)."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isascii() and c.isalpha() else c for c in words)


_NAMES = either_case("(password|passwd|secret|token|api_?key)")
_ASSIGN = _NAMES + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# fixed values: kinds in their listed order, then the rules added to them
RULES = (
    Rule("assign", 1, _ASSIGN, 2, 12, _ASSIGN.replace("]+)", "]{12,})")),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18, r"AKIA[A-Z0-9]{14}"),
    Rule("hex", 1, r"[0-9a-f]{16,}", 0, 16, r"[0-9a-f]{16}"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", False),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1, r"gh[pousr]_[A-Za-z0-9]{36}", False),
)
FOUND_TYPE = "array<struct<pre:int,len:int,hit:boolean>>"


def _found(text: Column, rule: Rule) -> Column:
    """For each match: code points since the match before, its length, and
    whether it stays; empty where the sieve finds nothing."""
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    pieces = F.split(text, rule.pattern, -1)
    z = F.transform(F.arrays_zip(matches.alias("m"), groups.alias("g"), F.slice(pieces, 1, F.size(matches)).alias("p")),
                    lambda x: F.struct(F.length(x["p"]).alias("pre"), F.length(x["m"]).alias("len"),
                                       (F.length(x["g"]) >= rule.min_chars).alias("hit")))
    return F.when(text.rlike(rule.sieve), z).otherwise(F.array().cast(FOUND_TYPE))


def _spans(found: DataFrame) -> DataFrame:
    """(blob, rule, found) to (blob, rule, start, end), matches that stay only."""
    m = found.filter(F.size("found") > 0).select("blob", "rule", F.posexplode("found").alias("i", "f"))
    w = Window.partitionBy("blob", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum((F.col("f.pre") + F.col("f.len")).cast("long")).over(w)
    return (m.withColumn("end", end).filter("f.hit")
            .select("blob", "rule", (F.col("end") - F.col("f.len")).alias("start"), "end"))


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


class Ledger:
    """``seen`` (blob, rule) and ``spans`` (blob, rule, start, end), one
    subfolder of each per scan.  Opening a path goes on after the scans committed
    there.  A scan whose driver fails before the end of ``append`` has no finished
    ``seen``, counts for nothing and is simply done again.  Scans of one path are
    made one after the other."""

    def __init__(self, spark, path: str | None = None):
        self.spark, self.path = spark, path or work_dir(spark, "ledger")
        self.committed = self._committed()

    @property
    def scans(self) -> int:
        """The number of the next scan."""
        return max(self.committed, default=-1) + 1

    def _committed(self) -> list[int]:
        """Numbers of the scans at the path whose ``seen`` is finished, by Spark's file system."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in fs.listStatus(root)] if fs.exists(root) else []
        numbers = [int(n[5:]) for n in names if n.startswith("scan=") and n[5:].isdigit()]
        return sorted(i for i in numbers if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/scan={i}/seen/_SUCCESS")))

    def _all(self, what: str, schema: str) -> DataFrame:
        parts = [f"{self.path}/scan={i}/{what}" for i in self.committed]
        return self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)

    def seen(self) -> DataFrame:
        return self._all("seen", "blob binary, rule string")

    def spans(self) -> DataFrame:
        return self._all("spans", "blob binary, rule string, start bigint, end bigint")

    def append(self, scanned: DataFrame) -> None:
        """``scanned``: blob, rule, found."""
        self.committed = self._committed()
        at = f"{self.path}/scan={self.scans}"
        stored(_spans(scanned), "spans", f"{at}/spans")
        stored(scanned.select("blob", "rule"), "seen", f"{at}/seen")
        self.committed.append(self.scans)


def scan(versions: DataFrame, ledger: Ledger, rules=RULES) -> DataFrame:
    """Scan what the ledger has not seen of ``versions`` (``path``, ``text``);
    returns the versions' paths and blobs (``path``, ``blob``)."""
    v = versions.select("path", text_of("text").alias("text")).withColumn("blob", blob_of(F.col("text")))
    paths = stored(v.select("path", "blob"), "paths")
    keys = [r.key for r in rules]
    todo_of = F.array(*[F.lit(k) for k in keys])
    if ledger.scans:
        had = ledger.seen().filter(F.col("rule").isin(keys)).groupBy("blob").agg(F.collect_set("rule").alias("had"))
        fresh = (paths.select("blob").distinct().join(had, "blob", "left")
                 .select("blob", F.array_except(todo_of, F.coalesce("had", F.array().cast("array<string>"))).alias("todo"))
                 .filter(F.size("todo") > 0))
        v = v.join(fresh, "blob")
    else:
        v = v.withColumn("todo", todo_of)
    # one text of each blob: copies meet in the partial aggregate
    blobs = v.groupBy("blob").agg(F.first("text").alias("text"), F.first("todo").alias("todo"))
    found = blobs.select("blob", F.explode(F.array(*[
        F.when(F.array_contains("todo", r.key), F.struct(F.lit(r.key).alias("rule"), _found(F.col("text"), r).alias("found")))
        for r in rules])).alias("x")).filter("x is not null").select("blob", "x.rule", "x.found")
    ledger.append(stored(found, "found"))
    return paths


def findings(paths: DataFrame, ledger: Ledger, rules=RULES) -> DataFrame:
    """One row per path: ``path``, ``found``: array of (start, kind_no, kind,
    end) of all its spans, by start and then kind as listed."""
    named = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.key), F.struct(
        F.lit(i).alias("no"), F.lit(r.kind).alias("kind"), F.lit(r.base).alias("base")))])
    s = ledger.spans().withColumn("r", named[F.col("rule")]).filter("r is not null")
    per = s.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct(
        "start", F.col("r.no").alias("no"), "end", F.col("r.kind").alias("kind"), F.col("r.base").alias("base")))).alias("found"))
    empty = F.array().cast(per.schema["found"].dataType)
    return paths.join(per, "blob", "left").select("path", "blob", F.coalesce("found", empty).alias("found"))


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan_digest(docs: DataFrame, rules=RULES, ledger: Ledger | None = None, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """Per document: ``doc_id``, number of spans of each base kind,
    ``base_sha256`` over the base spans, and ``spans``, all spans as text."""
    ledger = ledger or Ledger(docs.sparkSession)
    paths = scan(docs.select(F.col(id_col).alias("path"), F.col(text_col).alias("text")), ledger, rules)
    f = findings(paths, ledger, rules)
    base = F.filter("found", lambda x: x["base"])
    of = lambda kind: F.filter("found", lambda x: x["kind"] == kind)
    counts = [F.size(of(r.kind)).cast("long").alias(f"n_{r.kind}") for r in rules if r.base]
    return f.select(F.col("path").alias("doc_id"), *counts, F.sha2(joined(base), 256).alias("base_sha256"),
                    joined(F.col("found")).alias("spans"))
