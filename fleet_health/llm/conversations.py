"""Repair of conversation structure by divide and conquer over cost vectors.

A conversation's rows are to become ``(s?(ua)+)?`` by the cheapest edits.  Four
states say what came last (nothing, system, user, assistant); a row is kept,
given another role or deleted, and empty rows may be inserted before it.  As
the state fixes the role of every inserted or re-roled row, the string of edit
initials (the audit) fixes the repair.

The method is Hirschberg's: forward costs from the start state and backward
costs from the end meet in the middle, the cheapest crossing state is chosen,
and both halves are worked off in turn, so only vectors of four numbers are
held and never a table.  Ties go to the least audit: the forward vector also
holds the order of the four least audits.  A crossing lies just behind a row's
own edit, so audits that reach it have the same number of row edits and none
begins another; adding edits keeps their order, and the order of the four is
enough.

On Spark the same step is taken over chunks.  The damaged rows are
range-partitioned by (conversation, turn, role, text), so a conversation of any
length is spread over tasks, and cut into chunks of at most ``CHUNK_ROWS`` rows.
A chunk's 4 x 4 costs and orders are its vectors for each start state; folding
them backward and forward gives every chunk its start and end state, and each
chunk then rebuilds its own part.  Rows that are equal in all columns are
counted before the shuffle and dealt out again inside the chunks.  What one task
holds of a conversation is a small summary per chunk; only its digest, which
SHA-256 defines one after the other, streams through one task.

Defined results: a null role or text is one space, and so is a null id or turn
in the damage key.  Rows of a conversation are taken by turn (nulls first), then
role and text, so equal rows stand side by side.  Rows of the null id are one
conversation.  A role is read by its first character; an empty one cannot be
kept.  An empty table gives an empty result.  Columns other than the four are
not read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, stored

CHUNK_ROWS = 2048
CHUNK_CHARS = 4 << 20
# fixed values: the costs of the edits
RE_ROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
INF = 1 << 60
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = {START: "su", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
STATE = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
ROLE = {USER: "user", ASSISTANT: "assistant"}
FORCED = "d"  # class of a row that has to go; of others: its initial (x: none of the three), upper case where truncated


def _inserted(state: int) -> int:
    """The state behind an inserted or re-roled row."""
    return ASSISTANT if state == USER else USER


# from each state the cheapest ending and its edits
TAIL = {START: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}


@lru_cache(maxsize=None)
def _steps(kind: str) -> tuple:
    """All (from, to, cost, edits) of a row of class ``kind``: inserts, then its own edit."""
    late = TRUNCATED if kind.isupper() else 0
    steps = {}
    for p in range(4):
        state, edits, cost = p, "", 0
        for _ in range(3):  # a third insert only leads back
            ends = [(state, "D", DELETE)]
            if kind != FORCED:
                ends.append((_inserted(state), "R", RE_ROLE + late))
                if kind.lower() in FOLLOWS[state]:
                    ends.append((STATE[kind.lower()], "K", late))
            for q, e, c in ends:
                steps[p, q] = min(steps.get((p, q), (INF, "")), (cost + c, edits + e))
            state, edits, cost = _inserted(state), edits + "I", cost + INSERT
    return tuple((p, q, c, e) for (p, q), (c, e) in sorted(steps.items()))


def forward(kinds: str, start: int) -> tuple[list, list]:
    """Least cost of reaching each state behind the rows, and the order of the
    least audits that do."""
    cost = [INF] * 4
    cost[start] = 0
    order = [0] * 4
    for kind in kinds:
        best: list = [(INF, 0, "")] * 4
        for p, q, c, e in _steps(kind):
            if cost[p] < INF:
                best[q] = min(best[q], (cost[p] + c, order[p], e))
        place = {k: i for i, k in enumerate(sorted({b[1:] for b in best if b[0] < INF}))}
        cost = [b[0] for b in best]
        order = [place.get(b[1:], 4) for b in best]
    return cost, order


def backward(kinds: str, end: list) -> list:
    """Least cost from each state before the rows, ``end`` being the cost behind them."""
    for kind in reversed(kinds):
        before = [INF] * 4
        for p, q, c, _ in _steps(kind):
            before[p] = min(before[p], c + end[q])
        end = before
    return end


def cross(cost: list, order: list, rest: list) -> int:
    """The state of the cheapest crossing, of equal ones that of the least audit."""
    return min((c + r, o, q) for q, (c, o, r) in enumerate(zip(cost, order, rest)))[2]


def _only(q: int) -> list:
    return [0 if i == q else INF for i in range(4)]


def _rebuild(kinds: str, start: int, end: int) -> str:
    if len(kinds) == 1:
        return next(e for p, q, _, e in _steps(kinds) if (p, q) == (start, end))
    mid = len(kinds) // 2
    q = cross(*forward(kinds[:mid], start), backward(kinds[mid:], _only(end)))
    return _rebuild(kinds[:mid], start, q) + _rebuild(kinds[mid:], q, end)


@lru_cache(maxsize=1 << 14)
def rebuild(kinds: str, start: int, end: int) -> str:
    """The least of the cheapest audits from ``start`` to ``end``."""
    return _rebuild(kinds, start, end) if kinds else ""


@lru_cache(maxsize=1 << 14)
def _vectors(kinds: str) -> tuple[tuple, tuple]:
    """Costs and orders from each start state, one after the other."""
    both = [forward(kinds, p) for p in range(4)]
    return tuple(c for f, _ in both for c in f), tuple(o for _, r in both for o in r)


def repaired(audit: str, start: int, roles: list, texts: list) -> list[str]:
    """``role:text`` of the rows that an audit leaves."""
    out, state, i = [], start, 0
    for e in audit:
        if e == "I":
            state = _inserted(state)
            out.append(ROLE[state] + ":")
            continue
        if e == "K":
            state = STATE[roles[i][0]]
            out.append(f"{roles[i]}:{texts[i]}")
        elif e == "R":
            state = _inserted(state)
            out.append(f"{ROLE[state]}:{texts[i]}")
        i += 1
    return out


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` after the damage that the key's CRC asks for."""
    d = rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"),
                    F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
                    F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    d = d.withColumn("_way", F.crc32(key.cast("binary")) % 20).filter("_way != 0")
    text = F.when(F.col("_way") == 1, F.lit("")).when(F.col("_way") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return d.select("conv_id", "turn", F.when(F.col("_way") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                    text.alias("text"), F.when(F.col("_way") == 3, F.lit(2)).otherwise(F.lit(1)).alias("copies"))


def _key(conv):
    """The id as a text that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit(""))


def marked(rows: DataFrame) -> DataFrame:
    """Equal rows counted (``copies``), with ``blank``, ``first`` (no earlier row
    of the conversation has the same role and text) and ``late`` (truncated)."""
    each = rows.groupBy(_key("conv_id").alias("ck"), "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    said = F.unhex(F.sha2(F.concat(F.length("ck"), F.lit(":"), "ck", F.length("role"), F.lit(":"), "role", "text"), 256))
    each = stored(each.withColumn("said", said), "conversation_rows")
    again = each.groupBy("said").agg(F.sum("copies").alias("n"), F.min("turn").alias("first_turn"),
                                     F.max(F.col("turn").isNull()).alias("from_null")).filter("n > 1")
    again = stored(again.drop("n"), "said_again")
    j = each.join(again, "said", "left")
    first = (F.col("from_null").isNull() | (F.col("from_null") & F.col("turn").isNull())
             | (~F.col("from_null") & F.col("turn").eqNullSafe(F.col("first_turn"))))
    bare = F.btrim(F.col("text"), F.lit(SPACE_CHARS))
    return j.select("ck", "turn", "role", "text", "copies", (bare == "").alias("blank"), first.alias("first"),
                    (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("late"))


_CHUNK = ("ck string, part int, no int, kinds string, roles array<string>, texts array<string>, rows bigint, blank bigint, "
          "duplicate bigint, truncated bigint, illegal bigint, head string, tail string, cost array<bigint>, ranks array<int>")
LEGAL = {"su", "ua", "au"}


class _Chunk:
    def __init__(self, ck, no):
        self.ck, self.no, self.kinds, self.roles, self.texts = ck, no, [], [], []
        self.blank = self.duplicate = self.truncated = self.chars = 0

    def add(self, role, text, blank, first, late):
        forced = blank or not first
        if blank:
            self.blank += 1
        elif not first:
            self.duplicate += 1
        elif late:
            self.truncated += 1
        c = role[:1]
        kind = c if c in STATE else "x"
        self.kinds.append(FORCED if forced else kind.upper() if late else kind)
        self.roles.append(role)
        # a row that has to go leaves no text
        self.texts.append("" if forced else text)
        self.chars += len(self.texts[-1]) + len(role) + 16

    def full(self, rows):
        return len(self.kinds) >= rows or self.chars >= CHUNK_CHARS

    def row(self, part):
        kinds = "".join(self.kinds)
        heads = [r[:1] for r in self.roles]
        illegal = sum(a + b not in LEGAL for a, b in zip(heads, heads[1:]))
        cost, ranks = _vectors(kinds)
        return (self.ck, part, self.no, kinds, self.roles, self.texts, len(kinds), self.blank, self.duplicate, self.truncated,
                illegal, heads[0], heads[-1], list(cost), list(ranks))


def _batch(rows, schema):
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def _chunks(schema, chunk_rows: int):
    def fn(batches):
        part, out, size, now = TaskContext.get().partitionId(), [], 0, None
        for b in batches:
            for ck, role, text, copies, blank, first, late in zip(*(c.to_pylist() for c in b.columns)):
                for i in range(copies):
                    if now is not None and (now.ck != ck or now.full(chunk_rows)):
                        out.append(now.row(part))
                        size += now.chars
                        now = _Chunk(ck, now.no + 1)
                    elif now is None:
                        now = _Chunk(ck, 0)
                    now.add(role, text, blank, first and i == 0, late)
                    if size >= CHUNK_CHARS or len(out) >= 4096:
                        yield _batch(out, schema)
                        out, size = [], 0
        if now is not None:
            out.append(now.row(part))
        if out:
            yield _batch(out, schema)
    return fn


_FOLDED = "ck string, cost bigint, border bigint, ways array<struct<part:int,no:int,start:int,end:int,ending:string>>"


def fold(chunks: list) -> tuple[int, list]:
    """(cost, [(start, end)]) of a conversation's chunks, each (cost, ranks) of 4 x 4."""
    rest = [[TAIL[q][0] for q in range(4)]]
    for cost, _ in reversed(chunks):
        rest.append([min(cost[4 * p + q] + rest[-1][q] for q in range(4)) for p in range(4)])
    rest.reverse()
    state, ways = START, []
    for (cost, ranks), after in zip(chunks, rest[1:]):
        q = cross(cost[4 * state:4 * state + 4], ranks[4 * state:4 * state + 4], after)
        ways.append((state, q))
        state = q
    return rest[0][START], ways


def _fold(schema):
    def fn(batches):
        for b in batches:
            rows = []
            for ck, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                cost, ways = fold([(p["cost"], p["ranks"]) for p in parts])
                border = sum(a["tail"] + z["head"] not in LEGAL for a, z in zip(parts, parts[1:]))
                last = len(parts) - 1
                rows.append((ck, cost, border, [
                    {"part": p["part"], "no": p["no"], "start": s, "end": e, "ending": TAIL[e][1] if i == last else ""}
                    for i, (p, (s, e)) in enumerate(zip(parts, ways))]))
            if rows:
                yield _batch(rows, schema)
    return fn


_PARTS = "ck string, part int, no int, audit string, repaired string"


def _parts(schema):
    def fn(batches):
        for b in batches:
            rows = []
            for ck, part, no, kinds, roles, texts, start, end, ending in zip(*(c.to_pylist() for c in b.columns)):
                audit = rebuild(kinds, start, end) + ending
                left = repaired(audit, start, roles, texts)
                rows.append((ck, part, no, audit, "\n".join(left) if left else None))
            if rows:
                yield _batch(rows, schema)
    return fn


def _digests(schema):
    def fn(batches):
        out, ck, digest, any_ = [], None, None, False
        for b in batches:
            for c, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if c != ck:
                    if digest is not None:
                        out.append((ck, digest.hexdigest()))
                    ck, digest, any_ = c, hashlib.sha256(), False
                if text is not None:
                    digest.update((("\n" if any_ else "") + text).encode())
                    any_ = True
                if len(out) >= 4096:
                    yield _batch(out, schema)
                    out = []
        if digest is not None:
            out.append((ck, digest.hexdigest()))
        if out:
            yield _batch(out, schema)
    return fn


def _arrow(df: DataFrame, make, ddl: str, *args) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    return df.mapInArrow(make(to_arrow_schema(df.sparkSession.createDataFrame([], ddl).schema), *args), ddl)


def repair_parts(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``rows`` (``conv_id``, ``turn``, ``role``, ``text``, ``copies``) to
    (chunks, folded, parts): chunk statistics, a row of costs per conversation,
    and the repaired text and audit by (``ck``, ``part``, ``no``)."""
    order = ["ck", "turn", "role", "text"]
    m = marked(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    m = m.select("ck", "role", "text", "copies", "blank", "first", "late")
    chunks = stored(_arrow(m, _chunks, _CHUNK, chunk_rows), "conversation_chunks")
    sums = chunks.groupBy("ck").agg(F.array_sort(F.collect_list(F.struct("part", "no", "cost", "ranks", "head", "tail"))).alias("parts"))
    folded = stored(_arrow(sums, _fold, _FOLDED), "conversation_fold")
    ways = folded.select(F.inline("ways"))
    todo = chunks.join(ways, ["part", "no"]).select("ck", "part", "no", "kinds", "roles", "texts", "start", "end", "ending")
    return chunks, folded, stored(_arrow(todo, _parts, _PARTS), "conversation_parts")


def repair_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                         chunk_rows: int = CHUNK_ROWS, damage: bool = True) -> DataFrame:
    """One row per conversation: ``conv_id``, ``gaps``, ``blank``,
    ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit`` and
    ``repaired_sha256``.  ``damage=False`` repairs the rows as they are."""
    plain = rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"),
                        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))],
                        F.lit(1).alias("copies"))
    hit = damaged(rows, conv, turn, role, text) if damage else plain
    chunks, folded, parts = repair_parts(hit, chunk_rows)
    sums = chunks.groupBy("ck").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")])
    span = hit.select(_key("conv_id").alias("ck"), "turn").groupBy("ck").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    audits = parts.groupBy("ck").agg(F.array_sort(F.collect_list(F.struct("part", "no", "audit"))).alias("a")).select(
        "ck", F.array_join(F.transform("a", lambda x: x["audit"]), "").alias("audit"))
    in_order = parts.repartition("ck").sortWithinPartitions("ck", "part", "no").select("ck", "repaired")
    shas = _arrow(in_order, _digests, "ck string, sha string")
    out = plain.select("conv_id").distinct().withColumn("ck", _key("conv_id"))
    for df in (sums, span, folded.drop("ways"), audits, shas):
        out = out.join(df, "ck", "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select("conv_id", n(F.col("gaps")).alias("gaps"), *[n(F.col(c)).alias(c) for c in ("blank", "duplicate", "truncated")],
                      n(F.col("illegal") + F.col("border")).alias("illegal"), n(F.col("cost")).alias("cost"),
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
