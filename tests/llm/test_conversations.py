"""Conversation repair against a search over whole audits."""
import hashlib
import heapq
import random
import zlib
from itertools import product

import pytest

from fleet_health.llm import conversations as C
from llm_helpers import counted

SPACE = " \t\n\x0b\f\r"
COLS = "conv_id bigint, turn bigint, role string, text string"


def cheapest(rows):
    """rows: (role, text, forced, late).  Best-first over (cost, audit): the first
    full audit taken is the cheapest and least."""
    heap, done = [(0, "", 0, 0, "")], set()
    after = {"": "su", "s": "u", "u": "a", "a": "u"}
    full = {"u": "user", "a": "assistant"}
    while heap:
        cost, audit, i, _, out = heapq.heappop(heap)
        last = out[-1:]
        if (i, last) in done and i < len(rows):
            pass
        if i == len(rows) and last in ("", "a"):
            return cost, audit, out
        if len(audit) > 3 * len(rows) + 3:
            continue
        nxt = "a" if last == "u" else "u"
        steps = [(2, "I", i, nxt)]
        if i < len(rows):
            role, text, forced, late = rows[i]
            steps.append((3, "D", i + 1, ""))
            if not forced:
                steps.append((2 + late, "R", i + 1, nxt))
                if role[:1] and role[0] in after[last]:
                    steps.append((late, "K", i + 1, role[0]))
        for c, e, j, add in steps:
            heapq.heappush(heap, (cost + c, audit + e, j, 0, out + add))
    raise AssertionError


def expected(rows):
    convs, hit = {}, {}
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        convs.setdefault(c, [])
        way = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if way == 0:
            continue
        if way == 1:
            x = ""
        if way == 2:
            x = "".join(ch for ch in x if ch not in ".!?")
        if way == 4:
            r = "user"
        hit.setdefault(c, []).extend([(t, r, x)] * (2 if way == 3 else 1))
    out = []
    for c in convs:
        rows = sorted(hit.get(c, []), key=lambda v: (v[0] is not None, v[0] or 0, v[1].encode(), v[2].encode()))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, kinds = set(), []
        n = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, r, x in rows:
            bare = x.strip(SPACE)
            fault = "blank" if not bare else "duplicate" if (r, x) in seen else "truncated" if bare[-1] not in ".!?" else None
            if fault:
                n[fault] += 1
            seen.add((r, x))
            kinds.append((r, x, fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, _ = cheapest(kinds)
        left, state, i = [], "", 0
        for e in audit:
            nxt = "assistant" if state == "u" else "user"
            if e == "I":
                left.append(nxt + ":")
                state = nxt[0]
                continue
            r, x = kinds[i][:2]
            if e == "K":
                left.append(f"{r}:{x}")
                state = r[0]
            if e == "R":
                left.append(f"{nxt}:{x}")
                state = nxt[0]
            i += 1
        out.append((c, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit,
                    hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return out


def some_rows(seed=5, n=60):
    rng = random.Random(seed)
    rows = []
    for c in [*range(n), None]:
        turn = 0
        for _ in range(rng.randint(1, 6)):
            turn += rng.choice((1, 1, 1, 2, 0))
            rows.append((c, None if rng.random() < 0.08 else turn,
                         rng.choice(("user", "assistant", "user", "assistant", "system", "tool", "", None)),
                         rng.choice(("Yes.", "no", "What? \n", "", " \t", None, "über!", f"text {rng.random()}."))))
    rows += [(70, 1, "user", "same."), (70, 1, "user", "same."), (70, 1, "user", "same."), (70, 2, "user", "same.")]
    return rows


@pytest.mark.parametrize("chunk_rows", [1, 2, 2048])
def test_equals_search_over_audits(spark, chunk_rows):
    rows = some_rows()
    df = spark.createDataFrame(rows, COLS).repartition(5)
    assert counted(C.repair_conversations(df, chunk_rows=chunk_rows)) == counted(expected(rows))


def test_every_short_conversation_in_every_cut():
    kinds = ["d", "s", "u", "a", "x", "U", "A"]
    sample = {"d": ("user", "", True, False), "x": ("tool", "t.", False, False)}
    for k in "sua":
        sample[k] = ({"s": "system", "u": "user", "a": "assistant"}[k], "t.", False, False)
        sample[k.upper()] = (sample[k][0], "t", False, True)
    rng = random.Random(1)
    words = ["".join(w) for n in (1, 2, 3) for w in product(kinds, repeat=n)]
    words = rng.sample(words, 150) + ["".join(rng.choice(kinds) for _ in range(6)) for _ in range(25)]
    for w in words:
        want = cheapest([sample[k] for k in w])[:2]
        for size in {1, 2, len(w)}:
            parts = [w[i:i + size] for i in range(0, len(w), size)]
            cost, ways = C.fold([C._vectors(p) for p in parts])
            audit = "".join(C.rebuild(p, s, e) for p, (s, e) in zip(parts, ways)) + C.TAIL[ways[-1][1]][1]
            assert (cost, audit) == want, (w, size)


def test_long_conversation_is_many_chunks(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"row {i}.") for i in range(6000)] + [(2, 0, "user", "a.")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so small a table is one partition else
    try:
        chunks, folded, parts = C.repair_parts(C.damaged(spark.createDataFrame(rows, COLS)), chunk_rows=100)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    per = {r.ck: r["count"] for r in parts.groupBy("ck").count().collect()}
    assert per["=1"] >= 57 and chunks.agg({"rows": "max"}).first()[0] <= 100
    assert chunks.filter("ck = '=1'").select("part").distinct().count() > 1


def test_text_ids_empty_tables_and_clashing_names(spark):
    rows = [("b", 1, "user", "Hi."), ("b", 2, "assistant", "Yo."), ("", 1, "user", "x"), (None, None, None, None)]
    df = spark.createDataFrame([(*r, "k", 1, "s", 2) for r in rows],
                               "conv_id string, turn bigint, role string, text string, ck string, copies int, said string, part int")
    assert counted(C.repair_conversations(df)) == counted(expected(rows))
    assert C.repair_conversations(spark.createDataFrame([], COLS)).count() == 0
