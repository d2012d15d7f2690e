"""Mixing: targets, quotas and bounds against plain arithmetic."""
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fleet_health.llm.mixing import BLOCK_WORDS, mix_sources, mixed_documents, shard_quotas, source_targets

from llm_helpers import counted


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def brute_targets(sizes):
    """Source sizes to targets, sharing the excess again and again."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, target, stopped = sum(sizes.values()), {}, set()
    while True:
        free = [s for s in order if s not in stopped]
        if not free:
            return target
        left = total - sum(3 * sizes[s] for s in stopped)
        for s in free:
            target[s] = left * weight[s] / sum(weight[x] for x in free)
        over = {s for s in free if target[s] > 3 * sizes[s]}
        for s in over:
            target[s] = 3 * sizes[s]
        if not over:
            return target
        stopped |= over


def brute_quotas(target, blocks):
    order = list(target)
    won = dict.fromkeys(order, 0)
    for _ in range(blocks):
        best = max(order, key=lambda s: (target[s] / (2 * won[s] + 1), -order.index(s)))
        won[best] += 1
    return won


def test_targets(spark):
    sizes = {"a": 1000, "b": 10, "c": 7, "d": 0, "e": 300, None: 90}
    df = spark.createDataFrame(list(sizes.items()), "source string, size bigint")
    got = {r["source"]: r["target"] for r in source_targets(df).collect()}
    want = brute_targets(sizes)
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(sum(sizes.values()))


@pytest.mark.parametrize("shards", [1, 8])
def test_quotas_are_sainte_lague(spark, shards):
    sizes = {"a": 5000, "b": 100, "c": 333, "d": 40, "e": 8000, "f": 1}
    df = spark.createDataFrame(list(sizes.items()), "source string, size bigint")
    t = source_targets(df).cache()
    target = {r["source"]: r["target"] for r in t.orderBy("rank").collect()}
    blocks = round(sum(sizes.values()) / BLOCK_WORDS)
    q = shard_quotas(t, shards=shards).collect()
    for k in range(shards):
        want = brute_quotas(target, blocks * (k + 1) // shards)
        line = {s: -(-n // BLOCK_WORDS) * 3 for s, n in sizes.items()}
        assert {r["source"]: r["end"] for r in q if r["shard"] == k} == {s: min(n, line[s]) for s, n in want.items()}


def test_mix(docs, doc_rows):
    got = mix_sources(docs).cache()
    sizes = defaultdict(int)
    for _, t, s in doc_rows:
        sizes[s] += size(t)
    want = brute_targets(dict(sizes))
    rows = got.collect()
    assert counted([(r["doc_id"], r["size"]) for r in rows]) == counted([(d, size(t)) for d, t, _ in doc_rows])
    taken = defaultdict(int)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, n in taken.items():
        assert abs(n - want[s]) <= 1.5 * BLOCK_WORDS + 1
    again = mix_sources(docs.repartition(2))
    assert counted(got.select("doc_id", "size", "taken")) == counted(again.select("doc_id", "size", "taken"))


def test_small_buckets_give_the_same(docs):
    cols = ["doc_id", "size", "taken"]
    from fleet_health.llm import mixing
    sizes = docs.select("doc_id", "source", mixing.word_count().alias("size"))
    t = source_targets(sizes)
    at = [mixing.positions(sizes, t, bucket_rows=n).select("doc_id", "size", "at") for n in (1, 3, 10_000)]
    assert counted(at[0]) == counted(at[1]) == counted(at[2])
    assert counted(mix_sources(docs).select(*cols)) == counted(mix_sources(docs.coalesce(1)).select(*cols))


def test_mixed_documents(docs, clashing, no_docs):
    plan = {(r["doc_id"]): 0 for r in docs.select("doc_id").distinct().collect()}
    for r in mix_sources(docs).collect():
        plan[r["doc_id"]] += r["taken"]
    for table in (docs, clashing):
        out = mixed_documents(table)
        assert out.columns == table.columns
        got = defaultdict(int)
        for r in out.collect():
            got[r["doc_id"]] += size(r["text"])
            assert r["n_chars"] == len(r["text"])
        assert dict(got) == {d: n for d, n in plan.items() if n}
    assert mixed_documents(no_docs).count() == 0 and mix_sources(no_docs).count() == 0


def test_no_words(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id bigint, text string, source string")
    assert [tuple(r) for r in mix_sources(df).select(F.sum("taken"), F.sum("target")).collect()] == [(0, 0.0)]
