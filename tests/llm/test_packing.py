"""Packing: the pre-tokeniser against the tokenizer, exact round trips, slack."""
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fleet_health.llm.packing import closest_fill, encoder, pack_documents, plan_bins

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def ids(texts):
    return [e.ids for e in encoder(TOKENIZER).tok.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("  \n\t'sdrevlmtABab12é.,!  中あ😀\x1c\x85͸"), st.characters(codec="utf-8")), max_size=40), max_size=5))
def test_encoder_equals_tokenizer(texts):
    assert [x.tolist() for x in encoder(TOKENIZER).batch(texts)] == ids(texts)


def test_special_token_strings_are_text():
    t = ["a<|endoftext|>b", "it's we'll 'tis I'd've  x '\n's"]
    assert [x.tolist() for x in encoder(TOKENIZER).batch(t)] == ids(t)
    assert 50256 not in ids(t)[0]


@pytest.mark.parametrize("seed", range(5))
def test_closest_fill_is_exact(seed):
    rng = random.Random(seed)
    for _ in range(40):
        counts = {rng.randint(1, 40): rng.randint(1, 4) for _ in range(5)}
        room = rng.randint(0, 90)
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * i for s in sums for i in range(n + 1)}
        used = closest_fill(counts, room)
        assert all(n <= counts[k] for k, n in used.items())
        assert sum(k * n for k, n in used.items()) == max(s for s in sums if s <= room)


def test_plan_uses_every_piece_once():
    rng = random.Random(3)
    counts = {rng.randint(1, 1023): rng.randint(1, 50) for _ in range(300)} | {1024: 77}
    used, bins = defaultdict(int), 0
    for pattern, times in plan_bins(counts, 1024):
        assert sum(k * n for k, n in pattern.items()) <= 1024
        bins += times
        for k, n in pattern.items():
            used[k] += n * times
    assert dict(used) == counts
    # pieces of more than half a window can't share one
    least = max(sum(k * n for k, n in counts.items()) / 1024, sum(n for k, n in counts.items() if k > 512))
    assert bins <= least * 1.03 + 2


def check(rows, got, window):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[(r["doc_id"], r["doc_tokens"])].append(r)
        by_sequence[r["sequence_id"]].append(r)
    want = defaultdict(list)
    for d, t, _ in rows:
        full = np.array([*ids([t or ""])[0], 0], "<u4")
        for s in range(0, len(full), window):
            part = full[s:s + window]
            want[(d, len(full))].append((s, len(part), zlib.crc32(part.tobytes())))
    assert {k: sorted((r["start"], r["length"], r["ids_crc32"]) for r in v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in want.items()}
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
    return sum(r["length"] for r in got) / window, len(by_sequence)


@pytest.mark.parametrize("window", [16, 1024])
def test_pack_round_trip(docs, doc_rows, window):
    need, used = check(doc_rows, pack_documents(docs, TOKENIZER, window).collect(), window)
    assert used <= need * 1.05 + 2


def test_pack_odd_tables(clashing, doc_rows, no_docs):
    check(doc_rows, pack_documents(clashing, TOKENIZER).collect(), 1024)
    assert pack_documents(no_docs, TOKENIZER).count() == 0


def test_hot_length_is_numbered_in_buckets(spark):
    from fleet_health.llm.common import numbered
    df = spark.range(5000).selectExpr("id as doc_id", "if(id < 4000, 7, id % 5) as length")
    counts = {r["length"]: r["count"] for r in df.groupBy("length").count().collect()}
    got = numbered(df, ["length"], ["doc_id"], counts, bucket_rows=100).groupBy("length").agg({"_rank": "max"}).collect()
    assert {r[0]: r[1] + 1 for r in got} == counts
    ranks = numbered(df, ["length"], ["doc_id"], counts, bucket_rows=100).select("length", "_rank")
    assert ranks.distinct().count() == 5000
