"""DartMinHash: the estimate against exact weighted Jaccard, classes against brute force."""
import random
import re

import numpy as np
import pytest

from fleet_health.llm.graph import components
from fleet_health.llm.minhash import band_keys, first_of_each_class, near_duplicates, shingles, signatures
from llm_helpers import counted


def word_list(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def shingle_set(t):
    w = word_list(t)
    return {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute_classes(rows, threshold=0.8):
    sets, root = [shingle_set(t) for _, t, _ in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            same = (rows[i][1] or "") == (rows[j][1] or "")
            if same or a and b and len(a & b) >= threshold * len(a | b):
                root[find(i)] = find(j)
    ids = {}
    for i, (d, _, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(d)
    low = {r: min(x, key=lambda d: (d is None, d or 0)) for r, x in ids.items()}
    return [(d, low[find(i)], len(ids[find(i)])) for i, (d, _, _) in enumerate(rows)]


def test_shingles_and_counts():
    texts = ["a b c d e a b c d e", "", "A  B", "a b", "x"]
    t, s, c = shingles(texts)
    assert np.bincount(t, minlength=5).tolist() == [5, 0, 1, 1, 1] and sorted(c.tolist()) == [1] * 7 + [2]
    assert s[t == 2] == s[t == 3] and s[t == 3] != s[t == 4]


@pytest.mark.parametrize("counted_weights", [False, True])
def test_signatures_estimate_weighted_jaccard(counted_weights):
    rng = np.random.default_rng(4)
    k, n = 512, 60
    e = rng.integers(1, 1 << 60, n).astype(np.uint64)
    for share in (0.2, 0.5, 0.9):
        a = rng.uniform(0.1, 9, n) if counted_weights else np.ones(n)
        b = np.where(rng.random(n) < share, a, rng.uniform(0.1, 9, n)) if counted_weights else (rng.random(n) < share).astype(float)
        keep = b > 0
        text = np.concatenate([np.zeros(n, int), np.ones(keep.sum(), int)])
        sig = signatures(text, np.concatenate([e, e[keep]]), np.concatenate([a, b[keep]]), 2, k)
        exact = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert np.isfinite(sig).all()
        assert abs((sig[0] == sig[1]).mean() - exact) < 4 * np.sqrt(0.25 / k)


def test_signature_does_not_depend_on_neighbours():
    texts = ["one two three four five six seven", "a b c d e f g h i j k", "z"]
    alone = [band_keys(signatures(*(lambda x: (x[0], x[1], np.ones(len(x[1]))))(shingles([t])), 1, 12), 2, 6) for t in texts]
    t, s, _ = shingles(texts)
    assert np.array_equal(np.concatenate(alone), band_keys(signatures(t, s, np.ones(len(s)), 3, 12), 2, 6))


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 530)] + [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        return x if root[x] == x else find(root[x])

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in links)}


def sorted_classes(want):
    """The classes' ids, one for each class (null ids have several)."""
    out = []
    for (_, c, n), k in want.items():
        out += [c] * k if n == 1 else []
    return out + list({c for _, c, n in want if n > 1})


def test_classes(docs, clashing, doc_rows, no_docs):
    want = counted(brute_classes(doc_rows))
    assert counted(near_duplicates(docs).select("doc_id", "class_id", "class_size")) == want
    first = first_of_each_class(clashing)
    assert first.columns == clashing.columns
    kept = [r["doc_id"] for r in first.collect()]
    assert counted(kept) == counted(sorted_classes(want)) and near_duplicates(no_docs).count() == 0


def test_chains_and_shared_passages(spark):
    """Chains of near copies, and texts that share a long passage but are not
    similar: classes are the same as over all pairs."""
    rng = random.Random(8)
    new = lambda n: ["w" + str(rng.randint(0, 10 ** 9)) for _ in range(n)]
    rows, passage = [], new(60)
    for i in range(8):
        w = new(150)
        for j in range(6):
            w = list(w)
            w[rng.randrange(150)] = "edit"
            rows.append((len(rows), " ".join(w), "s"))
    rows += [(len(rows) + i, " ".join(new(rng.randint(5, 90)) + passage + new(rng.randint(5, 90))), "s") for i in range(60)]
    df = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id bigint, text string")
    assert counted(near_duplicates(df).select("doc_id", "class_id", "class_size")) == counted(brute_classes(rows))
