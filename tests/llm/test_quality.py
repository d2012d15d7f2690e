"""Quality rules against brute-force counts; both classifiers on held-out labels."""
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleet_health.llm.quality_pu import held_out, nn_pu_gradient, quality_scores
from fleet_health.llm.quality_rules import good_documents, quality_rules
from llm_helpers import counted

COLS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def brute(d, t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    places = {}
    for i in range(len(w) - 4):
        places.setdefault(tuple(w[i:i + 5]), []).append(i)
    inside = {i + k for p in places.values() if len(p) > 1 for i in p for k in range(5)}
    return (d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(inside),
            len(w) < 10 or 100 * len(inside) > 20 * len(w))


def test_counts(docs, clashing, doc_rows, labels, no_docs):
    want = counted([brute(d, t) for d, t, _ in doc_rows])
    for table in (docs, clashing):
        got = quality_rules(table, labels)
        assert counted(got.select(*COLS)) == want
        assert got.filter("kept and base_failed or probability not between 0 and 1").count() == 0
    assert quality_rules(no_docs, labels).count() == 0


def test_counts_random(spark):
    rng = random.Random(11)
    parts = ["a", "b", "#", "|x", " ", "  ", "\n", "\t", "é", "😀", "a b c d e ", "\n\n", "line\n", "\x0b"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    got = quality_rules(df, none)
    assert counted(got.select(*COLS)) == counted([brute(i, t) for i, t in enumerate(texts)])
    assert got.filter("kept = base_failed").count() == 0  # without labels the base rules decide


def test_good_documents(clashing, labels):
    out = good_documents(clashing, labels)
    assert out.columns == clashing.columns and out.filter("doc_id in (5, 6, 7, 14) or text is null").count() == 0


def test_pu_risk_is_non_negative():
    z = np.array([4.0, 5.0, 4.0, -6.0])
    positive, unlabelled = np.array([True, True, False, False]), np.array([False, False, True, True])
    plain = nn_pu_gradient(z, positive, unlabelled, 0.1)
    assert plain[3] > 0 and plain[0] < 0
    z = np.array([6.0, 6.0, -6.0, -6.0])  # as if no positives were among the unlabelled: the risk's rest is below zero
    back = nn_pu_gradient(z, positive, unlabelled, 0.9)
    assert back[2] < 0 and back[0] > 0


@pytest.fixture(scope="module")
def real(spark):
    d = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def test_rules_keep_good_and_drop_bad(real):
    docs, labels = real
    got = quality_rules(docs, labels).join(labels, "doc_id").filter("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k"))
    k = {r["quality"]: r["k"] for r in got.collect()}
    assert k[1] > 0.99 and k[0] < 0.05


def test_scores_on_held_out_labels(real):
    docs, labels = real
    rows = quality_scores(docs, labels).join(labels, "doc_id").filter("held_out").select("score", "predicted", "quality").toPandas()
    y, rank = rows.quality.values, rows.score.rank().values
    auc = (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    assert auc > 0.95 and (rows.predicted == y).mean() > 0.93


def test_scores_read_no_label_of_held_out_rows(real):
    docs, labels = real
    small = docs.filter("doc_id < 3000")
    spoiled = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality_scores(small, x, train_rows=500).select("doc_id", "score", "held_out") for x in (labels, spoiled))
    assert counted(a) == counted(b)


def test_scores_odd_tables(docs, clashing, doc_rows, labels, no_docs, spark):
    for table in (docs, clashing):
        got = quality_scores(table, labels, train_rows=50)
        assert got.count() == len(doc_rows) and got.filter("score is null or score not between 0 and 1").count() == 0
    assert quality_scores(no_docs, labels).count() == 0
    none = quality_scores(docs, labels.limit(0))
    assert none.select("score").distinct().count() == 1
