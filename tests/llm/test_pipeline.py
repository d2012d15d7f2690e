"""The pipeline: each stage on its predecessor's rows, against brute force."""
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline as P
from fleet_health.llm.common import stored
from test_exact_and_lines import brute_lines
from test_minhash import brute_classes
from test_mixing import brute_targets, size
from test_packing import check
from test_quality import brute as brute_counts

SF = "/root/testdata/sf0.001"


def triples(df):
    return [tuple(r) for r in df.select("doc_id", "text", "source").collect()]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at, frames = docs, []
    for name, stage in P.STAGES:
        at = stored(stage(spark, at, SF), f"test-{name}")
        frames.append(at)
        if name != "packing":
            assert at.dtypes == docs.dtypes and at.filter("n_chars != length(text)").count() == 0
    rules, lines, near, mix, packed = frames
    kept = {r["doc_id"] for r in rules.collect()}
    rows = triples(docs)
    assert kept <= {d for d, t, _ in rows if not brute_counts(d, t)[-1]}
    good = spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()
    passes = {r["doc_id"] for r in good} & {d for d, t, _ in rows if not brute_counts(d, t)[-1]}
    assert len(passes - kept) <= 0.03 * len(passes)
    assert sorted((d, t) for d, t, *_ in brute_lines(triples(rules))) == sorted((d, t) for d, t, _ in triples(lines))
    assert sorted({c for _, c, _ in brute_classes(triples(lines))}) == sorted(d for d, _, _ in triples(near))
    before = triples(near)
    sizes, taken = {}, {}
    for _, t, s in before:
        sizes[s] = sizes.get(s, 0) + size(t)
    for _, t, s in triples(mix):
        taken[s] = taken.get(s, 0) + size(t)
    for s, n in brute_targets(sizes).items():
        assert abs(taken[s] - n) <= 25
    need, used = check(triples(mix), packed.collect(), 1024)
    assert used <= need * 1.05 + 1


def test_run_is_the_stages(spark):
    a = P.run(spark, SF)
    assert a.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert a.agg(F.sum("length")).first()[0] > 0


def test_empty_and_odd_tables(spark, docs, clashing, no_docs, tmp_path):
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for table in (no_docs, docs, clashing):
        at = table
        for name, stage in P.STAGES:
            at = stored(stage(spark, at, str(tmp_path)), f"test-{name}")
            if name != "packing":
                assert at.columns == table.columns
        assert (at.count() == 0) == (table is no_docs)
