"""Ids that are texts: the results of the numbered table under the texts' order."""
import pytest
from pyspark.sql import functions as F

from fleet_health.llm.exact_dedup import exact_duplicates
from fleet_health.llm.line_dedup import drop_repeated_lines
from fleet_health.llm.minhash import near_duplicates
from fleet_health.llm.mixing import mix_sources
from fleet_health.llm.secret_scan import scan_digest
from llm_helpers import counted


@pytest.fixture(scope="module")
def both(docs):
    """The table and its copy with ids whose order as texts is that of the numbers."""
    text_id = F.when(F.col("doc_id").isNotNull(), F.concat(F.lit("id"), F.lpad(F.col("doc_id").cast("string"), 6, "0")))
    return docs, docs.withColumn("doc_id", text_id)


def as_number(df):
    return df.select(*[F.regexp_replace(c, "^id0*(?=[0-9])", "").cast("bigint").alias(c) if t == "string" and c in ("doc_id", "keep_id", "class_id")
                       else F.col(c) for c, t in df.dtypes])


@pytest.mark.parametrize("operator", [
    lambda d: exact_duplicates(d), lambda d: drop_repeated_lines(d).select("doc_id", "text", "n_lines", "n_dropped"),
    lambda d: drop_repeated_lines(d, batches=3).select("doc_id", "text", "n_dropped"),
    lambda d: near_duplicates(d).select("doc_id", "class_id", "class_size"), lambda d: scan_digest(d)],
    ids=["exact", "lines", "lines in three batches", "near", "secrets"])
def test_text_ids(both, operator):
    numbers, texts = both
    assert counted(as_number(operator(texts))) == counted(operator(numbers))


def test_mixing_takes_text_ids(both):
    numbers, texts = both
    a, b = mix_sources(numbers), mix_sources(texts)
    per = lambda d: {r[0]: (r[1], r[2]) for r in d.groupBy("source").agg(F.max("target"), F.sum("taken")).collect()} if "source" in d.columns else d.count()
    assert per(a) == per(b)
