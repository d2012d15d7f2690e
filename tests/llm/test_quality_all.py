"""The unlabelled risk covers all open documents, not only a sample of them."""
import numpy as np
from pyspark.sql import functions as F

from fleet_health.llm import quality_pu as Q
from fleet_health.llm.features import DIM, GROUPS, Linear, Sample, Texts, sparse_rows


def test_every_open_document_has_its_share(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").coalesce(2)
    rows = sparse_rows(docs.limit(40).withColumn("y", F.lit(1)).withColumn("fold", F.lit(1)))
    positives = Sample(rows.toArrow().to_batches())
    junk = "zqxj vwkq qzzx jjqx " * 30
    start, t = Linear(np.zeros(GROUPS * DIM), 0.0), Texts([junk])
    texts = docs.select("text")
    one = spark.createDataFrame([(junk,)], "text string")
    plain = Q.over_all(texts, start, positives, 0.5)
    seen = Q.over_all(texts.unionByName(one).coalesce(1), start, positives, 0.5)
    alone = Q.over_all(texts.coalesce(1), start, positives, 0.5)
    assert np.isfinite(plain.weights).all()
    assert seen.margin(t)[0] < alone.margin(t)[0] - 0.5

    given = []
    monkeypatch.setattr(Q, "over_all", lambda df, model, *rest: given.append(df.count()) or model)
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    Q.train(docs, labels, train_rows=40)
    assert given == [docs.filter(~Q.held_out(F.col("doc_id"))).count()]
