"""The bounded labelled sample keeps rare classes and one row of each id."""
import numpy as np
from pyspark.sql import functions as F

from fleet_health.llm.features import bounded_by_class, class_weights
from fleet_health.llm.quality_rules import labelled_rows


def test_a_rare_class_stays(spark):
    y = spark.range(20000).select(F.col("id").alias("doc_id"), (F.col("id") >= 5).cast("int").alias("y"))
    chosen, of = bounded_by_class(y, 100, "s")
    n = {r["y"]: r["count"] for r in chosen.groupBy("y").count().collect()}
    assert of == {0: 5, 1: 19995} and n[0] == 5 and 50 < n[1] < 150
    w = class_weights(np.array([0] * 5 + [1] * n[1]), of)
    assert abs(w.mean() - 1) < 1e-9 and abs(w[0] * 5 / w.sum() - 5 / 20000) < 1e-9


def test_one_row_of_a_repeated_id(spark):
    docs = spark.range(300).select(F.when(F.col("id") < 200, F.lit(7)).otherwise(F.col("id")).alias("doc_id"),
                                   F.concat_ws(" ", F.lit("text"), "id").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")).distinct()
    assert labelled_rows(docs, labels, 1000, "s", "doc_id", "text")[0].count() == 101
