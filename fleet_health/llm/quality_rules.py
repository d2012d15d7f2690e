"""Quality rules: fixed counts, and a calibrated n-gram classifier.

The base rules count words, symbols, repeated lines and repeated five-word
windows of the whole text.  What passes them is judged by a logistic regression
on hashed word and character n-grams (see ``features``), trained on labelled
rows and calibrated (Platt) on the part of them that training left out; the
verdict compares the probability with a fixed threshold.  Counting and scoring
happen in one pass in Arrow batches.

The classifier is fitted on about ``train_rows`` labelled rows, half of either
class, chosen by a hash of their id, one row of each, and weighed by class as all labels are; that bound does not grow with the data, everything else covers
all rows.

Defined results: a null text has no words and fails.  Without labelled rows of
both classes there is no classifier, and what passes the base rules stays.
Rows that repeat an id are judged alike; of conflicting labels the lowest holds;
labels without an id or quality are ignored.  An empty table gives an empty
result.  Columns other than id and text are only passed through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import chunked
from .common import Masked, stored, text_of
from .features import Linear, Texts, bounded_by_class, class_weights, descend, fitted, model_row, one_each, platt, sigmoid, sparse_rows

TRAIN_ROWS = 2500
EPOCHS = 16
THRESHOLD = 0.5
MIN_WORDS, REPEAT_PERCENT = 10, 20
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def labelled_rows(docs: DataFrame, labels: DataFrame, rows: int, seed: str, id_col: str, text_col: str,
                  label_col: str = "quality") -> tuple[DataFrame, dict[int, int]]:
    """Features of a bounded sample of ``docs`` with a label, stored, and
    the number of labels of each class.  The ids chosen are about ``rows``, so they are broadcast."""
    y = (labels.select(F.col("doc_id"), F.col(label_col).alias("y")).filter("doc_id is not null and y in (0, 1)")
         .groupBy("doc_id").agg(F.min("y").alias("y")))
    chosen, of = bounded_by_class(y, rows, seed)
    fold = F.pmod(F.crc32(F.concat_ws("|", F.lit(seed), F.lit("fold"), F.col("doc_id").cast("string"))), F.lit(4))
    t = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")
    return stored(sparse_rows(one_each(t.withColumn("fold", fold))), "features"), of


def _fit(of: dict[int, int]):
    def fit(s):
        if len(set(s.y.tolist())) < 2:
            return None
        train, weight = s.fold != 0, class_weights(s.y, of)
        if len(set(s.y[train].tolist())) < 2:
            train[:] = True
        w, b = descend(s, lambda z, own: np.where(train[own], (sigmoid(z) - s.y[own]) * weight[own], 0.0) / len(own), EPOCHS)
        z, out = s.margins(w, b), ~train
        held = out if len(set(s.y[out].tolist())) == 2 else np.ones(len(z), bool)
        return model_row(w, b, *platt(z[held], s.y[held], weight[held]))
    return fit


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text"):
    rows, of = labelled_rows(docs, labels, train_rows, "rules", id_col, text_col)
    return fitted(rows, _fit(of))


def judge(docs: DataFrame, model: Linear | None, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``probability`` and ``kept``,
    which take the place of columns so named."""
    m = Masked(docs)
    given = m.df.withColumn("given", text_of(m.of(text_col)))
    added = [T.StructField(c, T.LongType()) for c in COUNTS] + [
        T.StructField("base_failed", T.BooleanType()), T.StructField("probability", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    n = len(m.names)

    def run(batches):
        for b in batches:
            for lo, hi, texts in chunked(b.column(n)):
                t = Texts(texts)
                c = t.counts
                failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > REPEAT_PERCENT * c["n_words"])
                p = model.score(t) if model else np.ones(t.n)
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(n)), *(pa.array(c[x]) for x in COUNTS), pa.array(failed),
                     pa.array(p), pa.array(~failed & (p >= threshold))],
                    names=[*(f"c{i}" for i in range(n)), *COUNTS, "base_failed", "probability", "kept"])

    judged = given.mapInArrow(run, T.StructType(m.df.schema.fields + added))
    return m.back(judged, *(f.name for f in added))


def quality_rules(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, the five counts,
    ``base_failed``, ``probability``, ``kept``."""
    model = train(docs, labels, train_rows, id_col, text_col)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return judge(d, model, threshold).drop("text")


def good_documents(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that the rules reject."""
    model = train(docs, labels, train_rows, id_col, text_col)
    m = Masked(docs)
    return m.back(judge(m.df, model, threshold, m.of(text_col)).filter("kept"))
