"""Quality scores by positive-unlabelled learning.

Trusted positives are labelled rows of quality 1; the unlabelled set is text of
the corpus, whatever its labels.  The class prior is estimated from the labelled
rows open to learning.  A linear model on hashed n-grams (see ``features``)
minimises the non-negative unbiased risk

    prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1))

with the logistic loss: where the second part falls below zero, its gradient is
reversed, so the model cannot overfit the positives among the unlabelled.  A
bounded sample gives the start; then one pass over all open documents goes on
from it: each partition descends the risk of its own documents as the unlabelled
against the sample's positives, and the partitions' models are averaged, weighed
by their documents.  So every open document has its share in R_u.  The labelled rows that the risk has not seen then set the probability scale (Platt).

Labels are only read of rows whose crc32(id as text) mod 5 is not 0, and such
held-out rows are not in the unlabelled set.  Scores depend on the text alone.
The labelled rows, and the unlabelled ones of the start, are about ``train_rows``
each, chosen by a hash of their id; the pass and scoring cover all rows, in
Arrow batches.

Defined results: null and empty texts are scored like any other, from the
bias alone.  Without a labelled positive row all scores are the prior.  Rows
that repeat an id are scored by their own text.  A null id is never held out.
An empty table gives an empty result.  Columns other than id and text are not
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import chunked
from .common import stored, text_of
from .features import DIM, GROUPS, SCALE, Linear, Sample, Texts, bounded, bounded_by_class, class_weights, descend, fitted, model_row, one_each, platt, sigmoid, sparse_rows

TRAIN_ROWS = 2500
EPOCHS = 30
RATE = 0.1
PASS_RATE, PASS_ROWS = 0.01, 256  # of the pass over all open documents
GROUPED = 16  # partitions' models are added up in so many groups first
THRESHOLD = 0.3
HELD_OUT, FOLDS = 0, 5
UNLABELLED = 2


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def nn_pu_gradient(z: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> np.ndarray:
    """Each row's gradient of the non-negative risk (logistic loss)."""
    p = sigmoid(z)
    n_p, n_u = max(positive.sum(), 1), max(unlabelled.sum(), 1)
    as_negative = np.logaddexp(0, z)  # the loss of calling a row negative
    rest = as_negative[unlabelled].sum() / n_u - prior * as_negative[positive].sum() / n_p
    push = np.where(unlabelled, p / n_u, 0.0) - np.where(positive, prior * p / n_p, 0.0)
    if rest < 0:
        return -push
    return push + np.where(positive, prior * (p - 1) / n_p, 0.0)


def _start(prior: float):
    def fit(s):
        learn = s.fold != 0
        positive, unlabelled = (s.y == 1) & learn, s.y == UNLABELLED
        if not positive.any():
            return None
        return model_row(*descend(s, lambda z, own: nn_pu_gradient(z, positive[own], unlabelled[own], prior), EPOCHS, rate=RATE), 1.0, 0.0)
    return fit


def _scale(model: Linear, of: dict[int, int]):
    w, b = model.weights, model.bias

    def fit(s):
        learn = s.fold != 0
        # labelled rows that the risk has not seen: all negatives, and the positives left out, for all positives
        left_out = (s.y == 1) & ~learn
        scale = (s.y == 0) | (left_out if left_out.any() else s.y == 1)
        weight = np.where(s.y == 1, (s.y == 1).sum() / max((scale & (s.y == 1)).sum(), 1), 1.0)
        weight *= class_weights(s.y, of)
        return model_row(w, b, *platt(s.margins(w, b)[scale], s.y[scale], weight[scale]))
    return fit


def _descent(model: Linear, positives: Sample, prior: float):
    """A function of texts that makes one step of Adam with them as the unlabelled, and the weights and bias it works on."""
    v = np.append(model.weights, model.bias)
    m1, m2, done = np.zeros_like(v), np.zeros_like(v), [0]
    mine = positives.batches(PASS_ROWS)

    def step(texts: list):
        t = Texts(texts)
        count, parts = np.zeros((GROUPS, t.n)), []
        for g, owner, place in t.ngrams():
            count[g] += np.bincount(owner, minlength=t.n)
            parts.append((g, owner, (g * DIM + place).astype(np.int32)))
        share = SCALE / np.maximum(count, 1)
        z = np.full(t.n, v[-1])
        for g, owner, place in parts:
            z += share[g] * np.bincount(owner, weights=v[place], minlength=t.n)
        own = mine[done[0] % len(mine)]
        row, at, value = positives.features(own)
        zp = np.bincount(row, weights=v[at] * value, minlength=len(own)) + v[-1]
        positive = np.arange(len(own) + t.n) < len(own)
        push = nn_pu_gradient(np.concatenate([zp, z]), positive, ~positive, prior)
        grad = np.append(np.bincount(at, weights=push[:len(own)][row] * value, minlength=GROUPS * DIM), push.sum())
        for g, owner, place in parts:
            grad[:-1] += np.bincount(place, weights=(push[len(own):] * share[g])[owner], minlength=GROUPS * DIM)
        done[0] += 1
        m1[:] = 0.9 * m1 + 0.1 * grad
        m2[:] = 0.99 * m2 + 0.01 * grad * grad
        v[:] -= PASS_RATE * (m1 / (1 - 0.9 ** done[0])) / (np.sqrt(m2 / (1 - 0.99 ** done[0])) + 1e-8)
    return step, v


def over_all(texts: DataFrame, model: Linear, positives: Sample, prior: float) -> Linear:
    """``model`` after the pass over all ``texts`` (``text``) as the unlabelled."""
    given = texts.sparkSession.sparkContext.broadcast((model, positives))  # bounded: weights, and the sample's positives

    def run(batches):
        step, v = _descent(*given.value, prior)
        n, pid = 0, 0
        for b in batches:
            for lo, hi, part in chunked(b.column("text")):
                pid = b.column("pid")[0].as_py()
                for i in range(0, hi - lo, PASS_ROWS):
                    step(part[i:i + PASS_ROWS])
                n += hi - lo
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([pid], pa.int32()), pa.array([n], pa.int64()), pa.array([(v * n).tobytes()], pa.binary())],
                                             names=["pid", "n", "v"])

    def add(t: pa.Table) -> pa.Table:
        t = t.sort_by("pid")
        total = np.zeros(GROUPS * DIM + 1)
        for x in t.column("v"):
            total += np.frombuffer(x.as_py())
        return pa.table({"pid": t.column("pid").slice(0, 1), "n": [sum(t.column("n").to_pylist())], "v": pa.array([total.tobytes()], pa.binary())})

    each = texts.withColumn("pid", F.spark_partition_id()).mapInArrow(run, "pid int, n bigint, v binary")
    got = sorted(each.groupBy(F.pmod("pid", F.lit(GROUPED))).applyInArrow(add, "pid int, n bigint, v binary").collect())
    given.unpersist()
    if not got:
        return model
    v = sum(np.frombuffer(bytes(r["v"])) for r in got) / sum(r["n"] for r in got)
    return Linear(v[:-1], float(v[-1]))


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id",
          text_col: str = "text") -> tuple[Linear | None, float]:
    """The model and the estimated class prior."""
    open_ids = ~held_out(F.col("doc_id"))
    y = (labels.select("doc_id", F.col("quality").alias("y")).filter("doc_id is not null and y in (0, 1)").filter(open_ids)
         .groupBy("doc_id").agg(F.min("y").alias("y")))
    y = stored(y, "open_labels")
    n, positives = y.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    prior = (positives + 1) / (n + 2)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    u = d.select("doc_id").filter(open_ids & F.col("doc_id").isNotNull())
    labelled, of = bounded_by_class(y, train_rows, "pu-labelled")
    chosen = (labelled.unionByName(bounded(u, train_rows, "pu-unlabelled").distinct().withColumn("y", F.lit(UNLABELLED))))
    chosen = stored(chosen, "chosen")  # about twice ``train_rows`` ids, so they are broadcast
    fold = F.pmod(F.crc32(F.concat_ws("|", F.lit("pu-fold"), F.col("doc_id").cast("string"))), F.lit(4))
    sample = d.join(F.broadcast(chosen), "doc_id").withColumn("fold", fold)
    # an id may be both labelled and unlabelled: one row of each
    sample = one_each(sample.filter(f"y != {UNLABELLED}")).unionByName(one_each(sample.filter(f"y = {UNLABELLED}")))
    rows = stored(sparse_rows(sample), "features")
    model = fitted(rows, _start(prior))
    if model is None:
        return None, prior
    positives = Sample(rows.filter("y = 1 and fold != 0").toArrow().to_batches())
    model = over_all(d.filter(open_ids).select(text_of("text").alias("text")), model, positives, prior)
    return fitted(rows, _scale(model, of)), prior


def quality_scores(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``held_out``, ``score``,
    ``predicted``."""
    model, prior = train(docs, labels, train_rows, id_col, text_col)
    d = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for lo, hi, texts in chunked(b.column("text")):
                t = Texts(texts)
                p = model.score(t) if model else np.full(t.n, prior)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array(p)], names=["doc_id", "score"])

    scored = d.mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
