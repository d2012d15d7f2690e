"""Counts and hashed n-gram features of texts, and linear models over them.

Features come in five groups: words, pairs of neighbouring words (both A-Z
lower-cased), the 3- and 5-character n-grams of the text as it is, and its shape
(shares of repeated words and lines, symbols, capitals and digits, word length
and number, each in steps).  Each n-gram is hashed to one of ``DIM`` places of
its group, and a feature's value is its share of the group's n-grams, so a score
is an average over a text's n-grams whatever its length.  Scoring needs no table of a text's features: the
weights are looked up per n-gram and averaged.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Hasher, chunked, code_points, is_space, mix, words
from .common import stored

DIM = 1 << 15
GROUPS = 5
SCALE = 30.0
BLOCK = 250_000  # positions worked off at a time
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
# fixed values of the contract
SYMBOLS = "#*$%&|<>"
WINDOW = 5


def _runs_within(text: np.ndarray, n: int) -> np.ndarray:
    """Places i where i .. i+n-1 belong to the same text."""
    if len(text) < n:
        return np.zeros(0, np.int64)
    return np.flatnonzero(text[: len(text) - n + 1] == text[n - 1:])


def _repeated(text: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For each entry, how many entries have the same text and key."""
    order = np.lexsort((key, text))
    t, k = text[order], key[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (k[1:] != k[:-1])
    group = np.cumsum(new) - 1
    size = np.bincount(group) if len(group) else np.zeros(0, np.int64)
    out = np.empty(len(t), np.int64)
    out[order] = size[group]
    return out


class Texts:
    """A chunk of texts as arrays."""

    def __init__(self, texts: list):
        self.n = len(texts)
        self.cp, self.bounds = code_points(texts)
        self.start, self.end, self.text = words(self.cp, self.bounds)
        self.plain = Hasher(self.cp)

    @cached_property
    def counts(self) -> dict[str, np.ndarray]:
        """Per text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
        n, cp, text = self.n, self.cp, self.text
        each = lambda t, w=None: np.bincount(t, weights=w, minlength=n).astype(np.int64)
        of_char = lambda i: np.searchsorted(self.bounds, i, side="right") - 1
        symbols = np.zeros(len(cp), bool)
        for s in SYMBOLS:
            symbols |= cp == ord(s)
        # lines with a word: from the text's start or after \n to the next \n or the end
        full = np.flatnonzero(np.diff(self.bounds) > 0)
        cuts = np.flatnonzero(cp == 10)
        begin = np.sort(np.concatenate([self.bounds[full], cuts + 1]))
        stop = np.sort(np.concatenate([self.bounds[full + 1], cuts]))
        ink = np.concatenate([[0], np.cumsum(~is_space(cp))])
        real = ink[stop] > ink[begin]
        begin, stop = begin[real], stop[real]
        owner = of_char(begin)
        same = _repeated(owner, self.plain.of(begin, stop))
        # a group of m equal lines has m - 1 that equal an earlier one
        dup = each(owner) - np.rint(np.bincount(owner, weights=1.0 / same, minlength=n)).astype(np.int64) if len(owner) else each(owner)
        word = self.plain.of(self.start, self.end)
        at = _runs_within(text, WINDOW)
        key = np.zeros(len(at), np.uint64)
        for k in range(WINDOW):
            key = mix(key * _ODD[0] + word[at + k] + np.uint64(k + 1))
        often = at[_repeated(text[at], key) >= 2]
        cover = np.zeros(len(text) + 1, np.int64)
        np.add.at(cover, often, 1)
        np.add.at(cover, often + WINDOW, -1)
        inside = np.cumsum(cover[:-1]) > 0
        return {"n_words": each(text), "word_chars": each(text, (self.end - self.start).astype(np.float64)),
                "n_symbols": each(of_char(np.flatnonzero(symbols))), "n_dup_lines": dup,
                "n_repeat_words": each(text[inside])}

    def ngrams(self):
        """(group, text number, place) of every n-gram, in blocks of bounded size."""
        low = Hasher(self.cp, lower=True).of(self.start, self.end)
        yield 0, self.text, (mix(low + _ODD[1]) % np.uint64(DIM)).astype(np.int64)
        two = _runs_within(self.text, 2)
        yield 1, self.text[two], (mix(low[two] * _ODD[2] + low[two + 1]) % np.uint64(DIM)).astype(np.int64)
        for g, size in ((2, 3), (3, 5)):
            for lo in range(0, len(self.cp) - size + 1, BLOCK):
                at = np.arange(lo, min(lo + BLOCK, len(self.cp) - size + 1))
                owner = np.searchsorted(self.bounds, at, side="right") - 1
                ok = at + size <= self.bounds[owner + 1]
                at, owner = at[ok], owner[ok]
                yield g, owner, (self.plain.of(at, at + size) & np.uint64(DIM - 1)).astype(np.int64)
        yield 4, *self.shape()

    def shape(self):
        c, n, cp = self.counts, self.n, self.cp
        share = lambda x, of: np.minimum(np.sqrt(x / np.maximum(of, 1)) * 15, 15).astype(np.int64)
        chars = np.diff(self.bounds)
        total = lambda flag: np.diff(np.concatenate([[0], np.cumsum(flag)])[self.bounds])
        lines = total(cp == 10) + 1
        steps = [share(c["n_repeat_words"], c["n_words"]), share(c["n_dup_lines"], lines), share(c["n_symbols"], chars),
                 share(total((cp >= 65) & (cp <= 90)), chars), share(total((cp >= 48) & (cp <= 57)), chars),
                 np.minimum(c["word_chars"] / np.maximum(c["n_words"], 1), 15).astype(np.int64),
                 np.minimum(np.log2(c["n_words"] + 1), 15).astype(np.int64)]
        place = np.stack([i * 16 + x for i, x in enumerate(steps)], 1)
        return np.repeat(np.arange(n), len(steps)), place.ravel()


@dataclass
class Linear:
    """score = sigmoid(slope * (weights . features + bias) + shift)."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, t: Texts) -> np.ndarray:
        count, total = np.zeros((GROUPS, t.n)), np.zeros((GROUPS, t.n))
        for g, owner, place in t.ngrams():
            count[g] += np.bincount(owner, minlength=t.n)
            total[g] += np.bincount(owner, weights=self.weights[g * DIM + place], minlength=t.n)
        return self.bias + SCALE * (total / np.maximum(count, 1)).sum(axis=0)

    def score(self, t: Texts) -> np.ndarray:
        return sigmoid(self.slope * self.margin(t) + self.shift)


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def sparse_rows(labelled: DataFrame) -> DataFrame:
    """``labelled`` (``text``, ``y`` and ``fold``) to the rows' features
    (``y``, ``fold``, ``place``, ``value``)."""
    dims = GROUPS * DIM

    def run(batches):
        for b in batches:
            for lo, hi, texts in chunked(b.column("text")):
                t = Texts(texts)
                count = np.zeros((GROUPS, t.n))
                keys, numbers = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for g, owner, place in t.ngrams():
                    count[g] += np.bincount(owner, minlength=t.n)
                    k, n = np.unique(owner * dims + g * DIM + place, return_counts=True)
                    keys.append(k)
                    numbers.append(n)
                key, at = np.unique(np.concatenate(keys), return_inverse=True)
                number = np.bincount(at, weights=np.concatenate(numbers), minlength=len(key))
                owner, place = key // dims, key % dims
                value = SCALE * number / np.maximum(count[place // DIM, owner], 1)
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=t.n))]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [b.column("y").slice(lo, hi - lo), b.column("fold").slice(lo, hi - lo),
                     pa.ListArray.from_arrays(offsets, pa.array(place.astype(np.int32))),
                     pa.ListArray.from_arrays(offsets, pa.array(value.astype(np.float32)))],
                    names=["y", "fold", "place", "value"])

    return labelled.select(F.coalesce("text", F.lit("")).alias("text"), F.col("y").cast("int"), F.col("fold").cast("int")).mapInArrow(
        run, "y int, fold int, place array<int>, value array<float>")


class Sample:
    """The sparse rows of a bounded sample, in one task."""

    def __init__(self, batches):
        y, fold, size, place, value = [], [], [], [], []
        for b in batches:
            y.append(b.column("y").to_numpy(zero_copy_only=False))
            fold.append(b.column("fold").to_numpy(zero_copy_only=False))
            p = b.column("place")
            size.append(np.diff(p.offsets.to_numpy()))
            place.append(p.flatten().to_numpy())
            value.append(b.column("value").flatten().to_numpy())
        cat = lambda x, kind: np.concatenate(x).astype(kind, copy=False) if x else np.zeros(0, kind)
        self.y, self.fold = cat(y, np.int64), cat(fold, np.int64)
        self.ends = np.concatenate([[0], np.cumsum(cat(size, np.int64))])
        self.place, self.value = cat(place, np.int32), cat(value, np.float32)

    def features(self, own: np.ndarray):
        """(row number within ``own``, place, value) of some rows."""
        size = self.ends[own + 1] - self.ends[own]
        row = np.repeat(np.arange(len(own)), size)
        take = np.arange(len(row)) + np.repeat(self.ends[own] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        return row, self.place[take], self.value[take]

    def batches(self, rows: int):
        """Rows in a mixed but fixed order."""
        order = np.random.default_rng(7).permutation(len(self.y))
        return [order[lo:lo + rows] for lo in range(0, len(order), rows)]

    def margins(self, w: np.ndarray, bias: float) -> np.ndarray:
        z = np.zeros(len(self.y))
        for own in self.batches(256):
            row, place, value = self.features(own)
            z[own] = np.bincount(row, weights=w[place] * value, minlength=len(own)) + bias
        return z


def descend(sample: Sample, gradient, epochs: int, rows: int = 256, rate: float = 0.05, l2: float = 1e-6):
    """Adam on (weights, bias) over batches of rows, with a rate that falls to 0;
    ``gradient(margins, own)`` gives the margin gradient of the sample's rows ``own``."""
    w, b = np.zeros(GROUPS * DIM), 0.0
    m1, m2, c1, c2, i = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0, 0
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for own in sample.batches(rows):
            row, place, value = sample.features(own)
            i += 1
            g = gradient(np.bincount(row, weights=w[place] * value, minlength=len(own)) + b, own)
            gw, gb = np.bincount(place, weights=g[row] * value, minlength=GROUPS * DIM) + l2 * w, g.sum()
            m1, m2 = 0.9 * m1 + 0.1 * gw, 0.99 * m2 + 0.01 * gw * gw
            c1, c2 = 0.9 * c1 + 0.1 * gb, 0.99 * c2 + 0.01 * gb * gb
            f1, f2 = 1 - 0.9 ** i, 1 - 0.99 ** i
            w -= step * (m1 / f1) / (np.sqrt(m2 / f2) + 1e-8)
            b -= step * (c1 / f1) / (np.sqrt(c2 / f2) + 1e-8)
    return w, b


def platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, steps: int = 50) -> tuple[float, float]:
    """Slope and shift that calibrate margins (Newton steps; smoothed targets);
    ``weight`` gives each row's."""
    weight = np.ones(len(z)) if weight is None else weight
    pos, neg = (y == 1).sum(), (y == 0).sum()
    if not pos or not neg:
        return 1.0, 0.0
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([z, np.ones_like(z)], 1)
    v = np.array([1.0 / max(z.std(), 1e-6), 0.0])
    for _ in range(steps):
        p = sigmoid(x @ v)
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (weight * (p - t)) + 1e-3 * v)
        v = v - step / max(1.0, np.abs(step).max())
    return float(max(v[0], 1e-3)), float(v[1])


MODEL = "weights binary, bias double, slope double, shift double"


def model_row(w: np.ndarray, bias: float, slope: float, shift: float) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([w.astype(np.float32).tobytes()], pa.binary()), *(pa.array([float(x)], pa.float64()) for x in (bias, slope, shift))],
        names=["weights", "bias", "slope", "shift"])


def fitted(rows: DataFrame, fit) -> Linear | None:
    """Run ``fit(Sample) -> model_row or None`` in one task over a bounded sample."""

    def run(batches):
        got = fit(Sample(batches))
        if got is not None:
            yield got

    r = rows.repartition(1).mapInArrow(run, MODEL).first()
    return None if r is None else Linear(np.frombuffer(bytes(r["weights"]), np.float32).astype(np.float64), r["bias"], r["slope"], r["shift"])


def bounded(ids: DataFrame, rows: int, seed: str) -> DataFrame:
    """About ``rows`` rows of ``ids`` (``doc_id``), chosen by a seeded hash of
    the id: the same ones on each run."""
    n = ids.count()
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id").cast("string")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return ids.filter(u < F.lit(min(1.0, rows / max(n, 1))))


def bounded_by_class(labelled: DataFrame, rows: int, seed: str) -> tuple[DataFrame, dict[int, int]]:
    """About ``rows`` rows of ``labelled`` (``doc_id``, ``y``), half of them of either
    class (more where the other has fewer), by the same hash; and the rows of each
    class in ``labelled``.  Raises if a class is lost."""
    count = lambda df: {r["y"]: r["n"] for r in df.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    of = count(labelled)
    share = {y: min(1.0, max(rows / 2, rows - sum(n for x, n in of.items() if x != y)) / n) for y, n in of.items()}
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id").cast("string")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    limit = F.create_map(*[F.lit(x) for ys in share.items() for x in ys])[F.col("y")] if share else F.lit(0.0)
    chosen = stored(labelled.filter(u < limit), "chosen")
    if set(count(chosen)) != set(of):
        raise RuntimeError(f"train_rows = {rows} leaves no labelled row of a class: {of}")
    return chosen, of


def one_each(rows: DataFrame) -> DataFrame:
    """One row of each ``doc_id`` (``text``, ``y``, ``fold``): repeated ids meet in a partial aggregate."""
    return rows.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.min("y").alias("y"), F.min("fold").alias("fold"))


def class_weights(y: np.ndarray, of: dict[int, int]) -> np.ndarray:
    """Each labelled row's weight, so that the sample's classes weigh as all labels' do (1 on average; others 1)."""
    out, known = np.ones(len(y)), np.isin(y, list(of))
    for c, n in of.items():
        out[y == c] = n / max((y == c).sum(), 1)
    out[known] /= out[known].mean() if known.any() else 1.0
    return out
