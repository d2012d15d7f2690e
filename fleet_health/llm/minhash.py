"""Near duplicates by DartMinHash signatures and banded joining.

A text is a weighted set of word shingles.  Each shingle has a seeded Poisson
process of darts on (weight, rank): its weight axis is cut into the regions
[0, 1), [1, 2), [2, 4), ..., in each of which the darts arrive by rank.  A text
is hit by the darts below its shingles' weights, and only those with a rank of
at most t / (total weight) are thrown, about t darts however many shingles there
are.  Each dart falls on one of k coordinates, the earliest dart of a coordinate
is the signature there; two texts agree in a coordinate with the probability of
their weighted Jaccard similarity.  Where a coordinate got no dart, the text's
darts are thrown again with twice the rank (t = k ln k + 2k makes that rare).

Bands of ``rows`` coordinates are joined; with 32 bands of 6 a pair of
similarity 0.8 is missed once in about 17,000.  Links are then checked exactly
on the shingle sets:

1. texts that are equal are one node from the start (hot groups of copies
   collapse in a partial aggregate);
2. each node is checked against the smallest of the smallest nodes of its
   buckets, then against the other buckets' smallest nodes that it is not yet
   linked with;
3. in buckets that still hold several classes, all members are joined with those
   outside the bucket's largest class, by steps of size, so that a large class
   is never compared with itself.  The pairs across classes are compared inside
   the join by their sizes and parity maps, at their first common bucket.  A shingle flips one bit of its text's map, so two maps differ in at
   most as many bits as the sets differ in shingles: a pair whose maps differ in
   more than the threshold allows cannot be a link, and no link is dropped.  The
   other pairs leave the join and are checked: nothing is capped.

So a large group of near copies costs one check a member, not one a pair, and
links inside a class that is known are not looked for.  Classes are connected
components of the links that hold.

Defined results: words are runs without ASCII white space, A-Z lower-cased; a
text of fewer than five words is one shingle of all of them; null texts and
texts without words have no links and are classes of their own (unless equal
texts repeat: null counts as empty and equal texts are always one class).  The
class id is the smallest id in it, null last.  Rows that repeat an id are rows of
their own.  An empty table gives an empty result.  Columns other than id and
text are not read.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Hasher, chunked, code_points, mix, unit, words
from .common import Masked, stored, text_of
from .graph import components

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 6
# bits of a text's parity map, and texts whose maps are made at a time
MAP_BITS = 1536
MAP_TEXTS = 512
_ODD = np.array([0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0x9FB21C651E98DF25,
                 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
_PLACE = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)  # a factor for each place in a shingle


def shingles(texts: list, n: int = SHINGLE):
    """(text number, shingle, count) of all distinct shingles, by text and shingle."""
    cp, bounds = code_points(texts)
    start, end, text = words(cp, bounds)
    h = Hasher(cp, lower=True).of(start, end)
    if not len(h):
        return text, h, text
    if len(h) >= n:
        full = text[: len(h) - n + 1] == text[n - 1:]
        acc = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            acc += h[k: len(h) - n + 1 + k] * _PLACE[k]
        s, t = mix(acc)[full], text[: len(h) - n + 1][full]
    else:
        s, t = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # texts of fewer words: all of them at once
    number = np.bincount(text, minlength=len(texts))
    place = np.arange(len(text)) - np.searchsorted(text, text)
    few = number[text] < n
    if few.any():
        part = mix(h[few] * _PLACE[place[few]])
        whole = np.zeros(len(texts), np.uint64)
        np.add.at(whole, text[few], part)
        short = np.unique(text[few])
        s, t = np.concatenate([s, mix(whole[short])]), np.concatenate([t, short])
    order = np.lexsort((s, t))
    s, t = s[order], t[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (t[1:] != t[:-1])
    at = np.flatnonzero(new)
    return t[at], s[at], np.diff(np.append(at, len(s)))


def _darts(element: np.ndarray, weight: np.ndarray, limit: np.ndarray, low: float, width: float):
    """(place of the element, rank, hash) of the darts of one weight region
    with a rank of at most the element's ``limit`` that lie below its weight."""
    live, rank, j, block = np.arange(len(element)), np.zeros(len(element)), 0, 4
    region = (np.array([low + 1]).astype(np.uint64) * _ODD[3])[0]
    out = []
    while len(live):
        e = mix(element[live] + region)
        ids = mix(e[:, None] + np.arange(j + 1, j + block + 1, dtype=np.uint64)[None, :] * _ODD[4])
        arrive = -np.log(unit(ids)) / width
        arrive[:, 0] += rank[live]
        np.cumsum(arrive, axis=1, out=arrive)
        hit = arrive <= limit[live][:, None]
        if low or not np.all(weight[live] >= 1):
            hit &= low + width * unit(mix(ids + _ODD[5])) < weight[live][:, None]
        row, col = np.nonzero(hit)
        out.append((live[row], arrive[row, col], ids[row, col]))
        rank[live] = arrive[:, -1]
        live = live[arrive[:, -1] <= limit[live]]
        j, block = j + block, min(block * 2, 64)
    return [np.concatenate(x) for x in zip(*out)]


def signatures(text: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """n x k ranks of the earliest darts; rows of texts without elements are inf."""
    total = np.bincount(text, weights=weight, minlength=n)
    sig = np.full(n * k, np.inf)
    darts = k * math.log(k) + 2 * k
    todo = np.flatnonzero(total > 0)
    while len(todo):
        mine = np.isin(text, todo) if len(todo) < n else np.ones(len(text), bool)
        t, e, w = text[mine], element[mine], weight[mine]
        limit = darts / total[t]
        low = 0.0
        while True:
            width = max(low, 1.0)
            some = w > low
            if not some.any():
                break
            at, rank, ids = _darts(e[some], w[some], limit[some], low, width)
            np.minimum.at(sig, t[some][at] * k + (mix(ids + _ODD[6]) % np.uint64(k)).astype(np.int64), rank)
            low += width
        # a coordinate is settled once a dart below the limit has hit it
        todo = todo[np.isinf(sig.reshape(n, k)[todo]).any(axis=1)]
        darts *= 2
    return sig.reshape(n, k)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """n x bands hashes, of the band's number and its coordinates."""
    bits = np.ascontiguousarray(sig).view(np.uint64).reshape(len(sig), bands, rows)
    acc = np.zeros((len(sig), bands), np.uint64)
    for r in range(rows):
        acc = mix(acc * _ODD[7] + bits[:, :, r] + np.uint64(r + 1))
    return mix(acc + np.arange(1, bands + 1, dtype=np.uint64)[None, :] * _ODD[1]).view(np.int64)


def parity_maps(text: np.ndarray, element: np.ndarray, n: int) -> np.ndarray:
    """n x (MAP_BITS / 64), for ``text`` in order: each bit is the parity of the number of the text's
    elements that fall on it.  Two maps differ in no more bits than the sets in elements."""
    out = np.empty((n, MAP_BITS // 64), np.int64)
    place = (element % np.uint64(MAP_BITS)).astype(np.int64)
    for lo in range(0, n, MAP_TEXTS):  # texts in order: their elements stand together
        hi = min(lo + MAP_TEXTS, n)
        own = slice(*np.searchsorted(text, [lo, hi]))
        odd = np.bincount((text[own] - lo) * MAP_BITS + place[own], minlength=(hi - lo) * MAP_BITS) & 1
        out[lo:hi] = np.packbits(odd.astype(bool).reshape(hi - lo, MAP_BITS), axis=1).view(np.int64)
    return out


def _lists(values: np.ndarray, sizes) -> pa.Array:
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def band_table(keyed: DataFrame, bands: int = BANDS, rows: int = ROWS, n: int = SHINGLE, counted: bool = False) -> DataFrame:
    """``keyed`` (``row_id``, ``doc_id``, ``key``, ``text``) with ``size``
    (distinct shingles), ``bands`` and ``parity``.  ``counted`` weighs a shingle by how
    often it occurs, else all weigh 1."""
    schema = (f"row_id bigint, doc_id {keyed.schema['doc_id'].dataType.simpleString()}, key binary, size bigint, "
              "bands array<bigint>, parity array<bigint>")

    def run(batches):
        for b in batches:
            for lo, hi, texts in chunked(b.column("text")):
                t, s, c = shingles(texts, n)
                m = hi - lo
                w = c.astype(np.float64) if counted else np.ones(len(s))
                sig = signatures(t, s, w, m, bands * rows)
                size = np.bincount(t, minlength=m)
                full = size > 0
                keys, bits = band_keys(sig[full], bands, rows), parity_maps(t, s, m)[full]
                p = b.slice(lo, m)
                yield pa.RecordBatch.from_arrays(
                    [p.column("row_id"), p.column("doc_id"), p.column("key"), pa.array(size, pa.int64()),
                     _lists(keys.ravel(), np.where(full, bands, 0)), _lists(bits.ravel(), np.where(full, bits.shape[1], 0))],
                    names=["row_id", "doc_id", "key", "size", "bands", "parity"])

    return keyed.select("row_id", "doc_id", "key", "text").mapInArrow(run, schema)


def shingle_sets(texts: DataFrame, n: int = SHINGLE) -> DataFrame:
    """``texts`` (``node``, ``text``) to (``node``, ``set``)."""

    def run(batches):
        for b in batches:
            for lo, hi, part in chunked(b.column("text")):
                t, s, _ = shingles(part, n)
                yield pa.RecordBatch.from_arrays(
                    [b.column("node").slice(lo, hi - lo), _lists(s.view(np.int64), np.bincount(t, minlength=hi - lo))],
                    names=["node", "set"])

    return texts.select("node", "text").mapInArrow(run, "node bigint, set array<bigint>")


def _can_match(a, b, threshold: float):
    return F.least(a, b) >= F.lit(threshold) * F.greatest(a, b)


def _may_link(a: str, b: str, size_a: str, size_b: str, threshold: float):
    """False only for pairs that cannot have the similarity: sets of it differ in at
    most (1 - threshold) / (1 + threshold) of their sizes' sum, their maps in no more bits."""
    differ = reduce(lambda u, v: u + v, [F.bit_count(F.col(a)[w].bitwiseXOR(F.col(b)[w])) for w in range(MAP_BITS // 64)])
    most = (1 - threshold) / (1 + threshold)
    return differ <= F.lit(most) * (F.col(size_a) + F.col(size_b)) + F.lit(1e-6)


def _checked(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The ``pairs`` (``a``, ``b``) whose sets have the similarity."""
    sa = sets.select(F.col("node").alias("a"), F.col("set").alias("sa"))
    sb = sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))
    p = pairs.join(sb, "b").join(sa, "a").filter(_can_match(F.size("sa"), F.size("sb"), threshold))
    common = F.size(F.array_intersect("sa", "sb"))
    return p.filter(common >= F.lit(threshold) * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def class_sides(classed: DataFrame, nodes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """``classed`` (``bucket``, ``node``, ``root``, ``size``, ...), for the
    buckets that hold several classes: all members, and those outside the
    bucket's largest class (``other``), by steps of size (``step``).  Members of
    the largest class never meet each other, and only sets whose sizes allow the
    similarity do, so a bucket costs about as many comparisons as it has pairs
    across classes."""
    per = classed.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    largest = per.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("x"), F.count(F.lit(1)).alias("classes"))
    largest = stored(largest.filter("classes > 1").select("bucket", F.col("x.root").alias("big")), "mixed")
    step = F.floor(F.log(F.greatest(F.col("size"), F.lit(1))) / F.lit(math.log(1 / threshold))).cast("int")
    maps = nodes.select("node", "bands", "parity")
    members = stored(classed.join(largest, "bucket").join(maps, "node").withColumn("step", step), "mixed_members")
    other = members.filter("root != big").withColumn("step", F.explode(F.array(*[F.col("step") + i for i in (-1, 0, 1)])))
    return members, other


def across_classes(classed: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (``a``, ``b``) of one bucket that are in different classes and may link."""
    members, other = class_sides(classed, nodes, threshold)
    x = members.select("bucket", "step", "big", F.col("node").alias("a"), F.col("root").alias("ra"), F.col("size").alias("na"),
                       F.col("bands").alias("ba"), F.col("parity").alias("pa"))
    y = other.select("bucket", "step", F.col("node").alias("b"), F.col("root").alias("rb"), F.col("size").alias("nb"),
                     F.col("bands").alias("bb"), F.col("parity").alias("pb"))
    # two outside the largest class meet twice, one inside it is only on the left
    return (x.join(y, ["bucket", "step"])
            .filter((F.col("ra") != F.col("rb")) & ((F.col("ra") == F.col("big")) | (F.col("a") < F.col("b")))
                    & _can_match(F.col("na"), F.col("nb"), threshold) & _may_link("pa", "pb", "na", "nb", threshold)
                    & (F.array_intersect("ba", "bb")[0] == F.col("bucket"))).select("a", "b"))


def near_links(nodes: DataFrame, texts: DataFrame, threshold: float = THRESHOLD, n: int = SHINGLE) -> DataFrame:
    """Links (``a``, ``b``) that give the classes of ``nodes`` (``node``,
    ``key``, ``size``, ``bands``, ``parity``); ``texts`` has ``key`` and ``text``."""
    rows = nodes.select("node", "size", F.explode("bands").alias("bucket"))
    first = rows.groupBy("bucket").agg(F.min("node").alias("rep"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    hits = stored(rows.join(first.select("bucket", "rep"), "bucket"), "hits")

    wanted = hits.select("node").distinct().join(nodes.select("node", "key"), "node")
    # equal texts have one key: copies meet in a partial aggregate
    found = texts.join(wanted, "key").groupBy("node").agg(F.first("text").alias("text"))
    sets = stored(shingle_sets(found, n), "sets")

    star = hits.groupBy("node").agg(F.min("rep").alias("a")).filter("a != node").select("a", F.col("node").alias("b"))
    links = stored(_checked(star, sets, threshold), "links")

    # the other buckets' smallest nodes that are not in the same class yet
    roots = stored(components(links), "roots")
    classed = hits.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = hits.groupBy("node").agg(F.min("rep").alias("tried"))
    of_rep = roots.select(F.col("node").alias("rep"), F.col("root").alias("rep_root"))
    more = (classed.filter("rep != node").join(smallest, "node").filter("rep != tried")
            .select("node", "rep", "root").distinct().join(of_rep, "rep", "left")
            .filter(F.coalesce("rep_root", "rep") != F.col("root"))
            .select(F.col("rep").alias("a"), F.col("node").alias("b")))
    links = stored(links.unionByName(_checked(more, sets, threshold)), "links")

    # pairs across classes in the buckets that still hold several
    roots = stored(components(links), "roots")
    classed = hits.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    across = across_classes(classed, nodes, threshold)
    return stored(links.unionByName(_checked(across, sets, threshold)), "links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
                    bands: int = BANDS, rows: int = ROWS, n: int = SHINGLE, counted: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``class_id`` (smallest id of its
    class), ``class_size`` (rows), ``first`` (true for one row of each class, one
    with the smallest id) and ``key`` (MD5 of the text)."""
    d = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).withColumn("key", F.unhex(F.md5("text")))
    table = stored(band_table(d.withColumn("row_id", F.monotonically_increasing_id()), bands, rows, n, counted), "bands")
    nodes = (table.groupBy("key").agg(F.min(F.struct("row_id", "size", "bands", "parity")).alias("x"))
             .select(F.col("x.row_id").alias("node"), "key", F.col("x.size").alias("size"), F.col("x.bands").alias("bands"),
                     F.col("x.parity").alias("parity")))
    nodes = stored(nodes, "nodes")
    links = near_links(nodes, d.select("key", "text"), threshold, n)
    roots = components(links)
    of_key = nodes.select("key", "node").join(roots, "node", "left").select("key", F.coalesce("root", "node").alias("root"))
    member = stored(table.select("row_id", "doc_id", "key").join(of_key, "key"), "members")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.col("row_id").alias("row_id"))
    best = member.groupBy("root").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("class_size"))
    return member.join(best, "root").select(
        "doc_id", F.col("best.doc_id").alias("class_id"), "class_size",
        (F.col("row_id") == F.col("best.row_id")).alias("first"), "key")


def first_of_each_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """``docs`` with one document of each class.  Rows that repeat the id and
    text of one that stays are copies of it and go."""
    m = Masked(docs)
    id_, text_ = m.of(id_col), m.of(text_col)
    keep = near_duplicates(m.df, id_, text_, **params).filter("first").select("doc_id", "key")
    own = m.df.withColumn("own", F.unhex(F.md5(text_of(text_))))
    kept = own.join(keep, (F.col("own") == F.col("key")) & F.col(id_).eqNullSafe(F.col("doc_id")), "left_semi")
    return m.back(kept.dropDuplicates(["own", id_]))
