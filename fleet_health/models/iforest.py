"""Isolation forest (M1) and its parameter search (M2).

Training: every tree gets exactly psi distinct rows, the first ones by a hash
of (id, tree).  They come from a pool of about ``POOL`` x n_trees x psi rows
drawn by another hash, so the expansion to tree ids does not grow with the
table; ``fit`` raises if a tree falls short.  Trees are grown in parallel, one ``applyInPandas`` group per tree.  The fitted forest has at
most n_trees x (2 x max_samples - 1) nodes - a model-sized object - and is
broadcast for scoring, which runs vectorised in ``mapInPandas``.

Definitions (Liu, Ting, Zhou 2008): psi = min(max_samples, n); height
limit ceil(log2 psi); a node picks a random feature and a uniform cut
between the node's min and max; a leaf of size m adds c(m) = 2 H(m - 1) -
2 (m - 1) / m; score = 2 ^ (-E[h(x)] / c(psi)).
"""

from __future__ import annotations

import math
import uuid
from itertools import product
from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import series
from ..operators.knn import top_share
from ..operators.labels import RANK_BUCKETS
from ..schema import SAMPLE
from ..session import checkpoint_path, materialize
from .grown import c_factor, isolation_paths, one_cut

POOL = 4.0  # rows to choose from, per row wanted
GATHER_BYTES = 1 << 27  # features of a table that each task of a search holds in memory
TASK_TREES = 10
SCORED_ROWS = 1 << 14  # rows whose sums of path lengths stand in one value
TASK_ROWS = 1 << 16  # rows of a node that a task takes over from the top of a tree
FEW_ROWS = 1 << 12  # trees of up to so many rows have tops only
TOP_TREES = {True: 32, False: 4}  # trees whose tops are grown together: of few rows, of many
# fixed values: the grid of the search
SEARCH_GRID = {"n_estimators": (50, 100, 200), "max_samples": ("auto", 0.5, 0.8), "contamination": (0.005, 0.01, 0.02),
               "max_features": (0.5, 0.8, 1.0)}
NODE_SCHEMA = ("tree int, node int, feature int, threshold double, left int, right int, "
               "size long, depth int")


def _grow(tree_id: int, x: np.ndarray, seed: int, max_features: int) -> list[tuple]:
    rng = np.random.RandomState(seed + tree_id)
    limit = int(math.ceil(math.log2(max(len(x), 2))))
    nodes = []

    def build(idx, depth):
        me = len(nodes)
        nodes.append(None)
        sub = x[idx]
        if depth >= limit or len(idx) <= 1:
            nodes[me] = (tree_id, me, -1, 0.0, -1, -1, len(idx), depth)
            return me
        feats = rng.choice(x.shape[1], size=max_features, replace=False) if max_features < x.shape[1] \
            else np.arange(x.shape[1])
        lo, hi = sub[:, feats].min(axis=0), sub[:, feats].max(axis=0)
        ok = np.where(hi > lo)[0]
        if len(ok) == 0:
            nodes[me] = (tree_id, me, -1, 0.0, -1, -1, len(idx), depth)
            return me
        j = ok[rng.randint(len(ok))]
        f = int(feats[j])
        t = float(rng.uniform(lo[j], hi[j]))
        left_idx, right_idx = idx[sub[:, f] < t], idx[sub[:, f] >= t]
        left = build(left_idx, depth + 1)
        right = build(right_idx, depth + 1)
        nodes[me] = (tree_id, me, f, t, left, right, len(idx), depth)
        return me

    build(np.arange(len(x)), 0)
    return nodes


def fit(df: DataFrame, features: Sequence[str], n_trees: int = 100, max_samples: int | float | str = 256,
        max_features: float = 1.0, seed: int = 42, id_col: str = SAMPLE) -> dict:
    """Grow the forest; returns the (small) model: node table and psi.
    ``max_samples`` is a number of rows, a share of them (float) or 'auto' (256)."""
    feats = list(features)
    n = df.count()
    if max_samples == "auto":
        max_samples = 256
    psi = int(min(max_samples * n if isinstance(max_samples, float) else max_samples, n))
    if psi < 1:
        raise ValueError("an isolation forest needs at least one row")
    draw = lambda *salt: F.pmod(F.xxhash64(F.col("_id"), *[F.lit(seed) if x is None else x for x in salt]), F.lit(1 << 52)) \
        / F.lit(float(1 << 52))
    # a pool for all trees, and of it four times psi rows to each tree to choose from
    q = min(1.0, POOL * n_trees * psi / n)
    r = min(1.0, POOL * psi / (n * q))
    pool = df.select(F.col(id_col).alias("_id"), *[F.col(c).cast("double").alias(c) for c in feats]) \
             .filter(draw(None, F.lit("pool")) < q)
    per_tree = pool.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("tree"))
    per_tree = per_tree.withColumn("_u", draw(None, F.col("tree"))).filter(F.col("_u") < r)
    mf = max(1, int(round(max_features * len(feats)))) if max_features <= 1.0 else int(max_features)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_u", "_id"]).head(psi)
        t = int(pdf["tree"].iloc[0])
        rows = _grow(t, pdf[feats].to_numpy(dtype="float64"), seed, mf)
        return pd.DataFrame(rows, columns=["tree", "node", "feature", "threshold", "left", "right",
                                           "size", "depth"])

    nodes = per_tree.groupBy("tree").applyInPandas(grow, NODE_SCHEMA).toPandas()
    roots = nodes[nodes["node"] == 0]
    if len(roots) != n_trees or (roots["size"] != psi).any():
        raise RuntimeError(f"{len(roots)} of {n_trees} trees grew, on {sorted(set(roots['size']))} rows instead of {psi}")
    return {"nodes": nodes, "psi": psi, "features": feats, "n_trees": n_trees}


def _tree_arrays(nodes: pd.DataFrame) -> list[tuple]:
    """Per tree: feature, threshold, left, right, path length of a leaf, height."""
    out = []
    for _t, g in nodes.groupby("tree"):
        g = g.sort_values("node")
        depth = g["depth"].to_numpy()
        out.append((g["feature"].to_numpy(), g["threshold"].to_numpy(), g["left"].to_numpy(), g["right"].to_numpy(),
                    depth + c_factor(g["size"].to_numpy()), int(depth.max())))
    return out


def _path_lengths(trees: list[tuple], x: np.ndarray) -> np.ndarray:
    total, flat, base = np.zeros(len(x)), np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
    for tree in trees:
        total += _depths(tree, flat, base)
    return total / len(trees)


def score(model: dict, df: DataFrame, contamination: float | None = 0.01,
          id_col: str = SAMPLE) -> DataFrame:
    """Anomaly score per row; with ``contamination`` the top share is flagged."""
    spark = df.sparkSession
    bc = spark.sparkContext.broadcast(model)  # bounded: n_trees x (2 psi - 1) nodes
    feats = model["features"]
    cpsi = float(c_factor([model["psi"]])[0]) or 1.0
    out_schema = T.StructType(list(df.schema.fields) + [T.StructField("anomaly_score", T.DoubleType())])

    def run(batches):
        trees = [_descents(t) for t in _tree_arrays(bc.value["nodes"])]
        for pdf in batches:
            x = pdf[feats].to_numpy(dtype="float64")
            h = _path_lengths(trees, x) if len(pdf) else np.zeros(0)
            yield pdf.assign(anomaly_score=np.power(2.0, -h / cpsi))

    scored = df.mapInPandas(run, out_schema)
    if contamination is None:
        return scored
    return top_share(scored, "anomaly_score", contamination, "prediction_flag", id_col) \
        .withColumn("prediction", F.col("prediction_flag").cast("int")).drop("prediction_flag")


def _gathered_paths(df: DataFrame, feats: list[str], label: str, e: int, kinds: list[tuple], psis: list[int], counts: list[int],
                    seed: int) -> DataFrame:
    """``_id``, label and the sums of the path lengths in the first trees of each kind,
    for a table that tasks can hold: each grows trees and follows all rows."""
    spark = df.sparkSession
    rows = df.orderBy("_h", "_id").toPandas()  # GATHER_BYTES
    x = np.ascontiguousarray(rows[feats].to_numpy("float64"))
    held = spark.sparkContext.broadcast((x, rows["_id"].to_numpy(), rows[label].to_numpy()))
    parts = [(i, j, range(a, min(a + TASK_TREES, c))) for i in range(len(kinds)) for j, c in enumerate(counts)
             for a in range(counts[j - 1] if j else 0, c, TASK_TREES)]
    parts.sort(key=lambda p: -psis[p[0]])

    def grow(batches):
        x = held.value[0]
        for pdf in batches:
            for task in pdf["id"]:
                kind, cut, trees = parts[task]
                total, psi = np.zeros(len(x)), psis[kind]
                for tree in trees:
                    rng = np.random.default_rng([seed, kind, tree])
                    member = np.zeros(len(x), bool)
                    member[rng.choice(e, psi, replace=False)] = True
                    total += isolation_paths(x, member, _limit(psi), _tried(kinds[kind], feats), rng)
                for b in range(0, len(x), SCORED_ROWS):
                    yield pd.DataFrame({"kind": [kind], "cut": [cut], "block": [b], "sums": [total[b:b + SCORED_ROWS].tobytes()]})

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        _, ids, marks = held.value
        b = int(pdf["block"].iloc[0])
        some = slice(b, b + SCORED_ROWS)
        total = np.zeros((len(kinds), len(counts), len(ids[some])))
        for kind, cut, sums in zip(pdf["kind"], pdf["cut"], pdf["sums"]):
            total[kind, cut:] += np.frombuffer(sums)
        return pd.DataFrame({"_id": ids[some], label: marks[some], "sums": total.reshape(-1, total.shape[2]).T.tolist()})

    sums = spark.range(0, len(parts), 1, len(parts)).mapInPandas(grow, "kind int, cut int, block long, sums binary")
    schema = T.StructType([df.schema["_id"], df.schema[label], T.StructField("sums", T.ArrayType(T.DoubleType()))])
    return sums.groupBy("block").applyInPandas(gather, schema)


def _limit(psi: int) -> int:
    return int(math.ceil(math.log2(max(psi, 2))))


def _tried(kind: tuple, feats: list[str]) -> int:
    return max(1, round(kind[1] * len(feats)))


def _walk(top: dict, x: np.ndarray) -> np.ndarray:
    """The node of a tree's top where each row stands."""
    feature, cut, child = np.array(top["feature"]), np.array(top["cut"]), np.array(top["child"])
    at = np.zeros(len(x), np.int64)
    while True:
        go = np.flatnonzero(feature[at] >= 0)
        if not len(go):
            return at
        now = at[go]
        at[go] = child[now] + (x[go, feature[now]] >= cut[now])


def _routed_paths(df: DataFrame, feats: list[str], label: str, e: int, kinds: list[tuple], psis: list[int], counts: list[int],
                  seed: int, task_rows: int) -> DataFrame:
    """As ``_gathered_paths`` for any table: the tops of some trees at a time grow by
    the extremes of their nodes, taken over all partitions; nodes of up to
    ``task_rows`` rows are sent, with their rows, to a task that grows the rest.  A
    tree's rows are a share of each partition, drawn for all of them at once."""
    spark, d = df.sparkSession, len(feats)
    if e < df.count():
        last = df.select("_h", "_id").orderBy("_h", "_id").limit(e).agg(F.max("_h")).first()[0]
        df = df.withColumn("_e", F.col("_h") <= last)
    else:
        df = df.withColumn("_e", F.lit(True))

    def pack(batches):
        for pdf in batches:
            x = np.ascontiguousarray(pdf[feats].to_numpy("float64"))
            yield pdf[["_id", label, "_e"]].assign(_x=[r.tobytes() for r in x])

    packed = df.mapInPandas(pack, T.StructType([df.schema["_id"], df.schema[label], T.StructField("_e", T.BooleanType()),
                                                T.StructField("_x", T.BinaryType())]))
    data = materialize(packed.select("*", F.monotonically_increasing_id().alias("_n"), F.spark_partition_id().alias("_part")))
    sizes = {r["_part"]: r["n"] for r in data.groupBy("_part").agg(F.count_if("_e").alias("n")).collect()}  # a row per partition
    whole = sum(sizes.values())

    def drawn(kind: int, tree: int) -> dict:
        n = np.random.default_rng([seed, kind, tree]).multivariate_hypergeometric([*sizes.values()], min(psis[kind], whole), method="marginals")
        return dict(zip(sizes, n.tolist()))

    def batch(kind: int, trees: range, to: str):
        """Writes ``_n`` and the sum of the row's path lengths in ``trees``."""
        few, limit, tried = psis[kind] <= FEW_ROWS, _limit(psis[kind]), _tried(kinds[kind], feats)
        draws = {t: drawn(kind, t) for t in trees}
        tops = {t: {"feature": [-1], "cut": [0.0], "child": [-1], "depth": [0], "size": [0], "state": ["open"]} for t in trees}

        def standing(batches):
            """(rows, features, per tree: members, nodes) of each batch of rows."""
            members, start = None, 0
            for pdf in batches:
                if not len(pdf):
                    continue
                if members is None:
                    part, members = int(pdf["_part"].iloc[0]), {}
                    for t in trees:
                        members[t] = np.zeros(sizes[part], bool)
                        members[t][np.random.default_rng([seed, kind, t, part]).choice(sizes[part], draws[t][part], replace=False)] = True
                x, can = np.frombuffer(b"".join(pdf["_x"])).reshape(len(pdf), d), pdf["_e"].to_numpy("bool")
                many = int(can.sum())
                for t in trees:
                    mine = np.zeros(len(pdf), bool)
                    mine[can] = members[t][start:start + many]
                    yield pdf, x, t, mine, _walk(tops[t], x)
                start += many

        def extremes(batches):
            seen = {}
            for pdf, x, t, mine, at in standing(batches):
                asked = np.array([s == "open" for s in tops[t]["state"]])
                for node in np.unique(at[asked[at] & mine] if few else at[asked[at]]):
                    rows = at == node
                    n, s, lo, hi = seen.get((t, node), (0, 0, np.full(d, np.inf), np.full(d, -np.inf)))
                    v = x[rows & mine]
                    if len(v):
                        lo, hi = np.minimum(lo, v.min(axis=0)), np.maximum(hi, v.max(axis=0))
                    seen[t, node] = n + int(rows.sum()), s + len(v), lo, hi
            for (t, node), (n, s, lo, hi) in seen.items():
                yield pd.DataFrame({"tree": [t], "node": [node], "n": [n], "s": [s], "lo": [lo.tobytes()], "hi": [hi.tobytes()]})

        def merge(pdf: pd.DataFrame) -> pd.DataFrame:
            lo, hi = (np.frombuffer(b"".join(pdf[c])).reshape(len(pdf), d) for c in ("lo", "hi"))
            return pd.DataFrame({"tree": pdf["tree"].iloc[:1], "node": pdf["node"].iloc[:1], "n": [pdf["n"].sum()], "s": [pdf["s"].sum()],
                                 "lo": [lo.min(axis=0).tobytes()], "hi": [hi.max(axis=0).tobytes()]})

        schema = "tree int, node long, n long, s long, lo binary, hi binary"
        while any("open" in top["state"] for top in tops.values()):
            found = data.mapInPandas(extremes, schema).groupBy("tree", "node").applyInPandas(merge, schema).toPandas()  # a row per open node
            known = {(r.tree, r.node): r for r in found.itertuples()}
            for t, top in tops.items():
                for node in [i for i, s in enumerate(top["state"]) if s == "open"]:
                    r, depth = known.get((t, node)), top["depth"][node]
                    top["state"][node], top["size"][node] = "leaf", r.s if r else 0
                    if r is None or r.s <= 1 or depth >= limit:
                        continue
                    if not few and r.n <= task_rows:
                        top["state"][node] = "sent"
                        continue
                    f, cut = one_cut(np.frombuffer(r.lo), np.frombuffer(r.hi), tried, np.random.default_rng([seed, kind, t, node, 1]))
                    if f < 0:
                        continue
                    top["feature"][node], top["cut"][node], top["child"][node], top["state"][node] = f, cut, len(top["state"]), "split"
                    for _ in range(2):
                        for k, v in (("feature", -1), ("cut", 0.0), ("child", -1), ("depth", depth + 1), ("size", 0), ("state", "open")):
                            top[k].append(v)

        def ended(batches):
            for pdf, _, t, _, at in standing(batches):
                leaf = np.array([s == "leaf" for s in tops[t]["state"]])
                path = np.array(tops[t]["depth"]) + c_factor(tops[t]["size"])
                rows = leaf[at]
                yield pd.DataFrame({"_n": pdf["_n"][rows], "path": path[at[rows]]})

        def sent(batches):
            for pdf, _, t, mine, at in standing(batches):
                rows = np.array([s == "sent" for s in tops[t]["state"]])[at]
                yield pdf.loc[rows, ["_n", "_x"]].assign(tree=t, node=at[rows], member=mine[rows])

        def rest(pdf: pd.DataFrame) -> pd.DataFrame:
            t, node = int(pdf["tree"].iloc[0]), int(pdf["node"].iloc[0])
            pdf = pdf.sort_values("_n")
            x = np.frombuffer(b"".join(pdf["_x"])).reshape(len(pdf), d)
            rng = np.random.default_rng([seed, kind, t, node, 2])
            return pd.DataFrame({"_n": pdf["_n"], "path": isolation_paths(x, pdf["member"].to_numpy("bool"), limit, tried, rng, tops[t]["depth"][node])})

        paths = data.mapInPandas(ended, "_n long, path double")
        if any("sent" in top["state"] for top in tops.values()):
            moved = data.mapInPandas(sent, "_n long, _x binary, tree int, node long, member boolean")
            paths = paths.unionByName(moved.groupBy("tree", "node").applyInPandas(rest, "_n long, path double"))
        paths.groupBy("_n").agg(F.sum("path").alias("path")).write.mode("overwrite").parquet(to)

    place, done = checkpoint_path(spark, f"paths-{uuid.uuid4().hex}"), []
    for kind, psi in enumerate(psis):
        step, kept = TOP_TREES[psi <= FEW_ROWS], None
        for cut, c in enumerate(counts):
            for a in range(counts[cut - 1] if cut else 0, c, step):
                batch(kind, range(a, min(a + step, c)), f"{place}/new")
                new = spark.read.parquet(f"{place}/new")
                both = new if kept is None else spark.read.parquet(kept).unionByName(new).groupBy("_n").agg(F.sum("path").alias("path"))
                kept = f"{place}/{kind}-{cut}" if a + step >= c else f"{place}/sums-{(a // step) % 2}"
                both.write.mode("overwrite").parquet(kept)
            done.append(spark.read.parquet(kept).select("_n", F.lit(len(done)).alias("_model"), "path"))
    every = done[0]
    for one in done[1:]:
        every = every.unionByName(one)
    sums = every.groupBy("_n").agg(F.array(*[F.sum(F.when(F.col("_model") == i, F.col("path"))) for i in range(len(done))]).alias("sums"))
    return data.select("_n", "_id", label).join(sums, "_n").drop("_n")


def search(df: DataFrame, features: Sequence[str], label: str, grid: dict | None = None, seed: int = 42,
           fit_rows: int | None = None, id_col: str = SAMPLE, gather_bytes: int = GATHER_BYTES, task_rows: int = TASK_ROWS) -> DataFrame:
    """M2: precision, recall and F1 of every point of ``grid`` from few forests: the
    first 50 trees of 200 are a 50-tree forest, and contamination is a cut of one
    score, so 81 points take 9 forests.  Every tree grows on ``max_samples`` rows of
    the whole table (of ``fit_rows`` rows of it where that is given, the first by a
    hash of the id); all rows are scored and ranked.  Trees of half the table are
    not kept: the rows to be scored go down while a tree grows."""
    g = {**SEARCH_GRID, **(grid or {})}
    spark, feats = df.sparkSession, list(features)
    n = df.count()
    e = min(n, fit_rows or n)
    draw = F.pmod(F.xxhash64(F.col("_id"), F.lit(seed), F.lit("rows")), F.lit(1 << 40))
    rows = df.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias(label), *[F.col(c).cast("double") for c in feats]) \
        .withColumn("_h", draw)
    counts = sorted(g["n_estimators"])
    kinds = list(product(g["max_samples"], g["max_features"]))
    psis = [min(256 if m == "auto" else int(m * e) if isinstance(m, float) else int(m), e) for m, _ in kinds]
    if not n or min(psis) < 1:
        raise ValueError("an isolation forest needs at least one row")
    if n * len(feats) * 8 <= gather_bytes:
        sums = _gathered_paths(rows, feats, label, e, kinds, psis, counts, seed)
    else:
        sums = _routed_paths(rows, feats, label, e, kinds, psis, counts, seed, task_rows)
    each = [(t, float(c_factor([p])[0]) or 1.0) for p in psis for t in counts]
    scored = sums.select("_id", label, F.array(*[F.pow(F.lit(2.0), -F.col("sums")[i] / t / c) for i, (t, c) in enumerate(each)]).alias("scores"))
    held = materialize(scored)  # a row per input row, read twice below
    each = held.select("_id", label, F.posexplode("scores").alias("model", "score"))
    each = each.withColumn("_cell", F.floor((1 - F.col("score")) * RANK_BUCKETS))
    # rows of a bucket above a cut are flagged without being ranked: only the bucket that a cut divides is
    y = F.col(label) == 1
    sizes = each.groupBy("model", "_cell").agg(F.count(F.lit(1)).alias("_n"), F.count_if(y).alias("_y"))
    before = Window.partitionBy("model").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    sizes = materialize(sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))))  # bounded: models x buckets
    cuts = list(g["contamination"])
    want = [math.ceil(n * c) for c in cuts]
    ends = F.col("_before") + F.col("_n")
    parted = F.lit(False)
    for w in want:
        parted = parted | ((F.col("_before") < w) & (ends > w))
    divided = sizes.filter(parted).select("model", "_cell", "_before")
    inside = each.join(F.broadcast(divided), ["model", "_cell"])  # at most a row per model and cut
    ranked = series.global_position(inside, ["model", "_cell", 1 - F.col("score"), "_id"], "_at")
    ranked = materialize(ranked.select("model", "_cell", "_before", y.alias("_hit"), "_at"))
    least = ranked.groupBy("model", "_cell").agg(F.min("_at").alias("_first"))
    ranked = ranked.join(F.broadcast(least), ["model", "_cell"]).withColumn("_rank", F.col("_before") + F.col("_at") - F.col("_first") + 1)
    whole = sizes.groupBy("model").agg(
        F.sum("_y").alias("y"), *[f for i, w in enumerate(want) for f in (
            F.sum(F.when(ends <= w, F.col("_y")).otherwise(0)).alias(f"tp{i}"), F.sum(F.when(ends <= w, F.col("_n")).otherwise(0)).alias(f"n{i}"))])
    part = ranked.groupBy("model", "_cell").agg(*[f for i, w in enumerate(want) for f in (
        F.count_if(F.col("_hit") & (F.col("_rank") <= w)).alias(f"_tp{i}"), F.count_if(F.col("_rank") <= w).alias(f"_n{i}"))])
    part = part.join(divided.join(sizes.select("model", "_cell", "_n"), ["model", "_cell"]), ["model", "_cell"])
    part = part.groupBy("model").agg(*[f for i, w in enumerate(want) for f in (
        F.sum(F.when(F.col("_before") + F.col("_n") > w, F.col(f"_tp{i}")).otherwise(0)).alias(f"_tp{i}"),
        F.sum(F.when(F.col("_before") + F.col("_n") > w, F.col(f"_n{i}")).otherwise(0)).alias(f"_n{i}"))])
    wide = whole.join(part, "model", "left").select("model", "y", *[
        (F.col(f"{k}{i}") + F.coalesce(F.col(f"_{k}{i}"), F.lit(0))).alias(f"{k}{i}") for i in range(len(cuts)) for k in ("tp", "n")])
    per = wide.select("model", "y", F.inline(F.array(*[F.struct(F.lit(float(c)).alias("contamination"), F.col(f"tp{i}").alias("tp"),
                                                                F.col(f"n{i}").alias("flagged")) for i, c in enumerate(cuts)])))
    names = spark.createDataFrame([(i, t, str(m), float(mf)) for i, ((m, mf), t) in enumerate(product(kinds, counts))],
                                  "model int, n_estimators int, max_samples string, max_features double")
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return (names.join(per, "model").select(
        "n_estimators", "max_samples", "contamination", "max_features", ratio(F.col("tp"), F.col("flagged")).alias("precision"),
        ratio(F.col("tp"), F.col("y")).alias("recall"), ratio(2.0 * F.col("tp"), F.col("flagged") + F.col("y")).alias("f1")))


def _descents(tree: tuple) -> tuple:
    """A tree for ``_depths``: the feature, cut and [right, left] children of each
    node; a leaf is its own child, so rows that have arrived stay."""
    feature, threshold, left, right, length, height = tree
    inner, me = feature >= 0, np.arange(len(feature))
    nxt = np.stack([np.where(inner, right, me), np.where(inner, left, me)], axis=1).ravel()
    return np.where(inner, feature, 0), threshold, nxt, length, height


def _depths(tree: tuple, flat: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Path length of each row in one tree; row i starts at ``base[i]`` of ``flat``."""
    feature, threshold, nxt, length, height = tree
    at = np.zeros(len(base), np.int64)
    for _ in range(height):
        at = nxt[2 * at + (flat[base + feature[at]] < threshold[at])]
    return length[at]
