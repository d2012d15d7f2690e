"""The searches take all rows of the table."""
import numpy as np
import pytest

from fleet_health.models import grids, iforest
from fleet_health.models.grown import class_tree

ONE = {"n_estimators": (12,), "max_depth": (None,), "min_samples_split": (2,), "min_samples_leaf": (1,), "class_weight": ("balanced",)}


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(5)
    x = rng.random((16000, 2))
    odd = rng.random((20, 20)) < 0.3  # a pattern of 400 cells, some 40 rows each
    y = odd[(x[:, 0] * 20).astype(int), (x[:, 1] * 20).astype(int)].astype(int)
    return spark.createDataFrame([(i, int(c), *map(float, v)) for i, (c, v) in enumerate(zip(y, x))],
                                 "sample_id bigint, is_anomaly int, a double, b double").repartition(4).cache()


def test_fits_take_all_rows_of_their_folds(cells):
    whole = grids.forest_grid(cells, ["a", "b"], ONE, k=2).first().mean_f1
    part = grids.forest_grid(cells, ["a", "b"], ONE, k=2, train_rows=2000).first().mean_f1
    assert whole > part + 0.05


def test_a_table_that_is_not_gathered_is_fitted_whole_in_batches(cells):
    both = {**ONE, "n_estimators": (2, 4)}
    rows = grids.forest_grid(cells, ["a", "b"], both, k=2, gather_bytes=0, batch_nodes=4000).collect()
    here = {r.n_estimators: r.mean_f1 for r in grids.forest_grid(cells, ["a", "b"], both, k=2).collect()}
    assert len(rows) == 2 and all(abs(r.mean_f1 - here[r.n_estimators]) < 0.1 for r in rows)


def test_a_tree_grown_in_place_separates_and_stops():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 32, (3000, 4)).astype("uint8")
    y = ((x[:, 1] > 15) ^ (x[:, 2] > 20)).astype("uint8")
    held = np.arange(0, 3000, 3)
    times = np.ones(3000, int)
    times[held] = 0
    out = class_tree(x, y, times, held, (1.0, 1.0), 1, [(30, 2), (0, 2), (30, 5000)], 4, rng)
    assert (np.abs(out[0] - y[held]) > 0.5).mean() < 0.01  # both cuts are found
    share = y[times > 0].mean()
    assert np.allclose(out[1:], share)  # a tree of depth 0, a node too small to split
    leaf = class_tree(x, y, times, held, (1.0, 1.0), 1500, [(30, 2)], 4, rng)
    assert np.allclose(leaf, share)


def _far(spark, n=800):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(n - 20, 3)), rng.normal(size=(20, 3)) + 9])
    return spark.createDataFrame([(i, int(i >= n - 20), *map(float, v)) for i, v in enumerate(x)],
                                 "sample_id bigint, is_anomaly int, a double, b double, c double").repartition(3)


def test_isolation_trees_take_their_share_of_the_whole_table(spark, monkeypatch):
    """Rows beyond any fixed number are drawn: the sizes asked for are shares of all."""
    asked = []
    real = iforest._limit
    monkeypatch.setattr(iforest, "_gathered_paths", lambda df, feats, label, e, kinds, psis, counts, seed: asked.extend([e, *psis]) or df.selectExpr(
        "_id", label, f"array_repeat(1.0D, {len(kinds) * len(counts)}) AS sums"))
    df = spark.range(5000).selectExpr("id AS sample_id", "CAST(id = 7 AS INT) AS is_anomaly", "id * 1.0D AS a")
    assert iforest.search(df, ["a"], "is_anomaly").count() == 81
    assert asked == [5000] + [256] * 3 + [2500] * 3 + [4000] * 3 and real(4000) == 12


@pytest.mark.parametrize("gather, task_rows", [(1 << 27, 100), (0, 100)])
def test_isolation_search_by_either_way(spark, monkeypatch, gather, task_rows):
    monkeypatch.setattr(iforest, "FEW_ROWS", 300)
    monkeypatch.setattr(iforest, "TOP_TREES", {True: 10, False: 10})
    grid = {"n_estimators": (10, 20), "contamination": (0.025,), "max_samples": ("auto", 0.8), "max_features": (1.0,)}
    rows = iforest.search(_far(spark), ["a", "b", "c"], "is_anomaly", grid, gather_bytes=gather, task_rows=task_rows).collect()
    assert len(rows) == 4 and all(abs(r.precision - r.recall) < 1e-9 for r in rows)
    assert all(r.recall > (0.85 if r.max_samples == "auto" else 0.6) for r in rows), rows


def test_paths_of_a_tree_that_holds_all_rows():
    from fleet_health.models.grown import c_factor, isolation_paths
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 3))
    x[:40] = x[0]  # rows that no cut parts
    member = np.ones(500, bool)
    h = isolation_paths(x, member, 1000, 3, rng)
    assert len(set(h[:40])) == 1 and h[0] >= c_factor([40])[0]
    # every other row stands alone, so by Kraft's sum the leaves fill the tree
    assert abs((2.0 ** -h[40:]).sum() + 2.0 ** -(h[0] - c_factor([40])[0]) - 1) < 1e-9
    h = isolation_paths(x, member, 9, 2, rng)
    assert h.min() >= 1 and (h <= 9 + c_factor([500])[0]).all()
    flat = np.zeros((50, 5))
    assert np.allclose(isolation_paths(flat, np.ones(50, bool), 9, 5, rng), c_factor([50])[0])
    flat[:25, 3] = 1.0
    got = isolation_paths(flat, np.ones(50, bool), 9, 5, rng)
    assert np.allclose(got, 1 + c_factor([25])[0])  # the one feature that varies is found
