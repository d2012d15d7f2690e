"""The registered ENN and LOF over all rows against global brute force on a small
table whose hosts have fewer rows than k."""
import inspect

import numpy as np
import __spark_entry__ as E
from fleet_health.operators import knn as N
from fleet_health.plans import models, neighbors

N_ROWS, FEATS = 90, ["f_cpu", "f_memory", "f_disk"]


def _table(spark):
    x = (10 * np.random.RandomState(6).normal(size=(N_ROWS, 3))).round()  # whole numbers: exact ties
    y = (np.random.RandomState(7).rand(N_ROWS) < 0.2).astype(int)
    rows = [(i % 10, i, int(y[i]), *map(float, x[i])) for i in range(N_ROWS)]
    return x, y, spark.createDataFrame(rows, "host_id long, sample_id long, is_anomaly int, f_cpu double, f_memory double, f_disk double")


def _near(x, k):
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)
    return d, [sorted((d[i, j], j) for j in range(len(x)) if j != i)[:k] for i in range(len(x))]


def test_enn_over_all_rows(spark, monkeypatch):
    x, y, df = _table(spark)
    monkeypatch.setattr(neighbors, "points", lambda *_: df)
    got = {r.sample_id for r in E.queries()["edited_nearest_neighbours_global"](spark, "").collect()}
    assert got == {i for i, nb in enumerate(_near(x, 3)[1]) if all(y[j] == y[i] for _, j in nb)}


def test_lof_over_all_rows(spark, monkeypatch):
    x, _, df = _table(spark)
    monkeypatch.setattr(neighbors, "points", lambda *_: df)
    got = {r.sample_id: r for r in E.queries()["local_outlier_factor_global"](spark, "").collect()}
    nb = _near(x, 20)[1]
    kd = [np.sqrt(n[-1][0]) for n in nb]
    lrd = [1 / (np.mean([max(kd[j], np.sqrt(d)) for d, j in n]) + 1e-10) for n in nb]
    lof = [np.mean([lrd[j] for _, j in n]) / lrd[i] for i, n in enumerate(nb)]
    assert len(got) == N_ROWS and all(abs(got[i].lof - lof[i]) < 1e-6 for i in range(N_ROWS))
    assert [i for i in got if got[i].is_outlier] == [max(range(N_ROWS), key=lambda i: (lof[i], -i))]


def test_leaderboard_lof_is_not_blocked():
    assert "keys=[HOST]" not in inspect.getsource(models.q_detector_leaderboard)


def test_neighbour_cleaning_gathers_no_side_in_the_driver(spark):
    """All sides of its joins have a row per input row, so none may be broadcast however small its files are."""
    df = spark.createDataFrame([(i, i % 2, float(i % 7), float(i % 5)) for i in range(60)],
                               "sample_id bigint, is_anomaly int, a double, b double")
    out = N.edited_nearest_neighbours(df, ["a", "b"], 3)
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
