"""Flattened windows of the sequence classifier: exact on chunked series and on
batches of any size, and no pass over them writes or shuffles anything."""
import datetime as dt
import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from fleet_health.models import sequence
from fleet_health.operators import labels as L, series

FEATS = ["cpu_percent", "b"]
T0 = dt.datetime(2024, 1, 1)


def _samples(spark):
    """Hosts of 0 to 3 rows less than a window, of one, and of many chunks."""
    rng, rows = np.random.RandomState(3), []
    for h, n in enumerate((2, 4, 5, 6, 61, 100)):
        for i in range(n):
            b = None if (h, i) == (4, 20) else float(rng.rand())
            rows.append((h, 1000 * h + i, T0 + dt.timedelta(minutes=i), int(rng.rand() < .3), float(rng.rand() * 100), b))
    rng.shuffle(rows)
    return spark.createDataFrame([tuple(r) for r in rows],
                                 "host_id long, sample_id long, timestamp timestamp, is_anomaly int, cpu_percent double, b double")


@pytest.fixture
def small_parts(spark):
    put = {"fleet_health.series.chunkRows": "16", "spark.sql.execution.arrow.maxRecordsPerBatch": "7"}
    old = {k: spark.conf.get(k, None) for k in put}
    for k, v in put.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_windows_are_those_of_brute_force(spark, small_parts):
    df = _samples(spark)
    got = {r.sample_id: r.w for r in sequence.flatten_windows(df, FEATS, 5).select(
        "sample_id", vector_to_array("_window").alias("w")).collect()}
    hosts = {}
    for r in df.orderBy("host_id", "timestamp").collect():
        hosts.setdefault(r.host_id, []).append(r)
    want = {}
    for rows in hosts.values():
        for i in range(4, len(rows)):
            w = [[math.nan if r[f] is None else r[f] for r in rows[i - 4:i + 1]] for f in FEATS]
            e = np.exp((np.array(w[0]) - max(w[0])) / 10)
            want[rows[i].sample_id] = [*w[0], *w[1], *[float((e * f).sum() / e.sum()) for f in np.array(w)]]
    assert len(sequence.window_feature_names(FEATS, 5)) == 12 and got.keys() == want.keys()
    for k, v in want.items():
        np.testing.assert_allclose(got[k], v, rtol=1e-12)


def test_passes_over_windows_shuffle_nothing(spark):
    w = sequence.flatten_windows(_samples(spark), FEATS, 5)
    plan = w._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and "Window" not in plan
    assert w.rdd.getNumPartitions() % spark.sparkContext.defaultParallelism == 0
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_samples_are_split_as_the_windows_they_end(spark):
    df = _samples(spark)
    early = L.time_ordered_split(df, 0.2, skip=4)
    windows = sequence.flatten_windows(df, FEATS, 5).select("host_id", "sample_id", "timestamp")
    late = L.time_ordered_split(windows, 0.2).select("sample_id", F.col("is_test").alias("late"))
    j = early.join(late, "sample_id")
    assert j.count() == windows.count() and j.filter("is_test != late").count() == 0
    assert early.filter("is_test").count() == late.filter("late").count()


def test_split_keeps_given_positions(spark):
    df = series.with_position(_samples(spark))
    assert series.RN in L.time_ordered_split(df).columns
    assert series.RN not in L.time_ordered_split(df.drop(series.RN)).columns
