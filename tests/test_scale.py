"""Draws, fills, ranks and forests by yardsticks of their own, at sizes and
skews that the small tables do not show."""
import datetime as dt
import re
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fleet_health.models import iforest
from fleet_health.operators import knn, labels as L, rolling, series
from fleet_health.sources import tables, wire
from fleet_health.sources.metrics import load_metrics
from fleet_health.streaming.stateful import score_rows

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("base", [0, 10 ** 12])
def test_draws_are_uniform_and_independent(spark, base):
    ids = spark.range(base, base + 20_000).select(F.col("id"))
    u = ids.select(*[L.unit_hash(F.col("id"), s).alias(f"u{s}") for s in (1, 2, 3, 43, 44)]).toPandas().to_numpy()
    assert u.min() >= 0 and u.max() < 1
    for j in range(u.shape[1]):
        assert np.abs(np.histogram(u[:, j], 10, (0, 1))[0] / len(u) - 0.1).max() < 0.01
    c = np.corrcoef(u.T) - np.eye(u.shape[1])
    assert np.abs(c).max() < 0.04
    # no fixed shift between salts either
    assert len(np.unique(np.round((u[:, 1] - u[:, 0]) % 1, 3))) > 900


def test_draws_take_text_and_negative_ids(spark):
    df = spark.createDataFrame([("a",), ("b",)], "id string")
    assert df.select(F.count_if(L.unit_hash(F.col("id"), 1) < 1)).first()[0] == 2
    assert spark.range(-5, 5).select(F.min(L.unit_hash(F.col("id"), 1))).first()[0] >= 0


def test_point_anomalies_are_of_all_kinds(spark):
    m = load_metrics(spark, SF)
    a = L.inject_point_anomalies(m).filter("is_anomaly = 1").join(
        m.select("sample_id", *[F.col(c).alias(f"o_{c}") for c in ("cpu_percent", "memory_percent", "disk_usage_percent")]), "sample_id")
    share, span = [], []
    rows = a.toPandas()
    for c, lo, hi in (("cpu_percent", 90, 100), ("memory_percent", 95, 100), ("disk_usage_percent", 95, 100)):
        hit = rows[rows[c] != rows[f"o_{c}"]]
        share.append(len(hit) / len(rows))
        u = (hit[c] - lo) / (hi - lo)
        assert u.between(0, 1).all() and u.min() < 0.1 and u.max() > 0.9 and abs(u.mean() - 0.5) < 0.1
    assert all(abs(s - 1 / 3) < 0.08 for s in share)


def test_gradual_anomalies_have_no_cap_unless_asked(spark):
    rows = [(i, 1, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), 50.0, 50.0, 8.0, 8.0, 50.0, 100.0, 100.0) for i in range(12_000)]
    m = spark.createDataFrame(rows, "sample_id long, host_id long, timestamp timestamp_ntz, cpu_percent double, memory_percent double, "
                              "memory_used_gb double, memory_available_gb double, disk_usage_percent double, disk_used_gb double, disk_free_gb double")
    free, capped = (L.inject_point_anomalies(m, cap=c).filter("is_anomaly = 1").count() for c in (None, 50))
    assert free == 12_000 // 20 and capped == 50


def test_fill_of_a_long_host_is_linear(spark):
    n = 200_000
    rng = np.random.default_rng(1)
    x = np.where(rng.random(n) < 0.999, np.nan, rng.normal(size=n))
    pdf = pd.DataFrame({"host_id": 7, "sample_id": np.arange(n), "timestamp": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n), "s"),
                        "x": x})
    df = spark.createDataFrame(pdf).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")).withColumn(
        "x", F.when(~F.isnan("x"), F.col("x")))
    t0 = time.time()
    got = rolling.fill_gaps(df, ["x"], "bfill,ffill").orderBy("sample_id").toPandas()["x"]
    assert time.time() - t0 < 60
    assert np.allclose(got, pdf["x"].bfill().ffill())


def test_global_position_of_crowded_values(spark):
    df = spark.range(30_000).select(F.col("id").alias("sample_id"), F.when(F.col("id") % 3 == 0, F.lit(1.0)).otherwise(F.col("id") % 5).alias("s"))
    got = series.global_position(df, ["s", "sample_id"]).toPandas().sort_values("_rn")
    want = df.toPandas().sort_values(["s", "sample_id"])
    assert got["_rn"].tolist() == list(range(1, 30_001)) and got["sample_id"].tolist() == want["sample_id"].tolist()
    top = {r["sample_id"] for r in knn.top_share(df, "s", 0.01).filter("is_outlier").collect()}
    assert top == set(want.sort_values(["s", "sample_id"], ascending=[False, True])["sample_id"].head(300))


def test_every_tree_grows_on_its_own_rows(spark):
    df = spark.range(60_000).select(F.col("id").alias("sample_id"), F.rand(3).alias("a"), F.rand(4).alias("b"))
    m = iforest.fit(df, ["a", "b"], n_trees=100, max_samples=256)
    roots = m["nodes"][m["nodes"]["node"] == 0]
    assert len(roots) == 100 and set(roots["size"]) == {256}
    assert roots["threshold"].nunique() > 90


def test_history_reads_the_days_it_needs(spark, tmp_path):
    m = load_metrics(spark, "/root/testdata/sf0.001")
    wire.append_metrics(m, f"{tmp_path}/t")
    t = wire.read_metrics_table(spark, f"{tmp_path}/t")
    got = tables.metrics_history(t, hours=24)
    assert got.count() == tables.metrics_history(m, hours=24).count()
    assert re.search(r"PartitionFilters: \[[^\]]*date#", got._jdf.queryExecution().toString())


def test_unscorable_rows_get_no_anomaly(spark):
    from fleet_health.models import supervised as SV
    df = spark.createDataFrame([(i, float(i), int(i > 5)) for i in range(12)], "sample_id long, a double, is_anomaly int")
    model = SV.random_forest(df, ["a"], num_trees=5, max_depth=3)
    odd = spark.createDataFrame([(1, 11.0), (2, None), (3, float("nan"))], "sample_id long, a double")
    got = {r["sample_id"]: (r["anomaly_probability"], r["prediction"]) for r in score_rows(model, odd).collect()}
    assert got[2] == got[3] == (0.0, 0) and got[1][1] == 1
