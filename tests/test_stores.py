"""Roll-up tree and alert store: batches, retries, and what a batch touches."""
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleet_health.operators import reports as RP
from fleet_health.operators.alert_store import AlertStore
from fleet_health.operators.rollups import RollupStore
from fleet_health.schema import HOST, SAMPLE, TS
from fleet_health.sources.metrics import load_metrics

SF = "/root/testdata/sf0.001"


def rows(df):
    cols = sorted(df.columns)
    return sorted([tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect()], key=repr)


@pytest.fixture(scope="module")
def metrics(spark):
    return load_metrics(spark, SF).cache()


@pytest.fixture(scope="module")
def store(spark, metrics, tmp_path_factory):
    s = RollupStore(spark, str(tmp_path_factory.mktemp("rollups")))
    for i in range(3):
        s.add(metrics.filter(F.col(SAMPLE) % 3 == i), i)
    s.add(metrics.filter(F.col(SAMPLE) % 3 == 1), 1)  # tried again
    return s


@pytest.mark.parametrize("name", list(RP.CHART_RANGES))
def test_charts_from_the_tree_equal_charts_from_samples(metrics, store, name):
    n, period = RP.CHART_RANGES[name]
    assert rows(RP.chart_of_buckets(store.buckets(period), n, period)) == rows(RP.chart_series(metrics, name))


def test_levels_hold_all_samples_and_compact_to_the_same(spark, metrics, store, tmp_path):
    assert store.level_for("1 hour") == "1 hour" and store.level_for("15 minutes") == "5 minutes" and store.level_for("3 minutes") == "1 minute"
    with pytest.raises(ValueError):
        store.level_for("90 seconds")
    n = metrics.count()
    for level in store.levels:
        assert store.read(level).agg(F.sum("samples")).first()[0] == n
    packed = store.compact(str(tmp_path / "packed"))
    for level in store.levels:
        assert rows(packed.read(level).drop("last")) == rows(store.read(level).drop("last"))
    assert os.listdir(tmp_path / "packed" / "1_hour") == ["batch=0"]
    direct = metrics.groupBy(HOST, F.window(TS, "15 minutes").start.cast("timestamp_ntz").alias("bucket")).agg(
        *[F.avg(c).alias(c) for c in ("cpu_percent", "memory_percent", "disk_usage_percent")])
    assert rows(store.buckets("15 minutes")) == rows(direct)


ALERT = "alert_id bigint, host_id bigint, level string, title string, resolved boolean, resolved_at timestamp_ntz"


def test_a_batch_rewrites_the_buckets_it_touches(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    alerts = spark.createDataFrame([(i, i % 5, "warning", f"t{i}", False, None) for i in range(200)], ALERT)
    s = AlertStore(spark, str(tmp_path), alerts.schema, 16)
    assert s.alerts().count() == 0
    assert len(s.upsert(alerts, 0)) == 16
    change = spark.createDataFrame([(7, t0), (7, t0 + timedelta(hours=1)), (-1, t0)], "alert_id bigint, resolved_at timestamp_ntz")
    touched = s.upsert(change, 1)
    assert len(touched) <= 2 and len(os.listdir(tmp_path / "alerts" / "version=1")) <= 4
    once = rows(s.alerts())
    s.upsert(change, 1)  # tried again
    assert rows(s.alerts()) == once
    got = {r.alert_id: r for r in s.alerts().collect()}
    assert len(got) == 200 and [k for k, r in got.items() if r.resolved] == [7]
    assert got[7].resolved_at == t0 + timedelta(hours=1) and got[7].title == "t7"
    s.upsert(spark.createDataFrame([(500, 1, "critical", "new", False, None), (8, 9, "info", "other", False, None)], ALERT), 2)
    got = {r.alert_id: r for r in s.alerts().collect()}
    assert len(got) == 201 and got[8].title == "t8" and got[500].level == "critical"
    assert s.upsert(change.limit(0), 3) == []
