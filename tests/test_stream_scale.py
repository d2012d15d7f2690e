"""Streams over time slices of several files: one trigger a slice, one state call for many hosts."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from fleet_health.operators import alerts
from fleet_health.schema import HOST, METRIC_COLUMNS, SAMPLE, TS
from fleet_health.streaming import event_time as ET
from fleet_health.streaming import stateful as ST


@pytest.fixture(scope="module")
def metrics(spark):
    """600 hosts of 20 samples, ids in no order of time."""
    i = F.col("id")
    df = spark.range(0, 12000, numPartitions=5).select(
        (i % 600).alias(HOST), ((i * 7919) % 12000).alias(SAMPLE),
        (F.lit(dt.datetime(2024, 1, 1)).cast("timestamp") + F.make_dt_interval(mins=(i / 600).cast("int") * 20 + i % 7)).alias(TS),
        *[((i * (37 + n)) % 101).cast("double").alias(c) for n, c in enumerate(METRIC_COLUMNS)])
    return df.cache()


def test_a_slice_of_many_files_is_one_trigger(spark, metrics, tmp_path):
    parts = ST.write_time_ordered_files(metrics, str(tmp_path / "src"), 4, file_rows=1000)
    n = {len(ST._files_of(spark, p, metrics.schema)) for p in parts}
    assert len(n) == 1 and n.pop() > 1
    stream = ST.file_stream(spark, str(tmp_path / "src"), metrics.schema)
    q = ET.drain(ET.refresh_stream(stream, delay="1 minute"), str(tmp_path / "sink"), str(tmp_path / "ck"))
    assert len({p.batchId for p in q.recentProgress if p.numInputRows}) == 4 and ET.dropped_rows(q) == 0
    start = F.unix_micros(TS) - F.pmod(F.unix_micros(TS), F.lit(900_000_000))
    last = metrics.agg(F.max(F.unix_micros(TS))).first()[0]
    want = metrics.groupBy(HOST, start.alias("w")).agg(F.max_by(SAMPLE, F.struct(TS, SAMPLE)).alias("s")).filter(
        F.col("w") + 960_000_000 < F.lit(last))
    got = spark.read.parquet(str(tmp_path / "sink"))
    assert {tuple(r) for r in got.select(HOST, SAMPLE).collect()} == {tuple(r) for r in want.select(HOST, "s").collect()}


def test_hosts_share_state_calls(spark, metrics, tmp_path, monkeypatch):
    """With 5 keys for 600 hosts each host's counts and cooldowns stay its own."""
    monkeypatch.setattr(ST, "HOST_BUCKETS", 5)
    df = metrics.select(HOST, SAMPLE, TS, (F.col("cpu_percent") / 100).alias("anomaly_probability"))
    ST.write_time_ordered_files(df, str(tmp_path / "src"), 4, file_rows=1000)
    out = ST.stream_alert_cooldown(ST.file_stream(spark, str(tmp_path / "src"), df.schema), 3600.0)
    ST.run_available_now(out, str(tmp_path / "sink"), str(tmp_path / "ck"))
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "sink")).select(HOST, SAMPLE, "consecutive", "level").collect()}
    want = alerts.alert_cooldown(df.withColumn(TS, F.col(TS).cast("timestamp_ntz")), cooldown="1 hour")
    assert got == {tuple(r) for r in want.select(HOST, SAMPLE, "consecutive", "level").collect()} and len(got) > 600


def test_a_host_silent_in_a_shared_bucket_loses_its_state():
    class State:
        exists, hasTimedOut, get, timer, now = False, False, None, None, 0

        def getCurrentProcessingTimeMs(self):
            return self.now

        def update(self, v):
            self.exists, self.get = True, v

        def remove(self):
            self.exists, self.get = False, None

        def setTimeoutDuration(self, ms):
            self.timer = self.now + ms
    import pandas as pd
    fn, state = ST.make_alert_fn(300.0, idle_ms=100), State()
    batch = lambda *hosts: iter([pd.DataFrame({HOST: hosts, SAMPLE: range(len(hosts)), TS: pd.Timestamp("2024-01-01"), "anomaly_probability": 0.6})])
    list(fn((0,), batch(1, 2), state))
    state.now = 60
    list(fn((0,), batch(2), state))
    assert state.get[0] == [1, 2] and state.get[1] == [1, 2] and state.timer == 100
    state.now, state.hasTimedOut = 110, True
    list(fn((0,), iter([]), state))
    assert state.get[0] == [2] and state.timer == 160
    state.now = 170
    list(fn((0,), iter([]), state))
    assert not state.exists


def test_a_sample_without_host_is_refused():
    import pandas as pd
    row = pd.DataFrame({HOST: [1.0, None], SAMPLE: [1, 2], TS: pd.Timestamp("2024-01-01"), "anomaly_probability": 0.6})
    with pytest.raises(ValueError, match="host"):
        ST._gathered(iter([row]), ["anomaly_probability"])
