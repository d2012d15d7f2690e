"""Alert semantics against a direct sequential implementation of the rule."""
import datetime as dt
import random

from pyspark.sql import functions as F

from fleet_health.operators import alerts as A


def reference_rule(rows, cooldown_s, threshold=3, gated=False):
    """rows: (host, id, ts, p) -> emitted (host, id, cnt)."""
    out, state = [], {}
    for h, i, ts, p in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        cnt, last = state.get(h, (0, None))
        if gated and not p > 0.5:
            continue
        if p < 0.3:
            state[h] = (0, last)
            continue
        cnt += 1
        if last is not None and (ts - last).total_seconds() < cooldown_s:
            state[h] = (cnt, last)
            continue
        if p > 0.5 and (cnt >= threshold or p > 0.8):
            last = ts
            out.append((h, i, cnt))
        state[h] = (cnt, last)
    return sorted(out)


def _frame(spark, seed=3, hosts=3, n=120):
    rnd = random.Random(seed)
    t0 = dt.datetime(2024, 1, 1)
    rows, i = [], 0
    for h in range(hosts):
        t = t0
        for _ in range(n):
            t += dt.timedelta(seconds=rnd.choice([30, 60, 90, 200, 400]))
            p = rnd.choice([0.1, 0.3, 0.5, 0.51, 0.6, 0.8, 0.81, 0.95])  # thresholds exactly hit
            rows.append((h, i, t, p))
            i += 1
    df = spark.createDataFrame(rows, "host_id long, sample_id long, timestamp timestamp_ntz, anomaly_probability double")
    return rows, df


def test_cooldown_matches_rule(spark):
    rows, df = _frame(spark)
    for gated in (False, True):
        got = A.alert_cooldown(df, cooldown="300 seconds", gate_before_count=gated)
        got = sorted((r.host_id, r.sample_id, r.consecutive) for r in got.collect())
        assert got == reference_rule(rows, 300, gated=gated)


def test_cooldown_small_chunks(spark):
    rows, df = _frame(spark, seed=5)
    spark.conf.set("fleet_health.series.chunkRows", "17")
    try:
        got = sorted((r.host_id, r.sample_id, r.consecutive) for r in
                     A.alert_cooldown(df, cooldown="300 seconds").collect())
    finally:
        spark.conf.unset("fleet_health.series.chunkRows")
    assert got == reference_rule(rows, 300)


def test_consecutive_count_resets(spark):
    t0 = dt.datetime(2024, 1, 1)
    ps = [0.6, 0.6, 0.29, 0.3, 0.9, 0.1]
    df = spark.createDataFrame([(1, i, t0 + dt.timedelta(minutes=i), p) for i, p in enumerate(ps)],
                               "host_id long, sample_id long, timestamp timestamp_ntz, anomaly_probability double")
    got = [r.consecutive for r in A.consecutive_count(df).orderBy("sample_id").collect()]
    assert got == [1, 2, 0, 1, 2, 0]  # 0.3 is not below 0.3


def test_threshold_alerts_are_strict(spark):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, 1, t0, 90.0, 85.0), (1, 2, t0, 90.01, 85.01)],
                               "host_id long, sample_id long, timestamp timestamp_ntz, cpu_percent double, memory_percent double")
    got = sorted((r.sample_id, r.title) for r in A.threshold_alerts(df).collect())
    assert got == [(2, "High CPU Usage"), (2, "High Memory Usage")]


def test_asof_snapshot(spark):
    t0 = dt.datetime(2024, 1, 1)
    s = spark.createDataFrame([(1, 10, t0, 1.0, 2.0, 3.0), (1, 11, t0 + dt.timedelta(hours=2), 4.0, 5.0, 6.0)],
                              "host_id long, sample_id long, timestamp timestamp_ntz, cpu_percent double, memory_percent double, disk_usage_percent double")
    e = spark.createDataFrame([(1, 1, t0 - dt.timedelta(minutes=1)), (1, 2, t0), (1, 3, t0 + dt.timedelta(hours=3))],
                              "host_id long, alert_id long, timestamp timestamp_ntz")
    got = {r.alert_id: r.snapshot_sample_id for r in A.asof_snapshot(e, s).collect()}
    assert got == {1: None, 2: 10, 3: 11}
