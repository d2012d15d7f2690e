"""Step 8 queries: wire decoding, sinks, and Structured Streaming twins
(S1, S2, S5, T1, T2, T3, T5/T6, T11, T12).  Each streaming query writes the
fixture as time-ordered files into a fresh folder of the shared checkpoint
folder, drains it with ``trigger(availableNow=True)`` and returns the sink."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..models import supervised as SV
from ..operators import labels as L
from ..operators import packs
from ..schema import CPU, DISK, HOST, LABEL, MEM, METRIC_COLUMNS, SAMPLE, TS, LABELED_SCHEMA
from ..session import checkpoint_path, materialize
from ..sources import wire
from ..sources.metrics import load_metrics, load_scored, table
from ..streaming import event_time as ET
from ..streaming import stateful as ST
from .alerting import _cooldown_sql
from .features import _k4_cols, _pack_sql
from .registry import query, rounded
from .sqlbase import m

_MD = ["cpu_percent", "memory_percent", "memory_used_gb", "memory_available_gb",
       "disk_usage_percent", "disk_used_gb", "disk_free_gb"]


def _scratch(spark, name):
    return checkpoint_path(spark, f"streams/{name}-{uuid.uuid4().hex[:12]}")


# ------------------------------------------------------------------ S1
def wire_fixture(spark, sf_dir):
    """Fixture 2.6: every sample as JSON text, plus malformed texts derived
    from the events: a truncated copy of each 'signup' sample and a copy
    without timestamp of each 'view' sample."""
    ev = table(spark, sf_dir, "events")
    mt = load_metrics(spark, sf_dir)
    good = wire.encode_samples(mt)
    kinds = ev.select(F.col("event_id").alias(SAMPLE), "event_type")
    txt = wire.encode_samples(mt).select("value", F.get_json_object("value", "$.sample_id").cast("long").alias(SAMPLE))
    j = txt.join(kinds, SAMPLE)
    trunc = j.filter(F.col("event_type") == "signup").select(
        F.substring("value", 1, (F.length("value") / 2).cast("int")).alias("value"))
    no_ts = j.filter(F.col("event_type") == "view").select(
        F.regexp_replace("value", '"timestamp":"[^"]*",', "").alias("value"))
    return good.unionByName(trunc).unionByName(no_ts)


_DECODE_SQL = m("""
SELECT CAST(j->>'host_id' AS BIGINT) AS host_id, CAST(j->>'sample_id' AS BIGINT) AS sample_id,
  CAST(j->>'timestamp' AS TIMESTAMP) AS "timestamp",
  CAST(j->>'cpu_percent' AS DOUBLE) AS cpu_percent, CAST(j->>'memory_percent' AS DOUBLE) AS memory_percent,
  CAST(j->>'memory_used_gb' AS DOUBLE) AS memory_used_gb, CAST(j->>'memory_available_gb' AS DOUBLE) AS memory_available_gb,
  CAST(j->>'disk_usage_percent' AS DOUBLE) AS disk_usage_percent, CAST(j->>'disk_used_gb' AS DOUBLE) AS disk_used_gb,
  CAST(j->>'disk_free_gb' AS DOUBLE) AS disk_free_gb
FROM (SELECT CAST(value AS JSON) AS j FROM wire WHERE json_valid(value)) t
WHERE j->>'host_id' IS NOT NULL AND j->>'sample_id' IS NOT NULL AND j->>'timestamp' IS NOT NULL""", """
wire AS (
  SELECT json_object('host_id', host_id, 'sample_id', sample_id, 'timestamp', strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%f'),
                     'cpu_percent', cpu_percent, 'memory_percent', memory_percent, 'memory_used_gb', memory_used_gb,
                     'memory_available_gb', memory_available_gb, 'disk_usage_percent', disk_usage_percent,
                     'disk_used_gb', disk_used_gb, 'disk_free_gb', disk_free_gb)::VARCHAR AS value, sample_id FROM metrics
  UNION ALL
  SELECT substring(w.value, 1, CAST(floor(length(w.value) / 2) AS INTEGER)), w.sample_id
  FROM (SELECT json_object('host_id', host_id, 'sample_id', sample_id)::VARCHAR || '{' AS value, sample_id FROM metrics) w
  JOIN events e ON e.event_id = w.sample_id WHERE e.event_type = 'signup'
  UNION ALL
  SELECT json_object('host_id', host_id, 'sample_id', sample_id, 'cpu_percent', cpu_percent)::VARCHAR, m.sample_id
  FROM metrics m JOIN events e ON e.event_id = m.sample_id WHERE e.event_type = 'view'
)""")


@query("decode_samples", sql=rounded(_DECODE_SQL, _MD))
def q_decode_samples(spark, sf_dir):
    """Decode wire JSON; malformed texts are quarantined, not decoded."""
    return wire.decode_samples(wire_fixture(spark, sf_dir))


@query("quarantine_count", sql=m("""
SELECT CAST(count(*) AS BIGINT) AS quarantined FROM metrics m JOIN events e ON e.event_id = m.sample_id
WHERE e.event_type IN ('signup', 'view')"""))
def q_quarantine_count(spark, sf_dir):
    """Number of malformed wire texts sent to quarantine."""
    _, bad = wire.decode_samples(wire_fixture(spark, sf_dir), with_quarantine=True)
    return bad.agg(F.count(F.lit(1)).alias("quarantined"))


# ------------------------------------------------------------------ S2, S5
@query("append_metrics", sql=rounded(m('SELECT * EXCLUDE (is_anomaly), CAST("timestamp" AS DATE) AS date FROM metrics'), _MD))
def q_append_metrics(spark, sf_dir):
    """Append to a day-partitioned Parquet table, read it back."""
    path = _scratch(spark, "metrics_table")
    wire.append_metrics(load_metrics(spark, sf_dir).drop(LABEL), path)
    return wire.read_metrics_table(spark, path)


@query("csv_round_trip", sql=rounded(m("SELECT * FROM metrics"), _MD))
def q_csv_round_trip(spark, sf_dir):
    """Training table written as CSV with header and read back with a
    declared schema."""
    path = _scratch(spark, "training_csv")
    wire.write_training_csv(load_metrics(spark, sf_dir), path)
    return wire.read_training_csv(spark, path, LABELED_SCHEMA)


# ------------------------------------------------------------------ T1
def _files(spark, df, name):
    src = _scratch(spark, f"{name}_src")
    ST.write_time_ordered_files(df, src, 6)
    return src


def _drain(spark, stream, name, partition_by=None):
    sink, ck = _scratch(spark, f"{name}_sink"), _scratch(spark, f"{name}_ckpt")
    ST.run_available_now(stream, sink, ck, partition_by=partition_by)
    return spark.read.parquet(sink)


@query("stream_ingest", sql=rounded(m('SELECT *, CAST("timestamp" AS DATE) AS date FROM metrics'), _MD))
def q_stream_ingest(spark, sf_dir):
    """File stream (6 time-ordered files, one per trigger) -> day
    partitioned Parquet sink with a checkpoint; read back."""
    mt = load_metrics(spark, sf_dir)
    src = _files(spark, mt, "ingest")
    stream = ST.file_stream(spark, src, mt.schema)
    return _drain(spark, ST.stream_ingest(stream), "ingest", ["date"])


# ------------------------------------------------------------------ T2
_K4 = _k4_cols()
def _t2_sql():
    inner = ", ".join(f"{e} AS {n}" for e, n in _K4)
    names = [n for _, n in _K4]
    body = (f'SELECT host_id, sample_id, "timestamp", {", ".join(names)} FROM ('
            f'SELECT host_id, sample_id, "timestamp", rn, {inner} FROM (SELECT *, row_number() OVER '
            f'(PARTITION BY host_id ORDER BY "timestamp", sample_id) AS rn FROM metrics) t0) t1 WHERE rn >= 10')
    return rounded(m(body), [n for n in names if n not in ("hour", "day_of_week", "is_weekend", "resource_pressure")])


@query("stream_buffer_features", sql=_t2_sql())
def q_stream_buffer_features(spark, sf_dir):
    """Keyed buffer state (20 samples) -> K4 features of each new sample
    once 10 are buffered; equals the batch pack on rows 10+."""
    mt = ST.to_event_time(load_metrics(spark, sf_dir).drop(LABEL))
    src = _files(spark, mt, "buffer")
    out = _drain(spark, ST.stream_buffer_features(ST.file_stream(spark, src, mt.schema)), "buffer")
    return out.withColumn(TS, F.col(TS).cast("timestamp_ntz"))


# ------------------------------------------------------------------ T5/T6
@query("stream_alert_cooldown", sql=_cooldown_sql(False))
def q_stream_alert_cooldown(spark, sf_dir):
    """T5 + T6 as keyed streaming state (2-day cooldown); equals the batch
    ``alert_cooldown`` query."""
    sc = ST.to_event_time(load_scored(spark, sf_dir).select(HOST, SAMPLE, TS, "anomaly_probability"))
    src = _files(spark, sc, "alerts")
    out = _drain(spark, ST.stream_alert_cooldown(ST.file_stream(spark, src, sc.schema), 2 * 86400.0), "alerts")
    return out.withColumn(TS, F.col(TS).cast("timestamp_ntz"))


# ------------------------------------------------------------------ T3
@query("stream_score")
def q_stream_score(spark, sf_dir):
    """A forest fitted on the temporal features (K4) of the earlier 70 % of
    the table scores the later samples as they stream in: keyed buffers make
    their features (T2), each micro-batch is scored (foreachBatch)."""
    mt = load_metrics(spark, sf_dir)
    split = materialize(L.time_ordered_split(packs.features_temporal(mt), 0.3))
    train, later = split.filter(~F.col("is_test")), split.filter(F.col("is_test")).select(SAMPLE)
    model = SV.weighted_forest(train, ST.TEMPORAL_COLUMNS, num_trees=100, max_depth=10)
    live = ST.to_event_time(mt.join(later, SAMPLE, "left_semi").select(*[c for c in mt.columns if c != LABEL]))
    src = _files(spark, live, "score")
    sink, ck = _scratch(spark, "score_sink"), _scratch(spark, "score_ckpt")
    ST.stream_score(ST.stream_buffer_features(ST.file_stream(spark, src, live.schema)), model, sink, ck)
    out = spark.read.parquet(sink).withColumn(TS, F.col(TS).cast("timestamp_ntz"))
    return out.join(mt.select(SAMPLE, LABEL), SAMPLE).select(HOST, SAMPLE, TS, LABEL, "anomaly_probability", "prediction", "epoch")


# ------------------------------------------------------------------ T11, T12
@query("periodic_refresh", sql=rounded(m("""
SELECT host_id, time_bucket(INTERVAL 15 MINUTE, "timestamp") AS refresh_at, * EXCLUDE (host_id, r)
FROM (SELECT *, row_number() OVER (PARTITION BY host_id, time_bucket(INTERVAL 15 MINUTE, "timestamp")
      ORDER BY "timestamp" DESC, sample_id DESC) AS r FROM metrics) t WHERE r = 1"""), _MD))
def q_periodic_refresh(spark, sf_dir):
    """T11 batch twin: latest sample per host and 15-minute refresh window."""
    return ST.periodic_refresh_batch(load_metrics(spark, sf_dir))


@query("windowed_metrics", sql=rounded(m("""
SELECT host_id, window_start, window_end, avg_cpu, max_cpu, avg_memory, samples FROM (
  SELECT host_id, time_bucket(INTERVAL 1 DAY, "timestamp") AS window_start,
    time_bucket(INTERVAL 1 DAY, "timestamp") + INTERVAL 1 DAY AS window_end,
    avg(cpu_percent) AS avg_cpu, max(cpu_percent) AS max_cpu, avg(memory_percent) AS avg_memory, count(*) AS samples
  FROM metrics GROUP BY ALL) w
WHERE window_end <= (SELECT max("timestamp") FROM metrics) - INTERVAL 1 HOUR"""), ["avg_cpu", "max_cpu", "avg_memory"]))
def q_windowed_metrics(spark, sf_dir):
    """Tumbling 1-day windows per host with a 1-hour watermark in append
    mode: windows still open at the final watermark are not emitted."""
    mt = ST.to_event_time(load_metrics(spark, sf_dir).drop(LABEL))
    src = _files(spark, mt, "windows")
    out = _drain(spark, ST.windowed_metrics(ST.file_stream(spark, src, mt.schema), "1 day", None, "1 hour"),
                 "windows")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")) \
              .withColumn("window_end", F.col("window_end").cast("timestamp_ntz"))


# ------------------------------------------------------------------ N6, T11, T12 by event time
@query("forecast_error_live", sql=rounded(m("""
SELECT avg(abs(least(100.0::DOUBLE, f.cpu_percent + 7.5::DOUBLE) - a.cpu_percent)) AS cpu_mae,
  sqrt(avg(power(least(100.0::DOUBLE, f.cpu_percent + 7.5::DOUBLE) - a.cpu_percent, 2))) AS cpu_rmse, count(*) AS cpu_n,
  avg(abs(least(100.0::DOUBLE, f.memory_percent + 5.0::DOUBLE) - a.memory_percent)) AS memory_mae,
  sqrt(avg(power(least(100.0::DOUBLE, f.memory_percent + 5.0::DOUBLE) - a.memory_percent, 2))) AS memory_rmse, count(*) AS memory_n,
  avg(abs(least(100.0::DOUBLE, f.disk_usage_percent + 2.5::DOUBLE) - a.disk_usage_percent)) AS disk_mae,
  sqrt(avg(power(least(100.0::DOUBLE, f.disk_usage_percent + 2.5::DOUBLE) - a.disk_usage_percent, 2))) AS disk_rmse, count(*) AS disk_n
FROM metrics f JOIN metrics a ON a.host_id = f.host_id AND a."timestamp" >= f."timestamp" + INTERVAL 6 HOUR
  AND a."timestamp" < f."timestamp" + INTERVAL 18 HOUR"""), [f"{r}_{k}" for r in ("cpu", "memory", "disk") for k in ("mae", "rmse")]))
def q_forecast_error_live(spark, sf_dir):
    """N6 + E7 live: stream-stream interval join of each sample's 6 h forecast
    with its host's samples of the 12 hours after it falls due; errors of all
    pairs."""
    from ..operators import evaluate as EV
    mt = ST.to_event_time(load_metrics(spark, sf_dir).drop(LABEL))
    src = _files(spark, mt, "forecasts")
    stream = lambda: ST.file_stream(spark, src, mt.schema)
    joined = ET.forecast_actual_join(ET.forecast_stream(stream()), stream(), "12 hours")
    out = _drain(spark, joined, "forecasts")
    return EV.forecast_error(out, {n: (f"{n}_forecast", f"{n}_actual") for n in ET.FORECASTS})


@query("periodic_refresh_stream", sql=rounded(m("""
SELECT host_id, time_bucket(INTERVAL 15 MINUTE, "timestamp") AS refresh_at, * EXCLUDE (host_id, r, is_anomaly)
FROM (SELECT *, row_number() OVER (PARTITION BY host_id, time_bucket(INTERVAL 15 MINUTE, "timestamp")
      ORDER BY "timestamp" DESC, sample_id DESC) AS r FROM metrics) t WHERE r = 1
  AND time_bucket(INTERVAL 15 MINUTE, "timestamp") + INTERVAL 15 MINUTE
      < date_trunc('millisecond', (SELECT max("timestamp") FROM metrics)) - INTERVAL 1 HOUR"""), _MD))
def q_periodic_refresh_stream(spark, sf_dir):
    """T11 as a stream: event-time timers per host emit the latest sample of
    each 15-minute window once the watermark (1 hour) has passed it."""
    mt = ST.to_event_time(load_metrics(spark, sf_dir).drop(LABEL))
    src = _files(spark, mt, "refresh")
    out = _drain(spark, ET.refresh_stream(ST.file_stream(spark, src, mt.schema)), "refresh")
    return out.withColumn(TS, F.col(TS).cast("timestamp_ntz")).withColumn("refresh_at", F.col("refresh_at").cast("timestamp_ntz"))


# arrival: time-ordered files, every 20th sample three files late
_ARRIVED = """
span AS (SELECT epoch_us(min("timestamp")) AS lo, (epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) // 6 AS w FROM metrics),
arrived AS (SELECT m.*, epoch_us("timestamp") AS t,
  least(5, least(5, (epoch_us("timestamp") - lo) // w) + CASE WHEN sample_id % 20 = 3 THEN 3 ELSE 0 END) AS file FROM metrics m, span),
marks AS (SELECT f.file, max(a.t) - 21600000000 AS mark FROM (SELECT DISTINCT file FROM arrived) f LEFT JOIN arrived a ON a.file < f.file - 1 GROUP BY f.file)"""
_SLIDING = f"""
SELECT host_id, make_timestamp(s) AS window_start, make_timestamp(s + 86400000000) AS window_end, avg(cpu_percent) AS avg_cpu,
  max(cpu_percent) AS max_cpu, avg(memory_percent) AS avg_memory, count(*) AS samples
FROM (SELECT a.*, mark, unnest([t - t % 21600000000 - k * 21600000000 FOR k IN range(4)]) AS s FROM arrived a JOIN marks USING (file)) x
WHERE (mark IS NULL OR s + 86400000000 > mark) AND s + 86400000000 <= (SELECT max(t) - 21600000000 FROM arrived)
GROUP BY host_id, s"""
_LATE = """
SELECT count(*) AS late_rows, count(DISTINCT host_id) AS hosts FROM arrived JOIN marks USING (file)
WHERE t - t % 21600000000 + 86400000000 <= mark"""


def _late_files(spark, mt, name):
    """The table in six files by time, every 20th sample three files late."""
    src = _scratch(spark, f"{name}_src")
    t = F.unix_micros(F.col(TS))
    lo, w = mt.agg(F.min(t), F.expr(f"(max(unix_micros({TS})) - min(unix_micros({TS}))) div 6")).first()
    file = F.least(F.lit(5), F.expr(f"(unix_micros({TS}) - {lo}) div {w}")) + F.when(F.col(SAMPLE) % 20 == 3, 3).otherwise(0)
    d = mt.withColumn("_file", F.least(F.lit(5), file))
    for i in range(6):
        d.filter(F.col("_file") == i).drop("_file").coalesce(1).write.mode("overwrite").parquet(os.path.join(src, f"part{i:02d}"))
    return src


def _pane_store(spark, sf_dir):
    mt = ST.to_event_time(load_metrics(spark, sf_dir).drop(LABEL))
    src = _late_files(spark, mt, "panes")
    store = ET.PaneStore(spark, _scratch(spark, "panes_store"), "24 hours", "6 hours", "6 hours")
    store.run(ST.file_stream(spark, src, mt.schema), _scratch(spark, "panes_ckpt"))
    return store


@query("sliding_metrics", sql=rounded(m(_SLIDING, _ARRIVED), ["avg_cpu", "max_cpu", "avg_memory"]))
def q_sliding_metrics(spark, sf_dir):
    """T12 sliding: 1-day windows every 6 hours from 6-hour panes, watermark of
    6 hours, over files in which every 20th sample comes three files late; rows
    behind a window's watermark do not change it."""
    out = _pane_store(spark, sf_dir).windows()
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")) \
              .withColumn("window_end", F.col("window_end").cast("timestamp_ntz"))


@query("sliding_late_rows", sql=m(_LATE, _ARRIVED))
def q_sliding_late_rows(spark, sf_dir):
    """The rows that came after all their windows had closed (side table)."""
    return _pane_store(spark, sf_dir).late().agg(F.count(F.lit(1)).alias("late_rows"), F.count_distinct(HOST).alias("hosts"))
