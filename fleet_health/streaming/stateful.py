"""Structured Streaming operators.

State is bounded: the buffer keeps at most 20 samples of a host, the alert
state two scalars.  It is keyed by buckets of hosts (``by_hosts``), whose
``applyInPandasWithState`` calls sort each micro-batch by (host, timestamp,
sample_id) before folding it into the state, so a host's stream is processed
in event order within a batch.
Event time uses the ``timestamp`` (with time zone) type the watermark
needs; ``to_event_time`` converts the batch tables' ``timestamp_ntz``.
"""

from __future__ import annotations

import os
from collections import Counter
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.alerts import (ALERT_ABOVE, CONSECUTIVE_THRESHOLD, HIGH_ABOVE, RESET_BELOW)
from ..schema import BASE_FEATURES, CPU, DISK, HOST, MEM, METRIC_COLUMNS, SAMPLE, TS

BUFFER_SIZE = 20
SEQUENCE_MIN = 10
FILE_ROWS = 1 << 20  # rows of one file of a time slice
HOST_BUCKETS = 1024  # keys of the host states; fixed, as a checkpoint holds them


def to_event_time(df: DataFrame) -> DataFrame:
    return df.withColumn(TS, F.col(TS).cast("timestamp"))


def _files_of(spark: SparkSession, path: str, schema: T.StructType) -> list[str]:
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path).inputFiles()


def write_time_ordered_files(df: DataFrame, path: str, n_files: int = 6, file_rows: int = FILE_ROWS) -> list[str]:
    """Fixture 2.7: the table as ``n_files`` Parquet folders in time order
    (written one after another, so modification times follow event time).  All
    folders hold the same number of files, enough for about ``file_rows`` rows each, so
    ``file_stream`` can take a folder a trigger; empty files make up for missing ones."""
    spark = df.sparkSession
    lo, hi = df.agg(F.min(TS), F.max(TS)).first()
    span = (hi - lo) / n_files
    conds = []
    for i in range(n_files):
        cond = (F.col(TS) >= F.lit(lo + span * i)) if i else F.lit(True)
        if i < n_files - 1:
            cond = cond & (F.col(TS) < F.lit(lo + span * (i + 1)))
        conds.append(cond)
    most = max(df.agg(*[F.count_if(c) for c in conds]).first())
    per = max(1, -(-most // file_rows))
    out = []
    for i, cond in enumerate(conds):
        part = os.path.join(path, f"part{i:02d}")
        rows = df.filter(cond)
        (rows.coalesce(1) if per == 1 else rows.repartition(per)).write.mode("overwrite").parquet(part)
        missing = per - len(_files_of(spark, part, df.schema))
        if missing > 0:
            none = spark.createDataFrame([], df.schema).coalesce(1)
            for _ in range(missing):
                none.write.mode("append").parquet(part)
        out.append(part)
    return out


def file_stream(spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None) -> DataFrame:
    """The Parquet files below ``path``, oldest first, ``max_files`` a trigger; by
    default as many as a folder holds: rows of one time slice come in any order
    over its files, so a watermark must not move between them."""
    if max_files is None:
        folders = Counter(f.rsplit("/", 1)[0] for f in _files_of(spark, path, schema))
        max_files = max(folders.values(), default=1)
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
            .option("recursiveFileLookup", "true").parquet(path))


def run_available_now(df: DataFrame, sink: str, checkpoint: str, mode: str = "append",
                      partition_by=None) -> None:
    """Drain everything available into a Parquet sink (exactly once via the
    checkpoint) and stop."""
    w = df.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint) \
          .outputMode(mode).trigger(availableNow=True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.start().awaitTermination()


# ------------------------------------------------------------------ T1
def stream_ingest(source: DataFrame) -> DataFrame:
    """Subscribe -> decode -> append: adds the ``date`` partition column."""
    return source.withColumn("date", F.to_date(F.col(TS)))


# ------------------------------------------------------------------ T2
TEMPORAL_COLUMNS = (list(METRIC_COLUMNS) + ["hour", "day_of_week", "is_weekend", "hour_sin", "hour_cos"]
                    + [f"{c}_{s}" for c in BASE_FEATURES for s in ("rolling_mean_5", "rolling_std_5",
                                                                     "rolling_min_5", "rolling_max_5", "roc")]
                    + ["cpu_memory_ratio", "system_load_index", "resource_pressure"])
_INT_COLS = {"hour", "day_of_week", "is_weekend", "resource_pressure"}
BUFFER_STATE = T.StructType([T.StructField(c, T.ArrayType(T.LongType())) for c in ("ts", "ids", "host", "seen")]
                            + [T.StructField(c, T.ArrayType(T.DoubleType())) for c in METRIC_COLUMNS])


def buffer_output_schema() -> T.StructType:
    return T.StructType([T.StructField(HOST, T.LongType()), T.StructField(SAMPLE, T.LongType()),
                         T.StructField(TS, T.TimestampType())]
                        + [T.StructField(c, T.IntegerType() if c in _INT_COLS else T.DoubleType())
                           for c in TEMPORAL_COLUMNS])


def _window_features(ts: np.ndarray, values: dict, at: np.ndarray) -> dict:
    """K4 features of the rows ``at`` of sorted series, each with its host's four
    rows before it (same definitions as the batch pack: trailing 5 rows, sample
    std, roc 0 for a zero base; missing values leave a frame)."""
    when = pd.DatetimeIndex(ts[at].astype("datetime64[us]"))
    out = {c: values[c][at] for c in METRIC_COLUMNS}
    out.update(hour=when.hour, day_of_week=when.weekday, is_weekend=(when.weekday >= 5).astype("int32"),
               hour_sin=np.sin(2 * np.pi * when.hour / 24.0), hour_cos=np.cos(2 * np.pi * when.hour / 24.0))
    for c in BASE_FEATURES:
        w = pd.DataFrame(np.lib.stride_tricks.sliding_window_view(values[c], 5)[at - 4])
        last, prev = values[c][at], values[c][at - 1]
        with np.errstate(divide="ignore", invalid="ignore"):
            roc = np.where((prev == 0.0) | np.isnan(prev), 0.0, (last - prev) / prev)
        out.update({f"{c}_rolling_mean_5": w.mean(axis=1).to_numpy(), f"{c}_rolling_std_5": w.std(axis=1, ddof=1).to_numpy(),
                    f"{c}_rolling_min_5": w.min(axis=1).to_numpy(), f"{c}_rolling_max_5": w.max(axis=1).to_numpy(),
                    f"{c}_roc": roc})
    cpu, mem, disk = (values[c][at] for c in (CPU, MEM, DISK))
    out.update(cpu_memory_ratio=cpu / (mem + 1.0), system_load_index=cpu * 0.6 + mem * 0.3 + disk * 0.1,
               resource_pressure=(cpu > 80).astype("int32") + (mem > 80) + (disk > 80))
    return out


def by_hosts(stream: DataFrame) -> GroupedData:
    """The stream by the key of the host states: a bucket of hosts.  A Python call costs
    as much as hundreds of samples, so hosts share calls; what is kept of one stays the same."""
    return stream.withColumn("_hosts", F.pmod(F.xxhash64(HOST), F.lit(HOST_BUCKETS)).cast("int")).groupBy("_hosts")


def _gathered(pdfs: Iterator[pd.DataFrame], columns, held: dict | None = None, held_last: bool = False) -> dict:
    """The held rows of a bucket and its new samples of a micro-batch as arrays
    by (host, time, sample); ``_held`` marks the former.  Held rows stand before
    their host's new ones or, with ``held_last``, behind new ones of equal (time, sample)."""
    parts = [held] if held else []
    for p in pdfs:
        if p[HOST].isna().any():
            raise ValueError("a host state needs the host of every sample")
        part = {HOST: p[HOST].to_numpy(), "_ts": p[TS].astype("datetime64[us]").astype("int64").to_numpy(), SAMPLE: p[SAMPLE].to_numpy()}
        part.update({c: p[c].to_numpy(dtype="float64", na_value=np.nan) for c in columns})
        parts.append(part | {"_held": np.zeros(len(p), bool)})
    names = (HOST, "_ts", SAMPLE, *columns, "_held")
    if not parts:
        return {c: np.zeros(0, bool if c == "_held" else "int64") for c in names}
    rows = {c: np.concatenate([p[c] for p in parts]) for c in names}
    by = [rows["_held"], rows[SAMPLE], rows["_ts"]] if held_last else [rows[SAMPLE], rows["_ts"], ~rows["_held"]]
    order = np.lexsort((*by, rows[HOST]))
    return {c: v[order] for c, v in rows.items()}


def _starts(hosts: np.ndarray) -> np.ndarray:
    """Where each host's rows begin in sorted ``hosts``."""
    return np.flatnonzero(np.r_[True, hosts[1:] != hosts[:-1]]) if len(hosts) else np.zeros(0, int)


def _idle(state, hosts, seen, idle_ms: int | None):
    """Sets the timer of a bucket: the first moment at which one of its hosts has
    been silent for ``idle_ms``."""
    if idle_ms and len(hosts):
        state.setTimeoutDuration(max(1, int(min(seen)) + idle_ms - state.getCurrentProcessingTimeMs()))


def make_buffer_fn(idle_ms: int | None = None):
    def fn(key, pdfs: Iterator[pd.DataFrame], state):
        now = state.getCurrentProcessingTimeMs() if idle_ms else 0
        held, seen = None, {}
        if state.exists:
            st = state.get
            held = {HOST: np.array(st[2], "int64"), "_ts": np.array(st[0], "int64"), SAMPLE: np.array(st[1], "int64"),
                    "_held": np.ones(len(st[0]), bool)}
            held.update({c: np.array(st[4 + i], "float64") for i, c in enumerate(METRIC_COLUMNS)})
            at = np.array(st[3], "int64")
            if idle_ms:  # silent hosts: their buffers go
                stay = at + idle_ms > now
                held, at = {c: v[stay] for c, v in held.items()}, at[stay]
            seen = dict(zip(held[HOST].tolist(), at.tolist()))
        rows = _gathered(() if state.hasTimedOut else pdfs, METRIC_COLUMNS, held)
        hosts, n = rows[HOST], len(rows[HOST])
        if not n:
            state.remove()
            return
        start = _starts(hosts)
        size = np.diff(np.r_[start, n])
        place, left = np.arange(n) - np.repeat(start, size), np.repeat(start + size, size) - np.arange(n)
        if not state.hasTimedOut:
            seen.update(dict.fromkeys(hosts[~rows["_held"]].tolist(), now))
        keep = left <= BUFFER_SIZE
        at = [seen[h] for h in hosts[keep].tolist()]
        state.update((rows["_ts"][keep].tolist(), rows[SAMPLE][keep].tolist(), hosts[keep].tolist(), at,
                      *[rows[c][keep].tolist() for c in METRIC_COLUMNS]))
        _idle(state, at, at, idle_ms)
        # new are the rows behind a host's held ones
        old = np.repeat(np.add.reduceat(rows["_held"].astype(int), start), size)
        new = np.flatnonzero(place >= np.maximum(old, SEQUENCE_MIN - 1))
        if len(new):
            out = {HOST: hosts[new].astype("int64"), SAMPLE: rows[SAMPLE][new], TS: rows["_ts"][new].astype("datetime64[us]"),
                   **_window_features(rows["_ts"], rows, new)}
            yield pd.DataFrame(out)[[f.name for f in buffer_output_schema().fields]]
    return fn


def _timeout(idle_ms: int | None):
    return GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout


def stream_buffer_features(stream: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Per-host buffer of the last 20 samples; K4 features for each new
    sample once 10 are buffered.  A host that is silent for ``idle_ms`` of
    processing time loses its buffer (None: never).  The new rows of a bucket of hosts
    are held together; ``max_files`` bounds them."""
    return by_hosts(stream).applyInPandasWithState(
        make_buffer_fn(idle_ms), buffer_output_schema(), BUFFER_STATE, "append", _timeout(idle_ms))


# ------------------------------------------------------------------ T5/T6
ALERT_STATE = T.StructType([T.StructField(c, T.ArrayType(T.LongType())) for c in ("host", "cnt", "last", "seen")])


def alert_output_schema() -> T.StructType:
    return T.StructType([T.StructField(HOST, T.LongType()), T.StructField(SAMPLE, T.LongType()),
                         T.StructField(TS, T.TimestampType()),
                         T.StructField("anomaly_probability", T.DoubleType()),
                         T.StructField("consecutive", T.LongType()), T.StructField("level", T.StringType())])


def make_alert_fn(cooldown_seconds: float, threshold: int = CONSECUTIVE_THRESHOLD,
                  gate_before_count: bool = False, p_col: str = "anomaly_probability", idle_ms: int | None = None):
    cool_us = int(cooldown_seconds * 1_000_000)

    def fold(p, ts, cnt, last):
        """(places and counts of a host's alerts, count, last alert): sequential, over plain numbers."""
        picked = []
        for i, (p, t) in enumerate(zip(p, ts)):
            if gate_before_count and not p > ALERT_ABOVE:
                continue
            if p < RESET_BELOW:
                cnt = 0
                continue
            cnt += 1
            if last is not None and t - last < cool_us:
                continue
            if p > ALERT_ABOVE and (cnt >= threshold or p > HIGH_ABOVE):
                last = t
                picked.append((i, cnt))
        return picked, cnt, last

    def fn(key, pdfs, state):
        now = state.getCurrentProcessingTimeMs() if idle_ms else 0
        known = {h: v for h, *v in zip(*state.get)} if state.exists else {}  # host: count, last alert, last seen
        if idle_ms:
            known = {h: v for h, v in known.items() if v[2] + idle_ms > now}
        picked = []
        if not state.hasTimedOut:
            rows = _gathered(pdfs, [p_col])
            p, ts, start = rows[p_col].tolist(), rows["_ts"].tolist(), _starts(rows[HOST]).tolist()
            for a, z in zip(start, [*start[1:], len(ts)]):
                host = int(rows[HOST][a])
                cnt, last, _ = known.get(host, (0, None, 0))
                alerts, cnt, last = fold(p[a:z], ts[a:z], cnt, last)
                known[host] = (cnt, last, now)
                picked += [(a + i, c) for i, c in alerts]
        if not known:
            state.remove()
            return
        state.update(([*known], *[[v[i] for v in known.values()] for i in range(3)]))
        _idle(state, known, [v[2] for v in known.values()], idle_ms)
        if picked:
            at = np.array([i for i, _ in picked])
            p = rows[p_col][at]
            yield pd.DataFrame({HOST: rows[HOST][at].astype("int64"), SAMPLE: rows[SAMPLE][at], TS: rows["_ts"][at].astype("datetime64[us]"),
                                "anomaly_probability": p, "consecutive": [c for _, c in picked],
                                "level": np.where(p > HIGH_ABOVE, "CRITICAL", "WARNING")})
    return fn


def stream_alert_cooldown(stream: DataFrame, cooldown_seconds: float = 300.0, idle_ms: int | None = None, **kw) -> DataFrame:
    """T5 + T6 as keyed state: consecutive count and last emitted alert time
    per host; identical emissions to the batch ``alerts.alert_cooldown``.  A
    host silent for ``idle_ms`` of processing time starts anew (None: never)."""
    return by_hosts(stream).applyInPandasWithState(
        make_alert_fn(cooldown_seconds, idle_ms=idle_ms, **kw), alert_output_schema(), ALERT_STATE, "append",
        _timeout(idle_ms))


# ------------------------------------------------------------------ T3
def score_rows(model, batch: DataFrame) -> DataFrame:
    """Scores of a batch; a row whose features can't be scored (NULL or NaN)
    gets p = 0 and no anomaly, as the reference does for a scoring error."""
    from ..models.supervised import score_batch

    ok = F.lit(True)
    for c in model.stages[0].getInputCols():
        ok = ok & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return score_batch(model, batch.filter(ok)).unionByName(
        batch.filter(~ok).withColumn("anomaly_probability", F.lit(0.0)).withColumn("prediction", F.lit(0)))


def stream_score(stream: DataFrame, model, sink: str, checkpoint: str) -> None:
    """Score each micro-batch with a fitted pipeline (foreachBatch).  An
    epoch writes its own folder and overwrites it, so a batch that is tried
    again leaves its rows once; an error fails the query."""

    def each(batch: DataFrame, epoch: int):
        score_rows(model, batch).write.mode("overwrite").parquet(os.path.join(sink, f"epoch={epoch}"))

    (stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


# ------------------------------------------------------------------ T11/T12
def windowed_metrics(stream: DataFrame, window: str = "1 day", slide: str | None = None,
                     watermark: str = "1 hour") -> DataFrame:
    """Event-time mean / max per host and window with a watermark
    (append mode emits a window once the watermark passes its end)."""
    w = F.window(TS, window, slide) if slide else F.window(TS, window)
    return (stream.withWatermark(TS, watermark).groupBy(HOST, w.alias("w"))
            .agg(F.avg(CPU).alias("avg_cpu"), F.max(CPU).alias("max_cpu"), F.avg(MEM).alias("avg_memory"),
                 F.count(F.lit(1)).alias("samples"))
            .select(HOST, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "avg_cpu", "max_cpu", "avg_memory", "samples"))


def periodic_refresh_batch(df: DataFrame, every: str = "15 minutes") -> DataFrame:
    """T11 batch twin: the latest sample of each host in every refresh window."""
    w = F.window(TS, every)
    last = F.max_by(F.struct(*[F.col(c) for c in df.columns if c != HOST]), F.struct(F.col(TS), F.col(SAMPLE)))
    return (df.groupBy(HOST, w.start.cast("timestamp_ntz").alias("refresh_at")).agg(last.alias("_s"))
              .select(HOST, "refresh_at", "_s.*"))
