"""Event-time streams (N6, T11, T12): a stream-stream join of forecasts with what
came, refreshes fired by timers, and sliding windows merged from panes.

A watermark is the latest event time seen in the batches before, less a delay;
what it has closed is emitted once and never changed, what arrives behind it is
counted and kept aside.  All state is bounded by the delay, and all sinks are
written so that a batch that is tried again leaves its rows once.
"""

from __future__ import annotations

import math
import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from ..schema import CPU, DISK, HOST, MEM, METRIC_COLUMNS, SAMPLE, TS
from .stateful import _gathered, by_hosts


def _micros(interval: str) -> int:
    return int(pd.Timedelta(interval).total_seconds() * 1_000_000)


# ------------------------------------------------------------------ N6 live
FORECASTS = {"cpu": (CPU, 7.5), "memory": (MEM, 5.0), "disk": (DISK, 2.5)}  # fixed values: band half widths


def forecast_stream(stream: DataFrame, horizon: str = "6 hours") -> DataFrame:
    """Each sample's forecast for ``horizon`` later: the middle of its heuristic band."""
    return stream.select(F.col(HOST).alias("f_host"), F.col(SAMPLE).alias("forecast_id"),
                         (F.col(TS) + F.expr(f"INTERVAL {horizon}")).alias("due"),
                         *[F.least(F.lit(100.0), F.col(c) + half).alias(f"{n}_forecast") for n, (c, half) in FORECASTS.items()])


def forecast_actual_join(forecasts: DataFrame, actuals: DataFrame, within: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Each forecast with its host's samples of the ``within`` after it falls
    due.  Both sides carry a watermark, so a forecast is held until its interval
    has passed on both and then forgotten."""
    f = forecasts.withWatermark("due", delay)
    a = actuals.withWatermark(TS, delay).select(
        HOST, SAMPLE, TS, *[F.col(c).alias(f"{n}_actual") for n, (c, _) in FORECASTS.items()])
    hit = (F.col("f_host") == F.col(HOST)) & (F.col(TS) >= F.col("due")) & (F.col(TS) < F.col("due") + F.expr(f"INTERVAL {within}"))
    return f.join(a, hit).drop("f_host")


def dropped_rows(query) -> int:
    """Rows that a finished query's stateful operators found behind the watermark."""
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)


def drain(df: DataFrame, sink: str, checkpoint: str):
    """Runs a stream over everything available into a Parquet sink; the finished query."""
    q = (df.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return q


# ------------------------------------------------------------------ T11
_REFRESH_COLUMNS = [SAMPLE, TS, *METRIC_COLUMNS]
REFRESH_SCHEMA = T.StructType([T.StructField(HOST, T.LongType()), T.StructField("refresh_at", T.TimestampType()),
                               T.StructField(SAMPLE, T.LongType()), T.StructField(TS, T.TimestampType())]
                              + [T.StructField(c, T.DoubleType()) for c in METRIC_COLUMNS])
REFRESH_STATE = T.StructType([T.StructField(c, T.ArrayType(T.LongType())) for c in ("host", "ts", "ids")]
                             + [T.StructField(c, T.ArrayType(T.DoubleType())) for c in METRIC_COLUMNS])


def _refresh_fn(every_us: int):
    def fn(key, pdfs, state):
        mark, held = state.getCurrentWatermarkMs() * 1000, None
        if state.exists:
            st = state.get
            held = {c: np.array(v, "int64") for c, v in zip((HOST, "_ts", SAMPLE), st)} | {"_held": np.ones(len(st[0]), bool)}
            held.update({c: np.array(st[3 + i], "float64") for i, c in enumerate(METRIC_COLUMNS)})
        rows = _gathered(() if state.hasTimedOut else pdfs, METRIC_COLUMNS, held, held_last=True)
        # the last row of each host and window, by (time, sample)
        hosts, start = rows[HOST], rows["_ts"] // every_us * every_us
        last = np.r_[(hosts[1:] != hosts[:-1]) | (start[1:] != start[:-1]), True] if len(hosts) else np.zeros(0, bool)
        done = last & (start + every_us < mark)
        open_ = last & ~done
        if open_.any():
            state.update(tuple(rows[c][open_].tolist() for c in (HOST, "_ts", SAMPLE, *METRIC_COLUMNS)))
            # fires once the watermark has passed the end of the oldest open window
            state.setTimeoutTimestamp(max((int(start[open_].min()) + every_us) // 1000, state.getCurrentWatermarkMs() + 1))
        else:
            state.remove()
        if done.any():
            out = {HOST: hosts[done].astype("int64"), "refresh_at": start[done].astype("datetime64[us]"), SAMPLE: rows[SAMPLE][done],
                   TS: rows["_ts"][done].astype("datetime64[us]")}
            yield pd.DataFrame(out | {c: rows[c][done] for c in METRIC_COLUMNS})
    return fn


def refresh_stream(stream: DataFrame, every: str = "15 minutes", delay: str = "1 hour") -> DataFrame:
    """The latest sample of each host and refresh window, emitted by an
    event-time timer when the watermark has passed the window.  The timer also
    fires for hosts that have fallen silent.  State: a row per open window."""
    rows = stream.withWatermark(TS, delay).select(HOST, *_REFRESH_COLUMNS)
    return by_hosts(rows).applyInPandasWithState(_refresh_fn(_micros(every)), REFRESH_SCHEMA, REFRESH_STATE, "append",
                                                     GroupStateTimeout.EventTimeTimeout)


# ------------------------------------------------------------------ T12
class PaneStore:
    """Sliding windows as merged panes below ``path``.

    A batch's rows are aggregated once per (host, pane), the pane being the
    greatest common divisor of size and slide; a row is never copied into each
    of its windows.  Every epoch writes its own folders: ``panes`` (with the
    watermark that held when they came), ``late`` (rows all of whose windows
    were closed) and ``seen`` (the latest event time).
    """

    def __init__(self, spark: SparkSession, path: str, size: str, slide: str, delay: str):
        self.spark, self.path = spark, path
        self.size, self.slide, self.delay = _micros(size), _micros(slide), _micros(delay)
        self.pane = math.gcd(self.size, self.slide)

    def _folder(self, kind: str, epoch=None) -> str:
        return os.path.join(self.path, kind if epoch is None else f"{kind}/epoch={epoch}")

    def _read(self, kind: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema + ", epoch bigint").parquet(self._folder(kind))

    def _watermark(self, epoch: int) -> int | None:
        """What judges the rows of ``epoch``: a batch's watermark closes windows
        behind its own rows, so late are rows of windows that the batch before
        has closed, by the event times before it (one row a batch)."""
        if epoch < 2:
            return None
        last = self._read("seen", "latest bigint").filter(F.col("epoch") < epoch - 1).agg(F.max("latest")).first()[0]
        return None if last is None else last - self.delay

    def write(self, batch: DataFrame, epoch: int) -> None:
        """One micro-batch; writing an epoch again replaces it."""
        mark = self._watermark(epoch)
        t = F.unix_micros(F.col(TS).cast("timestamp"))
        last_end = t - F.pmod(t, F.lit(self.slide)) + self.size
        rows = batch.withColumn("_t", t).withColumn("_late", last_end <= F.lit(mark) if mark is not None else F.lit(False))
        rows.persist()
        try:
            rows.agg(F.max("_t").alias("latest")).filter("latest is not null").write.mode("overwrite").parquet(self._folder("seen", epoch))
            rows.filter("_late").select(HOST, SAMPLE, "_t").write.mode("overwrite").parquet(self._folder("late", epoch))
            panes = rows.filter("not _late").groupBy(HOST, (F.col("_t") - F.pmod("_t", F.lit(self.pane))).alias("pane")).agg(
                F.sum(CPU).alias("cpu"), F.count(CPU).alias("n_cpu"), F.max(CPU).alias("max_cpu"), F.sum(MEM).alias("memory"),
                F.count(MEM).alias("n_memory"), F.count(F.lit(1)).alias("samples"))
            panes.withColumn("mark", F.lit(mark).cast("long")).write.mode("overwrite").parquet(self._folder("panes", epoch))
        finally:
            rows.unpersist()

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        (stream.writeStream.foreachBatch(self.write).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start().awaitTermination())

    def late(self) -> DataFrame:
        """The rows that came behind the watermark of all their windows."""
        return self._read("late", f"{HOST} bigint, {SAMPLE} bigint, _t bigint").select(
            HOST, SAMPLE, F.timestamp_micros("_t").alias(TS), "epoch")

    def windows(self) -> DataFrame:
        """The closed windows, from panes that came before the window was closed."""
        last = self._read("seen", "latest bigint").agg(F.max("latest")).first()[0]
        p = self._read("panes", f"{HOST} bigint, pane bigint, cpu double, n_cpu bigint, max_cpu double, memory double, "
                                "n_memory bigint, samples bigint, mark bigint")
        p = p.groupBy(HOST, "pane", "mark").agg(*[F.sum(c).alias(c) for c in ("cpu", "n_cpu", "memory", "n_memory", "samples")],
                                                F.max("max_cpu").alias("max_cpu"))
        first = F.col("pane") - F.pmod("pane", F.lit(self.slide))
        starts = F.filter(F.transform(F.sequence(F.lit(0), F.lit((self.size - 1) // self.slide)), lambda i: first - i * F.lit(self.slide)),
                          lambda s: (s + F.lit(self.size) > F.col("pane")) & (F.col("mark").isNull() | (s + F.lit(self.size) > F.col("mark"))))
        w = p.withColumn("start", F.explode(starts)).filter(F.col("start") + self.size <= F.lit((last or 0) - self.delay))
        out = w.groupBy(HOST, "start").agg(
            F.try_divide(F.sum("cpu"), F.sum("n_cpu")).alias("avg_cpu"), F.max("max_cpu").alias("max_cpu"),
            F.try_divide(F.sum("memory"), F.sum("n_memory")).alias("avg_memory"), F.sum("samples").alias("samples"))
        return out.select(HOST, F.timestamp_micros("start").alias("window_start"),
                          F.timestamp_micros(F.col("start") + self.size).alias("window_end"), "avg_cpu", "max_cpu", "avg_memory", "samples")
