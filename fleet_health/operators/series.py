"""Ordered per-host series that do not depend on one task per host.

Every rolling / lag / lead feature is a window over one host's samples in
(timestamp, sample_id) order.  A plain ``Window.partitionBy(host)`` sorts a
whole host inside one task, which fails when a single host holds a large
share of the fleet's rows.  The helpers here split each host into chunks
of at most ``chunk_rows`` rows and copy the few boundary rows a bounded
frame needs into the neighbouring chunk (a halo), so results are exactly
those of the per-host window while every task stays bounded:

1. ``with_position`` gives each row its exact 1-based position ``_rn`` in
   its host.  Where no host has more rows than a chunk (one count), that is
   a row number in one window over the host.  Otherwise rows are counted
   per (host, time bucket) with a partial aggregate; cumulative offsets are
   taken over that count table, and the position inside a bucket comes from
   a window partitioned by (host, bucket).  No task ever sorts more than one
   chunk or one bucket of one host.
2. ``with_chunks`` assigns ``_chunk = (_rn - 1) div chunk_rows`` and adds
   halo copies (``_halo = true``) of the last ``lookback`` rows of a chunk
   to the next chunk and of the first ``lookahead`` rows to the previous
   one.
3. ``series_window`` is the window spec partitioned by (host, chunk) and
   ordered by ``_rn``; frames of ``rowsBetween(-lookback, lookahead)`` see
   exactly the rows they would see in the per-host window.
4. ``drop_halo`` removes the copies again.

Unbounded frames (forward / backward fill) carry a per-chunk summary
across chunks instead (see ``rolling.fill_gaps``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import HOST, SERIES_ORDER, TS
from ..session import materialize

RN = "_rn"
CHUNK = "_chunk"
HALO = "_halo"
_BUCKET = "_bucket"
_OFFSET = "_offset"
WHOLE = "whole"

# Rows per chunk.  Bounded so one window task holds at most this many rows
# of one host (plus halo) regardless of how skewed hosts are.
DEFAULT_CHUNK_ROWS = 1 << 19
# Granularity of the counting step in ``with_position``.
DEFAULT_BUCKET = "hour"


def _conf(df: DataFrame, key: str, default):
    try:
        v = df.sparkSession.conf.get(key, None)
    except Exception:  # pragma: no cover - conf lookup never fails in practice
        v = None
    return type(default)(v) if v is not None else default


def host_window(partition=(HOST,), order=SERIES_ORDER):
    """The plain per-host window (small tables: counts, chunks, summaries)."""
    return Window.partitionBy(*partition).orderBy(*order)


def fits(df: DataFrame, keys=(HOST,), chunk_rows: int | None = None) -> bool:
    """True if no key has more rows than one chunk holds: one count per key."""
    c = chunk_rows or _conf(df, "fleet_health.series.chunkRows", DEFAULT_CHUNK_ROWS)
    most = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n").alias("most")).first()["most"]
    return (most or 0) <= c


def with_position(df: DataFrame, bucket: str | None = None, keys=(HOST,),
                  order=SERIES_ORDER, bucket_expr: Column | None = None, whole: bool | None = None) -> DataFrame:
    """Add ``_rn``: exact 1-based position of each row inside its key
    (default: host) in ``order``.  Rows are counted per (key, bucket) where
    the bucket is ``date_trunc(bucket, order[0])`` or ``bucket_expr``; the
    bucket must be monotone in ``order`` (later columns only break ties).
    Keys that fit a chunk each (``whole``, counted when not given) need no
    buckets.  Rows without a key or a first order value have no position."""
    if RN in df.columns:
        return df
    keys = list(keys)
    order = list(order)
    if bucket_expr is None:
        if fits(df, keys) if whole is None else whole:
            first = F.col(order[0]) if isinstance(order[0], str) else order[0]
            known = first.isNotNull()
            for k in keys:
                known = known & F.col(k).isNotNull()
            return df.withColumn(RN, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).filter(known)
        bucket = bucket or _conf(df, "fleet_health.series.bucket", DEFAULT_BUCKET)
        bucket_expr = F.date_trunc(bucket, F.col(order[0]) if isinstance(order[0], str) else order[0])
    b = df.withColumn(_BUCKET, bucket_expr)
    counts = b.groupBy(*keys, _BUCKET).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        *keys, _BUCKET,
        F.coalesce(F.sum("_n").over(
            Window.partitionBy(*keys).orderBy(_BUCKET)
            .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(_OFFSET))
    pos = b.join(offsets, keys + [_BUCKET])
    w = Window.partitionBy(*keys, _BUCKET).orderBy(*order)
    return (pos.withColumn(RN, F.col(_OFFSET) + F.row_number().over(w))
               .drop(_BUCKET, _OFFSET))


def global_position(df: DataFrame, order, name: str = RN, weight: str | None = None) -> DataFrame:
    """Add ``name``: the exact 1-based position of each row in ``order`` over
    the whole table (with ``weight``, a column of row counts: that of its last).  Rows are dealt over range partitions of ``order``, which
    Spark balances by sampling whatever the values' distribution; counts of the
    partitions (one row each) give the offsets.  ``order`` must tell rows apart
    for one value not to fill a partition alone."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = materialize(df.repartitionByRange(parts, *cols).withColumn(_BUCKET, F.spark_partition_id()))
    one = F.col(weight) if weight else F.lit(1).cast("long")
    counts = held.groupBy(_BUCKET).agg(F.sum(one).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(_BUCKET, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(_OFFSET))
    w = Window.partitionBy(_BUCKET).orderBy(*cols)
    inside = F.sum(one).over(w.rowsBetween(Window.unboundedPreceding, 0)) if weight else F.row_number().over(w)
    return (held.join(F.broadcast(offsets), _BUCKET)  # one row per partition
            .withColumn(name, F.col(_OFFSET) + inside).drop(_BUCKET, _OFFSET))


def with_chunks(df: DataFrame, lookback: int = 0, lookahead: int = 0,
                chunk_rows: int | None = None) -> DataFrame:
    """Add ``_chunk`` and halo copies for frames reaching ``lookback`` rows
    back and ``lookahead`` rows ahead.  ``df`` must carry ``_rn``."""
    c = chunk_rows or _conf(df, "fleet_health.series.chunkRows", DEFAULT_CHUNK_ROWS)
    if lookback + lookahead >= c:
        raise ValueError("chunk_rows must exceed lookback + lookahead")
    idx = F.col(RN) - 1
    chunk = F.floor(idx / F.lit(c)).cast("long")
    pos = F.pmod(idx, F.lit(c))
    copies = [F.struct(chunk.alias("c"), F.lit(False).alias("h"))]
    if lookback > 0:
        copies.append(F.when(pos >= c - lookback,
                             F.struct((chunk + 1).alias("c"), F.lit(True).alias("h"))))
    if lookahead > 0:
        copies.append(F.when((pos < lookahead) & (chunk > 0),
                             F.struct((chunk - 1).alias("c"), F.lit(True).alias("h"))))
    if len(copies) == 1:
        return df.withColumn(CHUNK, chunk).withColumn(HALO, F.lit(False))
    ex = F.explode(F.filter(F.array(*copies), lambda x: x.isNotNull())).alias("_cp")
    return (df.select("*", ex)
              .withColumn(CHUNK, F.col("_cp.c"))
              .withColumn(HALO, F.col("_cp.h"))
              .drop("_cp"))


def series_window(keys=(HOST,)):
    """Window over one chunk of one key (host) in series order."""
    return Window.partitionBy(*keys, CHUNK).orderBy(RN)


def rows(lo: int, hi: int = 0, keys=(HOST,)):
    """Bounded rows frame ``lo..hi`` relative to the current row."""
    return series_window(keys).rowsBetween(lo, hi)


def prepare(df: DataFrame, lookback: int = 0, lookahead: int = 0,
            chunk_rows: int | None = None, keys=(HOST,), order=SERIES_ORDER) -> DataFrame:
    whole = RN not in df.columns and fits(df, keys, chunk_rows)
    out = with_chunks(with_position(df, keys=keys, order=order, whole=whole), lookback, lookahead, chunk_rows)
    return out.withMetadata(CHUNK, {WHOLE: True}) if whole else out


def is_whole(prepared: DataFrame) -> bool:
    """True if every key of a prepared series stands in one chunk."""
    return prepared.schema[CHUNK].metadata.get(WHOLE, False)


def drop_halo(df: DataFrame, keep_position: bool = False) -> DataFrame:
    """Remove halo copies; ``keep_position`` keeps ``_rn`` and ``_chunk`` for
    a following per-chunk step (fills, running counts)."""
    out = df.filter(~F.col(HALO)).drop(HALO)
    return out if keep_position else out.drop(RN, CHUNK)


def apply(df: DataFrame, build, lookback: int = 0, lookahead: int = 0,
          chunk_rows: int | None = None, keep_position: bool = False,
          keys=(HOST,), order=SERIES_ORDER) -> DataFrame:
    """Run ``build(prepared_df) -> DataFrame`` over the chunked series and
    remove the halo afterwards.  ``build`` uses ``series_window`` / ``rows``.

    The rows are dealt to their chunks by the number of shuffle partitions: it
    is the exchange the windows need in any case, but adaptive execution, which
    goes by bytes alone, would run a small table's many frames in one task."""
    prepared = prepare(df, lookback, lookahead, chunk_rows, keys, order)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    prepared = prepared.repartition(parts, *keys, CHUNK)
    return drop_halo(build(prepared), keep_position)


def first_rows_flag(n: int) -> Column:
    """True on the first ``n`` rows of a host."""
    return F.col(RN) <= n
