"""Trailing window features over host series.

Column builders here assume a frame prepared by :mod:`.series` (partition
(host, chunk), order ``_rn``); they are plain Catalyst window expressions,
so all frames with the same spec share one Exchange and one Sort.
Semantics follow pandas ``rolling(k, min_periods=1)``: trailing frames of up
to ``k`` rows, sample standard deviation (NULL on a single row).
"""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import HOST, TS
from . import series
from .series import CHUNK, HALO, RN


# --------------------------------------------------------------- W1 - W4
def rolling_mean(c: str, k: int) -> Column:
    return F.avg(c).over(series.rows(-(k - 1), 0))


def rolling_std(c: str, k: int) -> Column:
    return F.stddev_samp(c).over(series.rows(-(k - 1), 0))


def rolling_min(c: str, k: int) -> Column:
    return F.min(c).over(series.rows(-(k - 1), 0))


def rolling_max(c: str, k: int) -> Column:
    return F.max(c).over(series.rows(-(k - 1), 0))


def rolling_quantile(c: str, k: int, q: float) -> Column:
    """Exact linear-interpolated quantile of the trailing ``k`` rows."""
    return F.percentile(F.col(c), F.lit(q)).over(series.rows(-(k - 1), 0))


# --------------------------------------------------------------- W6 - W9
def lag(c: str, n: int) -> Column:
    return F.lag(c, n).over(series.series_window())


def lead(c: str, n: int) -> Column:
    return F.lead(c, n).over(series.series_window())


def rate_of_change(c: str, n: int = 1) -> Column:
    """(x - x[-n]) / x[-n]; 0 on the first ``n`` rows and for a zero base."""
    prev = lag(c, n)
    return F.coalesce(F.try_divide(F.col(c) - prev, prev), F.lit(0.0))


def acceleration(c: str) -> Column:
    """First difference of ``rate_of_change(c, 1)``; 0 on the first row."""
    w = series.series_window()
    p1, p2 = F.lag(c, 1).over(w), F.lag(c, 2).over(w)
    roc_now = F.coalesce(F.try_divide(F.col(c) - p1, p1), F.lit(0.0))
    roc_prev = F.coalesce(F.try_divide(p1 - p2, p2), F.lit(0.0))
    return F.when(p1.isNull(), F.lit(0.0)).otherwise(roc_now - roc_prev)


def volatility(c: str, k: int = 10, eps: float = 0.0, null_as_zero: bool = True) -> Column:
    """std / (mean + eps) over the trailing ``k`` rows."""
    v = F.try_divide(rolling_std(c, k), rolling_mean(c, k) + F.lit(eps))
    return F.coalesce(v, F.lit(0.0)) if null_as_zero else v


def rolling_trend(c: str, k: int = 10) -> Column:
    """Least-squares slope against row position over the trailing ``k``
    rows; 0 when the frame has one row."""
    f = series.rows(-(k - 1), 0)
    return F.coalesce(F.regr_slope(F.col(c), F.col(RN).cast("double")).over(f), F.lit(0.0))


# ------------------------------------------------------------- W12 - W13
def future_max(c: str, h: int) -> Column:
    """max over rows +1..+h; NULL unless row +h exists."""
    return F.when(lead(RN, h).isNotNull(), F.max(c).over(series.rows(1, h)))


# ------------------------------------------------------------------ W10
def with_host_stats(prepared: DataFrame, cols: Sequence[str],
                    prefix: str = "_hs") -> DataFrame:
    """Join per-host mean and sample std of ``cols`` to a chunked frame.

    The statistics are a partial (map-side combined) aggregate per host;
    they are attached on (host, chunk), the key the frame is already
    partitioned on, so only the small side moves and no join partition
    holds more than one chunk.  Where every host is one chunk, they are
    aggregates over the whole chunk in the same window stage as the frames.
    """
    if series.is_whole(prepared):
        chunk = series.rows(Window.unboundedPreceding, Window.unboundedFollowing)
        return prepared.select("*", *[f(c).over(chunk).alias(f"{prefix}_{n}_{c}")
                                      for n, f in (("mean", F.avg), ("std", F.stddev_samp)) for c in cols])
    base = prepared.filter(~F.col(HALO))
    stats = base.groupBy(HOST).agg(
        *[F.avg(c).alias(f"{prefix}_mean_{c}") for c in cols],
        *[F.stddev_samp(c).alias(f"{prefix}_std_{c}") for c in cols])
    chunks = base.select(HOST, CHUNK).distinct()
    return prepared.join(chunks.join(stats, HOST), [HOST, CHUNK])


def zscore(c: str, robust: bool = False, prefix: str = "_hs") -> Column:
    """(x - mean) / std over the host; robust variant gives 0 when std = 0."""
    m, s = F.col(f"{prefix}_mean_{c}"), F.col(f"{prefix}_std_{c}")
    z = F.try_divide(F.col(c) - m, s)
    if robust:
        return F.when(s > 0, z).otherwise(F.lit(0.0))
    return z


def zscore_columns(df: DataFrame, cols: Sequence[str], robust: bool = False) -> DataFrame:
    """W10 as a stand-alone operator: add ``{c}_zscore`` for every column."""
    def build(p):
        j = with_host_stats(p, cols)
        return j.select(*p.columns, *[zscore(c, robust).alias(f"{c}_zscore") for c in cols])
    return series.apply(df, build)


# ------------------------------------------------------------------ W14
def fill_gaps(df: DataFrame, cols: Sequence[str], order: str = "ffill,bfill,zero",
              keys=(HOST,)) -> DataFrame:
    """Fill NULLs of ``cols`` along each host series.

    ``order`` is a comma list of ``ffill`` / ``bfill`` / ``zero`` applied in
    turn (pandas ``ffill().bfill().fillna(0)`` = "ffill,bfill,zero").  Works on
    a frame with ``_rn`` / ``_chunk`` (kept by ``series.apply(...,
    keep_position=True)``) or positions it first.  Values are carried across
    chunks through a per-chunk summary, so no task holds a whole host.
    """
    steps = [s.strip() for s in order.split(",") if s.strip()]
    cols = list(cols)
    keys = list(keys)
    had_position = RN in df.columns and CHUNK in df.columns
    if not had_position:
        df = series.with_chunks(series.with_position(df, keys=keys)).filter(~F.col(HALO)).drop(HALO)
    if not cols:
        return df if had_position else df.drop(RN, CHUNK)
    summ = df.groupBy(*keys, CHUNK).agg(
        *[F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(RN), F.col(c).alias("v"))))
          .getField("v").alias(f"_last_{i}") for i, c in enumerate(cols)],
        *[F.min(F.when(F.col(c).isNotNull(), F.struct(F.col(RN), F.col(c).alias("v"))))
          .getField("v").alias(f"_first_{i}") for i, c in enumerate(cols)])
    wc = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    wb = Window.partitionBy(*keys).orderBy(F.col(CHUNK).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = summ.select(
        *keys, CHUNK,
        *[F.last(f"_last_{i}", ignorenulls=True).over(wc).alias(f"_cin_{i}") for i in range(len(cols))],
        *[F.last(f"_first_{i}", ignorenulls=True).over(wb).alias(f"_cout_{i}") for i in range(len(cols))])
    j = df.join(carry, keys + [CHUNK])
    # both directions run from the frame's start to the current row, which
    # Spark updates row by row; a frame that ends at the partition's end is
    # recomputed for every row
    forth = series.series_window(keys).rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(*keys, CHUNK).orderBy(F.col(RN).desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = []
    for i, c in enumerate(cols):
        prev = F.coalesce(F.last(c, ignorenulls=True).over(forth), F.col(f"_cin_{i}"))
        nxt = F.coalesce(F.last(c, ignorenulls=True).over(back), F.col(f"_cout_{i}"))
        e = F.col(c)
        for s in steps:
            if s == "ffill":
                e = F.coalesce(e, prev)
            elif s == "bfill":
                e = F.coalesce(e, nxt)
            elif s == "zero":
                e = F.coalesce(e, F.lit(0).cast(df.schema[c].dataType))
            else:
                raise ValueError(f"unknown fill step {s!r}")
        out.append(e.alias(c))
    keep = [c for c in df.columns if c not in cols]
    res = j.select(*keep, *out).select(*df.columns)
    return res if had_position else res.drop(RN, CHUNK)


def drop_null_rows(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """The ``dropna`` step: rows with a NULL in any of ``cols``."""
    return df.na.drop(subset=list(cols) if cols is not None else None)


# ------------------------------------------------------------------ W15
def resample(df: DataFrame, period: str, cols: Sequence[str], key: str | None = HOST,
             fill: str = "ffill") -> DataFrame:
    """Regular grid of ``period`` per ``key`` (or the whole fleet when
    ``key`` is None): mean per bucket, every bucket from the key's first to
    last one, gaps forward filled.

    The calendar of a key is bounded by its own first / last bucket, so
    its size grows with the time span, not with the fleet.
    """
    keys = [key] if key else []
    b = F.window(TS, period).start.cast("timestamp_ntz").alias("bucket")
    agg = (df.groupBy(*keys, b)
             .agg(*[F.avg(c).alias(c) for c in cols], F.count(F.lit(1)).alias("samples")))
    span = agg.groupBy(*keys).agg(F.min("bucket").alias("_lo"), F.max("bucket").alias("_hi"))
    cal = span.select(*keys, "_lo", F.explode(F.sequence(
        "_lo", "_hi", F.expr(f"INTERVAL {period}"))).alias("bucket"))
    grid = cal.join(agg, keys + ["bucket"], "left")
    grid = grid.withColumn("samples", F.coalesce("samples", F.lit(0)).cast("long"))
    hk = key or "_fleet"
    if not key:
        grid = grid.withColumn(hk, F.lit(0).cast("long"))
    g = grid.withColumnRenamed(hk, HOST) if hk != HOST else grid
    g = g.withColumnRenamed("bucket", TS)
    # position on a complete grid is arithmetic: no counting pass needed
    g = g.withColumn(RN, F.lit(1).cast("long") + (
        (F.unix_micros(F.col(TS).cast("timestamp"))
         - F.unix_micros(F.col("_lo").cast("timestamp")))
        / F.lit(_period_micros(period))).cast("long")).drop("_lo")
    g = series.with_chunks(g).drop(HALO)
    steps = fill if fill else ""
    if steps:
        g = fill_gaps(g, list(cols), steps)
    g = g.drop(RN, CHUNK)
    if hk != HOST:
        g = g.withColumnRenamed(HOST, hk)
    if not key:
        g = g.drop(hk)
    return g.withColumnRenamed(TS, "bucket")


_UNITS = {"second": 1, "seconds": 1, "minute": 60, "minutes": 60, "hour": 3600,
          "hours": 3600, "day": 86400, "days": 86400}


def _period_micros(period: str) -> int:
    n, unit = period.split()
    return int(n) * _UNITS[unit.lower()] * 1_000_000


# ------------------------------------------------------------------ W16
def sequence_windows(df: DataFrame, features: Sequence[str], length: int = 10,
                     label: str | None = "is_anomaly") -> DataFrame:
    """Every full run of ``length`` rows ending at a row (host series order)
    as ``seq`` = array of feature structs, oldest first; label of the last row."""
    def build(p):
        step = F.struct(F.col("sample_id"), *[F.col(c) for c in features])
        seq = F.collect_list(step).over(series.rows(-(length - 1), 0))
        return p.select(*p.columns, seq.alias("seq"))
    out = series.apply(df, build, lookback=length - 1)
    out = out.filter(F.size("seq") == length)
    keep = [HOST, "sample_id", TS] + ([label] if label else [])
    return out.select(*keep, "seq")


def explode_sequences(seqs: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row per (window end, step) for inspection and comparison."""
    ex = seqs.select(*[c for c in seqs.columns if c != "seq"],
                     F.posexplode("seq").alias("step", "s"))
    return ex.select(*[c for c in ex.columns if c != "s"],
                     F.col("s.sample_id").alias("step_sample_id"),
                     *[F.col(f"s.{c}").alias(f"step_{c}") for c in features])


# ------------------------------------------------------------------ W17
def rolling_apply(df: DataFrame, c: str, k: int, fn, name: str,
                  return_type: str = "double") -> DataFrame:
    """User function over each trailing frame of ``k`` rows.

    ``fn`` maps a pandas Series (the frame, oldest first) to a scalar; it
    runs as an Arrow-batched grouped-aggregate pandas UDF over a bounded
    rows frame, so the JVM streams frames to Python in batches.
    """
    import pandas as pd

    def _agg(v):
        return fn(v)
    # real (not postponed) annotations mark this as a Series -> scalar UDF
    _agg.__annotations__ = {"v": pd.Series, "return": float}
    _agg = F.pandas_udf(_agg, return_type)

    def build(p):
        return p.select(*p.columns, _agg(F.col(c)).over(series.rows(-(k - 1), 0)).alias(name))
    return series.apply(df, build, lookback=k - 1)
