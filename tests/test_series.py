"""Chunked host series: results must not depend on the chunk size."""
import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from fleet_health.operators import packs, rolling as R, series
from fleet_health.sources.metrics import load_metrics


def _rows(df, cols):
    return sorted(tuple(None if v is None else round(v, 9) if isinstance(v, float) else v for v in r)
                  for r in df.select(*cols).collect())


def test_position_is_exact(spark, sf_small):
    m = load_metrics(spark, sf_small)
    pos = series.with_position(m).select("host_id", "sample_id", "_rn").toPandas()
    ref = m.select("host_id", "sample_id", "timestamp").toPandas().sort_values(["host_id", "timestamp", "sample_id"])
    ref["_rn"] = ref.groupby("host_id").cumcount() + 1
    got = pos.merge(ref, on=["host_id", "sample_id"], suffixes=("", "_ref"))
    assert len(got) == len(ref) and (got["_rn"] == got["_rn_ref"]).all()


def test_halo_equals_unchunked(spark, sf_small):
    m = load_metrics(spark, sf_small)
    cols = lambda: [R.rolling_mean("cpu_percent", 5).alias("m5"), R.rolling_std("cpu_percent", 5).alias("s5"),
                    R.lag("cpu_percent", 3).alias("l3"), R.lead("cpu_percent", 4).alias("f4"),
                    R.rolling_trend("cpu_percent", 10).alias("t10")]

    def run(chunk):
        def build(p):
            return p.select("host_id", "sample_id", series.RN, series.CHUNK, series.HALO, *cols())
        return series.apply(m, build, lookback=9, lookahead=4, chunk_rows=chunk)
    big, small = run(1 << 19), run(17)  # small chunks: many halo boundaries
    names = ["host_id", "sample_id", "m5", "s5", "l3", "f4", "t10"]
    assert _rows(big, names) == _rows(small, names)


def test_fill_gaps_across_chunks(spark):
    t0 = dt.datetime(2024, 1, 1)
    vals = [None, None, 3.0, None, None, None, 7.0, None, None, None, None]
    rows = [(1, i, t0 + dt.timedelta(hours=i), v) for i, v in enumerate(vals)]
    rows += [(2, 100 + i, t0 + dt.timedelta(hours=i), None) for i in range(4)]
    df = spark.createDataFrame(rows, "host_id long, sample_id long, timestamp timestamp_ntz, x double")
    p = series.with_chunks(series.with_position(df), chunk_rows=3).drop(series.HALO)
    out = R.fill_gaps(p, ["x"], "ffill,bfill").drop(series.RN, series.CHUNK).toPandas().sort_values("sample_id")
    h1 = out[out.host_id == 1]["x"].tolist()
    assert h1 == [3.0, 3.0, 3.0, 3.0, 3.0, 3.0, 7.0, 7.0, 7.0, 7.0, 7.0]
    assert out[out.host_id == 2]["x"].isna().all()  # all-NULL host stays NULL
    z = R.fill_gaps(df, ["x"], "ffill,bfill,zero").toPandas()
    assert (z[z.host_id == 2]["x"] == 0.0).all()


def test_single_row_and_zero_base(spark):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, 1, t0, 0.0), (1, 2, t0 + dt.timedelta(hours=1), 5.0),
                                (2, 3, t0, 9.0)], "host_id long, sample_id long, timestamp timestamp_ntz, cpu_percent double")

    def build(p):
        return p.select("host_id", "sample_id", series.RN, series.CHUNK, series.HALO,
                        R.rolling_std("cpu_percent", 5).alias("s"), R.rate_of_change("cpu_percent", 1).alias("r"),
                        R.rolling_trend("cpu_percent", 10).alias("t"))
    got = {r.sample_id: r for r in series.apply(df, build, lookback=9).collect()}
    assert got[3].s is None and got[3].t == 0.0          # one row: NULL std, zero slope
    assert got[2].r == 0.0                                # zero base -> 0
    assert got[1].r == 0.0                                # first row -> 0


def test_pack_widths(spark, sf_small):
    m = load_metrics(spark, sf_small)
    ids = {"host_id", "sample_id", "timestamp", "is_anomaly"}
    width = lambda df: len([c for c in df.columns if c not in ids])
    assert width(packs.features_basic(m)) == 28
    assert width(packs.features_enhanced(m)) == 131
    assert width(packs.features_robust(m)) == 30
    assert width(packs.features_temporal(m)) == 40
    assert width(packs.features_debug(m)) == 23
    assert width(packs.features_failure(m)) == 17
