"""Sorted frames against pandas, and packs with and without missing values."""
import math
import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fleet_health.operators import packs, series
from fleet_health.operators.frames import Frames
from fleet_health.schema import BASE_FEATURES, HOST, LABEL, METRIC_COLUMNS, SAMPLE, TS


def samples(spark, gaps: float, hosts=5, rows=70):
    rng, out, sid = random.Random(7), [], 0
    for h in range(hosts):
        for i in range(1 if h == 0 else 2 if h == 1 else rows):
            sid += 1
            v = [None if rng.random() < gaps else (5.0 if h == 2 else round(rng.uniform(1, 99), rng.randint(0, 3))) for _ in METRIC_COLUMNS]
            out.append((h, sid, datetime(2024, 1, 1) + timedelta(minutes=rng.randint(0, 3) + 5 * i), *v, rng.randint(0, 1)))
    cols = ", ".join(f"{c} double" for c in METRIC_COLUMNS)
    return spark.createDataFrame(out, f"{HOST} bigint, {SAMPLE} bigint, {TS} timestamp, {cols}, {LABEL} int")


def same(a, b):
    if a is None or b is None or isinstance(a, float) and math.isnan(a):
        return a is None and b is None
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-7) if isinstance(a, float) else a == b


@pytest.mark.parametrize("gaps", [0.0, 0.3])
def test_frames_equal_pandas(spark, gaps):
    c, ks = BASE_FEATURES[0], (3, 5, 20)
    fr = Frames([c], ks)

    def build(p):
        cols = [f.alias(f"{n}_{k}") for k in ks for n, f in (
            ("mean", fr.mean(c, k)), ("std", fr.std(c, k)), ("min", fr.min(c, k)), ("max", fr.max(c, k)),
            ("q1", fr.quantile(c, k, 0.25)), ("q9", fr.quantile(c, k, 0.9)))]
        return fr.attach(p).select(HOST, SAMPLE, series.RN, series.CHUNK, series.HALO, *cols)
    df = samples(spark, gaps)
    got = {r[SAMPLE]: r.asDict() for r in series.apply(df, build, lookback=19, chunk_rows=32).collect()}
    pdf = df.toPandas().sort_values([HOST, TS, SAMPLE])
    for _, g in pdf.groupby(HOST):
        for k in ks:
            w = g[c].astype(float).rolling(k, min_periods=1)
            want = {"mean": w.mean(), "std": w.std(), "min": w.min(), "max": w.max(), "q1": w.quantile(0.25), "q9": w.quantile(0.9)}
            for n, s in want.items():
                for sid, v in zip(g[SAMPLE], s):
                    r = got[sid][f"{n}_{k}"]
                    assert (r is None and np.isnan(v)) or math.isclose(r, v, rel_tol=1e-6, abs_tol=1e-5), (n, k, sid, r, v)


@pytest.mark.parametrize("pack", [packs.features_basic, packs.features_enhanced, packs.features_robust, packs.features_temporal,
                                  packs.features_debug])
def test_fill_in_the_expression_equals_the_general_fill(spark, pack):
    df = samples(spark, 0.0)
    a = {r[SAMPLE]: r for r in pack(df, whole=True).collect()}
    b = {r[SAMPLE]: r for r in pack(df, whole=False).collect()}
    assert a.keys() == b.keys()
    for k in a:
        for c in a[k].__fields__:
            assert same(a[k][c], b[k][c]), (c, k, a[k][c], b[k][c])


def test_missing_values_take_the_general_fill(spark):
    df = samples(spark, 0.3)
    assert packs._complete(samples(spark, 0.0), BASE_FEATURES) and not packs._complete(df, BASE_FEATURES)
    out = packs.features_robust(df)
    feats = [c for c in out.columns if c not in (HOST, SAMPLE, TS, LABEL)]
    assert out.filter(F.greatest(*[F.col(c).isNull() for c in feats])).count() == 0
    assert packs.features_enhanced(df.limit(0)).count() == 0
