"""Step 7/9 queries: detectors, classifiers, forecasters, search and
evaluation on Spark ML (M1-M13, L13, E6, E9, E10, S9).  Model outputs are
not SQL-expressible, so most have no oracle (rows-only); the kernel
novelty detector (M3) is plain arithmetic and has one."""

from __future__ import annotations

import math
import os
from functools import partial

from pyspark.sql import functions as F

from ..models import grids, iforest, novelty, sequence, supervised as SV
from ..operators import evaluate as E
from ..operators import labels as L
from ..operators import packs, series
from ..operators.knn import local_outlier_factor
from ..schema import BASE_FEATURES, CPU, DISK, HOST, LABEL, MEM, SAMPLE, TS
from ..session import checkpoint_path, materialize
from ..sources.metrics import load_metrics
from .features import fleet_grid
from .registry import query, rounded
from .sqlbase import m

def _robust(spark, sf_dir):
    f = materialize(packs.features_robust(load_metrics(spark, sf_dir)))
    feats = [c for c in f.columns if c not in (HOST, SAMPLE, TS, LABEL)]
    return f, feats


def _split(df, fraction=0.3, seed=42):
    s = materialize(L.stratified_split(df, fraction, seed))
    return s.filter(~F.col("is_test")).drop("is_test"), s.filter(F.col("is_test")).drop("is_test")


def _scored_test(spark, sf_dir):
    f, feats = _robust(spark, sf_dir)
    train, test = _split(f)
    model = SV.weighted_forest(train, feats, num_trees=100, max_depth=10)
    return SV.score_batch(model, test), model, feats


@query("score_batch")
def q_score_batch(spark, sf_dir):
    """M5 + M10: balanced forest (100 trees, depth 10) on the robust
    features; probabilities for the held-out 30 %."""
    sc, _, _ = _scored_test(spark, sf_dir)
    return sc.select(HOST, SAMPLE, TS, LABEL, "anomaly_probability", "prediction")


@query("random_forest_on_smote")
def q_random_forest_on_smote(spark, sf_dir):
    """M6: SMOTE (ratio 0.1, k 2) on training rows only, tested on originals."""
    f, feats = _robust(spark, sf_dir)
    train, test = _split(f)
    _, sc = SV.random_forest_on_smote(train, test, feats, ratio=0.1, k=2, num_trees=100, max_depth=10)
    return sc.select(HOST, SAMPLE, TS, LABEL, "anomaly_probability", "prediction")


@query("cross_validate")
def q_cross_validate(spark, sf_dir):
    """Stratified 5-fold F1 of the anomaly class, mean and 2 x std."""
    f, feats = _robust(spark, sf_dir)
    r = SV.cross_validate(f, feats, k=5, num_trees=100, max_depth=10)
    return spark.range(1).select(F.lit(r["mean_f1"]).alias("mean_f1"), F.lit(r["two_std_f1"]).alias("two_std_f1"))


@query("grid_search")
def q_grid_search(spark, sf_dir):
    """The forest grid of 48 points (trees x depth x split x leaf x class
    weight) with stratified 5-fold F1; each fit takes all rows of its folds."""
    f, feats = _robust(spark, sf_dir)
    return grids.forest_grid(f, feats)


@query("feature_importance_top")
def q_feature_importance_top(spark, sf_dir):
    """The ten most important robust features of the balanced forest."""
    _, model, feats = _scored_test(spark, sf_dir)
    return SV.feature_importance_top(model, feats, 10)


@query("select_top_features")
def q_select_top_features(spark, sf_dir):
    """131 enhanced features -> max(15, n // 3) = 43 by forest importance."""
    f = materialize(packs.features_enhanced(load_metrics(spark, sf_dir)))
    feats = [c for c in f.columns if c not in (HOST, SAMPLE, TS, LABEL)]
    train, _ = _split(f)  # the features are chosen without the test rows
    model = SV.weighted_forest(train, feats, num_trees=100, max_depth=10)
    keep = SV.select_top_features(model, feats)
    return spark.createDataFrame([(i, c) for i, c in enumerate(keep)], "position int, feature string")


@query("split_sensitivity")
def q_split_sensitivity(spark, sf_dir):
    """Precision at test fractions 0.2 / 0.3 / 0.4 with an overfit flag."""
    f, feats = _robust(spark, sf_dir)
    return SV.split_sensitivity(f, feats, num_trees=100, max_depth=10)


@query("resource_forecast")
def q_resource_forecast(spark, sf_dir):
    """M9 + E7: three forest regressors on the forecast features of the
    hourly fleet grid (6 h ahead = 6 grid rows); clamped forecasts and the
    MAE / RMSE on the last 20 % of the hours."""
    g = fleet_grid(load_metrics(spark, sf_dir)).withColumn(HOST, F.lit(0).cast("long")) \
        .withColumn(SAMPLE, F.unix_seconds(F.col(TS).cast("timestamp")))
    k5 = packs.features_forecast(g, horizon=6)
    split = materialize(L.time_ordered_split(k5, 0.2))
    train, test = split.filter(~F.col("is_test")), split.filter(F.col("is_test"))
    models = SV.resource_forecaster(train, packs.FORECAST_FEATURES, horizon=6)
    fc = SV.forecast(models, test)
    return fc.select(TS, "cpu_6h", "memory_6h", "disk_6h", "confidence", "cpu_future_6",
                     "memory_future_6", "disk_future_6")


@query("forecast_model_error")
def q_forecast_model_error(spark, sf_dir):
    """E7 for M9: MAE / RMSE of the forest forecasts on the held-out hours."""
    fc = q_resource_forecast(spark, sf_dir)
    return E.forecast_error(fc, {"cpu": ("cpu_6h", "cpu_future_6"), "memory": ("memory_6h", "memory_future_6"),
                                 "disk": ("disk_6h", "disk_future_6")})


@query("failure_predictor")
def q_failure_predictor(spark, sf_dir):
    """M11 + R18: balanced forest on K6 + L1 (24-row horizon), constant
    p = 0.1 when no failure exists; report for the held-out rows."""
    from ..operators.reports import failure_prediction_report
    mt = load_metrics(spark, sf_dir)
    lab = L.will_fail_label(mt).select(SAMPLE, "will_fail")
    k6 = packs.features_failure(mt).join(lab, SAMPLE)
    s = materialize(L.stratified_split(k6, 0.2, 42, "will_fail"))
    train, test = s.filter(~F.col("is_test")), s.filter(F.col("is_test"))
    model = SV.failure_predictor(train, packs.FAILURE_FEATURES, num_trees=100, max_depth=10)
    pred = SV.predict_failure(model, test)
    return failure_prediction_report(pred).join(
        test.select(SAMPLE, F.col("will_fail").alias("actual_will_fail")), SAMPLE)


def _detector_input(spark, sf_dir):
    return materialize(load_metrics(spark, sf_dir).select(HOST, SAMPLE, TS, LABEL, CPU, MEM, DISK))


def _pack(df, pack):
    """A feature pack of all rows (no value: 0) and its feature names."""
    f = pack(df)
    feats = [c for c in f.columns if c not in (HOST, SAMPLE, TS, LABEL, series.RN)]
    return materialize(f.na.fill(0, feats)), feats


@query("isolation_forest")
def q_isolation_forest(spark, sf_dir):
    """M1: 100 trees, 256 samples, contamination 0.01 on the basic features (K1)."""
    d, feats = _pack(load_metrics(spark, sf_dir), packs.features_basic)
    model = iforest.fit(d, feats, 100, 256)
    return iforest.score(model, d, 0.01).select(HOST, SAMPLE, LABEL, "anomaly_score", "prediction")


@query("isolation_forest_search")
def q_isolation_forest_search(spark, sf_dir):
    """M2: the grid of 81 points (trees x samples x contamination x features) on
    the enhanced features (K2), F1 against the labels; trees grow on their share
    of the whole table."""
    d, feats = _pack(load_metrics(spark, sf_dir), packs.features_enhanced)
    return iforest.search(d, feats, LABEL)


# ------------------------------------------------------------------ M3 (with oracle)
def _novelty_sql() -> str:
    feats = [CPU, MEM, DISK]
    w0, b = novelty.rff_constants(3, novelty.N_COMPONENTS, novelty.RFF_SEED)
    amp = math.sqrt(2.0 / novelty.N_COMPONENTS)
    mean = "((SELECT avg(cpu_percent) FROM metrics) + (SELECT avg(memory_percent) FROM metrics) + (SELECT avg(disk_usage_percent) FROM metrics)) / 3.0"
    var = " + ".join(f"(SELECT avg(({c} - ({mean})) * ({c} - ({mean}))) FROM metrics)" for c in feats)
    gamma = f"(1.0 / (3.0 * (({var}) / 3.0)))"
    phis = []
    for k in range(novelty.N_COMPONENTS):
        z = " + ".join(["0.0"] + [f"{c} * {float(w0[k, j]):.17e}" for j, c in enumerate(feats)])
        phis.append(f"{amp:.17e} * cos(({z}) * sqrt(2.0 * g.gamma) + {float(b[k]):.17e}) AS phi{k}")
    mean = "(0.0 + (SELECT avg(cpu_percent) FROM metrics) + (SELECT avg(memory_percent) FROM metrics) + (SELECT avg(disk_usage_percent) FROM metrics)) / 3"
    var = " + ".join(["0.0"] + [f"(SELECT avg(({c} - ({mean})) * ({c} - ({mean}))) FROM metrics)" for c in feats])
    gamma = f"(1.0 / (3 * (({var}) / 3)))"
    mus = ", ".join(f"avg(phi{k}) AS mu{k}" for k in range(novelty.N_COMPONENTS))
    score = " + ".join(["0.0"] + [f"e.phi{k} * mu.mu{k}" for k in range(novelty.N_COMPONENTS)])
    return m(f"""
SELECT host_id, sample_id, novelty_score,
  row_number() OVER (ORDER BY -novelty_score, sample_id) <= ceil((SELECT count(*) FROM metrics) * 0.01) AS is_novel
FROM (SELECT e.host_id, e.sample_id, -({score}) AS novelty_score FROM emb e, mu) s""",
             f"g AS (SELECT {gamma} AS gamma)",
             f"emb AS (SELECT host_id, sample_id, {', '.join(phis)} FROM metrics, g)",
             f"mu AS (SELECT {mus} FROM emb)")


@query("kernel_novelty", sql=rounded(_novelty_sql(), ["novelty_score"]))
def q_kernel_novelty(spark, sf_dir):
    """M3: random-Fourier-feature novelty score (nu = 0.01) on cpu / memory / disk."""
    d = load_metrics(spark, sf_dir).select(HOST, SAMPLE, CPU, MEM, DISK)
    return novelty.kernel_novelty(d, d, [CPU, MEM, DISK], 0.01).select(HOST, SAMPLE, "novelty_score", "is_novel")


# ------------------------------------------------------------------ M8
@query("sequence_classifier")
def q_sequence_classifier(spark, sf_dir):
    """M8: 10-step windows per host of the temporal features (K4; flattened +
    attention pooling), cut in time order and split by time (L6); boosted trees with early stopping on
    a validation fifth of the training windows."""
    k4, feats = _pack(load_metrics(spark, sf_dir), partial(packs.features_temporal, keep_position=True))
    # the narrow samples are split (each stands for the window it ends) before they are flattened
    s = L.time_ordered_split(k4, 0.2, skip=sequence.SEQUENCE_LENGTH - 1)
    w = sequence.flatten_windows(s, feats)
    train = w.filter(~F.col("is_test")).withColumn("is_val", L.unit_hash(F.col(SAMPLE), 5) < 0.2)
    test = w.filter(F.col("is_test"))
    model = sequence.fit(train, feats, validation_col="is_val")
    return SV.score_batch(model, test).select(HOST, SAMPLE, TS, LABEL, "anomaly_probability", "prediction")


# ------------------------------------------------------------------ S9
@query("save_load_pipeline")
def q_save_load_pipeline(spark, sf_dir):
    """Persist the fitted pipeline in the shared checkpoint folder,
    reload it and score with the reloaded copy."""
    f, feats = _robust(spark, sf_dir)
    train, test = _split(f)
    model = SV.weighted_forest(train, feats, num_trees=100, max_depth=10)
    path = checkpoint_path(spark, f"models/detector-{os.getpid()}")
    SV.save_pipeline(model, path)
    again = SV.load_pipeline(path)
    return SV.score_batch(again, test).select(HOST, SAMPLE, LABEL, "anomaly_probability", "prediction")


# ------------------------------------------------------------------ E6 over models
@query("detector_leaderboard")
def q_detector_leaderboard(spark, sf_dir):
    """Forest, forest on SMOTE, isolation forest, kernel novelty, LOF and
    a two-member vote, evaluated on the same held-out rows, ranked by F1.  The
    unsupervised members are fitted on the training rows too; LOF has no model
    and compares a row with its neighbours among all rows of both parts."""
    f, feats = _robust(spark, sf_dir)
    train, test = _split(f)
    rf = SV.score_batch(SV.weighted_forest(train, feats, num_trees=100, max_depth=10), test) \
        .select(SAMPLE, LABEL, F.col("prediction").alias("random_forest"))
    _, sm = SV.random_forest_on_smote(train, test, feats, ratio=0.1, k=2, num_trees=100, max_depth=10)
    sm = sm.select(SAMPLE, F.col("prediction").alias("random_forest_smote"))
    d = _detector_input(spark, sf_dir)
    held = test.select(SAMPLE)
    d_train, d_test = materialize(d.join(held, SAMPLE, "left_anti")), materialize(d.join(held, SAMPLE, "left_semi"))
    ifm = iforest.fit(d_train, [CPU, MEM, DISK], 100, 256)
    iso = iforest.score(ifm, d_test, 0.06).select(SAMPLE, F.col("prediction").alias("isolation_forest"))
    nov = novelty.kernel_novelty(d_train, d_test, [CPU, MEM, DISK], 0.06).select(
        SAMPLE, F.col("is_novel").cast("int").alias("kernel_novelty"))
    pts = d.select(HOST, SAMPLE, (F.col(CPU) / 100).alias("a"), (F.col(MEM) / 100).alias("b"),
                   (F.col(DISK) / 100).alias("c"))
    from ..operators.knn import top_share
    lof = top_share(local_outlier_factor(pts, ["a", "b", "c"], 20), "lof", 0.06) \
        .select(SAMPLE, F.col("is_outlier").cast("int").alias("local_outlier_factor"))
    j = rf.join(sm, SAMPLE).join(iso, SAMPLE).join(nov, SAMPLE).join(lof, SAMPLE)
    j = j.withColumn("vote_forests", E.vote_ensemble(["random_forest", "random_forest_smote"]))
    models = ["random_forest", "random_forest_smote", "isolation_forest", "kernel_novelty",
              "local_outlier_factor", "vote_forests"]
    return E.model_leaderboard(E.evaluate_predictions(j, models, LABEL), "f1")
