"""Model properties: planted outliers rank first, forests beat a constant
model, balanced weights sum to n, novelty scores are finite."""
import numpy as np
from pyspark.sql import functions as F

from fleet_health.models import iforest, novelty, supervised as SV
from fleet_health.operators import evaluate as E, labels as L
from fleet_health.sources.metrics import load_metrics


def _frame(spark, n=600, seed=0):
    rng = np.random.RandomState(seed)
    x = rng.normal(50, 5, size=(n, 3))
    x[:6] = [[99, 99, 99], [1, 1, 1], [99, 1, 99], [1, 99, 1], [99, 99, 1], [1, 1, 99]]
    rows = [(int(i), 0, float(a), float(b), float(c), int(i < 6)) for i, (a, b, c) in enumerate(x)]
    return spark.createDataFrame(rows, "sample_id long, host_id long, a double, b double, c double, is_anomaly int")


def test_isolation_forest_ranks_planted_outliers(spark):
    df = _frame(spark)
    m = iforest.fit(df, ["a", "b", "c"], n_trees=50, max_samples=128, seed=1)
    sc = iforest.score(m, df, contamination=0.01)
    flagged = sorted(r.sample_id for r in sc.filter("prediction = 1").collect())
    assert flagged == [0, 1, 2, 3, 4, 5]


def test_kernel_novelty_flags_outliers(spark):
    df = _frame(spark, seed=1)
    out = novelty.kernel_novelty(df, df, ["a", "b", "c"], nu=0.01)
    flagged = {r.sample_id for r in out.filter("is_novel").collect()}
    assert len(flagged & set(range(6))) >= 5


def test_forest_beats_constant(spark, sf_small):
    m = load_metrics(spark, sf_small)
    s = L.stratified_split(m, 0.3, 42)
    train, test = s.filter(~F.col("is_test")), s.filter(F.col("is_test"))
    model = SV.weighted_forest(train, ["cpu_percent", "memory_percent", "disk_usage_percent"], num_trees=20, max_depth=6)
    sc = SV.score_batch(model, test)
    ev = E.evaluate_predictions(sc.withColumn("const", F.lit(0)), ["prediction", "const"]).collect()
    f1 = {r.model: r.f1 for r in ev}
    assert f1["prediction"] > f1["const"]


def test_balanced_weights_sum_to_n(spark, sf_small):
    m = load_metrics(spark, sf_small)
    w = L.balanced_class_weights(m)
    total = w.agg(F.sum("weight")).first()[0]
    assert abs(total - m.count()) < 1e-6


def test_stratified_split_is_exact(spark, sf_small):
    m = load_metrics(spark, sf_small)
    s = L.stratified_split(m, 0.2, 7)
    got = {r.is_anomaly: (r.n, r.t) for r in s.groupBy("is_anomaly").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_test").alias("t")).collect()}
    for cls, (n, t) in got.items():
        assert t == int(np.floor(n * 0.2 + 0.5))
