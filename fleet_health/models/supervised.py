"""Supervised models on Spark ML.

Training data stays distributed end to end: features are assembled with
``VectorAssembler``, trees are grown by Spark's distributed random forest,
and evaluation uses the aggregate operators of :mod:`..operators.evaluate`.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import labels as L
from ..schema import LABEL, SAMPLE
from ..session import materialize

MAX_TREE_DEPTH = 30  # Spark's limit; an unlimited depth maps to it
TASK_ROWS = 1 << 18  # rows of a forest's task, about
SMALL_ROWS = 1 << 14  # rows a core below which a table is left as it is dealt


def _depth(d):
    return MAX_TREE_DEPTH if d is None else min(int(d), MAX_TREE_DEPTH)


def _even(train: DataFrame) -> DataFrame:
    """``train`` dealt evenly over a multiple of the cores: every level of the
    trees is a stage over these partitions, and one more than the cores makes
    it last twice as long."""
    cores, n = train.sparkSession.sparkContext.defaultParallelism, train.count()
    if n < cores * SMALL_ROWS:
        return train
    return train.repartition(cores * max(1, round(n / (cores * TASK_ROWS))))


def random_forest(train: DataFrame, features: Sequence[str], label: str = LABEL,
                  num_trees: int = 100, max_depth: int | None = 10, weight_col: str | None = None,
                  min_instances: int = 1, seed: int = 42) -> PipelineModel:
    """M5: VectorAssembler + RandomForestClassifier (probability column).  Each
    row keeps its node in every tree, so no level walks the trees from the root;
    ``train`` is read several times and should be materialized."""
    asm = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    rf = RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=num_trees,
                                maxDepth=_depth(max_depth), minInstancesPerNode=min_instances, seed=seed, cacheNodeIds=True)
    if weight_col:
        rf.setWeightCol(weight_col)
    data = _even(train).withColumn(label, F.col(label).cast("double"))
    return Pipeline(stages=[asm, rf]).fit(data)


def score_batch(model: PipelineModel, df: DataFrame, threshold: float = 0.5,
                p_name: str = "anomaly_probability") -> DataFrame:
    """Probability of class 1 and the 0/1 prediction p > threshold."""
    out = model.transform(df)
    p = vector_to_array(F.col("probability"))[1]
    keep = [c for c in df.columns]
    return out.select(*keep, p.alias(p_name), (p > threshold).cast("int").alias("prediction"))


def weighted_forest(train: DataFrame, features, label: str = LABEL, **kw) -> PipelineModel:
    """M5 with balanced class weights."""
    w = L.balanced_class_weights(train, label, "_w")
    return random_forest(w, features, label, weight_col="_w", **kw)


def random_forest_on_smote(train: DataFrame, test: DataFrame, features, label: str = LABEL,
                           ratio: float = 0.1, k: int = 2, **kw):
    """M6: SMOTE (L8) on the training rows, forest fit, scored on the
    untouched test rows.  Returns (model, scored test)."""
    from ..operators.knn import smote
    bal = materialize(smote(train.select(SAMPLE, label, *features), features, ratio=ratio, k=k, label=label))
    model = random_forest(bal, features, label, **kw)
    return model, score_batch(model, test)


def feature_importances(model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """E10 source: (feature, importance) rows from the fitted forest."""
    # one value per input feature: a model-sized (not data-sized) table
    from pyspark.sql import SparkSession
    imp = model.stages[-1].featureImportances.toArray().tolist()
    s = SparkSession.getActiveSession()
    return s.createDataFrame([(f, float(v)) for f, v in zip(features, imp)], "feature string, importance double")


def feature_importance_top(model: PipelineModel, features: Sequence[str], k: int = 10) -> DataFrame:
    """The ``k`` most important features, descending."""
    return feature_importances(model, features).orderBy(F.col("importance").desc(), "feature").limit(k)


def select_top_features(model: PipelineModel, features: Sequence[str], minimum: int = 15,
                        fraction: float = 1 / 3) -> list[str]:
    """Keep max(15, n // 3) features by forest importance (131 -> 43)."""
    n = len(features)
    keep = min(n, max(minimum, int(n * fraction + 1e-9)))
    imp = model.stages[-1].featureImportances.toArray()
    order = sorted(range(n), key=lambda i: (-imp[i], i))[:keep]
    return [features[i] for i in sorted(order)]


def slice_features(df: DataFrame, all_features: Sequence[str], selected: Sequence[str]) -> DataFrame:
    """Apply L13 to an assembled vector with ``VectorSlicer``."""
    idx = [list(all_features).index(f) for f in selected]
    return VectorSlicer(inputCol="features", outputCol="selected_features", indices=idx).transform(df)


def stratified_folds(df: DataFrame, k: int = 5, seed: int = 42, label: str = LABEL) -> DataFrame:
    """fold = (hash rank within class) mod k, so every fold keeps the class mix."""
    r = L.rank_within(df, [label], L.unit_hash(F.col(SAMPLE), seed))
    return r.withColumn("fold", (F.pmod(F.col("_rank") - 1, F.lit(k))).cast("int")).drop("_rank")


def cross_validate(df: DataFrame, features, label: str = LABEL, k: int = 5, num_trees: int = 100,
                   max_depth: int | None = 10, seed: int = 42, parallelism: int = 2):
    """Stratified k-fold F1 of the anomaly class; mean and 2 x std."""
    # the folds are cut once, not for each fit and evaluation
    data = _even(materialize(stratified_folds(df.select(SAMPLE, label, *features), k, seed, label)))
    data = data.withColumn(label, F.col(label).cast("double"))
    asm = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    rf = RandomForestClassifier(labelCol=label, numTrees=num_trees, maxDepth=_depth(max_depth), seed=seed, cacheNodeIds=True)
    ev = MulticlassClassificationEvaluator(labelCol=label, metricName="fMeasureByLabel", metricLabel=1.0)
    grid = ParamGridBuilder().addGrid(rf.numTrees, [num_trees]).build()
    cv = CrossValidator(estimator=Pipeline(stages=[asm, rf]), estimatorParamMaps=grid, evaluator=ev,
                        foldCol="fold", numFolds=k, parallelism=parallelism, seed=seed)
    m = cv.fit(data)
    return {"mean_f1": float(m.avgMetrics[0]), "two_std_f1": 2 * float(m.stdMetrics[0]), "model": m.bestModel}


def split_sensitivity(df: DataFrame, features, label: str = LABEL, fractions=(0.2, 0.3, 0.4),
                      seed: int = 42, **kw) -> DataFrame:
    """Refit at several test fractions; precision 1.0 flags overfitting."""
    out = None
    for f in fractions:
        s = materialize(L.stratified_split(df.select(SAMPLE, label, *features), f, seed, label))
        train, test = s.filter(~F.col("is_test")), s.filter(F.col("is_test"))
        model = weighted_forest(train, features, label, **kw)
        sc = score_batch(model, test)
        res = E.evaluate_predictions(sc, ["prediction"], label).select(
            F.lit(f).alias("test_fraction"), "precision", "recall", "f1",
            (F.col("precision") == 1.0).alias("overfit_warning"))
        out = res if out is None else out.unionByName(res)
    return out


# ------------------------------------------------------------------ M9
FORECAST_CONFIDENCE = 0.85


def resource_forecaster(train: DataFrame, features: Sequence[str], horizon: int = 72,
                        num_trees: int = 100, max_depth: int = 10, seed: int = 42) -> dict:
    """Three forest regressors (cpu, memory, disk at +horizon rows)."""
    asm = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    models = {}
    for t in ("cpu", "memory", "disk"):
        rf = RandomForestRegressor(labelCol=f"{t}_future_{horizon}", numTrees=num_trees,
                                   maxDepth=max_depth, seed=seed, predictionCol=f"{t}_6h_raw")
        models[t] = Pipeline(stages=[asm, rf]).fit(train)
    return models


def forecast(models: dict, df: DataFrame) -> DataFrame:
    """Apply M9 and clamp every forecast to 0..100 (P4); constant confidence."""
    from ..functions.scalar import clamp_percent
    out = df
    for t, mdl in models.items():
        out = mdl.transform(out).drop("features")
        out = out.withColumn(f"{t}_6h", clamp_percent(F.col(f"{t}_6h_raw"))).drop(f"{t}_6h_raw")
    return out.withColumn("confidence", F.lit(FORECAST_CONFIDENCE))


# ------------------------------------------------------------------ M11
FALLBACK_PROBABILITY = 0.1


def failure_predictor(train: DataFrame, features: Sequence[str], label: str = "will_fail", **kw):
    """Balanced forest on K6 + L1; a constant model (p = 0.1) when the
    training data has no failure."""
    positives = train.filter(F.col(label) == 1).limit(1).count()
    if positives == 0:
        return None
    return weighted_forest(train, features, label, **kw)


def predict_failure(model, df: DataFrame) -> DataFrame:
    if model is None:
        return df.withColumn("failure_probability", F.lit(FALLBACK_PROBABILITY))
    return score_batch(model, df, p_name="failure_probability").drop("prediction")


# ------------------------------------------------------------------ S9
def save_pipeline(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)
