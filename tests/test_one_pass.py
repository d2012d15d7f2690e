"""Work that is done once: positions of small hosts, balanced and folded training rows, nodes of trees."""
import datetime as dt

from pyspark.sql import functions as F

from fleet_health.models import supervised as SV
from fleet_health.operators import knn, packs, rolling as R, series
from fleet_health.operators import labels as L

T0 = dt.datetime(2024, 1, 1)


def _metrics(spark, n=400, hosts=3):
    return spark.range(n).select(
        (F.col("id") % hosts).alias("host_id"), F.col("id").alias("sample_id"),
        (F.lit(T0) + F.make_dt_interval(mins=(F.col("id") * 37 % 4000).cast("int"))).cast("timestamp_ntz").alias("timestamp"),
        *[((F.col("id") * k) % 101).cast("double").alias(c)
          for k, c in ((7, "cpu_percent"), (11, "memory_percent"), (13, "memory_used_gb"), (17, "disk_usage_percent"), (19, "disk_used_gb"))],
        (F.col("id") % 10 == 0).cast("int").alias("is_anomaly"))


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _values(df):
    return sorted(tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in r) for r in df.collect())


def test_small_hosts_are_read_once(spark):
    p = _plan(packs.features_robust(_metrics(spark), whole=True))
    assert p.count("Range (") == 1 and "Join" not in p, p


def test_pack_does_not_depend_on_the_way_of_positions(spark):
    m = _metrics(spark)
    whole = _values(packs.features_robust(m))
    spark.conf.set("fleet_health.series.chunkRows", "17")
    try:
        assert not series.fits(m)
        assert _values(packs.features_robust(m)) == whole
    finally:
        spark.conf.unset("fleet_health.series.chunkRows")


def test_rows_without_host_or_time_have_no_position(spark):
    rows = [(1, 1, None), (1, 2, T0), (1, 3, T0 + dt.timedelta(hours=2)), (None, 4, T0), (2, 5, T0), (2, 6, T0)]
    df = spark.createDataFrame(rows, "host_id long, sample_id long, timestamp timestamp_ntz")
    one = series.with_position(df, whole=True).select("sample_id", series.RN)
    many = series.with_position(df, whole=False).select("sample_id", series.RN)
    assert one.schema == many.schema
    assert _values(one) == _values(many) == [(2, 2), (3, 3), (5, 1), (6, 2)]


def test_host_stats_of_whole_hosts(spark):
    m = _metrics(spark, 60)

    def build(p):
        assert series.is_whole(p)
        return R.with_host_stats(p, ["cpu_percent"])
    got = {r[0]: (r[1], r[2]) for r in series.apply(m, build).select("host_id", "_hs_mean_cpu_percent", "_hs_std_cpu_percent").distinct().collect()}
    for r in m.groupBy("host_id").agg(F.avg("cpu_percent"), F.stddev_samp("cpu_percent")).collect():
        assert abs(got[r[0]][0] - r[1]) < 1e-9 and abs(got[r[0]][1] - r[2]) < 1e-9


def test_training_rows_are_made_once(spark, monkeypatch):
    """The forest gets SMOTE rows, folds and splits as written tables, not as plans to be run for each of its passes."""
    seen = []
    monkeypatch.setattr(SV, "random_forest", lambda train, *a, **k: seen.append(_plan(train)))
    monkeypatch.setattr(SV, "score_batch", lambda model, test, *a: test.withColumn("prediction", F.lit(0)))
    feats = ["cpu_percent", "memory_percent"]
    m = _metrics(spark)
    SV.random_forest_on_smote(m, m, feats, ratio=0.3, k=2)
    SV.split_sensitivity(m, feats, fractions=(0.3,))
    assert len(seen) == 2
    assert not any("Window" in p or "Range (" in p or "Generate" in p for p in seen), seen


def test_smoteenn_cleans_written_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(knn, "edited_nearest_neighbours", lambda df, *a, **k: seen.append(_plan(df)) or df)
    knn.balance(_metrics(spark), ["cpu_percent", "memory_percent"], "smoteenn")
    assert "Window" not in seen[0] and "Generate" not in seen[0]


def test_node_cache_grows_the_same_forest(spark):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    feats = ["cpu_percent", "memory_percent", "disk_usage_percent"]
    m = _metrics(spark).coalesce(1).orderBy("sample_id").checkpoint()
    got = SV.random_forest(m, feats, num_trees=5, max_depth=6).stages[-1]
    assert got.getCacheNodeIds()
    asm = VectorAssembler(inputCols=feats, outputCol="features").transform(m)
    plain = RandomForestClassifier(labelCol="is_anomaly", numTrees=5, maxDepth=6, seed=42).fit(asm)
    assert [t.toDebugString.split("\n", 1)[1] for t in got.trees] == [t.toDebugString.split("\n", 1)[1] for t in plain.trees]


def test_even_deals_by_cores(spark, monkeypatch):
    m = _metrics(spark, 4000).select("sample_id", "is_anomaly", "cpu_percent")
    assert SV._even(m) is m  # a small table stays as it is
    monkeypatch.setattr(SV, "SMALL_ROWS", 10)
    monkeypatch.setattr(SV, "TASK_ROWS", 100)
    cores = spark.sparkContext.defaultParallelism
    even = SV._even(m)
    assert even.select(F.spark_partition_id()).distinct().count() == cores * round(4000 / (cores * 100))
    assert _values(even) == _values(m)
