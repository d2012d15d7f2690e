"""Streaming twins equal their batch queries (availableNow over files)."""
import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def _set(df, cols):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect())


def test_stream_cooldown_equals_batch(spark):
    q = E.queries()
    cols = ["host_id", "sample_id", "consecutive", "level"]
    assert _set(q["stream_alert_cooldown"](spark, SF), cols) == _set(q["alert_cooldown"](spark, SF), cols)


def test_stream_buffer_equals_pack_rows_from_ten(spark):
    q = E.queries()
    s = q["stream_buffer_features"](spark, SF)
    t = q["features_temporal"](spark, SF)
    from pyspark.sql import functions as F
    from fleet_health.operators import series
    rn = series.with_position(t.select("host_id", "sample_id", "timestamp")).select("sample_id", "_rn")
    t10 = t.join(rn, "sample_id").filter(F.col("_rn") >= 10)
    cols = ["host_id", "sample_id", "cpu_percent_rolling_std_5", "memory_percent_roc", "resource_pressure", "hour"]
    assert _set(s, cols) == _set(t10, cols)


def test_stream_ingest_keeps_every_row(spark):
    q = E.queries()
    assert q["stream_ingest"](spark, SF).count() == q["select_features"](spark, SF).count()


def test_stream_score_leaves_its_training_rows_alone(spark):
    """Only each host's later 30 % are scored, each once, from their tenth sample on."""
    from fleet_health.operators import labels as L
    from fleet_health.sources.metrics import load_metrics
    out = E.queries()["stream_score"](spark, SF).cache()
    split = L.time_ordered_split(load_metrics(spark, SF), 0.3)
    later = {r.sample_id for r in split.filter("is_test").select("sample_id").collect()}
    got = [r.sample_id for r in out.select("sample_id").collect()]
    per = split.filter("is_test").groupBy("host_id").count().collect()
    assert set(got) <= later and len(set(got)) == len(got) == sum(max(0, r["count"] - 9) for r in per)
