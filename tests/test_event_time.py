"""Event-time streams: restarts, late rows, silent hosts, and native twins."""
import shutil

import pytest
from pyspark.sql import functions as F

from fleet_health.plans import streams as P
from fleet_health.schema import HOST, LABEL, SAMPLE, TS
from fleet_health.sources.metrics import load_metrics
from fleet_health.streaming import event_time as ET
from fleet_health.streaming import stateful as ST

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def metrics(spark):
    return ST.to_event_time(load_metrics(spark, SF).drop(LABEL)).cache()


def rows(df, *cols):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect())


def test_refresh_goes_on_from_its_checkpoint(spark, metrics, tmp_path):
    """Half of the files, a stop, the other half: the windows of one run over all, each once."""
    files = ST.write_time_ordered_files(metrics, str(tmp_path / "all"), 6)
    whole = ET.refresh_stream(ST.file_stream(spark, str(tmp_path / "all"), metrics.schema))
    ET.drain(whole, str(tmp_path / "sink1"), str(tmp_path / "ck1"))
    src = tmp_path / "src"
    src.mkdir()
    for part in files[:3]:
        shutil.copytree(part, src / part.rsplit("/", 1)[1])
    go = lambda: ET.drain(ET.refresh_stream(ST.file_stream(spark, str(src), metrics.schema)), str(tmp_path / "sink2"), str(tmp_path / "ck2"))
    go()
    early = spark.read.parquet(str(tmp_path / "sink2")).count()
    for part in files[3:]:
        shutil.copytree(part, src / part.rsplit("/", 1)[1])
    go()
    a, b = (spark.read.parquet(str(tmp_path / s)) for s in ("sink1", "sink2"))
    assert 0 < early < b.count()
    assert rows(a, HOST, "refresh_at", SAMPLE) == rows(b, HOST, "refresh_at", SAMPLE)
    last = metrics.agg(F.max(TS)).first()[0]
    batch = ST.periodic_refresh_batch(metrics.withColumn(TS, F.col(TS).cast("timestamp_ntz")))
    batch = batch.filter(F.col("refresh_at").cast("timestamp") + F.expr("INTERVAL 75 MINUTES") < F.lit(last))
    assert rows(batch, HOST, SAMPLE) == rows(b, HOST, SAMPLE)


def test_silent_hosts_are_refreshed(spark, metrics, tmp_path):
    """A host without rows in the later files is emitted by its timer."""
    cut = metrics.agg(F.expr(f"percentile(unix_micros({TS}), 0.4)")).first()[0]
    quiet = metrics.agg(F.min(HOST)).first()[0]
    df = metrics.filter((F.col(HOST) != quiet) | (F.unix_micros(TS) < cut))
    ST.write_time_ordered_files(df, str(tmp_path / "src"), 4)
    ET.drain(ET.refresh_stream(ST.file_stream(spark, str(tmp_path / "src"), df.schema)), str(tmp_path / "sink"), str(tmp_path / "ck"))
    got = spark.read.parquet(str(tmp_path / "sink")).filter(F.col(HOST) == quiet).agg(F.max(SAMPLE)).first()[0]
    last = df.filter(F.col(HOST) == quiet).orderBy(F.col(TS).desc(), F.col(SAMPLE).desc()).first()[SAMPLE]
    assert got is not None and last in [r[SAMPLE] for r in spark.read.parquet(str(tmp_path / "sink")).filter(F.col(HOST) == quiet).collect()]


def test_late_forecast_rows_are_dropped_and_counted(spark, metrics, tmp_path):
    ST.write_time_ordered_files(metrics, str(tmp_path / "src"), 5)
    first = metrics.orderBy(TS).limit(7)
    first.coalesce(1).write.parquet(str(tmp_path / "src" / "part99"))  # the oldest rows once more, last
    stream = lambda: ST.file_stream(spark, str(tmp_path / "src"), metrics.schema)
    q = ET.drain(ET.forecast_actual_join(ET.forecast_stream(stream()), stream(), "12 hours"), str(tmp_path / "sink"), str(tmp_path / "ck"))
    assert ET.dropped_rows(q) > 0
    got = spark.read.parquet(str(tmp_path / "sink"))
    assert got.groupBy("forecast_id", SAMPLE).count().filter("count > 1").count() == 0
    a, b = metrics.alias("a"), metrics.alias("b")
    due = F.col(f"a.{TS}") + F.expr("INTERVAL 6 HOURS")
    want = a.join(b, (F.col(f"a.{HOST}") == F.col(f"b.{HOST}")) & (F.col(f"b.{TS}") >= due) & (F.col(f"b.{TS}") < due + F.expr("INTERVAL 12 HOURS")))
    assert got.count() == want.count() > 0


def test_panes_equal_the_native_sliding_window(spark, metrics, tmp_path):
    src = P._late_files(spark, metrics, "twin")
    store = ET.PaneStore(spark, str(tmp_path / "store"), "24 hours", "6 hours", "6 hours")
    store.run(ST.file_stream(spark, src, metrics.schema), str(tmp_path / "ck"))
    native = ST.windowed_metrics(ST.file_stream(spark, src, metrics.schema), "24 hours", "6 hours", "6 hours")
    ET.drain(native, str(tmp_path / "sink"), str(tmp_path / "ck2"))
    cols = [HOST, "window_start", "avg_cpu", "max_cpu", "avg_memory", "samples"]
    assert rows(store.windows(), *cols) == rows(spark.read.parquet(str(tmp_path / "sink")), *cols)
    assert store.late().count() > 0


def test_an_epoch_written_again_replaces_itself(spark, metrics, tmp_path):
    store = ET.PaneStore(spark, str(tmp_path / "s"), "90 minutes", "60 minutes", "1 hour")
    assert store.pane == 30 * 60 * 1_000_000
    half = metrics.agg(F.expr(f"percentile(unix_micros({TS}), 0.5)")).first()[0]
    a, b = metrics.filter(F.unix_micros(TS) < half), metrics.filter(F.unix_micros(TS) >= half)
    for batch, epoch in ((a, 0), (b, 1), (b, 1)):
        store.write(batch, epoch)
    once = rows(store.windows(), HOST, "window_start", "samples")
    starts = F.window(TS, "90 minutes", "60 minutes")
    last = metrics.agg(F.max(TS)).first()[0]
    want = metrics.groupBy(HOST, starts.alias("w")).count().filter(F.col("w.end") <= F.lit(last) - F.expr("INTERVAL 1 HOUR"))
    assert once == rows(want.select(HOST, F.col("w.start").alias("s"), "count"), HOST, "s", "count")
