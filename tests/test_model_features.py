"""The registered sequence classifier and isolation forests read the feature packs."""
import __spark_entry__ as E
import pytest

from fleet_health.models import iforest, sequence


class Seen(Exception):
    pass


@pytest.mark.parametrize("name, module, at, least", [
    ("sequence_classifier", sequence, "fit", 38), ("isolation_forest", iforest, "fit", 28),
    ("isolation_forest_search", iforest, "search", 100)])
def test_features_of_the_registered_models(spark, sf_small, monkeypatch, name, module, at, least):
    def seen(df, features, *args, **kw):
        assert len(features) >= least and any("rolling" in f or "mean" in f for f in features)
        assert any("roc" in f for f in features)
        raise Seen
    monkeypatch.setattr(module, at, seen)
    with pytest.raises(Seen):
        E.queries()[name](spark, sf_small)


def test_isolation_forest_scores_every_row(spark, sf_small):
    out = E.queries()["isolation_forest"](spark, sf_small)
    n = spark.read.parquet(f"{sf_small}/events.parquet").count()
    assert out.count() == n and out.filter("anomaly_score is null or isnan(anomaly_score)").count() == 0
