"""Shares and 'auto' as ``max_samples`` of the isolation forest."""
import pytest

from fleet_health.models import iforest


@pytest.mark.parametrize("given, psi", [(0.5, 150), (0.8, 240), ("auto", 256), (64, 64), (1000, 300)])
def test_max_samples(spark, given, psi):
    df = spark.range(300).selectExpr("id AS sample_id", "id * 1.0D AS a", "rand(3) AS b")
    assert iforest.fit(df, ["a", "b"], n_trees=4, max_samples=given)["psi"] == psi
