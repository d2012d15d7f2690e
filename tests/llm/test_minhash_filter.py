"""The filter inside the join across classes is exact."""
import numpy as np

from fleet_health.llm.minhash import MAP_BITS, _may_link, parity_maps


def test_the_filter_in_the_join_drops_no_link(spark):
    """Pairs of a similarity of exactly 0.8, or just above, all pass; most pairs well below do not."""
    rng = np.random.default_rng(12)
    rows = []
    for pair in range(6000):
        common, other = [(80, 20), (81, 19), (320, 80), (1600, 400), (60, 40)][pair % 5]
        e = rng.integers(1, 1 << 62, common + other).astype(np.uint64)
        left = other // 2
        a, b = e[:common + left], np.concatenate([e[:common], e[common + left:]])
        m = parity_maps(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b]), 2)
        rows.append((pair % 5, m[0].tolist(), m[1].tolist(), len(a), len(b)))
    df = spark.createDataFrame(rows, "kind int, pa array<bigint>, pb array<bigint>, na bigint, nb bigint")
    got = df.filter(_may_link("pa", "pb", "na", "nb", 0.8)).groupBy("kind").count().collect()
    passed = {r["kind"]: r["count"] for r in got}
    assert [passed[i] for i in range(4)] == [1200] * 4 and passed.get(4, 0) < 60 and MAP_BITS % 64 == 0
