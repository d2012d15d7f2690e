"""A bucket of one large class and a stranger costs as many comparisons as it has rows."""
from fleet_health.llm.minhash import across_classes, class_sides


def bucket(spark, n, strangers=1):
    rows = [(7, i, 0, 100) for i in range(n)] + [(7, n + k, n + k, 100 + 30 * k) for k in range(strangers)] + [(8, 0, 0, 100), (8, 1, 0, 100)]
    classed = spark.createDataFrame(rows, "bucket bigint, node bigint, root bigint, size bigint")
    nodes = spark.createDataFrame([(i, s, [7], [0] * 24) for b, i, _, s in rows if b == 7], "node bigint, size bigint, bands array<bigint>, parity array<bigint>")
    return classed, nodes


def test_comparisons_grow_with_the_rows(spark):
    for n in (500, 5000):
        classed, nodes = bucket(spark, n)
        members, other = class_sides(classed, nodes, 0.8)
        assert members.join(other, ["bucket", "step"]).count() <= 2 * n
        assert across_classes(classed, nodes, 0.8).count() == n


def test_pairs_of_strangers_come_once_and_sizes_prune(spark):
    classed, nodes = bucket(spark, 3, strangers=3)  # sizes 100, 100, 100 | 100, 130, 160
    got = sorted(tuple(sorted(r)) for r in across_classes(classed, nodes, 0.8).collect())
    assert got == [(0, 3), (1, 3), (2, 3), (4, 5)]
