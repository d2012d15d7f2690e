"""Labels and training-set preparation.

Randomness is a deterministic hash of row ids and a salt (``unit_hash``),
so every run, engine and partitioning gives the same picks; draws of one row
under different salts are independent.  Exact ranks
inside a class or host come from bucketed counting (``series.with_position``)
rather than one window per class, because the majority class is a hot
group by definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import CPU, DISK, DISK_USED, HOST, LABEL, MEM, MEM_USED, SAMPLE, TS
from . import rolling as R
from . import series
from .series import RN

# --- fixed values ------------------------------------------------------
FAILURE_THRESHOLDS = {CPU: 95.0, MEM: 98.0, DISK: 99.0}
FAILURE_HORIZON_ROWS = 24
RANK_BUCKETS = 65536
# point anomalies: share, cap, margin, affected memory rows
POINT_SHARE, POINT_CAP, POINT_MARGIN, POINT_MEMORY_ROWS, POINT_MEMORY_FACTOR = 20, 50, 10, 6, 1.5
POINT_KINDS = ("cpu_spike", "memory_leak", "disk_full")
POINT_RANGES = {"cpu_spike": (CPU, 90.0, 100.0), "memory_leak": (MEM, 95.0, 100.0),
                "disk_full": (DISK, 95.0, 100.0)}
# gradual anomalies: share, cap, margin; kind -> rows, metric, multiplier range, cap
GRADUAL_SHARE, GRADUAL_CAP, GRADUAL_MARGIN = 25, 200, 20
GRADUAL_KINDS = ("gradual_cpu_increase", "memory_leak", "disk_fill", "mixed_issue", "temporary_spike")
GRADUAL_RULES = {
    "gradual_cpu_increase": (5, ((CPU, 1.1, 1.5, 95.0, None),)),
    "memory_leak": (8, ((MEM, 1.05, 1.2, 98.0, MEM_USED),)),
    "disk_fill": (10, ((DISK, 1.02, 1.1, 99.0, DISK_USED),)),
    "mixed_issue": (1, ((CPU, 1.3, 1.3, 85.0, None), (MEM, 1.2, 1.2, 80.0, None))),
    "temporary_spike": (1, ((CPU, 1.5, 3.0, 100.0, None),)),
}
# ------------------------------------------------------------------------


def unit_hash(ids: Column, salt: int) -> Column:
    """u(id, salt) in [0, 1): the first 52 bits of md5("id|salt") / 2^52.  Any id
    goes, no product can overflow, and every SQL engine reproduces it."""
    digest = F.md5(F.concat_ws("|", ids.cast("string"), F.lit(str(salt))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rank_within(df: DataFrame, keys, score: Column, tie: str = SAMPLE, name: str = "_rank") -> DataFrame:
    """Exact 1-based rank by (score, tie) inside ``keys`` for a score in
    [0, 1), counted in ``RANK_BUCKETS`` buckets so no task sorts a whole group."""
    d = df.withColumn("_score", score)
    out = series.with_position(d, keys=list(keys), order=["_score", tie],
                               bucket_expr=F.floor(F.col("_score") * RANK_BUCKETS))
    return out.withColumnRenamed(RN, name).drop("_score")


# ------------------------------------------------------------------ L1
def will_fail_label(df: DataFrame, thresholds=None, horizon: int = FAILURE_HORIZON_ROWS,
                    drop_incomplete: bool = True) -> DataFrame:
    """1 when any metric's max over the next ``horizon`` rows is strictly
    above its limit; rows without a full horizon are dropped."""
    th = thresholds or FAILURE_THRESHOLDS

    def build(p):
        fm = {c: R.future_max(c, horizon).alias(f"future_max_{c.split('_')[0]}") for c in th}
        return p.select("*", *fm.values())
    out = series.apply(df, build, lookahead=horizon)
    names = {c: f"future_max_{c.split('_')[0]}" for c in th}
    cond = None
    for c, lim in th.items():
        e = F.col(names[c]) > lim
        cond = e if cond is None else cond | e
    out = out.withColumn("will_fail", cond.cast("int"))
    return R.drop_null_rows(out, list(names.values())) if drop_incomplete else out


# ------------------------------------------------------------------ helpers
def _host_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy(HOST).agg(F.count(F.lit(1)).alias("_n"))


def _picks(pos: DataFrame, share: int, cap: int | None, margin: int, salt: int) -> DataFrame:
    """n // share (with ``cap`` at most cap) distinct picks per host among
    0-based positions [margin, n - margin], chosen by hash rank.  A literal cap
    lets Spark apply the per-host limit partially before the shuffle; without
    one the rank is counted in hash buckets, as a host may be hot."""
    from pyspark.sql import Window
    idx = F.col(RN) - 1
    elig = pos.filter((idx >= margin) & (idx <= F.col("_n") - margin))
    wanted = F.floor(F.col("_n") / share)
    if cap is None:
        at = elig.withColumnRenamed(RN, "_at")
        ranked = rank_within(at, [HOST], unit_hash(F.col(SAMPLE), salt), name="_pick_rank").withColumnRenamed("_at", RN)
        return ranked.filter(F.col("_pick_rank") <= wanted)
    w = Window.partitionBy(HOST).orderBy(unit_hash(F.col(SAMPLE), salt), F.col(SAMPLE))
    ranked = elig.withColumn("_pick_rank", F.row_number().over(w)).filter(F.col("_pick_rank") <= cap)
    return ranked.filter(F.col("_pick_rank") <= F.least(F.lit(cap), wanted))


# ------------------------------------------------------------------ L2
def inject_point_anomalies(df: DataFrame, salt: int = 1, cap: int | None = None) -> DataFrame:
    """Label augmentation on a real table (one label per pick).

    Per host: n // 20 picks (with ``cap`` at most that many; the reference's
    trainers use ``POINT_CAP``) away from the first / last 10 rows;
    cpu_spike sets cpu to U(90, 100); memory_leak sets memory to U(95, 100)
    and multiplies memory_used_gb by 1.5 on the pick and the 5 rows after
    it; disk_full sets disk to U(95, 100).  The range effect is an interval
    join on row position, expanded to (host, position) keys, so it is an
    equi-join on unique keys.
    """
    base = df.drop(LABEL) if LABEL in df.columns else df
    pos = series.with_position(base).join(_host_sizes(base), HOST)
    picks = _picks(pos, POINT_SHARE, cap, POINT_MARGIN, salt)
    kind_idx = F.floor(unit_hash(F.col(SAMPLE), salt + 1) * len(POINT_KINDS)).cast("int")
    u = unit_hash(F.col(SAMPLE), salt + 2)
    picks = picks.select(HOST, RN, kind_idx.alias("_kind"), u.alias("_u"))
    # memory-used range effect: positions pick .. pick + 5
    mem_hits = (picks.filter(F.col("_kind") == POINT_KINDS.index("memory_leak"))
                .select(HOST, F.explode(F.sequence(F.col(RN), F.col(RN) + POINT_MEMORY_ROWS - 1)).alias(RN))
                .groupBy(HOST, RN).agg(F.count(F.lit(1)).alias("_mem_hits")))
    j = (pos.join(picks, [HOST, RN], "left").join(mem_hits, [HOST, RN], "left"))
    cols = []
    for c in base.columns:
        e = F.col(c)
        for k, (metric, lo, hi) in POINT_RANGES.items():
            if c == metric:
                e = F.when(F.col("_kind") == POINT_KINDS.index(k), F.lit(lo) + F.lit(hi - lo) * F.col("_u")) \
                     .otherwise(e)
        if c == MEM_USED:
            e = F.when(F.col("_mem_hits").isNotNull(),
                       e * F.pow(F.lit(POINT_MEMORY_FACTOR), F.col("_mem_hits"))).otherwise(e)
        cols.append(e.alias(c))
    return j.select(*cols, F.col("_kind").isNotNull().cast("int").alias(LABEL))


# ------------------------------------------------------------------ L3
def inject_gradual_anomalies(df: DataFrame, salt: int = 11, cap: int | None = None) -> DataFrame:
    """Subtle anomalies over runs of rows, labelling every touched row.

    Per host n // 25 picks (with ``cap`` at most that many; the reference's
    trainers use ``GRADUAL_CAP``) in [20, n - 20]; kinds: gradual cpu
    (5 rows x U(1.1, 1.5), cap 95), memory leak (8 rows x U(1.05, 1.2), cap 98,
    memory_used_gb scaled too), disk fill (10 rows x U(1.02, 1.1), cap 99,
    disk_used_gb scaled too), mixed issue (cpu x 1.3 cap 85, memory x 1.2
    cap 80), temporary spike (cpu x U(1.5, 3), cap 100).  Overlapping picks
    of one kind multiply (caps commute with factors >= 1); a row hit by
    several kinds takes the kind of its first pick (lowest pick rank) only.
    """
    base = df.drop(LABEL) if LABEL in df.columns else df
    pos = series.with_position(base).join(_host_sizes(base), HOST)
    picks = _picks(pos, GRADUAL_SHARE, cap, GRADUAL_MARGIN, salt)
    kind = F.floor(unit_hash(F.col(SAMPLE), salt + 1) * len(GRADUAL_KINDS)).cast("int")
    picks = picks.select(HOST, F.col(RN).alias("_p"), F.col(SAMPLE).alias("_pid"),
                         F.col("_pick_rank"), kind.alias("_kind"))
    rows_of = F.element_at(F.array(*[F.lit(GRADUAL_RULES[k][0]) for k in GRADUAL_KINDS]), F.col("_kind") + 1)
    hits = picks.select("*", F.posexplode(F.sequence(F.col("_p"), F.col("_p") + rows_of - 1)).alias("_i", RN))
    # per-hit multipliers; one draw per (pick, offset) as in the reference
    hid = F.concat_ws(":", F.col("_pid").cast("string"), F.col("_i").cast("string"))
    mult_cols = {}
    for metric in (CPU, MEM, DISK):
        e = F.lit(1.0)
        for ki, k in enumerate(GRADUAL_KINDS):
            for (m, lo, hi, _cap, _used) in GRADUAL_RULES[k][1]:
                if m == metric:
                    draw = F.lit(lo) + F.lit(hi - lo) * unit_hash(hid, salt + 2 + ki)
                    e = F.when(F.col("_kind") == ki, draw).otherwise(e)
        mult_cols[metric] = e
    hits = hits.select(HOST, RN, "_pick_rank", "_kind",
                       *[v.alias(f"_f_{k}") for k, v in mult_cols.items()])
    first_kind = F.min_by(F.col("_kind"), F.col("_pick_rank"))
    per_row = hits.groupBy(HOST, RN).agg(
        first_kind.alias("_kind"),
        *[F.collect_list(F.struct("_kind", F.col(f"_f_{m}").alias("f"))).alias(f"_fl_{m}")
          for m in (CPU, MEM, DISK)])
    # product of factors of the chosen kind (at most a few hits per row)
    prods = {}
    for m in (CPU, MEM, DISK):
        sel = F.filter(F.col(f"_fl_{m}"), lambda x: x["_kind"] == F.col("_kind"))
        prods[m] = F.aggregate(sel, F.lit(1.0), lambda acc, x: acc * x["f"])
    per_row = per_row.select(HOST, RN, "_kind", *[v.alias(f"_m_{k}") for k, v in prods.items()])
    j = pos.join(per_row, [HOST, RN], "left")
    caps = {}
    for ki, k in enumerate(GRADUAL_KINDS):
        for (m, _lo, _hi, cap, used) in GRADUAL_RULES[k][1]:
            caps.setdefault(m, []).append((ki, cap, used))
    used_of = {}
    for ki, k in enumerate(GRADUAL_KINDS):
        for (m, _lo, _hi, _cap, used) in GRADUAL_RULES[k][1]:
            if used:
                used_of.setdefault(used, []).append((ki, m))
    cols = []
    for c in base.columns:
        e = F.col(c)
        if c in caps:
            for ki, cap, _ in caps[c]:
                e = F.when(F.col("_kind") == ki, F.least(F.col(c) * F.col(f"_m_{c}"), F.lit(cap))).otherwise(e)
        if c in used_of:
            for ki, m in used_of[c]:
                e = F.when(F.col("_kind") == ki, F.col(c) * F.col(f"_m_{m}")).otherwise(e)
        cols.append(e.alias(c))
    return j.select(*cols, F.col("_kind").isNotNull().cast("int").alias(LABEL))


# ------------------------------------------------------------------ L4
def class_distribution(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Count and share per class plus the total."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return counts.select(label, "count", (F.col("count") / total).alias("ratio"), total.alias("total"))


# ------------------------------------------------------------------ L5, L6, L9
def stratified_split(df: DataFrame, test_fraction: float = 0.2, seed: int = 42,
                     label: str = LABEL) -> DataFrame:
    """Exact per-class split: in each class the round(n_c x f) rows with the
    smallest hash are test.  Adds ``is_test`` (bool)."""
    ranked = rank_within(df, [label], unit_hash(F.col(SAMPLE), seed))
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    j = ranked.join(F.broadcast(sizes), label)  # one row per class
    return j.withColumn("is_test", F.col("_rank") <= F.floor(F.col("_nc") * F.lit(test_fraction) + 0.5)) \
            .drop("_rank", "_nc")


def time_ordered_split(df: DataFrame, test_fraction: float = 0.2, skip: int = 0) -> DataFrame:
    """Latest round(n x f) samples of every host are test; earlier ones train.
    ``skip`` first samples of a host do not count (no full window ends there):
    rows are then split as the windows that end at them.  ``_rn``, where ``df``
    carries it, is kept."""
    pos = series.with_position(df).join(_host_sizes(df), HOST)
    test = F.col(RN) > F.col("_n") - F.floor(F.greatest(F.col("_n") - skip, F.lit(0)) * F.lit(test_fraction) + 0.5)
    out = pos.withColumn("is_test", test).drop("_n")
    return out if RN in df.columns else out.drop(RN)


def random_undersample(df: DataFrame, seed: int = 42, label: str = LABEL) -> DataFrame:
    """Every class reduced to the minority count (hash-ranked)."""
    ranked = rank_within(df, [label], unit_hash(F.col(SAMPLE), seed))
    n_min = df.groupBy(label).count().agg(F.min("count")).scalar()
    return ranked.filter(F.col("_rank") <= n_min).drop("_rank")


# ------------------------------------------------------------------ L11
def balanced_class_weights(df: DataFrame, label: str = LABEL, name: str = "weight") -> DataFrame:
    """weight_c = n / (classes x n_c), attached through a broadcast of the
    per-class counts (one row per class: size bounded by the label domain)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    k = counts.agg(F.count(F.lit(1))).scalar()
    n = counts.agg(F.sum("_nc")).scalar()
    w = counts.select(label, (n.cast("double") / (k * F.col("_nc"))).alias(name))
    return df.join(F.broadcast(w), label)
