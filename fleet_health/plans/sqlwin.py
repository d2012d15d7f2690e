"""DuckDB window SQL snippets mirroring :mod:`fleet_health.operators.rolling`."""

from __future__ import annotations

PART = 'PARTITION BY host_id ORDER BY "timestamp", sample_id'
W = f"({PART})"


def frame(k: int) -> str:
    return f"({PART} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


def mean(c, k):
    return f"avg({c}) OVER {frame(k)}"


def std(c, k):
    return f"stddev_samp({c}) OVER {frame(k)}"


def mn(c, k):
    return f"min({c}) OVER {frame(k)}"


def mx(c, k):
    return f"max({c}) OVER {frame(k)}"


def quant(c, k, q):
    return f"quantile_cont({c}, {q}) OVER {frame(k)}"


def lag(c, n):
    return f"lag({c}, {n}) OVER {W}"


def lead(c, n):
    return f"lead({c}, {n}) OVER {W}"


def roc(c, n=1):
    return f"coalesce(({c} - {lag(c, n)}) / nullif({lag(c, n)}, 0), 0.0::DOUBLE)"


def accel(c):
    now = f"coalesce(({c} - {lag(c, 1)}) / nullif({lag(c, 1)}, 0), 0.0::DOUBLE)"
    prev = f"coalesce(({lag(c, 1)} - {lag(c, 2)}) / nullif({lag(c, 2)}, 0), 0.0::DOUBLE)"
    return f"CASE WHEN {lag(c, 1)} IS NULL THEN 0.0::DOUBLE ELSE {now} - {prev} END"


def vol(c, k=10, eps=0.0, zero=True):
    v = f"{std(c, k)} / nullif({mean(c, k)} + {eps}::DOUBLE, 0)"
    return f"coalesce({v}, 0.0::DOUBLE)" if zero else v


def trend(c, k=10, x="rn"):
    """Needs a position column ``rn`` (row_number per host) in the input."""
    return (f"CASE WHEN count({c}) OVER {frame(k)} > 1 "
            f"THEN coalesce(regr_slope({c}, CAST({x} AS DOUBLE)) OVER {frame(k)}, 0.0::DOUBLE) "
            f"ELSE 0.0::DOUBLE END")


def future_max(c, h):
    return (f"CASE WHEN lead(sample_id, {h}) OVER {W} IS NOT NULL THEN "
            f"max({c}) OVER ({PART} ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) END")


def zscore(c, robust=False):
    m = f"avg({c}) OVER (PARTITION BY host_id)"
    s = f"stddev_samp({c}) OVER (PARTITION BY host_id)"
    if robust:
        return f"CASE WHEN {s} > 0 THEN ({c} - {m}) / {s} ELSE 0.0::DOUBLE END"
    return f"({c} - {m}) / nullif({s}, 0)"


def ffill(c):
    return f"last_value({c} IGNORE NULLS) OVER ({PART} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def bfill(c):
    return f"first_value({c} IGNORE NULLS) OVER ({PART} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


def filled(c, order="ffill,bfill,zero", zero="0.0::DOUBLE"):
    parts = [c]
    for s in order.split(","):
        if s == "ffill":
            parts.append(ffill(c))
        elif s == "bfill":
            parts.append(bfill(c))
        elif s == "zero":
            parts.append(zero)
    return f"coalesce({', '.join(parts)})" if len(parts) > 1 else c


def rn_col():
    return f"row_number() OVER {W} AS rn"
