"""Every registered query with an oracle agrees with DuckDB on sf0.001
(streaming and model queries are covered by their own tests)."""
import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from fleet_health.plans import catalog

SKIP = {"stream_ingest", "stream_buffer_features", "stream_alert_cooldown", "windowed_metrics",
        "kernel_novelty"}
SF = "/root/testdata/sf0.001"


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _rows(tbl):
    cols = sorted(tbl.column_names)
    data = [tbl.column(c).to_pylist() for c in cols]
    return cols, sorted((tuple(_norm(v) for v in r) for r in zip(*data)), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ["events"]:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF, t)}.parquet')")
    return c


# the optional subpackage has tests of its own
NAMES = [n for n in E.oracle_sql() if n in catalog.registry() and n not in SKIP]


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    got = E.queries()[name](spark, SF).toArrow()
    want = con.sql(E.oracle_sql()[name]).to_arrow_table()
    gc, gr = _rows(got)
    wc, wr = _rows(want)
    assert gc == wc
    assert len(gr) == len(wr)
    assert gr == wr
