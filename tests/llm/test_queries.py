"""The registered queries: oracles in DuckDB, and what the others promise."""
import duckdb
import pytest

import __spark_entry__ as E
from fleet_health.llm.queries import ORACLES, QUERIES
from llm_helpers import counted

SF = "/root/testdata/sf0.001"


def test_all_are_registered():
    assert {f"op{i}" for i in range(1, 14)} == {n.split("_")[0] for n in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= set(E.queries()) and set(ORACLES) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.sql(ORACLES[name]).to_arrow_table()
    got = QUERIES[name](spark, SF).toArrow()
    cols = sorted(want.column_names)
    assert sorted(got.column_names) == cols
    rows = lambda t: counted([tuple(r[c] for c in cols) for r in t.to_pylist()])
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_one_row_per_document_and_reruns_agree(spark, name):
    a, b = QUERIES[name](spark, SF), QUERIES[name](spark, SF)
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert a.select("doc_id").distinct().count() == n and (name.startswith("op10") or a.count() == n)
    assert counted(a) == counted(b)
