"""Plan shape: rolling frames share one shuffle; top-k reads use a partial
group limit before the shuffle; no Python nodes in expression-only queries."""
import re

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_w5_windows_share_one_exchange(spark):
    plan = _plan(E.queries()["multi_window_stats"](spark, SF))
    chunk_exchanges = re.findall(r"Exchange hashpartitioning\(host_id#\d+L?, _chunk#\d+L?", plan)
    assert len(chunk_exchanges) == 1, plan


def test_top_k_per_host_limits_before_shuffle(spark):
    plan = _plan(E.queries()["last_n_per_host"](spark, SF))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_no_python_in_expression_queries(spark):
    q = E.queries()
    for name in ("features_enhanced", "risk_levels", "threshold_alerts", "host_risk_snapshot"):
        plan = _plan(q[name](spark, SF))
        assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan and "MapInPandas" not in plan


def test_scan_prunes_columns(spark):
    plan = _plan(E.queries()["risk_levels"](spark, SF))
    scan = [l for l in plan.splitlines() if "FileScan parquet" in l][0]
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,value:double,props:string>" in scan, scan
