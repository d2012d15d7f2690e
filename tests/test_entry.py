"""The entry module works where the optional subpackage has been taken out."""
import os
import shutil
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = """
import __spark_entry__ as E
q, sql = E.queries(), E.oracle_sql()
assert len(q) > 100 and set(sql) <= set(q) and not [n for n in q if n.startswith("op") and n[2].isdigit()]
assert "pipeline" not in q and "host_risk_snapshot" in q
"""


@pytest.mark.parametrize("keep_pipeline", [True, False])
def test_entry_without_the_subpackage(tmp_path, keep_pipeline):
    shutil.copytree(f"{REPO}/fleet_health", tmp_path / "fleet_health", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py", "corpus_pipeline.py"][:1 + keep_pipeline]:
        if os.path.exists(f"{REPO}/{name}"):
            shutil.copy(f"{REPO}/{name}", tmp_path)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", ASK], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
