"""Every registered query against its SQL twin at the smallest size."""

import os

import pytest

import __spark_entry__ as entry
from oracle import compare, duck

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()
# tree ensembles, checked at full size by tests/oracle.py
SLOW = {"train_leaderboard", "tune_trials", "improve_until", "auto_drop", "model_importance", "model_pdp", "model_shap", "quantile_run"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW])
def test_query_matches_sql(spark, con, name):
    diff = compare(spark, con, SF_DIR, name, QUERIES[name], SQL.get(name))
    # a filter-type result may be empty at this size
    assert diff is None or (diff == "no rows" and name in {"prune_advice", "error_hints_cls"}), diff


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_only_for_known_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry_without_the_optional_parts():
    """With the training-data subpackage and the pipeline taken out, everything else is still registered."""
    import subprocess
    import sys

    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith(("tablewright.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
names = e.queries()
assert len(names) > 100 and not [n for n in names if n.startswith("op1_") or n == "pipeline"]
assert set(e.oracle_sql()) <= set(names)
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
