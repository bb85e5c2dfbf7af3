"""Every registered query outside llm, against its SQL where it has one."""

import pytest

from termforge.plans import registry
from tests.oracle import compare, connect

#: Queries that have no rows on the smallest data: no Korean dictionary, no text that defines an abbreviation.
EMPTY = {"fn_normalize_ko_all", "ann_abbr_find_all", "ann_abbr_emit_all"}
QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE])
def test_against_sql(spark, data, con, name):
    compare(QUERIES[name](spark, data), con, ORACLE[name])


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE])
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0 or name in EMPTY


def test_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_rest_does_not_import_llm():
    import subprocess
    import sys

    code = "import sys, __spark_entry__; from termforge.plans import registry; assert not [m for m in sys.modules if m.startswith('termforge.llm')]"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=str(__import__("pathlib").Path(__file__).parent.parent))
