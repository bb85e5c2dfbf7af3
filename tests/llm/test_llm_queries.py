import pytest

from termforge.llm.queries import ORACLE, QUERIES
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, data, con, name):
    df = QUERIES[name](spark, data)
    if name in ORACLE:
        compare(df, con, ORACLE[name])
    else:
        rows = df.collect()
        if name.endswith("_found"):
            assert len(set(rows)) == len(rows) and all(v is not None for r in rows for v in r)
