"""Every query outside the llm subpackage runs on sf0.001; those with SQL agree with it."""

import pytest
from parity import canonical, connect

from loamgraph.plans import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, FOLDER)
    rows = [tuple(r) for r in df.collect()]
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    assert sorted(names) == sorted(df.columns)
    assert canonical(rows, df.columns) == canonical(res.fetchall(), names)
