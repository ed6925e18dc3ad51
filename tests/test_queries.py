"""Every registered query at the smallest scale, against its SQL where there is one."""

import os

import pytest
from oracle import compare, connect

from gridwright.queries import load

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = load()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    if name in SQL:
        assert compare(df, duck, SQL[name]) == ""
    else:
        assert df.count() > 0
