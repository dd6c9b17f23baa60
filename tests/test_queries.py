"""Every query that has an SQL counterpart gives the same rows as DuckDB on the smallest tables."""

import pytest

import compare
from ticketlens.plans import load_queries

FOLDER = "/root/testdata/sf0.001"
CHECKED = sorted(name for name, item in load_queries().items() if item.sql is not None)


@pytest.fixture(scope="module")
def duck():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, duck, name):
    item = load_queries()[name]
    result = item.run(spark, FOLDER).toArrow()
    expected = duck.execute(item.sql).to_arrow_table()
    assert compare.compare(name, result, expected) == []
