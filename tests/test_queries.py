"""Every registered query against its check SQL on the smallest tables; the others must give rows."""

import pytest

from gridloom.plans import all_queries
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES = all_queries()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    query = QUERIES[name]
    left = query.run(spark, FOLDER).toPandas()
    if query.sql is None:
        assert len(left) > 0
    else:
        problem = compare(left, duck.execute(query.sql).df())
        assert problem is None, problem


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    first = entry.entry(spark)
    assert first.count() > 0
    assert first.schema == entry.entry(spark).schema
