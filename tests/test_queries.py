"""Every core query with SQL gives the rows of that SQL; the others run."""

from functools import lru_cache

import pytest

from compare import connect, duck_rows, spark_rows
from inkwell import plans

DATA = "/root/testdata/sf0.001"
QUERIES = {k: f for r in plans.registries() for k, f in r.queries.items()}
SQL = {k: s for r in plans.registries() for k, s in r.sql.items()}


@lru_cache
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    cols, rows = spark_rows(QUERIES[name](spark, DATA))
    assert cols
    if name in SQL:
        want_cols, want = duck_rows(con(), SQL[name])
        assert cols == want_cols
        assert rows == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
