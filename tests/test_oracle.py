"""Every registered query with an SQL twin equals DuckDB on the sf0.01 tables."""

import pytest

import __spark_entry__ as E
from conftest import SF_ORACLE
from oracle import compare, duck

SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_ORACLE)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(spark, con, name, E.queries()[name], SQL[name], SF_ORACLE)
    assert ok, msg


def test_every_query_has_a_builder():
    assert set(SQL) <= set(E.queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "float": "FLOAT"}


def test_oracle_column_types_match(spark):
    """Each twin returns the same column types as the Spark query (DuckDB's
    count_if / integer sums are HUGEINT unless cast)."""
    from conftest import SF_SMALL
    con = duck(SF_SMALL)
    bad = []
    for name, sql in SQL.items():
        d = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
        for c, t in E.queries()[name](spark, SF_SMALL).dtypes:
            if SPARK_TO_DUCK.get(t, t) != d.get(c):
                bad.append((name, c, t, d.get(c)))
    assert not bad, bad
