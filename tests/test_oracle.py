"""Every registered query next to its SQL on the smallest data set."""

import pytest
from check_oracle import canonical, connect, rows_of

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    got, names = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(SQL[name])
    want, want_names = rows_of([c[0] for c in rel.description], rel.fetchall())
    assert names == want_names
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert canonical(1.0) == canonical(1.0000000001)
