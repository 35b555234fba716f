"""Every registered query against its SQL counterpart, value for value."""

import pytest

import __spark_entry__ as contract

QUERIES = contract.queries()
ORACLES = contract.oracle_sql()


def in_order(rows, columns):
    places = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in places) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    result = duck.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert in_order(got, df.columns) == in_order(result.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_is_the_flagship(spark):
    df = contract.entry(spark)
    assert df.columns[-2:] == ["ChurnScore", "ChurnRisk"]
    assert df.count() == 150


def test_only_known_oracles():
    assert set(ORACLES) <= set(QUERIES)
