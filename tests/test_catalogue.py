"""Every query with SQL gives the same rows as DuckDB."""

from collections import Counter

import duckdb
import pytest

from tallyloom.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(row):
    return tuple(round(x, 6) if isinstance(x, float) else x for x in row)


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(name, spark, duck):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = Counter(plain(r) for r in df.select(columns).collect())
    sql = f"select {', '.join(columns)} from ({catalogue.oracle_sql()[name]})"
    assert got == Counter(plain(r) for r in duck.sql(sql).fetchall())
    assert got
