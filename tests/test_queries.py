"""Every registered query with SQL against DuckDB on the same tables."""

import os

import duckdb
import pytest

from provgraph.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def normal(rows):
    return sorted([tuple(str(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in rows])


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert normal(got.select(*columns).collect()) == normal([tuple(r[i] for i in order) for r in result.fetchall()])


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
