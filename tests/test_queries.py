"""Every catalogued query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from docloom import plans

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    return "null" if v is None else v.isoformat()[:19] if hasattr(v, "isoformat") else str(v)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_matches_sql(spark, sql, name):
    df = plans.QUERIES[name](spark, FOLDER)
    expected = sql.sql(plans.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    places = [expected.columns.index(c) for c in columns]
    rows = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    assert rows == sorted(tuple(norm(r[i]) for i in places) for r in expected.fetchall())


def test_every_query_has_sql():
    assert set(plans.QUERIES) == set(plans.ORACLE_SQL)
