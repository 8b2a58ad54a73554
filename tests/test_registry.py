"""Every registered query against its oracle on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for table in entry.TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


def comparable(rows):
    return sorted(tuple(str(round(v, 6) if isinstance(v, float) else v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, db, name):
    df = entry.queries()[name](spark, FOLDER)
    got = df.collect()
    assert got, name
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    answer = db.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(answer.columns)
    at = [answer.columns.index(c) for c in columns]
    want = [tuple(r[i] for i in at) for r in answer.fetchall()]
    assert comparable([[r[c] for c in columns] for r in got]) == comparable(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
