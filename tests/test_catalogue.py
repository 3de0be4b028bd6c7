"""Every query with SQL against DuckDB, and every other one for its columns."""

import glob
import os

import duckdb
import pytest

from dirloom.plans import catalogue


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_against_sql(spark, sf, db, name):
    got = catalogue.QUERIES[name](spark, sf)
    want = db.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert plain(got.collect(), got.columns) == plain(want.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES) - {"p1_found"}))
def test_without_sql(spark, sf, name):
    got = catalogue.QUERIES[name](spark, sf)
    assert len(set(got.columns)) == len(got.columns)
    got.write.format("noop").mode("overwrite").save()


def test_documented():
    assert all(q.__doc__ for q in catalogue.QUERIES.values())
