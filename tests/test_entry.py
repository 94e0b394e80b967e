"""Every query of the reference's operators against its SQL, at sf0.001."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from lexweave.plans import catalog, provisions

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(spark, name, queries, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    got = queries[name](spark, DIR)
    expected = con.execute(sql[name])
    names = [d[0] for d in expected.description]
    assert sorted(names) == sorted(got.columns)
    plain = lambda x: round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else x
    mine = sorted((tuple(map(plain, r)) for r in got.select(names).collect()), key=repr)
    theirs = sorted((tuple(map(plain, r)) for r in expected.fetchall()), key=repr)
    assert mine == theirs


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_against_sql(spark, name):
    same(spark, name, catalog.QUERIES, catalog.ORACLE_SQL)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, DIR).count() > 0


def test_contract(spark):
    assert provisions.QUERIES is catalog.QUERIES
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns
