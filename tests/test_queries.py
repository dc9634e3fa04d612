"""Every query that has SQL gives the rows of that SQL, over the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from storyproof.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(columns).collect())
    made = duck.execute(catalog.SQL[name])
    names = [d[0] for d in made.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(row[names.index(c)] for c in columns)) for row in made.fetchall())
    assert got == want


def test_every_query_without_sql_is_known():
    assert set(catalog.QUERIES) - set(catalog.SQL) == {"sentence_ranking"}


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["query", "corpus", "doc", "score", "score_norm", "rank"]
    assert df.count() == 1920


def test_the_registry_merges_all(spark):
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
