"""Every registered query against its SQL, and the entry point's contract."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__
from paperlake import catalog

catalog.load()
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.6f}"
    if isinstance(v, (list, tuple)):
        return tuple(shown(x) for x in v)
    return v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    mine, theirs = catalog.REGISTRY[name](spark, sf_dir), duck.sql(catalog.ORACLES[name])
    assert sorted(mine.columns) == sorted(theirs.columns)
    at = [theirs.columns.index(c) for c in mine.columns]
    got, want = mine.collect(), theirs.fetchall()
    assert Counter(shown(tuple(r)) for r in got) == Counter(shown(tuple(r[k] for k in at)) for r in want)


@pytest.mark.parametrize("name", sorted(set(catalog.REGISTRY) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert catalog.REGISTRY[name](spark, sf_dir).count() > 0


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["paper_id", "title", "abstract", "doi", "publication_date", "cited_by_count", "pdf_url", "authors", "venue"]
    assert df.count() == 10


def test_oracles_belong_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
