"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from accordance.plans import registry

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x + 0.0)
    return str(x)


def rows(data, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the given tables are not here")
@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_matches_sql(spark, duck, name):
    df, sql = registry.queries()[name](spark, SMALL), duck.sql(registry.oracles()[name])
    assert sorted(df.columns) == sorted(sql.columns)
    assert rows(df.collect(), df.columns) == rows(sql.fetchall(), sql.columns)


def test_every_query_but_those_of_random_draws_has_sql():
    assert set(registry.queries()) - set(registry.oracles()) == {"validation_artifacts", "artifact_intervals", "forest_intervals"}


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the given tables are not here")
def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
