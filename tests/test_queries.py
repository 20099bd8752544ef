"""Every registered query runs on the smallest sample and agrees with its DuckDB twin."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry_module
from check_queries import TABLES, compare
from tidemark.catalog import load_all

QUERIES, ORACLES = load_all()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    text, ok, _ = compare(spark, duck, name, QUERIES[name], ORACLES.get(name), sf)
    assert ok, text


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry_module.entry(spark).columns == ["user_id", "item_id", "score", "rank", "reasons"]
