"""Named queries against their SQL in DuckDB, on the smallest data."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from checks.queries import QUERIES
from checks.sql import SQL

DATA = "/root/testdata/sf0.001"
TABLES = ["events", "documents", "embeddings", "pages", "conversations"]
QUICK = [
    "security_by_type", "security_events", "points_review", "metric_rows", "rollup_by_type", "file_filter", "classified_imports",
    "file_summaries", "chunks_function", "chunks_code", "chunk_numbers", "token_batches", "nearest_vectors_other_file",
    "comments_on_diff", "pr_rollup", "fallback_bodies", "request_records", "deliveries_routed", "signatures",
    "dash_cumulative_cost_by_repo", "dash_success_rate", "dash_embedding_calls",
]
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


def plain(value):
    if value is None or value != value:
        return None
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([plain(record[i]) for i in order] for record in records), key=str)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["type", "severity", "n"]


@pytest.mark.parametrize("name", QUICK)
def test_query(spark, duck, name):
    made = entry.queries()[name](spark, DATA)
    wanted = duck.sql(entry.oracle_sql()[name])
    assert sorted(made.columns) == sorted(wanted.columns)
    assert rows(made.columns, made.collect()) == rows(wanted.columns, wanted.fetchall())
