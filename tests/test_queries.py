"""A sample of the registered queries against their SQL, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__

FOLDER = "/root/testdata/sf0.001"
NAMES = [
    "entity_columns", "expired_idle", "search_all", "search_combined", "degrees", "graph_edges", "agent_memories", "context_summary", "paths", "k_hop_nodes",
    "cosine_topk", "hash_embedding", "hybrid_weighted", "forget_ttl", "record_accesses", "graph_metrics", "stream_windows",
]

needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the generated tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


def test_registry():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 100


@needs_tables
def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["id", "confidence", "ts"]


@needs_tables
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, FOLDER).toPandas()
    want = duck.execute(__spark_entry__.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    lines = lambda df: sorted(map(str, df[columns].astype(str).values.tolist()))
    assert lines(got) == lines(want)
