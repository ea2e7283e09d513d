"""Corpus queries against their SQL."""

import os
from collections import Counter

import duckdb
import pytest

from latchflow.llm import registry

DATA = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    found = registry.QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({registry.oracles()[name]})").fetchall()
    assert Counter(map(tuple, found.select(*columns).collect())) == Counter(want) and want
