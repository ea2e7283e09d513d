"""Every registered query against its SQL, and the ordered ones again with slices forced."""

import math
import os
from collections import Counter

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from latchflow.plans import oracles, registry

DATA = "/root/testdata/sf0.001"
TABLES = ("events", "embeddings")
ORDERED = [
    "every_n", "decisions", "box_ttl_asof", "auto_close_asof", "block_attribution", "fps_rolling",
    "traplog_summary", "cooldown_compliance", "gate_forced", "fps_log_emit", "door_timeline", "deadband_thin",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def bag(frame: pd.DataFrame) -> Counter:
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return None
        return v if isinstance(v, (str, bool)) else round(float(v), 6)

    frame = frame[sorted(frame.columns)]
    return Counter(tuple(map(cell, r)) for r in frame.itertuples(index=False, name=None))


def test_all_are_registered():
    assert registry.QUERIES.items() <= entry.queries().items() and set(registry.QUERIES) == set(oracles.build())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    expected = duck.sql(oracles.build()[name]).df()
    assert sorted(df.columns) == sorted(expected.columns)
    got = df.toPandas()
    assert len(got) and bag(got) == bag(expected)


@pytest.mark.parametrize("name", ORDERED)
def test_slices_change_nothing(spark, duck, slice_rows, name):
    slice_rows(25)
    assert bag(registry.QUERIES[name](spark, DATA).toPandas()) == bag(duck.sql(oracles.build()[name]).df())


def test_entry(spark):
    assert entry.entry(spark).columns == ["session_key", "species", "n"]


def test_trap_log_lines_are_parsed_once(spark, tmp_path):
    start = "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id * id)"
    spark.range(9).selectExpr(
        "id AS event_id", f"{start} AS ts", "1L AS user_id", "IF(id < 4, 'click', 'view') AS event_type", "1D AS value", "'{\"k\": 1}' AS props"
    ).write.parquet(str(tmp_path / "events.parquet"))
    found = registry.QUERIES["traplog_summary"](spark, str(tmp_path))
    rows = {(r.label, r.n, r.min_gap_us, r.max_gap_us) for r in found.collect()}
    assert rows == {("click", 4, 1_000_000, 5_000_000), ("view", 5, 9_000_000, 15_000_000)}
    assert "regexp" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
