"""A cross-section of the registered queries against their SQL on the smallest data set."""

import glob
import os
import sys

import pytest

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables not present")

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

import __spark_entry__ as entry_module  # noqa: E402
from check_queries import rows_of  # noqa: E402

SAMPLE = [
    "halt_episodes", "canonical_halt_row", "upsert_trade_halts", "enrich_episodes", "ticker_halt_metrics", "halt_metrics_all",
    "bars_15m", "rvol", "scan_halt_feed", "warrant_diagnostics", "name_match_unique", "stream_bars_tumbling",
]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_every_query_has_a_twin():
    names = set(entry_module.catalog.runnable())
    assert names == set(entry_module.catalog.statements())
    assert names <= set(entry_module.queries()) and names <= set(entry_module.oracle_sql())


@pytest.mark.parametrize("name", SAMPLE)
def test_rows_equal(spark, con, name):
    df = entry_module.queries()[name](spark, DATA)
    cursor = con.execute(entry_module.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cursor.fetchall())


def test_flagship(spark):
    assert entry_module.entry(spark).count() > 0
