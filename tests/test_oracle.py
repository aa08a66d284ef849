"""Registered queries against their SQL. The default is a selection; ORACLE=all runs every query."""

import os
import sys

import duckdb
import pytest

import __spark_entry__ as entry

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from compare import rows_of  # noqa: E402

DATA = "/root/testdata/sf0.001"
CHOSEN = """x00_momentum_top1 x01_ordered_prefix s09_shard_sink f10_zscores f16_block_extremes g05_minus_leader h02_market_returns l04_target_stop_label q02_trailing_stop
p04_walk_forward k04_topk_symbol_cap k17_bucket_percent_rank k23_exposure_penalty t03_threshold_sweep a10_portfolio_row c05_score_bucket r03_score_deciles o08_bucket_audit
e03_ledger_drawdown e04_symbol_exposure st01_stream_bars""".split()
SKEWED = "x01_ordered_prefix k03_topk k15_cooldown k16_bucket_zscore k22_share_cap a02_auc a07_drawdown r01_numeric_summary x04_bars_from_trades".split()


def compare(spark, folder, name):
    con = duckdb.connect()
    for file in os.listdir(folder):
        con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{folder}/{file}'")
    df = entry.queries()[name](spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    want = con.execute(entry.oracle_sql()[name])
    assert got == rows_of([d[0] for d in want.description], want.fetchall())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()) if os.environ.get("ORACLE") == "all" else CHOSEN)
def test_query_agrees_with_sql(spark, name):
    compare(spark, DATA, name)


@pytest.fixture(scope="session")
def skewed(tmp_path_factory):
    """The tables with a third of the rows moved to one symbol, one time bucket and one score."""
    folder = tmp_path_factory.mktemp("skewed")
    for file in os.listdir(DATA):
        source, change = f"'{DATA}/{file}'", ""
        if file == "lineitem.parquet":
            hot = "l_orderkey % 3 = 0"
            change = f"""REPLACE (CASE WHEN {hot} THEN 1 ELSE l_suppkey END AS l_suppkey, CASE WHEN {hot} THEN 25.0 ELSE l_quantity END AS l_quantity,
            CASE WHEN {hot} THEN TIMESTAMP '1998-03-03' ELSE l_shipdate END AS l_shipdate)"""
        elif file == "events.parquet":
            change = "REPLACE (CASE WHEN event_id % 3 = 0 THEN 'view' ELSE event_type END AS event_type)"
        duckdb.sql(f"COPY (SELECT * {change} FROM {source}) TO '{folder}/{file}' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", SKEWED)
def test_hot_keys(spark, skewed, name):
    compare(spark, skewed, name)


def test_registry_is_complete():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert entry.oracle_sql().keys() == oracles.keys()
    families = {"x": 3, "s": 27, "u": 4, "f": 19, "g": 5, "h": 5, "l": 10, "p": 11, "m": 11, "c": 9, "v": 9, "k": 26, "t": 13, "a": 13, "r": 19, "o": 16, "e": 8, "q": 4, "st": 4}
    have = {name.split("_")[0] for name in queries}
    missing = [f"{f}{i:02d}" for f, n in families.items() for i in range(1, n + 1) if f"{f}{i:02d}" not in have]
    assert missing == []


def test_entry(spark):
    assert entry.entry(spark).count() == 1
