"""Heads of buckets against the whole buckets, and the variants' single join."""

import random

from pyspark.sql import functions as F

from barweave.operators import select
from barweave.plans import catalog_research
from barweave.plans.bindings import Tables

SCHEMA = "row_id string, symbol string, open_time bigint, trade_score double, hybrid_score double"


def test_heads_hold_the_best_rows(spark):
    rng = random.Random(5)
    rows = [(f"r{i}", f"S{rng.randrange(60)}", rng.choice([1, 2, 3, None]), rng.choice([None, round(rng.random(), 2)]), 0.0) for i in range(3000)]
    rows += [("few", "S1", 9, 0.5, 0.0), ("null", "S2", 9, None, 0.0), ("nan", "S3", 2, float("nan"), 0.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    heads = select.heads(df, 3, ["open_time"], "trade_score").cache()
    assert heads.count() < len(rows) / 3
    order = select.score_order(df, "trade_score")
    for per_symbol in (0, 1, 2):
        got, want = ([sorted((r.row_id, r.rank_in_bucket) for r in select.topk(d, 3, ["open_time"], order, per_symbol).collect())] for d in (heads, df))
        assert got == want
    share = {r.row_id: r.p for r in select.pct_rank(df, "trade_score", "p", ["open_time"]).collect()}
    part = select.pct_rank(heads, "trade_score", "p", ["open_time"], of=df).collect()
    assert part and all(r.p == share[r.row_id] for r in part)
    z = {r.row_id: r.z for r in select.zscore(df, {"hybrid_score": "z"}, ["open_time"]).collect()}
    assert all(r.z == z[r.row_id] for r in select.zscore(heads, {"hybrid_score": "z"}, ["open_time"], of=df).collect())


def test_research_rows_are_joined_once(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    rows = catalog_research.research_rows(t)
    assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert rows.inputFiles() == catalog_research.research_rows(t).inputFiles()
    assert rows.filter(F.col("predicted") == 1).count() == t.artifact.filter("predicted = 1").count()


def test_composite_reads_the_join_once(spark, monkeypatch):
    t = Tables(spark, "/root/testdata/sf0.001")
    reads = []
    read = Tables.read
    monkeypatch.setattr(Tables, "read", lambda self, name: reads.append(name) or read(self, name))
    out = catalog_research.composite_robustness(t)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and out.count() == 14
