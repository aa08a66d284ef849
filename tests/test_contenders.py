"""Contenders of the exposure penalty with many symbols of equal scores, and the number of replays."""

import random

import pytest
from pyspark.sql import functions as F

from barweave.operators import select
from test_exposure import SCHEMA, sequential


@pytest.mark.parametrize("cap,strength", [(0.0, 0.75), (0.35, 0.75), (0.0, -0.75)])
def test_few_contenders_and_replays_on_copies(spark, cap, strength):
    rng = random.Random(3)
    rows = [(f"r{b}-{i}-{c}", f"S{(i * 7 + b) % 50}c{c}", b, v, v) for b in range(60) for i in range(12) for v in [round(rng.random(), 2)] for c in range(4)]
    df = spark.createDataFrame(rows, SCHEMA)
    scale = select.score_scale(df, "trade_score").first().scale
    want = sequential(rows, scale, strength, 2, 1, cap, 50)
    for block_rows, most in ((200_000, 1), (100, 4)):
        rounds = []
        got = select.exposure_penalty(df, "trade_score", strength, 2, cap=cap, rounds=rounds, block_rows=block_rows).collect()
        assert [(r.row_id, r.rank_in_bucket) for r in sorted(got, key=lambda r: r.row_id)] == [w[:2] for w in want]
        assert rounds[0] <= most
    order = [F.desc("trade_score"), F.desc("hybrid_score"), F.col("symbol"), F.col("row_id")]
    some = select._contenders(df, 2, "open_time", "trade_score", order, 1, cap, 50, F.lit(abs(strength * scale)), strength < 0)
    assert some.count() < len(rows) / 3
