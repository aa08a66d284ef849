"""The exposure penalty and the cap inside the selection, against the rule taken one bucket at a time."""

import random

import pytest

from barweave.operators import select


def sequential(rows, scale, strength, k, per_symbol, cap, warmup):
    picks, total, out = {}, 0, []
    for bucket in sorted({r[2] for r in rows}):
        value = {r[0]: r[3] - (strength * scale * (picks.get(r[1], 0) / total) if total else 0.0) for r in rows if r[2] == bucket}
        ranked = sorted((r for r in rows if r[2] == bucket), key=lambda r: (-value[r[0]], -r[3], -r[4], r[1], r[0]))
        mine, done = {}, 0
        for r in ranked:
            if per_symbol and mine.get(r[1], 0) >= per_symbol:
                continue
            if cap and total >= warmup and (picks.get(r[1], 0) + 1) / (total + 1) > cap:
                continue
            picks[r[1]] = picks.get(r[1], 0) + 1
            mine[r[1]] = mine.get(r[1], 0) + 1
            total, done = total + 1, done + 1
            out.append((r[0], done, value[r[0]]))
            if done >= k:
                break
    return sorted(out)


def table(seed, n, buckets, symbols):
    rng = random.Random(seed)
    name = lambda: "hot" if rng.random() < 0.34 else f"S{rng.randrange(symbols)}"
    at = lambda: 7 if rng.random() < 0.2 else rng.randrange(buckets)
    return [(f"r{i:04d}", name(), at(), round(rng.gauss(0.5, 0.2), rng.choice([1, 2, 6])), rng.choice([0.1, 0.2])) for i in range(n)]


SCHEMA = "row_id string, symbol string, open_time bigint, trade_score double, hybrid_score double"


@pytest.mark.parametrize("cap,warmup,per_symbol,k", [(0.0, 50, 1, 2), (0.35, 20, 1, 2), (0.0, 50, 0, 3), (0.3, 5, 2, 3)])
def test_equals_the_sequential_rule(spark, cap, warmup, per_symbol, k):
    for seed, strength in ((1, 0.75), (2, 3.0)):
        rows = table(seed, 400, 60, 5)
        df = spark.createDataFrame(rows, SCHEMA)
        scale = select.score_scale(df, "trade_score").first().scale
        rounds = []
        got = select.exposure_penalty(df, "trade_score", strength, k, per_symbol=per_symbol, cap=cap, warmup=warmup, rounds=rounds)
        have = sorted((r.row_id, r.rank_in_bucket, r.penalised_score) for r in got.collect())
        want = sequential(rows, scale, strength, k, per_symbol, cap, warmup)
        assert [h[:2] for h in have] == [w[:2] for w in want]
        assert [h[2] for h in have] == pytest.approx([w[2] for w in want])
        assert rounds[0] >= rounds[-1] and len(rounds) <= rounds[0] + 1


def test_replay_equals_the_sequential_rule_on_many_tables():
    """The task's part alone, cut into blocks at random places, each started from what the rule has picked before."""
    import pandas as pd

    for seed in range(200):
        rng = random.Random(seed)
        rows = table(seed, rng.choice([30, 120]), rng.choice([3, 25]), rng.choice([2, 6]))
        cap, k, per_symbol = rng.choice([0.0, 0.35]), rng.choice([1, 2, 3]), rng.choice([0, 1, 2])
        want = sequential(rows, 1.0, 0.75, k, per_symbol, cap, 10)
        run = select._replay(["trade_score", "hybrid_score"], k, per_symbol, 0.75, cap, 10)
        symbol = {r[0]: r[1] for r in rows}
        got, edges = [], sorted(rng.sample(range(26), 3))
        for lo, hi in zip([-1, *edges], [*edges, 99]):
            counts = pd.Series([symbol[g[0]] for g in got], dtype=object).value_counts()
            before = pd.DataFrame({"symbol": counts.index, "picks": counts.to_numpy()})
            block = pd.DataFrame([r for r in rows if lo < r[2] <= hi], columns=["row_id", "symbol", "_bucket", "trade_score", "hybrid_score"])
            out = run((0,), block, before)
            got += list(zip(out["row_id"], out["rank_in_bucket"], out["penalised_score"]))
        assert [g[:2] for g in sorted(got)] == [w[:2] for w in want]


def test_empty_null_and_other_columns(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert select.exposure_penalty(none, "trade_score", 0.5, 2).count() == 0
    df = spark.createDataFrame([("a", "S", 1, None, None), ("b", "S", None, 1.0, 1.0), ("c", "S", 1, 2.0, None), ("c", "S", 1, 2.0, None)], SCHEMA)
    got = select.exposure_penalty(df, "trade_score", 0.5, 2).collect()
    assert [(r.row_id, r.rank_in_bucket, r.earlier_share) for r in got] == [("c", 1, 0.0)]
