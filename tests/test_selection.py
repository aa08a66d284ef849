import random

import pytest
from pyspark.sql import functions as F

from barweave.operators import models, scores, select, splits
from barweave.sources import samples as sets

MINUTE = 60_000
BASE = 1_600_000_000_000 - 1_600_000_000_000 % (60 * MINUTE)


def rows(spark, items):
    """(symbol, minute, score) triples."""
    return spark.createDataFrame(
        [(f"r{i:03d}", s, BASE + m * MINUTE, float(x), "d", 1) for i, (s, m, x) in enumerate(items)],
        "row_id string, symbol string, open_time bigint, trade_score double, trade_day string, fold int",
    )


def ids(df):
    return sorted(int(r.row_id[1:]) for r in df.collect())


def best(df, k, **how):
    return ids(select.topk(df, k, ["open_time"], select.score_order(df, "trade_score"), **how))


def test_topk_per_minute(spark):
    assert best(rows(spark, [("A", 0, 0.95), ("A", 0, 0.80), ("A", 1, 0.92), ("A", 1, 0.70)]), 1) == [0, 2]


def test_topk_symbol_cap(spark):
    df = rows(spark, [("AAVE", 0, 0.99), ("AAVE", 0, 0.98), ("AAVE", 0, 0.97), ("BTC", 0, 0.96)])
    assert best(df, 2, per_symbol=1) == [0, 3]


def test_unique_symbols_first(spark):
    assert best(rows(spark, [("BNB", 0, 0.99), ("BNB", 0, 0.98), ("ETH", 0, 0.97)]), 2, unique_first=True) == [0, 2]


def test_top_percent(spark):
    df = rows(spark, [("A", 0, 4.0), ("B", 0, 3.0), ("C", 0, 2.0), ("D", 0, 1.0)])
    assert ids(select.top_percent(df, 0.5, ["open_time"], select.score_order(df, "trade_score"))) == [0, 1]


def test_cooldown_edges(spark):
    df = rows(spark, [("AAVE", 0, 1), ("AAVE", 10, 1), ("AAVE", 16, 1)])
    assert ids(select.cooldown(df, 15)) == [0, 2]


def test_cooldown_matches_sequential_rule(spark):
    rnd = random.Random(4)
    items = [("hot" if rnd.random() < 0.5 else rnd.choice("ab"), rnd.randint(0, 300), 1.0) for _ in range(600)]
    df = rows(spark, items)
    last, want = {}, []
    for i, (s, m, _) in sorted(enumerate(items), key=lambda x: (x[1][1], x[0])):
        if s not in last or m - last[s] >= 7:
            last[s] = m
            want.append(i)
    assert ids(select.cooldown(df, 7)) == sorted(want)


def test_streak_cap(spark):
    df = rows(spark, [("AAVE", 0, 1), ("AAVE", 1, 1), ("AAVE", 2, 1), ("BTC", 3, 1), ("AAVE", 4, 1)])
    assert ids(select.streak_cap(df, 2)) == [0, 1, 3, 4]


def test_streak_cap_matches_sequential_rule(spark):
    rnd = random.Random(9)
    items = [(rnd.choice("aab"), i, 1.0) for i in range(500)]
    kept, run, prev = [], 0, None
    for i, (s, _, _) in enumerate(items):
        run = run + 1 if s == prev else 1
        prev = s
        if run <= 2:
            kept.append(i)
    assert ids(select.streak_cap(rows(spark, items), 2)) == kept


def test_first_entries_per_period(spark):
    df = rows(spark, [("AAVE", 0, 1), ("AAVE", 5, 1), ("AAVE", 70, 1)])
    assert ids(select.first_n(df.withColumn("p", select.period(60)), ["symbol", "p"], 1)) == [0, 2]
    assert ids(select.first_n(df, ["fold"], 2)) == [0, 1]


def test_dominance_penalty_turns_the_order(spark):
    df = rows(spark, [("BNB", 0, 1.00), ("ETH", 0, 0.92)])
    val = rows(spark, [("BNB", 0, 1)] * 9 + [("ETH", 0, 1)])
    got = {r.symbol: r.penalised_score for r in select.dominance_penalty(df, val, "trade_score", 0.8).collect()}
    assert got["BNB"] == pytest.approx(0.28) and got["ETH"] == pytest.approx(0.84)


def test_shrunk_symbol_score(spark):
    val = spark.createDataFrame(
        [("LEADER", "d", 0.02, True), ("GOOD", "d", 0.015, False)] * 2, "symbol string, trade_day string, net double, ex boolean"
    )
    got = {r.symbol: r.symbol_score for r in select.symbol_scores(val, F.col("net"), F.col("ex"), shrink=2.0).collect()}
    assert got["LEADER"] == pytest.approx(0.01875)


def test_zscore_and_percent_rank(spark):
    df = rows(spark, [("A", 0, 1.0), ("B", 0, 1.0), ("C", 0, 3.0), ("D", 1, 5.0)])
    z = {r.symbol: r.z for r in select.zscore(df, {"trade_score": "z"}, ["open_time"]).collect()}
    assert z["A"] == pytest.approx(-0.7071067) and z["C"] == pytest.approx(1.4142135) and z["D"] == 0.0
    p = {r.symbol: r.p for r in select.pct_rank(df, "trade_score", "p", ["open_time"]).collect()}
    assert (p["A"], p["B"], p["C"], p["D"]) == (0.25, 0.25, 1.0, 0.0)


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def test_scores(spark):
    p, r = F.lit(0.5), F.lit(0.04)
    assert value(spark, scores.hybrid("probability_times_return", p, r)) == pytest.approx(0.0185)
    assert value(spark, scores.hybrid("expected_return", p, r)) == pytest.approx(0.0385)
    assert value(spark, scores.hybrid("expected_return", F.lit(0.4), r, min_p=0.5)) == float("-inf")
    assert value(spark, scores.risk_adjust(F.lit(0.0385), F.lit(0.1), 0.5)) == pytest.approx(0.0385 - 0.05)
    relative = scores.risk_adjust_relative(F.lit(0.0385), F.lit(0.02), 0.5, F.lit(0.01), F.lit(0.02))
    assert value(spark, relative) == pytest.approx(0.0385 - 0.005)
    df = spark.createDataFrame([(1, 0.04), (1, 0.02), (0, -0.01), (0, -0.03)], "label int, trade_return double")
    got = scores.payoffs(df, 0.02, 0.02).first()
    assert (got.win_return, got.loss_return, got.payoff_source) == (pytest.approx(0.03), pytest.approx(-0.02), "empirical_validation")
    thin = scores.payoffs(df.filter("label = 1"), 0.02, 0.03, 2).first()
    assert (thin.win_return, thin.loss_return, thin.payoff_source) == (0.02, -0.03, "fixed_fallback")


def test_upper_cap_and_missing_floor_columns(spark):
    df = spark.createDataFrame([(4.0,), (3.0,), (2.0,), (1.0,)], "s double")
    got = scores.upper_cap(df, "s", 0.5).collect()
    assert got[0].upper_cap == 2.5 and sum(r.capped for r in got) == 2
    assert scores.dynamic_floor(df, "btc_return_60m", "vol").first().regime == "none"


def test_month_splits(spark):
    df = spark.createDataFrame([("A", f"2020-{m:02d}", i) for m in range(1, 9) for i in range(4)], "symbol string, month string, i int")
    counts = {r["split"]: r["count"] for r in splits.ratio(df).groupBy("split").count().collect()}
    assert counts == {"train": 24, "validation": 4, "test": 4}
    counts = {r["split"]: r["count"] for r in splits.fixed(df).groupBy("split").count().collect()}
    assert counts == {"train": 24, "validation": 4, "test": 4}
    assert splits.ratio(df.filter("month < '2020-03'")).count() == 0


def test_walk_forward_windows(spark):
    df = spark.range(32).select(F.col("id").cast("int").alias("month_index"))
    got = {(r.fold, r["split"]): (r.a, r.b) for r in splits.walk_forward_windows(df, 24, 4, 4).groupBy("fold", "split").agg(
        F.min("month_index").alias("a"), F.max("month_index").alias("b")).collect()}
    assert got == {(1, "train"): (0, 23), (1, "validation"): (24, 27), (1, "test"): (28, 31)}
    assert splits.walk_forward_windows(df, 6, 1, 1).select("fold").distinct().count() == 25
    assert splits.walk_forward_windows(df, 40, 1, 1).count() == 0


def test_embargo(spark):
    times = [("train", t) for t in (0, 4, 8)] + [("validation", t) for t in (20, 24, 28)] + [("test", t) for t in (40, 44, 48)]
    df = spark.createDataFrame([(1, s, t * MINUTE) for s, t in times], "fold int, split string, open_time bigint")
    kept, removed = splits.embargo(df, 5)
    assert {r["split"]: r["count"] for r in kept.groupBy("split").count().collect()} == {"train": 3, "validation": 1, "test": 1}
    assert sum(r.removed_rows for r in removed.collect()) == 4


def test_recent_rows_by_time(spark):
    df = spark.createDataFrame([(10,), (40,), (20,), (30,)], "t int")
    assert sorted(r.t for r in splits.recent(df, ["t"], share=0.5).collect()) == [30, 40]


def test_phases(spark):
    assert splits.parse_folds("1-3,5", 7) == {1, 2, 3, 5}
    for bad in ({"discovery": "1-3", "selection": "3"}, {"confirmation": "4"}, {"discovery": "9"}):
        with pytest.raises(ValueError):
            splits.phases(spark, 7, **bad)
    assert splits.phases(spark, 3).count() == 3


def test_cap_keeps_positives_when_they_fit(spark):
    df = spark.range(1000).select("id", (F.col("id") % 20 == 0).cast("int").alias("label"))
    got = splits.cap_rows(df, 200, 0.5, ["id"]).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in got} == {1: 50, 0: 150}


def test_ensemble_windows():
    assert models.windows([7, 0, 7, 30]) == [0, 30, 7]
    with pytest.raises(ValueError):
        models.windows([-1])


def test_global_month_index(spark):
    df = spark.createDataFrame([("A", "2020-02"), ("B", "2020-01"), ("B", "2020-02")], "symbol string, month string")
    assert {(r.symbol, r.month_index) for r in sets.global_month_index(df).collect()} == {("A", 1), ("B", 0), ("B", 1)}
