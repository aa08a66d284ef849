import random

import pytest
from pyspark.sql import functions as F

from barweave.operators import bars as bar_ops
from barweave.operators import exits, features, labels

COLS = bar_ops.BAR_COLUMNS
MINUTE = 60_000


def series(symbol="AAAUSDT", n=70, close=100.0, month="1970-01", **changes):
    rows = []
    for i in range(n):
        row = {
            "symbol": symbol, "month": month, "open_time": i * MINUTE, "open": close, "high": close * 1.002, "low": close * 0.998, "close": close,
            "volume": 1000.0, "quote_volume": 100000.0, "trades": 100.0, "taker_buy_base_volume": 500.0,
        }
        row.update(changes.get(f"bar{i}", {}))
        rows.append(row)
    return rows


def frame(spark, rows):
    schema = "symbol string, month string, open_time bigint, " + ", ".join(f"{c} double" for c in COLS[3:])
    return spark.createDataFrame([tuple(r[c] for c in COLS) for r in rows], schema)


def decide(spark, rows, **how):
    out = labels.outcomes(frame(spark, rows), 5, **how).filter(F.col("open_time") == 60 * MINUTE).collect()
    return out[0] if out else None


def test_target_hit(spark):
    got = decide(spark, series(bar61={"high": 106.0}), target=0.05, stop=0.02)
    assert (got.label, got.trade_return) == (1, pytest.approx(0.05))


def test_stop_hit(spark):
    got = decide(spark, series(bar61={"low": 97.0}), target=0.05, stop=0.02)
    assert (got.label, got.trade_return) == (0, pytest.approx(-0.02))


def test_tie_policies(spark):
    both = series(bar61={"high": 106.0, "low": 97.0})
    assert decide(spark, both, target=0.05, stop=0.02, tie="skip") is None
    assert decide(spark, both, target=0.05, stop=0.02, tie="target_first").label == 1
    assert decide(spark, both, target=0.05, stop=0.02, tie="stop_first").label == 0


def test_first_decline_exit(spark):
    rows = series(
        bar61={"close": 102.5, "high": 103.0}, bar62={"close": 103.5, "high": 104.0}, bar63={"close": 102.8, "high": 103.2}
    )
    got = decide(spark, rows, target=0.02, stop=0.02, exit_mode="first_decline")
    assert (got.label, got.trade_return) == (1, pytest.approx(0.035))


def test_missing_leaders_set_flags(spark):
    bars = frame(spark, series())
    row = features.regime(features.base(bars), bars).filter(F.col("_row") == 61).first()
    assert row["btc_regime_missing"] == 1.0 and row["eth_regime_missing"] == 1.0 and row["btc_return_5m"] == 0.0


def test_breadth_of_rising_symbols_and_gate(spark):
    rows = []
    for k in range(5):
        for i, r in enumerate(series(f"S{k}USDT", 70)):
            r["close"] = 100.0 + i * (k + 1) * 0.01
            r["high"], r["low"] = r["close"] * 1.01, r["close"] * 0.99
            rows.append(r)
    got = features.breadth(features.base(frame(spark, rows)), 5).filter(F.col("_row") == 61).first()
    assert got["market_breadth_up_5m"] == 1.0 and got["market_breadth_missing"] == 0.0
    alone = features.breadth(features.base(frame(spark, series())), 5).filter(F.col("_row") == 61).first()
    assert alone["market_breadth_missing"] == 1.0


def walk(seed, n=150):
    rnd = random.Random(seed)
    price, rows = 100.0, []
    for i, r in enumerate(series("AAAUSDT", n)):
        nxt = price * (1 + rnd.uniform(-0.02, 0.02))
        r.update(open=price, close=nxt, high=max(price, nxt) * 1.005, low=min(price, nxt) * 0.995, volume=rnd.uniform(1, 1000), trades=float(rnd.randint(1, 99)))
        r["taker_buy_base_volume"] = r["volume"] * rnd.random()
        r["quote_volume"] = r["volume"] * nxt
        price = nxt
        rows.append(r)
    return rows


def test_no_lookahead(spark):
    """Bars after the decision bar must not change any feature at it."""
    rows, cut = walk(5), 100
    changed = [dict(r) for r in rows]
    for r in changed[cut + 1:]:
        for c in COLS[3:]:
            r[c] *= 7.3
    wanted = ["_row", *features.BASE, *features.BREADTH]
    a, b = (
        features.breadth(features.base(frame(spark, x), day_rows=30), 1).filter(F.col("_row") <= cut + 1).select(*wanted).orderBy("_row").collect()
        for x in (rows, changed)
    )
    assert a == b


@pytest.mark.parametrize("width", [2, 7, 60, 149, 500])
def test_day_extremes_match_plain_windows(spark, width):
    df = frame(spark, walk(8))
    w = features.series().rowsBetween(-(width - 1), 0)
    plain = df.select("open_time", (F.col("close") / F.max("high").over(w) - 1).alias("h"), (F.col("close") / F.min("low").over(w) - 1).alias("l"))
    both = features.base(df, day_rows=width).join(plain, "open_time").agg(
        F.max(F.abs(F.col("distance_from_high_24h") - F.col("h"))).alias("dh"), F.max(F.abs(F.col("distance_from_low_24h") - F.col("l"))).alias("dl")
    ).first()
    assert both["dh"] < 1e-12 and both["dl"] < 1e-12


def test_history_restarts_with_the_month(spark):
    rows = series(n=70) + [dict(r, month="1970-02", open_time=r["open_time"] + 10**9) for r in series(n=70)]
    got = features.base(frame(spark, rows)).filter(F.col("_row") == 1).count()
    assert got == 2


TRAILING = [
    ([0.005, 0.009, 0.0085, 0.008], "max_holding_time", 4, 0.008),
    ([-0.021, -0.015, 0.01], "stop_loss", 1, -0.021),
    ([0.011, 0.0115, 0.0112], "max_holding_time", 3, 0.0112),
    ([0.011, 0.015, 0.012], "trailing_stop", 3, 0.012),
    ([0.001, 0.002, 0.0015, 0.0025], "max_holding_time", 4, 0.0025),
]


@pytest.mark.parametrize("path, reason, bar, ret", TRAILING)
def test_trailing_stop(spark, path, reason, bar, ret):
    df = spark.createDataFrame([(path,)], "p array<double>")
    got = df.select(exits.trailing("p", 0.01, 0.003, 0.02).alias("e")).first()["e"]
    assert (got.exit_reason, got.exit_bar, got.exit_return) == (reason, bar, pytest.approx(ret))


def test_future_path_uses_the_decision_close(spark):
    rows = series(n=3, bar0={"close": 110.0}, bar1={"close": 115.0}, bar2={"close": 116.0})
    got = exits.path(frame(spark, rows), 2).filter("open_time = 0").first()["future_returns"]
    assert got == [pytest.approx(115 / 110 - 1), pytest.approx(116 / 110 - 1)]


def test_missing_path_and_conflicting_bars_are_errors(spark):
    df = exits.path(frame(spark, series(n=3)), 5)
    with pytest.raises(Exception, match="ordered future candle path"):
        df.select(exits.trailing(exits.require_path(), 0.01, 0.003, 0.02)).collect()
    twice = frame(spark, series(n=2) + series(n=2))
    assert bar_ops.distinct_bars(twice).count() == 2
    clash = frame(spark, series(n=2) + series(n=2, bar1={"close": 111.0}))
    with pytest.raises(Exception, match="conflicting bars"):
        bar_ops.distinct_bars(clash).collect()


def test_relevance_and_utility(spark):
    df = spark.createDataFrame([(0.001,), (0.002,), (0.004,), (-0.010,)], "u double")
    cuts = labels.grade_cuts(df, "u", 0.5, 0.75, 1.0)
    row = cuts.first()
    assert (row.weak, row.useful, row.strong) == (pytest.approx(0.002), pytest.approx(0.003), pytest.approx(0.004))
    fixed = spark.createDataFrame([(0.003, 0.006, 0.008)], "weak double, useful double, strong double")
    values = spark.createDataFrame([(-0.010,), (0.001,), (0.004,), (0.007,), (0.009,)], "u double")
    got = [r.grade for r in labels.relevance(values, fixed, "u").orderBy("u").collect()]
    assert got == [0, 0, 1, 3, 4]
    two = spark.createDataFrame([(0.0030, 0.0), (0.0020, 0.0)], "trade_return double, max_future_low_return double")
    nets = [r[0] for r in two.select(labels.net_utility(0.001, 0.0005, margin=0.001)).collect()]
    assert nets == [pytest.approx(0.0005), pytest.approx(-0.0005)]
