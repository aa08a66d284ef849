"""Leakage-safe features per (symbol, month) series: base, leader context and market breadth.

History restarts with each month, lookbacks count rows. A series has at most one row per minute of a
month, so its window partition is bounded; every base feature shares that one partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clip, log1p_pos, safe_ratio
from .bars import SERIES

HOUR = 60
DAY = 1440
TINY = 1e-12

# Feature names in table order.
BASE = """
ret_1m ret_3m ret_5m range_pct candle_return log_volume log_quote_volume log_trades taker_buy_ratio volume_change
ret_10m ret_15m ret_30m ret_60m rolling_volatility_60m rolling_volume_mean_60m rolling_volume_zscore_60m
relative_volume_previous_hour rolling_trade_count_zscore_60m taker_buy_ratio_change taker_buy_imbalance
distance_from_recent_high_60m distance_from_recent_low_60m consecutive_green_candles consecutive_red_candles
volume_acceleration trade_count_acceleration candle_body_range_ratio upper_wick_pct lower_wick_pct
distance_from_high_24h distance_from_low_24h rolling_quote_volume_mean_60m rolling_quote_volume_zscore_60m
relative_quote_volume_previous_hour taker_buy_ratio_mean_60m taker_buy_ratio_zscore_60m
""".split()
LEADER_MEASURES = """
return_5m return_15m return_60m return_240m return_1440m volatility_60m volatility_240m volume_zscore_60m
volume_zscore_1440m
""".split()
BREADTH = """
market_breadth_up_5m market_breadth_up_15m market_breadth_up_60m market_average_return_5m market_average_return_15m
market_average_return_60m market_median_return_15m market_quote_volume_zscore_60m symbol_return_minus_market_5m
symbol_return_minus_market_15m symbol_return_minus_market_60m market_breadth_missing
""".split()
DEFAULT_LEADERS = {"btc": "BTCUSDT", "eth": "ETHUSDT"}


def regime_names(leaders: dict[str, str] = DEFAULT_LEADERS) -> list[str]:
    names = [f"{a}_{m}" for a in leaders for m in LEADER_MEASURES]
    names += [f"symbol_return_minus_{a}_{k}m" for a in leaders for k in (5, 15, 60)]
    first = next(iter(leaders))
    names.append(f"symbol_volume_zscore_minus_{first}_volume_zscore_60m")
    return names + [f"{a}_regime_missing" for a in leaders]


def series() -> Window:
    return Window.partitionBy(*SERIES).orderBy("open_time")


def _ret(back: str) -> Column:
    """Close over an earlier close, minus 1; 0 without that row."""
    return F.coalesce(clip(safe_ratio(F.col("close"), F.col(back)) - 1, -1, 1), F.lit(0.0))


def _taker() -> Column:
    return clip(safe_ratio("taker_buy_base_volume", "volume"), 0, 1)


def _stats(columns: dict[str, str], frame, tag: str = "") -> dict[str, Column]:
    """Window columns _m<tag>_<name> and _s<tag>_<name>, each computed once: mean (0 without rows) and
    population deviation (1 without rows or spread)."""
    out = {}
    for name, c in columns.items():
        sd = F.stddev_pop(c).over(frame)
        out[f"_m{tag}_{name}"] = F.coalesce(F.avg(c).over(frame), F.lit(0.0))
        out[f"_s{tag}_{name}"] = F.coalesce(sd, F.lit(0.0))
    return out


def _zscore(c: str, name: str, tag: str = "") -> Column:
    sd = F.when(F.col(f"_s{tag}_{name}") < TINY, 1.0).otherwise(F.col(f"_s{tag}_{name}"))
    return clip((F.col(c) - F.col(f"_m{tag}_{name}")) / sd, -20, 20)


def _block_tails(df: DataFrame, width: int) -> DataFrame:
    """First half of the sliding extremes: `_tail_high` and `_tail_low`.

    The series is cut into blocks of `width` rows counted from its end. The tail of a row is the extreme
    from the row to the end of its block, as a running extreme in descending order that starts over with
    each block because the block number leads the compared struct. The columns hold the tail of the row
    `width - 1` rows back, which in this order is a lead.
    """
    down = Window.partitionBy(*SERIES).orderBy(F.desc("open_time"))
    upto = down.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_block", F.floor((F.row_number().over(down) - 1) / width))
    df = df.withColumns(
        {
            "_th": F.max(F.struct("_block", F.col("high").alias("v"))).over(upto),
            "_tl": F.max(F.struct("_block", (-F.col("low")).alias("v"))).over(upto),
        }
    )
    return df.withColumns(
        {
            "_tail_high": F.lead("_th.v", width - 1).over(down),
            "_tail_low": -F.lead("_tl.v", width - 1).over(down),
        }
    ).drop("_th", "_tl")


def _block_heads() -> dict[str, Column]:
    """Second half: extremes from the start of the row's block (or, for the first rows, of the series)."""
    upto = series().rowsBetween(Window.unboundedPreceding, 0)
    block = -F.col("_block")
    return {
        "_head_high": F.max(F.struct(block.alias("b"), F.col("high").alias("v"))).over(upto),
        "_head_low": F.max(F.struct(block.alias("b"), (-F.col("low")).alias("v"))).over(upto),
        "_all_high": F.max("high").over(upto),
        "_all_low": F.min("low").over(upto),
    }


def base(bars: DataFrame, day_rows: int = DAY) -> DataFrame:
    """The bars with `_row` (1-based row of the series) and the 37 base features.

    One shuffle by series and two sorts of it. Window values are columns of their own, so each is computed
    once; the features are plain math over them. The day-long extremes take constant work per row: a window
    of `day_rows` rows is the tail of one block and the head of the next.
    """
    w = series()
    past = w.rowsBetween(-HOUR, -1)
    recent = w.rowsBetween(-(HOUR - 1), 0)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    green = F.col("close") >= F.col("open")

    df = _block_tails(bars.withColumn("_tb", _taker()), day_rows)
    df = df.withColumns(
        {
            "_row": F.row_number().over(w),
            **{f"_c{k}": F.lag("close", k).over(w) for k in (1, 3, 5, 10, 15, 30, 60)},
            **{f"_l_{c}": F.lag(c).over(w) for c in ("volume", "trades", "_tb")},
            **_stats({"v": "volume", "n": "trades", "q": "quote_volume", "tb": "_tb"}, past),
            "_high_hour": F.max("high").over(recent),
            "_low_hour": F.min("low").over(recent),
            **_block_heads(),
        }
    )
    df = df.withColumns(
        {
            "_step": safe_ratio(F.col("close"), F.col("_c1")) - 1,
            "_dv": safe_ratio(F.col("volume"), F.col("_l_volume") + TINY) - 1,
            "_dn": safe_ratio(F.col("trades"), F.col("_l_trades") + TINY) - 1,
        }
    )
    df = df.withColumns(
        {
            "_vol": F.stddev_pop("_step").over(recent),
            "_ldv": F.lag("_dv").over(w),
            "_ldn": F.lag("_dn").over(w),
            "_last_red": F.max(F.when(~green, F.col("_row"))).over(upto),
            "_last_green": F.max(F.when(green, F.col("_row"))).over(upto),
        }
    )
    zero = F.lit(0.0)
    row, span = F.col("_row"), F.greatest(zero, F.col("high") - F.col("low"))
    short = row <= day_rows
    day_high = F.when(short, F.col("_all_high")).otherwise(F.greatest(F.col("_head_high.v"), F.col("_tail_high")))
    day_low = F.when(short, F.col("_all_low")).otherwise(F.least(-F.col("_head_low.v"), F.col("_tail_low")))

    def against(level) -> Column:
        return clip(safe_ratio(F.col("close"), level) - 1, -1, 1)

    def relative(c: str, name: str) -> Column:
        return clip(safe_ratio(F.col(c), F.col(f"_m_{name}") + TINY), 0, 50)

    features = {
        **{f"ret_{k}m": _ret(f"_c{k}") for k in (1, 3, 5, 10, 15, 30, 60)},
        "range_pct": clip(safe_ratio(F.col("high") - F.col("low"), F.col("close")), 0, 2),
        "candle_return": clip(safe_ratio(F.col("close") - F.col("open"), F.col("open")), -1, 1),
        "log_volume": log1p_pos("volume"),
        "log_quote_volume": log1p_pos("quote_volume"),
        "log_trades": log1p_pos("trades"),
        "taker_buy_ratio": F.col("_tb"),
        "volume_change": F.coalesce(clip("_dv", -10, 10), zero),
        "rolling_volatility_60m": F.when(row > HOUR, clip("_vol", 0, 1)).otherwise(zero),
        "rolling_volume_mean_60m": log1p_pos("_m_v"),
        "rolling_volume_zscore_60m": _zscore("volume", "v"),
        "relative_volume_previous_hour": relative("volume", "v"),
        "rolling_trade_count_zscore_60m": _zscore("trades", "n"),
        "taker_buy_ratio_change": F.coalesce(clip(F.col("_tb") - F.col("_l__tb"), -1, 1), zero),
        "taker_buy_imbalance": clip(2 * F.col("_tb") - 1, -1, 1),
        "distance_from_recent_high_60m": against(F.col("_high_hour")),
        "distance_from_recent_low_60m": against(F.col("_low_hour")),
        "consecutive_green_candles": (row - F.coalesce("_last_red", F.lit(0))).cast("double"),
        "consecutive_red_candles": (row - F.coalesce("_last_green", F.lit(0))).cast("double"),
        "volume_acceleration": F.coalesce(clip(F.col("_dv") - F.col("_ldv"), -20, 20), zero),
        "trade_count_acceleration": F.coalesce(clip(F.col("_dn") - F.col("_ldn"), -20, 20), zero),
        "candle_body_range_ratio": clip(safe_ratio(F.abs(F.col("close") - F.col("open")), span), 0, 1),
        "upper_wick_pct": clip(safe_ratio(F.greatest(zero, F.col("high") - F.greatest("open", "close")), span), 0, 1),
        "lower_wick_pct": clip(safe_ratio(F.greatest(zero, F.least("open", "close") - F.col("low")), span), 0, 1),
        "distance_from_high_24h": against(day_high),
        "distance_from_low_24h": against(day_low),
        "rolling_quote_volume_mean_60m": log1p_pos("_m_q"),
        "rolling_quote_volume_zscore_60m": _zscore("quote_volume", "q"),
        "relative_quote_volume_previous_hour": relative("quote_volume", "q"),
        "taker_buy_ratio_mean_60m": clip("_m_tb", 0, 1),
        "taker_buy_ratio_zscore_60m": _zscore("_tb", "tb"),
    }
    return df.select(*bars.columns, "_row", *[features[name].alias(name) for name in BASE])


def eligible(window: int) -> Column:
    """A full hour of history before the row and a full outcome window after it. Needs `_row`."""
    return (F.col("_row") > HOUR) & F.lead("open_time", window).over(series()).isNotNull()


def with_eligibility(df: DataFrame, window: int) -> DataFrame:
    return df.withColumn("eligible", eligible(window))


def leader_table(bars: DataFrame, leaders: dict[str, str] = DEFAULT_LEADERS) -> DataFrame:
    """One row per (month, open_time) with the measures of every leader that has a bar there."""
    w = series()
    lags = (1, 5, 15, 60, 240, 1440)
    rows = bars.filter(F.col("symbol").isin(*leaders.values())).withColumns(
        {
            "_row": F.row_number().over(w),
            **{f"_c{k}": F.lag("close", k).over(w) for k in lags},
            **_stats({"v": "volume"}, w.rowsBetween(-60, -1), "60"),
            **_stats({"v": "volume"}, w.rowsBetween(-1440, -1), "1440"),
        }
    )
    rows = rows.withColumn("_step", safe_ratio(F.col("close"), F.col("_c1")) - 1)
    rows = rows.withColumns({f"_vol{k}": F.stddev_pop("_step").over(w.rowsBetween(-(k - 1), 0)) for k in (60, 240)})
    rows = rows.select(
        *SERIES,
        "open_time",
        *[_ret(f"_c{k}").alias(f"return_{k}m") for k in lags[1:]],
        *[F.when(F.col("_row") > k, clip(f"_vol{k}", 0, 1)).otherwise(0.0).alias(f"volatility_{k}m") for k in (60, 240)],
        *[_zscore("volume", "v", str(k)).alias(f"volume_zscore_{k}m") for k in (60, 1440)],
    )
    aggs = []
    for alias, symbol in leaders.items():
        mine = F.col("symbol") == symbol
        aggs += [F.max(F.when(mine, F.col(m))).alias(f"{alias}_{m}") for m in LEADER_MEASURES]
        aggs.append(F.max(F.when(mine, 1.0)).alias(f"_has_{alias}"))
    return rows.groupBy("month", "open_time").agg(*aggs)


def regime(df: DataFrame, bars: DataFrame, leaders: dict[str, str] = DEFAULT_LEADERS) -> DataFrame:
    """Adds the leader columns to a base feature frame by an exact time match; no match gives zeros and a flag.

    No broadcast hint: the leader table has one row per minute, adaptive execution sees its real size.
    """
    joined = df.join(leader_table(bars, leaders), ["month", "open_time"], "left")
    zero = F.lit(0.0)
    new = {f"{a}_{m}": F.coalesce(F.col(f"{a}_{m}"), zero) for a in leaders for m in LEADER_MEASURES}
    joined = joined.withColumns(new)
    more = {}
    for a in leaders:
        for k in (5, 15, 60):
            more[f"symbol_return_minus_{a}_{k}m"] = clip(F.col(f"ret_{k}m") - F.col(f"{a}_return_{k}m"), -1, 1)
        more[f"{a}_regime_missing"] = F.when(F.col(f"_has_{a}").isNull(), 1.0).otherwise(0.0)
    first = next(iter(leaders))
    more[f"symbol_volume_zscore_minus_{first}_volume_zscore_60m"] = clip(
        F.col("rolling_volume_zscore_60m") - F.col(f"{first}_volume_zscore_60m"), -20, 20
    )
    return joined.withColumns(more).select(*df.columns, *regime_names(leaders))


def breadth_table(df: DataFrame, min_symbols: int = 5) -> DataFrame:
    """One row per (month, open_time): shares, means and median over the symbols of that minute.

    Works on base feature columns. The median is exact; its group is the symbols of one minute.
    """
    def known(k):
        return F.when(F.col("_row") > k, F.col(f"ret_{k}m"))

    counts = {k: F.count(known(k)).alias(f"_n_{k}") for k in (5, 15, 60)}
    ups = [F.count_if(known(k) > 0).alias(f"_up_{k}") for k in (5, 15, 60)]
    means = [F.avg(known(k)).alias(f"_avg_{k}") for k in (5, 15, 60)]
    per_time = df.groupBy("month", "open_time").agg(
        *counts.values(), *ups, *means,
        F.percentile(known(15), 0.5).alias("_median"),
        F.sum("quote_volume").alias("_qv"),
    )
    past = Window.partitionBy("month").orderBy("open_time").rowsBetween(-HOUR, -1)  # minutes of one month
    per_time = per_time.withColumns(_stats({"q": "_qv"}, past))
    enough = F.least("_n_5", "_n_15", "_n_60") >= min_symbols
    zero = F.lit(0.0)

    def gated(c):
        return F.when(enough, c).otherwise(zero)

    return per_time.select(
        "month",
        "open_time",
        *[gated(safe_ratio(F.col(f"_up_{k}"), F.col(f"_n_{k}"))).alias(f"market_breadth_up_{k}m") for k in (5, 15, 60)],
        *[gated(clip(f"_avg_{k}", -1, 1)).alias(f"market_average_return_{k}m") for k in (5, 15, 60)],
        gated(clip("_median", -1, 1)).alias("market_median_return_15m"),
        gated(_zscore("_qv", "q")).alias("market_quote_volume_zscore_60m"),
        F.when(enough, 0.0).otherwise(1.0).alias("market_breadth_missing"),
    )


def breadth(df: DataFrame, min_symbols: int = 5) -> DataFrame:
    """Adds the breadth columns to a base feature frame."""
    joined = df.join(breadth_table(df, min_symbols), ["month", "open_time"], "left")
    diffs = {
        f"symbol_return_minus_market_{k}m": clip(F.col(f"ret_{k}m") - F.col(f"market_average_return_{k}m"), -1, 1)
        for k in (5, 15, 60)
    }
    return joined.withColumns(diffs).select(*df.columns, *BREADTH)
