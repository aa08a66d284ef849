"""Which symbols to work on: name rules and the balance of buys and sells."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import MS_PER_DAY, as_col, day_of

# Quote asset, excluded base assets, leveraged-token endings, excluded exact bases.
QUOTE = "USDT"
EXCLUDED_BASES = (
    "BUSD FDUSD TUSD USDC USDP USDS DAI AEUR EURI EUR TRY BRL GBP AUD JPY MXN PLN RON RUB UAH ZAR IDR BIDR NGN "
    "ARS COP CZK KZT VAI UST USTC RLUSD XUSD BFUSD SUSD USDE USDSB USD1 PAX BKRW"
).split()
LEVERAGED_ENDINGS = "UP DOWN BULL BEAR 3L 3S 5L 5S".split()
EXCLUDED_EXACT = "A C D F G S T U W WBETH WBTC BETH XAUT".split()

# Accepted band of buys per sell, days looked at, days searched, ratio without any sell.
RATIO_BAND = (0.70, 1.80)
DAYS_USED = 3
DAYS_SEARCHED = 4
ALL_BUYS_RATIO = 999_999.0


def requested(a: DataFrame, b: DataFrame, override: list[str] | None = None) -> DataFrame:
    """Sorted distinct symbols of two lists; an explicit list wins."""
    if override:
        both = a.sparkSession.createDataFrame([(s,) for s in override], "symbol string")
    else:
        both = a.select("symbol").unionByName(b.select("symbol"))
    return both.distinct().orderBy("symbol")


def is_ordinary(symbol) -> Column:
    """A plain coin against the quote asset: no fiat or stable base, no leveraged token."""
    symbol = as_col(symbol)
    base = F.regexp_extract(symbol, f"^(.*){QUOTE}$", 1)
    leveraged = base.rlike("^.+(" + "|".join(LEVERAGED_ENDINGS) + ")$")
    return (
        symbol.endswith(QUOTE)
        & base.rlike("^[A-Za-z0-9]+$")
        & ~base.isin(*EXCLUDED_BASES, *EXCLUDED_EXACT)
        & ~leveraged
    )


def side_counts(trades: DataFrame, asof_day: str) -> DataFrame:
    """Buys and sells per symbol over its newest 3 available of the last 4 completed UTC days before `asof_day`."""
    end = int(datetime.fromisoformat(asof_day).replace(tzinfo=timezone.utc).timestamp()) * 1000
    searched = F.col("trade_time").between(end - DAYS_SEARCHED * MS_PER_DAY, end - 1)
    daily = (
        trades.filter(searched)
        .select("symbol", day_of("trade_time").alias("day"), "is_buyer_maker")
        .groupBy("symbol", "day")
        .agg(F.count_if(~F.col("is_buyer_maker")).alias("buys"), F.count_if("is_buyer_maker").alias("sells"))
    )
    newest = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("day")))  # at most 4 days each
    return (
        daily.withColumn("newest", newest)
        .filter(F.col("newest") <= DAYS_USED)
        .groupBy("symbol")
        .agg(
            F.sum("buys").alias("buy_trades_3d"),
            F.sum("sells").alias("sell_trades_3d"),
            F.concat_ws("|", F.sort_array(F.collect_set("day"), asc=False)).alias("dates_used"),
        )
    )


def with_ratio(counts: DataFrame) -> DataFrame:
    buys, sells = F.col("buy_trades_3d"), F.col("sell_trades_3d")
    ratio = F.when(sells == 0, F.when(buys > 0, ALL_BUYS_RATIO).otherwise(0.0)).otherwise(buys / sells)
    return counts.withColumn("total_trades_3d", buys + sells).withColumn("buy_sell_ratio", ratio)


def buy_sell_ratio(counts: DataFrame, band: tuple[float, float] = RATIO_BAND) -> DataFrame:
    """Symbols that traded and whose ratio lies in the band, busiest first."""
    kept = with_ratio(counts).filter((F.col("total_trades_3d") > 0) & F.col("buy_sell_ratio").between(*band))
    return kept.orderBy(F.desc("total_trades_3d"), "symbol")
