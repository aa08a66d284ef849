"""Bars per (symbol, bucket) from a trade tape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import MS_PER_MINUTE, month_of

SERIES = ["symbol", "month"]
BAR_COLUMNS = [
    "symbol", "month", "open_time", "open", "high", "low", "close",
    "volume", "quote_volume", "trades", "taker_buy_base_volume",
]


def trade_order(columns: list[str]) -> Column:
    """One number to order trades by: time, or time and id packed into a wide decimal.

    A struct would order just as well, but first and last prices could then not be kept in a hash
    aggregate and every trade would be sorted first.
    """
    if len(columns) == 1:
        return F.col(columns[0])
    first, second = (F.col(c).cast("decimal(19,0)") for c in columns)
    return (first * F.lit("1" + "0" * 19).cast("decimal(20,0)")).cast("decimal(38,0)") + second


def from_trades(trades: DataFrame, bucket_ms: int = MS_PER_MINUTE, tie: list[str] | None = None) -> DataFrame:
    """One bar per symbol and bucket. Plain aggregates, so a hot symbol is combined before the shuffle.

    Trades of one time are ordered by `trade_id`, if the tape has it, unless `tie` says otherwise."""
    order = trade_order(tie or (["trade_time", "trade_id"] if "trade_id" in trades.columns else ["trade_time"]))
    bucket = (F.col("trade_time") - F.pmod("trade_time", F.lit(bucket_ms))).alias("open_time")
    out = trades.groupBy("symbol", bucket).agg(
        F.min_by("price", order).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", order).alias("close"),
        F.sum("quantity").alias("volume"),
        F.sum(F.col("price") * F.col("quantity")).alias("quote_volume"),
        F.count(F.lit(1)).cast("double").alias("trades"),
        F.sum(F.when(F.col("is_buyer_maker"), 0.0).otherwise(F.col("quantity"))).alias("taker_buy_base_volume"),
    )
    return out.withColumn("month", month_of("open_time")).select(*BAR_COLUMNS)


def distinct_bars(bars: DataFrame) -> DataFrame:
    """One row per (symbol, open_time): equal copies collapse, copies that differ are an error.

    Keeps every (symbol, month) series at no more than one row per minute, which bounds the series
    windows of the feature operators at 44,640 rows.
    """
    values = F.struct(*[c for c in BAR_COLUMNS if c not in ("symbol", "open_time")])
    grouped = bars.groupBy("symbol", "open_time").agg(F.min(values).alias("lo"), F.max(values).alias("hi"))
    checked = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(
        F.raise_error(F.concat(F.lit("conflicting bars for "), F.col("symbol"))).cast(grouped.schema["lo"].dataType)
    )
    return grouped.select("symbol", "open_time", checked.alias("v")).select("symbol", "open_time", "v.*").select(*BAR_COLUMNS)
