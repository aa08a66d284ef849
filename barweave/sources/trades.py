"""Reading trade tapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Texts of the maker flag. A buyer-maker trade is a sell by the taker.
BUY_FLAGS = ("false", "False", "0")
SELL_FLAGS = ("true", "True", "1")


def side(flag) -> Column:
    return F.when(flag.isin(*BUY_FLAGS), "buy").when(flag.isin(*SELL_FLAGS), "sell")


def parse_tape(lines: DataFrame) -> DataFrame:
    """(symbol, value) lines id,price,quantity,quote,time,isBuyerMaker[,...]; unknown flags are left out."""
    fields = lines.select("symbol", F.split("value", ",").alias("f")).filter(F.size("f") >= 6)
    rows = fields.select(
        "symbol",
        F.col("f")[0].try_cast("long").alias("trade_id"),
        F.col("f")[1].try_cast("double").alias("price"),
        F.col("f")[2].try_cast("double").alias("quantity"),
        F.col("f")[4].try_cast("long").alias("trade_time"),
        side(F.trim(F.col("f")[5])).alias("side"),
    )
    return rows.filter(F.col("side").isNotNull()).withColumn("is_buyer_maker", F.col("side") == "sell")


def read_trades(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Tapes in .csv or .csv.gz files named SYMBOL-..."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^([A-Z0-9]+)-", 1)
    return parse_tape(spark.read.text(path).select("value", name.alias("symbol")))
