"""Reading bar files: plain, gzip or zipped comma-separated lines without a header."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import month_of, to_ms
from ..operators.bars import BAR_COLUMNS, distinct_bars

# Position of each bar field in a line; a line needs at least 11 fields.
FIELDS = {
    "open_time": 0, "open": 1, "high": 2, "low": 3, "close": 4,
    "volume": 5, "quote_volume": 7, "trades": 8, "taker_buy_base_volume": 9,
}
MIN_FIELDS = 11
SYMBOL_IN_NAME = r"([A-Z0-9]+)-[0-9]+[a-zA-Z]-[0-9]{4}-[0-9]{2}(?:-[0-9]{2})?\.[a-z.]+$"
LINES_PER_BATCH = 50_000


def parse_lines(lines: DataFrame, line: str = "value", keep: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Text lines to bars. Header and short lines go; prices must be positive."""
    parts = F.split(F.col(line), ",")
    rows = lines.select(*keep, parts.alias("f")).filter(
        (F.size("f") >= MIN_FIELDS) & F.col("f")[0].rlike("^[0-9]+$")
    )
    cols = [
        (to_ms(F.col("f")[i].cast("long")) if name == "open_time" else F.col("f")[i].try_cast("double")).alias(name)
        for name, i in FIELDS.items()
    ]
    out = rows.select(*keep, *cols).withColumn("month", month_of("open_time"))
    priced = (F.col("open") > 0) & (F.col("high") > 0) & (F.col("low") > 0) & (F.col("close") > 0)
    return out.filter(priced).select(*BAR_COLUMNS)


def read_bars(spark: SparkSession, path: str | list[str], unique: bool = True) -> DataFrame:
    """Bars from .csv and .csv.gz files named SYMBOL-1m-YYYY-MM[-DD]."""
    lines = spark.read.text(path).select(
        "value", F.regexp_extract(F.col("_metadata.file_name"), SYMBOL_IN_NAME, 1).alias("symbol")
    )
    bars = parse_lines(lines)
    return distinct_bars(bars) if unique else bars


def _unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for symbol, content in zip(batch["symbol"], batch["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                with archive.open(archive.namelist()[0]) as member:
                    pending: list[str] = []
                    for raw in member:
                        pending.append(raw.decode("utf-8").rstrip("\r\n"))
                        if len(pending) == LINES_PER_BATCH:
                            yield pd.DataFrame({"symbol": symbol, "value": pending})
                            pending = []
                    if pending:
                        yield pd.DataFrame({"symbol": symbol, "value": pending})


def parse_archives(files: DataFrame) -> DataFrame:
    """(symbol, content) rows, each a zip whose first member holds bar lines."""
    return parse_lines(files.select("symbol", "content").mapInPandas(_unzip, "symbol string, value string"))


def read_bar_archives(spark: SparkSession, path: str | list[str], unique: bool = True) -> DataFrame:
    """Bars from zipped files; one file is one record, so files spread over tasks."""
    files = spark.read.format("binaryFile").load(path)
    name = F.regexp_extract(F.element_at(F.split("path", "/"), -1), SYMBOL_IN_NAME, 1)
    bars = parse_archives(files.select(name.alias("symbol"), "content"))
    return distinct_bars(bars) if unique else bars


def prefer_monthly(monthly: DataFrame, daily: DataFrame) -> DataFrame:
    """Monthly bars, plus daily bars of the (symbol, month) pairs that have no monthly ones."""
    have = monthly.select("symbol", "month").distinct()
    return monthly.unionByName(daily.join(have, ["symbol", "month"], "left_anti"))


def first_months(bars: DataFrame, n: int) -> DataFrame:
    """Only the first n distinct months of each symbol; 0 keeps all."""
    if n == 0:
        return bars
    months = bars.select("symbol", "month").distinct()
    place = F.dense_rank().over(Window.partitionBy("symbol").orderBy("month"))  # a symbol has few months
    keep = months.withColumn("place", place).filter(F.col("place") <= n).drop("place")
    return bars.join(keep, ["symbol", "month"], "left_semi")


def lines_of(bars: DataFrame) -> DataFrame:
    """Bars back to text lines in file layout, for exports and round trips."""
    blank = F.lit("0")
    cells = [
        F.col("open_time").cast("string"), *[F.col(c).cast("string") for c in ("open", "high", "low", "close", "volume")],
        blank, *[F.col(c).cast("string") for c in ("quote_volume", "trades", "taker_buy_base_volume")], blank,
    ]
    return bars.select("symbol", "month", F.concat_ws(",", *cells).alias("value"))
