"""Streaming forms of four batch operators: bars, cooldown, top-k per closed bucket, sliding side ratio."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.scalars import MS_PER_MINUTE, floor_div
from ..operators import select
from ..operators.universe import with_ratio


def bars(trades: DataFrame, every: str = "1 minute", delay: str = "10 minutes", tie: list[str] | None = None) -> DataFrame:
    """Bars of a trade stream (ts timestamp, symbol, price, quantity, is_buyer_maker), sent when the watermark
    passes their end; trades later than `delay` are dropped."""
    order = F.struct("ts", *(tie or []))
    w = F.window("ts", every)
    out = trades.withWatermark("ts", delay).groupBy("symbol", w).agg(
        F.min_by("price", order).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", order).alias("close"),
        F.sum("quantity").alias("volume"),
        F.sum(F.col("price") * F.col("quantity")).alias("quote_volume"),
        F.count(F.lit(1)).cast("double").alias("trades"),
        F.sum(F.when(F.col("is_buyer_maker"), 0.0).otherwise(F.col("quantity"))).alias("taker_buy_base_volume"),
    )
    start = F.unix_millis("window.start").alias("open_time")
    return out.select("symbol", start, *[c for c in out.columns if c not in ("symbol", "window")])


def cooldown(entries: DataFrame, minutes: int, delay: str = "10 minutes") -> DataFrame:
    """Accepted minutes per symbol of an entry stream (symbol, open_time in ms), sent when the watermark has passed them.

    Entries wait in the state until then, so the answer does not depend on how the stream is cut into micro-batches; entries later
    than `delay` are dropped. The state holds the last accepted minute and the distinct minutes still open, and is freed by a timer once
    the cooldown has run out.
    """
    timed = entries.select("symbol", floor_div("open_time", MS_PER_MINUTE).alias("minute"), F.timestamp_millis("open_time").alias("ts")).withWatermark("ts", delay)

    def accept(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, waiting = state.get if state.exists else (None, [])
        seen = set(waiting)
        for chunk in chunks:
            seen.update(chunk["minute"].unique().tolist())
        now = state.getCurrentWatermarkMs()
        kept, rest = [], []
        for m in sorted(int(m) for m in seen):
            if m >= now // MS_PER_MINUTE:
                rest.append(m)
            elif last is None or m - last >= minutes:
                kept.append(m)
                last = m
        until = rest[0] + 1 if rest else None if last is None else last + minutes
        if until is None or (not rest and until * MS_PER_MINUTE <= now):
            if state.exists:
                state.remove()
        else:
            state.update((last, rest))
            state.setTimeoutTimestamp(max(until * MS_PER_MINUTE, now + 1))
        yield pd.DataFrame({"symbol": [key[0]] * len(kept), "minute": kept}).astype({"minute": "int64"})

    return timed.groupBy("symbol").applyInPandasWithState(
        accept, "symbol string, minute bigint", "last bigint, waiting array<bigint>", "append", GroupStateTimeout.EventTimeTimeout
    )


def topk_sink(path: str, k: int, bucket: list[str], score: str):
    """foreachBatch function: the best k rows per bucket of each micro-batch, one folder per batch.

    Top-k of top-k is top-k, so no state is kept, and a repeated batch overwrites its own folder.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        best = select.topk(batch, k, bucket, select.score_order(batch, score))
        best.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def closed_topk(spark: SparkSession, path: str, k: int, bucket: list[str], score: str, closed) -> DataFrame:
    """Best k rows of the buckets for which the column condition `closed` holds, over all batches so far."""
    parts = spark.read.parquet(path).filter(closed).drop("rank_in_bucket")
    return select.topk(parts, k, bucket, select.score_order(parts, score))


def side_ratio(trades: DataFrame, span: str = "3 days", slide: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Buys, sells and their ratio per symbol over sliding calendar days."""
    counts = trades.withWatermark("ts", delay).groupBy("symbol", F.window("ts", span, slide)).agg(
        F.count_if(~F.col("is_buyer_maker")).alias("buy_trades_3d"), F.count_if("is_buyer_maker").alias("sell_trades_3d")
    )
    return with_ratio(counts.select("symbol", F.date_format("window.start", "yyyy-MM-dd").alias("first_day"), "buy_trades_3d", "sell_trades_3d"))
