"""Candidate selection: filters, ranks inside time buckets, caps and cooldowns.

A time bucket or a symbol may hold a large part of all rows. So ranks that are cut at k use a rank
filter, which Spark also applies before the shuffle; full ranks use the ordered prefix; bucket
statistics are aggregates joined back, not windows.
"""

from __future__ import annotations

import itertools
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import MS_PER_MINUTE, floor_div
from ..session import stored
from ..sources.candidates import PRE_FILTER_STAGE
from . import prefix, quantiles

BLOCK_ROWS = 200_000  # contenders replayed by one task
TIGHTEN = 2  # times the contenders are bounded again by the shares that are possible
SLACK = 1.000001
GROUPS = 4  # symbol groups for each row wanted: more of them bound a head more closely
# Order inside a bucket; row_id makes it total.
SCORE_ORDER = ["trade_score", "hybrid_score"]
# Weights of the blended score.
BLEND = {
    "calibrated_probability": 0.35,
    "calibrated_predicted_return": 0.25,
    "predicted_net_return": 0.25,
    "expected_value": 0.15,
}


def score_order(df: DataFrame, score: str) -> list[Column]:
    names = [score] + [c for c in SCORE_ORDER if c in df.columns and c != score]
    return [F.desc(c) for c in names] + [F.col("symbol"), F.col("row_id")]


def signals(df: DataFrame, score: str, threshold: float) -> DataFrame:
    return df.filter(F.col(score) >= threshold)


def rank_in_bucket(df: DataFrame, bucket: list[str], order: list[Column], rank: str, total: str) -> DataFrame:
    """Full rank and row count per bucket."""
    return prefix.ordered(df, bucket, order, rank=rank, total=total)


def topk(
    df: DataFrame,
    k: int,
    bucket: list[str],
    order: list[Column],
    per_symbol: int = 0,
    unique_first: bool = False,
    rank: str = "rank_in_bucket",
) -> DataFrame:
    """Best k rows per bucket. `per_symbol` limits a symbol, lower ranks move up; `unique_first` takes a
    symbol's second row only when the bucket has no further symbol."""
    if per_symbol or unique_first:
        mine = F.row_number().over(Window.partitionBy(*bucket, "symbol").orderBy(*order))
        # With unique_first a symbol's rows beyond its k-th can never be among the best k.
        df = df.withColumn("_mine", mine).filter(F.col("_mine") <= (per_symbol or k))
    final = [F.col("_mine"), *order] if unique_first else order
    place = F.row_number().over(Window.partitionBy(*bucket).orderBy(*final))
    return df.withColumn(rank, place).filter(F.col(rank) <= k).drop("_mine")


def bars(df: DataFrame, k: int, bucket: list[str], score: str) -> DataFrame:
    """Per bucket a score that `_have` (at most k) symbols reach, `_last`. Symbols are dealt over a fixed number of groups, so a task hands on
    a few rows a bucket, however many rows and symbols there are. It is stored: Spark then sees its size, and sends a small one to the rows."""
    group = F.pmod(F.xxhash64("symbol"), F.lit(GROUPS * k)).alias("_group")
    tops = df.filter(F.col(score).isNotNull()).groupBy(*bucket, group).agg(F.max(score).alias("_top"))
    place = F.row_number().over(Window.partitionBy(*bucket).orderBy(F.desc("_top")))
    best = tops.withColumn("_place", place).filter(F.col("_place") <= k)
    return stored(best.groupBy(*bucket).agg(F.min("_top").alias("_last"), F.count(F.lit(1)).alias("_have")))


def heads(df: DataFrame, k: int, bucket: list[str], score: str) -> DataFrame:
    """All rows of a bucket that reach the score of k symbols, so the best k under any limit per symbol are among them, with all their ties.
    A bucket with few symbols stays whole."""
    last = bars(df, k, bucket, score)
    named = last.select(*[F.col(c).alias(f"_at_{c}") for c in bucket], "_last", "_have")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in bucket])
    below = (F.col("_have") >= k) & ~F.coalesce(F.col(score) >= F.col("_last"), F.lit(False))
    return df.join(named, same, "left").filter(~F.coalesce(below, F.lit(False))).select(*df.columns)


def top_percent(df: DataFrame, share: float, bucket: list[str], order: list[Column], rank: str = "rank_in_bucket") -> DataFrame:
    """The first ceil(share * rows) rows of each bucket."""
    ranked = rank_in_bucket(df, bucket, order, rank, "_rows")
    return ranked.filter(F.col(rank) <= F.ceil(F.col("_rows") * share)).drop("_rows")


def top_utility(df: DataFrame, score: str, floor: float, k: int, bucket: list[str]) -> DataFrame:
    """Best k rows per bucket among those whose selection score is present and above the floor."""
    return topk(df.filter(F.col(score) > floor), k, bucket, score_order(df, score))


def market_filter(df: DataFrame, mode: str, breadth: float = 0.5, leader: str = "btc") -> DataFrame:
    """Adds `market_blocked`. 'btc_or_market_positive' takes the leader's 240-row return (form inferred)."""
    market = F.col("market_average_return_60m") > 0
    if mode == "market_positive":
        passed = market
    elif mode == "btc_or_market_positive":
        passed = market | (F.col(f"{leader}_return_240m") > 0)
    elif mode == "breadth":
        passed = F.col("market_breadth_up_60m") >= breadth
    else:
        raise ValueError(f"unknown market filter {mode}")
    return df.withColumn("market_blocked", ~passed)


def symbol_scores(
    validation: DataFrame, net: Column, executed: Column, shrink: float = 0.0, candidate_weight: float = 0.5, executed_weight: float = 0.5
) -> DataFrame:
    """Per symbol: candidate and executed quality (mean net return), their blend, and the blend shrunk to the
    mean quality of all candidates. A row that was executed supports its symbol once."""
    rows = validation.select("symbol", "trade_day", net.alias("net"), executed.alias("ex"))
    per = rows.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count_if("ex").alias("executed"),
        F.avg("net").alias("candidate_quality"),
        F.avg(F.when(F.col("ex"), F.col("net"))).alias("executed_quality"),
        F.sum("net").alias("total_net"),
        F.countDistinct(F.when(F.col("ex"), F.col("trade_day"))).alias("active_days"),
    )
    whole = rows.agg(F.avg("net").alias("_global"), F.count_if("ex").alias("_executed"))
    joined = per.crossJoin(F.broadcast(whole))  # one row
    c, e = F.col("candidate_quality"), F.coalesce("executed_quality", "candidate_quality")
    blended = (candidate_weight * c + executed_weight * e) / (candidate_weight + executed_weight)
    n = F.col("candidates")
    score = (n * blended + shrink * F.col("_global")) / (n + shrink)
    share = F.when(F.col("_executed") > 0, F.col("executed") / F.col("_executed")).otherwise(0.0)
    return joined.withColumn("symbol_score", score).withColumn("executed_share", share).drop("_global", "_executed")


def symbol_filter(scores: DataFrame, min_rows: int, min_score: float = 0.0, max_share: float = 1.0, min_days: int = 0) -> DataFrame:
    """Adds `reason` ('' for a kept symbol). A symbol with a large share of the executed rows needs active days."""
    reason = (
        F.when(F.col("candidates") < min_rows, "too_few_rows")
        .when((F.col("executed_share") > max_share) & (F.col("active_days") < min_days), "dominance_support_floor")
        .when(F.col("symbol_score") <= min_score, "negative_score")
        .otherwise("")
    )
    return scores.withColumn("reason", reason)


def keep_symbols(df: DataFrame, filtered: DataFrame) -> DataFrame:
    return df.join(filtered.filter(F.col("reason") == "").select("symbol"), "symbol", "left_semi")


def dominance_penalty(df: DataFrame, validation: DataFrame, score: str, weight: float, grace: float = 0.0) -> DataFrame:
    """Adds penalised_score: score - weight * max(0, validation share of the symbol - grace)."""
    total = validation.agg(F.count(F.lit(1)).alias("_total"))
    shares = (
        validation.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n")).crossJoin(F.broadcast(total))  # one row
        .select("symbol", (F.col("_n") / F.col("_total")).alias("validation_share"))
    )
    over = F.greatest(F.lit(0.0), F.coalesce("validation_share", F.lit(0.0)) - grace)
    return df.join(shares, "symbol", "left").withColumn("penalised_score", F.col(score) - weight * over)


def first_n(df: DataFrame, keys: list[str], n: int, order: tuple[str, ...] = ("open_time", "row_id")) -> DataFrame:
    """First n entries in time per day, fold, or (symbol, period)."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")


def period(minutes: int) -> Column:
    return floor_div("open_time", minutes * MS_PER_MINUTE)


def streak_cap(df: DataFrame, n: int, order: tuple[str, ...] = ("open_time", "row_id")) -> DataFrame:
    """At most the first n rows of every run of one symbol in time order.

    A run keeps (rank over all rows - rank within the symbol) constant.
    """
    ranked = prefix.ordered(df, [], list(order), rank="_all")
    ranked = prefix.ordered(ranked, ["symbol"], ["_all"], rank="_own")
    run = Window.partitionBy("symbol", F.col("_all") - F.col("_own")).orderBy("_all")
    return ranked.withColumn("_place", F.row_number().over(run)).filter(F.col("_place") <= n).drop("_place", "_all", "_own")


def cooldown(df: DataFrame, minutes: int, keys: tuple[str, ...] = ("fold", "symbol")) -> DataFrame:
    """Entries kept when the symbol's last kept entry is at least `minutes` minutes back.

    Only the first row of a minute can be kept, so each key is reduced to its distinct minutes first:
    a group holds at most the minutes of one fold, however many rows the symbol has.
    """
    tagged = df.withColumn("_minute", floor_div("open_time", MS_PER_MINUTE))
    if minutes <= 0:
        return df
    first = tagged.groupBy(*keys, "_minute").agg(F.min(F.struct("open_time", "row_id")).alias("_first"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in first.select(*keys, "_minute").schema.fields)

    def accept(pdf: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(pdf["_minute"].to_numpy())
        kept, i = [], 0
        while i < len(times):
            kept.append(times[i])
            i = int(np.searchsorted(times, times[i] + minutes))
        out = pdf.iloc[: len(kept)][[*keys]].copy()
        out["_minute"] = kept
        return out

    accepted = first.select(*keys, "_minute").groupBy(*keys).applyInPandas(accept, schema)
    ids = first.join(accepted, [*keys, "_minute"]).select(*keys, "_minute", F.col("_first.row_id").alias("row_id"))
    return tagged.join(ids, [*keys, "_minute", "row_id"], "left_semi").drop("_minute")


def zscore(df: DataFrame, columns: dict[str, str], bucket: list[str], of: DataFrame | None = None) -> DataFrame:
    """Adds z-scores within the bucket; 0 for one row or no spread. Aggregates joined back, so a hot bucket splits; they are stored, so every
    reading of the result has the same digits and small ones are sent to the rows. `of`: the rows the statistics come from."""
    aggs = []
    for source, out in columns.items():
        aggs += [F.avg(source).alias(f"_m_{out}"), F.stddev_pop(source).alias(f"_s_{out}")]
    joined = df.join(stored((df if of is None else of).groupBy(*bucket).agg(*aggs)), bucket)
    cols = {
        out: F.when(F.col(f"_s_{out}") > 1e-12, (F.col(source) - F.col(f"_m_{out}")) / F.col(f"_s_{out}")).otherwise(0.0)
        for source, out in columns.items()
    }
    return joined.withColumns(cols).select(*df.columns, *cols)


def pct_rank(df: DataFrame, source: str, out: str, bucket: list[str], of: DataFrame | None = None) -> DataFrame:
    """(average 0-based position of equal values) / (rows - 1) within the bucket. `of`: the rows whose `heads` df holds; only the heads are
    ordered, the rows below them are counted."""
    ranks = quantiles.value_ranks(df, bucket, source).withColumn("_whole", F.col("size"))
    if of is not None:
        whole = stored(of.filter(F.col(source).isNotNull()).groupBy(*bucket).agg(F.count(F.lit(1)).alias("_whole")))
        ranks = ranks.drop("_whole").join(whole, bucket)
    share = ((F.col("first") + F.col("last")) / 2 + F.col("_whole") - F.col("size")) / F.greatest(F.col("_whole") - 1, F.lit(1))
    return df.join(ranks.select(*bucket, source, share.alias(out)), [*bucket, source])


def blend(df: DataFrame, bucket: list[str], weights: dict[str, float] = BLEND, out: str = "blended_score") -> DataFrame:
    """Weighted sum of the z-scores of several columns within the bucket."""
    scored = zscore(df, {c: f"_z_{c}" for c in weights}, bucket)
    total = sum((F.col(f"_z_{c}") * w for c, w in weights.items()), F.lit(0.0))
    return scored.withColumn(out, total).select(*df.columns, out)


def pool(df: DataFrame, score_edge: bool = True, symbol: bool = True) -> DataFrame:
    """Candidates open for re-selection: pre-filter rows over the threshold with either filter on or off; in a
    table without pre-filter rows the raw signals; without those the selected rows."""
    pre = F.coalesce(F.col("candidate_serialization_stage") == PRE_FILTER_STAGE, F.lit(False))
    has_pre, has_raw = df.agg(F.max(pre), F.max(F.col("raw_signal") == 1)).first()  # two flags, so that a plain filter reaches the scan
    inside = F.col("selected_by_threshold") == 1
    if score_edge:
        inside = inside & (F.col("selected_by_score_edge") == 1)
    if symbol:
        inside = inside & (F.col("selected_by_symbol_filter") == 1)
    if has_pre:
        return df.filter(inside)
    return df.filter(F.col("raw_signal") == 1 if has_raw else (F.col("predicted") == 1) | (F.col("selected_by_topk") == 1))


def baseline(df: DataFrame, first: str, second: str) -> DataFrame:
    """Rows with the first flag if any row has it, else rows with the second."""
    has_first = not df.filter(F.col(first) == 1).isEmpty()
    return df.filter(F.col(first if has_first else second) == 1)


def baseline_selected(df: DataFrame) -> DataFrame:
    return baseline(df, "selected_by_topk", "predicted")


def baseline_executed(df: DataFrame) -> DataFrame:
    return baseline(df, "predicted", "selected_by_topk")


def best_per_day(df: DataFrame) -> DataFrame:
    """One row per (day, symbol): the best trade score, the earlier row on ties."""
    place = F.row_number().over(Window.partitionBy("trade_day", "symbol").orderBy(F.desc("trade_score"), "open_time", "row_id"))
    return df.withColumn("_place", place).filter(F.col("_place") == 1).drop("_place")


def share_cap(df: DataFrame, cap: float) -> DataFrame:
    """At most max(1, floor(rows * cap)) rows per symbol, in time order."""
    limit = df.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * cap)).alias("_limit"))
    ranked = prefix.ordered(df, ["symbol"], ["open_time", "row_id"], rank="_place")
    return ranked.crossJoin(F.broadcast(limit)).filter(F.col("_place") <= F.col("_limit")).drop("_place", "_limit")  # one row


def score_scale(df: DataFrame, score: str) -> DataFrame:
    """One row: the largest of spread, scaled quartile range, a quarter of the median, and 1e-6."""
    qs = quantiles.exact(df, [], score, {"q1": 0.25, "med": 0.5, "q3": 0.75})
    sd = df.agg(F.stddev_pop(score).alias("sd"))
    scale = F.greatest(
        F.coalesce("sd", F.lit(0.0)), (F.col("q3") - F.col("q1")) / 1.349, F.abs("med") * 0.25, F.lit(1e-6)
    )
    return qs.crossJoin(F.broadcast(sd)).select(scale.alias("scale"))


def score_spread(df: DataFrame, score: str) -> float:
    """`score_scale` as one number, 0 without rows."""
    spread = score_scale(df, score).first()
    return spread["scale"] if spread else 0.0


def _most_over(cap: float, warmup: int) -> int | None:
    """How many symbols can be over the cap at once: each has more than cap * (total + 1) - 1 of the picks."""
    least = cap * (warmup + 1) - 1
    return int(warmup / least) if least > 0 else None


def _contenders(df: DataFrame, k: int, bucket: str, score: str, order: list[Column], per_symbol: int, cap: float, warmup: int, reach: Column, lifts: bool = False) -> DataFrame:
    """Rows that can be picked whatever came before: a penalty takes at most `reach` from a score, and a cap passes over a known number of
    symbols, so a row that lies further below the best row of the last symbol needed is out."""
    over = _most_over(cap, warmup) if cap else 0
    if over is None:
        return df
    last = bars(df, k + over, [bucket], score)
    few = F.col("_have") < k + over
    some = df.join(last, bucket).filter(few | (F.col(score) >= F.col("_last") - reach * SLACK)).drop("_last")
    if per_symbol and not cap:
        mine = F.row_number().over(Window.partitionBy(bucket, "symbol").orderBy(*order))
        some = some.withColumn("_mine", mine).filter(F.col("_mine") <= per_symbol).drop("_mine")
    some = stored(some)
    # A symbol's share of the picks is at most its share of the chances: buckets before in which it is a contender. Frequent contenders are
    # few, so the penalty that is possible shrinks, and with it the contenders.
    most = per_symbol or k
    least = F.greatest(F.lit(0), F.least(F.lit(k), F.col("_have") - over))  # picks of a bucket
    each = last.select(F.col(bucket).alias("_time"), least.cast("bigint").alias("_least"))
    picked = prefix.ordered(each, [], ["_time"], sums={"_upto": F.col("_least")})
    picked = stored(picked.select(F.col("_time").alias(bucket), (F.col("_upto") - F.col("_least")).alias("_picked"), "_least"))
    for _ in range(TIGHTEN):
        mine = some.groupBy(bucket, "symbol").agg(F.max(score).alias("_top"), F.least(F.lit(most), F.count(F.lit(1))).alias("_can"))
        run = Window.partitionBy("symbol").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)  # one row a symbol and bucket
        mine = mine.withColumn("_chances", F.coalesce(F.sum("_can").over(run), F.lit(0))).join(picked, bucket)
        share = F.when(F.col("_chances") == 0, 0.0).when(F.col("_picked") == 0, 1.0).otherwise(F.least(F.lit(1.0), F.col("_chances") / F.col("_picked")))
        # The scale of a penalty may be negative: then a share lifts a score, so both bounds are moved.
        loss = share * reach * SLACK
        up = F.when(F.lit(lifts), loss).otherwise(0.0)
        mine = stored(mine.select(bucket, "symbol", (F.col("_top") - loss).alias("_low"), up.alias("_up"), (F.col("_top") + up).alias("_high")))
        bar = bars(mine, k + over, [bucket], "_low").select(bucket, F.when(~few, F.col("_last")).alias("_bar"))
        open_ = mine.join(bar, bucket).filter(F.col("_bar").isNull() | (F.col("_high") >= F.col("_bar")))
        kept = some.join(stored(open_.select(bucket, "symbol", "_up", "_bar")), [bucket, "symbol"])
        some = stored(kept.filter(F.col("_bar").isNull() | (F.col(score) + F.col("_up") >= F.col("_bar"))).drop("_up", "_bar"))
    return some.drop("_have")


def _replay(columns: list[str], k: int, per_symbol: int, penalty: float, cap: float, warmup: int):
    """Selection over one block of ordered buckets, from the picks before it: what a task does."""
    ties = [3 + i for i, c in enumerate(columns) if c in SCORE_ORDER]

    def run(key: tuple, rows: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        picks = dict(zip(before["symbol"].tolist(), before["picks"].tolist()))
        total, out = sum(picks.values()), []
        rows = rows.sort_values("_bucket", kind="stable")
        for at, group in itertools.groupby(zip(*(rows[c].tolist() for c in ["_bucket", "symbol", "row_id", *columns])), key=lambda r: r[0]):
            ranked = []
            for row in group:
                share = picks.get(row[1], 0) / total if total else 0.0
                value = row[3] - penalty * share
                ranked.append((-value, *(-row[i] for i in ties), row[1], row[2], share, row))
            mine: dict = {}
            done = 0
            for row in sorted(ranked, key=lambda r: r[:-2]):
                symbol = row[-1][1]
                if per_symbol and mine.get(symbol, 0) >= per_symbol:
                    continue
                if cap and total >= warmup and (picks.get(symbol, 0) + 1) / (total + 1) > cap:
                    continue
                picks[symbol] = picks.get(symbol, 0) + 1
                mine[symbol] = mine.get(symbol, 0) + 1
                total, done = total + 1, done + 1
                out.append((key[0], at, symbol, row[-1][2], *row[-1][3:], done, -row[0], row[-2]))
                if done >= k:
                    break
        return pd.DataFrame(out, columns=["_block", "_bucket", "symbol", "row_id", *columns, "rank_in_bucket", "penalised_score", "earlier_share"])

    return run


def exposure_penalty(
    df: DataFrame, score: str, strength: float, k: int, bucket: str = "open_time", per_symbol: int = 1, scale_score: str = "trade_score", cap: float = 0.0, warmup: int = 50,
    rounds: list[int] | None = None, block_rows: int = BLOCK_ROWS, scale: float | None = None,
) -> DataFrame:
    """Top k of each bucket in time order after subtracting strength * scale * (the symbol's share of all picks so far); with a `cap`, a symbol
    whose share would rise above it is passed over once there are `warmup` picks. The scale is the spread of `scale_score`, if it is not given.

    Each bucket depends on the picks of all before it. Ordered buckets are dealt over blocks, and every block is replayed at once from assumed
    picks before it; the picks found give the next assumption, and only blocks whose assumption changed are replayed again. Block n is
    exact after n rounds at most, so the fixed point is the answer of the sequential rule; in practice a few rounds do (`rounds` takes the
    number of blocks replayed in each). Only contenders are replayed: without a cap at most `per_symbol` rows a symbol and bucket, and rows too
    far below the best never. One bucket's contenders come to one task: one row a symbol, if a symbol has one bar a minute.
    Among rows equal in bucket, symbol, row_id and scores one stands for all; rows without a score or bucket are never picked.
    """
    spark = df.sparkSession
    columns = list(dict.fromkeys([score, *(c for c in SCORE_ORDER if c in df.columns)]))
    narrow = df.select(F.col(bucket).alias("_bucket"), "symbol", "row_id", *columns).filter(F.col("_bucket").isNotNull() & F.col(score).isNotNull()).fillna(float("-inf"), columns)
    penalty = strength * (score_spread(df, scale_score) if scale is None else scale)
    order = [F.desc(c) for c in columns] + [F.col("symbol"), F.col("row_id")]
    some = _contenders(narrow, k, "_bucket", score, order, per_symbol, cap, warmup, F.lit(abs(penalty)), penalty < 0)
    # Blocks of a bounded number of rows: each round replays a task's worth in a block, and few blocks need few rounds.
    n = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-some.count() // block_rows)))
    blocks = stored(some.repartitionByRange(n, "_bucket").withColumn("_block", F.spark_partition_id()))

    replay = _replay(columns, k, per_symbol, penalty, cap, warmup)
    fields = {f.name: f.dataType.simpleString() for f in blocks.schema.fields}
    names = ["_block", "_bucket", "symbol", "row_id", *columns]
    kind = ", ".join(f"`{c}` {fields[c]}" for c in names) + ", rank_in_bucket int, penalised_score double, earlier_share double"
    last: dict[int, int] = {}  # block -> round of its last replay: at most one entry a partition
    todo = sorted(r._block for r in blocks.select("_block").distinct().collect())
    assumed = stored(spark.createDataFrame([], "_block int, symbol string, picks bigint"))
    found: list[DataFrame] = []
    while todo:
        if rounds is not None:
            rounds.append(len(todo))
        # An empty row for each block keeps a block without earlier picks in the cogroup.
        state = assumed.filter(F.col("_block").isin(todo))
        fresh = blocks.filter(F.col("_block").isin(todo)).groupBy("_block").cogroup(state.groupBy("_block")).applyInPandas(replay, kind)
        found.append(stored(fresh))
        last |= dict.fromkeys(todo, len(found) - 1)
        picks = _last_replays(found, last)
        counted = picks.groupBy("_block", "symbol").agg(F.count(F.lit(1)).alias("picks"))
        sums = Window.partitionBy("symbol").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        # One row a symbol and block: the symbol's picks up to the block before.
        grid = counted.select("symbol").distinct().withColumn("_block", F.explode(F.array(*[F.lit(b) for b in sorted(last)])))
        before = grid.join(counted, ["_block", "symbol"], "left").withColumn("picks", F.coalesce("picks", F.lit(0)))
        before = stored(before.withColumn("picks", F.coalesce(F.sum("picks").over(sums), F.lit(0))).filter("picks > 0"))
        old = assumed.withColumnRenamed("picks", "_old")
        changed = before.join(old, ["_block", "symbol"], "full").filter(~F.col("picks").eqNullSafe(F.col("_old"))).select("_block").distinct()
        todo, assumed = sorted(r._block for r in changed.collect()), before
    if not found:
        return df.limit(0).withColumns({"rank_in_bucket": F.lit(0), "penalised_score": F.lit(0.0), "earlier_share": F.lit(0.0)})
    picks = _last_replays(found, last).drop("_block").withColumnRenamed("_bucket", bucket)
    keys = [bucket, "symbol", "row_id"]
    chosen = picks.select(*keys, F.col(score).alias("_score"), "rank_in_bucket", "penalised_score", "earlier_share")
    joined = df.join(chosen, keys).filter(F.col(score).eqNullSafe(F.col("_score"))).drop("_score")
    one = F.row_number().over(Window.partitionBy(bucket, "rank_in_bucket").orderBy(*[F.col(f"`{c}`") for c in columns]))
    return joined.withColumn("_one", one).filter("_one = 1").drop("_one")


def _last_replays(found: list[DataFrame], last: dict[int, int]) -> DataFrame:
    """The picks of each block from the round that replayed it last."""
    parts = [part.filter(F.col("_block").isin([b for b, r in last.items() if r == i])) for i, part in enumerate(found) if i in last.values()]
    return reduce(DataFrame.unionByName, parts)


def fill_sizes(df: DataFrame, rows: DataFrame, capital: float = 10_000.0) -> DataFrame:
    """`rows` with a missing size set to the median selected size of the source and fold, else of the source,
    else a tenth of the capital; `size_filled` tells which."""
    selected = df.filter((F.col("selected_by_topk") == 1) & (F.col("position_size") > 0))
    by_fold = quantiles.exact(selected, ["source", "fold_id"], "position_size", {"_fold_median": 0.5}).drop("rows")
    by_source = quantiles.exact(selected, ["source"], "position_size", {"_source_median": 0.5}).drop("rows")
    # Stored, so that Spark sees how small they are and leaves the rows where they lie.
    joined = rows.join(stored(by_fold), ["source", "fold_id"], "left").join(stored(by_source), "source", "left")
    missing = F.coalesce(F.col("position_size") <= 0, F.lit(True))
    filled = F.coalesce("_fold_median", "_source_median", F.lit(capital * 0.1))
    return (
        joined.withColumn("size_filled", missing.cast("int"))
        .withColumn("position_size", F.when(missing, filled).otherwise(F.col("position_size")))
        .drop("_fold_median", "_source_median")
    )


def annotate(df: DataFrame, score: str, buckets: dict[str, str]) -> DataFrame:
    """Rank and candidate count per bucket kind, and the first stage that rejected the row."""
    out = prefix.ranks(df, score_order(df, score), buckets, "rank_within_{}_bucket", "candidate_count_within_{}_bucket")
    stage = (
        F.when(F.col("selected_by_threshold") != 1, "threshold")
        .when(F.col("selected_by_score_edge") != 1, "score_edge")
        .when(F.col("selected_by_symbol_filter") != 1, "symbol_filter")
        .when(F.col("selected_by_topk") != 1, "ranking")
        .when(F.col("executed") != 1, "execution")
        .otherwise("")
    )
    reason = F.when(stage == "ranking", F.concat(F.lit("rank_above_top_k_"), F.col("configured_top_k"))).otherwise(
        F.when(stage == "", "").otherwise(F.concat(F.lit("rejected_by_"), stage))
    )
    return out.withColumn("rejection_stage", stage).withColumn("rejection_reason", reason)


def position_size(capital: float = 10_000.0, fraction: float = 0.1, volume_fraction: float = 0.01) -> Column:
    return F.least(F.lit(capital * fraction), F.col("quote_volume") * volume_fraction)
