"""Classification counts, AUC, returns after costs, drawdown and portfolio rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.scalars import as_col, num, safe_ratio
from . import prefix, quantiles

CAPITAL = 10_000.0
COST = 0.0015  # fee and slippage of a round trip


def classify(df: DataFrame, keys: list[str], predicted: Column, label: str = "label") -> DataFrame:
    """Confusion counts and rates per key; a rate without rows is 0."""
    pos = F.col(label) == 1
    counts = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(predicted & pos).alias("tp"),
        F.count_if(predicted & ~pos).alias("fp"),
        F.count_if(~predicted & ~pos).alias("tn"),
        F.count_if(~predicted & pos).alias("fn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns(
        {
            "accuracy": safe_ratio(tp + F.col("tn"), F.col("rows")),
            "precision": safe_ratio(tp, tp + fp),
            "recall": safe_ratio(tp, tp + fn),
            "f1": safe_ratio(2 * tp, 2 * tp + fp + fn),
        }
    )


def auc(df: DataFrame, score: str, label: str = "label", keys: list[str] | None = None) -> DataFrame:
    """Rank-sum AUC; among equal scores positives rank above negatives. 0 when a class is missing.

    Rows are counted per (score, label) before the ordered prefix.
    """
    keys = keys or []
    counted = df.filter(F.col(score).isNotNull()).groupBy(*keys, score, label).agg(F.count(F.lit(1)).cast("double").alias("_c"))
    run = prefix.ordered(counted, keys, [F.col(score), F.col(label)], sums={"_end": F.col("_c")})
    pos = F.col(label) == 1
    rank_sum = F.col("_c") * (2 * F.col("_end") - F.col("_c") + 1) / 2
    sums = run.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(pos, rank_sum)), F.lit(0.0)).alias("_rs"),
        F.coalesce(F.sum(F.when(pos, F.col("_c"))), F.lit(0.0)).alias("p"),
        F.coalesce(F.sum(F.when(~pos, F.col("_c"))), F.lit(0.0)).alias("n"),
    )
    p, n = F.col("p"), F.col("n")
    value = F.when((p == 0) | (n == 0), 0.0).otherwise((F.col("_rs") - p * (p + 1) / 2) / (p * n))
    return sums.select(*keys, p.cast("bigint").alias("positives"), n.cast("bigint").alias("negatives"), value.alias("auc"))


def _number(df: DataFrame, name: str) -> Column:
    """The column as a finite double, 0 otherwise; text is parsed, numbers are taken as they are."""
    if isinstance(df.schema[name].dataType, StringType):
        return num(name)
    v = F.col(name).cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v)


def gross_return(df: DataFrame) -> Column:
    """The dynamic exit return if present, else the trade return, else the forward return."""
    rest = _number(df, "trade_return" if "trade_return" in df.columns else "forward_return")
    if "dynamic_trade_return" not in df.columns:
        return rest
    given = F.nullif(F.trim(F.col("dynamic_trade_return").cast("string")), F.lit("")).isNotNull()
    return F.when(given, _number(df, "dynamic_trade_return")).otherwise(rest)


def with_returns(df: DataFrame, cost: float = COST, extra: float = 0.0, capital: float = CAPITAL) -> DataFrame:
    """Adds gross, net and profit; a missing size counts as a tenth of the capital."""
    gross = gross_return(df)
    size = F.coalesce(F.col("position_size").cast("double"), F.lit(capital * 0.1))
    return df.withColumn("gross", gross).withColumn("net", F.col("gross") - cost - extra).withColumn("profit", size * F.col("net"))


def factor(gains: Column, losses: Column) -> Column:
    """Gains over losses; without losses infinite if there are gains, else 0."""
    return F.when(losses == 0, F.when(gains > 0, F.lit(float("inf"))).otherwise(0.0)).otherwise(gains / losses)


def gains(c="profit") -> Column:
    return F.coalesce(F.sum(F.when(as_col(c) > 0, as_col(c))), F.lit(0.0))


def losses(c="profit") -> Column:
    return F.coalesce(-F.sum(F.when(as_col(c) < 0, as_col(c))), F.lit(0.0))


def profit_factor(c="profit") -> Column:
    return factor(gains(c), losses(c))


def equity_curve(df: DataFrame, keys: list[str], order: list, profit: str = "profit", start: float = CAPITAL) -> DataFrame:
    """Adds equity after each row and the peak so far (at least the start)."""
    run = prefix.ordered(df, keys, order, sums={"_gain": F.col(profit)}, highs={"_high": "_gain"})
    peak = F.greatest(F.col("_high") + start, F.lit(float(start)))
    return run.withColumn("equity", F.col("_gain") + start).withColumn("peak", peak).drop("_gain", "_high")


def drawdown(df: DataFrame, keys: list[str], order: list, profit: str = "profit", start: float = CAPITAL) -> DataFrame:
    """Per key: worst fall from the peak as a fraction of it, and in money (from an equity of 0)."""
    narrow = dict.fromkeys([*keys, *(o for o in order if isinstance(o, str)), profit])
    curve = equity_curve(df.select(*narrow) if all(isinstance(o, str) for o in order) else df, keys, order, profit, start)
    gap = F.col("peak") - F.col("equity")
    return curve.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(F.col("peak") > 0, gap / F.col("peak"))), F.lit(0.0)).alias("max_drawdown"),
        F.max(gap).alias("max_drawdown_money"),
    )


def nested_drawdowns(df: DataFrame, keys: list[str], order: list[str], level: str, count: int, profit: str = "profit", start: float = CAPITAL) -> DataFrame:
    """Per key and i from 1 to `count`: worst fall from the peak of the rows whose `level` is at least i. One pass, no row is repeated.

    Rows from `prefix.ranged` with these keys and this order are not ordered again."""
    each = range(1, count + 1)
    inside = {i: F.col(level) >= i for i in each}
    gains = {f"_g{i}": F.when(inside[i], F.col(profit)).otherwise(0.0) for i in each}
    rows = df.filter(F.col(level) > 0)
    if prefix.AT not in df.columns:
        rows = prefix.ranged(rows, keys, order, keep=list(dict.fromkeys([*keys, level, profit])))
    rows = rows.select(*dict.fromkeys([*keys, level, profit]), prefix.BUCKET, prefix.AT)
    run = prefix.scan(rows, keys, order, sums=gains, highs={f"_h{i}": f"_g{i}" for i in each})
    falls = []
    for i in each:
        peak = F.greatest(F.col(f"_h{i}") + start, F.lit(float(start)))
        gap = peak - (F.col(f"_g{i}") + start)
        falls.append(F.max(F.when(inside[i] & (peak > 0), gap / peak)).alias(f"_f{i}"))
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"_f{i}").alias("max_drawdown")) for i in each])).alias("_p")
    return run.groupBy(*keys).agg(*falls).select(*keys, pairs).select(*keys, "_p.*")


def trade_stats(df: DataFrame, keys: list[str], fee: float = 0.001, slippage: float = 0.0005) -> DataFrame:
    """Means and medians of returns, excursions and profits after fee and after fee and slippage."""
    size = F.col("position_size")
    sums = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"),
        F.avg((F.col("trade_return") > 0).cast("double")).alias("win_rate"),
        F.avg("forward_return").alias("mean_forward_return"),
        F.avg("trade_return").alias("mean_trade_return"),
        F.avg("max_future_high_return").alias("mean_favorable"),
        F.avg("max_future_low_return").alias("mean_adverse"),
        F.sum(size * (F.col("trade_return") - fee)).alias("profit_after_fee"),
        F.sum(size * (F.col("trade_return") - fee - slippage)).alias("profit_after_fee_and_slippage"),
    )
    for c in ("forward_return", "trade_return"):
        median = quantiles.exact(df, keys, c, {f"median_{c}": 0.5}).drop("rows")
        sums = sums.join(median, keys) if keys else sums.crossJoin(F.broadcast(median))
    return sums


def activity(df: DataFrame, keys: list[str]) -> DataFrame:
    """Trades per active day and per active month."""
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"),
        F.countDistinct("trade_day").alias("active_days"),
        F.countDistinct("month").alias("active_months"),
    )
    return out.withColumns(
        {
            "trades_per_active_day": safe_ratio(F.col("trades"), F.col("active_days")),
            "trades_per_active_month": safe_ratio(F.col("trades"), F.col("active_months")),
        }
    )


ORDER = ["open_time", "symbol", "row_id"]


def totals(df: DataFrame, keys: list[str], folds: int = 1, capital: float = CAPITAL) -> DataFrame:
    """The portfolio row per key but for its drawdown, the only part that needs the rows in order."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trade_count"),
        F.sum("profit").alias("portfolio_profit"),
        (F.sum("profit") / (capital * max(1, folds))).alias("portfolio_return"),
        F.avg("gross").alias("avg_gross_return"),
        F.avg("net").alias("avg_net_return"),
        F.avg((F.col("net") > 0).cast("double")).alias("win_rate"),
        profit_factor().alias("profit_factor"),
        F.countDistinct("trade_day").alias("active_days"),
        F.countDistinct("symbol").alias("active_symbols"),
    )


def portfolio(df: DataFrame, keys: list[str], folds: int = 1, capital: float = CAPITAL, order: list | None = None) -> DataFrame:
    """The portfolio row per key. Needs the columns of `with_returns`."""
    base = totals(df, keys, folds, capital)
    fall = drawdown(df, keys, order or ORDER, start=capital).drop("max_drawdown_money")
    return base.join(fall, keys) if keys else base.crossJoin(F.broadcast(fall))  # one row without keys


def costs(df: DataFrame, keys: list[str], cost: float = COST) -> DataFrame:
    """Plain and size-weighted returns before and after costs, and the cost drag in money."""
    size = F.sum("position_size")
    return df.groupBy(*keys).agg(
        F.avg("gross").alias("average_gross_return_before_costs"),
        F.avg("net").alias("average_net_return_after_costs"),
        F.avg(F.col("gross") - F.col("net")).alias("average_cost_drag_per_trade"),
        F.sum((F.col("gross") - F.col("net")) * F.col("position_size")).alias("total_cost_drag"),
        safe_ratio(F.sum(F.col("gross") * F.col("position_size")), size).alias("trade_weighted_gross_return"),
        safe_ratio(F.sum(F.col("net") * F.col("position_size")), size).alias("trade_weighted_net_return"),
        F.count_if(F.col("net") > 0).alias("winning_trades"),
        F.count_if(F.col("net") <= 0).alias("losing_trades"),
    )


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").parquet(path)


def prediction_table(df: DataFrame, score: str, threshold: float, size: Column) -> DataFrame:
    """Score, raw signal, prediction, size (0 without a signal) and returns of every row."""
    raw = F.col(score) >= threshold
    taken = raw & (size > 0)
    return df.select(
        "row_id", "symbol", "month", "open_time", "label", F.col(score).alias("probability"),
        raw.cast("int").alias("raw_signal"), taken.cast("int").alias("predicted"),
        F.when(taken, size).otherwise(0.0).alias("position_size"), "forward_return", "trade_return",
    )
