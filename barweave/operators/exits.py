"""Exits along the ordered path of returns that follows a decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import as_col
from .features import series

EPS = 1e-12  # lets a pullback of exactly the drawdown count


def path(bars: DataFrame, horizon: int) -> DataFrame:
    """Adds the returns of the next `horizon` closes over this close; null where the series ends before.

    Expects one row per (symbol, open_time), see `bars.distinct_bars`, which rejects conflicting copies.
    """
    following = F.collect_list("close").over(series().rowsBetween(1, horizon))
    rows = bars.withColumn("_next", following)
    returns = F.transform("_next", lambda x: x / F.col("close") - 1)
    return rows.withColumn("future_returns", F.when(F.size("_next") == horizon, returns)).drop("_next")


def require_path(c: str = "future_returns") -> Column:
    """The path itself; a row without one stops the job."""
    missing = F.raise_error(F.lit("trailing exits need an ordered future candle path")).cast("array<double>")
    return F.coalesce(as_col(c), missing)


def trailing(path_col, activation: float, drawdown: float, stop: float) -> Column:
    """struct(exit_bar, exit_return, exit_reason, best_return). Within a bar the stop is looked at first."""
    start = F.struct(
        F.lit(float("-inf")).alias("best"),
        F.lit(0).alias("bar"),
        F.lit(0.0).alias("at"),
        F.lit("").alias("reason"),
    )

    def step(state, r):
        best = F.greatest(state["best"], r)
        stopped = r <= -stop
        pulled = (best >= activation) & (best - r >= drawdown - EPS)
        reason = F.when(stopped, "stop_loss").when(pulled, "trailing_stop").otherwise("")
        moved = F.struct(best.alias("best"), (state["bar"] + 1).alias("bar"), r.alias("at"), reason.alias("reason"))
        return F.when(state["reason"] != "", state).otherwise(moved)

    def finish(state):
        reason = F.when(state["reason"] == "", "max_holding_time").otherwise(state["reason"])
        return F.struct(
            state["bar"].alias("exit_bar"),
            state["at"].alias("exit_return"),
            reason.alias("exit_reason"),
            state["best"].alias("best_return"),
        )

    return F.aggregate(as_col(path_col), start, step, finish)


def fixed(horizon: int) -> Column:
    """The fixed-horizon exit keeps the trade return."""
    r = F.col("trade_return")
    return F.struct(
        F.lit(horizon).alias("exit_bar"), r.alias("exit_return"), F.lit("fixed_horizon").alias("exit_reason"),
        F.greatest(r, F.lit(0.0)).alias("best_return"),
    )


def summary(df: DataFrame, exit_col: str, fixed_col: str) -> DataFrame:
    """Per reason and over all ('all'): trades, mean exit bar, mean dynamic and fixed return, their gap."""
    rows = df.select(
        F.explode(F.array(F.col(f"{exit_col}.exit_reason"), F.lit("all"))).alias("exit_reason"),
        F.col(f"{exit_col}.exit_bar").alias("bar"),
        F.col(f"{exit_col}.exit_return").alias("dynamic"),
        F.col(fixed_col).alias("fixed"),
    )
    return rows.groupBy("exit_reason").agg(
        F.count(F.lit(1)).alias("trades"),
        F.avg("bar").alias("average_exit_bar"),
        F.avg("dynamic").alias("average_dynamic_return"),
        F.avg("fixed").alias("average_fixed_return"),
        F.avg(F.col("dynamic") - F.col("fixed")).alias("dynamic_minus_fixed"),
    )
