"""Outcomes of the next bars: returns, excursions, target/stop labels, utilities and grades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import floor_div, minute, safe_ratio
from . import quantiles
from .features import series

FUTURE_HIGH, TARGET_STOP = "future_high", "target_stop"


def ahead(c: str, j: int) -> Column:
    return F.lead(c, j).over(series())


def first_hit(conditions: list[Column]) -> Column:
    """1-based index of the first condition that holds; null when none does."""
    return F.coalesce(*[F.when(cond, F.lit(j)) for j, cond in enumerate(conditions, 1)])


def first_decline_return(c: str, target_price: Column, hit: Column, window: int) -> Column:
    """Hold from the target bar on while closes do not fall; leave at the close before the first lower one.

    The level held before bar j is max(target, close of bar j-1), so no state has to be carried.
    """
    held = {j: F.greatest(target_price, F.col(f"_close_{j}")) for j in range(1, window + 1)}
    exits = [
        F.when((hit < j) & (F.col(f"_close_{j}") < held[j - 1]), held[j - 1]) for j in range(2, window + 1)
    ]
    return safe_ratio(F.coalesce(*exits, held[window]), F.col(c)) - 1


def outcomes(
    df: DataFrame,
    window: int = 5,
    mode: str = TARGET_STOP,
    target: float = 0.05,
    stop: float = 0.02,
    tie: str = "stop_first",
    exit_mode: str = "fixed_target",
    growth: float = 0.05,
) -> DataFrame:
    """Adds label, forward_return, trade_return and the excursions. Rows without a full window have null
    outcomes; with tie='skip' rows whose deciding bar touches both prices are dropped."""
    steps = range(1, window + 1)
    rows = df.withColumns(
        {f"_{c}_{j}": ahead(c, j) for c in ("high", "low", "close") for j in steps}
    )
    close = F.col("close")
    full = F.col(f"_close_{window}").isNotNull()
    forward = safe_ratio(F.col(f"_close_{window}"), close) - 1
    top = F.greatest(*[F.col(f"_high_{j}") for j in steps]) if window > 1 else F.col("_high_1")
    bottom = F.least(*[F.col(f"_low_{j}") for j in steps]) if window > 1 else F.col("_low_1")
    best = safe_ratio(top, close) - 1
    rows = rows.withColumns(
        {
            "forward_return": F.when(full, forward),
            "max_future_high_return": F.when(full, best),
            "max_future_low_return": F.when(full, safe_ratio(bottom, close) - 1),
        }
    )
    if mode == FUTURE_HIGH:
        hit = F.col("max_future_high_return") >= growth
        rows = rows.withColumns(
            {
                "label": F.when(full, F.when(hit, 1).otherwise(0)),
                "trade_return": F.when(full, F.when(hit, F.lit(growth)).otherwise(F.col("forward_return"))),
            }
        )
    elif mode == TARGET_STOP:
        target_price, stop_price = close * (1 + target), close * (1 - stop)
        rows = rows.withColumns(
            {
                "_hit": first_hit([F.col(f"_high_{j}") >= target_price for j in steps]),
                "_stop": first_hit([F.col(f"_low_{j}") <= stop_price for j in steps]),
            }
        )
        never = F.lit(window + 1)
        hit, out = F.coalesce("_hit", never), F.coalesce("_stop", never)
        touched = F.col("_hit").isNotNull()
        tied = touched & (hit == out)
        won = touched & ((hit < out) | (tied if tie == "target_first" else F.lit(False)))
        gain = F.lit(target) if exit_mode == "fixed_target" else first_decline_return("close", target_price, F.col("_hit"), window)
        lost = F.col("_stop").isNotNull() & ~won
        rows = rows.withColumns(
            {
                "label": F.when(full, F.when(won, 1).otherwise(0)),
                "trade_return": F.when(full, F.when(won, gain).when(lost, -stop).otherwise(F.col("forward_return"))),
                "_tied": tied,
            }
        )
        if tie == "skip":
            rows = rows.filter(~F.coalesce("_tied", F.lit(False)))
    else:
        raise ValueError(f"unknown label mode {mode}")
    return rows.select(
        *df.columns, "label", "forward_return", "trade_return", "max_future_high_return", "max_future_low_return"
    )


# Not pinned by the reference: bounds of the clipped target and the epsilon of the scaled one.
CLIP = 0.10
SCALE_EPS = 1e-6


def regression_target(mode: str, cost: float = 0.0015, bound: float = CLIP) -> Column:
    r = F.col("trade_return")
    if mode == "gross":
        return r
    if mode == "net":
        return r - cost
    if mode == "clipped":
        return F.greatest(F.lit(-bound), F.least(F.lit(bound), r))
    if mode == "risk_adjusted":
        return r / (F.col("rolling_volatility_60m") + SCALE_EPS)
    raise ValueError(f"unknown target mode {mode}")


def invert_risk_adjusted(c: str) -> Column:
    return F.col(c) * (F.col("rolling_volatility_60m") + SCALE_EPS)


def net_utility(
    fee: float = 0.001, slippage: float = 0.0005, latency: float = 0.0, margin: float = 0.0, adverse: float = 0.0
) -> Column:
    """Trade return after all costs and the required margin, less a penalty on the adverse excursion."""
    drop = F.greatest(F.lit(0.0), -F.col("max_future_low_return"))
    return F.col("trade_return") - fee - slippage - latency - margin - adverse * drop


def grade_cuts(train: DataFrame, utility: str, q1: float, q2: float, q3: float) -> DataFrame:
    """One row: linear quantiles of the positive training utilities."""
    return quantiles.exact(train.filter(F.col(utility) > 0), [], utility, {"weak": q1, "useful": q2, "strong": q3})


def relevance(df: DataFrame, cuts: DataFrame, utility: str, mode: str = "utility_tail") -> DataFrame:
    """Grades 0 to 4. In 'utility_tail' the weak cut starts grade 1 and grade 2 is left out; in
    'train_quantiles' every positive utility has at least grade 1."""
    u = F.col(utility)
    joined = df.crossJoin(F.broadcast(cuts.select("weak", "useful", "strong")))  # one row
    strong = F.when(u >= F.col("strong"), 4).when(u >= F.col("useful"), 3)
    if mode == "utility_tail":
        grade = strong.when(u >= F.col("weak"), 1).otherwise(0)
    else:
        grade = strong.when(u >= F.col("weak"), 2).when(u > 0, 1).otherwise(0)
    grade = F.when(u > 0, grade).otherwise(0)
    return joined.withColumn("grade", grade).drop("weak", "useful", "strong")


def decision_groups(df: DataFrame, minutes: int, min_size: int) -> DataFrame:
    """Rows with the number of their time bucket, without the buckets below `min_size` rows."""
    tagged = df.withColumn("decision_group", floor_div(minute("open_time"), minutes))
    sizes = tagged.groupBy("decision_group").agg(F.count(F.lit(1)).alias("group_rows"))
    return tagged.join(sizes.filter(F.col("group_rows") >= min_size), "decision_group")
