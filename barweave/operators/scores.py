"""Candidate scores as column math, with payoffs fitted on validation rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import as_col, safe_ratio
from . import quantiles

COST = 0.0015


def ev_fixed(p, target: float, stop: float, cost: float = COST) -> Column:
    p = as_col(p)
    return p * target - (1 - p) * stop - cost


def payoffs(validation: DataFrame, target: float, stop: float, min_rows: int = 1, keys: list[str] | None = None) -> DataFrame:
    """Mean win and loss of validation labels; the fixed payoffs where either class has too few rows."""
    won, lost = F.col("label") == 1, F.col("label") == 0
    stats = validation.groupBy(*(keys or [])).agg(
        F.count_if(won).alias("wins"),
        F.count_if(lost).alias("losses"),
        F.avg(F.when(won, F.col("trade_return"))).alias("_win"),
        F.avg(F.when(lost, F.col("trade_return"))).alias("_loss"),
    )
    enough = (F.col("wins") >= min_rows) & (F.col("losses") >= min_rows)
    return stats.select(
        *(keys or []), "wins", "losses",
        F.when(enough, F.col("_win")).otherwise(F.lit(target)).alias("win_return"),
        F.when(enough, F.col("_loss")).otherwise(F.lit(-stop)).alias("loss_return"),
        F.when(enough, "empirical_validation").otherwise("fixed_fallback").alias("payoff_source"),
    )


def ev_empirical(df: DataFrame, payoff: DataFrame, p: str, cost: float = COST, keys: list[str] | None = None) -> DataFrame:
    """Adds expected_value and payoff_source from the payoffs of `payoffs` (one row, or one per fold)."""
    small = payoff.select(*(keys or []), "win_return", "loss_return", "payoff_source")
    joined = df.join(small, keys) if keys else df.crossJoin(F.broadcast(small))  # one row without keys
    value = F.col(p) * F.col("win_return") + (1 - F.col(p)) * F.col("loss_return") - cost
    return joined.withColumn("expected_value", value).drop("win_return", "loss_return")


def ev_predicted(predicted_return, cost: float = COST) -> Column:
    return as_col(predicted_return) - cost


def hybrid(mode: str, p, predicted_return, cost: float = COST, min_p: float = 0.0, win=None, loss=None) -> Column:
    """'probability_times_return' p*r - cost; 'expected_return' r - cost; 'conditional_payoff' p*win + (1-p)*loss - cost with the
    win and loss returns of `payoffs`; below the probability gate -inf."""
    p, ret = as_col(p), as_col(predicted_return)
    if mode == "probability_times_return":
        value = p * ret - cost
    elif mode == "expected_return":
        value = ret - cost
    elif mode == "conditional_payoff":
        if win is None or loss is None:
            raise ValueError("conditional_payoff needs the win and loss returns")
        value = p * as_col(win) + (1 - p) * as_col(loss) - cost
    else:
        raise ValueError(f"unknown hybrid mode {mode}")
    return F.when(p >= min_p, value).otherwise(F.lit(float("-inf")))


def risk_adjust(score, uncertainty, penalty: float) -> Column:
    return as_col(score) - penalty * as_col(uncertainty)


def risk_adjust_relative(score, uncertainty, penalty: float, reference_scale, global_std) -> Column:
    """The uncertainty is first scaled by the typical return over the global spread."""
    scale = safe_ratio(as_col(reference_scale), as_col(global_std))
    return as_col(score) - penalty * as_col(uncertainty) * scale


def dynamic_floor(
    df: DataFrame,
    leader_return: str,
    volatility: str,
    bullish: float = 0.01,
    bearish: float = -0.01,
    floors: tuple[float, float, float] = (0.001, 0.0015, 0.0025),
    high_volatility: float = 0.02,
    volatility_floors: tuple[float, float] = (0.0025, 0.001),
    fallback: float = 0.001,
) -> DataFrame:
    """Adds score_floor and regime. Without the two columns the fallback holds for every row."""
    if leader_return not in df.columns or volatility not in df.columns:
        return df.withColumn("score_floor", F.lit(fallback)).withColumn("regime", F.lit("none"))
    up, flat, down = floors
    high, normal = volatility_floors
    lead, vol = F.col(leader_return), F.col(volatility)
    direction = F.when(lead >= bullish, "bullish").when(lead <= bearish, "bearish").otherwise("neutral")
    floor = F.when(lead >= bullish, up).when(lead <= bearish, down).otherwise(flat)
    vol_floor = F.when(vol >= high_volatility, high).otherwise(normal)
    name = F.concat(direction, F.when(vol >= high_volatility, "_high_volatility").otherwise("_normal_volatility"))
    return df.withColumn("score_floor", F.greatest(floor, vol_floor)).withColumn("regime", name)


def upper_cap(df: DataFrame, score: str, q: float) -> DataFrame:
    """Adds upper_cap (the exact q-quantile) and capped (score above it)."""
    cap = quantiles.exact(df, [], score, {"upper_cap": q}).select("upper_cap")
    joined = df.crossJoin(F.broadcast(cap))  # one row
    return joined.withColumn("capped", F.col(score) > F.col("upper_cap"))


def win_loss_gap(df: DataFrame, keys: list[str], score: str, net: Column) -> DataFrame:
    """Mean score of winners less the mean score of the others; a side without rows counts 0."""
    won = F.coalesce(F.avg(F.when(net > 0, F.col(score))), F.lit(0.0))
    other = F.coalesce(F.avg(F.when(net <= 0, F.col(score))), F.lit(0.0))
    return df.groupBy(*keys).agg(won.alias("winner_score"), other.alias("loser_score"), (won - other).alias("score_gap"))
