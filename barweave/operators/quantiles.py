"""Exact quantiles without collecting a group: count per value, ordered prefix of the counts, pick the ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import prefix


def value_ranks(df: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """One row per (key, value) with the 0-based rank range [first, last] its rows take, and the key's count.

    `weight` lets a row stand for that many equal rows (0 leaves it out).
    """
    size = F.sum(weight) if weight else F.count(F.lit(1))
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(size.alias("rows"))
    if weight:
        counted = counted.filter(F.col("rows") > 0)
    return (
        prefix.ordered(
            counted, keys, [F.col(value)], sums={"upto": F.col("rows")}, key_sums={"size": F.col("rows")}
        )
        .withColumn("first", F.col("upto") - F.col("rows"))
        .withColumn("last", F.col("upto") - 1)
        .drop("upto")
    )


def exact(
    df: DataFrame, keys: list[str], value: str, qs: dict[str, float], how: str = "linear", weight: str | None = None
) -> DataFrame:
    """Quantiles per key: 'linear' interpolates between the two ranks, 'lower' takes the lower one."""
    ranks = value_ranks(df, keys, value, weight)

    def at(position):
        inside = (F.col("first") <= position) & (position <= F.col("last"))
        return F.max(F.when(inside, F.col(value)))

    aggs = []
    for name, q in qs.items():
        pos = (F.col("size") - 1) * F.lit(float(q))
        aggs.append(at(F.floor(pos)).alias(f"_lo_{name}"))
        aggs.append(at(F.ceil(pos)).alias(f"_hi_{name}"))
    picked = ranks.groupBy(*keys, "size").agg(*aggs)
    out = []
    for name, q in qs.items():
        pos = (F.col("size") - 1) * F.lit(float(q))
        w = pos - F.floor(pos)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo * (1 - w) + hi * w if how == "linear" else lo).alias(name))
    return picked.select(*keys, F.col("size").alias("rows"), *out)
