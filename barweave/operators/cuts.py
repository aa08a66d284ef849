"""Rows at given ranks of a total order, and every row's place between them, without ordering all rows.

Values are counted, and only the values that hold a wanted rank are looked into: their rows are counted by the first tie column, and the rows
of the cells that still hold a wanted rank are ordered by the rest. All other rows are only compared with the cut rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from . import prefix

ID = "_id"


def frozen(df: DataFrame) -> DataFrame:
    """The rows written once with a number, which tells rows apart that agree in all tie columns."""
    return stored(df.withColumn(ID, F.monotonically_increasing_id()))


def falling(c: str) -> Column:
    """The value of a descending order: NaN first and null last, as Spark sorts them."""
    return F.when(F.col(c).isNull(), float("nan")).when(F.isnan(c), float("-inf")).otherwise(-F.col(c))


def sizes(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))


def places(sizes: DataFrame, by: list[str], ranks: list[Column]) -> DataFrame:
    """One row per key and rank; `ranks` are expressions of the key's row count `_n`."""
    listed = F.posexplode(F.array(*[r.cast("bigint") for r in ranks])).alias("_j", "_place")
    return sizes.select(*by, listed)


def _hits(run: DataFrame) -> DataFrame:
    """The cells of a running count that hold a wanted rank, with the rank inside the cell."""
    start = F.col("_end") - F.col("_rows")
    inside = F.filter("_wanted", lambda w: (w["place"] > start) & (w["place"] <= F.col("_end")))
    left = F.transform(inside, lambda w: F.struct(w["j"].alias("j"), (w["place"] - start).alias("place")))
    return run.withColumn("_wanted", left).filter(F.size("_wanted") > 0)


def cut(rows: DataFrame, by: list[str], value: Column, ties: list[str], wanted: DataFrame, count: int) -> DataFrame:
    """Adds to each row the `count` cut rows of its key, for `below`. Rows come from `frozen`; `wanted` from `places`.

    A rank below 1 lies before every row. The order is by value (ascending; negate it for the other way), then the ties.
    """
    rows = rows.withColumn("_v", value)
    n = F.count(F.lit(1)).alias("_rows")
    asked = wanted.groupBy(*by).agg(F.collect_list(F.struct(F.col("_j").alias("j"), F.col("_place").alias("place"))).alias("_wanted"))  # a few places a key

    counted = prefix.ordered(rows.groupBy(*by, "_v").agg(n), by, ["_v"], sums={"_end": F.col("_rows")})
    held = stored(_hits(counted.join(F.broadcast(asked), by)).select(*by, "_v", "_wanted"))  # at most one row a place, as below
    first = ties[0]
    inner = rows.select(*by, "_v", *ties, ID).join(F.broadcast(held), [*by, "_v"])
    cells = inner.groupBy(*by, "_v", first).agg(n)
    cells = prefix.ordered(cells, [*by, "_v"], [first], sums={"_end": F.col("_rows")}).join(F.broadcast(held), [*by, "_v"])
    tied = stored(_hits(cells).select(*by, "_v", F.col(first).alias("_first"), "_wanted"))
    same = F.col(first).eqNullSafe(F.col("_first"))
    last = inner.drop("_wanted").join(F.broadcast(tied.withColumnsRenamed({c: f"_k_{c}" for c in [*by, "_v"]})), _same(by) & same).drop(*[f"_k_{c}" for c in [*by, "_v"]], "_first")
    last = prefix.ordered(last, [*by, "_v", first], [*ties[1:], ID], rank="_end").withColumn("_rows", F.lit(1))
    found = _hits(last).select(*by, F.explode("_wanted").alias("_w"), F.struct("_v", *ties, ID).alias("_row"))
    found = found.select(*by, F.col("_w.j").alias("j"), "_row")
    each = range(count)
    cuts = found.groupBy(*by).agg(*[F.max(F.when(F.col("j") == j, F.col("_row"))).alias(f"_cut{j}") for j in each])
    early = wanted.groupBy(*by).agg(*[F.max((F.col("_j") == j) & (F.col("_place") < 1)).alias(f"_early{j}") for j in each])
    table = stored(early.join(cuts, by, "left"))  # one row a key
    return rows.join(F.broadcast(table), by)


def _same(by: list[str]) -> Column:
    out = F.col("_v") == F.col("_k__v")
    for c in by:
        out = out & (F.col(c) == F.col(f"_k_{c}"))
    return out


def below(ties: list[str], first: int, end: int) -> Column:
    """How many of the key's ranks number first to end - 1 are smaller than the row's rank, over a frame from `cut`."""
    row = F.struct("_v", *ties, ID)

    def before(j: int) -> Column:
        at = F.col(f"_cut{j}")  # null: past the last row, or before the first
        higher = (at["_v"] < F.col("_v")) | ((at["_v"] == F.col("_v")) & (at < row))
        return F.when(F.col(f"_early{j}") | higher, 1).otherwise(0)

    return sum((before(j) for j in range(first, end)), F.lit(0))
