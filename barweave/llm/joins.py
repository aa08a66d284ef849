"""A join that a hot key cannot bring into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT = 1000


def spread_join(left: DataFrame, right: DataFrame, key: str | list[str], rows: str) -> DataFrame:
    """Inner join to a frame with one row a key, whose column ``rows`` counts the key's rows on the left; ``rows`` itself is dropped.

    Keys with more than 1 / HOT of all rows are fewer than HOT: they are broadcast, so no task gets a hot key's rows.
    """
    total = right.agg(F.sum(rows)).first()[0] or 0
    hot = right.filter(F.col(rows) * HOT > total)
    cold = right.filter(F.col(rows) * HOT <= total)
    few = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold.drop(rows), key)
    return left.join(F.broadcast(hot.drop(rows)), key).unionByName(few)
