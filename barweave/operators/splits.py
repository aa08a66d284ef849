"""Chronological splits: by months, walk-forward folds, embargo, caps and recent subsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import MS_PER_MINUTE
from . import prefix

TRAIN, VALIDATION, TEST = "train", "validation", "test"


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def _month_places(df: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct months per key with their 0-based place and the number of months."""
    months = df.select(*keys, "month").distinct()
    w = Window.partitionBy(*keys).orderBy("month")  # calendar months of one key
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return months.withColumn("_place", F.row_number().over(w) - 1).withColumn("_months", size)


def _split_by_place(train: Column, val: Column, test: Column) -> Column:
    p = F.col("_place")
    return (
        F.when(p < train, TRAIN).when(p < train + val, VALIDATION).when(p < train + val + test, TEST)
    )


def ratio(df: DataFrame, validation: float = 0.15, test: float = 0.15, per_symbol: bool = True) -> DataFrame:
    """Adds `split`; the last months are test, the ones before validation. Below 3 months a symbol is left out."""
    keys = ["symbol"] if per_symbol else []
    n = F.col("_months")
    val = F.greatest(F.lit(1), half_up(n * validation))
    tst = F.greatest(F.lit(1), half_up(n * test))
    crowded = val + tst >= n
    val, tst = F.when(crowded, 1).otherwise(val), F.when(crowded, 1).otherwise(tst)
    places = _month_places(df, keys).filter(n >= 3)
    places = places.withColumn("split", _split_by_place(n - val - tst, val, tst)).select(*keys, "month", "split")
    return df.join(places, [*keys, "month"])


def fixed(df: DataFrame, train: int = 6, validation: int = 1, test: int = 1) -> DataFrame:
    """Adds `split` from the first months of each symbol; symbols with fewer months are left out."""
    places = _month_places(df, ["symbol"]).filter(F.col("_months") >= train + validation + test)
    places = places.withColumn("split", _split_by_place(F.lit(train), F.lit(validation), F.lit(test)))
    return df.join(places.filter(F.col("split").isNotNull()).select("symbol", "month", "split"), ["symbol", "month"])


def months(df: DataFrame, start: int, end: int) -> DataFrame:
    """Rows with start <= month_index < end."""
    return df.filter((F.col("month_index") >= start) & (F.col("month_index") < end))


def walk_forward_windows(
    df: DataFrame, train: int, validation: int = 1, test: int = 1, start: int = 0
) -> DataFrame:
    """(fold, split, month_index) membership. Fold i trains from month start + i * test on; a month is in
    many folds. Folds whose test months do not all exist are not made."""
    whole = train + validation + test
    last = df.agg((F.max("month_index") + 1).alias("n"))
    count = F.floor((F.col("n") - start - whole) / test) + 1
    folds = last.select(F.explode(F.sequence(F.lit(1), F.greatest(count, F.lit(0)).cast("int"))).alias("fold"), count.alias("c"))
    folds = folds.filter(F.col("fold") <= F.col("c"))
    place = F.explode(F.sequence(F.lit(0), F.lit(whole - 1))).alias("_place")
    rows = folds.select("fold", place)
    return rows.select(
        "fold",
        _split_by_place(F.lit(train), F.lit(validation), F.lit(test)).alias("split"),
        ((F.col("fold") - 1) * test + start + F.col("_place")).cast("int").alias("month_index"),
    )


def walk_forward(df: DataFrame, train: int, validation: int = 1, test: int = 1, start: int = 0) -> DataFrame:
    """Rows once per fold they belong to, with `fold` and `split`."""
    windows = walk_forward_windows(df, train, validation, test, start)
    return df.join(F.broadcast(windows), "month_index")  # folds x months of a fold


def embargo(df: DataFrame, minutes: int, keys: tuple[str, ...] = ("fold", "split")) -> tuple[DataFrame, DataFrame]:
    """Drops validation and test rows in the first minutes of their window. Returns (rows, removed counts)."""
    first = df.groupBy(*keys).agg(F.min("open_time").alias("_first"))
    flagged = df.join(F.broadcast(first), list(keys))  # one row per fold and split
    early = (F.col("split") != TRAIN) & (F.col("open_time") < F.col("_first") + minutes * MS_PER_MINUTE)
    removed = flagged.groupBy(*keys).agg(F.count_if(early).alias("removed_rows"), F.count_if(~early).alias("kept_rows"))
    return flagged.filter(~early).drop("_first"), removed


def attach_folds(df: DataFrame, fold_months: DataFrame) -> DataFrame:
    """`fold_index` of the row's month out of (month, fold_index); 0 for months without a fold."""
    joined = df.join(F.broadcast(fold_months.select("month", "fold_index")), "month", "left")  # calendar months
    return joined.withColumn("fold_index", F.coalesce("fold_index", F.lit(0)))


def parse_folds(text: str, total: int) -> set[int]:
    """'1-3,5' to {1, 2, 3, 5}."""
    found: set[int] = set()
    for part in filter(None, (p.strip() for p in (text or "").split(","))):
        low, _, high = part.partition("-")
        a, b = int(low), int(high or low)
        if a > b:
            raise ValueError(f"descending fold range {part}")
        found.update(range(a, b + 1))
    outside = sorted(f for f in found if not 1 <= f <= total)
    if outside:
        raise ValueError(f"folds outside 1..{total}: {outside}")
    return found


def phases(spark: SparkSession, total: int, discovery: str = "", selection: str = "", confirmation: str = "") -> DataFrame:
    """(phase, fold) pairs; one phase over all folds when none is given."""
    named = {"discovery": discovery, "selection": selection, "confirmation": confirmation}
    sets = {name: parse_folds(text, total) for name, text in named.items()}
    if sets["confirmation"] and not sets["selection"]:
        raise ValueError("confirmation folds need selection folds")
    taken: dict[int, str] = {}
    for name, folds in sets.items():
        for fold in folds:
            if fold in taken:
                raise ValueError(f"fold {fold} is in {taken[fold]} and {name}")
            taken[fold] = name
    if not taken:
        taken = {f: "diagnostic_all_folds" for f in range(1, total + 1)}
    return spark.createDataFrame([(p, f) for f, p in taken.items()], "phase string, fold int")


def even_stride(rank: Column, size: Column, quota: Column) -> Column:
    """True for `quota` of `size` ranks (1-based), evenly spread."""
    step = F.floor(rank * quota / size)
    return step > F.floor((rank - 1) * quota / size)


def cap_rows(df: DataFrame, limit: int, positive_fraction: float, order: list[str]) -> DataFrame:
    """Stratified cap: every positive if they fit into the fraction, else that many; negatives fill the
    rest. Both are spread evenly over time, so the sample is the same on every run."""
    sizes = df.agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("label") == 1).alias("_pos"))
    ranked = prefix.ordered(df, ["label"], order, rank="_rank", total="_size")
    ranked = ranked.crossJoin(F.broadcast(sizes))  # one row
    pos = F.least(F.col("_pos"), F.floor(F.lit(limit * positive_fraction)))
    quota = F.when(F.col("label") == 1, pos).otherwise(F.least(F.lit(limit) - pos, F.col("_size")))
    keep = (F.col("_n") <= limit) | even_stride(F.col("_rank"), F.col("_size"), quota)
    return ranked.filter(keep).drop("_rank", "_size", "_n", "_pos")


def month_label(df: DataFrame, keys: list[str]) -> DataFrame:
    """'a..b' over the months of each key, 'a' for a single month."""
    span = df.groupBy(*keys).agg(F.min("month").alias("a"), F.max("month").alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.concat_ws("..", "a", "b"))
    return span.select(*keys, text.alias("months"))


def backfill(df: DataFrame, months_back: int) -> DataFrame:
    """Moves the last train months into validation when no validation row was traded (column `traded`)."""
    facts = df.agg(
        F.max(F.when(F.col("split") == TRAIN, F.col("month_index"))).alias("_last"),
        F.count_if((F.col("split") == VALIDATION) & F.col("traded")).alias("_trades"),
    )
    moved = (F.col("_trades") == 0) & (F.col("split") == TRAIN) & (F.col("month_index") > F.col("_last") - months_back)
    joined = df.crossJoin(F.broadcast(facts))  # one row
    return joined.withColumn("split", F.when(moved, VALIDATION).otherwise(F.col("split"))).drop("_last", "_trades")


def recent(df: DataFrame, order: list[str], share: float = 0.0, rows: int = 0) -> DataFrame:
    """The newest rows by time: a count, or a share of all rows rounded up."""
    newest = [F.desc(order[0]), *order[1:]]
    ranked = prefix.ordered(df, [], newest, rank="_rank", total="_size")
    keep = F.lit(rows) if rows else F.ceil(F.col("_size") * share)
    return ranked.filter(F.col("_rank") <= keep).drop("_rank", "_size")
