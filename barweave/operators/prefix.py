"""Ordered prefix over a total order without one giant window task.

Rows are range-partitioned on (keys, order) by Spark, so a key or value that holds a large part of
all rows is spread over many buckets as long as the order columns tell its rows apart. The bucket
number is frozen by writing the ordered rows to the shared checkpoint folder: both the bucket totals
and the rows see the same buckets, also after a lost executor. The carry into each bucket is a window
over the small totals table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import as_col
from ..session import stored

BUCKET = "_bucket"
AT = "_at"  # place in the total order, rising over all buckets


def ranged(df: DataFrame, keys: list[str], order: list, partitions: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """Spread the rows over ordered buckets and freeze the bucket number and each row's place, so that later steps order by one number.

    `keep` names the columns to store; those of the order are not needed after it."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(k) for k in keys] + [as_col(o) for o in order]
    placed = df.repartitionByRange(n, *by).sortWithinPartitions(*by)
    return stored(placed.select(*(keep or df.columns), F.spark_partition_id().alias(BUCKET), F.monotonically_increasing_id().alias(AT)))


def scan(
    df: DataFrame,
    keys: list[str],
    order: list,
    sums: dict[str, Column] | None = None,
    maxes: dict[str, Column] | None = None,
    rank: str | None = None,
    total: str | None = None,
    previous: dict[str, Column] | None = None,
    key_sums: dict[str, Column] | None = None,
    maxes_before: dict[str, Column] | None = None,
    highs: dict[str, str] | None = None,
) -> DataFrame:
    """Running row number, sums and maxima per key over a bucketed frame from `ranged`.

    `total` adds the row count of the key, `key_sums` adds whole sums of the key, `previous` adds
    the value of the row before, `maxes_before` the maximum up to the row before. `highs` adds the running maximum of one
    of the running sums: a bucket is summed up by (sum, highest prefix), and these combine from bucket to bucket.
    """
    sums, maxes, previous, key_sums = sums or {}, maxes or {}, previous or {}, key_sums or {}
    past, highs = maxes_before or {}, highs or {}
    order = [F.col(AT)] if AT in df.columns else [as_col(o) for o in order]
    inside = Window.partitionBy(BUCKET, *keys).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    last = F.struct(F.lit(1).alias("set"), *[e.alias(n) for n, e in previous.items()])
    aggs = [F.count(F.lit(1)).alias("_t_n")]
    aggs += [F.sum(e).alias(f"_t_s_{n}") for n, e in sums.items()]
    aggs += [F.max(e).alias(f"_t_m_{n}") for n, e in maxes.items()]
    aggs += [F.max(e).alias(f"_t_b_{n}") for n, e in past.items()]
    aggs += [F.sum(e).alias(f"_t_k_{n}") for n, e in key_sums.items()]
    aggs += [F.max(f"_l_h_{n}").alias(f"_t_h_{n}") for n in highs]
    source = df
    if highs:
        # One shuffle of the rows as they are serves the totals and the rows; the join below drops null keys anyway.
        for c in (BUCKET, *keys):
            df = df.filter(F.col(c).isNotNull())
        df = df.repartition(BUCKET, *keys)
        source = df.select("*", *[F.sum(sums[of]).over(upto).alias(f"_l_s_{of}") for of in dict.fromkeys(highs.values())])
        source = source.select("*", *[F.max(f"_l_s_{of}").over(upto).alias(f"_l_h_{n}") for n, of in highs.items()])
    if previous:
        if AT not in df.columns:
            source = source.withColumn(AT, F.row_number().over(inside))
        aggs.append(F.max_by(last, F.col(AT)).alias("_t_last"))
    totals = source.groupBy(BUCKET, *keys).agg(*aggs)

    # At most one row per bucket and key, and a key spans at most `partitions` buckets.
    before = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    for n, of in highs.items():
        totals = totals.withColumn(f"_h_{n}", F.coalesce(F.sum(f"_t_s_{of}").over(before), F.lit(0)) + F.col(f"_t_h_{n}"))
    carry = totals.select(
        F.col(BUCKET),
        *keys,
        F.coalesce(F.sum("_t_n").over(before), F.lit(0)).alias("_c_n"),
        F.sum("_t_n").over(Window.partitionBy(*keys)).alias("_c_total"),
        *[F.sum(f"_t_k_{n}").over(Window.partitionBy(*keys)).alias(f"_c_k_{n}") for n in key_sums],
        *[F.coalesce(F.sum(f"_t_s_{n}").over(before), F.lit(0)).alias(f"_c_s_{n}") for n in sums],
        *[F.max(f"_t_m_{n}").over(before).alias(f"_c_m_{n}") for n in maxes],
        *[F.max(f"_t_b_{n}").over(before).alias(f"_c_b_{n}") for n in past],
        *[F.max(f"_h_{n}").over(before).alias(f"_c_h_{n}") for n in highs],
        *([F.last("_t_last").over(before).alias("_c_last")] if previous else []),
    )
    if not keys:
        carry = F.broadcast(carry)  # one row per bucket

    cols = [F.col(c) for c in df.columns]
    cols.append(F.row_number().over(inside).alias("_l_n"))
    cols += [F.sum(e).over(upto).alias(f"_l_s_{n}") for n, e in sums.items()]
    cols += [F.max(e).over(upto).alias(f"_l_m_{n}") for n, e in maxes.items()]
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    cols += [F.max(e).over(earlier).alias(f"_l_b_{n}") for n, e in past.items()]
    if previous:
        cols.append(F.lag(last).over(inside).alias("_l_last"))
    local = df.select(*cols)
    if highs:
        local = local.select("*", *[F.max(f"_l_s_{of}").over(upto).alias(f"_l_h_{n}") for n, of in highs.items()])

    out = [F.col(c) for c in df.columns]
    if rank:
        out.append((F.col("_l_n") + F.col("_c_n")).alias(rank))
    if total:
        out.append(F.col("_c_total").alias(total))
    out += [F.col(f"_c_k_{n}").alias(n) for n in key_sums]
    out += [(F.coalesce(F.col(f"_l_s_{n}"), F.lit(0)) + F.col(f"_c_s_{n}")).alias(n) for n in sums]
    out += [F.greatest(f"_l_m_{n}", f"_c_m_{n}").alias(n) for n in maxes]
    out += [F.greatest(f"_l_b_{n}", f"_c_b_{n}").alias(n) for n in past]
    out += [F.greatest(F.col(f"_l_h_{n}") + F.col(f"_c_s_{of}"), F.col(f"_c_h_{n}")).alias(n) for n, of in highs.items()]
    if previous:
        seen = F.coalesce("_l_last", "_c_last")
        out += [seen[n].alias(n) for n in previous]
    return local.join(carry, [BUCKET, *keys]).select(*out)


def ordered(df: DataFrame, keys: list[str], order: list, partitions: int | None = None, **what) -> DataFrame:
    """`ranged` and `scan` in one step, without the bucket column."""
    return scan(ranged(df, keys, order, partitions), keys, order, **what).drop(BUCKET, AT)


def ranks(df: DataFrame, order: list, scopes: dict[str, str], rank: str, total: str) -> DataFrame:
    """Rank and row count within each scope (name to key column), all under one order; `rank` and `total` are patterns for the names.

    The rows are ordered once, by the order alone, and go once more to the task of their bucket: there they are numbered per key of every
    scope. What lies in earlier buckets is a count per bucket and key.
    """
    placed = ranged(df, [], order)
    rows = placed.repartition(BUCKET)  # serves the window of every scope
    for name, key in scopes.items():
        cells = placed.groupBy(F.col(BUCKET).alias("_cell"), F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
        whole = Window.partitionBy("_key")
        before = F.sum("_n").over(whole.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
        # Stored, so that Spark sees its size: at most one row a bucket and key.
        cells = stored(cells.select("_cell", "_key", F.coalesce(before, F.lit(0)).alias("_c_n"), F.sum("_n").over(whole).alias("_c_total")))
        inside = F.row_number().over(Window.partitionBy(BUCKET, key).orderBy(AT))
        joined = rows.withColumn("_l_n", inside).join(cells, (F.col(BUCKET) == F.col("_cell")) & F.col(key).eqNullSafe(F.col("_key")))
        out = {rank.format(name): F.col("_l_n") + F.col("_c_n"), total.format(name): F.col("_c_total")}
        rows = joined.withColumns(out).drop("_l_n", "_cell", "_key", "_c_n", "_c_total")
    return rows.drop(BUCKET, AT)
