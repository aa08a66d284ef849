"""Sample tables, shard sets with manifests, merges and checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SHARD = ["symbol", "month"]

# Used when the manifest and the caller give no valid target or stop.
DEFAULT_TARGET = 0.05
DEFAULT_STOP = 0.02


def write_samples(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_shards(df: DataFrame, path: str, codec: str = "zstd") -> None:
    """One folder per (symbol, month); only folders present in `df` are replaced."""
    (
        df.repartition(*SHARD)  # a shard holds at most one row per minute of a month
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", codec)
        .partitionBy(*SHARD)
        .parquet(path)
    )


def shard_manifest(df: DataFrame, conf: dict | None = None) -> DataFrame:
    """One row per shard with its row count, first and last time, and the configuration it was made with."""
    extra = [F.lit(v).alias(k) for k, v in (conf or {}).items()]
    return df.groupBy(*SHARD).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("open_time").alias("first_open_time"),
        F.max("open_time").alias("last_open_time"),
    ).select("*", *extra)


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.write.mode("overwrite").json(path)


def read_shards(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Shards named by the manifest; folders it does not list are not read."""
    stored = spark.read.option("basePath", path).parquet(path)
    stored = stored.withColumn("symbol", F.col("symbol").cast("string")).withColumn("month", F.col("month").cast("string"))
    return stored.join(manifest.select(*SHARD), SHARD, "left_semi")


def _fingerprint(df: DataFrame) -> DataFrame:
    cols = sorted(c for c in df.columns if c not in (*SHARD, "_source"))
    digest = F.sum(F.xxhash64(*cols).cast("decimal(20,0)"))
    return df.groupBy("_source", *SHARD).agg(F.count(F.lit(1)).alias("rows"), digest.alias("digest"))


def _config_check(configs: list[dict]) -> None:
    first = configs[0]
    for other in configs[1:]:
        if other != first:
            raise ValueError("shard sets were made with different configurations")


def merge_shards(sources: list[DataFrame], configs: list[dict] | None = None) -> tuple[DataFrame, DataFrame]:
    """Union of shard sets. Equal copies of a shard count once, from the first source that has it;
    copies that differ are an error. Returns (rows, shards and rows added per source)."""
    if configs:
        _config_check(configs)
    tagged = reduce(
        DataFrame.unionByName, [df.withColumn("_source", F.lit(i)) for i, df in enumerate(sources)]
    )
    prints = _fingerprint(tagged)
    clash = prints.groupBy(*SHARD).agg(F.countDistinct("digest", "rows").alias("kinds")).filter("kinds > 1")
    found = clash.limit(5).collect()  # at most five names, for the message
    if found:
        raise ValueError("conflicting shards: " + ", ".join(f"{row.symbol}/{row.month}" for row in found))
    owner = prints.groupBy(*SHARD).agg(F.min_by(F.struct("_source", "rows"), "_source").alias("o"))
    owner = owner.select(*SHARD, F.col("o._source").alias("_source"), F.col("o.rows").alias("rows"))
    merged = tagged.join(owner.drop("rows"), [*SHARD, "_source"], "left_semi").drop("_source")
    added = owner.groupBy("_source").agg(F.count(F.lit(1)).alias("shards"), F.sum("rows").alias("rows"))
    return merged, added


def new_shards(existing: DataFrame, incoming: list[DataFrame], configs: list[dict] | None = None) -> DataFrame:
    """Rows of incoming shards that the existing set does not have, after the same conflict check."""
    merged, _ = merge_shards([existing, *incoming], configs)
    return merged.join(existing.select(*SHARD).distinct(), SHARD, "left_anti")


def append_shards(spark: SparkSession, path: str, incoming: list[DataFrame], configs: list[dict] | None = None) -> None:
    """Add new shards to a stored set; with nothing new the set is left as it is."""
    existing = spark.read.parquet(path)
    existing = existing.withColumn("symbol", F.col("symbol").cast("string")).withColumn("month", F.col("month").cast("string"))
    fresh = new_shards(existing, incoming, configs)
    if not fresh.isEmpty():
        fresh.repartition(*SHARD).write.mode("append").partitionBy(*SHARD).parquet(path)


def sample_violations(df: DataFrame, target: float, stop: float, exit_mode: str = "fixed_target", tolerance: float = 1e-9) -> DataFrame:
    """One row of violation counts over the whole sample table."""
    has_volume = "quote_volume" in df.columns or "log_quote_volume" in df.columns
    low = F.col("trade_return") < -stop - tolerance
    high = (F.col("trade_return") > target + tolerance) if exit_mode == "fixed_target" else F.lit(False)
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        (F.lit(0) if has_volume else F.count(F.lit(1))).cast("bigint").alias("missing_quote_volume"),
        F.count_if(F.col("open_time").cast("string").try_cast("double").isNull()).alias("bad_open_time"),
        F.count_if(low).alias("below_stop"),
        F.count_if(high).alias("above_target"),
    )


def check_samples(df: DataFrame, target: float, stop: float, exit_mode: str = "fixed_target") -> None:
    counts = sample_violations(df, target, stop, exit_mode).first().asDict()
    rows = counts.pop("rows")
    broken = {k: v for k, v in counts.items() if v}
    if broken:
        raise ValueError(f"bad samples among {rows}: {broken}")


def effective_targets(manifests: DataFrame, target: float | None = None, stop: float | None = None) -> DataFrame:
    """Target and stop per manifest row: given value, else the manifest's, else the default; with a source tag."""

    def pick(given, column, default) -> tuple[Column, Column]:
        def valid(c):
            return c.isNotNull() & ~F.isnan(c) & (c > 0) & (c < float("inf"))

        g = F.lit(given).cast("double")
        m = F.col(column).cast("double")
        value = F.when(valid(g), g).when(valid(m), m).otherwise(F.lit(default))
        tag = F.when(valid(g), "argument").when(valid(m), "manifest").otherwise("default")
        return value, tag

    u, u_tag = pick(target, "upside_target", DEFAULT_TARGET)
    s, s_tag = pick(stop, "downside_stop", DEFAULT_STOP)
    return (
        manifests.withColumn("effective_target", u).withColumn("target_source", u_tag)
        .withColumn("effective_stop", s).withColumn("stop_source", s_tag)
    )


def global_month_index(df: DataFrame) -> DataFrame:
    """month_index = 0-based rank of the month over all symbols."""
    months = df.select("month").distinct()
    place = (F.dense_rank().over(Window.orderBy("month")) - 1).cast("int")  # one row per calendar month
    return df.drop("month_index").join(F.broadcast(months.withColumn("month_index", place)), "month")
