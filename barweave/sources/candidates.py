"""Candidate artifacts: fixed schema, sinks, read checks and the compact research view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import fold_index, truthy

PRE_FILTER_STAGE = "pre_score_edge_pre_symbol_filter"

# The candidate artifact schema, version 1, in file order.
CANDIDATE_SCHEMA = """
candidate_id string, source string, stable_row_id string, symbol string, month string, month_index int,
open_time bigint, fold_id string, decision_bucket_id bigint, execution_bucket_id bigint, period_bucket_id bigint,
row_position bigint, label int, forward_return double, trade_return double, max_future_high_return double,
max_future_low_return double, quote_volume double, actual_exit_return double, exit_timestamp bigint,
holding_period_minutes double, raw_probability double, calibrated_probability double, raw_predicted_return double,
calibrated_predicted_return double, expected_value double, hybrid_score double, ranker_score double,
ranker_selection_score double, ranker_utility_score double, uncertainty double, meta_probability double,
final_preselection_score double, selected_threshold double, candidate_serialization_stage string,
selected_by_threshold int, selected_by_score_edge int, selected_by_symbol_filter int, selected_by_topk int,
raw_signal int, predicted int, threshold_percentile double, candidate_generation_reason string,
rejection_stage string, rejection_reason string, selected_by_score_before_execution int, executed int,
position_size double, rank_within_decision_bucket int, candidate_count_within_decision_bucket int,
rank_within_execution_bucket int, candidate_count_within_execution_bucket int, rank_within_period_bucket int,
candidate_count_within_period_bucket int, configured_top_k int, symbol_exposure_before_selection double,
capital_available_before_selection double, trade_day string, exit_reason string
"""
SCHEMA_FIELDS = [tuple(part.split()) for part in CANDIDATE_SCHEMA.replace("\n", " ").split(",")]
SCHEMA_VERSION = 1


def to_schema(df: DataFrame) -> DataFrame:
    """Exactly the artifact columns: extras go, missing ones are null, non-finite numbers are null."""

    def column(name: str, kind: str) -> Column:
        if name not in df.columns:
            return F.lit(None).cast(kind).alias(name)
        c = F.col(name).cast(kind)
        if kind == "double":
            c = F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)
        return c.alias(name)

    return df.select(*[column(n, k) for n, k in SCHEMA_FIELDS])


def fingerprint(df: DataFrame) -> DataFrame:
    """Row count, executed count and an order-free content digest in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("executed") == 1).alias("executed_rows"),
        F.sum(F.xxhash64(*df.columns).cast("decimal(20,0)")).cast("string").alias("digest"),
    )


def write_candidates(df: DataFrame, path: str) -> None:
    """Rows under `path/rows`, the manifest (version, counts, digest, coverage) under `path/manifest`."""
    spark = df.sparkSession
    rows = to_schema(df)
    rows.write.mode("overwrite").parquet(f"{path}/rows")
    stored = spark.read.parquet(f"{path}/rows")
    manifest = fingerprint(stored).select(
        F.lit(SCHEMA_VERSION).alias("version"), F.lit(True).alias("complete"), "*",
        F.lit(True).alias("full_candidate_coverage"),
    )
    manifest.write.mode("overwrite").json(f"{path}/manifest")


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Candidate rows after checking version, complete flag, counts and digest against the manifest."""
    told = spark.read.json(f"{path}/manifest").first()  # one manifest row
    if told is None or told["version"] != SCHEMA_VERSION:
        raise ValueError("unknown candidate artifact version")
    if not told["complete"]:
        raise ValueError("candidate artifact is not complete")
    rows = spark.read.parquet(f"{path}/rows")
    seen = fingerprint(rows).first()
    for name in ("rows", "executed_rows", "digest"):
        if str(seen[name]) != str(told[name]):
            raise ValueError(f"candidate artifact does not match its manifest: {name}")
    return rows


def predictions(df: DataFrame, mode: str) -> DataFrame:
    """Rows a prediction sink keeps: all, trades (executed), candidates (any selection flag) or none."""
    if mode == "all":
        return df
    if mode == "trades":
        return df.filter(truthy("executed"))
    if mode == "candidates":
        return df.filter(truthy("raw_signal") | truthy("executed") | truthy("selected_by_topk"))
    if mode == "none":
        return df.filter(F.lit(False))
    raise ValueError(f"unknown prediction mode {mode}")


def write_predictions(df: DataFrame, path: str, mode: str) -> None:
    predictions(df, mode).write.mode("overwrite").parquet(path)


def capabilities(manifests: DataFrame) -> DataFrame:
    """Coverage class of each manifest row and the analyses it allows."""
    # The coverage levels and the words supported, unsupported and unsupported_limited_rows.
    known = F.col("has_manifest")
    full = F.coalesce("full_candidate_coverage", F.lit(False))
    stage = F.coalesce("candidate_serialization_stage", F.lit("post_selection"))
    pre = stage == PRE_FILTER_STAGE
    kind = F.concat(
        F.when(pre, "pre_filter_candidate").otherwise("post_selection_candidate"),
        F.when(full, "").otherwise("_limited"),
    )
    rows = F.when(~known, "unsupported").when(full, "supported").otherwise("unsupported_limited_rows")
    ablation = F.when(known & pre & full, "supported").otherwise("unsupported")
    reason = (
        F.when(~known, "no manifest lies with the rows")
        .when(~full, "the saved rows are not all candidates")
        .when(~pre, "the filters had already run when the rows were saved")
        .otherwise("")
    )
    return manifests.select(
        "*",
        F.when(known, kind).otherwise("legacy_trades_only_or_unknown").alias("coverage_level"),
        F.lit("supported").alias("executed_trade_diagnostics"),
        rows.alias("true_topk_reselection"),
        rows.alias("rejected_candidate_analysis"),
        rows.alias("cross_sectional_normalization"),
        rows.alias("exposure_aware_reselection"),
        ablation.alias("score_edge_ablation"),
        ablation.alias("symbol_filter_ablation"),
        reason.alias("reason"),
    )


def row_id(df: DataFrame) -> Column:
    """'candidate:<id>', else 'stable:<id>', else 'source:fold:row'."""

    def text(name):
        return F.nullif(F.trim(F.col(name).cast("string")), F.lit("")) if name in df.columns else F.lit(None).cast("string")

    def plain(name):
        return F.coalesce(text(name), F.lit(""))

    fallback = F.concat_ws(":", plain("source"), plain("fold_id"), plain("row_position"))
    return F.coalesce(
        F.concat(F.lit("candidate:"), text("candidate_id")), F.concat(F.lit("stable:"), text("stable_row_id")), fallback
    )


def compact(df: DataFrame) -> DataFrame:
    """Artifact columns under their research names, with fallbacks where a column may be empty."""
    return df.select(
        row_id(df).alias("row_id"),
        "symbol", "month", "open_time", "trade_day", "label",
        fold_index("fold_id").alias("fold"),
        F.col("executed").alias("predicted"),
        F.coalesce("selected_by_score_before_execution", "selected_by_topk").alias("selected_by_topk"),
        "raw_signal",
        F.coalesce("actual_exit_return", "trade_return", "forward_return").alias("dynamic_trade_return"),
        "trade_return",
        F.col("raw_probability").alias("probability"),
        "calibrated_probability",
        F.coalesce("calibrated_predicted_return", "raw_predicted_return").alias("predicted_trade_return"),
        F.coalesce("final_preselection_score", "hybrid_score").alias("trade_score"),
        "hybrid_score", "expected_value", "position_size", "configured_top_k",
        "candidate_serialization_stage", "selected_by_threshold", "selected_by_score_edge", "selected_by_symbol_filter",
        "decision_bucket_id", "period_bucket_id",
    )


def relevant(df: DataFrame) -> DataFrame:
    """Rows the offline research needs: pre-filter rows over the threshold, or any selection flag."""
    flags = ["raw_signal", "predicted", "executed", "selected_by_topk", "selected_by_score_before_execution"]
    have = [f for f in flags if f in df.columns]
    pre = (F.col("candidate_serialization_stage") == PRE_FILTER_STAGE) & truthy("selected_by_threshold")
    any_flag = truthy(have[0])
    for f in have[1:]:
        any_flag = any_flag | truthy(f)
    return df.filter(F.coalesce(pre, F.lit(False)) | any_flag)


def extract(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw, predicted or selected rows, and the flag counts over all rows."""
    raw, predicted, top = truthy("raw_signal"), truthy("predicted"), truthy("selected_by_topk")
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(raw).alias("raw_signal_rows"),
        F.count_if(predicted).alias("predicted_rows"),
        F.count_if(top).alias("selected_by_topk_rows"),
        F.count_if(raw | predicted | top).alias("kept_rows"),
    )
    return df.filter(raw | predicted | top), counts
