"""Calibration of probabilities, returns and selection scores."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import prefix, quantiles

NEG_INF = float("-inf")
UNCERTAINTY_BUCKETS = 10  # not pinned by the reference


def _vector(df: DataFrame, column: str) -> DataFrame:
    return VectorAssembler(inputCols=[column], outputCol="_x").transform(df)


def platt(fit: DataFrame, df: DataFrame, p: str, label: str = "label") -> DataFrame:
    """Adds calibrated_probability: a logistic curve over the log-odds of `p`, fitted on `fit`."""
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col(p)))

    def odds(d):
        return _vector(d.withColumn("_odds", F.log(q / (1 - q))), "_odds")

    model = LogisticRegression(featuresCol="_x", labelCol="_y", maxIter=50).fit(
        odds(fit).withColumn("_y", F.col(label).cast("double"))
    )
    out = model.setProbabilityCol("_p").setPredictionCol("_c").setRawPredictionCol("_r").transform(odds(df))
    return out.withColumn("calibrated_probability", vector_to_array("_p")[1]).drop("_x", "_odds", "_p", "_c", "_r")


def isotonic(fit: DataFrame, df: DataFrame, p: str, label: str = "label") -> DataFrame:
    """Adds calibrated_probability: the best non-decreasing curve, fitted on `fit`."""
    model = IsotonicRegression(featuresCol="_x", labelCol="_y", predictionCol="calibrated_probability").fit(
        _vector(fit.withColumn("_y", F.col(label).cast("double")), p)
    )
    return model.transform(_vector(df, p)).drop("_x")


def linear_fit(fit: DataFrame, predicted: str, actual: str, keys: list[str] | None = None) -> DataFrame:
    """Least-squares slope and intercept; identity without spread."""
    out = fit.groupBy(*(keys or [])).agg(
        F.regr_slope(actual, predicted).alias("_s"), F.regr_intercept(actual, predicted).alias("_i")
    )
    return out.select(
        *(keys or []), F.coalesce("_s", F.lit(1.0)).alias("slope"),
        F.when(F.col("_s").isNull(), 0.0).otherwise(F.col("_i")).alias("intercept"),
    )


def linear(fit: DataFrame, df: DataFrame, predicted: str, actual: str, out: str = "calibrated_return") -> DataFrame:
    line = linear_fit(fit, predicted, actual)
    joined = df.crossJoin(F.broadcast(line))  # one row
    return joined.withColumn(out, F.col("slope") * F.col(predicted) + F.col("intercept")).drop("slope", "intercept")


def _between(value: str) -> Column:
    return (F.col(value) > F.col("_low")) & (F.col(value) <= F.col("_high"))


def bin_table(df: DataFrame, score: str, order: list, bins: int, aggs: list[Column]) -> DataFrame:
    """Equal-count bins ceil(bins * rank / n) with score bounds open at both ends, and aggregates."""
    ranked = prefix.ordered(df, [], [F.col(score), *order], rank="_rank", total="_n")
    place = F.ceil(F.col("_rank") * bins / F.col("_n")).cast("int")
    return ranked.withColumn("bin", place).groupBy("bin").agg(
        F.count(F.lit(1)).alias("rows"), F.min(score).alias("lower_score"), F.max(score).alias("upper_score"), *aggs
    )


def with_edges(bins: DataFrame) -> DataFrame:
    """Half-open score ranges of the bins: the first starts at -inf, the last ends at +inf."""
    w = Window.orderBy("bin")  # a handful of bins
    below = F.coalesce(F.lag("upper_score").over(w), F.lit(NEG_INF))
    above = F.when(F.lead("bin").over(w).isNull(), F.lit(float("inf"))).otherwise(F.col("upper_score"))
    return bins.withColumn("_low", below).withColumn("_high", above)


def bucket_residual(
    fit: DataFrame, df: DataFrame, predicted: str, actual: str, bins: int = UNCERTAINTY_BUCKETS, min_rows: int = 30
) -> DataFrame:
    """Adds uncertainty: spread of the residuals in the bucket of the prediction, else over all rows."""
    residual = F.col(actual) - F.col(predicted)
    cuts = quantiles.exact(fit, [], predicted, {f"c{i}": i / bins for i in range(1, bins)}).drop("rows")

    def bucketed(d):
        joined = d.crossJoin(F.broadcast(cuts))  # one row
        place = sum((F.when(F.col(predicted) > F.col(f"c{i}"), 1).otherwise(0) for i in range(1, bins)), F.lit(0))
        return joined.withColumn("_bucket", place).drop(*[f"c{i}" for i in range(1, bins)])

    spread = bucketed(fit).groupBy("_bucket").agg(F.stddev_pop(residual).alias("_sd"), F.count(F.lit(1)).alias("_n"))
    whole = fit.agg(F.stddev_pop(residual).alias("_all"))
    out = bucketed(df).join(F.broadcast(spread), "_bucket", "left").crossJoin(F.broadcast(whole))  # buckets, one row
    value = F.when(F.col("_n") >= min_rows, F.col("_sd")).otherwise(F.col("_all"))
    return out.withColumn("uncertainty", value).drop("_bucket", "_sd", "_n", "_all")


def score_bucket(fit: DataFrame, score: str, utility: str, order: list, bins: int, min_rows: int, shrink: float) -> DataFrame:
    """Mean utility per equal-count score bin, shrunk to the mean of all rows: (n*m + s*g) / (n + s).

    No rows come back when `fit` has fewer than `min_rows`: calibration is off then.
    """
    table = bin_table(fit, score, order, bins, [F.avg(utility).alias("mean_utility")])
    whole = fit.agg(F.avg(utility).alias("_g"), F.count(F.lit(1)).alias("_n"))
    joined = table.crossJoin(F.broadcast(whole)).filter(F.col("_n") >= min_rows)  # one row
    value = (F.col("rows") * F.col("mean_utility") + shrink * F.col("_g")) / (F.col("rows") + shrink)
    return joined.withColumn("calibrated_utility", value).drop("_g", "_n")


def apply_score_bucket(df: DataFrame, bins: DataFrame, score: str, out: str = "selection_score") -> DataFrame:
    """The calibrated utility of the row's bin; the raw score when calibration is off."""
    edges = with_edges(bins).select("_low", "_high", F.col("calibrated_utility").alias("_u"))
    joined = df.join(F.broadcast(edges), _between(score), "left")  # a handful of bins, one match per row
    return joined.withColumn(out, F.coalesce("_u", F.col(score))).drop("_low", "_high", "_u")


def top_bin_gate(df: DataFrame, bins: DataFrame, score: str, floor: float = 0.0) -> DataFrame:
    """Sets every score to -inf when the best bin's utility is below the floor."""
    top = bins.agg(F.max_by("calibrated_utility", "bin").alias("_top"))
    rejected = F.coalesce(F.col("_top") < floor, F.lit(False))
    joined = df.crossJoin(F.broadcast(top))  # one row
    return joined.withColumn(score, F.when(rejected, F.lit(NEG_INF)).otherwise(F.col(score))).drop("_top")


def blend(bucket_utility, regression_utility, weight: float) -> Column:
    """(1 - w) of the bucket utility and w of the regression utility."""
    return (1 - weight) * F.col(bucket_utility) + weight * F.col(regression_utility)
