"""Fits and batch scores with Spark ML: scaling, logistic baseline, boosted trees, ensembles and filters.

Fits loop over folds or windows on the driver; every fit and every score is a distributed job.
"""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import accounting

FLAT = 1e-9
MAX_BINS = 63


def scaler(train: DataFrame, features: list[str]) -> DataFrame:
    """feature, mean, stddev of the training rows; a stddev below 1e-9 is 1."""
    wide = train.agg(*[f(c).alias(f"{n}_{c}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    rows = [
        F.struct(
            F.lit(c).alias("feature"), F.col(f"m_{c}").alias("mean"),
            F.when(F.col(f"s_{c}") < FLAT, 1.0).otherwise(F.col(f"s_{c}")).alias("stddev"),
        )
        for c in features
    ]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _scaler_values(scales: DataFrame) -> dict[str, tuple[float, float]]:
    return {row["feature"]: (row["mean"], row["stddev"]) for row in scales.collect()}  # one row per feature


def standardise(df: DataFrame, scales: DataFrame) -> DataFrame:
    """Replaces each feature by (x - mean) / stddev; the values become literals, so nothing is joined."""
    return df.withColumns({c: (F.col(c) - m) / s for c, (m, s) in _scaler_values(scales).items()})


def class_weight(train: DataFrame, cap: float, label: str = "label", keys: list[str] | None = None) -> DataFrame:
    """Weight of positives: min(cap, negatives / positives), 1 without positives."""
    pos = F.count_if(F.col(label) == 1)
    neg = F.count_if(F.col(label) == 0)
    weight = F.when(pos == 0, 1.0).otherwise(F.least(F.lit(float(cap)), neg / pos))
    return train.groupBy(*(keys or [])).agg(pos.alias("positives"), neg.alias("negatives"), weight.alias("positive_weight"))


def assemble(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(df)


def logistic(train: DataFrame, features: list[str], label: str = "label", cap: float = 50.0, l2: float = 1e-3) -> Scored:
    """Class-weighted L2 logistic model on standardised features."""
    scales = scaler(train, features)
    weight = class_weight(train, cap, label).first()["positive_weight"]
    rows = assemble(standardise(train, scales), features).withColumn("_y", F.col(label).cast("double"))
    rows = rows.withColumn("_w", F.when(F.col(label) == 1, float(weight)).otherwise(1.0))
    fit = LogisticRegression(
        featuresCol="features", labelCol="_y", weightCol="_w", regParam=l2, maxIter=30, standardization=False
    ).fit(rows)
    return Scored(fit, features, _scaler_values(scales))


class Scored:
    """A fitted model with what is needed to score raw rows: features, scales, and whether it is a classifier."""

    def __init__(self, model: Model, features: list[str], scales: dict[str, tuple[float, float]] | None = None):
        self.model, self.features, self.scales = model, features, scales

    def score(self, df: DataFrame, out: str) -> DataFrame:
        """All columns of `df` and the probability of the positive class, or the predicted value."""
        x = {c: F.col(c) for c in self.features}
        if self.scales:
            x = {c: (F.col(c) - m) / s for c, (m, s) in self.scales.items()}
        named = {f"_x_{i}": x[c].cast("double") for i, c in enumerate(self.features)}
        rows = VectorAssembler(inputCols=list(named), outputCol="features", handleInvalid="keep").transform(df.withColumns(named))
        classifier = self.model.hasParam("probabilityCol")
        model = self.model.copy()
        model.setPredictionCol("_prediction")
        if classifier:
            model.setProbabilityCol("_probability").setRawPredictionCol("_raw")
        done = model.transform(rows)
        value = vector_to_array("_probability")[1] if classifier else F.col("_prediction")
        return done.withColumn(out, value).select(*[c for c in df.columns if c != out], out)

    def importance(self) -> DataFrame:
        """feature, importance, non_zero; for a linear model the size of the coefficient."""
        weights = getattr(self.model, "featureImportances", None)
        values = weights.toArray() if weights is not None else abs(self.model.coefficients.toArray())
        rows = [(f, float(v), bool(v)) for f, v in zip(self.features, values)]
        return SparkSession.active().createDataFrame(rows, "feature string, importance double, non_zero boolean")

    def coefficients(self) -> DataFrame:
        """feature, weight, mean, stddev of a linear model; the intercept has mean 0 and stddev 1."""
        rows = [
            (f, float(w), float(self.scales[f][0]), float(self.scales[f][1]))
            for f, w in zip(self.features, self.model.coefficients.toArray())
        ]
        rows.append(("intercept", float(self.model.intercept), 0.0, 1.0))
        return SparkSession.active().createDataFrame(rows, "feature string, weight double, mean double, stddev double")


def gbt(
    train: DataFrame, validation: DataFrame, features: list[str], kind: str, label: str, max_iter: int = 20, depth: int = 4, seed: int = 7
) -> Scored:
    """Boosted trees ('classifier' or 'regressor') that stop when the validation rows no longer improve."""
    cols = [*features, label]
    rows = train.select(*cols, F.lit(False).alias("_val")).unionByName(validation.select(*cols, F.lit(True).alias("_val")))
    named = {f"_x_{i}": F.col(c).cast("double") for i, c in enumerate(features)}
    rows = rows.withColumns(named).withColumn("_y", F.col(label).cast("double"))
    rows = VectorAssembler(inputCols=list(named), outputCol="features", handleInvalid="keep").transform(rows)
    conf = {
        "featuresCol": "features", "labelCol": "_y", "maxIter": max_iter, "maxDepth": depth, "maxBins": MAX_BINS, "seed": seed,
        "validationIndicatorCol": "_val", "stepSize": 0.1,
    }
    return Scored((GBTClassifier if kind == "classifier" else GBTRegressor)(**conf).fit(rows), features)


def rank(train: DataFrame, validation: DataFrame, features: list[str], relevance: str, **conf) -> Scored:
    """Ranker by regression on the relevance grade or net utility; `ranker.fit` has the losses within decision groups."""
    return gbt(train, validation, features, "regressor", relevance, **conf)


def windows(spec: list[int]) -> list[int]:
    """Training window lengths in months, without repeats, longest first; 0 means all months."""
    if any(w < 0 for w in spec):
        raise ValueError("training windows must not be negative")
    return sorted(set(spec), key=lambda w: -(w or 10**9))


def ensemble(train: DataFrame, spec: list[int], fit, df: DataFrame, out: str) -> DataFrame:
    """Mean score of one model per trailing window of training months (`month_index`); `fit` makes a `Scored`."""
    last = train.agg(F.max("month_index")).first()[0]  # one number
    names = []
    for i, w in enumerate(windows(spec)):
        part = train if w == 0 else train.filter(F.col("month_index") > last - w)
        df = fit(part).score(df, f"_score_{i}")
        names.append(f"_score_{i}")
    mean = sum((F.col(n) for n in names), F.lit(0.0)) / len(names)
    return df.withColumn(out, mean).drop(*names)


def keep_filter(
    base: DataFrame, filtered: DataFrame, keys: list[str], min_trades: int, max_precision_loss: float = 0.0, max_score_loss: float = 0.0
) -> DataFrame:
    """Whether a filter stays on: enough trades, precision and score held. Both sides have the keys, trades,
    precision and score; the first failed check is the reason for 'off'."""
    f = filtered.select(*keys, *[F.col(c).alias(f"filtered_{c}") for c in ("trades", "precision", "score")])
    joined = base.join(f, keys, "left") if keys else base.crossJoin(F.broadcast(f))  # one row
    reason = (
        F.when(F.coalesce("filtered_trades", F.lit(0)) < min_trades, "too_few_trades")
        .when(F.col("filtered_precision") < F.col("precision") - max_precision_loss, "precision_dropped")
        .when(F.col("filtered_score") < F.col("score") - max_score_loss, "score_dropped")
        .otherwise("")
    )
    return joined.withColumn("reason", reason).withColumn("enabled", F.col("reason") == "")


def filter_row(df: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """trades, precision and score (mean net return) of selected rows, for `keep_filter`."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"), F.avg(F.col(label).cast("double")).alias("precision"), F.avg("net").alias("score")
    )


def meta_filter(
    candidates: DataFrame, validation: DataFrame, rows: DataFrame, features: list[str], min_probability: float, min_trades: int
) -> tuple[DataFrame, DataFrame]:
    """A second classifier on candidate rows (positive net return). Returns (rows with meta_probability and
    meta_kept, the decision row); when the decision is off every row is kept."""
    target = (F.col("net") > 0).cast("int")
    model = logistic(candidates.withColumn("_won", target), features, "_won")
    scored = model.score(validation, "meta_probability")
    verdict = keep_filter(
        filter_row(scored, []), filter_row(scored.filter(F.col("meta_probability") >= min_probability), []), [], min_trades
    )
    gate = verdict.select(F.col("enabled").alias("_on"))
    out = model.score(rows, "meta_probability").crossJoin(F.broadcast(gate))  # one row
    kept: Column = ~F.col("_on") | (F.col("meta_probability") >= min_probability)
    return out.withColumn("meta_kept", kept).drop("_on"), verdict


def evaluate(scored: DataFrame, score: str, threshold: float) -> DataFrame:
    """Classification counts and AUC of a scored frame as one row."""
    counts = accounting.classify(scored, [], F.col(score) >= threshold)
    return counts.crossJoin(F.broadcast(accounting.auc(scored, score).select("auc")))  # one row

