"""Boosted ranking: gradients of a ranking loss within decision groups, one Spark ML tree a round.

Both losses need a few sums per group only, never its pairs or a sorted list, so one group may hold any share of the rows:

* ``listwise``: cross-entropy of the softmax of a group's scores against its gains 2^grade - 1, scaled to 1. A group without a gain has none.
* ``pairwise``: mean of exp(s_j - s_i) over the pairs of a group with grade i above grade j. It is a sum over pairs of grade levels of
  (sum of exp(-s) above) x (sum of exp(s) below). A group of one grade has none.

A round aggregates the sums, joins them to the rows, and fits a regression tree to minus gradient / curvature, weighted by curvature, so a leaf
holds the Newton step. The curvature is at least the size of the gradient, so no leaf goes beyond 1. The rows are written once a round
(`session.stored`); the driver sees the grade levels, one row of losses a round and the trees. Rows with a null group or grade are left out.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from . import select
from .models import MAX_BINS, Scored

#: Most grade levels; `labels.relevance` makes five.
MAX_LEVELS = 32
LISTWISE, PAIRWISE = "listwise", "pairwise"


def levels(df: DataFrame, grade: str) -> list[int]:
    """The grades of the rows, ascending."""
    found = [row[0] for row in df.select(F.col(grade).cast("int")).dropna().distinct().limit(MAX_LEVELS + 1).collect()]
    if len(found) > MAX_LEVELS:
        raise ValueError(f"{grade} has more than {MAX_LEVELS} levels; make grades first")
    return sorted(found)


def _total(terms: list):
    return sum(terms[1:], terms[0]) if terms else F.lit(0.0)


def group_sums(df: DataFrame, keys: list[str], grade: str, score: str, grades: list[int], objective: str) -> DataFrame:
    """One row a group with the sums that `gradients` needs, and its loss; groups without a loss are left out."""
    s, g = F.col(score), F.col(grade)
    if objective == LISTWISE:
        gain = F.pow(F.lit(2.0), g) - 1
        sums = df.groupBy(*keys).agg(F.sum(F.exp(s)).alias("_z"), F.sum(gain).alias("_gain"), F.sum(gain * s).alias("_gs"))
        return sums.filter("_gain > 0").withColumn("loss", F.log("_z") - F.col("_gs") / F.col("_gain"))
    if objective != PAIRWISE:
        raise ValueError(f"unknown objective {objective}")
    aggs = []
    for i, level in enumerate(grades):
        mine = g == level
        aggs += [
            F.count_if(mine).alias(f"_n{i}"),
            F.coalesce(F.sum(F.when(mine, F.exp(s))), F.lit(0.0)).alias(f"_up{i}"),
            F.coalesce(F.sum(F.when(mine, F.exp(-s))), F.lit(0.0)).alias(f"_down{i}"),
        ]
    sums = df.groupBy(*keys).agg(*aggs) if aggs else df.select(*keys).distinct()
    places = range(len(grades))
    below = [_total([F.col(f"_up{j}") for j in range(i)]) for i in places]
    above = [_total([F.col(f"_down{j}") for j in range(i + 1, len(grades))]) for i in places]
    pairs = _total([F.col(f"_n{i}") * F.col(f"_n{j}") for i in places for j in range(i)])
    loss = _total([F.col(f"_down{i}") * below[i] for i in places])
    out = sums.select(*keys, pairs.cast("double").alias("_pairs"), loss.alias("_loss"), F.array(*below).alias("_below"), F.array(*above).alias("_above"))
    return out.filter("_pairs > 0").withColumn("loss", F.col("_loss") / F.col("_pairs"))


def gradients(df: DataFrame, keys: list[str], grade: str, score: str, objective: str = LISTWISE, grades: list[int] | None = None) -> DataFrame:
    """The rows with `gradient` and `hessian` of their group's loss in their own score; rows of groups without a loss are left out."""
    grades = levels(df, grade) if grades is None else grades
    sums = group_sums(df, keys, grade, score, grades, objective)
    s, g = F.col(score), F.col(grade)
    joined = df.join(sums, keys)
    if objective == LISTWISE:
        p = F.exp(s) / F.col("_z")
        slope, curve = p - (F.pow(F.lit(2.0), g) - 1) / F.col("_gain"), p * (1 - p)
    else:
        place = F.array_position(F.array(*[F.lit(v) for v in grades]), g.cast("int")).cast("int")
        win = F.exp(-s) * F.element_at("_below", place) / F.col("_pairs")
        lose = F.exp(s) * F.element_at("_above", place) / F.col("_pairs")
        slope, curve = lose - win, lose + win
    return joined.select(*df.columns, slope.alias("gradient"), curve.alias("hessian"))


class Ranking(Scored):
    """A fitted ranker: scores like any `Scored`; `losses` has (training, validation) mean loss before each round and after the last."""

    def __init__(self, model: GBTRegressionModel, features: list[str], losses: list[tuple[float | None, float | None]]):
        super().__init__(model, features)
        self.losses = losses


def fit(
    train: DataFrame, validation: DataFrame | None, features: list[str], grade: str, group: list[str], objective: str = LISTWISE,
    rounds: int = 20, step: float = 0.3, depth: int = 4, patience: int = 3, seed: int = 7,
) -> Ranking:
    """Boosts trees for `rounds`, or until the validation loss has not fallen for `patience` rounds; trees after the best round are dropped, but for the first.

    Without validation rows the training loss decides."""
    if rounds < 1:
        raise ValueError("at least one round")

    def part(df: DataFrame, val: bool) -> DataFrame:
        named = {f"_x_{i}": F.col(c).cast("double") for i, c in enumerate(features)}
        keys = [F.col(k).alias(f"_g{i}") for i, k in enumerate(group)]
        rows = df.select(*keys, F.col(grade).cast("int").alias("_grade"), *[e.alias(n) for n, e in named.items()]).dropna(subset=["_grade", *[f"_g{i}" for i in range(len(group))]])
        out = VectorAssembler(inputCols=list(named), outputCol="features", handleInvalid="keep").transform(rows)
        return out.drop(*named).withColumn("_val", F.lit(val)).withColumn("_score", F.lit(0.0))

    keys = ["_val", *[f"_g{i}" for i in range(len(group))]]
    state = part(train, False)
    if validation is not None:
        state = state.unionByName(part(validation, True))
    state = stored(state)
    grades = levels(state, "_grade")
    trees, losses, best, best_at = [], [], None, 0
    for at in range(rounds + 1):
        by = {row["_val"]: row["loss"] for row in group_sums(state, keys, "_grade", "_score", grades, objective).groupBy("_val").agg(F.avg("loss").alias("loss")).collect()}
        losses.append((by.get(False), by.get(True)))
        seen = by.get(True, by.get(False))
        if at == 0 and by.get(False) is None:
            raise ValueError("no group has rows of different grades")
        if best is None or seen < best - 1e-12:
            best, best_at = seen, at
        if at == rounds or at - best_at >= patience:
            break
        size = F.greatest("hessian", F.abs("gradient"))
        # rows of groups without a loss go: no later round needs them
        sloped = stored(gradients(state, keys, "_grade", "_score", objective, grades).withColumn("_w", size))
        rows = sloped.filter("NOT _val AND _w > 0").select("features", "_w", (-F.col("gradient") / F.col("_w")).alias("_y"))
        tree = DecisionTreeRegressor(featuresCol="features", labelCol="_y", weightCol="_w", maxDepth=depth, maxBins=MAX_BINS, seed=seed, predictionCol="_tree").fit(rows)
        trees.append(tree)
        moved = tree.transform(sloped).withColumn("_score", F.col("_score") + F.lit(step) * F.col("_tree"))
        state = moved.drop("_tree", "_w", "gradient", "hessian")
    return Ranking(_ensemble(trees[: max(best_at, 1)], step), features, losses)


def _ensemble(trees: list, step: float) -> GBTRegressionModel:
    """The trees as one Spark ML model, scored in one pass."""
    sc = SparkSession.active().sparkContext
    jvm = sc._jvm.org.apache.spark.ml.regression
    own = sc._gateway.new_array(jvm.DecisionTreeRegressionModel, len(trees))
    weights = sc._gateway.new_array(sc._jvm.double, len(trees))
    for i, tree in enumerate(trees):
        own[i], weights[i] = tree._java_obj, float(step)
    made = GBTRegressionModel(jvm.GBTRegressionModel(f"ranker_{trees[0].uid}", own, weights))
    return made.setFeaturesCol("features")


def ndcg(df: DataFrame, group: list[str], score: str, grade: str, k: int, ties: list) -> DataFrame:
    """group, dcg, ideal and ndcg of the best k rows a group; ndcg is null where no row has a grade above 0. `ties` order rows of equal score or grade."""
    gain = (F.pow(F.lit(2.0), F.col(grade)) - 1) / F.log2(F.col("_place") + 1)

    def total(by: str, out: str) -> DataFrame:
        top = select.topk(df, k, group, [F.desc(by), *ties], rank="_place")
        return top.groupBy(*group).agg(F.sum(gain).alias(out))

    both = total(score, "dcg").join(total(grade, "ideal"), group)
    return both.withColumn("ndcg", F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")))
