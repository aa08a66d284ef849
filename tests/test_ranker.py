"""The boosted ranker: gradients against finite differences and pairs, fits against a planted order and a regression."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barweave.operators import models, ranker

FEATURES = ["a", "b"]


def brute_loss(rows, objective):
    """Mean loss over groups of rows (group, grade, score)."""
    groups = {}
    for g, y, s in rows:
        groups.setdefault(g, []).append((y, s))
    out = {}
    for g, own in groups.items():
        if objective == ranker.PAIRWISE:
            pairs = [math.exp(t - s) for y, s in own for z, t in own if y > z]
            if pairs:
                out[g] = sum(pairs) / len(pairs)
        else:
            gain = [2.0**y - 1 for y, _ in own]
            if sum(gain):
                z = sum(math.exp(s) for _, s in own)
                out[g] = -sum(w / sum(gain) * math.log(math.exp(s) / z) for w, (_, s) in zip(gain, own))
    return out


@pytest.mark.parametrize("objective", [ranker.LISTWISE, ranker.PAIRWISE])
def test_gradients_are_finite_differences(spark, objective):
    """Also with a third of the rows in one group, a group of one row, of one grade and of zeros."""
    rng = np.random.RandomState(5)
    rows = [(0 if i % 3 == 0 else int(rng.randint(1, 9)), int(rng.choice([0, 1, 3, 4])), float(rng.normal())) for i in range(120)]
    rows += [(20, 3, 0.4), (21, 1, 0.1), (21, 1, 0.9), (22, 0, 0.3), (22, 0, -0.3)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, g int, y int, s double")
    got = {r.i: (r.gradient, r.hessian) for r in ranker.gradients(df, ["g"], "y", "s", objective).collect()}
    losses = brute_loss(rows, objective)
    assert {rows[i][0] for i in got} == set(losses)
    for i, (slope, curve) in got.items():
        g, y, s = rows[i]
        mine = [(h, z, t) for h, z, t in rows if h == g]
        at = mine.index((g, y, s))

        def moved(by):
            return brute_loss([*mine[:at], (g, y, s + by), *mine[at + 1 :]], objective)[g]

        assert slope == pytest.approx((moved(1e-5) - moved(-1e-5)) / 2e-5, abs=1e-6)
        assert curve == pytest.approx((moved(1e-3) - 2 * moved(0) + moved(-1e-3)) / 1e-6, abs=1e-4)
    sums = ranker.group_sums(df, ["g"], "y", "s", ranker.levels(df, "y"), objective)
    assert {r.g: pytest.approx(r.loss) for r in sums.collect()} == losses


@pytest.fixture(scope="module")
def planted(spark):
    """Grades follow b within a group; a is large and belongs to the group, so a regression spends its trees on it."""
    rng = np.random.RandomState(8)
    rows = []
    for g in range(150):
        base = float(rng.normal() * 3)
        b = rng.normal(size=8)
        order = (b + rng.normal(size=8) * 0.3).argsort().argsort()
        # in a group with a large base all rows have high grades, in others low ones
        for i in range(8):
            grade = int(min(4, max(0, (3 if base > 0 else 0) + (1 if order[i] >= 6 else 0))))
            rows.append((g * 8 + i, g, base, float(b[i]), grade))
    df = spark.createDataFrame(rows, "row_id int, g int, a double, b double, grade int").cache()
    return df.filter("g % 3 = 0"), df.filter("g % 3 = 1"), df.filter("g % 3 = 2")


def mean_ndcg(df):
    return ranker.ndcg(df, ["g"], "s", "grade", 2, [F.desc("row_id")]).agg(F.avg("ndcg")).first()[0]


@pytest.mark.parametrize("objective", [ranker.LISTWISE, ranker.PAIRWISE])
def test_ranker_beats_a_regression_on_the_grade(planted, objective):
    train, val, test = planted
    model = ranker.fit(train, val, FEATURES, "grade", ["g"], objective, rounds=5, depth=2)
    got = mean_ndcg(model.score(test, "s"))
    flat = mean_ndcg(models.rank(train, val, FEATURES, "grade", max_iter=5, depth=2).score(test, "s"))
    assert got > flat and got > 0.85
    first, last = model.losses[0], model.losses[-1]
    assert last[0] < first[0] and last[1] < first[1]
    weight = {r.feature: r.importance for r in model.importance().collect()}
    assert weight["b"] > 0.7


def test_ranker_stops_and_rejects(spark, planted):
    train, val, _ = planted
    noise = val.withColumn("grade", F.pmod(F.xxhash64("row_id"), F.lit(5)).cast("int"))
    model = ranker.fit(train, noise, FEATURES, "grade", ["g"], rounds=8, depth=2, patience=1)
    assert model.model.getNumTrees < 8
    with pytest.raises(ValueError, match="different grades"):
        ranker.fit(train.limit(0), None, FEATURES, "grade", ["g"])
    with pytest.raises(ValueError, match="levels"):
        ranker.fit(train.withColumn("grade", F.col("row_id")), None, FEATURES, "grade", ["g"])
    with pytest.raises(ValueError, match="unknown objective"):
        ranker.gradients(train.withColumn("s", F.lit(0.0)), ["g"], "grade", "s", "other")


def test_ndcg_by_hand(spark):
    df = spark.createDataFrame([(1, 1, 0.9, 0), (2, 1, 0.8, 4), (3, 1, 0.1, 1), (4, 2, 0.5, 0)], "row_id int, g int, s double, y int")
    got = {r.g: r for r in ranker.ndcg(df, ["g"], "s", "y", 2, [F.col("row_id")]).collect()}
    assert got[1].dcg == pytest.approx(15 / math.log2(3)) and got[1].ideal == pytest.approx(15 + 1 / math.log2(3))
    assert got[2].ndcg is None
