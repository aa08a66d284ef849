"""Fitted models against small independent fits: stationary points, no worse errors, exact scores."""

import numpy as np
import pytest

from barweave.operators import accounting, calibrate, models

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.RandomState(3)
    x = rng.normal(size=(600, 3)) * [1, 5, 0.2] + [0, 10, -1]
    z = 1.2 * x[:, 0] - 0.3 * (x[:, 1] - 10)
    label = (rng.rand(600) < 1 / (1 + np.exp(-z))).astype(int)
    ret = 0.01 * z + rng.normal(size=600) * 0.01
    p = 1 / (1 + np.exp(-1.8 * z - 0.7))  # over-confident and shifted; no ties
    rows = [(i, *map(float, x[i]), int(label[i]), float(ret[i]), float(p[i]), i // 100) for i in range(600)]
    df = spark.createDataFrame(rows, "row_id int, a double, b double, c double, label int, net double, p double, month_index int").cache()
    return df, df.filter("row_id % 3 <> 0"), df.filter("row_id % 3 = 0")


def columns(df, *names):
    rows = df.orderBy("row_id").select(*names).collect()
    return [np.array([r[n] for r in rows], dtype=float) for n in names]


def brier(p, y):
    return float(((p - y) ** 2).mean())


def test_logistic_is_a_stationary_point(data):
    _, train, test = data
    model = models.logistic(train, FEATURES)
    a, b, c, y = columns(train, *FEATURES, "label")
    raw = np.stack([a, b, c], axis=1)
    x = (raw - raw.mean(axis=0)) / raw.std(axis=0)
    weight = np.where(y == 1, min(50.0, (y == 0).sum() / (y == 1).sum()), 1.0)
    w, b0 = model.model.coefficients.toArray(), model.model.intercept
    p = 1 / (1 + np.exp(-(x @ w + b0)))
    gap = weight * (p - y)
    gradient = np.append((gap[:, None] * x).sum(axis=0) / weight.sum() + 1e-3 * w, gap.sum() / weight.sum())
    assert abs(gradient).max() < 1e-4
    # the scores are those of the coefficients table, on raw rows
    table = {r.feature: r for r in model.coefficients().collect()}
    ta, tb, tc, s = columns(model.score(test, "s"), *FEATURES, "s")
    z = table["intercept"].weight + sum((v - table[f].mean) / table[f].stddev * table[f].weight for f, v in zip(FEATURES, (ta, tb, tc)))
    assert abs(s - 1 / (1 + np.exp(-z))).max() < 1e-9
    importance = {r.feature: r.importance for r in model.importance().collect()}
    assert importance["a"] > importance["c"] and all(importance[f] == pytest.approx(abs(table[f].weight)) for f in FEATURES)


def test_boosted_trees_beat_the_base_rate(data):
    _, train, test = data
    model = models.gbt(train, test, FEATURES, "classifier", "label")
    scored = model.score(test, "s")
    s, y = columns(scored, "s", "label")
    assert brier(s, y) < 0.9 * brier(np.full(len(y), y.mean()), y)
    assert accounting.auc(scored, "s").first().auc > 0.75
    importance = {r.feature: r.importance for r in model.importance().collect()}
    assert sum(importance.values()) == pytest.approx(1) and importance["c"] < min(importance["a"], importance["b"])
    # the validation rows end the fit before the last round
    stopped = models.gbt(train, test, FEATURES, "classifier", "label", max_iter=60)
    assert stopped.model.getNumTrees < 60


def test_ranker_orders_by_relevance(data):
    _, train, test = data
    s, net = columns(models.rank(train, test, FEATURES, "net").score(test, "s"), "s", "net")
    assert np.corrcoef(s.argsort().argsort(), net.argsort().argsort())[0, 1] > 0.5
    assert ((s - net) ** 2).mean() < 0.8 * net.var()


def test_ensemble_is_the_mean_of_its_windows(data):
    df, train, test = data
    fit = lambda part: models.logistic(part, FEATURES)
    got = columns(models.ensemble(train, [0, 2, 2], fit, test, "m"), "m")[0]
    whole = columns(fit(train).score(test, "s"), "s")[0]
    late = columns(fit(train.filter("month_index > 3")).score(test, "s"), "s")[0]
    assert abs(got - (whole + late) / 2).max() < 1e-12


def test_meta_filter_gates_only_when_it_helps(data):
    df, train, test = data
    rows, verdict = models.meta_filter(train, test, test, FEATURES, 0.5, 1)
    assert verdict.first().enabled
    p, kept, net = columns(rows, "meta_probability", "meta_kept", "net")
    assert ((p >= 0.5) == (kept == 1)).all() and net[kept == 1].mean() > net.mean()
    rows, verdict = models.meta_filter(train, test, test, FEATURES, 0.5, 10_000)
    assert not verdict.first().enabled and verdict.first().reason == "too_few_trades" and rows.filter("NOT meta_kept").count() == 0


def test_platt_and_isotonic(data):
    _, train, test = data
    p, y = columns(train, "p", "label")
    platt = columns(calibrate.platt(train, train, "p"), "calibrated_probability")[0]
    odds = np.log(p / (1 - p))
    assert abs(np.array([(platt - y).mean(), ((platt - y) * odds).mean()])).max() < 1e-3
    iso = columns(calibrate.isotonic(train, train, "p"), "calibrated_probability")[0]
    order = np.argsort(p)
    assert (np.diff(iso[order]) >= -1e-12).all()
    # pool adjacent violators
    blocks = []
    for v in y[order]:
        blocks.append([v, 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            v2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + v2, blocks[-1][1] + n2]
    want = np.concatenate([np.full(int(n), v / n) for v, n in blocks])
    assert abs(iso[order] - want).max() < 1e-9
    tp, ty = columns(test, "p", "label")
    for fit in (calibrate.platt, calibrate.isotonic):
        assert brier(columns(fit(train, test, "p"), "calibrated_probability")[0], ty) <= brier(tp, ty)
        assert brier(columns(fit(train, train, "p"), "calibrated_probability")[0], y) <= brier(p, y)
