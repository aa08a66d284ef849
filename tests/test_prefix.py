import random

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from barweave.operators import accounting, prefix, quantiles


def sample(n=3000, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rnd.random() < 0.4 else rnd.choice("abc")
        value = 7.0 if rnd.random() < 0.3 else float(rnd.randint(0, 500))
        rows.append((key, value, i, rnd.random()))
    return rows


def test_prefix_equals_one_big_window(spark):
    pdf = pd.DataFrame(sample(), columns=["k", "v", "id", "x"])
    df = spark.createDataFrame(pdf)
    got = prefix.ordered(
        df, ["k"], ["v", "id"], partitions=7, sums={"s": F.col("x")}, maxes={"m": F.col("x")}, rank="r", total="n",
        previous={"before": F.col("id")}, key_sums={"whole": F.col("x")},
    ).toPandas().sort_values("id").reset_index(drop=True)
    want = pdf.sort_values(["k", "v", "id"])
    g = want.groupby("k")
    want = want.assign(
        s=g["x"].cumsum(), m=g["x"].cummax(), r=g.cumcount() + 1, n=g["x"].transform("size"), before=g["id"].shift(), whole=g["x"].transform("sum")
    ).sort_values("id").reset_index(drop=True)
    assert (got["r"] == want["r"]).all() and (got["n"] == want["n"]).all()
    np.testing.assert_allclose(got["s"], want["s"])
    np.testing.assert_allclose(got["m"], want["m"])
    np.testing.assert_allclose(got["whole"], want["whole"])
    assert got["before"].fillna(-1).astype(int).tolist() == want["before"].fillna(-1).astype(int).tolist()


def test_prefix_without_key_and_descending(spark):
    pdf = pd.DataFrame(sample(800, 2), columns=["k", "v", "id", "x"])
    got = prefix.ordered(spark.createDataFrame(pdf), [], [F.desc("v"), "id"], partitions=5, rank="r").toPandas()
    want = pdf.sort_values(["v", "id"], ascending=[False, True])["id"].tolist()
    assert got.sort_values("r")["id"].tolist() == want


def test_one_key_is_spread_over_buckets(spark):
    df = spark.range(4000).select(F.lit("hot").alias("k"), F.col("id"))
    sizes = [row["n"] for row in prefix.ranged(df, ["k"], ["id"], 8).groupBy(prefix.BUCKET).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) < 1000


def test_quantiles_match_linear_interpolation(spark):
    pdf = pd.DataFrame(sample(1500, 3), columns=["k", "v", "id", "x"])
    qs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.925, "e": 1.0}
    got = quantiles.exact(spark.createDataFrame(pdf), ["k"], "v", qs).toPandas().set_index("k")
    for key, part in pdf.groupby("k"):
        np.testing.assert_allclose(got.loc[key, list(qs)].astype(float), np.quantile(part["v"], list(qs.values())))


def test_weighted_quantile_repeats_values(spark):
    df = spark.createDataFrame([(1.0, 3), (2.0, 0), (5.0, 2), (9.0, 1)], "v double, w int")
    got = quantiles.exact(df, [], "v", {"m": 0.5, "h": 0.9}, weight="w").first()
    np.testing.assert_allclose([got["m"], got["h"]], np.quantile([1, 1, 1, 5, 5, 9], [0.5, 0.9]))


def test_ranks_of_several_scopes_order_the_rows_once(spark, monkeypatch):
    rows = [(i, (i * 37) % 101 if i % 11 else None, i % 3 if i % 7 else None, 0 if i % 2 else i % 5) for i in range(1500)]
    df = spark.createDataFrame(rows, "id int, v int, a int, b int")
    calls = []
    ranged = prefix.ranged
    monkeypatch.setattr(prefix, "ranged", lambda *args, **kw: calls.append(args) or ranged(*args, **kw))
    order = [F.desc("v"), F.col("id")]
    got = prefix.ranks(df, order, {"a": "a", "b": "b"}, "r_{}", "n_{}").collect()
    assert len(calls) == 1 and len(got) == len(rows)
    want = df
    for c in "ab":
        whole = Window.partitionBy(c)
        want = want.withColumn(f"r_{c}", F.row_number().over(whole.orderBy(*order))).withColumn(f"n_{c}", F.count(F.lit(1)).over(whole))
    assert {r.id: tuple(r) for r in got} == {r.id: tuple(r) for r in want.collect()}


def test_running_highs_shuffle_their_rows_once(spark):
    """The totals and the rows of a running maximum of sums share a shuffle, which carries the rows and not a number for each sum."""
    df = spark.range(300).selectExpr("id % 3 AS k", "id AS at", "id % 5 AS level", "id % 7 - 3D AS profit")
    got = accounting.nested_drawdowns(df, ["k"], ["at"], "level", 4)
    rows = got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in plan and plan.count("FileScan") == 1
    for r in rows:
        equity, peak, fall = 10_000.0, 10_000.0, 0.0
        for x in (x for x in range(300) if x % 3 == r.k and x % 5 >= r.i):
            equity += x % 7 - 3
            peak = max(peak, equity)
            fall = max(fall, (peak - equity) / peak)
        assert abs(r.max_drawdown - fall) < 1e-12
