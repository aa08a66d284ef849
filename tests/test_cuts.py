"""Ranks found by cut rows: against a plain sort, with ties in every column, and without ordering the exploded rows."""

import random

from pyspark.sql import functions as F

from barweave.operators import cuts, prefix, reports, thresholds

TIES = ["t", "s"]


def test_cut_rows_equal_a_sort(spark):
    random.seed(4)
    # ties in value, in value and t, and whole copies of rows
    rows = [(k, float(random.choice([0, 0, 1, 2, 5])), random.choice([1, 1, 2]), random.choice("ab"), i) for k in "xyz" for i in range(7 if k == "z" else 90)]
    df = cuts.frozen(spark.createDataFrame(rows, "k string, v double, t int, s string, i int"))
    n = F.col("_n")
    ranks = [F.floor(n * j / 10) for j in range(1, 10)] + [F.ceil(n / 100), n]
    for sign in (1, -1):
        wanted = cuts.places(cuts.sizes(df, ["k"]), ["k"], ranks)
        placed = cuts.cut(df, ["k"], sign * F.col("v"), TIES, wanted, len(ranks))
        got = placed.select("k", "_v", *TIES, cuts.ID, cuts.below(TIES, 0, 9).alias("d"), cuts.below(TIES, 9, 11).alias("h")).collect()
        for k in "xyz":
            mine = sorted((r for r in got if r.k == k), key=lambda r: (r._v, r.t, r.s, r[cuts.ID]))
            size = len(mine)
            for at, r in enumerate(mine, 1):
                assert r.d == sum(size * j // 10 < at for j in range(1, 10))
                assert r.h == (-(-size // 100) < at) + (size < at)


def test_rankings_order_no_exploded_rows(spark, monkeypatch):
    seen = []
    ranged = prefix.ranged
    monkeypatch.setattr(prefix, "ranged", lambda df, *a, **k: seen.append(df.count()) or ranged(df, *a, **k))
    rows = [(f"S{i % 5}", "2024-01", "2024-01-01", i // 40, str(i), i % 2, 0.01, 0.01 - i % 3 * 0.01, 1.0, 1.0, 1, i % 2, i % 10 / 10, i % 7 / 7) for i in range(400)]
    names = "symbol string, month string, trade_day string, open_time int, row_id string, label int, gross double, net double, profit double, position_size double, raw_signal int, executed int, a double, b double"
    df = spark.createDataFrame(rows, names)
    assert reports.ranking(df, ["a", "b"]).filter("bucket = 'top_25pct'").select("rows").distinct().collect()[0][0] == 100
    assert {r.rows for r in reports.deciles(df, ["a", "b"]).collect()} == {40}
    assert max(seen) < 200  # 800 exploded rows


def test_sweep_repeats_no_row_and_orders_no_exploded_rows(spark, monkeypatch):
    seen = []
    ranged = prefix.ranged
    monkeypatch.setattr(prefix, "ranged", lambda df, *a, **k: seen.append(df.count()) or ranged(df, *a, **k))
    random.seed(7)
    rows = [(i % 2, f"S{i % 5}", f"d{i % 9}", i // 3, str(i), i % 2, random.uniform(-0.1, 0.1), 40_000.0 * random.uniform(-0.1, 0.1), i % 11 / 10) for i in range(300)]
    df = spark.createDataFrame(rows, "fold int, symbol string, trade_day string, open_time int, row_id string, label int, net double, profit double, p double")
    df = df.withColumn("gross", F.col("net")).withColumn("position_size", F.lit(1.0))
    got = thresholds.sweep(df, [0.2, 0.5, 0.9], "p", ["fold"], tails=True, drawdown_order=["open_time", "symbol", "row_id"]).collect()
    assert max(seen) <= 300
    for g in got:
        hits = sorted((r for r in rows if r[0] == g.fold and r[8] >= g.threshold), key=lambda r: (r[3], r[1], r[4]))
        equity, peak, fall = 10_000.0, 10_000.0, 0.0
        for r in hits:
            equity += r[7]
            peak = max(peak, equity)
            fall = max(fall, (peak - equity) / peak)
        assert abs(g.max_drawdown - fall) < 1e-9
        best = sorted(hits, key=lambda r: (-r[8], r[3], r[1], r[4]))
        for name, share in (("top_1pct_net", 0.01), ("top_decile_net", 0.1)):
            n = max(1, -int(-len(hits) * share // 1))
            assert abs(g[name] - sum(r[6] for r in best[:n]) / n) < 1e-9


def test_sweep_reads_its_rows_once(spark):
    """Whatever the sweep adds, the rows' source is read when they are written, and by none of its tables."""
    df = spark.range(200).selectExpr(
        "cast(id % 2 as int) AS fold", "concat('S', id % 7) AS symbol", "concat('d', id % 9) AS trade_day", "id * 43200000 AS open_time", "cast(id AS string) AS row_id", "cast(id % 2 AS int) AS label",
        "id % 5 / 100 - 0.02 AS net", "id % 5 / 100 AS gross", "id * 1.5D AS position_size", "id % 5 * 10 - 20D AS profit", "id % 11 / 10 AS p",
    )
    for more in ({}, {"short_history_days": 50, "drawdown_order": ["open_time", "symbol", "row_id"]}, {"tails": True}):
        got = thresholds.sweep(df, [0.2, 0.5], "p", ["fold"], **more)
        assert "Range (0, 200" not in got._jdf.queryExecution().optimizedPlan().toString()
        rows = df.collect()
        for g in got.collect():
            hits = [r for r in rows if r.fold == g.fold and r.p >= g.threshold]
            assert g.trades == len(hits) and g.active_days == len({r.trade_day for r in hits})
            assert abs(g.cost_drag - sum((r.gross - r.net) * r.position_size for r in hits)) < 1e-6
            if more.get("short_history_days"):
                first = {s: min(r.open_time for r in rows if r.symbol == s) for s in {r.symbol for r in rows}}
                assert abs(g.short_history_share - sum(r.open_time - first[r.symbol] < 50 * 86_400_000 for r in hits) / len(hits)) < 1e-9
