import math
import random

import pytest
from pyspark.sql import functions as F

from barweave.operators import accounting, ledger, reports, research, select, thresholds
from barweave.sources import candidates as arts


def test_penalties(spark):
    df = spark.createDataFrame(
        [(120, 12.0, 0.10, 0.8, 0.9, 0.8, 120.0)],
        "trades int, profit double, max_drawdown double, profit_top1 double, profit_top3 double, trade_top1 double, cost_drag double",
    )

    def value(c):
        return df.select(c).first()[0]

    avg = F.col("profit") / F.col("trades")
    assert value(thresholds.penalised(avg, drawdown=0.5, trade_count=0.1, target_trades=100)) == pytest.approx(0.1 - 0.05 - 2.0)
    assert value(thresholds.penalised(F.lit(5.0), top1=2.0, top3=1.0)) == pytest.approx(5.0 - 1.6 - 0.9)
    capped = thresholds.penalised(F.lit(5.0), trade_top1=0.5, trade_top1_cap=0.75)
    assert value(capped) == pytest.approx(5.0 - 0.4 - 0.05 / 0.25)
    assert value(thresholds.penalised(F.lit(100.0), stress_multiplier=2.0, stress_weight=0.5)) == pytest.approx(40.0)


def test_balanced_profit(spark):
    df = spark.createDataFrame([(5, 100.0), (75, 95.0)], "trades int, profit double")
    sparse, dense = [r[0] for r in df.select(thresholds.objective("profit_balanced", target_trades=75)).collect()]
    assert sparse < dense == pytest.approx(95.0)


def test_score_grid_has_the_count_from_the_top(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 91)], "s double")
    assert 86.0 in thresholds.values_of(thresholds.score_grid(df, "s", -1e9, (5,)))


def swept(spark, rows):
    cols = "threshold_index int, threshold double, trades int, objective double, active_days int, profit_top1 double, trade_top1 double, floor_snapped boolean"
    return spark.createDataFrame(rows, cols).withColumn("flags", F.array().cast("array<string>"))


def test_tie_breaks(spark):
    quiet_broad = swept(spark, [(1, 0.001, 75, 0.4, 2, 0.0, 0.0, False), (2, 0.002, 75, 0.4, 5, 0.0, 0.0, False)])
    assert thresholds.choose_tied(quiet_broad, [], "balanced").first().threshold == 0.002
    diverse = swept(spark, [(1, 0.1, 54, 314.0, 8, 0.75, 0.85, False), (2, 0.2, 70, 249.0, 8, 0.46, 0.55, False)])
    assert thresholds.choose_tied(diverse, [], "diversified", 0.25).first().threshold == 0.2
    snapped = swept(spark, [(1, 0.1, 40, 100.0, 8, 0.4, 0.4, True), (2, 0.2, 34, 94.0, 8, 0.4, 0.4, False)])
    assert thresholds.choose_tied(snapped, [], "avoid_floor_snap", 0.10).first().threshold == 0.2


def trades(spark, n=20):
    rows = []
    for i in range(n):
        rows.append(
            (f"r{i:02d}", "AAAUSDT" if i < 2 else "BBBUSDT", "2026-01" if i < 2 else "2026-02", f"d{i}", i * 60000, 1 if i < 2 else 0, 1.0 - i * 0.01,
             1000.0, 0.02 if i == 0 else (0.03 if i == 1 else -0.01), int(i < 5), int(i < 3))
        )
    df = spark.createDataFrame(
        rows, "row_id string, symbol string, month string, trade_day string, open_time bigint, label int, trade_score double, position_size double, trade_return double, raw_signal int, executed int"
    )
    return accounting.with_returns(df)


def test_ranking_tail(spark):
    got = {r.bucket: r for r in reports.ranking(trades(spark), ["trade_score"]).collect()}
    assert got["score_decile_01"].rows == 2 and got["score_decile_01"].avg_net_return == pytest.approx(0.0235)
    assert got["score_decile_01"].profit == pytest.approx(47.0) and got["score_decile_01"].top_symbol_share == 1.0
    assert got["top_5pct"].avg_net_return == pytest.approx(0.0185) and got["raw_candidates"].rows == 5


def test_decile_bounds(spark):
    for n in (7, 23, 100):
        rows = [(f"r{i}", "S", i, float(i), 0.0, 0.0, 0.0) for i in range(n)]
        df = spark.createDataFrame(rows, "row_id string, symbol string, open_time bigint, s double, gross double, net double, profit double")
        got = {r.decile: r["rows"] for r in reports.deciles(df, ["s"]).collect()}
        want = {d: d * n // 10 - (d - 1) * n // 10 for d in range(1, 11)}
        assert got == {d: c for d, c in want.items() if c}


def test_drawdown_matches_a_loop(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.uniform(-900, 800)) for i in range(400)]
    equity = peak = 10_000.0
    worst = 0.0
    for _, p in rows:
        equity += p
        peak = max(peak, equity)
        worst = max(worst, (peak - equity) / peak)
    got = accounting.drawdown(spark.createDataFrame(rows, "i int, profit double"), [], ["i"]).first()
    assert got.max_drawdown == pytest.approx(worst)


def test_auc_with_ties_counts_positives_last(spark):
    df = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.2, 0), (0.9, 1)], "s double, label int")
    assert accounting.auc(df, "s").first().auc == pytest.approx(1.0)
    assert accounting.auc(df.filter("label = 1"), "s").first().auc == 0.0


def test_gross_return_prefers_the_dynamic_exit(spark):
    df = spark.createDataFrame([("0.05", 0.01), (" ", 0.01), (None, 0.02)], "dynamic_trade_return string, trade_return double")
    assert [r[0] for r in df.select(accounting.gross_return(df)).collect()] == [0.05, 0.01, 0.02]


def test_leave_symbol_out_matches_filtering(spark):
    df = trades(spark, 40).withColumn("predicted_return", F.lit(0.0))
    names = research.top_symbols(df, 8)
    got = {r.removed_symbol: r for r in research.leave_symbol(df, names).collect()}
    for name in names:
        want = accounting.portfolio(df.filter(F.col("symbol") != name), []).first()
        row = got[name]
        for c in ("trade_count", "active_days", "active_symbols"):
            assert row[c] == want[c]
        for c in ("portfolio_profit", "avg_net_return", "win_rate", "max_drawdown"):
            assert row[c] == pytest.approx(want[c])


def test_decision_reasons(spark):
    exps = spark.createDataFrame([("baseline_executed_trades", 0.01), ("variant", 0.02)], "experiment string, portfolio_return double")
    phases = spark.createDataFrame([("selection", 40, 2)], "phase string, trade_count int, active_folds int")
    audit = spark.createDataFrame([("execution_open_time", 0.05)], "scope string, selected_replaceable_share double")
    costs = spark.createDataFrame([("variant", "double_cost", -0.01)], "experiment string, cost_scenario string, portfolio_return double")
    row = research.decision(exps, phases, audit, costs).first()
    assert row.reasons == "selection_underpowered;candidate_reselection_sparse;cost_stress_failed" and row.promoted_experiment == ""
    good = research.decision(
        exps, spark.createDataFrame([("selection", 400, 5)], phases.schema), spark.createDataFrame([("execution_open_time", 0.5)], audit.schema),
        spark.createDataFrame([("variant", "double_cost", 0.01)], costs.schema),
    ).first()
    assert good.decision == "offline_variant_candidate" and good.promoted_experiment == "variant"


def test_pool_filters(spark):
    stage = arts.PRE_FILTER_STAGE
    rows = [(i, stage, 1, e, s, 0, 0, 0) for i, (e, s) in enumerate([(1, 1), (0, 1), (1, 0), (0, 0)])]
    df = spark.createDataFrame(
        rows, "id int, candidate_serialization_stage string, selected_by_threshold int, selected_by_score_edge int, selected_by_symbol_filter int, raw_signal int, predicted int, selected_by_topk int"
    )
    assert [select.pool(df, e, s).count() for e, s in ((True, True), (False, True), (True, False), (False, False))] == [1, 2, 2, 4]


def test_ledger_matches_a_loop(spark):
    rnd = random.Random(6)
    rows = []
    for i in range(150):
        start = rnd.randint(0, 3000) * 60000
        rows.append((f"t{i:03d}", f"c{i}", rnd.choice("ABC"), "fold_1", start, start + rnd.randint(1, 400) * 60000, rnd.uniform(10, 900), rnd.uniform(-0.3, 0.3)))
    df = spark.createDataFrame(
        rows, "trade_id string, candidate_id string, symbol string, fold_id string, open_time bigint, close_time bigint, notional double, gross_return double"
    )
    events = ledger.from_trades(df).orderBy("event_sequence").collect()
    assert [e.event_sequence for e in events] == list(range(300))
    peak, under, deepest, longest, recovery, held, share = events[0].equity, None, 0.0, 0.0, 0.0, {}, 0.0
    for e in events:
        if e.equity >= peak:
            if under is not None:
                recovery, under = max(recovery, e.timestamp - under), None
            peak = e.equity
        else:
            under = e.timestamp if under is None else under
            deepest, longest = max(deepest, (peak - e.equity) / peak), max(longest, e.timestamp - under)
        sign = 1 if e.event_type == ledger.OPEN else -1
        held[e.symbol] = max(0.0, held.get(e.symbol, 0.0) + sign * e.position_notional)
        share = max(share, max(held.values()) / e.equity)
    got = ledger.reconcile(ledger.from_trades(df)).first()
    assert got.max_drawdown == pytest.approx(deepest)
    assert got.longest_underwater_minutes == longest and got.time_to_recovery_minutes == recovery
    assert got.maximum_per_symbol_exposure == pytest.approx(share)
    assert got.status == "passed" and events[-1].concurrent_position_count == 0 and math.isclose(events[-1].total_open_exposure, 0, abs_tol=1e-6)


def test_execution_audit(spark):
    df = spark.createDataFrame(
        [(0, 0, 1000.0, 0), (1, 60000, 1000.0, 1), (2, 0, 1000.0, 1)], "pos int, open_time bigint, position_size double, selected int"
    )
    row = reports.execution_audit(df, ["pos"], 5, 1).first()
    assert (row.time_decreases, row.max_backward_minutes, row.bucket_count, row.max_bucket_size) == (1, 1.0, 2, 2)
    assert (row.top_k_violations, row.max_open_positions, row.max_open_capital) == (0, 2, 2000.0)


def test_fold_table(spark):
    df = spark.createDataFrame(
        [(1, 2, 10.0, 0.02, 0.002, 0.5), (2, 0, 0.0, 0.0, 0.0, float("-inf")), (3, 1, -5.0, -0.01, -0.001, 0.1)],
        "fold int, trade_count int, portfolio_profit double, portfolio_return double, avg_net_return double, objective double",
    )
    row = reports.aggregate_folds(df).first()
    assert (row.active_folds, row.finite_objectives, row.nonfinite_objectives) == (2, 2, 1)
    assert row.profit_per_active_fold == pytest.approx(2.5)
    assert [r[0] for r in df.orderBy("fold").select(reports.fold_status()).collect()] == ["active_profitable", "inactive", "active_losing"]
