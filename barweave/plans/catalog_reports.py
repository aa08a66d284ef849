"""Thresholds, accounting, calibration and report tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import day_of, rnd
from ..operators import accounting, calibrate, features, labels, prefix, reports, select, thresholds
from ..session import scratch, stored
from .bindings import LEADERS, r, with_tables
from .catalog_bars import FEATURE_SQL, LEADER_CTE, LEADER_MAP, OUT_CTE, STEPS_CTE, TARGET, WINDOW, ret
from .registry import query

INF = float("inf")


def n_rows(name: str = "rows"):
    return F.count(F.lit(1)).alias(name)


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def rounded(df: DataFrame, keep: list[str], digits: dict[str, int]) -> DataFrame:
    return df.select(*keep, *[rnd(c, d).alias(c) for c, d in digits.items()])


def finite(c: str):
    """Null in place of an infinite factor, which SQL text has no portable form for."""
    return F.when(F.col(c) < INF, rnd(c)).alias(c)


def factor_sql(profit: str = "profit", where: str = "true") -> str:
    gain = f"coalesce(sum({profit}) FILTER (WHERE {profit} > 0 AND {where}), 0.0)"
    loss = f"coalesce(-sum({profit}) FILTER (WHERE {profit} < 0 AND {where}), 0.0)"
    return f"CASE WHEN {loss} = 0 THEN (CASE WHEN {gain} > 0 THEN NULL ELSE 0.0 END) ELSE {r(f'{gain} / {loss}')} END"


def drawdown_cte(name: str, source: str, keys: str, order: str = "open_time, symbol, row_id") -> str:
    by = f"PARTITION BY {keys} " if keys else ""
    head = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""{name} AS (SELECT {head}max((peak - equity) / peak) AS dd, max(peak - equity) AS dd_money FROM (
  SELECT *, greatest(10000.0, max(equity) OVER ({by}ORDER BY {order} ROWS UNBOUNDED PRECEDING)) AS peak FROM (
    SELECT *, 10000.0 + sum(profit) OVER ({by}ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS equity FROM {source})) WHERE peak > 0 {group})"""


# ---------------------------------------------------------------- thresholds

GRID = [round(0.1 * i, 1) for i in range(1, 11)]
GRID_CTE = "grid AS (SELECT CAST(i AS INTEGER) AS i, t AS threshold FROM (VALUES " + ", ".join(
    f"({i}, {t}::DOUBLE)" for i, t in enumerate(GRID, 1)
) + ") v(i, t))"
SWEEP_CTE = """hits AS (SELECT g.i, g.threshold, r.* FROM ret r JOIN grid g ON r.probability >= g.threshold),
per_sym AS (SELECT fold, i, symbol, count(*) AS n, sum(profit) AS p, row_number() OVER (PARTITION BY fold, i ORDER BY count(*) DESC, symbol) AS place,
  row_number() OVER (PARTITION BY fold, i ORDER BY greatest(0.0, sum(profit)) DESC, symbol) AS rich FROM hits GROUP BY 1, 2, 3),
conc AS (SELECT fold, i, max(n) AS top1, sum(n) FILTER (WHERE place <= 3) AS top3, max(greatest(0.0, p)) AS gain1, sum(greatest(0.0, p)) FILTER (WHERE rich <= 3) AS gain3, sum(greatest(0.0, p)) AS gains FROM per_sym GROUP BY 1, 2),
per_day AS (SELECT fold, i, count(*) AS active_days, max(n)::BIGINT AS max_day FROM (SELECT fold, i, trade_day, count(*) AS n FROM hits GROUP BY 1, 2, 3) GROUP BY 1, 2),
sums AS (SELECT fold, i, count(*) AS trades, sum(label)::BIGINT AS tp, sum(profit) AS profit, sum(net) AS net, sum((gross - net) * position_size) AS cost_drag, avg(expected_value) AS ev,
  coalesce(avg(probability) FILTER (WHERE net > 0), 0.0) - coalesce(avg(probability) FILTER (WHERE net <= 0), 0.0) AS score_gap FROM hits GROUP BY 1, 2),
whole AS (SELECT fold, sum(label) AS pos, count(*) AS n FROM ret GROUP BY 1),
sweep AS (SELECT w.fold, g.i, g.threshold, coalesce(trades, 0) AS trades, coalesce(tp, 0) AS tp, coalesce(tp / trades, 0.0) AS precision, coalesce(tp, 0) / pos AS recall,
  2 * coalesce(tp, 0) / (coalesce(trades, 0) + pos) AS f1, coalesce(profit, 0.0) AS profit, coalesce(profit / trades, 0.0) AS avg_profit, coalesce(net / trades, 0.0) AS avg_net,
  coalesce(cost_drag, 0.0) AS cost_drag, coalesce(score_gap, 0.0) AS score_gap, coalesce(active_days, 0) AS active_days, coalesce(max_day, 0) AS max_day,
  coalesce(top1 / trades, 0.0) AS trade_top1, coalesce(top3 / trades, 0.0) AS trade_top3, coalesce(gain1 / gains, 0.0) AS profit_top1, coalesce(gain3 / gains, 0.0) AS profit_top3, coalesce(ev, 0.0) AS ev, coalesce(trades, 0) / n AS signal_share
  FROM whole w CROSS JOIN grid g LEFT JOIN sums s ON s.fold = w.fold AND s.i = g.i LEFT JOIN conc c ON c.fold = w.fold AND c.i = g.i LEFT JOIN per_day d ON d.fold = w.fold AND d.i = g.i)"""
SWEEP = ("ret", GRID_CTE, SWEEP_CTE)


def sweep_sql(sql: str, *more: str) -> str:
    return with_tables("ret", sql, GRID_CTE, SWEEP_CTE, *more)


YOUNG = 500  # days


def swept(t, rows=None, **more):
    return thresholds.sweep(t.returns if rows is None else rows, GRID, "probability", ["fold"], **more)


BASE_GRID = [0.5, 0.6, 0.7, 0.8, 0.9]
QS = ", ".join(str(q) for q in thresholds.GRID_QUANTILES)


def grid_sql(source: str, value: str, counts: tuple, extra: str, clamp: str, floor: str) -> str:
    cs = ", ".join(str(c) for c in counts)
    return f"""WITH RECURSIVE s AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS place, count(*) OVER () AS n FROM ({source})),
    wanted AS (SELECT v FROM s WHERE place IN (SELECT CAST(floor((n - 1) * q) AS BIGINT) FROM (SELECT max(n) AS n FROM s), (SELECT unnest([{QS}]) AS q))
      UNION SELECT v FROM s WHERE n - place IN ({cs}) UNION SELECT max(v) - 1e-12 FROM s {extra}),
    u AS (SELECT DISTINCT {clamp} AS v FROM wanted)
    SELECT {r("v", 5)} AS threshold FROM (SELECT v, lag(v) OVER (ORDER BY v) AS before FROM u WHERE {floor}) WHERE before IS NULL OR v - before > 1e-12"""


query(
    "t01_adaptive_grid",
    grid_sql(
        "SELECT l_quantity / 50 + l_discount / 1000 AS v FROM lineitem WHERE l_quantity / 50 + l_discount / 1000 BETWEEN 0 AND 1", "v",
        (40, 80, *thresholds.GRID_COUNTS), "".join(f" UNION SELECT {b}" for b in BASE_GRID), "greatest(0.0, least(1.0, v))", "true",
    ),
)(
    lambda t: thresholds.grid(
        t.read("lineitem").select((F.col("l_quantity") / 50 + F.col("l_discount") / 1000).alias("s")), "s", BASE_GRID, 40
    ).select(rnd("threshold", 5).alias("threshold"))
)
query(
    "t02_score_grid",
    grid_sql("SELECT l_extendedprice / 100000 AS v FROM lineitem", "v", (5, 20), "", "v", "v >= 0.6"),
)(
    lambda t: thresholds.score_grid(
        t.read("lineitem").select((F.col("l_extendedprice") / 100000).alias("s")), "s", 0.6, (5, 20)
    ).select(rnd("threshold", 5).alias("threshold"))
)

T3 = {"precision": 6, "recall": 6, "f1": 6, "profit": 2, "avg_profit": 4, "avg_net": 6, "cost_drag": 2, "score_gap": 6, "trade_top1": 6, "trade_top3": 6, "profit_top1": 6, "profit_top3": 6, "signal_share": 6}
query(
    "t03_threshold_sweep",
    sweep_sql(
        f"""SELECT CAST(fold AS INTEGER) AS fold, threshold, trades, tp, active_days, max_day AS max_trades_in_day,
        {", ".join(f"{r(c, d)} AS {c}" for c, d in T3.items())} FROM sweep"""
    ),
)(lambda t: rounded(swept(t), ["fold", "threshold", "trades", "tp", "active_days", "max_trades_in_day"], T3))

OBJECTIVES = ("profit", "precision", "recall", "f1", "avg_profit", "ev", "profit_balanced")
OBJ_SQL = {o: f"CASE WHEN trades > 0 THEN {r(o, 3)} END" for o in OBJECTIVES[:-1]}  # ev is a column of the sweep
OBJ_SQL["profit_balanced"] = f"CASE WHEN trades > 0 THEN {r('CASE WHEN profit > 0 THEN profit * least(1.0, trades / 1500) ELSE profit END', 3)} END"
OBJ_SQL["profit_strict"] = f"CASE WHEN trades > 0 THEN {r('profit', 3)} ELSE 0.0 END"


@query("t04_objectives", sweep_sql(f"SELECT CAST(fold AS INTEGER) AS fold, threshold, {', '.join(f'{s} AS {o}' for o, s in OBJ_SQL.items())} FROM sweep"))
def objectives(t):
    s = swept(t)
    cols = {o: thresholds.objective(o, target_trades=1500) for o in OBJECTIVES} | {"profit_strict": thresholds.objective("profit", strict=True)}
    return s.select("fold", "threshold", *[F.when(c > -INF, rnd(c, 3)).alias(o) for o, c in cols.items()])


query(
    "t05_penalties",
    sweep_sql(
        f"""SELECT CAST(fold AS INTEGER) AS fold, threshold, {r('''profit - 10 * greatest(0, trades - 2000) - 2000 * profit_top1 - 100 * trade_top1
        - 50 * greatest(0.0, coalesce(trades / nullif(active_days, 0), 0.0) - 4) - 25 * greatest(0, max_day - 6) - 5 * (profit_top1 + trade_top1)
        - greatest(0.0, trade_top1 - 0.012) / (1.0 - 0.012) - 3000 * profit_top3 - 700 * coalesce(dd, 0.0) - 900 * coalesce(young, 0.0)''', 2)} AS penalised
        FROM sweep LEFT JOIN falls USING (fold, i) LEFT JOIN ages USING (fold, i)""",
        """falls AS (SELECT fold, i, max((peak - equity) / peak) AS dd FROM (SELECT *, greatest(10000.0, max(equity) OVER (PARTITION BY fold, i ORDER BY open_time, symbol, row_id ROWS UNBOUNDED PRECEDING)) AS peak
          FROM (SELECT fold, i, open_time, symbol, row_id, 10000.0 + sum(profit) OVER (PARTITION BY fold, i ORDER BY open_time, symbol, row_id ROWS UNBOUNDED PRECEDING) AS equity FROM hits)) GROUP BY 1, 2)""",
        f"ages AS (SELECT fold, i, avg(CAST(open_time - since < {YOUNG * 86400000} AS INTEGER)) AS young FROM hits JOIN (SELECT symbol, min(open_time) AS since FROM ret GROUP BY 1) USING (symbol) GROUP BY 1, 2)",
    ),
)(
    lambda t: swept(t, short_history_days=YOUNG, drawdown_order=accounting.ORDER).select(
        "fold", "threshold",
        rnd(
            thresholds.penalised(
                F.col("profit"), trade_count=10, target_trades=2000, top1=2000, trade_top1=100, trade_top1_cap=0.012,
                burst_day=50, target_per_day=4, burst_max=25, target_max_in_day=6, diversity=5,
                top3=3000, drawdown=700, short_history=900,
            ),
            2,
        ).alias("penalised"),
    )
)
query(
    "t06_cost_stress_blend",
    sweep_sql(f"SELECT CAST(fold AS INTEGER) AS fold, threshold, {r('profit - 0.5 * (2.0 - 1) * cost_drag', 2)} AS penalised FROM sweep"),
)(
    lambda t: swept(t).select(
        "fold", "threshold", rnd(thresholds.penalised(F.col("profit"), stress_multiplier=2.0, stress_weight=0.5), 2).alias("penalised")
    )
)

FLAGS = {"min_trades": 700, "max_trades": 8000, "min_precision": 0.33, "min_avg_net": 0.0085, "min_score_gap": -0.002, "max_signal_share": 0.9, "max_trade_top1": 0.02, "max_profit_top1": 0.03,
         "max_profit_top3": 0.05, "positive_top_1pct": True, "min_top_decile": 0.0095}
FLAG_SQL = """concat_ws(';', CASE WHEN trades < 700 THEN 'rejected_under_min_trades' END, CASE WHEN trades > 8000 THEN 'rejected_over_max_trades' END,
  CASE WHEN precision < 0.33 THEN 'rejected_under_min_precision' END, CASE WHEN avg_net < 0.0085 THEN 'rejected_under_min_avg_net_return' END,
  CASE WHEN score_gap < -0.002 THEN 'rejected_under_min_score_gap' END, CASE WHEN signal_share > 0.9 THEN 'rejected_over_signal_share' END,
  CASE WHEN trade_top1 > 0.02 THEN 'rejected_over_trade_concentration' END, CASE WHEN profit_top1 > 0.03 THEN 'rejected_over_top1_concentration' END,
  CASE WHEN profit_top3 > 0.05 THEN 'rejected_over_top3_concentration' END, CASE WHEN coalesce(p1, 0.0) < 0 THEN 'rejected_negative_top_1pct' END,
  CASE WHEN coalesce(d1, 0.0) < 0.0095 THEN 'rejected_under_min_top_decile_net_return' END)"""
TAIL_CTES = (
    "ordered AS (SELECT fold, row_number() OVER w AS rk, sum(net) OVER (w ROWS UNBOUNDED PRECEDING) AS s FROM ret WINDOW w AS (PARTITION BY fold ORDER BY probability DESC, open_time, symbol, row_id))",
    "tails AS (SELECT x.fold, i, max(s / rk) FILTER (WHERE rk = greatest(1, ceil(trades * 0.01))) AS p1, max(s / rk) FILTER (WHERE rk = greatest(1, ceil(trades * 0.1))) AS d1 FROM sums x JOIN ordered o ON o.fold = x.fold GROUP BY 1, 2)",
)
query(
    "t07_admission_flags",
    sweep_sql(
        f"SELECT CAST(fold AS INTEGER) AS fold, threshold, {FLAG_SQL} AS flags, {r('coalesce(p1, 0.0)')} AS top_1pct_net, {r('coalesce(d1, 0.0)')} AS top_decile_net FROM sweep LEFT JOIN tails USING (fold, i)",
        *TAIL_CTES,
    ),
)(
    lambda t: swept(t, tails=True).select(
        "fold", "threshold", F.concat_ws(";", thresholds.flags(**FLAGS)).alias("flags"), rnd("top_1pct_net").alias("top_1pct_net"), rnd("top_decile_net").alias("top_decile_net")
    )
)

JUDGED_CTE = """judged AS (SELECT *, concat_ws(';', CASE WHEN precision < 0.33 THEN 'p' END, CASE WHEN trade_top1 > 0.018 THEN 'c' END) AS flags,
  CASE WHEN trades > 0 THEN avg_profit END AS objective FROM sweep)"""


def judged(t, min_precision=0.33, top1=0.018, rows=None):
    s = swept(t, rows)
    return s.withColumn("flags", thresholds.flags(min_precision=min_precision, max_trade_top1=top1)).withColumn(
        "objective", thresholds.objective("avg_profit")
    )


MIN_TRADES = 3000
CHOSEN_CTE = f"""best AS (SELECT * FROM judged WHERE flags = '' AND trades >= {MIN_TRADES} QUALIFY row_number() OVER (PARTITION BY fold ORDER BY objective DESC, i) = 1),
few AS (SELECT * FROM judged WHERE trades > 0 AND trades < {MIN_TRADES} QUALIFY row_number() OVER (PARTITION BY fold ORDER BY objective DESC, i) = 1),
chosen AS (SELECT w.fold, coalesce(b.threshold, f.threshold, 1.01) AS threshold, coalesce(b.trades, f.trades, 0) AS trades, coalesce(b.objective, f.objective) AS objective,
  CASE WHEN b.fold IS NOT NULL THEN 'selected' WHEN f.fold IS NOT NULL THEN 'fallback' ELSE 'no_trade' END AS status
  FROM whole w LEFT JOIN best b ON b.fold = w.fold LEFT JOIN few f ON f.fold = w.fold)"""
query(
    "t08_chosen_threshold",
    sweep_sql(f"SELECT CAST(fold AS INTEGER) AS fold, threshold, trades, {r('objective', 4)} AS objective, status FROM chosen", JUDGED_CTE, CHOSEN_CTE),
)(lambda t: rounded(thresholds.choose(judged(t), ["fold"], MIN_TRADES), ["fold", "threshold", "trades", "status"], {"objective": 4}))

TIES = ("fewer_trades", "balanced", "diversified", "avoid_floor_snap")
TIE_ORDER = {
    "fewer_trades": "trades, objective DESC, i", "balanced": "active_days DESC, objective DESC, i",
    "diversified": "better DESC, profit_top1 + trade_top1, objective DESC, i", "avoid_floor_snap": "snapped, objective DESC, i",
}


def _tie_sql() -> str:
    parts = [
        f"""SELECT '{k}' AS tie, fold, threshold, trades, is_best FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY {o}) AS place FROM near
        {"WHERE better = 1 OR is_best" if k == "diversified" else ""}) WHERE place = 1"""
        for k, o in TIE_ORDER.items()
    ]
    return "SELECT tie, CAST(fold AS INTEGER) AS fold, threshold, trades, is_best AS was_best FROM (" + " UNION ALL ".join(parts) + ")"


@query(
    "t09_tie_breaks",
    sweep_sql(
        _tie_sql(),
        JUDGED_CTE,
        "ok AS (SELECT *, i <= 2 AS snapped FROM judged WHERE flags = '' AND objective IS NOT NULL)",
        "top AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY fold ORDER BY objective DESC, i) = 1)",
        """near AS (SELECT o.*, o.i = t.i AS is_best, CAST(o.profit_top1 <= t.profit_top1 - 0.002 AND o.trade_top1 <= t.trade_top1 - 0.002 AS INTEGER) AS better
          FROM ok o JOIN top t ON t.fold = o.fold WHERE o.objective >= t.objective - abs(t.objective) * 0.25 OR o.i = t.i)""",
    ),
)
def tie_breaks(t):
    s = judged(t).withColumn("floor_snapped", F.col("threshold_index") <= 2)
    parts = [thresholds.choose_tied(s, ["fold"], how, 0.25, 0.002).withColumn("tie", F.lit(how)) for how in TIES]
    return union(parts).select("tie", "fold", "threshold", "trades", "was_best")


@query(
    "t10_no_trade_status",
    sweep_sql(
        """SELECT CAST(w.fold AS INTEGER) AS fold, CASE WHEN b.fold IS NULL THEN 'no_trade' ELSE 'selected' END AS status, b.threshold FROM whole w LEFT JOIN
        (SELECT * FROM judged WHERE flags = '' AND trades >= 4500 AND objective > 0 QUALIFY row_number() OVER (PARTITION BY fold ORDER BY objective DESC, i) = 1) b ON b.fold = w.fold""",
        JUDGED_CTE,
    ),
)
def no_trade_status(t):
    chosen = thresholds.choose(judged(t), ["fold"], 4500, strict=True)
    return chosen.select("fold", "status", thresholds.shown().alias("threshold"))


@query(
    "t11_near_misses",
    sweep_sql(
        f"""SELECT CAST(w.fold AS INTEGER) AS fold, coalesce(c, 0) AS near_miss_count, {r("best")} AS best_avg_net, m.threshold AS near_miss_threshold, m.trades AS near_miss_trades
        FROM (SELECT fold, count_if(f = 'rejected_under_min_avg_net_return')::BIGINT AS c, max(CASE WHEN trades > 0 THEN avg_net END) AS best FROM fl GROUP BY 1) w
        LEFT JOIN (SELECT * FROM fl WHERE f = 'rejected_under_min_avg_net_return' QUALIFY row_number() OVER (PARTITION BY fold ORDER BY avg_net DESC, i) = 1) m ON m.fold = w.fold""",
        """fl AS (SELECT *, concat_ws(';', CASE WHEN trades < 700 THEN 'rejected_under_min_trades' END, CASE WHEN avg_net < 0.0085 THEN 'rejected_under_min_avg_net_return' END) AS f FROM sweep)""",
    ),
)
def near_misses(t):
    s = swept(t).withColumn("flags", thresholds.flags(min_trades=700, min_avg_net=0.0085))
    out = thresholds.near_misses(s, ["fold"])
    return out.select("fold", "near_miss_count", rnd("best_avg_net").alias("best_avg_net"), "near_miss_threshold", "near_miss_trades")


STABILITY_CTES = (
    GRID_CTE,
    SWEEP_CTE,
    JUDGED_CTE,
    "near AS (SELECT * FROM judged QUALIFY row_number() OVER (PARTITION BY fold ORDER BY abs(threshold - (fold / 10 + 0.03)), i) = 1)",
    """stab AS (SELECT CAST(fold AS INTEGER) AS fold, closest AS closest_threshold, n0 AS neighbor_min_trades, n1 AS neighbor_max_trades,
        ((CASE WHEN own > 0 THEN greatest(0.0, least(1.0, a0 / own)) ELSE CAST(a0 >= own AS INTEGER) END) + (CASE WHEN n1 > 0 THEN greatest(0.0, 1 - (n1 - n0) / n1) ELSE 1.0 END) + greatest(0.0, 1 - (c1 - c0)) + ok) / 4 AS stability
        FROM (SELECT j.fold, max(a.threshold) AS closest, max(a.avg_net) AS own, min(j.trades) AS n0, max(j.trades) AS n1, min(j.avg_net) AS a0, min(j.trade_top1) AS c0, max(j.trade_top1) AS c1,
          avg(CAST(j.flags = '' AS INTEGER)) AS ok FROM judged j JOIN near a ON a.fold = j.fold AND abs(a.i - j.i) <= 2 GROUP BY 1))""",
)


def fold_stability(t, rows: DataFrame | None = None) -> DataFrame:
    s = stored(judged(t, rows=rows))  # one row a fold and threshold, read three times
    picked = s.select("fold").distinct().withColumn("selected_threshold", F.col("fold") / 10 + 0.03)
    return thresholds.stability(s, picked, ["fold"])


query(
    "t12_threshold_stability",
    with_tables("ret", f"SELECT fold, closest_threshold, neighbor_min_trades, neighbor_max_trades, {r('stability')} AS stability FROM stab", *STABILITY_CTES),
)(lambda t: rounded(fold_stability(t), ["fold", "closest_threshold", "neighbor_min_trades", "neighbor_max_trades"], {"stability": 6}))


@query(
    "t13_inactive_blockers",
    with_tables(
        "cand",
        f"""SELECT CAST(fold AS INTEGER) AS fold, {r("best")} AS best_score, closest AS closest_symbol, {r("thr - best")} AS gap FROM (
          SELECT fold, max(trade_score) AS best, arg_max(symbol, (trade_score, symbol)) AS closest, 2 * avg(trade_score) AS thr FROM cand GROUP BY 1) WHERE best < thr""",
    ),
)
def inactive_blockers(t):
    c = t.candidates
    chosen = c.groupBy("fold").agg((2 * F.avg("trade_score")).alias("threshold"))
    out = thresholds.blockers(c, chosen, "trade_score", ["fold"])
    return rounded(out, ["fold", "closest_symbol"], {"best_score": 6, "gap": 6})


# ---------------------------------------------------------------- accounting

RATES = {"accuracy": 6, "precision": 6, "recall": 6, "f1": 6}
query(
    "a01_classification",
    with_tables(
        "ret",
        f"""SELECT fold, rows, tp, fp, tn, fn, {r("(tp + tn) / rows")} AS accuracy, {r("coalesce(tp / nullif(tp + fp, 0), 0.0)")} AS precision,
        {r("tp / (tp + fn)")} AS recall, {r("2 * tp / (2 * tp + fp + fn)")} AS f1 FROM (SELECT fold, count(*) AS rows, count_if(predicted AND label = 1)::BIGINT AS tp,
        count_if(predicted AND label = 0)::BIGINT AS fp, count_if(NOT predicted AND label = 0)::BIGINT AS tn, count_if(NOT predicted AND label = 1)::BIGINT AS fn FROM ret GROUP BY 1)""",
    ),
)(lambda t: rounded(accounting.classify(t.returns, ["fold"], F.col("predicted")), ["fold", "rows", "tp", "fp", "tn", "fn"], RATES))

AUC_SQL = "(sum(rk) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label)))"
query(
    "a02_auc",
    with_tables(
        "cand",
        f"""SELECT fold, sum(label)::BIGINT AS positives, (count(*) - sum(label))::BIGINT AS negatives, {r(AUC_SQL)} AS auc FROM (
        SELECT fold, label, row_number() OVER (PARTITION BY fold ORDER BY probability, label) AS rk FROM cand) GROUP BY 1""",
    ),
)(lambda t: rounded(accounting.auc(t.candidates, "probability", keys=["fold"]), ["fold", "positives", "negatives"], {"auc": 6}))
query(
    "a03_sampled_auc",
    with_tables(
        "cand",
        f"""SELECT sum(label)::BIGINT AS positives, (count(*) - sum(label))::BIGINT AS negatives, {r(AUC_SQL)} AS auc FROM (
        SELECT label, row_number() OVER (ORDER BY trade_score, label) AS rk FROM cand)""",
    ),
)(
    # counts for each distinct score make the area over all rows as cheap as one over a sample
    lambda t: rounded(accounting.auc(t.candidates, "trade_score"), ["positives", "negatives"], {"auc": 6})
)


@query(
    "a04_net_return",
    with_tables(
        "art",
        f"""SELECT symbol, count(*) AS rows, {r("avg(coalesce(actual_exit_return, trade_return))")} AS gross, {r("avg(coalesce(actual_exit_return, trade_return) - 0.0015 - 0.001)")} AS net
        FROM (SELECT * REPLACE (CASE WHEN row_position % 2 = 0 THEN actual_exit_return END AS actual_exit_return) FROM art) GROUP BY 1""",
    ),
)
def net_return(t):
    text = F.when(F.col("row_position") % 2 == 0, F.col("actual_exit_return").cast("string")).otherwise(" ")
    df = accounting.with_returns(t.artifact.withColumn("dynamic_trade_return", text), extra=0.001)
    return df.groupBy("symbol").agg(n_rows(), rnd(F.avg("gross")).alias("gross"), rnd(F.avg("net")).alias("net"))


@query(
    "a05_trade_profit",
    with_tables("ret", f"SELECT row_id, {r('CASE WHEN line = 7 THEN 1000.0 ELSE position_size END * net', 4)} AS profit FROM ret"),
)
def trade_profit(t):
    c = t.candidates.withColumn("position_size", F.when(F.col("line") != 7, F.col("position_size")))
    return accounting.with_returns(c).select("row_id", rnd("profit", 4).alias("profit"))


query("a06_profit_factor", with_tables("ret", f"SELECT symbol, fold, {factor_sql()} AS profit_factor FROM ret WHERE predicted GROUP BY 1, 2"))(
    lambda t: t.returns.filter("predicted").groupBy("symbol", "fold").agg(accounting.profit_factor().alias("profit_factor"))
    .select("symbol", "fold", finite("profit_factor"))
)
query(
    "a07_drawdown",
    with_tables("ret", f"SELECT fold, {r('dd')} AS max_drawdown, {r('dd_money', 2)} AS max_drawdown_money FROM d", drawdown_cte("d", "ret", "fold")),
)(
    lambda t: rounded(
        accounting.drawdown(t.returns.select("fold", "open_time", "symbol", "row_id", "profit"), ["fold"], accounting.ORDER),
        ["fold"], {"max_drawdown": 6, "max_drawdown_money": 2},
    )
)
A8 = {
    "win_rate": ("avg(CAST(trade_return > 0 AS INTEGER))", 6), "mean_forward_return": ("avg(forward_return)", 6), "mean_trade_return": ("avg(trade_return)", 6),
    "mean_favorable": ("avg(max_future_high_return)", 6), "mean_adverse": ("avg(max_future_low_return)", 6),
    "profit_after_fee": ("sum(position_size * (trade_return - 0.001))", 2), "profit_after_fee_and_slippage": ("sum(position_size * (trade_return - 0.001 - 0.0005))", 2),
    "median_forward_return": ("quantile_cont(forward_return, 0.5)", 6), "median_trade_return": ("quantile_cont(trade_return, 0.5)", 6),
}
query(
    "a08_trade_statistics",
    with_tables("ret", f"SELECT fold, count(*) AS trades, {', '.join(f'{r(s, d)} AS {c}' for c, (s, d) in A8.items())} FROM ret WHERE predicted GROUP BY 1"),
)(lambda t: rounded(accounting.trade_stats(t.returns.filter("predicted"), ["fold"]), ["fold", "trades"], {c: d for c, (_, d) in A8.items()}))
query(
    "a09_activity",
    with_tables(
        "ret",
        f"""SELECT symbol, count(*) AS trades, count(DISTINCT trade_day) AS active_days, count(DISTINCT month) AS active_months,
        {r("count(*) / count(DISTINCT trade_day)")} AS trades_per_active_day, {r("count(*) / count(DISTINCT month)")} AS trades_per_active_month FROM ret GROUP BY 1""",
    ),
)(
    lambda t: rounded(
        accounting.activity(t.candidates, ["symbol"]), ["symbol", "trades", "active_days", "active_months"],
        {"trades_per_active_day": 6, "trades_per_active_month": 6},
    )
)
PORTFOLIO = {"portfolio_profit": 2, "portfolio_return": 6, "avg_gross_return": 6, "avg_net_return": 6, "win_rate": 6, "max_drawdown": 6}


def portfolio_sql(source: str, key: str, extra: str = "", folds: int = 1) -> str:
    return f"""SELECT s.{key}, count(*) AS trade_count, {r("sum(profit)", 2)} AS portfolio_profit, {r(f"sum(profit) / (10000.0 * {folds})")} AS portfolio_return,
    {r("avg(gross)")} AS avg_gross_return, {r("avg(net)")} AS avg_net_return, {r("avg(CAST(net > 0 AS INTEGER))")} AS win_rate, {factor_sql()} AS profit_factor,
    count(DISTINCT trade_day) AS active_days, count(DISTINCT symbol) AS active_symbols, {r("any_value(dd)")} AS max_drawdown {extra}
    FROM {source} s JOIN dd_{source} d ON d.{key} = s.{key} GROUP BY s.{key}"""


def portfolio_rows(df: DataFrame, *keys: str) -> DataFrame:
    out = rounded(df, [*keys, "trade_count", "active_days", "active_symbols", "profit_factor"], PORTFOLIO)
    return out.withColumn("profit_factor", finite("profit_factor"))


EXECUTED = "ex AS (SELECT * FROM ret WHERE predicted)"
query(
    "a10_portfolio_row",
    with_tables("ret", portfolio_sql("ex", "fold", folds=7), EXECUTED, drawdown_cte("dd_ex", "ex", "fold")),
)(lambda t: portfolio_rows(accounting.portfolio(t.returns.filter("predicted"), ["fold"], folds=7), "fold"))
A11 = {
    "average_gross_return_before_costs": ("avg(gross)", 6), "average_net_return_after_costs": ("avg(net)", 6), "average_cost_drag_per_trade": ("avg(gross - net)", 6),
    "total_cost_drag": ("sum((gross - net) * position_size)", 2), "trade_weighted_gross_return": ("sum(gross * position_size) / sum(position_size)", 6),
    "trade_weighted_net_return": ("sum(net * position_size) / sum(position_size)", 6),
}
query(
    "a11_costs",
    with_tables(
        "ret",
        f"""SELECT fold, {", ".join(f"{r(s, d)} AS {c}" for c, (s, d) in A11.items())}, count_if(net > 0)::BIGINT AS winning_trades, count_if(net <= 0)::BIGINT AS losing_trades FROM ret GROUP BY 1""",
    ),
)(lambda t: rounded(accounting.costs(t.returns, ["fold"]), ["fold", "winning_trades", "losing_trades"], {c: d for c, (_, d) in A11.items()}))


@query(
    "a12_metrics_sink",
    with_tables("ret", f"SELECT fold, count(*) AS rows, count_if(predicted AND label = 1)::BIGINT AS tp, {r('avg(CAST(predicted = (label = 1) AS INTEGER))')} AS accuracy FROM ret GROUP BY 1"),
)
def metrics_sink(t):
    path = scratch(t.spark, "metrics")
    accounting.write_metrics(accounting.classify(t.returns, ["fold"], F.col("predicted")), path)
    return rounded(t.spark.read.parquet(path), ["fold", "rows", "tp"], {"accuracy": 6})


@query(
    "a13_prediction_table",
    with_tables(
        "ret",
        f"""SELECT row_id, CAST(probability >= 0.6 AS INTEGER) AS raw_signal, CAST(probability >= 0.6 AS INTEGER) AS predicted,
        {r("CASE WHEN probability >= 0.6 THEN least(1000.0, quote_volume * 0.01) ELSE 0.0 END", 3)} AS position_size FROM ret""",
    ),
)
def prediction_table(t):
    path = scratch(t.spark, "predictions")
    accounting.prediction_table(t.candidates, "probability", 0.6, select.position_size()).write.parquet(path)
    return t.spark.read.parquet(path).select("row_id", "raw_signal", "predicted", rnd("position_size", 3).alias("position_size"))


# ---------------------------------------------------------------- calibration

LINE_CTE = "line AS (SELECT fold, regr_slope(trade_return, predicted_return) AS s, regr_intercept(trade_return, predicted_return) AS i FROM cand GROUP BY 1)"


@query("c01_platt")
def platt(t):
    d = t.doc_scores
    out = calibrate.platt(d, d, "p")
    return out.select("doc_id", "p", "label", rnd("calibrated_probability").alias("calibrated_probability"))


query("c02_linear_calibration", with_tables("cand", f"SELECT fold, {r('s')} AS slope, {r('i')} AS intercept FROM line", LINE_CTE))(
    lambda t: rounded(calibrate.linear_fit(t.candidates, "predicted_return", "trade_return", ["fold"]), ["fold"], {"slope": 6, "intercept": 6})
)


@query("c03_isotonic")
def isotonic(t):
    d = t.doc_scores
    out = calibrate.isotonic(d, d, "p")
    return out.select("doc_id", "p", "label", rnd("calibrated_probability").alias("calibrated_probability"))


CUTS = ", ".join(f"quantile_cont(predicted_return, {i / 10}) AS c{i}" for i in range(1, 10))
PLACE = " + ".join(f"CAST(predicted_return > c{i} AS INTEGER)" for i in range(1, 10))


@query(
    "c04_bucket_uncertainty",
    with_tables(
        "cand",
        f"""SELECT row_id, {r("u")} AS uncertainty FROM (SELECT row_id, CASE WHEN n >= 2000 THEN sd ELSE whole END AS u FROM (SELECT row_id, {PLACE} AS b FROM cand, cuts) x
        JOIN spread s ON s.b = x.b, (SELECT stddev_pop(trade_return - predicted_return) AS whole FROM cand WHERE fold <= 5))""",
        f"cuts AS (SELECT {CUTS} FROM cand WHERE fold <= 5)",
        f"spread AS (SELECT {PLACE} AS b, stddev_pop(trade_return - predicted_return) AS sd, count(*) AS n FROM cand, cuts WHERE fold <= 5 GROUP BY 1)",
    ),
)
def bucket_uncertainty(t):
    c = t.candidates.select("row_id", "fold", "predicted_return", "trade_return")
    out = calibrate.bucket_residual(c.filter("fold <= 5"), c, "predicted_return", "trade_return", min_rows=2000)
    return out.select("row_id", rnd("uncertainty").alias("uncertainty"))


BINS = 8
BINS_CTE = f"""binned AS (SELECT *, CAST(ceil(rk * {BINS} / n) AS INTEGER) AS bin FROM (SELECT trade_score, net, row_number() OVER (ORDER BY trade_score, open_time, row_id) AS rk,
  count(*) OVER () AS n FROM ret WHERE fold <= 5)),
bins AS (SELECT bin, count(*) AS rows, min(trade_score) AS lo, max(trade_score) AS hi, (count(*) * avg(net) + 100 * (SELECT avg(net) FROM binned)) / (count(*) + 100) AS u FROM binned GROUP BY 1),
edges AS (SELECT bin, u, coalesce(lag(hi) OVER (ORDER BY bin), -1e300) AS a, CASE WHEN bin = {BINS} THEN 1e300 ELSE hi END AS b FROM bins)"""


def score_bins(t):
    fit = t.returns.filter("fold <= 5").select("trade_score", "net", "open_time", "row_id")
    return calibrate.score_bucket(fit, "trade_score", "net", ["open_time", "row_id"], BINS, 100, 100.0)


query(
    "c05_score_bucket",
    with_tables("ret", f"SELECT bin, rows, {r('lo')} AS lower_score, {r('hi')} AS upper_score, {r('u')} AS calibrated_utility FROM bins", BINS_CTE),
)(lambda t: rounded(score_bins(t), ["bin", "rows"], {"lower_score": 6, "upper_score": 6, "calibrated_utility": 6}))


@query(
    "c06_top_bin_gate",
    with_tables(
        "ret",
        f"""SELECT kept, count(*) AS rows FROM (SELECT (SELECT u FROM bins WHERE bin = {BINS}) >= floor AS kept FROM ret, (VALUES (0.0), (1.0)) v(floor) WHERE fold > 5) GROUP BY 1""",
        BINS_CTE,
    ),
)
def top_bin_gate(t):
    rows, bins = t.candidates.filter("fold > 5").select("trade_score"), score_bins(t)
    parts = [calibrate.top_bin_gate(rows, bins, "trade_score", floor) for floor in (0.0, 1.0)]
    return union(parts).groupBy((F.col("trade_score") > -INF).alias("kept")).agg(n_rows())


@query(
    "c07_blended_utility",
    with_tables(
        "ret",
        f"SELECT row_id, {r('0.5 * u + 0.5 * predicted_return')} AS selection_score FROM ret JOIN edges ON trade_score > a AND trade_score <= b WHERE fold > 5",
        BINS_CTE,
    ),
)
def blended_utility(t):
    rows = t.candidates.filter("fold > 5").select("row_id", "trade_score", "predicted_return")
    out = calibrate.apply_score_bucket(rows, score_bins(t), "trade_score", "utility")
    return out.select("row_id", rnd(calibrate.blend("utility", "predicted_return", 0.5)).alias("selection_score"))


def _metric_sql(c: str, kind: str) -> str:
    q = f"greatest(1e-12, least(1 - 1e-12, {c}))"
    if kind == "probability":
        a, b, m = f"avg(({c} - label) * ({c} - label))", f"avg(-(label * ln({q}) + (1 - label) * ln(1 - {q})))", "avg(label)"
    else:
        a, b, m = f"avg(abs({c} - net))", f"avg(({c} - net) * ({c} - net))", "avg(net)"
    return f"SELECT '{c}' AS \"column\", '{kind}' AS kind, count(*) AS rows, {r(f'avg({c})')} AS mean_prediction, {r(m)} AS actual_mean, {r(a)} AS brier_or_mae, {r(b)} AS log_loss_or_mse FROM docs"


query(
    "c08_calibration_metrics",
    with_tables("docs", " UNION ALL ".join(_metric_sql(c, k) for c, k in (("p", "probability"), ("p_root", "probability"), ("predicted_return", "return")))),
)(
    lambda t: rounded(
        reports.calibration_metrics(t.doc_scores, ["p", "p_root"], ["predicted_return"]), ["column", "kind", "rows"],
        {c: 6 for c in ("mean_prediction", "actual_mean", "brier_or_mae", "log_loss_or_mse")},
    )
)


@query(
    "c09_calibration_buckets",
    with_tables(
        "docs",
        f"""SELECT f.source, f.bucket, coalesce(rows, 0) AS rows, coalesce({r("mp")}, 0.0) AS mean_probability, coalesce({r("ar")}, 0.0) AS actual_rate,
        {r("ece")} AS expected_calibration_error FROM (SELECT source, CAST(b AS INTEGER) AS bucket FROM (VALUES ('p'), ('p_root')) v(source), range(10) g(b)) f
        LEFT JOIN cells c ON c.source = f.source AND c.bucket = f.bucket JOIN (SELECT source, sum(abs(mp - ar) * rows) / sum(rows) AS ece FROM cells GROUP BY 1) e ON e.source = f.source""",
        """long AS (SELECT 'p' AS source, p AS v, label FROM docs UNION ALL SELECT 'p_root', p_root, label FROM docs)""",
        "cells AS (SELECT source, CAST(least(floor(v * 10), 9) AS INTEGER) AS bucket, count(*) AS rows, avg(v) AS mp, avg(label) AS ar FROM long GROUP BY 1, 2)",
    ),
)
def calibration_buckets(t):
    buckets = reports.calibration_buckets(t.doc_scores, ["p", "p_root"])
    joined = buckets.join(F.broadcast(reports.calibration_error(buckets)), "source")  # one row per source
    return rounded(joined, ["source", "bucket", "rows"], {"mean_probability": 6, "actual_rate": 6, "expected_calibration_error": 6})


# ---------------------------------------------------------------- reports

SCORES = ["probability", "trade_score", "expected_value"]
LONG_CTE = "long AS (" + " UNION ALL ".join(f"SELECT '{c}' AS score, {c} AS value, * FROM ret" for c in SCORES) + ")"
R1 = {"min": "min(value)", "max": "max(value)", "mean": "avg(value)", "std": "stddev_pop(value)"} | {
    p: f"quantile_cont(value, {q})" for p, q in reports.QUANTILES.items()
}
query(
    "r01_numeric_summary",
    with_tables("ret", f"SELECT score AS \"column\", count(*) AS count, {', '.join(f'{r(s)} AS {c}' for c, s in R1.items())} FROM long GROUP BY 1", LONG_CTE),
)(lambda t: rounded(reports.summary(t.returns, SCORES), ["column", "count"], {c: 6 for c in R1}))
R2 = {
    f"{side}_{kind}": f"{fn} FILTER (WHERE net {op} 0)"
    for side, op in (("winner", ">"), ("loser", "<="))
    for kind, fn in (("mean", "avg(value)"), ("median", "quantile_cont(value, 0.5)"))
}
query(
    "r02_score_distribution",
    with_tables(
        "ret",
        f"""SELECT score AS "column", count(*) AS count, {r("stddev_pop(value)")} AS std, {", ".join(f"{r(s)} AS {c}" for c, s in R2.items())},
        {r(f"{R2['winner_mean']} - {R2['loser_mean']}")} AS winner_minus_loser_mean FROM long GROUP BY 1""",
        LONG_CTE,
    ),
)(
    lambda t: rounded(
        reports.score_distribution(t.returns, SCORES), ["column", "count"], {c: 6 for c in ("std", *R2, "winner_minus_loser_mean")}
    )
)
DECILE_CTE = """ranked AS (SELECT *, CAST(ceil(10 * row_number() OVER (PARTITION BY score ORDER BY value, open_time, symbol, row_id) / count(*) OVER (PARTITION BY score)) AS INTEGER) AS decile FROM long),
tops AS (SELECT score, decile, arg_max(symbol, (n, symbol)) AS top_symbol, max(n) / sum(n) AS share FROM (SELECT score, decile, symbol, count(*) AS n FROM ranked GROUP BY 1, 2, 3) GROUP BY 1, 2),
dec AS (SELECT score, decile, count(*) AS rows, min(value) AS lo, max(value) AS hi, avg(gross) AS g, avg(net) AS avg_net_return, avg(CAST(net > 0 AS INTEGER)) AS pos FROM ranked GROUP BY 1, 2)"""
query(
    "r03_score_deciles",
    with_tables(
        "ret",
        f"""SELECT d.score, d.decile, rows, {r("lo")} AS score_min, {r("hi")} AS score_max, {r("g")} AS avg_gross_return, {r("avg_net_return")} AS avg_net_return,
        {r("pos")} AS positive_return_rate, top_symbol, {r("share")} AS top_symbol_share FROM dec d JOIN tops t ON t.score = d.score AND t.decile = d.decile""",
        LONG_CTE, DECILE_CTE,
    ),
)(
    lambda t: rounded(
        reports.deciles(t.returns, SCORES), ["score", "decile", "rows", "top_symbol"],
        {c: 6 for c in ("score_min", "score_max", "avg_gross_return", "avg_net_return", "positive_return_rate", "top_symbol_share")},
    )
)
query(
    "r04_monotonicity",
    with_tables(
        "ret",
        f"""SELECT score, {r("avg(CAST(avg_net_return >= before AS INTEGER))")} AS monotonicity FROM (SELECT score, avg_net_return, lag(avg_net_return) OVER (PARTITION BY score ORDER BY decile) AS before FROM dec)
        WHERE before IS NOT NULL GROUP BY 1""",
        LONG_CTE, DECILE_CTE,
    ),
)(lambda t: rounded(reports.monotonicity(reports.deciles(t.returns, SCORES), ["score"]), ["score"], {"monotonicity": 6}))
RANK_CTE = """desc_ranked AS (SELECT *, row_number() OVER (PARTITION BY score ORDER BY value DESC, open_time, symbol, row_id) AS rk, count(*) OVER (PARTITION BY score) AS n FROM long),
placed AS (""" + " UNION ALL ".join(
    f"SELECT *, 'top_{p}pct' AS bucket FROM desc_ranked WHERE rk <= ceil(n * {p} / 100)" for p in reports.TOP_SHARES
) + """ UNION ALL SELECT *, 'score_decile_' || lpad(CAST(CAST(ceil(rk * 10 / n) AS BIGINT) AS VARCHAR), 2, '0') FROM desc_ranked
  UNION ALL SELECT *, 'raw_candidates' FROM desc_ranked WHERE raw_signal = 1 UNION ALL SELECT *, 'executed' FROM desc_ranked WHERE executed = 1)"""


def _rank_top(column: str) -> str:
    return f"""top_{column} AS (SELECT score, bucket, arg_max({column}, (n, {column})) AS v, max(n) / sum(n) AS share FROM
    (SELECT score, bucket, {column}, count(*) AS n FROM placed GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


query(
    "r05_ranking_report",
    with_tables(
        "ret",
        f"""SELECT p.score AS score_source, p.bucket, count(*) AS rows, {r("avg(label)")} AS label_rate, {r("avg(net)")} AS avg_net_return, {factor_sql()} AS profit_factor,
        {r("sum(profit)", 2)} AS profit, count(DISTINCT trade_day) AS active_days, any_value(s.v) AS top_symbol, {r("any_value(s.share)")} AS top_symbol_share,
        {r("any_value(m.share)")} AS top_month_share FROM placed p JOIN top_symbol s ON s.score = p.score AND s.bucket = p.bucket
        JOIN top_month m ON m.score = p.score AND m.bucket = p.bucket GROUP BY 1, 2""",
        LONG_CTE, RANK_CTE, _rank_top("symbol"), _rank_top("month"),
    ),
)(
    lambda t: rounded(
        reports.ranking(t.returns, SCORES), ["score_source", "bucket", "rows", "active_days", "top_symbol", "profit_factor"],
        {"label_rate": 6, "avg_net_return": 6, "profit": 2, "top_symbol_share": 6, "top_month_share": 6},
    ).withColumn("profit_factor", finite("profit_factor"))
)
EXPOSURE_CTE = """expo AS (SELECT symbol, count(*) AS trade_count, sum(position_size) AS capital, sum(CASE WHEN profit >= 0 THEN profit ELSE 0.0 END) AS gp, sum(profit) AS net_profit,
  sum(CASE WHEN profit < 0 THEN -profit ELSE 0.0 END) AS loss, count(DISTINCT trade_day) AS active_days, avg(trade_score) AS average_score, avg(net) AS average_net_return,
  avg(abs(predicted_return - net)) AS err FROM ret WHERE predicted GROUP BY 1),
shares AS (SELECT *, trade_count / sum(trade_count) OVER () AS trade_share, capital / sum(capital) OVER () AS capital_share,
  greatest(0.0, net_profit) / sum(greatest(0.0, net_profit)) OVER () AS net_profit_share, loss / sum(loss) OVER () AS loss_share FROM expo)"""
query(
    "r06_symbol_exposure",
    with_tables(
        "ret",
        f"""SELECT symbol, trade_count, active_days, {r("capital", 2)} AS capital, {r("gp", 2)} AS gross_profit, {r("net_profit", 2)} AS net_profit, {r("average_score")} AS average_score,
        {r("err")} AS average_abs_return_error, {r("trade_share")} AS trade_share, {r("capital_share")} AS capital_share, {r("net_profit_share")} AS net_profit_share, {r("loss_share")} AS loss_share FROM shares""",
        EXPOSURE_CTE,
    ),
)(
    lambda t: rounded(
        reports.exposure(t.returns.filter("predicted")), ["symbol", "trade_count", "active_days"],
        {"capital": 2, "gross_profit": 2, "net_profit": 2, "average_score": 6, "average_abs_return_error": 6, "trade_share": 6, "capital_share": 6, "net_profit_share": 6, "loss_share": 6},
    )
)
query(
    "r07_concentration",
    with_tables(
        "ret",
        f"""SELECT {r("max(net_profit_share)")} AS net_profit_share_top1, {r("list_sum(list_slice(list_reverse_sort(list(net_profit_share)), 1, 3))")} AS net_profit_share_top3,
        {r("max(trade_share)")} AS trade_share_top1, {r("list_sum(list_slice(list_reverse_sort(list(trade_share)), 1, 3))")} AS trade_share_top3,
        arg_max(symbol, (net_profit, trade_count)) AS top_symbol, count(*) AS symbol_count FROM shares""",
        EXPOSURE_CTE,
    ),
)(
    lambda t: rounded(
        reports.concentration(reports.exposure(t.returns.filter("predicted"))), ["top_symbol", "symbol_count"],
        {c: 6 for c in ("net_profit_share_top1", "net_profit_share_top3", "trade_share_top1", "trade_share_top3")},
    )
)
query(
    "r08_symbol_report",
    with_tables(
        "ret",
        f"""SELECT symbol, count(*) AS rows, sum(executed)::BIGINT AS predicted_trades, sum(label)::BIGINT AS actual_positive_rows,
        {r("avg(CAST(net > 0 AS INTEGER)) FILTER (WHERE executed = 1)")} AS win_rate, {r("avg(forward_return)")} AS avg_forward_return,
        {r("sum(position_size * (gross - 0.001)) FILTER (WHERE executed = 1)", 2)} AS total_profit_after_fee, {r("sum(profit) FILTER (WHERE executed = 1)", 2)} AS total_profit_after_fee_and_slippage,
        {factor_sql(where="executed = 1")} AS profit_factor, {r("avg(position_size) FILTER (WHERE executed = 1)", 2)} AS avg_position_size FROM ret GROUP BY 1""",
    ),
)(
    lambda t: rounded(
        reports.symbols(t.returns), ["symbol", "rows", "predicted_trades", "actual_positive_rows", "profit_factor"],
        {"win_rate": 6, "avg_forward_return": 6, "total_profit_after_fee": 2, "total_profit_after_fee_and_slippage": 2, "avg_position_size": 2},
    ).withColumn("profit_factor", finite("profit_factor"))
)

BAR_TRADES_CTE = f"""bar_trades AS (SELECT o.symbol, o.month, o.open_time, strftime(make_timestamp(o.open_time * 1000), '%Y-%m-%d') AS trade_day, o.g AS gross, o.g - 0.0015 AS net,
  1000.0 * (o.g - 0.0015) AS profit, s.ret60, s.vol, s.relv, coalesce(b.return_60m, 0.0) AS lead FROM (SELECT *, CASE WHEN mfe >= {TARGET} THEN {TARGET} ELSE forward_return END AS g FROM outs) o
  JOIN (SELECT symbol, month, open_time, {ret(60)} AS ret60, {FEATURE_SQL["f08_volatility"]["rolling_volatility_60m"]} AS vol,
    {FEATURE_SQL["f11_relative_volume"]["relative_volume_previous_hour"]} AS relv FROM steps) s ON s.symbol = o.symbol AND s.month = o.month AND s.open_time = o.open_time
  LEFT JOIN leaders b ON b.symbol = '{LEADER_MAP["btc"]}' AND b.month = o.month AND b.open_time = o.open_time)"""


def bar_trades(t):
    df = labels.outcomes(features.base(t.bars), WINDOW, mode="future_high", growth=TARGET).filter("forward_return IS NOT NULL")
    df = features.regime(df, t.bars, LEADER_MAP).withColumn("position_size", F.lit(1000.0)).withColumn("trade_day", day_of("open_time"))
    return accounting.with_returns(df).withColumn("row_id", F.concat_ws("|", "symbol", "open_time"))


@query(
    "r09_regime_report",
    with_tables(
        "bars",
        f"""SELECT k.regime_type, k.regime_value, count(*) AS trade_count, {r("sum(profit)", 2)} AS portfolio_profit, {r("avg(CAST(net > 0 AS INTEGER))")} AS win_rate, {factor_sql()} AS profit_factor,
        {r("any_value(dd)")} AS max_drawdown FROM kinds k JOIN d ON d.regime_type = k.regime_type AND d.regime_value = k.regime_value GROUP BY 1, 2""",
        STEPS_CTE, LEADER_CTE, OUT_CTE, BAR_TRADES_CTE,
        """kinds AS (SELECT 'btc_direction' AS regime_type, CASE WHEN lead > 0 THEN 'up' WHEN lead < 0 THEN 'down' ELSE 'flat' END AS regime_value, * FROM bar_trades
          UNION ALL SELECT 'volatility', CASE WHEN vol >= 0.6 THEN 'high' ELSE 'normal' END, * FROM bar_trades)""",
        drawdown_cte("d", "kinds", "regime_type, regime_value", "open_time, symbol"),
    ),
)
def regime_report(t):
    lead = F.col("btc_return_60m")
    types = {
        "btc_direction": F.when(lead > 0, "up").when(lead < 0, "down").otherwise("flat"),
        "volatility": F.when(F.col("rolling_volatility_60m") >= 0.6, "high").otherwise("normal"),
    }
    out = reports.regimes(bar_trades(t), types)
    out = rounded(out, ["regime_type", "regime_value", "trade_count", "profit_factor"], {"portfolio_profit": 2, "win_rate": 6, "max_drawdown": 6})
    return out.withColumn("profit_factor", finite("profit_factor"))


FEATS = ["probability", "trade_score", "uncertainty", "quote_volume"]


@query(
    "r10_feature_stability",
    with_tables(
        "cand",
        f"""SELECT feature, {r("avg(imp)")} AS mean_importance, {r("stddev_pop(imp)")} AS std_importance, min(rk)::INTEGER AS min_rank, max(rk)::INTEGER AS max_rank, {r("avg(rk)")} AS mean_rank,
        count(DISTINCT fold) AS folds_present, {r("avg(imp) / (avg(imp) + stddev_pop(imp))")} AS stability_score FROM (SELECT *, rank() OVER (PARTITION BY fold ORDER BY imp DESC) AS rk FROM ("""
        + " UNION ALL ".join(f"SELECT fold, '{c}' AS feature, abs(corr({c}, label)) AS imp FROM cand GROUP BY 1" for c in FEATS)
        + ")) GROUP BY 1",
    ),
)
def feature_stability(t):
    wide = t.candidates.groupBy("fold").agg(*[F.abs(F.corr(c, F.col("label").cast("double"))).alias(c) for c in FEATS])
    out = reports.feature_stability(reports.long_form(wide, FEATS, "feature", "importance", ["fold"]))
    return rounded(
        out, ["feature", "min_rank", "max_rank", "folds_present"],
        {"mean_importance": 6, "std_importance": 6, "mean_rank": 6, "stability_score": 6},
    )


@query(
    "r11_baselines",
    with_tables(
        "bars",
        f"""SELECT baseline_name, CAST(reason = '' OR trades IS NOT NULL AS INTEGER) AS available, CASE WHEN trades IS NULL THEN reason ELSE '' END AS skipped_reason,
        coalesce(trades, 0) AS trades, coalesce(win_rate, 0.0) AS win_rate, coalesce(avg_trade_return, 0.0) AS avg_trade_return, coalesce(portfolio_profit, 0.0) AS portfolio_profit
        FROM (VALUES ('no_trade', ''), ('random_trade', ''), ('simple_momentum', ''), ('volume_spike', ''), ('logistic_baseline', ''),
          ('leader_buy_and_hold', '{reports.NO_PATH}'), ('equal_weight_buy_and_hold', '{reports.NO_PATH}')) l(baseline_name, reason) LEFT JOIN (
        SELECT baseline_name, count(*) AS trades, {r("avg(CAST(net > 0 AS INTEGER))")} AS win_rate, {r("avg(gross)")} AS avg_trade_return, {r("sum(profit)", 2)} AS portfolio_profit FROM (
          SELECT 'random_trade' AS baseline_name, * FROM bar_trades WHERE ('0x' || substr(md5(symbol || '|' || open_time), 1, 4))::INT % 16 = 0
          UNION ALL SELECT 'simple_momentum', * FROM bar_trades WHERE ret60 > 0 UNION ALL SELECT 'volume_spike', * FROM bar_trades WHERE relv >= 2
          UNION ALL SELECT 'logistic_baseline', * FROM bar_trades WHERE 1 / (1 + exp(-(0.3 * ln(1 + relv) - 4 * ret60))) >= 0.6) GROUP BY 1
        UNION ALL SELECT name, count(*), {r("avg(CAST(h > 0 AS INTEGER))")}, {r("avg(h)")}, {r("avg(h) * 10000", 2)} FROM
          (SELECT symbol, arg_max(close, open_time) / arg_min(close, open_time) - 1 AS h FROM bars GROUP BY 1)
          JOIN (VALUES ('equal_weight_buy_and_hold'), ('leader_buy_and_hold')) k(name) ON name LIKE 'equal%' OR symbol = '{LEADERS[0]}' GROUP BY 1) USING (baseline_name)""",
        STEPS_CTE, LEADER_CTE, OUT_CTE, BAR_TRADES_CTE,
    ),
)
def baseline_rules(t):
    """The logistic rule has stated weights here: the report takes the trades of any fitted model."""
    rows = bar_trades(t)
    score = 0.3 * F.log1p("relative_volume_previous_hour") - 4 * F.col("ret_60m")
    out = reports.baselines(rows, t.bars, leader=LEADERS[0], logistic=rows.filter(1 / (1 + F.exp(-score)) >= 0.6))
    return rounded(out, ["baseline_name", "available", "skipped_reason", "trades"], {"win_rate": 6, "avg_trade_return": 6, "portfolio_profit": 2})


query(
    "r12_candidate_utility",
    with_tables(
        "ret",
        f"""SELECT c.fold, count(*) AS candidates, count_if(net > 0)::BIGINT AS positive_utility_count, count_if(net > 0 AND executed = 1)::BIGINT AS executed_positive_utility_count,
        {r("count_if(net > 0 AND executed = 1) / count_if(net > 0)")} AS positive_utility_recall, {r("max(net) FILTER (WHERE net > 0 AND executed = 0)")} AS missed_best_utility,
        {r("avg(trade_score) FILTER (WHERE net > 0) - avg(trade_score) FILTER (WHERE net <= 0)")} AS score_positive_utility_gap,
        {r("avg(net) FILTER (WHERE rk <= ceil(n / 10))")} AS top_decile_utility, count_if(rk <= ceil(n / 10) AND net <= 0)::BIGINT AS high_score_loss_count,
        {r("avg(net) FILTER (WHERE rk <= ceil(n / 10) AND net <= 0)")} AS high_score_loss_utility FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY trade_score DESC, open_time, symbol, row_id) AS rk,
        count(*) OVER (PARTITION BY fold) AS n FROM ret) c GROUP BY 1""",
    ),
)(
    lambda t: rounded(
        reports.candidate_utility(t.returns, "trade_score", ["fold"]),
        ["fold", "candidates", "positive_utility_count", "executed_positive_utility_count", "high_score_loss_count"],
        {c: 6 for c in ("positive_utility_recall", "missed_best_utility", "score_positive_utility_gap", "top_decile_utility", "high_score_loss_utility")},
    )
)


@query(
    "r13_execution_audit",
    with_tables(
        "cand",
        f"""SELECT a.*, bucket_count, max_bucket_size, max_selected_in_bucket, top_k_violations, max_open_positions, {r("max_open_capital", 2)} AS max_open_capital FROM
        (SELECT count(*) AS input_rows, count_if(back > 0)::BIGINT AS time_decreases, coalesce(max(back) FILTER (WHERE back > 0), 0) / 60000 AS max_backward_minutes FROM
          (SELECT lag(open_time) OVER (ORDER BY row_id) - open_time AS back FROM cand)) a,
        (SELECT count(*) AS bucket_count, max(n)::BIGINT AS max_bucket_size, max(s)::BIGINT AS max_selected_in_bucket, count_if(s > 2)::BIGINT AS top_k_violations FROM
          (SELECT open_time, count(*) AS n, count_if(selected_by_topk) AS s FROM cand GROUP BY 1)),
        (SELECT max(o)::BIGINT AS max_open_positions, max(c) AS max_open_capital FROM (SELECT sum(n) OVER w AS o, sum(c) OVER w AS c FROM
          (SELECT moved, step, sum(step) AS n, sum(step * position_size) AS c FROM (SELECT open_time AS moved, 1 AS step, position_size FROM cand WHERE selected_by_topk
             UNION ALL SELECT open_time + 4320 * 60000, -1, position_size FROM cand WHERE selected_by_topk) GROUP BY 1, 2) WINDOW w AS (ORDER BY moved, step ROWS UNBOUNDED PRECEDING)))""",
    ),
)
def execution_audit(t):
    c = t.candidates.select("row_id", "open_time", "position_size", F.col("selected_by_topk").cast("int").alias("selected"))
    out = reports.execution_audit(c, ["row_id"], 4320, 2)
    keep = ["input_rows", "time_decreases", "max_backward_minutes", "bucket_count", "max_bucket_size", "max_selected_in_bucket", "top_k_violations", "max_open_positions"]
    return rounded(out, keep, {"max_open_capital": 2})


STATUS_SQL = "CASE WHEN n = 0 THEN 'inactive' WHEN p > 0 THEN 'active_profitable' ELSE 'active_losing' END"
query(
    "r14_fold_status",
    with_tables(
        "ret",
        f"""SELECT symbol, fold, n AS trade_count, {STATUS_SQL} AS status FROM (SELECT symbol, fold, sum(executed)::BIGINT AS n, sum(CASE WHEN executed = 1 THEN profit ELSE 0.0 END) AS p FROM ret GROUP BY 1, 2)""",
    ),
)(
    lambda t: t.returns.groupBy("symbol", "fold").agg(
        F.sum("executed").alias("trade_count"), F.sum(F.when(F.col("executed") == 1, F.col("profit")).otherwise(0.0)).alias("portfolio_profit")
    ).select("symbol", "fold", "trade_count", reports.fold_status().alias("status"))
)
FOLD_CTE = """fold_rows AS (SELECT symbol, fold, sum(executed)::BIGINT AS n, coalesce(sum(profit) FILTER (WHERE executed = 1), 0.0) AS p, coalesce(avg(net) FILTER (WHERE executed = 1), 0.0) AS net,
  CASE WHEN sum(executed) >= 12 THEN sum(profit) FILTER (WHERE executed = 1) END AS obj FROM ret GROUP BY 1, 2)"""


def fold_rows(t):
    ex = F.col("executed") == 1
    g = t.returns.groupBy("symbol", "fold").agg(
        F.sum("executed").alias("trade_count"),
        F.coalesce(F.sum(F.when(ex, F.col("profit"))), F.lit(0.0)).alias("portfolio_profit"),
        F.coalesce(F.avg(F.when(ex, F.col("net"))), F.lit(0.0)).alias("avg_net_return"),
    )
    objective = F.when(F.col("trade_count") >= 12, F.col("portfolio_profit")).otherwise(F.lit(-INF))
    return g.withColumn("portfolio_return", F.col("portfolio_profit") / accounting.CAPITAL).withColumn("objective", objective)


query(
    "r15_fold_aggregate",
    with_tables(
        "ret",
        f"""SELECT count(*) AS folds, count_if(n > 0)::BIGINT AS active_folds, sum(n)::BIGINT AS trades, {r("sum(p)", 2)} AS profit, {r("avg(p) / 10000")} AS mean_return, {r("avg(net)")} AS mean_net_return,
        {r("avg(net) FILTER (WHERE n > 0)")} AS active_mean_net_return, {r("sum(net * n) / sum(n)")} AS trade_weighted_net_return, {r("sum(p) / count_if(n > 0)", 3)} AS profit_per_active_fold,
        count(obj) AS finite_objectives, count(*) - count(obj) AS nonfinite_objectives, {r("avg(obj)", 3)} AS mean_objective FROM fold_rows""",
        FOLD_CTE,
    ),
)(
    lambda t: rounded(
        reports.aggregate_folds(fold_rows(t)), ["folds", "active_folds", "trades", "finite_objectives", "nonfinite_objectives"],
        {"profit": 2, "mean_return": 6, "mean_net_return": 6, "active_mean_net_return": 6, "trade_weighted_net_return": 6, "profit_per_active_fold": 3, "mean_objective": 3},
    )
)


def _tier_sql() -> str:
    return " UNION ALL ".join(
        f"""SELECT symbol, '{t}' AS tier, concat_ws(';', CASE WHEN pr < {v["profitable_rate"]} THEN 'profitable_fold_rate' END, CASE WHEN md < {v["median_return"]} THEN 'median_portfolio_return' END,
        CASE WHEN mn < {v["mean_return"]} THEN 'mean_portfolio_return' END, CASE WHEN wd > {v["drawdown"]} THEN 'worst_fold_drawdown' END, CASE WHEN ac < {v["active"]} THEN 'active_folds' END) AS failed_checks FROM sm"""
        for t, v in reports.TIERS.items()
    )


@query(
    "r16_acceptance",
    with_tables(
        "ret",
        f"SELECT symbol, tier, CAST(failed_checks = '' AS INTEGER) AS accepted, CASE WHEN failed_checks = '' THEN tier || '_pass' ELSE 'rejected' END AS strength, failed_checks FROM ({_tier_sql()})",
        FOLD_CTE,
        """sm AS (SELECT symbol, avg(CAST(p > 0 AS INTEGER)) AS pr, quantile_cont(p / 10000, 0.5) AS md, avg(p / 10000) AS mn, max(greatest(0.0, -p / 10000)) AS wd, count_if(n > 0) AS ac FROM fold_rows GROUP BY 1)""",
    ),
)
def acceptance(t):
    ret_ = F.col("portfolio_return")
    summary = fold_rows(t).groupBy("symbol").agg(
        F.avg((F.col("portfolio_profit") > 0).cast("double")).alias("profitable_rate"),
        F.percentile(ret_, 0.5).alias("median_return"),  # one value per fold
        F.avg(ret_).alias("mean_return"),
        F.max(F.greatest(F.lit(0.0), -ret_)).alias("worst_drawdown"),
        F.count_if(F.col("trade_count") > 0).alias("active_folds"),
    )
    return reports.acceptance(summary).select("symbol", "tier", "accepted", "strength", "failed_checks")


@query(
    "r17_robustness",
    with_tables(
        "ret",
        f"""SELECT priority, CASE WHEN failed_checks = '' THEN 'passed' ELSE 'failed' END AS gate_status, CAST(p > 0 AND failed_checks <> '' AS INTEGER) AS profitable_but_fragile, failed_checks FROM (
          SELECT b.priority, p, concat_ws(';', CASE WHEN ts > 0.0118 THEN 'top_symbol_share' END, CASE WHEN tm > 0.02 THEN 'top_month_share' END,
            CASE WHEN pf < 1.05 THEN 'profit_factor' END, CASE WHEN mono < 0.6 THEN 'tail_monotonicity' END, CASE WHEN t1 <= 0 THEN 'top_1pct_net_return' END, CASE WHEN t5 <= 0 THEN 'top_5pct_net_return' END,
            CASE WHEN t10 <= 0 THEN 'top_decile_net_return' END, CASE WHEN gap < 0 THEN 'executed_score_gap' END) AS failed_checks
          FROM (SELECT priority, sum(profit) AS p, sum(profit) FILTER (WHERE profit > 0) / -sum(profit) FILTER (WHERE profit < 0) AS pf,
              avg(net) FILTER (WHERE rk <= ceil(n / 100)) AS t1, avg(net) FILTER (WHERE rk <= ceil(n / 20)) AS t5, avg(net) FILTER (WHERE rk <= ceil(n / 10)) AS t10,
              avg(trade_score) FILTER (WHERE net > 0) - avg(trade_score) FILTER (WHERE net <= 0) AS gap FROM rk GROUP BY 1) b
          JOIN (SELECT priority, max(n) / sum(n) AS ts FROM (SELECT priority, symbol, count(*) AS n FROM rk GROUP BY 1, 2) GROUP BY 1) s ON s.priority = b.priority
          JOIN (SELECT priority, max(n) / sum(n) AS tm FROM (SELECT priority, month, count(*) AS n FROM rk GROUP BY 1, 2) GROUP BY 1) m ON m.priority = b.priority
          JOIN (SELECT priority, avg(CAST(v >= before AS INTEGER)) AS mono FROM (SELECT priority, v, lag(v) OVER (PARTITION BY priority ORDER BY d) AS before FROM
            (SELECT priority, ceil(10 * up / n) AS d, avg(net) AS v FROM rk GROUP BY 1, 2)) WHERE before IS NOT NULL GROUP BY 1) o ON o.priority = b.priority)""",
        """rk AS (SELECT *, row_number() OVER (PARTITION BY priority ORDER BY trade_score DESC, open_time, symbol, row_id) AS rk, row_number() OVER (PARTITION BY priority ORDER BY trade_score, open_time, symbol, row_id) AS up,
          count(*) OVER (PARTITION BY priority) AS n FROM ret WHERE predicted)""",
    ),
)
def robustness(t):
    ex = t.returns.filter("predicted")
    ranked = prefix.ordered(ex, ["priority"], [F.desc("trade_score"), "open_time", "symbol", "row_id"], rank="_rank", total="_n")

    def top(share):
        return F.avg(F.when(F.col("_rank") <= F.ceil(F.col("_n") / share), F.col("net")))

    won = F.col("net") > 0
    base = ranked.groupBy("priority").agg(
        F.count(F.lit(1)).alias("trades"), F.countDistinct("trade_day").alias("active_days"), F.countDistinct("symbol").alias("active_symbols"),
        F.countDistinct("month").alias("active_months"), F.sum("profit").alias("profit"), accounting.profit_factor().alias("profit_factor"),
        top(100).alias("top_1pct_net"), top(20).alias("top_5pct_net"), top(10).alias("top_10pct_net"),
        (F.avg(F.when(won, F.col("trade_score"))) - F.avg(F.when(~won, F.col("trade_score")))).alias("score_gap"),
    )
    mono = reports.monotonicity(reports.deciles(ex, ["trade_score"], ["priority"]), ["priority"])
    for column in ("symbol", "month"):
        base = base.join(reports._top_share(ex, ["priority"], column, column), "priority")
    out = reports.robustness(base.join(mono, "priority"), max_symbol_share=0.0118, max_month_share=0.02)
    return out.select("priority", "gate_status", "profitable_but_fragile", "failed_checks")


query(
    "r18_short_history",
    with_tables(
        "cand",
        f"""SELECT month, count(*) AS trades, {r("avg(CAST(open_time - first < 30 * 86400000::BIGINT AS INTEGER))")} AS short_history_share FROM
        (SELECT month, open_time, min(open_time) OVER (PARTITION BY symbol) AS first FROM cand) GROUP BY 1""",
    ),
)(lambda t: rounded(reports.short_history(t.candidates, 30, ["month"]), ["month", "trades"], {"short_history_share": 6}))


@query(
    "r19_run_comparison",
    with_tables(
        "ret",
        " UNION ALL ".join(
            f"SELECT 'threshold_{c}' AS run, count(*) AS trades, {r('sum(profit)', 2)} AS profit, {r('avg(net)')} AS mean_net FROM ret WHERE probability >= {c}" for c in (0.2, 0.5, 0.8)
        ),
    ),
)
def run_comparison(t):
    runs = {
        f"threshold_{c}": t.returns.filter(F.col("probability") >= c).agg(
            n_rows("trades"), rnd(F.sum("profit"), 2).alias("profit"), rnd(F.avg("net")).alias("mean_net")
        )
        for c in (0.2, 0.5, 0.8)
    }
    return reports.compare(runs)
