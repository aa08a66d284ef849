"""Offline research, ledgers, models and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import MS_PER_DAY, MS_PER_MINUTE, floor_div, rnd
from ..operators import accounting, features, labels, ledger, models, ranker, reports, research, select, splits
from ..session import scratch, stored
from ..sources import candidates as arts
from ..streaming import streams
from .bindings import r, with_tables
from .catalog_bars import TARGET, WINDOW
from .catalog_select import sequential_cte
from .catalog_reports import EXPOSURE_CTE, STABILITY_CTES, finite, fold_stability, n_rows, portfolio_rows, portfolio_sql, drawdown_cte, factor_sql, rounded
from .registry import query

EX = "ex AS (SELECT * FROM ret WHERE predicted)"
METRICS = {"portfolio_profit": 2, "avg_net_return": 6, "win_rate": 6, "top_symbol_profit_share": 6, "top_symbol_trade_share": 6, "max_drawdown": 6}


def executed(t) -> DataFrame:
    return t.returns.filter("predicted")


def metric_sql(source: str, name: str, label: str, where: str = "true", extra: float = 0.0) -> str:
    """One row of `variant_metrics` in SQL: rows of `source` under `where`, with an extra cost."""
    net = f"(net - {extra!r})"
    p = f"(position_size * {net})"
    return f"""SELECT {label} AS {name}, count(*) AS trade_count, {r(f"sum({p})", 2)} AS portfolio_profit, {r(f"avg({net})")} AS avg_net_return, {r(f"avg(CAST({net} > 0 AS INTEGER))")} AS win_rate,
    {factor_sql(p)} AS profit_factor, count(DISTINCT trade_day) AS active_days, count(DISTINCT symbol) AS active_symbols,
    {r(f"(SELECT max(greatest(0.0, g)) / sum(greatest(0.0, g)) FROM (SELECT sum({p}) AS g FROM {source} WHERE {where} GROUP BY symbol))")} AS top_symbol_profit_share,
    {r(f"(SELECT max(c) / sum(c) FROM (SELECT count(*) AS c FROM {source} WHERE {where} GROUP BY symbol))")} AS top_symbol_trade_share,
    {r(f'''(SELECT max((peak - equity) / peak) FROM (SELECT equity, greatest(10000.0, max(equity) OVER (ORDER BY open_time, symbol, row_id ROWS UNBOUNDED PRECEDING)) AS peak FROM
      (SELECT open_time, symbol, row_id, 10000.0 + sum({p}) OVER (ORDER BY open_time, symbol, row_id ROWS UNBOUNDED PRECEDING) AS equity FROM {source} WHERE {where})))''')} AS max_drawdown
    FROM {source} WHERE {where}"""


def variant_rows(df: DataFrame, key: str) -> DataFrame:
    out = rounded(df, [key, "trade_count", "active_days", "active_symbols", "profit_factor"], METRICS)
    return out.withColumn("profit_factor", finite("profit_factor"))


# ---------------------------------------------------------------- offline research

LOSO_SQL = f"""SELECT t.symbol AS removed_symbol, count(*) AS trade_count, {r("sum(profit)", 2)} AS portfolio_profit, {r("avg(net)")} AS avg_net_return, {r("avg(CAST(net > 0 AS INTEGER))")} AS win_rate,
  count(DISTINCT trade_day) AS active_days, count(DISTINCT e.symbol) AS active_symbols, (SELECT count(*) FROM ex) - count(*) AS removed_trades,
  {r("(sum(profit) - (SELECT sum(profit) FROM ex)) / 10000.0")} AS return_delta, {r("any_value(dd)")} AS max_drawdown
  FROM top8 t JOIN ex e ON e.symbol <> t.symbol JOIN d ON d.removed = t.symbol GROUP BY 1"""


query(
    "o01_leave_symbol_out",
    with_tables(
        "ret",
        f"""SELECT removed AS removed_symbol, count(e.symbol) AS trade_count, {r("coalesce(sum(profit), 0.0)", 2)} AS portfolio_profit, {r("coalesce(avg(net), 0.0)")} AS avg_net_return,
        {r("coalesce(avg(CAST(net > 0 AS INTEGER)), 0.0)")} AS win_rate, count(DISTINCT trade_day) AS active_days, count(DISTINCT e.symbol) AS active_symbols,
        (SELECT count(*) FROM ex) - count(e.symbol) AS removed_trades, {r("(coalesce(sum(profit), 0.0) - (SELECT sum(profit) FROM ex)) / 10000.0")} AS return_delta
        FROM (SELECT DISTINCT symbol AS removed FROM ex) x LEFT JOIN ex e ON e.symbol <> x.removed GROUP BY 1""",
        EX,
    ),
)(
    lambda t: rounded(
        research.leave_each_symbol(executed(t)), ["removed_symbol", "trade_count", "active_days", "active_symbols", "removed_trades"],
        {"portfolio_profit": 2, "avg_net_return": 6, "win_rate": 6, "return_delta": 6},
    )
)


@query(
    "o01_top_symbol_drawdowns",
    with_tables(
        "ret", LOSO_SQL, EX, EXPOSURE_CTE,
        "top8 AS (SELECT symbol FROM expo ORDER BY net_profit DESC, trade_count DESC, symbol LIMIT 8)",
        "pairs AS (SELECT t.symbol AS removed, e.* FROM top8 t JOIN ex e ON e.symbol <> t.symbol)",
        drawdown_cte("d", "pairs", "removed"),
    ),
)
def top_symbol_drawdowns(t):
    """A report on the eight symbols with the largest profit; o01_leave_symbol_out has all symbols."""
    df = executed(t)
    out = research.leave_symbol(df, research.top_symbols(df, 8))
    return rounded(
        out, ["removed_symbol", "trade_count", "active_days", "active_symbols", "removed_trades"],
        {"portfolio_profit": 2, "avg_net_return": 6, "win_rate": 6, "return_delta": 6, "max_drawdown": 6},
    )


FOLDS_CTE = """fold_rows AS (SELECT fold, count(*) AS n, sum(profit) AS p, sum(profit) / 10000.0 AS ret FROM ex GROUP BY 1)"""
query(
    "o02_leave_fold_out",
    with_tables(
        "ret",
        f"""SELECT a.fold AS removed_fold, {r("a.p", 2)} AS removed_profit, {r("greatest(0.0, a.p) / (SELECT sum(greatest(0.0, p)) FROM fold_rows)")} AS removed_profit_share, {r("sum(b.p)", 2)} AS remaining_profit,
        {r("sum(b.p) / (10000.0 * count(*))")} AS remaining_mean_return, {r("quantile_cont(b.ret, 0.5)")} AS remaining_median_return, {r("min(b.ret)")} AS remaining_worst_return,
        count_if(b.n > 0)::BIGINT AS remaining_active_folds, count_if(b.ret > 0)::BIGINT AS remaining_profitable_folds FROM fold_rows a JOIN fold_rows b ON b.fold <> a.fold GROUP BY a.fold, a.p""",
        EX, FOLDS_CTE,
    ),
)(
    lambda t: rounded(
        research.leave_fold(accounting.portfolio(executed(t), ["fold"])), ["removed_fold", "remaining_active_folds", "remaining_profitable_folds"],
        {"removed_profit": 2, "removed_profit_share": 6, "remaining_profit": 2, "remaining_mean_return": 6, "remaining_median_return": 6, "remaining_worst_return": 6},
    )
)
query(
    "o03_cost_stress",
    with_tables("ret", " UNION ALL ".join(metric_sql("ex", "cost_scenario", f"'{n}'", extra=e) for n, e in research.COST_SCENARIOS.items()), EX),
)(lambda t: variant_rows(research.cost_stress(executed(t)), "cost_scenario"))

MATRIX_CTE = """m AS (SELECT 'corrected_frozen_baseline' AS experiment, * FROM ex
  UNION ALL SELECT 'executed_nonnegative_expected_value_only', * FROM ex WHERE expected_value >= 0
  UNION ALL SELECT 'executed_trade_score_top_half_only', * FROM ex WHERE trade_score >= (SELECT quantile_cont(trade_score, 0.5) FROM ex)
  UNION ALL SELECT 'executed_unique_symbol_per_day', * FROM ex QUALIFY row_number() OVER (PARTITION BY trade_day, symbol ORDER BY trade_score DESC, open_time, row_id) = 1
  UNION ALL SELECT 'executed_symbol_trade_share_cap_35pct', * FROM ex QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY open_time, row_id) <= greatest(1, floor(count(*) OVER () * 0.35))
  UNION ALL SELECT 'corrected_baseline_double_cost', * REPLACE (net - 0.0015 AS net, position_size * (net - 0.0015) AS profit) FROM ex)"""
query(
    "o04_experiment_matrix",
    with_tables("ret", portfolio_sql("m", "experiment"), EX, MATRIX_CTE, drawdown_cte("dd_m", "m", "experiment")),
)(lambda t: portfolio_rows(accounting.portfolio(research.matrix(executed(t)), ["experiment"]), "experiment"))


ARTIFACT_COLUMNS = [
    "source", "fold_id", "symbol", "month", "trade_day", "open_time", "label", "trade_return", "position_size", "hybrid_score", "calibrated_probability",
    "raw_predicted_return", "expected_value", "decision_bucket_id", "period_bucket_id", "candidate_serialization_stage", "raw_signal",
    "selected_by_threshold", "selected_by_score_edge", "selected_by_symbol_filter", "selected_by_topk", "predicted", "configured_top_k",
]
_STORED: dict[tuple[str, str, str], DataFrame] = {}


def once(t, name: str, build) -> DataFrame:
    """What `build` gives, made once for an application and a folder."""
    key = (t.spark.sparkContext.applicationId, t.folder, name)
    if key not in _STORED:
        _STORED[key] = build()
    return _STORED[key]


def research_rows(t) -> DataFrame:
    """Artifact rows with the columns the variants read. The join behind them is written once, in the columns that are read."""
    a = once(t, "rows", lambda: stored(t.artifact.select(arts.row_id(t.artifact).alias("row_id"), *ARTIFACT_COLUMNS)))
    a = a.withColumns(
        {
            "trade_score": F.col("hybrid_score"),
            "predicted_net_return": F.col("raw_predicted_return"),
            "calibrated_predicted_return": F.col("expected_value"),
        }
    )
    a = a.withColumn("fold", F.substring("fold_id", 6, 9).cast("int")).withColumn("minute", floor_div("open_time", MS_PER_MINUTE))
    return accounting.with_returns(a)


RROWS_CTE = """rr AS (SELECT CASE WHEN candidate_id IS NOT NULL THEN 'candidate:' || candidate_id WHEN stable_row_id IS NOT NULL THEN 'stable:' || stable_row_id
    ELSE source || ':' || fold_id || ':' || row_position END AS row_id, symbol, month, trade_day, open_time, label, hybrid_score AS trade_score, calibrated_probability, raw_predicted_return, expected_value,
    position_size, trade_return AS gross, trade_return - 0.0015 AS net, position_size * (trade_return - 0.0015) AS profit, selected_by_threshold, selected_by_score_edge, selected_by_symbol_filter,
    selected_by_topk, predicted, CAST(substr(fold_id, 6) AS INTEGER) AS fold, period_bucket_id, decision_bucket_id FROM art)"""


def pool_cte(name: str, where: str) -> str:
    return f"{name} AS (SELECT * FROM rr WHERE selected_by_threshold = 1{where})"


def pick_cte(name: str, pool: str, score: str) -> str:
    order = f"{score} DESC, trade_score DESC, symbol, row_id"
    return f"""{name} AS (SELECT * FROM (SELECT * FROM {pool} QUALIFY row_number() OVER (PARTITION BY open_time, symbol ORDER BY {order}) <= 1)
    QUALIFY row_number() OVER (PARTITION BY open_time ORDER BY {order}) <= 2)"""


def z(c: str) -> str:
    o = "OVER (PARTITION BY open_time)"
    return f"(CASE WHEN stddev_pop({c}) {o} > 1e-12 THEN ({c} - avg({c}) {o}) / stddev_pop({c}) {o} ELSE 0.0 END)"


def penalised_cte(name: str, pool: str, score: str, strength: float, cap: float = 0.0) -> str:
    """Top 2 under the exposure penalty, with the columns of the pool; of rows that agree in time, symbol, id and scores one is taken."""
    return f"""{sequential_cte(name, pool, score, strength, 2, cap)},
{name} AS (SELECT c.* FROM {name}_keys k JOIN {pool} c ON c.open_time = k.open_time AND c.symbol = k.c.s AND c.row_id = k.c.i AND -c.trade_score = k.c.t
  QUALIFY row_number() OVER (PARTITION BY c.open_time, k.rank_in_bucket ORDER BY c.symbol) = 1)"""


VARIANT_CTES = (
    RROWS_CTE,
    pool_cte("p0", " AND selected_by_score_edge = 1 AND selected_by_symbol_filter = 1"),
    pool_cte("p1", " AND selected_by_symbol_filter = 1"),
    pool_cte("p2", " AND selected_by_score_edge = 1"),
    pool_cte("p3", ""),
    f"pb AS (SELECT *, 0.35 * {z('calibrated_probability')} + 0.25 * {z('expected_value')} + 0.25 * {z('raw_predicted_return')} + 0.15 * {z('expected_value')} AS b FROM p0)",
    pick_cte("v_score", "p0", "trade_score"),
    pick_cte("v_blend", "pb", "b"),
    penalised_cte("v_pen", "p0", "trade_score", 0.75),
    penalised_cte("v_cap", "p0", "trade_score", 0.35, 0.35),
    penalised_cte("v_capb", "pb", "b", 0.5, 0.35),
    pick_cte("v_edge", "p1", "trade_score"),
    pick_cte("v_sym", "p2", "trade_score"),
    pick_cte("v_none", "p3", "trade_score"),
)
ROWS = "row_id, symbol, month, trade_day, open_time, fold, gross, net, profit, position_size"
VARIANTS_SQL = " UNION ALL ".join(
    f"SELECT '{n}' AS experiment, {ROWS} FROM {src}"
    for n, src in {
        "baseline_executed_trades": "rr WHERE predicted = 1",
        "baseline_selected_by_topk": "rr WHERE selected_by_topk = 1",
        "score_replay_trade_score": "v_score",
        "cross_sectional_score_zscore": "v_score",  # a z-score or rank inside the bucket keeps its order
        "cross_sectional_score_rank": "v_score",
        "exposure_aware_trade_score_penalty": "v_pen",
        "exposure_aware_trade_share_cap_35pct": "v_cap",
        "calibration_plus_normalization": "v_blend",
        "calibration_plus_concentration_control": "v_capb",
        "score_edge_disabled": "v_edge",
        "symbol_filter_disabled": "v_sym",
        "score_edge_and_symbol_filter_disabled": "v_none",
    }.items()
)
PENALISED = ("exposure_aware_trade_score_penalty", "exposure_aware_trade_share_cap_35pct", "calibration_plus_concentration_control")


VARIANT_SQL = f"SELECT experiment, count(*) AS trades, count(DISTINCT open_time) AS buckets, {r('sum(profit)', 2)} AS profit, {r('avg(net)')} AS mean_net FROM sim"
SIMPLE_CTE = f"sim AS ({VARIANTS_SQL})"


def all_variants(t) -> DataFrame:
    """The picks of all twelve variants, made once for an application and a folder: every comparison reads the same table."""
    return once(t, "variants", lambda: research.variants(research_rows(t), VARIANT_COLUMNS))


def saved(t) -> DataFrame:
    """The executed rows of the baseline."""
    return all_variants(t).filter("experiment = 'baseline_executed_trades'")


VARIANT_COLUMNS = ["row_id", "source", "fold_id", "symbol", "month", "trade_day", "open_time", "trade_score", "fold", "gross", "net", "profit", "position_size", "label"]


def variant_totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("experiment").agg(
        n_rows("trades"), F.countDistinct("open_time").alias("buckets"), rnd(F.sum("profit"), 2).alias("profit"), rnd(F.avg("net")).alias("mean_net")
    )


query("o05_selection_variants", with_tables("art", f"{VARIANT_SQL} GROUP BY 1", *VARIANT_CTES, SIMPLE_CTE))(lambda t: variant_totals(all_variants(t)))
query("o05_penalised_variants", with_tables("art", f"{VARIANT_SQL} WHERE experiment IN {PENALISED} GROUP BY 1", *VARIANT_CTES, SIMPLE_CTE))(
    lambda t: variant_totals(all_variants(t).filter(F.col("experiment").isin(*PENALISED)))
)


SIM = ("art", *VARIANT_CTES, SIMPLE_CTE)


def sim_sql(sql: str, *more: str) -> str:
    return with_tables("art", sql, *VARIANT_CTES, SIMPLE_CTE, *more)


query(
    "o06_vs_reference",
    sim_sql(
        f"""SELECT experiment, count(*) AS trade_count, {r("sum(profit) - (SELECT sum(profit) FROM rr WHERE predicted = 1)", 2)} AS profit_vs_saved,
        {r("(sum(profit) - (SELECT sum(profit) FROM rr WHERE predicted = 1)) / 10000.0")} AS return_vs_saved, count(*) - (SELECT count(*) FROM rr WHERE predicted = 1) AS trades_vs_saved FROM sim GROUP BY 1"""
    ),
)(
    lambda t: rounded(
        research.vs_reference(
            accounting.totals(all_variants(t), ["experiment"]), accounting.totals(saved(t), [])
        ),
        ["experiment", "trade_count", "trades_vs_saved"], {"profit_vs_saved": 2, "return_vs_saved": 6},
    )
)
query(
    "o07_selection_overlap",
    sim_sql(
        f"""SELECT experiment, count(*) AS selected_trades, count_if(b)::BIGINT AS overlap_trades, {r("count_if(b) / count(*)")} AS overlap_share, {r("count_if(b) / (SELECT count(DISTINCT row_id) FROM rr WHERE predicted = 1)")} AS baseline_retention
        FROM (SELECT DISTINCT experiment, row_id, row_id IN (SELECT row_id FROM rr WHERE predicted = 1) AS b FROM sim) GROUP BY 1"""
    ),
)(
    lambda t: rounded(
        research.overlap(all_variants(t), saved(t), ["experiment"]),
        ["experiment", "selected_trades", "overlap_trades"], {"overlap_share": 6, "baseline_retention": 6},
    )
)
SCOPES = {"execution_open_time": "minute", "artifact_decision_bucket": "decision_bucket_id", "artifact_period_bucket": "period_bucket_id"}
AUDIT_CTE = """bk AS (SELECT 'execution_open_time' AS scope, open_time // 60000 AS bucket, count(*) AS n, count_if(selected_by_topk = 1)::BIGINT AS s, count_if(selected_by_topk = 0 AND net > 0)::BIGINT AS m FROM p0 GROUP BY 2
  UNION ALL SELECT 'artifact_decision_bucket', decision_bucket_id, count(*), count_if(selected_by_topk = 1)::BIGINT, count_if(selected_by_topk = 0 AND net > 0)::BIGINT FROM p0 GROUP BY 2
  UNION ALL SELECT 'artifact_period_bucket', period_bucket_id, count(*), count_if(selected_by_topk = 1)::BIGINT, count_if(selected_by_topk = 0 AND net > 0)::BIGINT FROM p0 GROUP BY 2),
weighted AS (SELECT scope, quantile_cont(n, 0.5) AS w50, quantile_cont(n, 0.9) AS w90 FROM (SELECT scope, n, unnest(range(s)) FROM bk) GROUP BY 1)"""
query(
    "o08_bucket_audit",
    sim_sql(
        f"""SELECT b.scope, 2::BIGINT AS top_k, count(*) AS bucket_count, sum(n)::BIGINT AS candidate_rows, max(n) AS bucket_max, count_if(n <= 2)::BIGINT AS buckets_at_or_below_top_k,
        sum(CASE WHEN n > 2 THEN s ELSE 0 END)::BIGINT AS selected_in_replaceable_buckets, sum(m)::BIGINT AS profitable_nonselected_rows, count_if(m > 0)::BIGINT AS buckets_with_profitable_nonselected, {r("count_if(m > 0) / count(*)")} AS profitable_nonselected_bucket_share,
        max(n) FILTER (WHERE s > 0) AS selected_bucket_max, {r("quantile_cont(n, 0.5)")} AS bucket_p50, {r("quantile_cont(n, 0.9)")} AS bucket_p90, {r("any_value(w50)")} AS selected_bucket_p50, {r("any_value(w90)")} AS selected_bucket_p90,
        {r("sum(CASE WHEN n > 2 THEN s ELSE 0 END) / (SELECT count(*) FROM rr WHERE selected_by_topk = 1)")} AS selected_replaceable_share FROM bk b JOIN weighted w ON w.scope = b.scope GROUP BY 1""",
        AUDIT_CTE,
    ),
)(
    lambda t: rounded(
        research.bucket_audit(research_rows(t), SCOPES),
        ["scope", "top_k", "bucket_count", "candidate_rows", "bucket_max", "buckets_at_or_below_top_k", "selected_in_replaceable_buckets", "profitable_nonselected_rows",
         "buckets_with_profitable_nonselected", "selected_bucket_max"],
        {c: 6 for c in ("bucket_p50", "bucket_p90", "selected_bucket_p50", "selected_bucket_p90", "selected_replaceable_share", "profitable_nonselected_bucket_share")},
    )
)
query(
    "o09_configured_k",
    with_tables("art", "SELECT max(n) AS top_k FROM (SELECT open_time // 60000 AS minute, count(*) AS n FROM art WHERE selected_by_topk = 1 GROUP BY 1)"),
)(lambda t: research.configured_k(t.artifact.withColumn("configured_top_k", F.lit(0))))

FOLD_M_CTE = """fm AS (SELECT e.experiment, f.fold, coalesce(n, 0) AS n, coalesce(p, 0.0) AS p, coalesce(p, 0.0) / 10000.0 AS ret FROM (SELECT DISTINCT experiment FROM sim) e
  CROSS JOIN (SELECT CAST(i AS INTEGER) AS fold FROM range(1, 9) g(i)) f LEFT JOIN (SELECT experiment, fold, count(*) AS n, sum(profit) AS p FROM sim GROUP BY 1, 2) s ON s.experiment = e.experiment AND s.fold = f.fold)"""


def sim_folds(t) -> DataFrame:
    return research.fold_metrics(all_variants(t), 8, ["experiment"], accounting.totals)


query(
    "o10_fold_metrics",
    sim_sql(f"SELECT experiment, fold, n AS trade_count, {r('p', 2)} AS portfolio_profit, {r('ret')} AS portfolio_return FROM fm", FOLD_M_CTE),
)(lambda t: rounded(sim_folds(t), ["experiment", "fold", "trade_count"], {"portfolio_profit": 2, "portfolio_return": 6}))
SUMMARY_COLS = f"""count(*) AS fold_count, sum(n)::BIGINT AS trade_count, {r("sum(p)", 2)} AS portfolio_profit, {r("avg(ret)")} AS mean_fold_return, {r("quantile_cont(ret, 0.5)")} AS median_fold_return,
  {r("min(ret)")} AS worst_fold_return, {r("max(ret)")} AS best_fold_return, count_if(n > 0)::BIGINT AS active_folds, count_if(ret > 0)::BIGINT AS profitable_folds,
  {r("max(greatest(0.0, p)) / (CASE WHEN sum(greatest(0.0, p)) = 0 THEN 1.0 ELSE sum(greatest(0.0, p)) END)")} AS top_fold_profit_share"""
SUMMARY = {"portfolio_profit": 2, **{c: 6 for c in ("mean_fold_return", "median_fold_return", "worst_fold_return", "best_fold_return", "top_fold_profit_share")}}
COUNTS = ["fold_count", "trade_count", "active_folds", "profitable_folds"]
query("o11_fold_summary", sim_sql(f"SELECT experiment, {SUMMARY_COLS} FROM fm GROUP BY 1", FOLD_M_CTE))(
    lambda t: rounded(research.fold_summary(sim_folds(t), ["experiment"]), ["experiment", *COUNTS], SUMMARY)
)
PHASE_CTE = "ph AS (SELECT *, CASE WHEN fold <= 3 THEN 'discovery' WHEN fold <= 6 THEN 'selection' ELSE 'confirmation' END AS phase FROM fm)"


def phase_rows(t, folds):
    return research.phase_matrix(folds, splits.phases(t.spark, 8, "1-3", "4-6", "7-8"), ["experiment"])


query("o12_phase_matrix", sim_sql(f"SELECT experiment, phase, {SUMMARY_COLS} FROM ph GROUP BY 1, 2", FOLD_M_CTE, PHASE_CTE))(
    lambda t: rounded(phase_rows(t, sim_folds(t)), ["experiment", "phase", *COUNTS], SUMMARY)
)


@query(
    "o13_decision",
    sim_sql(
        f"""SELECT best AS best_experiment, {r("best_ret")} AS best_return, {r("base_ret")} AS baseline_return, sel_n AS selection_max_trades, sel_a AS selection_max_active_folds, {r("share")} AS replaceable_share,
        {r("dbl")} AS double_cost_return, concat_ws(';', CASE WHEN best = 'baseline_executed_trades' THEN 'baseline_best' END, CASE WHEN sel_n < 100 OR sel_a < 3 THEN 'selection_underpowered' END,
          CASE WHEN share < 0.1 THEN 'candidate_reselection_sparse' END, CASE WHEN dbl < 0 THEN 'cost_stress_failed' END) AS reasons
        FROM (SELECT arg_max(experiment, (round(rt, 9), -place)) AS best, max(rt) AS best_ret, max(rt) FILTER (WHERE experiment = 'baseline_executed_trades') AS base_ret, arg_max(dbl, (round(rt, 9), -place)) AS dbl
              FROM (SELECT experiment, list_position({research.VARIANTS}, experiment) AS place, sum(profit) / 80000.0 AS rt, sum(position_size * (net - 0.0015)) / 80000.0 AS dbl FROM sim GROUP BY 1)),
             (SELECT max(n)::BIGINT AS sel_n, max(a)::BIGINT AS sel_a FROM (SELECT experiment, sum(n) AS n, count_if(n > 0) AS a FROM ph WHERE phase = 'selection' GROUP BY 1)),
             (SELECT sum(CASE WHEN n > 2 THEN s ELSE 0 END) / (SELECT count(*) FROM rr WHERE selected_by_topk = 1) AS share FROM bk WHERE scope = 'execution_open_time')""",
        AUDIT_CTE, FOLD_M_CTE, PHASE_CTE,
    ),
)
def decision(t):
    sims = all_variants(t)
    rows = accounting.totals(sims, ["experiment"], folds=8)
    dear = sims.withColumn("net", F.col("net") - accounting.COST).withColumn("profit", F.col("position_size") * F.col("net"))
    costs = accounting.totals(dear, ["experiment"], folds=8).withColumn("cost_scenario", F.lit("double_cost"))
    audit = research.bucket_audit(research_rows(t), {"execution_open_time": "minute"})
    out = research.decision(rows, phase_rows(t, sim_folds(t)), audit, costs)
    return rounded(
        out, ["best_experiment", "selection_max_trades", "selection_max_active_folds", "reasons"],
        {"best_return": 6, "baseline_return": 6, "replaceable_share": 6, "double_cost_return": 6},
    )


COMPOSITE_SQL = {
    "median_fold_return": "(quantile_cont(ret, 0.5) + 0.02) / 0.08", "worst_fold_return": "(min(ret) + 0.12) / 0.12", "profitable_fold_rate": "avg(CAST(ret > 0 AS INTEGER))",
    "walkforward_profit_factor": "((SELECT sum(profit) FILTER (WHERE profit > 0) / -sum(profit) FILTER (WHERE profit < 0) FROM ex) - 0.8) / 0.7", "active_fold_rate": "avg(CAST(n > 0 AS INTEGER))",
    "tail_monotonicity": "(SELECT avg(CAST(v >= before AS INTEGER)) FROM (SELECT v, lag(v) OVER (ORDER BY d) AS before FROM (SELECT d, avg(net) AS v FROM dec GROUP BY 1)) WHERE before IS NOT NULL)",
    "double_cost_return": "((SELECT sum(position_size * (net - 0.0015)) FROM ex) / 70000.0 + 0.02) / 0.08",
    "return_without_key_symbol": "(((SELECT sum(profit) FROM ex) - (SELECT max(net_profit) FROM expo)) / 70000.0 + 0.02) / 0.08",
    "return_without_key_fold": "(((sum(p) - max(p)) / 60000.0) + 0.02) / 0.08", "top_symbol_concentration_penalty": "1 - (SELECT max(net_profit_share) FROM shares)",
    "top_fold_concentration_penalty": "1 - max(greatest(0.0, p)) / sum(greatest(0.0, p))", "inactive_fold_penalty": "avg(CAST(n > 0 AS INTEGER))", "threshold_stability": "(SELECT avg(stability) FROM stab)",
}
COMP_CTE = "comp AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS component, greatest(0.0, least(1.0, {s})) AS score FROM fold_rows HAVING count(*) > 0" for n, s in COMPOSITE_SQL.items()
) + ")"


SWEPT_COLUMNS = ["symbol", "trade_day", "fold", "label", "probability", "expected_value", "position_size", "gross", "net", "profit", "predicted"]
EXECUTED_COLUMNS = ["row_id", "open_time", "trade_score", "predicted_return"]  # read of executed rows only


@query(
    "o14_composite_robustness",
    with_tables(
        "ret",
        f"SELECT component, {r('score')} AS score FROM comp UNION ALL SELECT 'composite_robustness_score', {r('avg(score)')} FROM comp",
        EX, FOLDS_CTE, EXPOSURE_CTE, *STABILITY_CTES,
        "dec AS (SELECT net, ceil(10 * row_number() OVER (ORDER BY trade_score, open_time, symbol, row_id) / count(*) OVER ()) AS d FROM ex)",
        COMP_CTE,
    ),
)
def composite_robustness(t):
    rows = stored(t.returns.select(*SWEPT_COLUMNS, *[F.when(F.col("predicted"), F.col(c)).alias(c) for c in EXECUTED_COLUMNS]))  # the join is written once
    df = rows.filter("predicted")
    folds = stored(accounting.totals(df, ["fold"]))  # one row a fold
    exposed = reports.exposure(df)
    loso = research.leave_symbol(df, research.top_symbols(df, 1), folds=7, path=False).select(F.col("portfolio_return").alias("return_without_symbol"))
    lofo = research.leave_fold(folds).agg(F.min("remaining_mean_return").alias("return_without_fold"))
    stress = research.cost_stress(df, folds=7, path=False).filter("cost_scenario = 'double_cost'").select(F.col("portfolio_return").alias("double_cost_return"))
    mono = reports.monotonicity(reports.deciles(df, ["trade_score"]), ["score"]).select("monotonicity")
    facts = df.agg(accounting.profit_factor().alias("profit_factor"))
    top = exposed.agg(F.max("net_profit_share").alias("top_symbol_share"))
    for part in (mono, stress, loso, lofo, top):
        facts = facts.crossJoin(F.broadcast(part))  # one row each
    facts = facts.crossJoin(F.broadcast(fold_stability(t, rows).agg(F.avg("stability").alias("stability"))))  # one row
    return rounded(research.composite(folds, facts), ["component"], {"score": 6})


query(
    "o15_selected_trades",
    sim_sql(
        f"""SELECT experiment, row_id, symbol, {r("CASE WHEN row_id LIKE 'walkforward%' THEN med ELSE position_size END", 3)} AS position_size, CAST(row_id LIKE 'walkforward%' AS INTEGER) AS size_filled FROM sim
        JOIN (SELECT fold, quantile_cont(position_size, 0.5) AS med FROM rr WHERE selected_by_topk = 1 GROUP BY 1) m ON m.fold = sim.fold"""
    ),
)(
    lambda t: research.selected(
        select.fill_sizes(
            research_rows(t),
            all_variants(t).withColumn("position_size", F.when(~F.col("row_id").startswith("walkforward"), F.col("position_size"))),
        )
    ).select("experiment", "row_id", "symbol", rnd("position_size", 3).alias("position_size"), "size_filled")
)
query(
    "o16_parameter_grid",
    with_tables(
        "ret",
        f"""SELECT 't' || th || '_k' || k AS config, count(*) AS trades, {r("sum(profit)", 2)} AS profit, {r("avg(net)")} AS mean_net FROM
        (SELECT *, row_number() OVER (PARTITION BY open_time ORDER BY trade_score DESC, symbol, row_id) AS rk FROM ret), (VALUES (0.2), (0.5), (0.8)) a(th), (VALUES (1), (2), (3)) b(k)
        WHERE trade_score >= th AND rk <= k GROUP BY 1""",
    ),
)(
    lambda t: research.grid(t.returns, [0.2, 0.5, 0.8], [1, 2, 3], "trade_score").groupBy("config").agg(
        n_rows("trades"), rnd(F.sum("profit"), 2).alias("profit"), rnd(F.avg("net")).alias("mean_net")
    )
)

# ---------------------------------------------------------------- ledger

LEDGER_CTE = """tr AS (SELECT CAST(o_orderkey AS VARCHAR) AS trade_id, 'C' || (o_custkey % 20) AS symbol, 'fold_' || (year(o_orderdate) - 1994) AS fold_id, epoch_ms(o_orderdate) / 60000 AS t0,
  epoch_ms(o_orderdate) / 60000 + 7200 AS t1, o_totalprice / 1000 AS notional, ((o_custkey % 7) - 3) / 100 AS gross FROM orders),
ev AS (SELECT trade_id, symbol, fold_id, t0 AS ts, 'position_open' AS kind, 1 AS side, notional, 0.0::DOUBLE AS pnl FROM tr UNION ALL SELECT trade_id, symbol, fold_id, t1, 'position_close', -1, notional, notional * gross FROM tr),
led AS (SELECT *, row_number() OVER (ORDER BY fold_id, ts, side, trade_id) - 1 AS seq, 10000.0 + sum(pnl - notional * 0.00075::DOUBLE) OVER w AS equity, sum(side * notional) OVER w AS exposure, sum(side) OVER w AS positions
  FROM ev WINDOW w AS (PARTITION BY fold_id ORDER BY ts, side, trade_id ROWS UNBOUNDED PRECEDING)),
wat AS (SELECT *, max(equity) OVER (PARTITION BY fold_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS peak FROM led)"""


def led_sql(sql: str, *more: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([LEDGER_CTE, *more]) + "\n" + sql


def ledger_trades(t) -> DataFrame:
    at = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    return t.read("orders").select(
        F.col("o_orderkey").cast("string").alias("trade_id"), F.concat(F.lit("c"), "o_orderkey").alias("candidate_id"),
        F.concat(F.lit("C"), F.col("o_custkey") % 20).alias("symbol"), F.concat(F.lit("fold_"), F.year("o_orderdate") - 1994).alias("fold_id"),
        at.alias("open_time"), (at + 5 * MS_PER_DAY).alias("close_time"), (F.col("o_totalprice") / 1000).alias("notional"),
        ((F.col("o_custkey") % 7 - 3) / 100).alias("gross_return"),
    )


def events(t) -> DataFrame:
    return ledger.from_trades(ledger_trades(t))


query(
    "e08_events_from_trades",
    led_sql(f"SELECT seq AS event_sequence, ts AS timestamp, kind AS event_type, trade_id, {r('equity', 4)} AS equity, {r('exposure', 3)} AS total_open_exposure, CAST(positions AS INTEGER) AS concurrent_position_count FROM led"),
)(
    lambda t: events(t).select(
        "event_sequence", "timestamp", "event_type", "trade_id", rnd("equity", 4).alias("equity"),
        rnd("total_open_exposure", 3).alias("total_open_exposure"), "concurrent_position_count",
    )
)


@query(
    "s25_ledger_sink",
    led_sql("SELECT fold_id, count(*) AS events, min(seq) AS first_sequence, max(seq) AS last_sequence, 24 AS columns FROM led GROUP BY 1"),
)
def ledger_sink(t):
    path = scratch(t.spark, "ledger")
    ledger.write(events(t), path)
    stored = t.spark.read.parquet(path)
    return stored.groupBy("fold_id").agg(
        n_rows("events"), F.min("event_sequence").alias("first_sequence"), F.max("event_sequence").alias("last_sequence"),
        F.lit(len(stored.columns)).alias("columns"),
    )


query(
    "e01_ledger_totals",
    led_sql(
        f"""SELECT fold_id, count(*) AS event_count, {r("arg_min(equity, seq)", 4)} AS starting_capital, {r("arg_max(equity, seq)", 4)} AS ending_capital, {r("sum(notional * 0.0005)", 4)} AS total_fees,
        {r("sum(notional * 0.00025)", 4)} AS total_slippage, {r("arg_max(equity, seq) - arg_min(equity, seq)", 4)} AS portfolio_profit, {r("(arg_max(equity, seq) - arg_min(equity, seq)) / arg_min(equity, seq)")} AS portfolio_return FROM led GROUP BY 1"""
    ),
)(
    lambda t: rounded(
        ledger.totals(events(t), ["fold_id"]), ["fold_id", "event_count"],
        {"starting_capital": 4, "ending_capital": 4, "total_fees": 4, "total_slippage": 4, "portfolio_profit": 4, "portfolio_return": 6},
    )
)
query(
    "e02_ledger_exposure",
    led_sql(
        f"""SELECT fold_id, CAST(max(positions) AS INTEGER) AS max_concurrent_positions, {r("max(exposure)", 3)} AS maximum_open_exposure, {r("max(exposure / equity) FILTER (WHERE equity > 0)", 5)} AS maximum_capital_utilization FROM led GROUP BY 1"""
    ),
)(
    lambda t: rounded(
        ledger.totals(events(t), ["fold_id"]), ["fold_id", "max_concurrent_positions"], {"maximum_open_exposure": 3, "maximum_capital_utilization": 5}
    )
)
WATER_CTE = """st AS (SELECT *, max(CASE WHEN equity >= peak THEN seq END) OVER (PARTITION BY fold_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS stretch FROM wat),
spans AS (SELECT fold_id, stretch, min(ts) AS a, max(ts) AS b, max((peak - equity) / peak) AS gap FROM st WHERE equity < peak GROUP BY 1, 2),
recov AS (SELECT s.fold_id, s.stretch, min(x.ts) AS back FROM spans s JOIN st x ON x.fold_id = s.fold_id AND x.equity >= x.peak AND x.seq > s.stretch GROUP BY 1, 2)"""
query(
    "e03_ledger_drawdown",
    led_sql(
        f"""SELECT s.fold_id, {r("max(gap)")} AS max_drawdown, max(b - a) AS longest_underwater_minutes, coalesce(max(back - a), 0.0) AS time_to_recovery_minutes FROM spans s
        LEFT JOIN recov q ON q.fold_id = s.fold_id AND q.stretch = s.stretch GROUP BY 1""",
        WATER_CTE,
    ),
)(lambda t: ledger.drawdown(events(t), ["fold_id"]).withColumn("max_drawdown", rnd("max_drawdown")))
query(
    "e04_symbol_exposure",
    led_sql(
        f"""SELECT fold_id, {r("max(held / equity) FILTER (WHERE equity > 0)", 5)} AS maximum_per_symbol_exposure FROM (
        SELECT l.fold_id, l.equity, sum(CASE WHEN l.symbol = s.symbol THEN side * notional ELSE 0.0 END) OVER (PARTITION BY l.fold_id, s.symbol ORDER BY seq ROWS UNBOUNDED PRECEDING) AS held
        FROM led l CROSS JOIN (SELECT DISTINCT symbol FROM tr) s) GROUP BY 1"""
    ),
)(lambda t: rounded(ledger.symbol_exposure(events(t)), ["fold_id"], {"maximum_per_symbol_exposure": 5}))


def reported(t) -> DataFrame:
    n = F.col("notional")
    wrong = F.when(F.col("fold_id") == "fold_3", 1.0).otherwise(0.0)
    return ledger_trades(t).groupBy("fold_id").agg((F.sum(n * 0.001) + F.max(wrong)).alias("reported_fees"), F.sum(n * 0.0005).alias("reported_slippage"))


query(
    "e05_reconciliation",
    led_sql("SELECT fold_id, count(*) AS event_count, CASE WHEN fold_id = 'fold_3' THEN 'failed' ELSE 'passed' END AS status, 'exact_realized' AS drawdown_precision FROM led GROUP BY 1"),
)(lambda t: ledger.reconcile(events(t), reported(t)).select("fold_id", "event_count", "status", "drawdown_precision"))
query(
    "e06_ledger_by_fold",
    led_sql(
        f"""SELECT 'failed' AS status, count(*) AS event_count, count(DISTINCT fold_id) AS fold_count, CAST(max(positions) AS INTEGER) AS max_concurrent_positions, {r("max(exposure)", 3)} AS maximum_open_exposure,
        {r("max((peak - equity) / peak)")} AS max_drawdown FROM wat"""
    ),
)(
    lambda t: rounded(
        ledger.by_fold(ledger.reconcile(events(t), reported(t))), ["status", "event_count", "fold_count", "max_concurrent_positions"],
        {"maximum_open_exposure": 3, "max_drawdown": 6},
    )
)
query(
    "e07_match_candidates",
    """SELECT count(*) AS opened, count_if(o_orderstatus <> 'P')::BIGINT AS executed, count_if(o_orderstatus = 'P')::BIGINT AS opened_only, 0::BIGINT AS executed_only, count_if(o_orderstatus = 'P') = 0 AS matched FROM orders""",
)(
    lambda t: ledger.match_candidates(
        events(t), t.read("orders").filter("o_orderstatus <> 'P'").select(F.concat(F.lit("c"), "o_orderkey").alias("candidate_id"))
    )
)

# ---------------------------------------------------------------- models

FEATURES = ["ret_5m", "ret_60m", "rolling_volatility_60m", "rolling_volume_zscore_60m", "taker_buy_ratio", "log_quote_volume"]
CUT_TRAIN, CUT_VAL = 1705536000000, 1705968000000  # 2024-01-18 and 2024-01-23


def model_rows(t) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Eligible bars with features and outcomes, cut by time into train, validation and test."""
    df = labels.outcomes(features.base(t.bars), WINDOW, mode="future_high", growth=TARGET)
    df = df.filter((F.col("_row") > features.HOUR) & F.col("forward_return").isNotNull())
    df = df.withColumn("net", F.col("trade_return") - accounting.COST).withColumn("day_index", F.floor(F.col("open_time") / MS_PER_DAY).cast("int"))
    df = df.select("symbol", "open_time", "day_index", "label", "trade_return", "net", *FEATURES)
    # The fits below read these rows many times; stored, the features are computed once.
    df = stored(df)
    return df.filter(F.col("open_time") < CUT_TRAIN), df.filter(F.col("open_time").between(CUT_TRAIN, CUT_VAL - 1)), df.filter(F.col("open_time") >= CUT_VAL)


CAND_FEATURES = ["probability", "trade_score", "uncertainty", "quote_volume"]
query(
    "m01_scaler",
    with_tables("cand", " UNION ALL ".join(f"SELECT '{c}' AS feature, {r(f'avg({c})', 3)} AS mean, {r(f'stddev_pop({c})', 3)} AS stddev FROM cand WHERE fold <= 5" for c in CAND_FEATURES)),
)(lambda t: rounded(models.scaler(t.candidates.filter("fold <= 5"), CAND_FEATURES), ["feature"], {"mean": 3, "stddev": 3}))
query(
    "m02_class_weight",
    with_tables(
        "cand",
        f"""SELECT symbol, count_if(label = 1)::BIGINT AS positives, count_if(label = 0)::BIGINT AS negatives, {r("least(2.0, count_if(label = 0) / count_if(label = 1))")} AS positive_weight FROM cand GROUP BY 1""",
    ),
)(lambda t: rounded(models.class_weight(t.candidates, 2.0, keys=["symbol"]), ["symbol", "positives", "negatives"], {"positive_weight": 6}))


@query("m03_logistic")
def logistic(t):
    train, _, test = model_rows(t)
    return models.evaluate(models.logistic(train, FEATURES).score(test, "score"), "score", 0.5)


@query("m04_boosted_trees")
def boosted_trees(t):
    train, val, test = model_rows(t)
    model = models.gbt(train, val, FEATURES, "classifier", "label")
    return models.evaluate(model.score(test, "score"), "score", 0.5)


@query("m05_ranker")
def rank_groups(t):
    train, val, test = model_rows(t)
    cuts = labels.grade_cuts(train, "net", 0.25, 0.5, 0.75)
    graded = [labels.relevance(d, cuts, "net") for d in (train, val)]
    scored = ranker.fit(*graded, FEATURES, "grade", ["open_time"], rounds=10).score(test, "ranker_score")
    top = select.topk(scored.withColumn("row_id", F.col("symbol")), 1, ["open_time"], [F.desc("ranker_score"), F.col("symbol")])
    return top.agg(n_rows("picks"), rnd(F.avg("net")).alias("mean_net"), rnd(F.avg("label")).alias("precision"))


GRADED_CTE = """graded AS (SELECT row_id, open_time, probability AS s, CASE WHEN net > 0.06 THEN 4 WHEN net > 0.03 THEN 3 WHEN net > 0 THEN 1 ELSE 0 END AS grade FROM ret)"""


def graded_candidates(t) -> DataFrame:
    grade = F.when(F.col("net") > 0.06, 4).when(F.col("net") > 0.03, 3).when(F.col("net") > 0, 1).otherwise(0)
    return t.returns.select("row_id", "open_time", F.col("probability").alias("s"), grade.alias("grade"))


def gradient_totals(t, objective: str) -> DataFrame:
    df = ranker.gradients(graded_candidates(t), ["open_time"], "grade", "s", objective)
    return df.groupBy("open_time", "grade").agg(n_rows(), rnd(F.sum("gradient")).alias("gradient"), rnd(F.sum("hessian")).alias("hessian"))


query(
    "m05_pairwise_gradients",
    with_tables(
        "ret",
        f"""SELECT open_time, grade, count(*) AS rows, {r("sum(g)")} AS gradient, {r("sum(h)")} AS hessian FROM (
          SELECT a.open_time, a.row_id, a.grade, sum(CASE WHEN a.grade > b.grade THEN -exp(b.s - a.s) ELSE exp(a.s - b.s) END) / any_value(n) AS g,
            sum(CASE WHEN a.grade > b.grade THEN exp(b.s - a.s) ELSE exp(a.s - b.s) END) / any_value(n) AS h
          FROM graded a JOIN graded b ON a.open_time = b.open_time AND a.grade <> b.grade JOIN pairs p ON p.open_time = a.open_time GROUP BY ALL) GROUP BY 1, 2""",
        GRADED_CTE,
        "pairs AS (SELECT a.open_time, count(*) AS n FROM graded a JOIN graded b ON a.open_time = b.open_time AND a.grade > b.grade GROUP BY 1)",
    ),
)(lambda t: gradient_totals(t, ranker.PAIRWISE))
query(
    "m05_listwise_gradients",
    with_tables(
        "ret",
        f"""SELECT open_time, grade, count(*) AS rows, {r("sum(p - y)")} AS gradient, {r("sum(p * (1 - p))")} AS hessian FROM (
          SELECT open_time, grade, exp(s) / sum(exp(s)) OVER g AS p, (2 ** grade - 1) / nullif(sum(2 ** grade - 1) OVER g, 0) AS y FROM graded WINDOW g AS (PARTITION BY open_time))
        WHERE y IS NOT NULL GROUP BY 1, 2""",
        GRADED_CTE,
    ),
)(lambda t: gradient_totals(t, ranker.LISTWISE))
query(
    "m05_ndcg",
    with_tables(
        "ret",
        f"""SELECT open_time, {r("sum(CASE WHEN i <= 5 THEN gain / log2(i + 1) ELSE 0.0 END)")} AS dcg, {r("sum(CASE WHEN j <= 5 THEN gain / log2(j + 1) ELSE 0.0 END)")} AS ideal,
          {r("sum(CASE WHEN i <= 5 THEN gain / log2(i + 1) ELSE 0.0 END) / nullif(sum(CASE WHEN j <= 5 THEN gain / log2(j + 1) ELSE 0.0 END), 0)")} AS ndcg FROM (
          SELECT open_time, 2.0 ** grade - 1 AS gain, row_number() OVER (PARTITION BY open_time ORDER BY s DESC, row_id) AS i,
            row_number() OVER (PARTITION BY open_time ORDER BY grade DESC, row_id) AS j FROM graded) GROUP BY 1""",
        GRADED_CTE,
    ),
)(lambda t: rounded(ranker.ndcg(graded_candidates(t), ["open_time"], "s", "grade", 5, [F.col("row_id")]), ["open_time"], {"dcg": 6, "ideal": 6, "ndcg": 6}))


@query("m06_batch_score")
def batch_score(t):
    train, _, test = model_rows(t)
    return models.logistic(train, FEATURES).score(test, "score").select("symbol", "open_time", rnd("score").alias("score"))


@query("m07_importance")
def importance(t):
    train, val, _ = model_rows(t)
    return models.gbt(train, val, FEATURES, "regressor", "trade_return").importance()


@query("m08_ensemble")
def ensemble(t):
    train, _, test = model_rows(t)
    rows = train.withColumn("month_index", F.col("day_index"))  # days stand in for months
    out = models.ensemble(rows, [7, 0, 7], lambda d: models.logistic(d, FEATURES), test, "score")
    return models.evaluate(out, "score", 0.5)


@query("m09_meta_filter")
def meta_filter(t):
    train, val, test = model_rows(t)
    kept, verdict = models.meta_filter(train, val, test, FEATURES, 0.55, 50)
    counts = kept.agg(n_rows(), F.count_if("meta_kept").alias("kept_rows"))
    return counts.crossJoin(F.broadcast(verdict.select("enabled", "reason")))  # one row


query(
    "m10_keep_filter",
    with_tables(
        "ret",
        """SELECT symbol, b.n AS trades, coalesce(f.n, 0) AS filtered_trades, CASE WHEN coalesce(f.n, 0) < 250 THEN 'too_few_trades' WHEN f.p < b.p THEN 'precision_dropped' WHEN f.s < b.s THEN 'score_dropped' ELSE '' END AS reason
        FROM (SELECT symbol, count(*) AS n, avg(label) AS p, avg(net) AS s FROM ret GROUP BY 1) b LEFT JOIN
        (SELECT symbol, count(*) AS n, avg(label) AS p, avg(net) AS s FROM ret WHERE probability >= 0.55 GROUP BY 1) f USING (symbol)""",
    ),
)(
    lambda t: models.keep_filter(
        models.filter_row(t.returns, ["symbol"]), models.filter_row(t.returns.filter("probability >= 0.55"), ["symbol"]), ["symbol"], 250
    ).select("symbol", "trades", F.coalesce("filtered_trades", F.lit(0)).alias("filtered_trades"), "reason")
)


@query("m11_coefficients")
def coefficients(t):
    train, _, _ = model_rows(t)
    return models.logistic(train, FEATURES).coefficients()


# ---------------------------------------------------------------- streams


def trade_stream(t) -> DataFrame:
    """The events table as a file stream."""
    schema = t.read("events").schema
    raw = t.spark.readStream.schema(schema).parquet(f"{t.folder}/events.parque[t]")
    return raw.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("symbol"), (F.col("value") + 1).alias("price"),
        (1 + F.col("user_id") % 7).cast("double").alias("quantity"), (F.col("event_id") % 2 == 1).alias("is_buyer_maker"),
    )


def drained(t, stream: DataFrame, name: str) -> DataFrame:
    """Runs an append stream over all present files into a table and reads it back."""
    path, log = scratch(t.spark, name), scratch(t.spark, f"{name}-log")
    run = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", log).outputMode("append").trigger(availableNow=True)
    run.start().awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(path)


query(
    "st01_stream_bars",
    with_tables(
        "bars",
        f"""SELECT symbol, open_time, {r("open")} AS open, {r("high")} AS high, {r("low")} AS low, {r("close")} AS close, {r("volume")} AS volume, trades FROM bars
        WHERE open_time + 3600000 <= (SELECT max(trade_us) // 1000 - 600000 FROM trades)""",
    ),
)(
    lambda t: drained(t, streams.bars(trade_stream(t), "1 hour", "10 minutes", ["event_id"]), "stream-bars").select(
        "symbol", "open_time", *[rnd(c).alias(c) for c in ("open", "high", "low", "close", "volume")], "trades"
    )
)
query(
    "st02_stream_cooldown",
    with_tables(
        "trades",
        "SELECT symbol, minute FROM acc WHERE minute < ((SELECT max(trade_us) // 1000 FROM trades) - 600000) // 60000",
        "mins AS (SELECT DISTINCT symbol, trade_time // 60000 AS minute FROM trades)",
        """acc AS (SELECT symbol, min(minute) AS minute FROM mins GROUP BY 1 UNION ALL
          SELECT a.symbol, min(m.minute) FROM acc a JOIN mins m ON m.symbol = a.symbol AND m.minute >= a.minute + 90 GROUP BY a.symbol, a.minute)""",
    ),
)(
    lambda t: drained(
        t, streams.cooldown(trade_stream(t).select("symbol", F.unix_millis("ts").alias("open_time")), 90), "stream-cooldown"
    )
)


@query(
    "st03_stream_topk",
    with_tables(
        "trades",
        """SELECT bucket, row_id FROM (SELECT trade_time // 3600000 AS bucket, CAST(event_id AS VARCHAR) AS row_id, price, symbol FROM trades)
        WHERE bucket < (SELECT max(trade_time) // 3600000 FROM trades) QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY price DESC, symbol, row_id) <= 3""",
    ),
)
def stream_topk(t):
    path, log = scratch(t.spark, "stream-topk"), scratch(t.spark, "stream-topk-log")
    rows = trade_stream(t).select(
        "symbol", F.col("event_id").cast("string").alias("row_id"), F.col("price").alias("trade_score"), F.floor(F.unix_millis("ts") / 3_600_000).alias("bucket")
    )
    sink = streams.topk_sink(path, 3, ["bucket"], "trade_score")
    rows.writeStream.foreachBatch(sink).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    newest = t.trades.agg(F.max(F.floor(F.col("trade_time") / 3_600_000))).first()[0]  # one number
    return streams.closed_topk(t.spark, path, 3, ["bucket"], "trade_score", F.col("bucket") < newest).select("bucket", "row_id")


query(
    "st04_stream_side_ratio",
    with_tables(
        "trades",
        f"""SELECT symbol, strftime(d, '%Y-%m-%d') AS first_day, count_if(NOT is_buyer_maker)::BIGINT AS buy_trades_3d, count_if(is_buyer_maker)::BIGINT AS sell_trades_3d,
        {r("count_if(NOT is_buyer_maker) / count_if(is_buyer_maker)")} AS buy_sell_ratio FROM trades JOIN (SELECT DISTINCT unnest([date_trunc('day', make_timestamp(trade_us)) - INTERVAL 1 DAY * i FOR i IN range(3)]) AS d FROM trades)
        ON make_timestamp(trade_us) >= d AND make_timestamp(trade_us) < d + INTERVAL 3 DAY WHERE d + INTERVAL 3 DAY <= (SELECT max(make_timestamp(trade_us)) - INTERVAL 1 HOUR FROM trades) GROUP BY 1, 2""",
    ),
)(
    lambda t: drained(t, streams.side_ratio(trade_stream(t)), "stream-ratio").select(
        "symbol", "first_day", "buy_trades_3d", "sell_trades_3d", rnd("buy_sell_ratio").alias("buy_sell_ratio")
    )
)
