"""What-if research over saved candidates: variants, leave-one-out, stress, audits and the decision row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import MS_PER_MINUTE, floor_div, safe_ratio
from ..session import stored
from . import accounting, prefix, quantiles, reports, select
from .accounting import CAPITAL, COST

# The research variants and the limits of the decision row.
TOP_K = 2
MIN_SELECTION_TRADES = 100
MIN_SELECTION_FOLDS = 3
MIN_REPLACEABLE_SHARE = 0.10
VARIANTS = [
    "baseline_executed_trades",
    "baseline_selected_by_topk",
    "score_replay_trade_score",
    "cross_sectional_score_zscore",
    "cross_sectional_score_rank",
    "exposure_aware_trade_score_penalty",
    "exposure_aware_trade_share_cap_35pct",
    "calibration_plus_normalization",
    "calibration_plus_concentration_control",
    "score_edge_disabled",
    "symbol_filter_disabled",
    "score_edge_and_symbol_filter_disabled",
]
COST_SCENARIOS = {"baseline_cost": 0.0, "double_cost": COST, "triple_cost": 2 * COST}


def tagged(parts: dict[str, DataFrame], name: str = "experiment") -> DataFrame:
    return reduce(DataFrame.unionByName, [df.withColumn(name, F.lit(n)) for n, df in parts.items()])


def variant_metrics(
    df: DataFrame, variants: dict[str, tuple[Column, float]], folds: int = 1, capital: float = CAPITAL, order: list | None = None, path: bool = True
) -> DataFrame:
    """One portfolio row per variant (rows kept, extra cost) in a single pass over the trades. Without `path` the rows are not ordered and
    there is no max_drawdown.

    Every variant is a few more aggregate columns: one range shuffle gives all the drawdowns, and the day
    and symbol counts come from per-day and per-symbol totals, so no row is repeated per variant.
    """
    order = order or accounting.ORDER
    names = list(variants)
    cols, net = [], F.col("net")
    for i, (keep, extra) in enumerate(variants.values()):
        cols.append(F.when(keep, net - extra).alias(f"_n{i}"))
        cols.append(F.when(keep, F.col("position_size") * (net - extra)).alias(f"_p{i}"))
    needed = dict.fromkeys([c for c in order if isinstance(c, str)] + ["symbol", "trade_day", "gross"])
    wide = df.select(*needed, *cols)

    each = range(len(names))
    aggs = []
    for i in each:
        n, p = F.col(f"_n{i}"), F.col(f"_p{i}")
        aggs += [
            F.count(n).alias(f"trade_count_{i}"),
            F.coalesce(F.sum(p), F.lit(0.0)).alias(f"portfolio_profit_{i}"),
            F.coalesce(F.avg(F.when(n.isNotNull(), F.col("gross"))), F.lit(0.0)).alias(f"avg_gross_return_{i}"),
            F.coalesce(F.avg(n), F.lit(0.0)).alias(f"avg_net_return_{i}"),
            F.coalesce(F.avg((n > 0).cast("double")), F.lit(0.0)).alias(f"win_rate_{i}"),
            accounting.profit_factor(p).alias(f"profit_factor_{i}"),
        ]
    rows = wide.agg(*aggs)
    days = wide.groupBy("trade_day").agg(*[F.count(f"_n{i}").alias(f"_c{i}") for i in each])
    days = days.agg(*[F.count_if(F.col(f"_c{i}") > 0).alias(f"active_days_{i}") for i in each])
    per = wide.groupBy("symbol").agg(
        *[F.count(f"_n{i}").alias(f"_c{i}") for i in each],
        *[F.greatest(F.lit(0.0), F.coalesce(F.sum(f"_p{i}"), F.lit(0.0))).alias(f"_g{i}") for i in each],
    )
    aggs = []
    for i in each:
        aggs += [
            F.count_if(F.col(f"_c{i}") > 0).alias(f"active_symbols_{i}"),
            safe_ratio(F.max(f"_g{i}"), F.sum(f"_g{i}")).alias(f"top_symbol_profit_share_{i}"),
            safe_ratio(F.max(f"_c{i}"), F.sum(f"_c{i}")).alias(f"top_symbol_trade_share_{i}"),
        ]
    symbols = per.agg(*aggs)
    wide_row = rows.crossJoin(F.broadcast(days)).crossJoin(F.broadcast(symbols))
    measures = [
        "trade_count", "portfolio_profit", "avg_gross_return", "avg_net_return", "win_rate", "profit_factor", "active_days",
        "active_symbols", "top_symbol_profit_share", "top_symbol_trade_share",
    ]
    if path:
        gains = {f"_e{i}": F.coalesce(F.col(f"_p{i}"), F.lit(0.0)) for i in each}
        narrow = wide.select(*[o for o in order if isinstance(o, str)], *[f"_p{i}" for i in each]) if all(isinstance(o, str) for o in order) else wide
        run = prefix.ordered(narrow, [], order, sums=gains, highs={f"_k{i}": f"_e{i}" for i in each})
        falls = []
        for i in each:
            peak = F.greatest(F.col(f"_k{i}"), F.lit(0.0)) + capital
            falls.append(F.max((peak - F.col(f"_e{i}") - capital) / peak).alias(f"max_drawdown_{i}"))
        wide_row = wide_row.crossJoin(F.broadcast(run.agg(*falls)))
        measures.append("max_drawdown")
    structs = [
        F.struct(F.lit(n).alias("variant"), *[F.col(f"{m}_{i}").alias(m) for m in measures]) for i, n in enumerate(names)
    ]
    out = wide_row.select(F.explode(F.array(*structs)).alias("v")).select("v.*")
    return out.withColumn("portfolio_return", F.col("portfolio_profit") / (capital * max(1, folds)))


def top_symbols(df: DataFrame, n: int) -> list[str]:
    """The n symbols on top of the exposure order: n names on the driver."""
    ordered = reports.exposure(df).orderBy(*reports.exposure_order())
    return [row[0] for row in ordered.select("symbol").limit(n).collect()]


def leave_each_symbol(df: DataFrame, folds: int = 1, capital: float = CAPITAL) -> DataFrame:
    """What is left without each symbol in turn, for every symbol: the whole minus the symbol's part, from one row a (symbol, day)."""
    cells = df.groupBy("symbol", "trade_day").agg(
        F.count(F.lit(1)).alias("n"), F.sum("profit").alias("p"), F.sum("net").alias("s"), F.count_if(F.col("net") > 0).alias("w")
    )
    alone = cells.groupBy("trade_day").agg(F.count(F.lit(1)).alias("k"), F.min("symbol").alias("symbol")).filter("k = 1")
    alone = alone.groupBy("symbol").agg(F.count(F.lit(1)).alias("own_days"))
    part = cells.groupBy("symbol").agg(*[F.sum(c).alias(c) for c in "npsw"])
    whole = part.agg(*[F.sum(c).alias(f"all_{c}") for c in "npsw"], F.count(F.lit(1)).alias("symbols"))
    days = df.select("trade_day").distinct().agg(F.count(F.lit(1)).alias("days"))
    out = part.join(alone, "symbol", "left").crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(days))  # one row each
    left = F.col("all_n") - F.col("n")
    gain = F.col("all_p") - F.col("p")
    return out.select(
        F.col("symbol").alias("removed_symbol"), left.alias("trade_count"), gain.alias("portfolio_profit"), safe_ratio(F.col("all_s") - F.col("s"), left).alias("avg_net_return"),
        safe_ratio(F.col("all_w") - F.col("w"), left).alias("win_rate"), (F.col("days") - F.coalesce("own_days", F.lit(0))).alias("active_days"),
        (F.col("symbols") - 1).alias("active_symbols"), F.col("n").alias("removed_trades"), (gain / (capital * max(1, folds))).alias("portfolio_return"),
        (-F.col("p") / (capital * max(1, folds))).alias("return_delta"),
    )


def leave_symbol(df: DataFrame, symbols: list[str], folds: int = 1, path: bool = True) -> DataFrame:
    """Metrics without each symbol, and their distance from the whole."""
    variants = {"": (F.lit(True), 0.0)} | {s: (F.col("symbol") != s, 0.0) for s in symbols}
    table = variant_metrics(df, variants, folds, path=path)
    whole = table.filter(F.col("variant") == "").select(
        F.col("portfolio_return").alias("baseline_return"), F.col("trade_count").alias("baseline_trades"),
        F.col("top_symbol_profit_share").alias("baseline_top_share"),
    )
    out = table.filter(F.col("variant") != "").crossJoin(F.broadcast(whole))  # one row
    return out.withColumnRenamed("variant", "removed_symbol").withColumns(
        {
            "return_delta": F.col("portfolio_return") - F.col("baseline_return"),
            "removed_trades": F.col("baseline_trades") - F.col("trade_count"),
        }
    )


def leave_fold(folds: DataFrame, capital: float = CAPITAL) -> DataFrame:
    """Per removed fold what remains. `folds` has one row per fold."""
    a = folds.select(
        F.col("fold").alias("removed_fold"), F.col("portfolio_profit").alias("removed_profit"), F.col("portfolio_return").alias("removed_return")
    )
    total = folds.agg(F.sum(F.greatest(F.lit(0.0), F.col("portfolio_profit"))).alias("_gain"))
    rest = a.join(F.broadcast(folds), F.col("fold") != F.col("removed_fold"), "left")  # one row per fold; a single fold leaves none
    out = rest.groupBy("removed_fold", "removed_profit", "removed_return").agg(
        F.coalesce(F.sum("portfolio_profit"), F.lit(0.0)).alias("remaining_profit"),
        F.coalesce(F.sum("portfolio_profit") / (capital * F.count("fold")), F.lit(0.0)).alias("remaining_mean_return"),
        F.coalesce(F.percentile("portfolio_return", 0.5), F.lit(0.0)).alias("remaining_median_return"),
        F.coalesce(F.min("portfolio_return"), F.lit(0.0)).alias("remaining_worst_return"),
        F.count_if(F.col("trade_count") > 0).alias("remaining_active_folds"),
        F.count_if(F.col("portfolio_return") > 0).alias("remaining_profitable_folds"),
    )
    gain = F.when(F.col("_gain") == 0, 1.0).otherwise(F.col("_gain"))
    share = F.greatest(F.lit(0.0), F.col("removed_profit")) / gain
    return out.crossJoin(F.broadcast(total)).withColumn("removed_profit_share", share).drop("_gain")  # one row


def cost_stress(df: DataFrame, folds: int = 1, path: bool = True) -> DataFrame:
    """Portfolio rows at one, two and three times the round-trip cost."""
    table = variant_metrics(df, {n: (F.lit(True), extra) for n, extra in COST_SCENARIOS.items()}, folds, path=path)
    cost = F.create_map(*[x for n, e in COST_SCENARIOS.items() for x in (F.lit(n), F.lit(COST + e))])
    return table.withColumnRenamed("variant", "cost_scenario").withColumn("round_trip_cost", cost[F.col("cost_scenario")])


def matrix(df: DataFrame) -> DataFrame:
    """Rows of the six post-selection variants under `experiment`."""
    df = stored(df)
    middle = quantiles.exact(df, [], "trade_score", {"_med": 0.5}).select("_med")
    top_half = df.crossJoin(F.broadcast(middle)).filter(F.col("trade_score") >= F.col("_med")).drop("_med")  # one row
    dear = df.withColumn("net", F.col("net") - COST).withColumn("profit", F.col("position_size") * F.col("net"))
    return tagged(
        {
            "corrected_frozen_baseline": df,
            "executed_nonnegative_expected_value_only": df.filter(F.col("expected_value") >= 0),
            "executed_trade_score_top_half_only": top_half,
            "executed_unique_symbol_per_day": select.best_per_day(df),
            "executed_symbol_trade_share_cap_35pct": select.share_cap(df, 0.35),
            "corrected_baseline_double_cost": dear,
        }
    )


def variants(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows of the twelve selection variants under `experiment`, with `columns` (default: all). Needs the artifact's flags, `trade_score`,
    `row_id` and the columns of the blended score. `df` is read many times and should be stored; the baselines are its rows, the picks are
    stored here. Only rows that reach the score of enough symbols of their bucket are ordered."""
    columns = columns or df.columns
    pool = select.pool(df)
    bucket = ["open_time"]

    def best(rows, score):
        return select.topk(select.heads(rows, TOP_K, bucket, score), TOP_K, bucket, select.score_order(rows, score), per_symbol=1)

    scale = select.score_spread(pool, "trade_score")

    def penalised(rows, score, strength, cap=0.0):
        return select.exposure_penalty(rows, score, strength, TOP_K, cap=cap, scale=scale)

    blended = select.blend(pool, bucket)
    heads = stored(select.heads(pool, TOP_K, bucket, "trade_score"))  # a z-score or rank inside the bucket keeps its order
    replays = {
        "score_replay_trade_score": best(heads, "trade_score"),
        "cross_sectional_score_zscore": best(select.zscore(heads, {"trade_score": "_s"}, bucket, of=pool), "_s"),
        "cross_sectional_score_rank": best(select.pct_rank(heads, "trade_score", "_s", bucket, of=pool), "_s"),
        "exposure_aware_trade_score_penalty": penalised(pool, "trade_score", 0.75),
        "exposure_aware_trade_share_cap_35pct": penalised(pool, "trade_score", 0.35, 0.35),
        "calibration_plus_normalization": best(blended, "blended_score"),
        "calibration_plus_concentration_control": penalised(blended, "blended_score", 0.50, 0.35),
        "score_edge_disabled": best(select.pool(df, score_edge=False), "trade_score"),
        "symbol_filter_disabled": best(select.pool(df, symbol=False), "trade_score"),
        "score_edge_and_symbol_filter_disabled": best(select.pool(df, False, False), "trade_score"),
    }
    parts = {"baseline_executed_trades": select.baseline_executed(df), "baseline_selected_by_topk": select.baseline_selected(df)}
    picks = stored(tagged({n: d.select(*columns) for n, d in replays.items()}))
    return tagged({n: d.select(*columns) for n, d in parts.items()}).unionByName(picks)


def vs_reference(metrics: DataFrame, reference: DataFrame) -> DataFrame:
    """Distance of each row from the saved reference row (profit, return and trades)."""
    saved = reference.select(
        F.col("portfolio_profit").alias("saved_profit"), F.col("portfolio_return").alias("saved_return"), F.col("trade_count").alias("saved_trades")
    )
    joined = metrics.crossJoin(F.broadcast(saved))  # one row
    return joined.withColumns(
        {
            "profit_vs_saved": F.col("portfolio_profit") - F.col("saved_profit"),
            "return_vs_saved": F.col("portfolio_return") - F.col("saved_return"),
            "trades_vs_saved": F.col("trade_count") - F.col("saved_trades"),
        }
    )


def overlap(selected: DataFrame, baseline: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Distinct ids of both sides and of their intersection, per key of the selected side."""
    keys = keys or []
    mine = selected.select(*keys, "row_id").distinct()
    base = baseline.select("row_id").distinct()
    size = base.agg(F.count(F.lit(1)).alias("baseline_trades"))
    both = mine.join(base.withColumn("_in", F.lit(1)), "row_id", "left")
    out = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("selected_trades"), F.count("_in").alias("overlap_trades"))
    out = out.crossJoin(F.broadcast(size))  # one row
    return out.withColumns(
        {
            "overlap_share": safe_ratio(F.col("overlap_trades"), F.col("selected_trades")),
            "baseline_retention": safe_ratio(F.col("overlap_trades"), F.col("baseline_trades")),
        }
    )


def configured_k(df: DataFrame) -> DataFrame:
    """One row: the largest configured k, else the largest number of picks in a minute."""
    told = df.agg(F.max(F.when(F.col("configured_top_k") > 0, F.col("configured_top_k"))).alias("_told"))
    seen = select.baseline_selected(df).groupBy(floor_div("open_time", MS_PER_MINUTE).alias("_minute")).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n").alias("_seen"))
    both = told.crossJoin(F.broadcast(seen))  # one row
    return both.select(F.coalesce(F.col("_told").cast("bigint"), F.col("_seen"), F.lit(0)).alias("top_k"))


def bucket_audit(df: DataFrame, scopes: dict[str, str]) -> DataFrame:
    """Per bucket definition (scope name to column): sizes, how many picks could have been replaced, and
    profitable candidates that were left. Needs `net` and the artifact's flags."""
    picked = F.col("selected_by_topk") == 1
    parts = F.explode(F.array(*[F.struct(F.lit(n).alias("scope"), F.col(c).cast("string").alias("bucket")) for n, c in scopes.items()]))
    rows = select.pool(df).select(picked.alias("_sel"), (~picked & (F.col("net") > 0)).alias("_missed"), parts.alias("_p"))
    rows = rows.select("_sel", "_missed", "_p.*").filter(F.col("bucket").isNotNull())
    buckets = rows.groupBy("scope", "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("_sel").alias("s"), F.count_if("_missed").alias("m")
    )
    buckets = stored(buckets)  # read three times
    buckets = buckets.crossJoin(F.broadcast(configured_k(df)))  # one row
    small = F.col("n") <= F.col("top_k")
    sums = buckets.groupBy("scope", "top_k").agg(
        F.count(F.lit(1)).alias("bucket_count"),
        F.sum("n").alias("candidate_rows"),
        F.max("n").alias("bucket_max"),
        F.count_if(small).alias("buckets_at_or_below_top_k"),
        F.sum(F.when(small, F.col("n")).otherwise(0)).alias("_small_rows"),
        F.sum(F.when(~small, F.col("s")).otherwise(0)).alias("selected_in_replaceable_buckets"),
        F.sum("m").alias("profitable_nonselected_rows"),
        F.count_if(F.col("m") > 0).alias("buckets_with_profitable_nonselected"),
        F.max(F.when(F.col("s") > 0, F.col("n"))).alias("selected_bucket_max"),
    )
    half = {"p50": 0.5, "p90": 0.9}
    sizes = quantiles.exact(buckets, ["scope"], "n", {f"bucket_{k}": q for k, q in half.items()}).drop("rows")
    weighted = quantiles.exact(buckets, ["scope"], "n", {f"selected_bucket_{k}": q for k, q in half.items()}, weight="s").drop("rows")
    picks = select.baseline_selected(df).agg(F.count(F.lit(1)).alias("selected_rows"))
    out = sums.join(sizes, "scope").join(weighted, "scope", "left").crossJoin(F.broadcast(picks))  # one row per scope
    return out.withColumns(
        {
            "bucket_share_at_or_below_top_k": safe_ratio(F.col("buckets_at_or_below_top_k"), F.col("bucket_count")),
            "candidate_share_at_or_below_top_k": safe_ratio(F.col("_small_rows"), F.col("candidate_rows")),
            "profitable_nonselected_bucket_share": safe_ratio(F.col("buckets_with_profitable_nonselected"), F.col("bucket_count")),
            "selected_replaceable_share": safe_ratio(F.col("selected_in_replaceable_buckets"), F.col("selected_rows")),
        }
    ).drop("_small_rows")


def fold_metrics(df: DataFrame, total_folds: int, keys: list[str] | None = None, metrics=accounting.portfolio) -> DataFrame:
    """Portfolio row per fold (or the row `metrics` gives); folds without trades stay as zero rows."""
    keys = keys or []
    done = metrics(df.filter(F.col("fold") > 0), [*keys, "fold"])
    frame = df.select(*keys).distinct() if keys else df.select(F.lit(0).alias("_x")).limit(1)
    frame = frame.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(total_folds))).alias("fold"))
    return frame.join(done, [*keys, "fold"], "left").fillna(0)


def fold_summary(folds: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, median, worst, best, active and profitable folds and the largest profit share of a fold."""
    gain = F.greatest(F.lit(0.0), F.col("portfolio_profit"))
    total = F.sum(gain)
    return folds.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("fold_count"),
        F.sum("trade_count").alias("trade_count"),
        F.sum("portfolio_profit").alias("portfolio_profit"),
        F.avg("portfolio_return").alias("mean_fold_return"),
        F.percentile("portfolio_return", 0.5).alias("median_fold_return"),  # one value per fold
        F.min("portfolio_return").alias("worst_fold_return"),
        F.max("portfolio_return").alias("best_fold_return"),
        F.count_if(F.col("trade_count") > 0).alias("active_folds"),
        F.count_if(F.col("portfolio_return") > 0).alias("profitable_folds"),
        (F.max(gain) / F.when(total == 0, 1.0).otherwise(total)).alias("top_fold_profit_share"),
    )


def phase_matrix(folds: DataFrame, phases: DataFrame, keys: list[str]) -> DataFrame:
    """`fold_summary` per key and research phase."""
    return fold_summary(folds.join(F.broadcast(phases), "fold"), [*keys, "phase"])  # one row per fold


def decision(experiments: DataFrame, phase_rows: DataFrame, audit: DataFrame, costs: DataFrame, order: list[str] = VARIANTS) -> DataFrame:
    """One row: keep the baseline or promote a variant, with the reasons against. Of equal returns the first in `order` is best.

    experiments(experiment, portfolio_return), phase_rows(phase, trade_count, active_folds),
    audit(scope, selected_replaceable_share), costs(experiment, cost_scenario, portfolio_return).
    """
    place = F.array_position(F.array(*map(F.lit, order)), F.col("experiment"))
    # returns of equal picks differ in their last digits, by the order of the sum
    first = F.struct(F.round("portfolio_return", 9), F.when(place > 0, -place).otherwise(-len(order) - 1), "experiment")
    best = experiments.agg(
        F.max_by("experiment", first).alias("best_experiment"),
        F.max("portfolio_return").alias("best_return"),
        F.max(F.when(F.col("experiment") == "baseline_executed_trades", F.col("portfolio_return"))).alias("baseline_return"),
    )

    def phase(name):
        mine = F.col("phase") == name
        return [
            F.max(F.when(mine, F.col("trade_count"))).alias(f"{name}_max_trades"),
            F.max(F.when(mine, F.col("active_folds"))).alias(f"{name}_max_active_folds"),
        ]

    powers = phase_rows.agg(*phase("selection"), *phase("confirmation"))
    exact = audit.agg(
        F.max(F.when(F.col("scope") == "execution_open_time", F.col("selected_replaceable_share"))).alias("replaceable_share")
    )
    doubled = costs.filter(F.col("cost_scenario") == "double_cost").select("experiment", F.col("portfolio_return").alias("double_cost_return"))
    row = best.crossJoin(F.broadcast(powers)).crossJoin(F.broadcast(exact))  # one row each
    row = row.join(F.broadcast(doubled), F.col("experiment") == F.col("best_experiment"), "left").drop("experiment")  # one per variant
    trades, active = F.col("selection_max_trades"), F.col("selection_max_active_folds")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("best_experiment") == "baseline_executed_trades", "baseline_best"),
            F.when(trades.isNull(), "no_selection_split").when(
                (trades < MIN_SELECTION_TRADES) | (active < MIN_SELECTION_FOLDS), "selection_underpowered"
            ),
            F.when(F.col("replaceable_share") < MIN_REPLACEABLE_SHARE, "candidate_reselection_sparse"),
            F.when(F.col("double_cost_return") < 0, "cost_stress_failed"),
        )
    )
    out = row.withColumn("reasons", F.concat_ws(";", reasons))
    verdict = F.when(F.col("reasons") == "", "offline_variant_candidate").otherwise("do_not_promote_offline_tuning")
    promoted = F.when(F.col("reasons") == "", F.col("best_experiment")).otherwise("")
    return out.withColumn("decision", verdict).withColumn("promoted_experiment", promoted)


def composite(folds: DataFrame, facts: DataFrame) -> DataFrame:
    """Thirteen components clipped to [0, 1] and their mean, one row each. Their offsets and spans are fixed values.

    `folds` has one row per fold; `facts` is one row with profit_factor, monotonicity, double_cost_return,
    return_without_symbol, return_without_fold, top_symbol_share and stability.
    """
    gain = F.greatest(F.lit(0.0), F.col("portfolio_profit"))
    summed = folds.agg(
        F.percentile("portfolio_return", 0.5).alias("median"), F.min("portfolio_return").alias("worst"),  # one value per fold
        F.avg((F.col("portfolio_return") > 0).cast("double")).alias("profitable"),
        F.avg((F.col("trade_count") > 0).cast("double")).alias("active"),
        safe_ratio(F.max(gain), F.sum(gain)).alias("top_fold"),
    )
    row = summed.crossJoin(F.broadcast(facts))  # one row
    c = F.col
    values = {
        "median_fold_return": (c("median") + 0.02) / 0.08,
        "worst_fold_return": (c("worst") + 0.12) / 0.12,
        "profitable_fold_rate": c("profitable"),
        "walkforward_profit_factor": (c("profit_factor") - 0.8) / 0.7,
        "active_fold_rate": c("active"),
        "tail_monotonicity": c("monotonicity"),
        "double_cost_return": (c("double_cost_return") + 0.02) / 0.08,
        "return_without_key_symbol": (c("return_without_symbol") + 0.02) / 0.08,
        "return_without_key_fold": (c("return_without_fold") + 0.02) / 0.08,
        "top_symbol_concentration_penalty": 1 - c("top_symbol_share"),
        "top_fold_concentration_penalty": 1 - c("top_fold"),
        "inactive_fold_penalty": c("active"),
        "threshold_stability": c("stability"),
    }
    clipped = {n: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) for n, v in values.items()}
    parts = [F.struct(F.lit(n).alias("component"), v.alias("score")) for n, v in clipped.items()]
    mean = sum(clipped.values(), F.lit(0.0)) / len(clipped)
    parts.append(F.struct(F.lit("composite_robustness_score").alias("component"), mean.alias("score")))
    return row.select(F.explode(F.array(*parts)).alias("p")).select("p.*")


def selected(df: DataFrame) -> DataFrame:
    """Detail of the selected trades of every variant."""
    return df.select(
        "experiment", "row_id", "symbol", "open_time", "trade_day", "trade_score", "position_size", "gross", "net", "profit", "size_filled"
    )


def grid(df: DataFrame, thresholds: list[float], ks: list[int], score: str, bucket: str = "open_time") -> DataFrame:
    """Picks of every (threshold, k) pair over the same candidates, with `config`, in one ranking.

    Rows over a threshold on the ranking score are the head of each bucket, so a single rank cut at the
    largest k serves all pairs; only those rows meet the grid.
    """
    top = select.topk(df, max(ks), [bucket], select.score_order(df, score), rank="_rank")
    pairs = [(f"t{t}_k{k}", float(t), k) for t in thresholds for k in ks]
    configs = df.sparkSession.createDataFrame(pairs, "config string, _t double, _k int")
    fits = (F.col(score) >= F.col("_t")) & (F.col("_rank") <= F.col("_k"))
    return top.join(F.broadcast(configs), fits).drop("_t", "_k", "_rank")  # the grid
