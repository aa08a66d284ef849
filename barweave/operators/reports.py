"""Report tables: distributions, deciles, rankings, exposure, calibration, folds and gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import MS_PER_DAY, MS_PER_MINUTE, safe_ratio
from . import accounting, cuts, prefix, quantiles

QUANTILES = {f"p{p:02d}": p / 100 for p in (1, 5, 10, 25, 50, 75, 90, 95, 99)}
TOP_SHARES = (1, 5, 10, 25, 100)
DECILES = 10


def long_form(df: DataFrame, columns: list[str], name: str, value: str, keep: list[str]) -> DataFrame:
    """One row per (row, column) with a present, finite value."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns]))
    out = df.select(*keep, pairs.alias("_p")).select(*keep, "_p.*")
    v = F.col(value)
    return out.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def summary(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """Count, bounds, mean, median, population spread and percentiles per column."""
    by = [*(keys or []), "column"]
    rows = long_form(df, columns, "column", "value", keys or [])
    plain = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("count"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
    )
    qs = quantiles.exact(rows, by, "value", QUANTILES).drop("rows")
    return plain.join(qs, by).withColumn("median", F.col("p50"))


def score_distribution(df: DataFrame, columns: list[str]) -> DataFrame:
    """`summary` with mean and median of winners and losers."""
    rows = long_form(df.withColumn("_won", F.col("net") > 0), columns, "column", "value", ["_won"])
    medians = quantiles.exact(rows, ["column", "_won"], "value", {"m": 0.5})
    means = rows.groupBy("column", "_won").agg(F.avg("value").alias("a"))
    sides = means.join(medians, ["column", "_won"]).groupBy("column").agg(
        *[
            F.coalesce(F.max(F.when(F.col("_won") == w, F.col(c))), F.lit(0.0)).alias(f"{side}_{kind}")
            for w, side in ((True, "winner"), (False, "loser"))
            for c, kind in (("a", "mean"), ("m", "median"))
        ]
    )
    return summary(df, columns).join(sides, "column").withColumn(
        "winner_minus_loser_mean", F.col("winner_mean") - F.col("loser_mean")
    )


def _top_share(rows: DataFrame, by: list[str], column: str, name: str) -> DataFrame:
    """Most frequent value of a column per group with its share; the later name wins ties."""
    counts = rows.groupBy(*by, column).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*by).agg(
        F.max_by(column, F.struct("_n", column)).alias(f"top_{name}"),
        (F.max("_n") / F.sum("_n")).alias(f"top_{name}_share"),
    )


TRADE = ["symbol", "month", "trade_day", "open_time", "row_id", "label", "gross", "net", "profit", "position_size"]


ORDERED = ["open_time", "symbol", "row_id"]


def deciles(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """Per score and decile (1 is the lowest): rows, bounds, returns, factor and top symbol.

    decile = ceil(10 * rank / n), ties by time, symbol and row id. Only the rows at the ends of the deciles are looked for.
    """
    by = [*(keys or []), "score"]
    kept = [*(keys or []), *ORDERED, "gross", "net", "profit"]
    base = cuts.frozen(df.select(*dict.fromkeys([*kept, *columns])))
    rows = long_form(base, columns, "score", "value", [*kept, cuts.ID])
    n = F.col("_n")
    ends = cuts.places(cuts.sizes(rows, by), by, [F.floor(n * j / DECILES) for j in range(1, DECILES)])
    cut = cuts.cut(rows, by, F.col("value"), ORDERED, ends, DECILES - 1)
    placed = cut.withColumn("decile", cuts.below(ORDERED, 0, DECILES - 1) + 1)
    group = [*by, "decile"]
    sums = placed.groupBy(*group).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("value").alias("score_min"),
        F.max("value").alias("score_max"),
        F.avg("gross").alias("avg_gross_return"),
        F.avg("net").alias("avg_net_return"),
        F.avg((F.col("net") > 0).cast("double")).alias("positive_return_rate"),
        accounting.profit_factor().alias("profit_factor"),
    )
    return sums.join(_top_share(placed, group, "symbol", "symbol"), group)


def monotonicity(table: DataFrame, keys: list[str], place: str = "decile", value: str = "avg_net_return") -> DataFrame:
    """Share of adjacent deciles whose right side is not lower; 0 with a single decile."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(place))  # at most ten rows
    steps = table.withColumn("_up", F.when(before.isNotNull(), (F.col(value) >= before).cast("double")))
    return steps.groupBy(*keys).agg(F.coalesce(F.avg("_up"), F.lit(0.0)).alias("monotonicity"))


def ranking(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per score source: top 1/5/10/25/100 %, deciles (01 is the best), raw candidates and executed rows."""
    kept = [*TRADE, "raw_signal", "executed"]
    base = cuts.frozen(df.select(*dict.fromkeys([*kept, *columns])))
    rows = long_form(base, columns, "score_source", "value", [*kept, cuts.ID])
    n = F.col("_n")
    heads, ends = [F.ceil(n * p / 100) for p in TOP_SHARES], [F.floor(n * j / DECILES) for j in range(1, DECILES)]
    wanted = cuts.places(cuts.sizes(rows, ["score_source"]), ["score_source"], heads + ends)
    count = len(heads + ends)
    cut = cuts.cut(rows, ["score_source"], -F.col("value"), ORDERED, wanted, count)
    # A row's buckets follow from how many top shares it is inside, its decile and its two flags, so rows are
    # summed on these first, counted per symbol and day; only the small cells are handed out to the buckets.
    spot = cut.withColumns(
        {
            "_tops": F.lit(len(TOP_SHARES)) - cuts.below(ORDERED, 0, len(TOP_SHARES)),
            "_decile": cuts.below(ORDERED, len(TOP_SHARES), count) + 1,
            "_raw": F.col("raw_signal") == 1,
            "_ex": F.col("executed") == 1,
        }
    )
    cell = ["score_source", "_tops", "_decile", "_raw", "_ex"]
    widest = len(TOP_SHARES)
    tops = [F.when(F.col("_tops") >= widest - i, F.lit(f"top_{p}pct")) for i, p in enumerate(TOP_SHARES)]
    decile = F.concat(F.lit("score_decile_"), F.lpad(F.col("_decile").cast("string"), 2, "0"))
    chosen = [F.when(F.col("_raw"), F.lit("raw_candidates")), F.when(F.col("_ex"), F.lit("executed"))]
    buckets = F.explode(F.array_compact(F.array(*tops, decile, *chosen))).alias("bucket")
    by = ["score_source", "bucket"]

    sums = ["n", "label", "gross", "net", "profit", "gains", "losses"]
    whole = spot.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(c).alias(c) for c in ("label", "gross", "net", "profit")],
        accounting.gains().alias("gains"),
        accounting.losses().alias("losses"),
        F.min("value").alias("lo"),
    )
    n = F.sum("n")
    out = whole.select("score_source", buckets, *sums, "lo").groupBy(*by).agg(
        n.alias("rows"),
        (F.sum("label") / n).alias("label_rate"),
        (F.sum("gross") / n).alias("avg_trade_return"),
        (F.sum("net") / n).alias("avg_net_return"),
        accounting.factor(F.sum("gains"), F.sum("losses")).alias("profit_factor"),
        F.sum("profit").alias("profit"),
        F.min("lo").alias("score_min"),
    )
    per_symbol = spot.groupBy(*cell, "symbol").agg(F.count(F.lit(1)).alias("n"))
    per_symbol = per_symbol.select("score_source", buckets, "symbol", "n").groupBy(*by, "symbol").agg(F.sum("n").alias("n"))
    tops = per_symbol.groupBy(*by).agg(
        F.max_by("symbol", F.struct("n", "symbol")).alias("top_symbol"), (F.max("n") / F.sum("n")).alias("top_symbol_share")
    )
    per_day = spot.groupBy(*cell, "month", "trade_day").agg(F.count(F.lit(1)).alias("n"))
    per_day = per_day.select("score_source", buckets, "month", "trade_day", "n").groupBy(*by, "month", "trade_day").agg(F.sum("n").alias("n"))
    per_month = per_day.groupBy(*by, "month").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("days"))
    months = per_month.groupBy(*by).agg(
        F.sum("days").alias("active_days"),
        F.max_by("month", F.struct("n", "month")).alias("top_month"),
        (F.max("n") / F.sum("n")).alias("top_month_share"),
    )
    return out.join(tops, by).join(months, by)


def exposure(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per symbol: counts, capital, profits and their shares of the whole; zero totals count as 1."""
    by = keys or []
    per = df.filter(F.col("symbol") != "").groupBy(*by, "symbol").agg(
        F.count(F.lit(1)).alias("trade_count"),
        F.sum("position_size").alias("capital"),
        F.sum(F.when(F.col("profit") >= 0, F.col("profit")).otherwise(0.0)).alias("gross_profit"),
        F.sum("profit").alias("net_profit"),
        F.sum(F.when(F.col("profit") < 0, -F.col("profit")).otherwise(0.0)).alias("loss"),
        F.countDistinct("trade_day").alias("active_days"),
        F.avg("trade_score").alias("average_score"),
        F.avg("net").alias("average_net_return"),
        F.avg("predicted_return").alias("average_predicted_return"),
        F.avg(F.abs(F.col("predicted_return") - F.col("net"))).alias("average_abs_return_error"),
    )
    gain = F.greatest(F.lit(0.0), F.col("net_profit"))
    sums = per.groupBy(*by).agg(
        F.sum("trade_count").alias("_t"), F.sum("capital").alias("_c"), F.sum(gain).alias("_g"), F.sum("loss").alias("_l")
    )
    joined = per.join(sums, by) if by else per.crossJoin(F.broadcast(sums))  # one row without keys

    def share(value, total):
        return value / F.when(F.col(total) == 0, F.lit(1.0)).otherwise(F.col(total))

    return joined.select(
        *per.columns,
        share(F.col("trade_count"), "_t").alias("trade_share"),
        share(F.col("capital"), "_c").alias("capital_share"),
        share(gain, "_g").alias("net_profit_share"),
        share(F.col("loss"), "_l").alias("loss_share"),
    )


def exposure_order() -> list[Column]:
    return [F.desc("net_profit"), F.desc("trade_count"), F.col("symbol")]


def concentration(exposed: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Largest and three largest shares of profit and trades, and the symbol on top of the order."""
    by = keys or []

    def top(c, n):
        place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(c), "symbol"))
        best = exposed.select(*by, "symbol", c, place.alias("_p")).filter(F.col("_p") <= n)
        return best.groupBy(*by).agg(F.sum(c).alias(f"{c}_top{n}"))

    parts = [top(c, n) for c in ("net_profit_share", "trade_share") for n in (1, 3)]
    rank = F.struct(F.col("net_profit"), F.col("trade_count"))
    parts.append(exposed.groupBy(*by).agg(F.max_by("symbol", rank).alias("top_symbol"), F.count(F.lit(1)).alias("symbol_count")))
    if by:
        return reduce(lambda a, b: a.join(b, by), parts)
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)  # one row each


def symbols(df: DataFrame) -> DataFrame:
    """Per symbol over all rows, with trade figures over the executed ones."""
    ex = F.col("executed") == 1
    size, ret = F.col("position_size"), F.col("gross")
    out = df.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(ex).alias("predicted_trades"),
        F.count_if(F.col("label") == 1).alias("actual_positive_rows"),
        F.avg(F.when(ex, (F.col("net") > 0).cast("double"))).alias("win_rate"),
        F.avg("forward_return").alias("avg_forward_return"),
        F.avg(F.when(ex, ret)).alias("avg_trade_return"),
        F.sum(F.when(ex, size * (ret - 0.001)).otherwise(0.0)).alias("total_profit_after_fee"),
        F.sum(F.when(ex, F.col("profit")).otherwise(0.0)).alias("total_profit_after_fee_and_slippage"),
        accounting.factor(
            F.coalesce(F.sum(F.when(ex & (F.col("profit") > 0), F.col("profit"))), F.lit(0.0)),
            F.coalesce(-F.sum(F.when(ex & (F.col("profit") < 0), F.col("profit"))), F.lit(0.0)),
        ).alias("profit_factor"),
        F.avg(F.when(ex, size)).alias("avg_position_size"),
    )
    return out.fillna(0.0, ["win_rate", "avg_trade_return", "avg_position_size"])


def regimes(df: DataFrame, types: dict[str, Column], order: list | None = None) -> DataFrame:
    """Trades and profit per regime type and value, with the drawdown of that regime alone."""
    kinds = F.explode(F.array(*[F.struct(F.lit(n).alias("regime_type"), c.alias("regime_value")) for n, c in types.items()]))
    rows = df.select(*[c for c in TRADE if c in df.columns], kinds.alias("_k")).select("*", "_k.*").drop("_k")
    keys = ["regime_type", "regime_value"]
    return accounting.portfolio(rows, keys, order=order)


def feature_stability(importance: DataFrame) -> DataFrame:
    """Importance per (fold, feature) to mean, spread, ranks and folds per feature.

    stability_score = mean / (mean + spread), our choice: the reference does not pin it.
    """
    ranked = importance.withColumn(
        "_rank", F.rank().over(Window.partitionBy("fold").orderBy(F.desc("importance")))  # one row per feature
    )
    out = ranked.groupBy("feature").agg(
        F.avg("importance").alias("mean_importance"),
        F.stddev_pop("importance").alias("std_importance"),
        F.min("_rank").alias("min_rank"),
        F.max("_rank").alias("max_rank"),
        F.avg("_rank").alias("mean_rank"),
        F.countDistinct("fold").alias("folds_present"),
    )
    return out.withColumn(
        "stability_score", safe_ratio(F.col("mean_importance"), F.col("mean_importance") + F.col("std_importance"))
    )


#: Why a baseline has no figures.
NO_PATH, NO_LOGISTIC, NO_CONTEXT = "continuous_price_path_unavailable", "logistic_metrics_unavailable", "baseline_context_missing"


def baselines(
    df: DataFrame, bars: DataFrame | None = None, momentum: float = 0.0, spike: float = 2.0, share: int = 16, leader: str | None = None, logistic: DataFrame | None = None
) -> DataFrame:
    """All baselines, each with `available` and `skipped_reason`: no_trade; random, simple_momentum and volume_spike on a feature frame with
    outcomes; logistic_baseline from `logistic`, the trades (columns of `with_returns`) that a logistic model chose; buy-and-hold of the
    leader and of all symbols alike from a price path. What is missing gives a row of zeros with the reason. The cut-offs are ours."""
    pick = F.conv(F.substring(F.md5(F.concat_ws("|", "symbol", F.col("open_time").cast("string"))), 1, 4), 16, 10).cast("int")
    needs = {"random_trade": None, "simple_momentum": "ret_60m", "volume_spike": "relative_volume_previous_hour"}
    rules = {
        "random_trade": pick % share == 0,
        "simple_momentum": F.col("ret_60m") > momentum,
        "volume_spike": F.col("relative_volume_previous_hour") >= spike,
    }
    rules = {n: c for n, c in rules.items() if needs[n] is None or needs[n] in df.columns}
    kept = [c for c in TRADE if c in df.columns]
    named = F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))).alias("baseline_name")
    rows = df.select(named, *kept)
    if logistic is not None:
        rows = rows.unionByName(logistic.select(F.lit("logistic_baseline").alias("baseline_name"), *kept))
    done = accounting.portfolio(rows, ["baseline_name"]).select(
        "baseline_name", F.col("trade_count").alias("trades"), "win_rate", F.col("avg_gross_return").alias("avg_trade_return"),
        "portfolio_profit", "profit_factor", "max_drawdown",
    )
    if bars is not None:
        held = bars.groupBy("symbol").agg(
            (F.max_by("close", "open_time") / F.min_by("close", "open_time") - 1).alias("r")
        )
        every = [(held, "equal_weight_buy_and_hold")] + ([(held.filter(F.col("symbol") == leader), "leader_buy_and_hold")] if leader else [])
        for own, name in every:
            hold = own.agg(
                F.lit(name).alias("baseline_name"), F.count(F.lit(1)).alias("trades"),
                F.avg((F.col("r") > 0).cast("double")).alias("win_rate"), F.avg("r").alias("avg_trade_return"),
                (F.avg("r") * accounting.CAPITAL).alias("portfolio_profit"), F.lit(0.0).alias("profit_factor"), F.lit(0.0).alias("max_drawdown"),
            )
            done = done.unionByName(hold.filter("trades > 0"))
    reasons = {"no_trade": "", "logistic_baseline": "" if logistic is not None else NO_LOGISTIC, "leader_buy_and_hold": NO_PATH, "equal_weight_buy_and_hold": NO_PATH}
    reasons |= {n: "" if n in rules else NO_CONTEXT for n in needs}
    listed = df.sparkSession.createDataFrame(list(reasons.items()), "baseline_name string, skipped_reason string")
    measures = [c for c in done.columns if c != "baseline_name"]
    out = listed.join(done, "baseline_name", "left").withColumn("available", ((F.col("skipped_reason") == "") | F.col("trades").isNotNull()).cast("int"))
    out = out.withColumn("skipped_reason", F.when(F.col("available") == 1, "").otherwise(F.col("skipped_reason")))
    return out.fillna(0, measures).select("baseline_name", "available", "skipped_reason", *measures)


def candidate_utility(df: DataFrame, score: str, keys: list[str]) -> DataFrame:
    """How much of the positive utility among candidates was executed, and what high scores lost."""
    pos, ex = F.col("net") > 0, F.col("executed") == 1
    base = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count_if(pos).alias("positive_utility_count"),
        F.count_if(pos & ex).alias("executed_positive_utility_count"),
        safe_ratio(F.count_if(pos & ex), F.count_if(pos)).alias("positive_utility_recall"),
        F.coalesce(F.max(F.when(pos & ~ex, F.col("net"))), F.lit(0.0)).alias("missed_best_utility"),
        (
            F.coalesce(F.avg(F.when(pos, F.col(score))), F.lit(0.0)) - F.coalesce(F.avg(F.when(~pos, F.col(score))), F.lit(0.0))
        ).alias("score_positive_utility_gap"),
    )
    narrow = cuts.frozen(df.select(*keys, score, *ORDERED, "net").withColumn("_all", F.lit(1)))
    by = keys or ["_all"]
    ends = cuts.places(cuts.sizes(narrow, by), by, [F.ceil(F.col("_n") / DECILES)])
    top = cuts.cut(narrow, by, cuts.falling(score), ORDERED, ends, 1).filter(cuts.below(ORDERED, 0, 1) == 0)
    high = top.groupBy(*keys).agg(
        F.avg("net").alias("top_decile_utility"),
        F.count_if(F.col("net") <= 0).alias("high_score_loss_count"),
        F.avg((F.col("net") <= 0).cast("double")).alias("high_score_loss_share"),
        F.coalesce(F.avg(F.when(F.col("net") <= 0, F.col("net"))), F.lit(0.0)).alias("high_score_loss_utility"),
    )
    return base.join(high, keys) if keys else base.crossJoin(F.broadcast(high))  # one row


def execution_audit(df: DataFrame, input_order: list, hold_minutes: int, top_k: int, capital: float = accounting.CAPITAL) -> DataFrame:
    """One row: time order of the input, bucket sizes, top-k violations, and peak positions and capital.

    Needs selected (0/1). Positions open at open_time and close `hold_minutes` later, closes first.
    """
    stepped = prefix.ordered(df, [], input_order, previous={"_before": F.col("open_time")})
    back = F.col("_before") - F.col("open_time")
    times = stepped.agg(
        F.count(F.lit(1)).alias("input_rows"),
        F.count_if(back > 0).alias("time_decreases"),
        (F.coalesce(F.max(F.when(back > 0, back)), F.lit(0)) / MS_PER_MINUTE).alias("max_backward_minutes"),
    )
    buckets = df.groupBy("open_time").agg(F.count(F.lit(1)).alias("_n"), F.sum("selected").alias("_s"))
    sizes = buckets.agg(
        F.count(F.lit(1)).alias("bucket_count"), F.max("_n").alias("max_bucket_size"),
        F.max("_s").alias("max_selected_in_bucket"), F.count_if(F.col("_s") > top_k).alias("top_k_violations"),
    )
    closing = F.col("open_time") + hold_minutes * MS_PER_MINUTE
    moves = F.explode(
        F.array(
            F.struct(F.col("open_time").alias("at"), F.lit(1).alias("step")),
            F.struct(closing.alias("at"), F.lit(-1).alias("step")),
        )
    ).alias("m")
    # Counted per instant first: the curve needs no more than one row per time and direction.
    events = df.filter("selected = 1").select("position_size", moves).select("position_size", "m.*")
    events = events.groupBy("at", "step").agg(F.count(F.lit(1)).alias("_n"), F.sum("position_size").alias("_c"))
    curve = prefix.ordered(
        events, [], ["at", "step"],
        sums={"open": F.col("step") * F.col("_n"), "used": F.col("step") * F.col("_c")},
    )
    peaks = curve.agg(F.max("open").alias("max_open_positions"), F.max("used").alias("max_open_capital"))
    out = times.crossJoin(F.broadcast(sizes)).crossJoin(F.broadcast(peaks))  # one row each
    return out.withColumn("max_capital_share", F.col("max_open_capital") / capital)


def fold_status(trades: str = "trade_count", profit: str = "portfolio_profit") -> Column:
    return F.when(F.col(trades) == 0, "inactive").when(F.col(profit) > 0, "active_profitable").otherwise("active_losing")


def aggregate_folds(folds: DataFrame) -> DataFrame:
    """One row over folds: plain, active-only and trade-weighted means; non-finite objectives are counted apart."""
    active = F.col("trade_count") > 0
    good = ~F.isnan("objective") & (F.abs("objective") < float("inf"))
    good = F.coalesce(good, F.lit(False))
    return folds.agg(
        F.count(F.lit(1)).alias("folds"),
        F.count_if(active).alias("active_folds"),
        F.sum("trade_count").alias("trades"),
        F.sum("portfolio_profit").alias("profit"),
        F.avg("portfolio_return").alias("mean_return"),
        F.avg("avg_net_return").alias("mean_net_return"),
        F.avg(F.when(active, F.col("avg_net_return"))).alias("active_mean_net_return"),
        safe_ratio(F.sum(F.col("avg_net_return") * F.col("trade_count")), F.sum("trade_count")).alias("trade_weighted_net_return"),
        safe_ratio(F.sum("portfolio_profit"), F.count_if(active)).alias("profit_per_active_fold"),
        F.count_if(good).alias("finite_objectives"),
        F.count_if(~good).alias("nonfinite_objectives"),
        F.avg(F.when(good, F.col("objective"))).alias("mean_objective"),
    )


def failed(checks: dict[str, Column]) -> Column:
    """Names of the failed checks, joined by ';'."""
    return F.concat_ws(";", F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(n)) for n, bad in checks.items()])))


# Acceptance limits per tier; only partly pinned by the reference.
TIERS = {
    "research": {"profitable_rate": 0.50, "median_return": 0.0, "mean_return": 0.0, "drawdown": 1.0, "active": 2},
    "paper": {"profitable_rate": 0.55, "median_return": 0.0, "mean_return": 0.001, "drawdown": 0.5, "active": 3},
    "live": {"profitable_rate": 0.60, "median_return": 0.001, "mean_return": 0.002, "drawdown": 0.3, "active": 5},
}


def acceptance(summary_row: DataFrame, tiers: dict[str, dict] = TIERS) -> DataFrame:
    """One row per tier and summary row (profitable_rate, median_return, mean_return, worst_drawdown, active_folds)."""
    limits = F.explode(
        F.array(*[F.struct(F.lit(t).alias("tier"), *[F.lit(float(v)).alias(f"_{k}") for k, v in lim.items()]) for t, lim in tiers.items()])
    )
    rows = summary_row.select("*", limits.alias("_l")).select(*summary_row.columns, "_l.*")
    bad = failed(
        {
            "profitable_fold_rate": F.col("profitable_rate") < F.col("_profitable_rate"),
            "median_portfolio_return": F.col("median_return") < F.col("_median_return"),
            "mean_portfolio_return": F.col("mean_return") < F.col("_mean_return"),
            "worst_fold_drawdown": F.col("worst_drawdown") > F.col("_drawdown"),
            "active_folds": F.col("active_folds") < F.col("_active"),
        }
    )
    out = rows.withColumn("failed_checks", bad).withColumn("accepted", (F.col("failed_checks") == "").cast("int"))
    strength = F.when(F.col("accepted") == 1, F.concat("tier", F.lit("_pass"))).otherwise("rejected")
    return out.withColumn("strength", strength).select(*summary_row.columns, "tier", "accepted", "strength", "failed_checks")


def robustness(
    df: DataFrame, min_trades: int = 10, min_days: int = 3, min_symbols: int = 3, min_months: int = 2, max_symbol_share: float = 0.7,
    max_month_share: float = 0.7, min_factor: float = 1.05, min_monotonicity: float = 0.6, min_gap: float = 0.0,
) -> DataFrame:
    """Gate per row of metrics; a profitable row that fails is fragile."""
    bad = failed(
        {
            "trades": F.col("trades") < min_trades,
            "active_days": F.col("active_days") < min_days,
            "active_symbols": F.col("active_symbols") < min_symbols,
            "active_months": F.col("active_months") < min_months,
            "top_symbol_share": F.col("top_symbol_share") > max_symbol_share,
            "top_month_share": F.col("top_month_share") > max_month_share,
            "profit_factor": F.col("profit_factor") < min_factor,
            "tail_monotonicity": F.col("monotonicity") < min_monotonicity,
            "top_1pct_net_return": F.col("top_1pct_net") <= 0,
            "top_5pct_net_return": F.col("top_5pct_net") <= 0,
            "top_decile_net_return": F.col("top_10pct_net") <= 0,
            "executed_score_gap": F.col("score_gap") < min_gap,
        }
    )
    out = df.withColumn("failed_checks", bad)
    status = F.when(F.col("failed_checks") == "", "passed").otherwise("failed")
    fragile = ((F.col("profit") > 0) & (F.col("failed_checks") != "")).cast("int")
    return out.withColumn("gate_status", status).withColumn("profitable_but_fragile", fragile)


def short_history(df: DataFrame, days: float, keys: list[str]) -> DataFrame:
    """Share of trades of symbols first seen less than `days` before, among the evaluated rows."""
    first = df.groupBy("symbol").agg(F.min("open_time").alias("_first"))
    young = F.col("open_time") - F.col("_first") < days * MS_PER_DAY
    return df.join(first, "symbol").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"), F.avg(young.cast("double")).alias("short_history_share")
    )


def compare(runs: dict[str, DataFrame]) -> DataFrame:
    """One row per configuration out of single-row summaries."""
    tagged = [df.withColumn("run", F.lit(name)) for name, df in runs.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def calibration_metrics(df: DataFrame, probabilities: list[str], returns: list[str], label: str = "label") -> DataFrame:
    """Per probability column: Brier, log loss, mean prediction, actual rate; per return column: MAE, MSE
    against `net`. A column with a missing value is left out."""
    y = F.col(label).cast("double")
    columns = {c: "probability" for c in probabilities} | {c: "return" for c in returns}
    aggs = [F.count(F.lit(1)).alias("_rows"), F.avg(y).alias("_rate"), F.avg("net").alias("_net")]
    for c, kind in columns.items():
        v = F.col(c)
        aggs.append(F.count(v).alias(f"_k_{c}"))
        aggs.append(F.avg(v).alias(f"_m_{c}"))
        if kind == "probability":
            q = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), v))
            aggs += [F.avg((v - y) * (v - y)).alias(f"_a_{c}"), F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q))).alias(f"_b_{c}")]
        else:
            aggs += [F.avg(F.abs(v - F.col("net"))).alias(f"_a_{c}"), F.avg((v - F.col("net")) * (v - F.col("net"))).alias(f"_b_{c}")]
    wide = df.agg(*aggs)
    entries = [
        F.when(
            F.col(f"_k_{c}") == F.col("_rows"),
            F.struct(
                F.lit(c).alias("column"), F.lit(kind).alias("kind"), F.col("_rows").alias("rows"),
                F.col(f"_m_{c}").alias("mean_prediction"), F.col("_rate" if kind == "probability" else "_net").alias("actual_mean"),
                F.col(f"_a_{c}").alias("brier_or_mae"), F.col(f"_b_{c}").alias("log_loss_or_mse"),
            ),
        )
        for c, kind in columns.items()
    ]
    return wide.select(F.explode(F.array_compact(F.array(*entries))).alias("e")).select("e.*")


def calibration_buckets(df: DataFrame, sources: list[str], label: str = "label") -> DataFrame:
    """Ten probability buckets per source, empty ones included."""
    rows = long_form(df, sources, "source", "p", [label, "net"])
    placed = rows.withColumn("bucket", F.least(F.floor(F.col("p") * 10), F.lit(9)).cast("int"))
    seen = placed.groupBy("source", "bucket").agg(
        F.count(F.lit(1)).alias("rows"), F.avg("p").alias("mean_probability"), F.avg(label).alias("actual_rate"),
        F.avg("net").alias("avg_net_return"),
    )
    cells = [(s, b) for s in sources for b in range(10)]
    frame = df.sparkSession.createDataFrame(cells, "source string, bucket int")
    return frame.join(F.broadcast(seen), ["source", "bucket"], "left").fillna(0).fillna(0.0)  # ten rows per source


def calibration_error(buckets: DataFrame) -> DataFrame:
    """Expected (row-weighted) and largest gap between mean probability and actual rate."""
    gap = F.abs(F.col("mean_probability") - F.col("actual_rate"))
    return buckets.groupBy("source").agg(
        safe_ratio(F.sum(gap * F.col("rows")), F.sum("rows")).alias("expected_calibration_error"),
        F.max(F.when(F.col("rows") > 0, gap)).alias("max_calibration_error"),
    )
