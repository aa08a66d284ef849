"""Decision thresholds: grids out of the scores, one-pass sweeps, objectives, admission and choice.

Grids have a few dozen values. The sweep bins every row once by the number of thresholds it passes and
works on the small table of bins from there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import MS_PER_DAY, safe_ratio
from ..session import stored
from . import accounting, cuts, prefix, quantiles

# Quantiles and top counts that enter an adaptive grid, and the threshold of 'no trade'.
GRID_QUANTILES = (0.50, 0.60, 0.70, 0.80, 0.85, 0.90, 0.925, 0.95, 0.975, 0.99, 0.995)
GRID_COUNTS = (10, 25, 50, 100, 250, 500, 1000)
NO_TRADE = 1.01
SAME = 1e-12
NEG_INF = float("-inf")


def _at_ranks(df: DataFrame, score: str, counts: tuple[int, ...]) -> DataFrame:
    """Scores at floor((n-1)q) and at the given counts from the top, and just below the maximum."""
    ranks = quantiles.value_ranks(df, [], score)
    size = ranks.agg(F.max("size").alias("n"))
    wanted = [F.floor((F.col("n") - 1) * q) for q in GRID_QUANTILES]
    wanted += [F.when(F.col("n") >= c, F.col("n") - c) for c in counts]
    places = size.select(F.explode(F.array_compact(F.array_distinct(F.array(*wanted)))).alias("place"))
    hit = F.col("place").between(F.col("first"), F.col("last"))
    picked = ranks.join(F.broadcast(places), hit).select(F.col(score).alias("threshold"))  # one row per wanted rank
    top = ranks.agg(F.max(score).alias("top")).select((F.col("top") - SAME).alias("threshold"))
    return picked.unionByName(top)


def _dedupe(values: DataFrame) -> DataFrame:
    """Sorted values, each more than 1e-12 above the one kept before it."""
    empty = F.array().cast("array<double>")

    def keep(acc, x):
        return F.when((F.size(acc) == 0) | (x - F.element_at(acc, -1) > SAME), F.concat(acc, F.array(x))).otherwise(acc)

    ordered = values.agg(F.array_sort(F.collect_set("threshold")).alias("v"))  # a grid, not rows
    return ordered.select(F.explode(F.aggregate("v", empty, keep)).alias("threshold"))


def grid(df: DataFrame, score: str, base: list[float], min_trades: int) -> DataFrame:
    """Adaptive grid for probabilities, inside [0, 1]."""
    inside = df.filter(F.col(score).between(0.0, 1.0))
    counts = (max(1, min_trades), max(1, 2 * min_trades), *GRID_COUNTS)
    fixed = df.sparkSession.createDataFrame([(float(b),) for b in base], "threshold double")
    values = _at_ranks(inside, score, counts).unionByName(fixed)
    return _dedupe(values.select(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "threshold")).alias("threshold")))


def score_grid(df: DataFrame, score: str, floor: float, counts: tuple[int, ...]) -> DataFrame:
    """Adaptive grid for free scores, not below the floor."""
    return _dedupe(_at_ranks(df, score, counts).filter(F.col("threshold") >= floor))


def values_of(grid_df: DataFrame) -> list[float]:
    """The grid on the driver: a few dozen numbers."""
    return sorted(row[0] for row in grid_df.collect())


def _tails(df: DataFrame, totals: DataFrame, score: str, keys: list[str], count: int) -> DataFrame:
    """Mean net return of the best hundredth and tenth (at least one row) of the rows at or above each of the `count` thresholds.

    They are heads of one ranking: the rows are summed between the cut rows of all heads, and these sums are added up.
    """
    ties = [c for c in ("open_time", "symbol", "row_id") if c in df.columns]
    base = cuts.frozen(df.select(*keys, score, *ties, "net"))
    size = lambda share: F.greatest(F.lit(1), F.ceil(F.col("trades") * share)).cast("bigint")
    both = F.explode(F.array(F.struct(F.lit(0).alias("_tail"), size(0.01).alias("_place")), F.struct(F.lit(1).alias("_tail"), size(0.1).alias("_place"))))
    heads = totals.select(*keys, "i", both.alias("_h")).select(*keys, "i", "_h.*", (F.col("i") * 2 + F.col("_h._tail") - 2).alias("_j"))
    heads = stored(heads)  # two rows for each key and threshold
    segment = cuts.below(ties, 0, 2 * count)
    parts = cuts.cut(base, keys, cuts.falling(score), ties, heads, 2 * count).withColumn("_segment", segment).groupBy(*keys, "_segment").agg(F.sum("net").alias("_sum"))
    # A row is inside a head if only cut rows of shorter heads are smaller than it.
    other = heads.select(*[F.col(k).alias(f"_o_{k}") for k in keys], F.col("_place").alias("_shorter"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_o_{k}")) for k in keys], F.lit(True))
    shorter = heads.join(F.broadcast(other), same).groupBy(*keys, "i", "_tail", "_place").agg(F.count_if(F.col("_shorter") < F.col("_place")).alias("_upto"))
    mean = shorter.join(parts, keys).filter(F.col("_segment") <= F.col("_upto")).groupBy(*keys, "i", "_tail").agg((F.sum("_sum") / F.first("_place")).alias("m"))
    return mean.groupBy(*keys, "i").agg(
        F.max(F.when(F.col("_tail") == 0, F.col("m"))).alias("top_1pct_net"), F.max(F.when(F.col("_tail") == 1, F.col("m"))).alias("top_decile_net")
    )


def sweep(
    df: DataFrame, thresholds: list[float], score: str, keys: list[str],
    tails: bool = False, short_history_days: float | None = None, drawdown_order: list | None = None,
) -> DataFrame:
    """Metrics of the rows at or above each threshold, per key. Needs the columns of `accounting.with_returns`.

    A column expected_value gives avg_expected_value. `tails` adds top_1pct_net and top_decile_net, `short_history_days` the share of
    rows whose symbol was first seen less than that before, `drawdown_order` the worst fall from the peak in that order.
    The narrow rows are written once, in that order if there is one: what `df` joins and shuffles is not done again for each table.
    """
    ts = sorted(set(thresholds))
    passed = sum((F.when(F.col(score) >= t, 1).otherwise(0) for t in ts), F.lit(0))
    rows = df.withColumns({"_bin": passed, "_drag": (F.col("gross") - F.col("net")) * F.col("position_size")})
    narrow = dict.fromkeys([*keys, "symbol", "trade_day", "label", score, "net", "profit", "_drag", "_bin"])
    narrow |= dict.fromkeys(c for c in ("expected_value",) if c in df.columns)
    narrow |= dict.fromkeys(c for c in ("open_time", "row_id") if (tails or (c == "open_time" and short_history_days is not None)) and c in df.columns)
    if drawdown_order is not None:
        rows = prefix.ranged(rows.select(*(narrow | dict.fromkeys(drawdown_order))), keys, drawdown_order, keep=list(narrow))
    else:
        rows = stored(rows.select(*narrow))
    steps = F.explode(F.sequence(F.lit(1), F.col("_bin"))).alias("i")
    won = F.col("net") > 0

    expected = F.col("expected_value") if "expected_value" in df.columns else F.lit(None).cast("double")
    young, aged = F.lit(0), rows
    if short_history_days is not None:
        first = stored(rows.groupBy("symbol").agg(F.min("open_time").alias("_first")))  # stored, so that Spark sees its size
        aged = rows.join(first, "symbol", "left")
        young = (F.col("open_time") - F.col("_first") < short_history_days * MS_PER_DAY).cast("int")
    cells = aged.groupBy(*keys, "symbol", "_bin").agg(
        F.sum(expected).alias("expected"),
        F.sum(young).alias("young"),
        F.count(F.lit(1)).alias("trades"),
        F.count_if(F.col("label") == 1).alias("tp"),
        F.sum("profit").alias("profit"),
        F.sum("net").alias("net"),
        F.sum("_drag").alias("cost_drag"),
        F.count_if(won).alias("winners"),
        F.sum(F.when(won, F.col(score)).otherwise(0.0)).alias("winner_score"),
        F.sum(F.when(won, 0.0).otherwise(F.col(score))).alias("loser_score"),
    )
    sums = ["trades", "tp", "profit", "net", "cost_drag", "winners", "winner_score", "loser_score", "expected", "young"]
    open_cells = cells.filter("_bin > 0")
    per_symbol = open_cells.select(*keys, "symbol", steps, *sums).groupBy(*keys, "i", "symbol").agg(
        *[F.sum(c).alias(c) for c in sums]
    )
    biggest = Window.partitionBy(*keys, "i").orderBy(F.desc("trades"), "symbol")  # one row per symbol
    per_symbol = per_symbol.withColumn("_place", F.row_number().over(biggest))
    gain = F.greatest(F.lit(0.0), F.col("profit"))
    richest = Window.partitionBy(*keys, "i").orderBy(F.desc(gain), "symbol")  # one row per symbol
    per_symbol = per_symbol.withColumn("_rich", F.row_number().over(richest))
    totals = per_symbol.groupBy(*keys, "i").agg(
        *[F.sum(c).alias(c) for c in sums],
        F.max("trades").alias("_top1"),
        F.sum(F.when(F.col("_place") <= 3, F.col("trades"))).alias("_top3"),
        F.max(gain).alias("_gain1"),
        F.sum(gain).alias("_gains"),
        F.sum(F.when(F.col("_rich") <= 3, gain)).alias("_gain3"),
    )
    days = rows.filter("_bin > 0").groupBy(*keys, "trade_day", "_bin").agg(F.count(F.lit(1)).alias("n"))
    days = days.select(*keys, "trade_day", "n", steps).groupBy(*keys, "i", "trade_day").agg(F.sum("n").alias("n"))
    days = days.groupBy(*keys, "i").agg(F.count(F.lit(1)).alias("active_days"), F.max("n").alias("max_trades_in_day"))
    positives = rows.groupBy(*keys).agg(F.count_if(F.col("label") == 1).alias("_pos"), F.count(F.lit(1)).alias("_rows"))
    labels = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("threshold")) for i, t in enumerate(ts, 1)]))
    frame = positives.select(*keys, "_pos", "_rows", labels.alias("g")).select(*keys, "_pos", "_rows", "g.*")
    out = frame.join(totals, [*keys, "i"], "left").join(days, [*keys, "i"], "left")
    zero = [*sums, "_top1", "_top3", "_gain1", "_gain3", "_gains", "active_days", "max_trades_in_day"]
    more = []
    if tails:
        out = out.join(_tails(rows, totals, score, keys, len(ts)), [*keys, "i"], "left")
        more += ["top_1pct_net", "top_decile_net"]
    if drawdown_order is not None:
        falls = accounting.nested_drawdowns(rows, keys, drawdown_order, "_bin", len(ts))
        out = out.join(falls, [*keys, "i"], "left")
        more.append("max_drawdown")
    out = out.fillna(0, [*zero, *more])
    n, tp = F.col("trades"), F.col("tp")
    return out.select(
        *keys, F.col("i").alias("threshold_index"), "threshold", "trades", "tp",
        safe_ratio(tp, n).alias("precision"),
        safe_ratio(tp, F.col("_pos")).alias("recall"),
        safe_ratio(2 * tp, n + F.col("_pos")).alias("f1"),
        "profit",
        safe_ratio(F.col("profit"), n).alias("avg_profit"),
        safe_ratio(F.col("net"), n).alias("avg_net"),
        "cost_drag",
        (safe_ratio(F.col("winner_score"), F.col("winners")) - safe_ratio(F.col("loser_score"), n - F.col("winners"))).alias("score_gap"),
        "active_days", "max_trades_in_day",
        safe_ratio(F.col("_top1"), n).alias("trade_top1"),
        safe_ratio(F.col("_top3"), n).alias("trade_top3"),
        safe_ratio(F.col("_gain1"), F.col("_gains")).alias("profit_top1"),
        safe_ratio(n, F.col("_rows")).alias("signal_share"),
        safe_ratio(F.col("_gain3"), F.col("_gains")).alias("profit_top3"),
        safe_ratio(F.col("expected"), n).alias("avg_expected_value"),
        safe_ratio(F.col("young"), n).alias("short_history_share"),
        *more,
    )


def objective(name: str, strict: bool = False, target_trades: int = 75) -> Column:
    """Objective of a sweep row; without trades -inf, or 0 for profit in strict mode.

    profit_balanced scales a gain by trades / target below the target (the exact discount is not pinned).
    """
    some = F.col("trades") > 0
    empty = F.lit(0.0 if name == "profit" and strict else NEG_INF)
    profit = F.col("profit")
    if name in ("precision", "recall", "f1", "profit", "avg_profit"):
        value = F.col(name).cast("double")
    elif name == "ev":
        value = F.col("avg_expected_value")
    elif name == "profit_balanced":
        value = F.when(profit > 0, profit * F.least(F.lit(1.0), F.col("trades") / target_trades)).otherwise(profit)
    else:
        raise ValueError(f"unknown objective {name}")
    return F.when(some, value).otherwise(empty)


def over(c: str, limit: float) -> Column:
    return F.greatest(F.lit(0.0), F.col(c) - limit)


def penalised(
    base: Column,
    drawdown: float = 0.0,
    trade_count: float = 0.0, target_trades: int = 0,
    top1: float = 0.0, top3: float = 0.0, trade_top1: float = 0.0, trade_top1_cap: float | None = None,
    burst_day: float = 0.0, target_per_day: float = 0.0, burst_max: float = 0.0, target_max_in_day: float = 0.0,
    short_history: float = 0.0, diversity: float = 0.0,
    stress_multiplier: float = 1.0, stress_weight: float = 0.0,
) -> Column:
    """The objective less weighted penalties; a weight of 0 leaves its column unread."""
    terms = [
        (drawdown, lambda: F.col("max_drawdown")),
        (trade_count, lambda: over("trades", target_trades)),
        (top1, lambda: F.col("profit_top1")),
        (top3, lambda: F.col("profit_top3")),
        (trade_top1, lambda: F.col("trade_top1")),
        (burst_day, lambda: F.greatest(F.lit(0.0), safe_ratio(F.col("trades"), F.col("active_days")) - target_per_day)),
        (burst_max, lambda: over("max_trades_in_day", target_max_in_day)),
        (short_history, lambda: F.col("short_history_share")),
        (diversity, lambda: F.col("profit_top1") + F.col("trade_top1")),
        (stress_weight * (stress_multiplier - 1.0), lambda: F.col("cost_drag")),
    ]
    value = base
    for weight, term in terms:
        if weight:
            value = value - weight * term()
    if trade_top1_cap is not None:
        value = value - over("trade_top1", trade_top1_cap) / (1.0 - trade_top1_cap)
    return value


def flags(
    min_trades: int = 0, max_trades: int = 0, min_precision: float = 0.0, min_avg_net: float | None = None,
    min_score_gap: float | None = None, max_signal_share: float = 1.0, max_trade_top1: float = 1.0, max_profit_top1: float = 1.0,
    max_profit_top3: float = 1.0, positive_top_1pct: bool = False, min_top_decile: float | None = None,
) -> Column:
    """Array of the names of the failed admission checks; the two on tail returns need a sweep with tails."""
    checks = {
        "rejected_under_min_trades": F.col("trades") < min_trades,
        "rejected_over_max_trades": (F.col("trades") > max_trades) if max_trades else None,
        "rejected_under_min_precision": F.col("precision") < min_precision,
        "rejected_under_min_avg_net_return": (F.col("avg_net") < min_avg_net) if min_avg_net is not None else None,
        "rejected_under_min_score_gap": (F.col("score_gap") < min_score_gap) if min_score_gap is not None else None,
        "rejected_over_signal_share": F.col("signal_share") > max_signal_share,
        "rejected_over_trade_concentration": F.col("trade_top1") > max_trade_top1,
        "rejected_over_top1_concentration": F.col("profit_top1") > max_profit_top1,
        "rejected_over_top3_concentration": F.col("profit_top3") > max_profit_top3,
        "rejected_negative_top_1pct": (F.col("top_1pct_net") < 0) if positive_top_1pct else None,
        "rejected_under_min_top_decile_net_return": (F.col("top_decile_net") < min_top_decile) if min_top_decile is not None else None,
    }
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items() if c is not None]))


def choose(swept: DataFrame, keys: list[str], min_trades: int, strict: bool = False) -> DataFrame:
    """Threshold per key: best `objective` among rows with an empty `flags` and enough trades (the first wins
    ties), else the best with fewer trades, else no trade. In strict mode only a positive objective trades."""
    admissible = (F.size("flags") == 0) & (F.col("trades") >= min_trades) & (F.col("objective") > NEG_INF)
    if strict:
        admissible = admissible & (F.col("objective") > 0)
    few = (F.col("trades") > 0) & (F.col("trades") < min_trades) & (F.col("objective") > NEG_INF)
    row = F.struct("threshold", "trades", "objective")
    rank = F.struct(F.col("objective"), -F.col("threshold_index"))
    out = swept.groupBy(*keys).agg(
        F.max_by(row, F.when(admissible, rank)).alias("_best"),
        F.max_by(row, F.when(few, rank)).alias("_few"),
        F.max(admissible).alias("_has_best"),
        F.max(few).alias("_has_few"),
    )
    fallback = F.col("_has_few") & ~F.lit(strict)
    status = F.when(F.col("_has_best"), "selected").when(fallback, "fallback").otherwise("no_trade")
    picked = F.when(F.col("_has_best"), F.col("_best")).when(fallback, F.col("_few"))
    return out.select(
        *keys,
        F.coalesce(picked["threshold"], F.lit(NO_TRADE)).alias("threshold"),
        F.coalesce(picked["trades"], F.lit(0)).alias("trades"),
        picked["objective"].alias("objective"),
        status.alias("status"),
    )


def shown(c: str = "threshold") -> Column:
    """The threshold for reports: the no-trade sentinel is hidden."""
    return F.when(F.col(c) < NO_TRADE - SAME, F.col(c))


def choose_tied(swept: DataFrame, keys: list[str], how: str, tolerance: float = 0.0, improvement: float = 0.05) -> DataFrame:
    """Choice among admissible rows that are within `tolerance` (a share of the best objective) of the best.

    fewer_trades, balanced (more active days), diversified (both concentrations lower than the best row's
    by `improvement`; the lowest wins), avoid_floor_snap (a threshold that was not moved to the floor).
    """
    ok = swept.filter((F.size("flags") == 0) & (F.col("objective") > NEG_INF))
    first = F.struct(F.col("objective"), -F.col("threshold_index"))
    best = ok.groupBy(*keys).agg(
        F.max_by(F.struct("threshold_index", "objective", "profit_top1", "trade_top1"), first).alias("_b")
    )
    both = ok.join(best, keys) if keys else ok.crossJoin(F.broadcast(best))  # one row without keys
    near = both.filter(
        (F.col("objective") >= F.col("_b.objective") - F.abs(F.col("_b.objective")) * tolerance)
        | (F.col("threshold_index") == F.col("_b.threshold_index"))
    )
    is_best = F.col("threshold_index") == F.col("_b.threshold_index")
    tail = [F.col("objective"), -F.col("threshold_index")]
    if how == "fewer_trades":
        rank = F.struct(-F.col("trades"), *tail)
    elif how == "balanced":
        rank = F.struct(F.col("active_days"), *tail)
    elif how == "avoid_floor_snap":
        rank = F.struct((~F.col("floor_snapped")).cast("int"), *tail)
    elif how == "diversified":
        better = (F.col("profit_top1") <= F.col("_b.profit_top1") - improvement) & (
            F.col("trade_top1") <= F.col("_b.trade_top1") - improvement
        )
        near = near.filter(better | is_best)
        rank = F.struct(better.cast("int"), -(F.col("profit_top1") + F.col("trade_top1")), *tail)
    else:
        raise ValueError(f"unknown tie break {how}")
    pick = F.max_by(F.struct("threshold", "trades", "objective", is_best.alias("was_best")), rank).alias("p")
    return near.groupBy(*keys).agg(pick).select(*keys, "p.*")


def near_misses(swept: DataFrame, keys: list[str], only: str = "rejected_under_min_avg_net_return") -> DataFrame:
    """Rejected rows that fail nothing but one check: how many, and the best of them by mean net return."""
    alone = (F.size("flags") == 1) & (F.col("flags")[0] == only)
    row = F.struct("threshold", "trades", "avg_net", "trade_top1")
    rank = F.when(alone, F.struct(F.col("avg_net"), -F.col("threshold_index")))
    tried = F.when(F.col("trades") > 0, F.col("avg_net"))
    return swept.groupBy(*keys).agg(
        F.count_if(alone).alias("near_miss_count"),
        F.max(tried).alias("best_avg_net"),
        F.max_by(row, rank).alias("_m"),
    ).select(
        *keys, "near_miss_count", "best_avg_net",
        F.col("_m.threshold").alias("near_miss_threshold"),
        F.col("_m.trades").alias("near_miss_trades"),
        F.col("_m.avg_net").alias("near_miss_avg_net"),
    )


def stability(swept: DataFrame, selected: DataFrame, keys: list[str]) -> DataFrame:
    """How little the metrics move over the two neighbours on each side of the selected threshold.

    `selected` has the keys and `selected_threshold`. Four components in [0, 1] and their mean.
    """
    numbered = swept.withColumn(
        "_i", F.row_number().over(Window.partitionBy(*keys).orderBy("threshold_index", "threshold"))  # grid rows
    ).join(selected, keys)
    gap = F.abs(F.col("threshold") - F.col("selected_threshold"))
    at = numbered.groupBy(*keys).agg(
        F.min_by(F.struct("_i", "threshold", "avg_net"), F.struct(gap, F.col("_i"))).alias("_at")
    )
    around = numbered.join(at, keys).filter(F.abs(F.col("_i") - F.col("_at._i")) <= 2)
    agg = around.groupBy(*keys, "selected_threshold", "_at").agg(
        F.min("avg_net").alias("neighbor_min_avg_net"), F.max("avg_net").alias("neighbor_max_avg_net"),
        F.min("trades").alias("neighbor_min_trades"), F.max("trades").alias("neighbor_max_trades"),
        F.min("trade_top1").alias("_c0"), F.max("trade_top1").alias("_c1"),
        F.avg((F.size("flags") == 0).cast("double")).alias("_ok"),
    )
    own, low = F.col("_at.avg_net"), F.col("neighbor_min_avg_net")
    performance = F.when(own > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), low / own))).otherwise((low >= own).cast("double"))
    n0, n1 = F.col("neighbor_min_trades"), F.col("neighbor_max_trades")
    trades = F.when(n1 > 0, F.greatest(F.lit(0.0), 1 - (n1 - n0) / n1)).otherwise(1.0)
    spread = F.greatest(F.lit(0.0), 1 - (F.col("_c1") - F.col("_c0")))
    return agg.select(
        *keys, "selected_threshold", F.col("_at.threshold").alias("closest_threshold"), own.alias("selected_avg_net"),
        "neighbor_min_avg_net", "neighbor_max_avg_net", "neighbor_min_trades", "neighbor_max_trades",
        ((performance + trades + spread + F.col("_ok")) / 4).alias("stability"),
    )


def blockers(df: DataFrame, chosen: DataFrame, score: str, keys: list[str]) -> DataFrame:
    """Keys whose best score stays below their threshold: that score, its gap and the closest symbol."""
    best = df.groupBy(*keys).agg(
        F.max(score).alias("best_score"),
        F.max_by("symbol", F.struct(F.col(score), F.col("symbol"))).alias("closest_symbol"),
    )
    joined = best.join(chosen.select(*keys, "threshold"), keys)
    return joined.filter(F.col("best_score") < F.col("threshold")).withColumn("gap", F.col("threshold") - F.col("best_score"))
