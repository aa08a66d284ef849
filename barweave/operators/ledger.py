"""Portfolio ledgers: events out of trades, sinks, and reconciliation per fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import MS_PER_MINUTE, fold_index, safe_ratio
from ..session import stored
from . import prefix

OPEN, CLOSE, MARK = "position_open", "position_close", "mark_to_market"
START = 10_000.0
TOLERANCE = 1e-6
DEFAULT_FOLD = "default"  # events without a fold
CELL = 10  # a cell of the exposure has two to this power of rows

# The ledger schema, version 1, in file order.
EVENT_SCHEMA = """
event_sequence bigint, timestamp double, event_type string, trade_id string, candidate_id string, symbol string,
fold_id string, decision_timestamp double, entry_timestamp double, exit_timestamp double, position_quantity double,
position_notional double, entry_price double, current_price double, realized_pnl double, unrealized_pnl double,
fee double, slippage double, latency_cost double, cash_balance double, reserved_capital double,
total_open_exposure double, equity double, concurrent_position_count int
"""
EVENT_FIELDS = [tuple(part.split()) for part in EVENT_SCHEMA.replace("\n", " ").split(",")]


def to_schema(df: DataFrame) -> DataFrame:
    cols = [(F.col(n) if n in df.columns else F.lit(None)).cast(k).alias(n) for n, k in EVENT_FIELDS]
    return df.select(*cols)


def from_trades(trades: DataFrame, start: float = START, fee_rate: float = 0.001, slippage_rate: float = 0.0005) -> DataFrame:
    """Open and close events of trades (trade_id, candidate_id, symbol, fold_id, open_time, close_time in ms,
    notional, gross_return), half of the costs on each side, with running cash, exposure and equity per fold.

    The sequence runs on over the folds; at one time closes come before opens.
    """
    n = F.col("notional")
    fee, slip = n * fee_rate / 2, n * slippage_rate / 2
    minute = {c: (F.col(c) / MS_PER_MINUTE) for c in ("open_time", "close_time")}

    def event(kind, at, pnl, side):
        return F.struct(
            minute[at].alias("timestamp"), F.lit(kind).alias("event_type"), pnl.alias("realized_pnl"), F.lit(side).alias("_side")
        )

    pairs = F.explode(F.array(event(OPEN, "open_time", F.lit(0.0), 1), event(CLOSE, "close_time", n * F.col("gross_return"), -1)))
    events = trades.select(
        "trade_id", "candidate_id", "symbol", "fold_id", n.alias("position_notional"), fee.alias("fee"), slip.alias("slippage"),
        F.lit(0.0).alias("latency_cost"), F.lit(0.0).alias("unrealized_pnl"), minute["open_time"].alias("decision_timestamp"),
        minute["open_time"].alias("entry_timestamp"), minute["close_time"].alias("exit_timestamp"), pairs.alias("_e"),
    ).select("*", "_e.*").drop("_e")
    order = ["fold_id", "timestamp", "_side", "trade_id"]
    gain = F.col("realized_pnl") - F.col("fee") - F.col("slippage") - F.col("latency_cost")
    run = prefix.ordered(
        events, ["fold_id"], order[1:], rank="_n",
        sums={
            "_gain": gain,
            "total_open_exposure": F.col("_side") * F.col("position_notional"),
            "concurrent_position_count": F.col("_side"),
        },
    )
    sizes = trades.groupBy("fold_id").agg((2 * F.count(F.lit(1))).alias("_events"))
    earlier = Window.orderBy(fold_index("fold_id"), "fold_id").rowsBetween(Window.unboundedPreceding, -1)  # one row per fold
    offsets = sizes.select("fold_id", F.coalesce(F.sum("_events").over(earlier), F.lit(0)).alias("_before"))
    run = run.join(F.broadcast(offsets), "fold_id")
    equity = F.col("_gain") + start
    out = run.withColumns(
        {
            "event_sequence": F.col("_before") + F.col("_n") - 1,
            "equity": equity,
            "reserved_capital": F.col("total_open_exposure"),
            "cash_balance": equity - F.col("total_open_exposure"),
        }
    )
    return to_schema(out)


def write(events: DataFrame, path: str) -> None:
    to_schema(events).write.mode("overwrite").parquet(path)


def totals(events: DataFrame, keys: list[str]) -> DataFrame:
    """First and last equity, costs, profit and return, counts and peaks per key."""
    seq = F.col("event_sequence")
    equity, exposure = F.col("equity"), F.col("total_open_exposure")
    out = events.groupBy(*keys).agg(
        F.min_by("equity", seq).alias("starting_capital"),
        F.max_by("equity", seq).alias("ending_capital"),
        F.count(F.lit(1)).alias("event_count"),
        F.sum("fee").alias("total_fees"),
        F.sum("slippage").alias("total_slippage"),
        F.sum("latency_cost").alias("total_latency_cost"),
        F.max("concurrent_position_count").alias("max_concurrent_positions"),
        F.max("total_open_exposure").alias("maximum_open_exposure"),
        F.coalesce(F.max(F.when(equity > 0, exposure / equity)), F.lit(0.0)).alias("maximum_capital_utilization"),
        F.count_if(F.col("event_type") == MARK).alias("mark_events"),
    )
    profit = F.col("ending_capital") - F.col("starting_capital")
    return out.withColumn("portfolio_profit", profit).withColumn(
        "portfolio_return", safe_ratio(F.col("portfolio_profit"), F.col("starting_capital"))
    )


def drawdown(events: DataFrame, keys: list[str]) -> DataFrame:
    """Largest fall from the peak, longest time under water, longest time to recovery, per key (minutes).

    A stretch under water has constant 'sequence of the last row at the peak'; it ends with the first row
    that reaches the peak again.
    """
    narrow = events.select(*keys, "event_sequence", "timestamp", "equity")
    top = F.struct("equity", "event_sequence")  # of equal peaks the last one
    run = prefix.ordered(narrow, keys, ["event_sequence"], maxes={"_top": top}, maxes_before={"_top_before": top})
    run = run.withColumns(
        {"peak": F.col("_top.equity"), "_stretch": F.col("_top.event_sequence"), "_before": F.col("_top_before.event_sequence")}
    )
    below = F.col("equity") < F.col("peak")
    gap = F.when(below & (F.col("peak") > 0), (F.col("peak") - F.col("equity")) / F.col("peak"))
    # Rows below the peak belong to the stretch; a row at the peak closes the stretch of the row before it.
    spans = run.withColumn("_id", F.when(below, F.col("_stretch")).otherwise(F.col("_before")))
    spans = spans.groupBy(*keys, "_id").agg(
        F.min(F.when(below, F.col("timestamp"))).alias("_from"),
        F.max(F.when(below, F.col("timestamp"))).alias("_last"),
        F.max(F.when(~below, F.col("timestamp"))).alias("_back"),
        F.max(gap).alias("_gap"),
    )
    zero = F.lit(0.0)
    return spans.groupBy(*keys).agg(
        F.coalesce(F.max("_gap"), zero).alias("max_drawdown"),
        F.coalesce(F.max(F.col("_last") - F.col("_from")), zero).alias("longest_underwater_minutes"),
        F.coalesce(F.max(F.when(F.col("_from").isNotNull(), F.col("_back") - F.col("_from"))), zero).alias("time_to_recovery_minutes"),
    )


def _levels(rows: DataFrame, column: str) -> int:
    return max(1, int(rows.agg(F.max(column)).first()[0] or 0).bit_length())


def _level(count: Column) -> Column:
    """k with 2 ** k <= count < 2 ** (k + 1)."""
    return F.length(F.bin(count)) - 1


def _spread(rows: DataFrame, over: Window, levels: int, starting, ending=None) -> DataFrame:
    """Adds `_top`: the largest value of the stretches that cover a row.

    A stretch is covered by two runs of 2 ** k rows. `starting(k)` is the value of such a run from this row on, `ending(k)` that of one which
    ends before this row. A run hands its value to its halves, the longest runs first.
    """
    rows = rows.withColumn("_top", F.lit(None).cast("double"))
    for k in reversed(range(levels)):
        tops = [F.col("_top"), F.lag("_top", 1 << k).over(over), starting(k)]
        if ending is not None:
            tops.append(F.lead(ending(k), 1 << k).over(over))
        rows = rows.withColumn("_top", F.greatest(*tops))
    return rows


def symbol_exposure(events: DataFrame, cell: int = CELL) -> DataFrame:
    """Per fold: the largest exposure of one symbol over the equity of the moment. A close counts only when its trade was opened.

    A symbol's exposure is constant between its own events. These stretches are laid over the events, each of which gets the largest
    exposure that covers it. Rows are in ordered buckets, and a bucket is cut into cells of 2 ** `cell` rows. A stretch within a cell is spread over its rows;
    a longer one covers the end of one cell, whole cells, which are rows of a small table, and the start of another.
    """
    named = F.col("fold_id").isNotNull()
    events = stored(events.select("fold_id", "trade_id", "symbol", "event_sequence", "event_type", "position_notional", F.when(F.col("equity") > 0, F.col("equity")).alias("low")))
    opening, closing = (F.col("event_type").eqNullSafe(F.lit(kind)) & named for kind in (OPEN, CLOSE))
    opens = events.filter(opening).select(
        F.col("fold_id").alias("_fold"), F.col("trade_id").alias("_trade"), F.col("symbol").alias("_symbol"), F.col("position_notional").alias("_notional"), F.col("event_sequence").alias("_opened")
    )
    opened = (F.col("fold_id") == F.col("_fold")) & (F.col("trade_id") == F.col("_trade")) & (F.col("_opened") < F.col("event_sequence"))
    closes = events.filter(closing).join(opens, opened, "left").select("fold_id", "event_sequence", "low", F.col("_symbol").alias("symbol"), (-F.col("_notional")).alias("step"))
    others = events.filter(~closing).select(
        "fold_id", "event_sequence", "low", F.when(opening, F.col("symbol")).alias("symbol"), F.when(opening, F.col("position_notional")).alias("step")
    )
    placed = prefix.ranged(others.unionByName(closes), ["fold_id"], ["event_sequence", "symbol", "step"])

    at = F.col(prefix.AT)
    inside = F.shiftright(at.bitwiseAND(F.lit((1 << 33) - 1)), cell)  # the cell within its bucket
    sizes = placed.groupBy(prefix.BUCKET).agg(F.max(inside + 1).alias("_n"))
    earlier = Window.orderBy(prefix.BUCKET).rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    bases = sizes.select(prefix.BUCKET, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    rows = placed.join(F.broadcast(bases), prefix.BUCKET).select("fold_id", prefix.BUCKET, prefix.AT, (F.col("_base") + inside).alias("_cell"), "low", "symbol", "step")

    own = Window.partitionBy(prefix.BUCKET, "fold_id", "symbol").orderBy(prefix.AT)
    here = F.struct(at.alias("at"), F.col("_cell").alias("cell"))
    moves = rows.filter(F.col("symbol").isNotNull()).withColumn("_next", F.lead(here).over(own))
    moves = prefix.scan(moves, ["fold_id", "symbol"], [], sums={"_held": F.col("step")}, previous={"_was": here})
    same_next, same_was = (F.coalesce(F.col(f"{c}.cell") == F.col("_cell"), F.lit(False)) for c in ("_next", "_was"))
    before = F.col("_held") - F.col("step")
    # the crossing rows are read twice
    moves = stored(
        moves.select(
            "fold_id", "symbol", prefix.AT, "_cell", "low", F.col("_held").alias("held"),
            F.when(same_next, F.col("_next.at") - at).alias("_on"),
            F.when(same_was, at - F.col("_was.at")).alias("_back"), F.when(F.col("_was").isNotNull(), before).alias("before"), F.col("_was.cell").alias("_from"),
        )
    )

    line = Window.partitionBy("fold_id", "_cell").orderBy(prefix.AT)
    back = Window.partitionBy("fold_id", "_cell").orderBy(F.desc(prefix.AT)).rowsBetween(Window.unboundedPreceding, -1)
    marks = rows.filter(F.col("symbol").isNull()).select("fold_id", prefix.AT, "_cell", "low")
    each = moves.drop("symbol").unionByName(marks, allowMissingColumns=True)
    each = _spread(
        each, line, cell,
        lambda k: F.when(_level(F.col("_on")) == k, F.col("held")), lambda k: F.when(_level(F.col("_back")) == k, F.col("before")),
    )
    tail = F.max(F.when(F.col("_on").isNull(), F.col("held"))).over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    head = F.max(F.when(F.col("_back").isNull(), F.col("before"))).over(back)
    shares = each.select("fold_id", "low", F.greatest("_top", tail, head).alias("_top"))

    cells = rows.groupBy("fold_id", "_cell").agg(F.min("low").alias("low"))  # a row for each 2 ** cell rows
    limits = cells.groupBy("fold_id").agg(F.max("_cell").alias("_end"), F.count(F.lit(1)).alias("_n"))
    across = moves.filter(F.col("_from") < F.col("_cell") - 1).select("fold_id", (F.col("_from") + 1).alias("_cell"), (F.col("_cell") - F.col("_from") - 1).alias("_n"), F.col("before").alias("held"))
    last = moves.groupBy("fold_id", "symbol").agg(F.max_by(F.struct("_cell", "held"), at).alias("last")).select("fold_id", "last.*")
    after = last.join(F.broadcast(limits.select("fold_id", "_end")), "fold_id").filter(F.col("_cell") < F.col("_end"))  # limits: one row a fold
    after = after.select("fold_id", (F.col("_cell") + 1).alias("_cell"), (F.col("_end") - F.col("_cell")).alias("_n"), "held")
    runs = across.unionByName(after).filter(F.col("held") > 0).withColumn("k", _level(F.col("_n")))
    second = F.col("_cell") + F.col("_n") - F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("k"))
    runs = runs.select("fold_id", F.explode(F.array("_cell", second)).alias("_cell"), "k", "held")
    levels = _levels(limits, "_n")
    starts = runs.groupBy("fold_id", "_cell").agg(*[F.max(F.when(F.col("k") == k, F.col("held"))).alias(f"_start{k}") for k in range(levels)])
    whole = _spread(cells.join(starts, ["fold_id", "_cell"], "left"), Window.partitionBy("fold_id").orderBy("_cell"), levels, lambda k: F.col(f"_start{k}"))
    every = events.select("fold_id", F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("_top"))
    shares = shares.unionByName(whole.select("fold_id", "low", "_top")).unionByName(every)
    return shares.groupBy("fold_id").agg(F.coalesce(F.max(F.greatest(F.lit(0.0), F.col("_top")) / F.col("low")), F.lit(0.0)).alias("maximum_per_symbol_exposure"))


def reconcile(events: DataFrame, reported: DataFrame | None = None) -> DataFrame:
    """Totals and drawdowns per fold with a status: fees and slippage must equal the reported ones.

    `reported` has fold_id, reported_fees and reported_slippage; a missing value is not checked. Events without a fold are filed
    under `DEFAULT_FOLD`.
    """
    named = F.coalesce(F.nullif(F.trim("fold_id"), F.lit("")), F.lit(DEFAULT_FOLD))
    read = [
        "event_sequence", "timestamp", "event_type", "trade_id", "symbol", "position_notional", "fee", "slippage", "latency_cost", "total_open_exposure", "equity",
        "concurrent_position_count",
    ]
    events = stored(events.select(named.alias("fold_id"), *read))  # read by all three
    out = totals(events, ["fold_id"]).join(drawdown(events, ["fold_id"]), "fold_id").join(symbol_exposure(events), "fold_id")
    if reported is not None:
        out = out.join(reported, "fold_id", "left")
    else:
        out = out.withColumns({c: F.lit(None).cast("double") for c in ("reported_fees", "reported_slippage")})

    def same(total: str, told: str) -> Column:
        return F.col(told).isNull() | (F.abs(F.col(total) - F.col(told)) <= TOLERANCE)

    passed = same("total_fees", "reported_fees") & same("total_slippage", "reported_slippage")
    marked = F.col("mark_events") > 0
    return out.withColumns(
        {
            "status": F.when(passed, "passed").otherwise("failed"),
            "drawdown_precision": F.when(marked, "exact_mark_to_market").otherwise("exact_realized"),
        }
    )


def by_fold(reconciled: DataFrame) -> DataFrame:
    """One row over folds: every fold must pass; peaks are the worst fold's."""
    worst = [
        "max_concurrent_positions", "maximum_capital_utilization", "maximum_open_exposure", "maximum_per_symbol_exposure",
        "max_drawdown", "longest_underwater_minutes", "time_to_recovery_minutes",
    ]
    return reconciled.agg(
        F.when(F.bool_and(F.col("status") == "passed"), "passed").otherwise("failed").alias("status"),
        F.sum("event_count").alias("event_count"),
        F.count(F.lit(1)).alias("fold_count"),
        F.when(F.bool_and(F.col("drawdown_precision") == "exact_mark_to_market"), "exact_mark_to_market").otherwise("exact_realized").alias("drawdown_precision"),
        *[F.max(c).alias(c) for c in worst],
    )


def match_candidates(events: DataFrame, executed: DataFrame) -> DataFrame:
    """Opened candidates against executed candidates: ids on one side only, and whether the sets agree."""
    opened = events.filter(F.col("event_type") == OPEN).select("candidate_id").distinct().withColumn("_o", F.lit(1))
    wanted = executed.select("candidate_id").distinct().withColumn("_e", F.lit(1))
    both = opened.join(wanted, "candidate_id", "full_outer")
    out = both.agg(
        F.count("_o").alias("opened"),
        F.count("_e").alias("executed"),
        F.count_if(F.col("_e").isNull()).alias("opened_only"),
        F.count_if(F.col("_o").isNull()).alias("executed_only"),
    )
    return out.withColumn("matched", (F.col("opened_only") == 0) & (F.col("executed_only") == 0))
