"""Shared primitives, sources, sinks and universe."""

from __future__ import annotations

import io
import zipfile
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import prefix, universe
from ..session import scratch
from ..sources import bars as bar_files
from ..sources import candidates as arts
from ..sources import samples as sets
from ..sources import trades as tapes
from .bindings import r, with_tables
from .registry import query


@query(
    "x01_ordered_prefix",
    with_tables(
        "cand",
        f"""SELECT row_id, symbol, row_number() OVER w AS place, count(*) OVER (PARTITION BY symbol) AS symbol_rows,
        {r("sum(position_size) OVER w", 2)} AS running_size, {r("max(trade_score) OVER w")} AS running_top_score,
        lag(row_id) OVER w AS previous_row
        FROM cand WINDOW w AS (PARTITION BY symbol ORDER BY open_time, row_id ROWS UNBOUNDED PRECEDING)""",
    ),
)
def ordered_prefix(t):
    c = t.candidates.select("row_id", "symbol", "open_time", "position_size", "trade_score")
    out = prefix.ordered(
        c, ["symbol"], ["open_time", "row_id"],
        sums={"running_size": F.col("position_size")}, maxes={"running_top_score": F.col("trade_score")},
        rank="place", total="symbol_rows", previous={"previous_row": F.col("row_id")},
    )
    return out.select(
        "row_id", "symbol", "place", "symbol_rows", X.rnd("running_size", 2).alias("running_size"),
        X.rnd("running_top_score").alias("running_top_score"), "previous_row",
    )


@query(
    "x02_guarded_math",
    with_tables(
        "cand",
        f"""SELECT row_id, {r("CASE WHEN uncertainty = 0 THEN 0.0 ELSE max_future_high_return / uncertainty END")} AS ratio,
        {r("greatest(-0.02, least(0.02, trade_return))")} AS clipped, {r("ln(1 + greatest(0.0, quote_volume))")} AS logged
        FROM cand""",
    ),
)
def guarded_math(t):
    return t.candidates.select(
        "row_id",
        X.rnd(X.safe_ratio("max_future_high_return", "uncertainty")).alias("ratio"),
        X.rnd(X.clip("trade_return", -0.02, 0.02)).alias("clipped"),
        X.rnd(X.log1p_pos("quote_volume")).alias("logged"),
    )


@query(
    "x03_parse_or_default",
    """SELECT o_orderkey, coalesce(try_cast(o_orderpriority AS DOUBLE), -1.0) AS whole_text,
    coalesce(try_cast(substr(o_orderpriority, 1, 1) AS DOUBLE), -1.0) AS first_digit,
    coalesce(try_cast(nullif(CAST(o_custkey % 3 AS VARCHAR), '1') AS DOUBLE), 0.0) <> 0 AS flag FROM orders""",
)
def parse_or_default(t):
    o = t.read("orders")
    third = (F.col("o_custkey") % 3).cast("string")
    return o.select(
        "o_orderkey",
        X.num("o_orderpriority", -1).alias("whole_text"),
        X.num(F.substring("o_orderpriority", 1, 1), -1).alias("first_digit"),
        X.truthy(F.nullif(third, F.lit("1"))).alias("flag"),
    )


BAR_SQL = f"""SELECT symbol, month, open_time, {r("open")} AS open, {r("high")} AS high, {r("low")} AS low,
{r("close")} AS close, {r("volume")} AS volume, {r("quote_volume")} AS quote_volume, trades,
{r("taker_buy_base_volume")} AS taker_buy_base_volume FROM bars"""


def shown(bars: DataFrame) -> DataFrame:
    rounded = ["open", "high", "low", "close", "volume", "quote_volume", "taker_buy_base_volume"]
    return bars.select("symbol", "month", "open_time", "trades", *[X.rnd(c).alias(c) for c in rounded])


@query("x04_bars_from_trades", with_tables("bars", BAR_SQL))
def bars_from_trades(t):
    return shown(t.bars)


@query("s01_read_bars", with_tables("bars", BAR_SQL))
def read_bars(t):
    path = scratch(t.spark, "bar-lines")
    lines = bar_files.lines_of(t.bars).drop("month")
    header = t.bars.select("symbol", F.lit("open_time,open,high,low,close,volume,x,q,n,t,x").alias("value")).distinct()
    lines.unionByName(header).write.partitionBy("symbol").text(path)
    return shown(bar_files.parse_lines(t.spark.read.text(path)))


def _zip_month(pdf: pd.DataFrame) -> pd.DataFrame:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("bars.csv", "\n".join(pdf["value"]))
    return pd.DataFrame({"symbol": [pdf["symbol"].iloc[0]], "content": [buffer.getvalue()]})


@query("s02_read_zipped_bars", with_tables("bars", BAR_SQL))
def read_zipped_bars(t):
    # One archive per symbol and month, as the exchange publishes them.
    archives = bar_files.lines_of(t.bars).groupBy("symbol", "month").applyInPandas(_zip_month, "symbol string, content binary")
    return shown(bar_files.parse_archives(archives))


@query(
    "s03_read_trades",
    with_tables(
        "trades",
        f"""SELECT symbol, CASE WHEN is_buyer_maker THEN 'sell' ELSE 'buy' END AS side, count(*) AS trades,
        {r("sum(quantity)")} AS quantity, {r("sum(price * quantity)", 3)} AS quote, min(trade_time) AS first_time
        FROM trades WHERE event_id % 11 <> 0 GROUP BY 1, 2""",
    ),
)
def read_trades(t):
    path = scratch(t.spark, "tape")
    flag = (
        F.when(F.col("event_id") % 11 == 0, "unknown")
        .when(F.col("is_buyer_maker"), F.when(F.col("event_id") % 3 == 0, "True").otherwise("true"))
        .otherwise(F.when(F.col("event_id") % 3 == 0, "0").otherwise("False"))
    )
    cells = ["event_id", "price", "quantity", F.lit("0"), "trade_time", flag]
    t.trades.select("symbol", F.concat_ws(",", *[X.as_col(c).cast("string") for c in cells]).alias("value")).write.partitionBy(
        "symbol"
    ).text(path)
    tape = tapes.parse_tape(t.spark.read.text(path))
    return tape.groupBy("symbol", "side").agg(
        F.count(F.lit(1)).alias("trades"),
        X.rnd(F.sum("quantity")).alias("quantity"),
        X.rnd(F.sum(F.col("price") * F.col("quantity")), 3).alias("quote"),
        F.min("trade_time").alias("first_time"),
    )


@query(
    "s04_prefer_monthly",
    with_tables(
        "cand",
        """SELECT c.symbol, c.month, count(*) AS rows, max(line) AS last_line FROM cand c
        LEFT JOIN (SELECT DISTINCT symbol, month FROM cand WHERE line <= 3) m ON m.symbol = c.symbol AND m.month = c.month
        WHERE line <= 3 OR m.symbol IS NULL GROUP BY 1, 2""",
    ),
)
def prefer_monthly(t):
    c = t.candidates.select("symbol", "month", "line")
    return (
        bar_files.prefer_monthly(c.filter("line <= 3"), c)
        .groupBy("symbol", "month")
        .agg(F.count(F.lit(1)).alias("rows"), F.max("line").alias("last_line"))
    )


@query(
    "s05_first_months",
    with_tables(
        "cand",
        """SELECT symbol, count(*) AS rows, count(DISTINCT month) AS months, max(month) AS last_month FROM
        (SELECT symbol, month, dense_rank() OVER (PARTITION BY symbol ORDER BY month) AS place FROM cand)
        WHERE place <= 6 GROUP BY 1""",
    ),
)
def first_months(t):
    c = bar_files.first_months(t.candidates.select("symbol", "month"), 6)
    return c.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("month").alias("months"), F.max("month").alias("last_month")
    )


@query(
    "s06_symbol_union",
    "SELECT 'S' || s_suppkey AS symbol FROM supplier UNION SELECT 'S' || c_custkey FROM customer",
)
def symbol_union(t):
    a = t.read("supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("symbol"))
    b = t.read("customer").select(F.concat(F.lit("S"), "c_custkey").alias("symbol"))
    return universe.requested(a, b)


@query(
    "s07_epoch_units",
    """SELECT o_orderkey, epoch_ms(o_orderdate) AS open_time, epoch_ms(o_orderdate) // 60000 AS minute FROM orders""",
)
def epoch_units(t):
    us = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    raw = (
        F.when(F.col("o_orderkey") % 3 == 0, us)
        .when(F.col("o_orderkey") % 3 == 1, X.floor_div(us, 1000))
        .otherwise(X.floor_div(us, 1_000_000))
    )
    o = t.read("orders").select("o_orderkey", raw.alias("raw"))
    return o.select("o_orderkey", X.to_ms("raw").alias("open_time"), X.minute("raw").alias("minute"))


@query(
    "s08_sample_table",
    with_tables(
        "cand",
        f"""SELECT symbol, count(*) AS rows, {r("sum(trade_return)")} AS trade_return, min(open_time) AS first_time,
        sum(label)::BIGINT AS positives FROM cand GROUP BY 1""",
    ),
)
def sample_table(t):
    path = scratch(t.spark, "samples")
    sets.write_samples(t.candidates.select("symbol", "month", "open_time", "label", "trade_return"), path)
    return t.spark.read.parquet(path).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"),
        X.rnd(F.sum("trade_return")).alias("trade_return"),
        F.min("open_time").alias("first_time"),
        F.sum("label").alias("positives"),
    )


SHARD_SQL = f"count(*) AS rows, {r('sum(volume)')} AS volume"


def shard_totals(df: DataFrame) -> DataFrame:
    return df.groupBy("symbol", "month").agg(F.count(F.lit(1)).alias("rows"), X.rnd(F.sum("volume")).alias("volume"))


@query(
    "s09_shard_sink",
    with_tables(
        "bars",
        f"""SELECT symbol, month, {SHARD_SQL} FROM (SELECT symbol, month, CASE WHEN symbol = 'view' THEN 2 * volume ELSE volume END AS volume
        FROM bars) GROUP BY 1, 2""",
    ),
)
def shard_sink(t):
    path = scratch(t.spark, "shards")
    sets.write_shards(t.bars, path)
    sets.write_shards(t.bars.filter("symbol = 'view'").withColumn("volume", F.col("volume") * 2), path, "gzip")
    return shard_totals(t.spark.read.parquet(path))


@query(
    "s10_shard_manifest",
    with_tables(
        "bars",
        """SELECT symbol, month, count(*) AS rows, min(open_time) AS first_open_time, max(open_time) AS last_open_time,
        'target_stop' AS label_mode, 5 AS window_minutes FROM bars GROUP BY 1, 2""",
    ),
)
def shard_manifest(t):
    path = scratch(t.spark, "manifest")
    made = sets.shard_manifest(t.bars, {"label_mode": "target_stop", "window_minutes": 5})
    sets.write_manifest(made, path)
    return t.spark.read.schema(made.schema).json(path)


@query("s11_manifest_read", with_tables("bars", f"SELECT symbol, month, {SHARD_SQL} FROM bars WHERE symbol <> 'error' GROUP BY 1, 2"))
def manifest_read(t):
    path = scratch(t.spark, "shards")
    sets.write_shards(t.bars, path)
    listed = sets.shard_manifest(t.bars.filter("symbol <> 'error'"))
    return shard_totals(sets.read_shards(t.spark, path, listed))


def _halves(t):
    a = t.bars.filter(F.col("symbol").isin("view", "click", "error"))
    b = t.bars.filter(F.col("symbol").isin("error", "purchase", "signup"))
    return a, b


@query(
    "s12_merge_shards",
    with_tables(
        "bars",
        """SELECT CAST(CASE WHEN symbol IN ('view', 'click', 'error') THEN 0 ELSE 1 END AS INTEGER) AS source,
        count(DISTINCT (symbol, month)) AS shards, count(*) AS rows FROM bars GROUP BY 1""",
    ),
)
def merge_shards(t):
    _, added = sets.merge_shards(list(_halves(t)), [{"window": 5}, {"window": 5}])
    return added.withColumnRenamed("_source", "source")


@query("s13_append_shards", with_tables("bars", f"SELECT symbol, month, {SHARD_SQL} FROM bars GROUP BY 1, 2"))
def append_shards(t):
    path = scratch(t.spark, "shards")
    a, b = _halves(t)
    sets.write_shards(a, path)
    sets.append_shards(t.spark, path, [b])
    sets.append_shards(t.spark, path, [b])  # nothing new the second time
    return shard_totals(t.spark.read.parquet(path))


@query(
    "s14_global_month_index",
    with_tables(
        "cand",
        """SELECT month, CAST(month_index AS INTEGER) AS month_index, count(*) AS rows, count(DISTINCT symbol) AS symbols FROM
        (SELECT month, symbol, dense_rank() OVER (ORDER BY month) - 1 AS month_index FROM cand) GROUP BY 1, 2""",
    ),
)
def global_month_index(t):
    return (
        sets.global_month_index(t.candidates.select("symbol", "month"))
        .groupBy("month", "month_index")
        .agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("symbol").alias("symbols"))
    )


@query(
    "s15_sample_checks",
    with_tables(
        "cand",
        """SELECT count(*) AS rows, 0::BIGINT AS missing_quote_volume, 0::BIGINT AS bad_open_time,
        count_if(trade_return < -0.03 - 1e-9)::BIGINT AS below_stop, count_if(trade_return > 0.05 + 1e-9)::BIGINT AS above_target FROM cand""",
    ),
)
def sample_checks(t):
    return sets.sample_violations(t.candidates, 0.05, 0.03)


@query(
    "s16_effective_targets",
    """SELECT c_custkey, CASE WHEN u > 0 THEN u ELSE 0.05 END AS effective_target,
    CASE WHEN u > 0 THEN 'manifest' ELSE 'default' END AS target_source,
    CASE WHEN s > 0 THEN s ELSE 0.02 END AS effective_stop, CASE WHEN s > 0 THEN 'manifest' ELSE 'default' END AS stop_source
    FROM (SELECT c_custkey, c_acctbal / 100000 AS u, CASE WHEN c_nationkey > 3 THEN c_nationkey / 1000 END AS s FROM customer)""",
)
def effective_targets(t):
    m = t.read("customer").select(
        "c_custkey",
        (F.col("c_acctbal") / 100000).alias("upside_target"),
        F.when(F.col("c_nationkey") > 3, F.col("c_nationkey") / 1000).alias("downside_stop"),
    )
    return sets.effective_targets(m).drop("upside_target", "downside_stop")


@query(
    "s17_prediction_modes",
    with_tables(
        "art",
        f"""SELECT mode, count(*) AS rows, {r("sum(position_size)", 2)} AS size FROM art, (VALUES ('all'), ('trades'), ('candidates')) v(mode)
        WHERE mode = 'all' OR (mode = 'trades' AND executed = 1) OR (mode = 'candidates' AND (raw_signal = 1 OR executed = 1 OR selected_by_topk = 1))
        GROUP BY 1""",
    ),
)
def prediction_modes(t):
    parts = []
    for mode in ("all", "trades", "candidates", "none"):
        path = scratch(t.spark, f"predictions-{mode}")
        arts.write_predictions(t.artifact, path, mode)
        parts.append(t.spark.read.parquet(path).select(F.lit(mode).alias("mode"), "position_size"))
    both = reduce(DataFrame.unionByName, parts)
    return both.groupBy("mode").agg(F.count(F.lit(1)).alias("rows"), X.rnd(F.sum("position_size"), 2).alias("size"))


@query(
    "s18_candidate_sink",
    with_tables(
        "art",
        """SELECT 1 AS version, true AS complete, count(*) AS rows, count_if(executed = 1)::BIGINT AS executed_rows,
        true AS full_candidate_coverage FROM art""",
    ),
)
def candidate_sink(t):
    path = scratch(t.spark, "candidates")
    arts.write_candidates(t.artifact.withColumn("extra", F.lit(1)), path)
    told = t.spark.read.json(f"{path}/manifest")
    return told.select(F.col("version").cast("int").alias("version"), "complete", "rows", "executed_rows", "full_candidate_coverage")


@query(
    "s19_candidate_read_check",
    with_tables(
        "art",
        f"""SELECT symbol, count(*) AS rows, count(actual_exit_return) AS exits, count(ranker_score) AS ranker_scores,
        {r("sum(quote_volume)", 3)} AS quote_volume FROM (SELECT *, NULL AS ranker_score FROM art) GROUP BY 1""",
    ),
)
def candidate_read_check(t):
    path = scratch(t.spark, "candidates")
    arts.write_candidates(t.artifact, path)
    return arts.read_candidates(t.spark, path).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("actual_exit_return").alias("exits"),
        F.count("ranker_score").alias("ranker_scores"),
        X.rnd(F.sum("quote_volume"), 3).alias("quote_volume"),
    )


@query(
    "s20_capabilities",
    """WITH m AS (SELECT o_orderkey, o_orderpriority <> '5-LOW' AS known, o_orderstatus = 'F' AS full_rows, o_custkey % 2 = 0 AS pre FROM orders)
    SELECT o_orderkey, CASE WHEN NOT known THEN 'legacy_trades_only_or_unknown' ELSE
      (CASE WHEN pre THEN 'pre_filter_candidate' ELSE 'post_selection_candidate' END) || (CASE WHEN full_rows THEN '' ELSE '_limited' END) END AS coverage_level,
    CASE WHEN NOT known THEN 'unsupported' WHEN full_rows THEN 'supported' ELSE 'unsupported_limited_rows' END AS true_topk_reselection,
    CASE WHEN known AND pre AND full_rows THEN 'supported' ELSE 'unsupported' END AS score_edge_ablation,
    CASE WHEN NOT known THEN 'no manifest lies with the rows' WHEN NOT full_rows THEN 'the saved rows are not all candidates'
      WHEN NOT pre THEN 'the filters had already run when the rows were saved' ELSE '' END AS reason FROM m""",
)
def capabilities(t):
    stage = F.when(F.col("o_custkey") % 2 == 0, arts.PRE_FILTER_STAGE).otherwise("post_selection")
    m = t.read("orders").select(
        "o_orderkey",
        (F.col("o_orderpriority") != "5-LOW").alias("has_manifest"),
        (F.col("o_orderstatus") == "F").alias("full_candidate_coverage"),
        stage.alias("candidate_serialization_stage"),
    )
    return arts.capabilities(m).select("o_orderkey", "coverage_level", "true_topk_reselection", "score_edge_ablation", "reason")


@query(
    "s21_candidate_id",
    with_tables("art", "SELECT sha1(symbol || '|' || open_time || '|' || coalesce(stable_row_id, '')) AS id, count(*) AS rows FROM art GROUP BY 1"),
)
def candidate_ids(t):
    made = X.candidate_id("symbol", "open_time", "stable_row_id")
    return t.artifact.groupBy(made.alias("id")).agg(F.count(F.lit(1)).alias("rows"))


COMPACT_SQL = """SELECT CASE WHEN candidate_id IS NOT NULL THEN 'candidate:' || candidate_id
  WHEN stable_row_id IS NOT NULL THEN 'stable:' || stable_row_id ELSE source || ':' || fold_id || ':' || row_position END AS row_id,
  symbol, month, CAST(substr(fold_id, 6) AS INTEGER) AS fold, executed AS predicted, selected_by_topk, raw_signal,
  coalesce(actual_exit_return, trade_return) AS dynamic_trade_return, raw_probability AS probability,
  coalesce(calibrated_predicted_return, raw_predicted_return) AS predicted_trade_return,
  coalesce(final_preselection_score, hybrid_score) AS trade_score FROM art"""


@query("s22_research_columns", with_tables("art", COMPACT_SQL))
def research_columns(t):
    return arts.compact(arts.to_schema(t.artifact)).select(
        "row_id", "symbol", "month", "fold", "predicted", "selected_by_topk", "raw_signal", "dynamic_trade_return",
        "probability", "predicted_trade_return", "trade_score",
    )


@query(
    "s23_relevant_rows",
    with_tables(
        "art",
        """SELECT candidate_serialization_stage, fold_id, count(*) AS rows FROM art
        WHERE (candidate_serialization_stage = 'pre_score_edge_pre_symbol_filter' AND selected_by_threshold = 1)
           OR raw_signal = 1 OR predicted = 1 OR executed = 1 OR selected_by_topk = 1 GROUP BY 1, 2""",
    ),
)
def relevant_rows(t):
    return arts.relevant(t.artifact).groupBy("candidate_serialization_stage", "fold_id").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "s24_extract",
    with_tables(
        "art",
        """SELECT count(*) AS rows, sum(raw_signal)::BIGINT AS raw_signal_rows, sum(predicted)::BIGINT AS predicted_rows,
        sum(selected_by_topk)::BIGINT AS selected_by_topk_rows,
        count_if(raw_signal + predicted + selected_by_topk > 0)::BIGINT AS kept_rows FROM art""",
    ),
)
def extract(t):
    return arts.extract(t.artifact)[1]


@query(
    "s26_row_identity",
    with_tables("art", f"SELECT split_part(row_id, ':', 1) AS kind, count(*) AS rows, count(DISTINCT row_id) AS ids FROM ({COMPACT_SQL}) GROUP BY 1"),
)
def row_identity(t):
    ids = t.artifact.select(arts.row_id(t.artifact).alias("row_id"))
    return ids.groupBy(F.split("row_id", ":")[0].alias("kind")).agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("row_id").alias("ids")
    )


@query(
    "s27_fold_number",
    with_tables(
        "cand",
        "SELECT CAST(CASE WHEN line = 7 THEN 0 ELSE fold END AS INTEGER) AS fold, count(*) AS rows FROM cand GROUP BY 1",
    ),
)
def fold_number(t):
    text = (
        F.when(F.col("line") == 1, F.col("fold").cast("string"))
        .when(F.col("line") == 2, F.concat(F.lit("fold_"), "fold"))
        .when(F.col("line") == 3, F.concat(F.lit("walkforward_fold_"), "fold"))
        .when(F.col("line") == 4, F.concat(F.lit("Fold-"), "fold"))
        .when(F.col("line") == 5, F.concat(F.lit("run "), "fold"))
        .when(F.col("line") == 6, F.concat(F.lit(" "), "fold", F.lit(".0 ")))
        .otherwise("none")
    )
    return t.candidates.groupBy(X.fold_index(text).alias("fold")).agg(F.count(F.lit(1)).alias("rows"))


BASES = "'BTC', 'EUR', 'ETHUP', 'SOL3S', 'W', 'UP', 'WBTC', 'DO-GE', 'JUP', 'ADA'"


@query(
    "u01_ordinary_symbols",
    f"""WITH s AS (SELECT s_suppkey, list_value({BASES})[CAST(s_suppkey % 10 AS INTEGER) + 1]
      || CASE WHEN s_suppkey % 7 = 0 THEN 'BUSD' ELSE 'USDT' END AS symbol FROM supplier)
    SELECT s_suppkey, symbol, s_suppkey % 7 <> 0 AND s_suppkey % 10 IN (0, 5, 9) AS ordinary FROM s""",
)
def ordinary_symbols(t):
    bases = F.array(*[F.lit(b.strip(" '")) for b in BASES.split(",")])
    base = F.element_at(bases, (F.col("s_suppkey") % 10 + 1).cast("int"))
    quote = F.when(F.col("s_suppkey") % 7 == 0, "BUSD").otherwise("USDT")
    s = t.read("supplier").select("s_suppkey", F.concat(base, quote).alias("symbol"))
    return s.withColumn("ordinary", universe.is_ordinary("symbol"))


COUNTS_CTE = """counts AS (SELECT symbol, sum(buys)::BIGINT AS buy_trades_3d, sum(sells)::BIGINT AS sell_trades_3d,
  string_agg(day, '|' ORDER BY day DESC) AS dates_used FROM (
    SELECT symbol, day, buys, sells, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS newest FROM (
      SELECT symbol, strftime(make_timestamp(trade_us), '%Y-%m-%d') AS day, count_if(NOT is_buyer_maker) AS buys,
             count_if(is_buyer_maker) AS sells FROM trades GROUP BY 1, 2)
    WHERE day >= '2024-01-25' AND day < '2024-01-29') WHERE newest <= 3 GROUP BY 1)"""


@query("u02_side_counts", with_tables("trades", "SELECT * FROM counts", COUNTS_CTE))
def side_counts(t):
    return universe.side_counts(t.trades, "2024-01-29")


@query(
    "u03_buy_sell_ratio",
    with_tables(
        "trades",
        f"""SELECT symbol, buy_trades_3d, sell_trades_3d, {r("buy_trades_3d / sell_trades_3d")} AS buy_sell_ratio FROM counts
        WHERE buy_trades_3d / sell_trades_3d BETWEEN 0.7 AND 1.8""",
        COUNTS_CTE,
    ),
)
def buy_sell_ratio(t):
    kept = universe.buy_sell_ratio(universe.side_counts(t.trades, "2024-01-29"))
    return kept.select("symbol", "buy_trades_3d", "sell_trades_3d", X.rnd("buy_sell_ratio").alias("buy_sell_ratio"))


@query(
    "u04_busiest_first",
    with_tables(
        "trades",
        """SELECT row_number() OVER (ORDER BY buy_trades_3d + sell_trades_3d DESC, symbol) AS place, symbol,
        buy_trades_3d + sell_trades_3d AS total_trades_3d, dates_used FROM counts""",
        COUNTS_CTE,
    ),
)
def busiest_first(t):
    counts = universe.with_ratio(universe.side_counts(t.trades, "2024-01-29"))
    placed = prefix.ordered(counts, [], [F.desc("total_trades_3d"), "symbol"], rank="place")
    return placed.select("place", "symbol", "total_trades_3d", "dates_used")
