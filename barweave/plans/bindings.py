"""How the provided tables stand in for bars, trades, candidates and ledgers, in Spark and in SQL.

The SQL side of every binding is a chain of common table expressions; `with_tables` puts the ones a
query needs in front of its text.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import MS_PER_DAY, day_of, month_of
from ..operators import bars as bar_ops
from ..operators.accounting import with_returns
from ..sources.candidates import PRE_FILTER_STAGE

HOUR_MS = 3_600_000
FEE = 0.0015
CAPITAL = 10_000.0
LEADERS = ("view", "click")

CTE = {
    "trades": """trades AS (
  SELECT event_id, event_type AS symbol, epoch_us(ts) // 1000 AS trade_time, epoch_us(ts) AS trade_us, value + 1 AS price,
         CAST(1 + user_id % 7 AS DOUBLE) AS quantity, event_id % 2 = 1 AS is_buyer_maker
  FROM events)""",
    "bars": """bars AS (
  SELECT symbol, strftime(make_timestamp(open_time * 1000), '%Y-%m') AS month, open_time,
         open, high, low, close, volume, quote_volume, trades, taker_buy_base_volume
  FROM (SELECT symbol, trade_time - trade_time % 3600000 AS open_time,
               arg_min(price, (trade_us, event_id)) AS open, max(price) AS high, min(price) AS low,
               arg_max(price, (trade_us, event_id)) AS close, sum(quantity) AS volume,
               sum(price * quantity) AS quote_volume, CAST(count(*) AS DOUBLE) AS trades,
               sum(CASE WHEN is_buyer_maker THEN 0.0 ELSE quantity END) AS taker_buy_base_volume
        FROM trades GROUP BY 1, 2))""",
    "cand": """cand AS (
  SELECT l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber || '-' || l_extendedprice AS row_id,
         'S' || l_suppkey AS symbol, epoch_ms(l_shipdate) AS open_time,
         strftime(l_shipdate, '%Y-%m') AS month, strftime(l_shipdate, '%Y-%m-%d') AS trade_day,
         CAST(year(o_orderdate) - 1994 AS INTEGER) AS fold,
         CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS INTEGER) AS label,
         l_quantity / 50 AS probability, 0.1 + 0.8 * (l_quantity / 50) AS calibrated_probability,
         l_extendedprice / 100000 AS trade_score,
         (l_quantity / 50) * 0.08 - 0.03 AS predicted_return, l_tax / 2 AS uncertainty,
         (l_quantity / 50) * 0.02 - (1 - l_quantity / 50) * 0.02 - 0.0015 AS expected_value,
         l_discount - l_tax AS trade_return, l_discount - 0.05 AS forward_return,
         l_discount AS max_future_high_return, -l_tax AS max_future_low_return,
         l_extendedprice AS position_size, l_extendedprice * l_quantity AS quote_volume,
         CAST(l_linenumber AS INTEGER) AS line, o_orderpriority AS priority,
         l_quantity >= 10 AS selected_by_threshold, l_linestatus = 'O' AS selected_by_score_edge,
         l_suppkey % 10 <> 0 AS selected_by_symbol_filter,
         l_quantity >= 10 AND l_linenumber <= 2 AS selected_by_topk,
         l_quantity >= 10 AND l_linenumber <= 2 AND l_linestatus = 'O' AS predicted
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "art": """art AS (
  SELECT CASE WHEN line <= 5 THEN row_id END AS candidate_id, 'walkforward' AS source,
         CASE WHEN line <= 6 THEN 'r' || row_id END AS stable_row_id, symbol, month, open_time,
         'fold_' || fold AS fold_id, open_time // 60000 AS decision_bucket_id, open_time // 60000 AS execution_bucket_id,
         open_time // 604800000 AS period_bucket_id, CAST(line AS BIGINT) AS row_position, label, forward_return,
         trade_return, max_future_high_return, max_future_low_return, quote_volume,
         CASE WHEN label = 1 THEN trade_return END AS actual_exit_return, probability AS raw_probability,
         calibrated_probability, predicted_return AS raw_predicted_return,
         CASE WHEN line <= 4 THEN predicted_return / 2 END AS calibrated_predicted_return, expected_value,
         trade_score AS hybrid_score, CASE WHEN line <= 3 THEN trade_score * 2 END AS final_preselection_score,
         uncertainty, CASE WHEN fold <= 5 THEN 'pre_score_edge_pre_symbol_filter' ELSE 'post_selection' END AS candidate_serialization_stage,
         CAST(selected_by_threshold AS INTEGER) AS selected_by_threshold,
         CAST(selected_by_score_edge AS INTEGER) AS selected_by_score_edge,
         CAST(selected_by_symbol_filter AS INTEGER) AS selected_by_symbol_filter,
         CAST(selected_by_topk AS INTEGER) AS selected_by_topk, CAST(predicted AS INTEGER) AS predicted,
         CAST(selected_by_threshold AND selected_by_score_edge AS INTEGER) AS raw_signal,
         CAST(predicted AS INTEGER) AS executed, position_size, trade_day, 2 AS configured_top_k
  FROM cand)""",
    "ret": """ret AS (
  SELECT *, trade_return AS gross, trade_return - 0.0015 AS net, position_size * (trade_return - 0.0015) AS profit,
         CAST(selected_by_threshold AND selected_by_score_edge AS INTEGER) AS raw_signal, CAST(predicted AS INTEGER) AS executed
  FROM cand)""",
    "docs": """docs AS (
  SELECT l.doc_id, least(n_chars / 20000, 1.0) AS p, sqrt(least(n_chars / 20000, 1.0)) AS p_root, quality AS label,
         quality - 0.5 AS net, toxic / 2 AS predicted_return
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id)""",
}
NEEDS = {"bars": ["trades"], "art": ["cand"], "ret": ["cand"]}


def with_tables(names: str, sql: str, *more: str) -> str:
    """`names` is a blank-separated list of bindings; `more` are further CTE texts."""
    chain: list[str] = []
    for name in names.split():
        for part in [*NEEDS.get(name, []), name]:
            if CTE[part] not in chain:
                chain.append(CTE[part])
    return "WITH RECURSIVE " + ",\n".join([*chain, *more]) + "\n" + sql


def r(sql: str, digits: int = 6) -> str:
    """SQL twin of `functions.scalars.rnd`."""
    return f"floor(({sql}) * {float(10**digits)!r} + 0.5000017) / {float(10**digits)!r}"


class Tables:
    """Lazy views of one scale-factor folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def trades(self) -> DataFrame:
        ts = F.col("ts").cast("timestamp")
        return self.read("events").select(
            "event_id",
            F.col("event_type").alias("symbol"),
            F.unix_millis(ts).alias("trade_time"),
            F.unix_micros(ts).alias("trade_us"),
            (F.col("value") + 1).alias("price"),
            (1 + F.col("user_id") % 7).cast("double").alias("quantity"),
            (F.col("event_id") % 2 == 1).alias("is_buyer_maker"),
        )

    @cached_property
    def bars(self) -> DataFrame:
        return bar_ops.from_trades(self.trades, HOUR_MS, tie=["trade_us", "event_id"])

    @cached_property
    def candidates(self) -> DataFrame:
        items = self.read("lineitem")
        orders = self.read("orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
        p = F.col("l_quantity") / 50
        ship = F.unix_millis(F.col("l_shipdate").cast("timestamp"))
        keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]
        threshold = F.col("l_quantity") >= 10
        top = threshold & (F.col("l_linenumber") <= 2)
        return items.join(orders, items.l_orderkey == orders.o_orderkey).select(
            F.concat_ws("-", *keys).alias("row_id"),
            F.concat(F.lit("S"), "l_suppkey").alias("symbol"),
            ship.alias("open_time"),
            month_of(ship).alias("month"),
            day_of(ship).alias("trade_day"),
            (F.year("o_orderdate") - 1994).alias("fold"),
            F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
            p.alias("probability"),
            (0.1 + 0.8 * p).alias("calibrated_probability"),
            (F.col("l_extendedprice") / 100000).alias("trade_score"),
            (p * 0.08 - 0.03).alias("predicted_return"),
            (F.col("l_tax") / 2).alias("uncertainty"),
            (p * 0.02 - (1 - p) * 0.02 - FEE).alias("expected_value"),
            (F.col("l_discount") - F.col("l_tax")).alias("trade_return"),
            (F.col("l_discount") - 0.05).alias("forward_return"),
            F.col("l_discount").alias("max_future_high_return"),
            (-F.col("l_tax")).alias("max_future_low_return"),
            F.col("l_extendedprice").alias("position_size"),
            (F.col("l_extendedprice") * F.col("l_quantity")).alias("quote_volume"),
            F.col("l_linenumber").cast("int").alias("line"),
            F.col("o_orderpriority").alias("priority"),
            threshold.alias("selected_by_threshold"),
            (F.col("l_linestatus") == "O").alias("selected_by_score_edge"),
            (F.col("l_suppkey") % 10 != 0).alias("selected_by_symbol_filter"),
            top.alias("selected_by_topk"),
            (top & (F.col("l_linestatus") == "O")).alias("predicted"),
        )

    @cached_property
    def artifact(self) -> DataFrame:
        """Candidates in the layout of the candidate artifact."""
        c = self.candidates
        pre = F.when(F.col("fold") <= 5, PRE_FILTER_STAGE).otherwise("post_selection")
        flags = ["selected_by_threshold", "selected_by_score_edge", "selected_by_symbol_filter", "selected_by_topk", "predicted"]
        return c.select(
            F.when(F.col("line") <= 5, F.col("row_id")).alias("candidate_id"),
            F.lit("walkforward").alias("source"),
            F.when(F.col("line") <= 6, F.concat(F.lit("r"), "row_id")).alias("stable_row_id"),
            "symbol", "month", "open_time", F.concat(F.lit("fold_"), "fold").alias("fold_id"),
            (F.col("open_time") / 60000).cast("long").alias("decision_bucket_id"),
            (F.col("open_time") / 60000).cast("long").alias("execution_bucket_id"),
            (F.col("open_time") / (7 * MS_PER_DAY)).cast("long").alias("period_bucket_id"),
            F.col("line").cast("long").alias("row_position"),
            "label", "forward_return", "trade_return", "max_future_high_return", "max_future_low_return", "quote_volume",
            F.when(F.col("label") == 1, F.col("trade_return")).alias("actual_exit_return"),
            F.col("probability").alias("raw_probability"), "calibrated_probability",
            F.col("predicted_return").alias("raw_predicted_return"),
            F.when(F.col("line") <= 4, F.col("predicted_return") / 2).alias("calibrated_predicted_return"),
            "expected_value", F.col("trade_score").alias("hybrid_score"),
            F.when(F.col("line") <= 3, F.col("trade_score") * 2).alias("final_preselection_score"),
            "uncertainty", pre.alias("candidate_serialization_stage"),
            *[F.col(f).cast("int").alias(f) for f in flags],
            (F.col("selected_by_threshold") & F.col("selected_by_score_edge")).cast("int").alias("raw_signal"),
            F.col("predicted").cast("int").alias("executed"),
            "position_size", "trade_day", F.lit(2).alias("configured_top_k"),
        )

    @cached_property
    def returns(self) -> DataFrame:
        """Candidates with gross, net, profit and 0/1 signal flags."""
        c = with_returns(self.candidates)
        raw = F.col("selected_by_threshold") & F.col("selected_by_score_edge")
        return c.withColumn("raw_signal", raw.cast("int")).withColumn("executed", F.col("predicted").cast("int"))

    @cached_property
    def doc_scores(self) -> DataFrame:
        """Labelled documents: length as a probability of quality."""
        docs = self.read("documents").select("doc_id", "n_chars")
        p = F.least(F.col("n_chars") / 20000, F.lit(1.0))
        return self.read("labels").join(docs, "doc_id").select(
            "doc_id", p.alias("p"), F.sqrt(p).alias("p_root"), F.col("quality").alias("label"),
            (F.col("quality") - 0.5).alias("net"), (F.col("toxic") / 2).alias("predicted_return"),
        )
