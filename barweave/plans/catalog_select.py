"""Splits, scores and candidate selection over the candidate binding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import rnd
from ..operators import features, scores, select, splits
from ..session import stored
from ..sources import candidates as arts
from ..sources import samples as sets
from .bindings import r, with_tables
from .catalog_bars import BREADTH_CTE, FEATURE_SQL, LEADER_CTE, LEADER_MAP, MIN_SYMBOLS, STEPS_CTE, clip, gate
from .registry import query

def n_rows():
    return F.count(F.lit(1)).alias("rows")



def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# ---------------------------------------------------------------- splits

PLACES = """places AS (SELECT symbol, month, row_number() OVER (PARTITION BY symbol ORDER BY month) - 1 AS place,
  count(*) OVER (PARTITION BY symbol) AS n FROM (SELECT DISTINCT symbol, month FROM cand))"""
GLOBAL = """indexed AS (SELECT *, dense_rank() OVER (ORDER BY month) - 1 AS month_index, (SELECT count(DISTINCT month) FROM cand) AS n FROM cand)"""
SIZES = """greatest(1, floor(n * 0.15 + 0.5)) AS v, greatest(1, floor(n * 0.15 + 0.5)) AS t"""
SPLIT_OF = "CASE WHEN place < n - v - t THEN 'train' WHEN place < n - t THEN 'validation' ELSE 'test' END"


def split_totals(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys, "split").agg(n_rows(), F.min("month").alias("first_month"), F.max("month").alias("last_month"))


TOTALS = "count(*) AS rows, min(c.month) AS first_month, max(c.month) AS last_month"


@query(
    "p01_ratio_split",
    with_tables(
        "cand",
        f"""SELECT c.symbol, split, {TOTALS} FROM cand c JOIN (SELECT symbol, month, {SPLIT_OF} AS split FROM
          (SELECT symbol, month, place, n, CASE WHEN v + t >= n THEN 1 ELSE v END AS v, CASE WHEN v + t >= n THEN 1 ELSE t END AS t
           FROM (SELECT *, {SIZES} FROM places WHERE n >= 3))) s ON s.symbol = c.symbol AND s.month = c.month GROUP BY 1, 2""",
        PLACES,
    ),
)
def ratio_split(t):
    return split_totals(splits.ratio(t.candidates.select("symbol", "month")), "symbol")


@query(
    "p02_fixed_split",
    with_tables(
        "cand",
        f"""SELECT c.symbol, split, {TOTALS} FROM cand c JOIN (SELECT symbol, month,
          CASE WHEN place < 6 THEN 'train' WHEN place < 7 THEN 'validation' ELSE 'test' END AS split FROM places WHERE n >= 8 AND place < 8) s
          ON s.symbol = c.symbol AND s.month = c.month GROUP BY 1, 2""",
        PLACES,
    ),
)
def fixed_split(t):
    return split_totals(splits.fixed(t.candidates.select("symbol", "month")), "symbol")


@query(
    "p03_month_range",
    with_tables(
        "cand",
        f"""SELECT split, {TOTALS} FROM (SELECT month, {SPLIT_OF} AS split FROM (SELECT month, month_index AS place, n, {SIZES} FROM indexed
        WHERE month_index >= 12 AND month_index < 80)) c GROUP BY 1""",
        GLOBAL,
    ),
)
def month_range(t):
    df = sets.global_month_index(splits.ratio(t.candidates.select("symbol", "month"), per_symbol=False))
    return split_totals(splits.months(df, 12, 80))


T, V, K = 24, 4, 4
FOLDS = f"""folds AS (SELECT i AS fold, (i - 1) * {K} AS s FROM generate_series(1, (SELECT CAST(floor((max(n) - {T + V + K}) / {K}) + 1 AS BIGINT) FROM indexed)) g(i)),
walk AS (SELECT CAST(f.fold AS INTEGER) AS fold, CASE WHEN month_index < s + {T} THEN 'train' WHEN month_index < s + {T + V} THEN 'validation' ELSE 'test' END AS split, c.*
  EXCLUDE (fold) FROM indexed c JOIN folds f ON month_index >= s AND month_index < s + {T + V + K})"""


def walked(t):
    df = sets.global_month_index(t.candidates.select("row_id", "symbol", "month", "open_time"))
    return splits.walk_forward(df, T, V, K)


@query("p04_walk_forward", with_tables("cand", f"SELECT fold, split, {TOTALS} FROM walk c GROUP BY 1, 2", GLOBAL, FOLDS))
def walk_forward(t):
    return split_totals(walked(t), "fold")


@query(
    "p05_embargo",
    with_tables(
        "cand",
        """SELECT fold, split, count_if(early)::BIGINT AS removed_rows, count_if(NOT early)::BIGINT AS kept_rows FROM (
          SELECT fold, split, split <> 'train' AND open_time < min(open_time) OVER (PARTITION BY fold, split) + 4320 * 60000 AS early FROM walk) GROUP BY 1, 2""",
        GLOBAL, FOLDS,
    ),
)
def embargo(t):
    return splits.embargo(walked(t), 4320)[1]


@query(
    "p06_attach_folds",
    with_tables(
        "cand",
        f"""SELECT CAST(coalesce(w.fold, 0) AS INTEGER) AS fold_index, count(*) AS rows, count(DISTINCT c.month) AS months FROM cand c
        LEFT JOIN (SELECT DISTINCT month, fold FROM walk WHERE split = 'test') w ON w.month = c.month GROUP BY 1""",
        GLOBAL, FOLDS,
    ),
)
def attach_folds(t):
    tests = walked(t).filter("split = 'test'").select("month", F.col("fold").alias("fold_index")).distinct()
    joined = splits.attach_folds(t.candidates.select("month"), tests)
    return joined.groupBy("fold_index").agg(n_rows(), F.countDistinct("month").alias("months"))


@query(
    "p07_fold_phases",
    with_tables(
        "cand",
        """SELECT CASE WHEN fold IN (1, 2, 3, 5) THEN 'discovery' WHEN fold = 4 OR fold = 6 THEN 'selection' ELSE 'confirmation' END AS phase,
        count(*) AS rows, count(DISTINCT fold) AS folds FROM cand GROUP BY 1""",
    ),
)
def fold_phases(t):
    phases = splits.phases(t.spark, 7, "1-3,5", "4, 6", "7")
    joined = t.candidates.select("fold").join(F.broadcast(phases), "fold")  # one row per fold
    return joined.groupBy("phase").agg(n_rows(), F.countDistinct("fold").alias("folds"))


@query(
    "p08_capped_rows",
    with_tables(
        "cand",
        """SELECT row_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY open_time, row_id) AS rk,
            count(*) OVER (PARTITION BY label) AS size FROM cand)
          , (SELECT count(*) AS n, least(count_if(label = 1), 5000) AS pos FROM cand)
        WHERE n <= 20000 OR floor(rk * (CASE WHEN label = 1 THEN pos ELSE least(20000 - pos, size) END) / size)
          > floor((rk - 1) * (CASE WHEN label = 1 THEN pos ELSE least(20000 - pos, size) END) / size)""",
    ),
)
def capped_rows(t):
    df = t.candidates.select("row_id", "label", "open_time")
    return splits.cap_rows(df, 20_000, 0.25, ["open_time", "row_id"]).select("row_id", "label")


@query(
    "p09_month_label",
    with_tables("cand", "SELECT symbol, CASE WHEN min(month) = max(month) THEN min(month) ELSE min(month) || '..' || max(month) END AS months FROM cand GROUP BY 1"),
)
def month_label(t):
    return splits.month_label(t.candidates, ["symbol"])


@query(
    "p10_backfill",
    with_tables(
        "cand",
        f"""SELECT CASE WHEN trades = 0 AND split = 'train' AND month_index > last - 2 THEN 'validation' ELSE split END AS split, {TOTALS} FROM base c,
        (SELECT max(CASE WHEN split = 'train' THEN month_index END) AS last, count_if(split = 'validation' AND traded) AS trades FROM base) GROUP BY 1""",
        GLOBAL,
        f"""base AS (SELECT month, month_index, traded, {SPLIT_OF} AS split FROM (SELECT month, month_index, month_index AS place, n,
          predicted AND fold = 1 AS traded, {SIZES} FROM indexed))""",
    ),
)
def backfill(t):
    c = t.candidates.select("symbol", "month", (F.col("predicted") & (F.col("fold") == 1)).alias("traded"))
    df = sets.global_month_index(splits.ratio(c, per_symbol=False))
    return split_totals(splits.backfill(df, 2))


@query(
    "p11_recent_rows",
    with_tables(
        "cand",
        """SELECT row_id, open_time FROM (SELECT row_id, open_time, row_number() OVER (ORDER BY open_time DESC, row_id) AS rk, count(*) OVER () AS n FROM cand)
        WHERE rk <= ceil(n * 0.25)""",
    ),
)
def recent_rows(t):
    return splits.recent(t.candidates.select("row_id", "open_time"), ["open_time", "row_id"], share=0.25)


# ---------------------------------------------------------------- scores

query("v01_expected_value_fixed", with_tables("cand", f"SELECT row_id, {r('probability * 0.05 - (1 - probability) * 0.02 - 0.0015')} AS expected_value FROM cand"))(
    lambda t: t.candidates.select("row_id", rnd(scores.ev_fixed("probability", 0.05, 0.02)).alias("expected_value"))
)

PAYOFF = """pay AS (SELECT fold, count_if(label = 1) AS wins, count_if(label = 0) AS losses, avg(trade_return) FILTER (WHERE label = 1) AS w,
  avg(trade_return) FILTER (WHERE label = 0) AS l FROM cand GROUP BY 1),
pay2 AS (SELECT fold, CASE WHEN wins >= 2500 AND losses >= 2500 THEN w ELSE 0.05 END AS w, CASE WHEN wins >= 2500 AND losses >= 2500 THEN l ELSE -0.02 END AS l,
  CASE WHEN wins >= 2500 AND losses >= 2500 THEN 'empirical_validation' ELSE 'fixed_fallback' END AS src FROM pay)"""


@query(
    "v02_expected_value_empirical",
    with_tables(
        "cand",
        f"""SELECT row_id, src AS payoff_source, {r("calibrated_probability * w + (1 - calibrated_probability) * l - 0.0015")} AS expected_value
        FROM cand JOIN pay2 ON pay2.fold = cand.fold""",
        PAYOFF,
    ),
)
def expected_value_empirical(t):
    c = t.candidates.drop("expected_value")
    pay = scores.payoffs(c, 0.05, 0.02, 2500, ["fold"])
    out = scores.ev_empirical(c, pay, "calibrated_probability", keys=["fold"])
    return out.select("row_id", "payoff_source", rnd("expected_value").alias("expected_value"))


query("v03_expected_value_predicted", with_tables("cand", f"SELECT row_id, {r('predicted_return - 0.0015')} AS expected_value FROM cand"))(
    lambda t: t.candidates.select("row_id", rnd(scores.ev_predicted("predicted_return")).alias("expected_value"))
)


@query(
    "v04_hybrid_score",
    with_tables(
        "cand",
        f"""SELECT row_id, {r("calibrated_probability * predicted_return - 0.0015")} AS product_score,
        calibrated_probability >= 0.5 AS passed, CASE WHEN calibrated_probability >= 0.5 THEN {r("predicted_return - 0.0015")} END AS return_score,
        {r("calibrated_probability * win + (1 - calibrated_probability) * loss - 0.0015")} AS payoff_score
        FROM cand, (SELECT avg(trade_return) FILTER (WHERE label = 1) AS win, avg(trade_return) FILTER (WHERE label = 0) AS loss FROM cand)""",
    ),
)
def hybrid_score(t):
    product = scores.hybrid("probability_times_return", "calibrated_probability", "predicted_return")
    gated = scores.hybrid("expected_return", "calibrated_probability", "predicted_return", min_p=0.5)
    passed = gated != float("-inf")
    paid = scores.hybrid("conditional_payoff", "calibrated_probability", "predicted_return", win="win_return", loss="loss_return")
    both = t.candidates.crossJoin(F.broadcast(scores.payoffs(t.candidates, 0.02, 0.02)))  # one row
    return both.select(
        "row_id", rnd(product).alias("product_score"), passed.alias("passed"), F.when(passed, rnd(gated)).alias("return_score"), rnd(paid).alias("payoff_score")
    )


query("v05_risk_adjusted", with_tables("cand", f"SELECT row_id, {r('expected_value - 0.5 * uncertainty')} AS score FROM cand"))(
    lambda t: t.candidates.select("row_id", rnd(scores.risk_adjust("expected_value", "uncertainty", 0.5)).alias("score"))
)


@query(
    "v06_relative_penalty",
    with_tables(
        "cand",
        f"""SELECT row_id, {r("expected_value - 0.5 * uncertainty * scale")} AS score FROM cand,
        (SELECT avg(abs(trade_return)) / stddev_pop(trade_return) AS scale FROM cand)""",
    ),
)
def relative_penalty(t):
    c = t.candidates
    context = c.agg(F.avg(F.abs("trade_return")).alias("typical"), F.stddev_pop("trade_return").alias("spread"))
    joined = c.crossJoin(F.broadcast(context))  # one row
    score = scores.risk_adjust_relative("expected_value", "uncertainty", 0.5, "typical", "spread")
    return joined.select("row_id", rnd(score).alias("score"))


VOL60 = FEATURE_SQL["f08_volatility"]["rolling_volatility_60m"]


@query(
    "v07_dynamic_floor",
    with_tables(
        "bars",
        """SELECT s.symbol, s.open_time, greatest(CASE WHEN lr >= 0.01 THEN 0.001 WHEN lr <= -0.01 THEN 0.0025 ELSE 0.0015 END,
          CASE WHEN vol >= 0.5 THEN 0.0025 ELSE 0.001 END)::DOUBLE AS score_floor,
        CASE WHEN lr >= 0.01 THEN 'bullish' WHEN lr <= -0.01 THEN 'bearish' ELSE 'neutral' END
          || CASE WHEN vol >= 0.5 THEN '_high_volatility' ELSE '_normal_volatility' END AS regime FROM vols s""",
        STEPS_CTE, LEADER_CTE,
        f"""vols AS (SELECT s.symbol, s.open_time, s.vol, coalesce(b.return_60m, 0.0) AS lr FROM (SELECT symbol, month, open_time, {VOL60} AS vol FROM steps) s
          LEFT JOIN leaders b ON b.symbol = '{LEADER_MAP["btc"]}' AND b.month = s.month AND b.open_time = s.open_time)""",
    ),
)
def dynamic_floor(t):
    df = features.regime(features.base(t.bars), t.bars, LEADER_MAP)
    out = scores.dynamic_floor(df, "btc_return_60m", "rolling_volatility_60m", high_volatility=0.5)
    return out.select("symbol", "open_time", "score_floor", "regime")


@query(
    "v08_upper_cap",
    with_tables(
        "cand",
        f"""SELECT row_id, {r("cap")} AS upper_cap, trade_score > cap AS capped FROM cand, (SELECT quantile_cont(trade_score, 0.9) AS cap FROM cand)""",
    ),
)
def upper_cap(t):
    return scores.upper_cap(t.candidates, "trade_score", 0.9).select("row_id", rnd("upper_cap").alias("upper_cap"), "capped")


@query(
    "v09_win_loss_gap",
    with_tables(
        "cand",
        f"""SELECT fold, {r("avg(trade_score) FILTER (WHERE trade_return - 0.0015 > 0)")} AS winner_score,
        {r("avg(trade_score) FILTER (WHERE trade_return - 0.0015 <= 0)")} AS loser_score,
        {r("avg(trade_score) FILTER (WHERE trade_return - 0.0015 > 0) - avg(trade_score) FILTER (WHERE trade_return - 0.0015 <= 0)")} AS score_gap
        FROM cand GROUP BY 1""",
    ),
)
def win_loss_gap(t):
    out = scores.win_loss_gap(t.candidates, ["fold"], "trade_score", F.col("trade_return") - 0.0015)
    return out.select("fold", *[rnd(c).alias(c) for c in ("winner_score", "loser_score", "score_gap")])


# ---------------------------------------------------------------- selection

ORDER_SQL = "trade_score DESC, symbol, row_id"
BUCKET = ["open_time"]


def ordered(df):
    return select.score_order(df, "trade_score")


query("k01_signals", with_tables("cand", "SELECT row_id FROM cand WHERE trade_score >= 0.5"))(
    lambda t: select.signals(t.candidates, "trade_score", 0.5).select("row_id")
)
query(
    "k02_bucket_order",
    with_tables(
        "cand",
        f"""SELECT row_id, open_time, row_number() OVER (PARTITION BY open_time ORDER BY {ORDER_SQL}) AS place,
        count(*) OVER (PARTITION BY open_time) AS bucket_rows FROM cand""",
    ),
)(
    lambda t: select.rank_in_bucket(
        t.candidates.select("row_id", "symbol", "open_time", "trade_score"), BUCKET, ordered(t.candidates), "place", "bucket_rows"
    ).select("row_id", "open_time", "place", "bucket_rows")
)
query(
    "k03_topk",
    with_tables(
        "cand",
        f"SELECT row_id, CAST(rk AS INTEGER) AS rank_in_bucket FROM (SELECT row_id, row_number() OVER (PARTITION BY open_time ORDER BY {ORDER_SQL}) AS rk FROM cand) WHERE rk <= 3",
    ),
)(lambda t: select.topk(t.candidates, 3, BUCKET, ordered(t.candidates)).select("row_id", "rank_in_bucket"))

MINE = f"mine AS (SELECT *, row_number() OVER (PARTITION BY open_time, symbol ORDER BY {ORDER_SQL}) AS mine FROM cand)"
query(
    "k04_topk_symbol_cap",
    with_tables(
        "cand",
        f"""SELECT row_id, CAST(rk AS INTEGER) AS rank_in_bucket FROM (SELECT row_id, row_number() OVER (PARTITION BY open_time ORDER BY {ORDER_SQL}) AS rk
        FROM mine WHERE mine <= 1) WHERE rk <= 3""",
        MINE,
    ),
)(lambda t: select.topk(t.candidates, 3, BUCKET, ordered(t.candidates), per_symbol=1).select("row_id", "rank_in_bucket"))
query(
    "k05_unique_first",
    with_tables(
        "cand",
        f"""SELECT row_id, CAST(rk AS INTEGER) AS rank_in_bucket FROM (SELECT row_id, row_number() OVER (PARTITION BY open_time ORDER BY mine, {ORDER_SQL}) AS rk
        FROM mine) WHERE rk <= 25""",
        MINE,
    ),
)(lambda t: select.topk(t.candidates, 25, BUCKET, ordered(t.candidates), unique_first=True).select("row_id", "rank_in_bucket"))
query(
    "k06_top_percent",
    with_tables(
        "cand",
        f"""SELECT row_id, rk AS rank_in_bucket FROM (SELECT row_id, row_number() OVER (PARTITION BY open_time ORDER BY {ORDER_SQL}) AS rk,
        count(*) OVER (PARTITION BY open_time) AS n FROM cand) WHERE rk <= ceil(n * 0.1)""",
    ),
)(
    lambda t: select.top_percent(
        t.candidates.select("row_id", "symbol", "open_time", "trade_score"), 0.1, BUCKET, ordered(t.candidates)
    ).select("row_id", "rank_in_bucket")
)


@query(
    "k07_top_utility",
    with_tables(
        "art",
        """SELECT candidate_id, CAST(rk AS INTEGER) AS rank_in_bucket FROM (SELECT candidate_id,
        row_number() OVER (PARTITION BY open_time ORDER BY calibrated_predicted_return DESC, hybrid_score DESC, symbol, stable_row_id) AS rk FROM art
        WHERE calibrated_predicted_return > 0.005) WHERE rk <= 2""",
    ),
)
def top_utility(t):
    df = t.artifact.withColumn("row_id", F.col("stable_row_id"))
    return select.top_utility(df, "calibrated_predicted_return", 0.005, 2, BUCKET).select("candidate_id", "rank_in_bucket")


@query(
    "k08_market_filter",
    with_tables(
        "bars",
        f"""SELECT mode, count(*) AS rows, count_if(NOT passed)::BIGINT AS blocked FROM (
          SELECT 'market_positive' AS mode, a > 0 AS passed FROM ctx UNION ALL SELECT 'btc_or_market_positive', a > 0 OR lr > 0 FROM ctx
          UNION ALL SELECT 'breadth', up >= 0.5 FROM ctx) GROUP BY 1""",
        STEPS_CTE, LEADER_CTE, BREADTH_CTE,
        f"""ctx AS (SELECT {gate(clip("a60", -1, 1))} AS a, {gate("up60")} AS up, coalesce(b.return_240m, 0.0) AS lr FROM steps s
          JOIN market m ON m.month = s.month AND m.open_time = s.open_time
          LEFT JOIN leaders b ON b.symbol = '{LEADER_MAP["btc"]}' AND b.month = s.month AND b.open_time = s.open_time)""",
    ),
)
def market_filter(t):
    df = features.regime(features.breadth(features.base(t.bars), MIN_SYMBOLS), t.bars, LEADER_MAP)
    parts = [
        select.market_filter(df, m).select(F.lit(m).alias("mode"), "market_blocked")
        for m in ("market_positive", "btc_or_market_positive", "breadth")
    ]
    return union(parts).groupBy("mode").agg(n_rows(), F.count_if("market_blocked").alias("blocked"))


SYMBOL_CTE = """val AS (SELECT symbol, trade_day, trade_return - 0.0015 AS net, predicted AS ex FROM cand WHERE fold <= 5),
sym AS (SELECT symbol, count(*) AS n, count_if(ex) AS e, avg(net) AS cq, avg(net) FILTER (WHERE ex) AS eq, count(DISTINCT CASE WHEN ex THEN trade_day END) AS days FROM val GROUP BY 1),
scored AS (SELECT symbol, n, e, days, cq, eq, e / total AS share, (n * (0.5 * cq + 0.5 * coalesce(eq, cq)) + 50 * g) / (n + 50) AS score
  FROM sym, (SELECT avg(net) AS g, count_if(ex) AS total FROM val)),
reasons AS (SELECT *, CASE WHEN n < 300 THEN 'too_few_rows' WHEN share > 0.011 AND days < 55 THEN 'dominance_support_floor' WHEN score <= 0 THEN 'negative_score' ELSE '' END AS reason FROM scored)"""


def filtered_symbols(t):
    validation = t.candidates.filter("fold <= 5")
    s = select.symbol_scores(validation, F.col("trade_return") - 0.0015, F.col("predicted"), shrink=50)
    return select.symbol_filter(s, 300, 0.0, 0.011, 55)


query(
    "k09_symbol_filter",
    with_tables(
        "cand",
        "SELECT c.symbol, count(*) AS rows FROM cand c JOIN reasons s ON s.symbol = c.symbol AND s.reason = '' WHERE fold > 5 GROUP BY 1",
        SYMBOL_CTE,
    ),
)(lambda t: select.keep_symbols(t.candidates.filter("fold > 5"), filtered_symbols(t)).groupBy("symbol").agg(n_rows()))
query(
    "k10_shrunk_symbol_score",
    with_tables(
        "cand",
        f"SELECT symbol, n AS candidates, e::BIGINT AS executed, {r('cq')} AS candidate_quality, {r('eq')} AS executed_quality, {r('score')} AS symbol_score FROM scored",
        SYMBOL_CTE,
    ),
)(
    lambda t: filtered_symbols(t).select(
        "symbol", "candidates", "executed", *[rnd(c).alias(c) for c in ("candidate_quality", "executed_quality", "symbol_score")]
    )
)
query(
    "k11_dominance_floor",
    with_tables("cand", f"SELECT symbol, {r('share')} AS executed_share, days AS active_days, reason FROM reasons", SYMBOL_CTE),
)(lambda t: filtered_symbols(t).select("symbol", rnd("executed_share").alias("executed_share"), "active_days", "reason"))


@query(
    "k12_dominance_penalty",
    with_tables(
        "cand",
        f"""SELECT row_id, {r("trade_score - 0.8 * greatest(0.0, coalesce(share, 0.0) - 0.009)")} AS penalised_score FROM cand c LEFT JOIN
        (SELECT symbol, count(*) / (SELECT count(*) FROM cand WHERE fold <= 5) AS share FROM cand WHERE fold <= 5 GROUP BY 1) s ON s.symbol = c.symbol""",
    ),
)
def dominance_penalty(t):
    c = t.candidates
    out = select.dominance_penalty(c, c.filter("fold <= 5"), "trade_score", 0.8, 0.009)
    return out.select("row_id", rnd("penalised_score").alias("penalised_score"))


FIRST = "row_number() OVER (PARTITION BY {keys} ORDER BY open_time, row_id) AS rk"


@query(
    "k13_first_entries",
    with_tables(
        "cand",
        f"""SELECT kind, row_id FROM (SELECT 'day' AS kind, row_id, {FIRST.format(keys="trade_day")} FROM cand
        UNION ALL SELECT 'fold', row_id, {FIRST.format(keys="fold")} FROM cand
        UNION ALL SELECT 'symbol_period', row_id, {FIRST.format(keys="symbol, open_time // 2592000000")} FROM cand) WHERE rk <= 2""",
    ),
)
def first_entries(t):
    c = t.candidates.select("row_id", "symbol", "trade_day", "fold", "open_time").withColumn("period", select.period(43_200))
    keys = {"day": ["trade_day"], "fold": ["fold"], "symbol_period": ["symbol", "period"]}
    return union([select.first_n(c, k, 2).select(F.lit(kind).alias("kind"), "row_id") for kind, k in keys.items()])


@query(
    "k14_streak_cap",
    with_tables(
        "cand",
        """SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY g, a - b ORDER BY a) AS place FROM (
          SELECT row_id, priority AS g, row_number() OVER (ORDER BY open_time, row_id) AS a, row_number() OVER (PARTITION BY priority ORDER BY open_time, row_id) AS b FROM cand))
        WHERE place <= 2""",
    ),
)
def streak_cap(t):
    # Order priorities stand in for symbols: five values, so that runs do occur.
    c = t.candidates.select("row_id", F.col("priority").alias("symbol"), "open_time")
    return select.streak_cap(c, 2).select("row_id")


@query(
    "k15_cooldown",
    with_tables(
        "cand",
        """SELECT f.fold, f.symbol, f.row_id FROM acc JOIN firsts f ON f.fold = acc.fold AND f.symbol = acc.symbol AND f.minute = acc.minute""",
        "firsts AS (SELECT fold, symbol, open_time // 60000 AS minute, arg_min(row_id, (open_time, row_id)) AS row_id FROM cand GROUP BY 1, 2, 3)",
        """acc AS (SELECT fold, symbol, min(minute) AS minute FROM firsts GROUP BY 1, 2 UNION ALL
          SELECT a.fold, a.symbol, min(f.minute) FROM acc a JOIN firsts f ON f.fold = a.fold AND f.symbol = a.symbol AND f.minute >= a.minute + 14400
          GROUP BY a.fold, a.symbol, a.minute)""",
    ),
)
def cooldown(t):
    c = t.candidates.select("fold", "symbol", "open_time", "row_id")
    return select.cooldown(c, 14_400).select("fold", "symbol", "row_id")


def z_sql(c: str) -> str:
    over = "OVER (PARTITION BY open_time)"
    return f"(CASE WHEN stddev_pop({c}) {over} > 1e-12 THEN ({c} - avg({c}) {over}) / stddev_pop({c}) {over} ELSE 0.0 END)"


query("k16_bucket_zscore", with_tables("cand", f"SELECT row_id, {r(z_sql('trade_score'))} AS z FROM cand"))(
    lambda t: select.zscore(t.candidates.select("row_id", "open_time", "trade_score"), {"trade_score": "z"}, BUCKET).select("row_id", rnd("z").alias("z"))
)
query(
    "k17_bucket_percent_rank",
    with_tables(
        "cand",
        f"""SELECT row_id, {r("(rank() OVER (PARTITION BY open_time ORDER BY probability) - 1 + (count(*) OVER (PARTITION BY open_time, probability) - 1) / 2) / greatest(count(*) OVER (PARTITION BY open_time) - 1, 1)")} AS share FROM cand""",
    ),
)(
    lambda t: select.pct_rank(t.candidates.select("row_id", "open_time", "probability"), "probability", "share", BUCKET).select(
        "row_id", rnd("share").alias("share")
    )
)


@query(
    "k18_blended_score",
    with_tables(
        "cand",
        f"""SELECT row_id, {r(f"0.35 * {z_sql('calibrated_probability')} + 0.25 * {z_sql('predicted_return')} + 0.25 * {z_sql('trade_score')} + 0.15 * {z_sql('expected_value')}")} AS blended_score FROM cand""",
    ),
)
def blended_score(t):
    c = t.candidates.select(
        "row_id", "open_time", "calibrated_probability", "expected_value",
        F.col("predicted_return").alias("calibrated_predicted_return"), F.col("trade_score").alias("predicted_net_return"),
    )
    return select.blend(c, BUCKET).select("row_id", rnd("blended_score").alias("blended_score"))


POOLS = {"both": (True, True), "no_edge": (False, True), "no_symbol": (True, False), "none": (False, False)}


def _pool_sql(edge: bool, sym: bool) -> str:
    cond = "selected_by_threshold = 1"
    cond += " AND selected_by_score_edge = 1" if edge else ""
    return cond + (" AND selected_by_symbol_filter = 1" if sym else "")


@query(
    "k19_candidate_pool",
    with_tables(
        "art",
        " UNION ALL ".join(
            f"SELECT '{n}' AS filters, count(*) AS rows, {r('sum(position_size)', 2)} AS size FROM art WHERE {_pool_sql(*p)}" for n, p in POOLS.items()
        )
        + f" UNION ALL SELECT 'raw', count(*), {r('sum(position_size)', 2)} FROM art WHERE fold_id IN ('fold_6', 'fold_7') AND raw_signal = 1",
    ),
)
def candidate_pool(t):
    flags = ["candidate_serialization_stage", "raw_signal", "selected_by_threshold", "selected_by_score_edge", "selected_by_symbol_filter", "predicted", "selected_by_topk"]
    a = stored(t.artifact.select("fold_id", "position_size", *flags))  # read by every pool
    parts = [select.pool(a, *p).select(F.lit(n).alias("filters"), "position_size") for n, p in POOLS.items()]
    later = a.filter(F.col("fold_id").isin("fold_6", "fold_7"))  # these folds hold no pre-filter rows
    parts.append(select.pool(later).select(F.lit("raw").alias("filters"), "position_size"))
    return union(parts).groupBy("filters").agg(n_rows(), rnd(F.sum("position_size"), 2).alias("size"))


@query(
    "k20_baselines",
    with_tables(
        "art",
        """SELECT 'selected' AS kind, count(*) AS rows FROM art WHERE selected_by_topk = 1
        UNION ALL SELECT 'executed', count(*) FROM art WHERE predicted = 1
        UNION ALL SELECT 'executed_without_flag', count(*) FROM art WHERE selected_by_topk = 1 AND predicted = 0""",
    ),
)
def baselines(t):
    a = t.artifact
    none = a.filter("predicted = 0")
    parts = [("selected", select.baseline_selected(a)), ("executed", select.baseline_executed(a)), ("executed_without_flag", select.baseline_executed(none))]
    return union([d.select(F.lit(n).alias("kind")) for n, d in parts]).groupBy("kind").agg(n_rows())


query(
    "k21_best_per_day",
    with_tables("cand", "SELECT trade_day, symbol, row_id FROM cand QUALIFY row_number() OVER (PARTITION BY trade_day, symbol ORDER BY trade_score DESC, open_time, row_id) = 1"),
)(lambda t: select.best_per_day(t.candidates).select("trade_day", "symbol", "row_id"))
query(
    "k22_share_cap",
    with_tables(
        "cand",
        """SELECT symbol, row_id FROM (SELECT symbol, row_id, row_number() OVER (PARTITION BY symbol ORDER BY open_time, row_id) AS rk, count(*) OVER () AS n FROM cand)
        WHERE rk <= greatest(1, floor(n * 0.005))""",
    ),
)(lambda t: select.share_cap(t.candidates.select("symbol", "row_id", "open_time"), 0.005).select("symbol", "row_id"))

def sequential_cte(name: str, pool: str, score: str, strength: float, k: int, cap: float = 0.0, warmup: int = 50) -> str:
    """Picks under the exposure penalty, one bucket after the other: a recursion that carries the picks of each symbol."""
    over = f"AND NOT (total + len(acc) >= {warmup} AND (coalesce(picks[x[1].s], 0) + 1) / (total + len(acc) + 1) > {cap})" if cap else ""
    return f"""{name}_scale AS (SELECT greatest(stddev_pop(trade_score), (quantile_cont(trade_score, 0.75) - quantile_cont(trade_score, 0.25)) / 1.349,
  abs(quantile_cont(trade_score, 0.5)) * 0.25, 1e-6) * {strength} AS penalty FROM {pool}),
{name}_b AS MATERIALIZED (SELECT dense_rank() OVER (ORDER BY open_time) AS b, open_time, {score} AS v, trade_score AS t, symbol AS s, row_id AS i FROM {pool}),
{name}_run AS (SELECT 0::BIGINT AS b, 0::BIGINT AS open_time, MAP([]::VARCHAR[], []::BIGINT[]) AS picks, 0::BIGINT AS total,
    []::STRUCT(a DOUBLE, t DOUBLE, s VARCHAR, i VARCHAR)[] AS chosen
  UNION ALL SELECT b, open_time, map_concat(picks, map_from_entries(list_transform(chosen, lambda x: {{'k': x.s, 'v': coalesce(picks[x.s], 0) + 1}}))), total + len(chosen), chosen
  FROM (SELECT b, open_time, picks, total, list_reduce(list_transform(list_sort(list_transform(entries, lambda x:
        {{'a': -(x.v - penalty * (CASE WHEN total > 0 THEN coalesce(picks[x.s], 0) / total ELSE 0.0 END)), 't': -x.t, 's': x.s, 'i': x.i}})), lambda x: [x]),
      lambda acc, x: CASE WHEN len(acc) < {k} AND NOT list_contains(list_transform(acc, lambda y: y.s), x[1].s) {over} THEN list_concat(acc, x) ELSE acc END,
      []::STRUCT(a DOUBLE, t DOUBLE, s VARCHAR, i VARCHAR)[]) AS chosen
    FROM (SELECT n.b, any_value(n.open_time) AS open_time, list({{'v': n.v, 't': n.t, 's': n.s, 'i': n.i}}) AS entries, any_value(r.picks) AS picks, any_value(r.total) AS total,
        any_value(penalty) AS penalty FROM {name}_run r JOIN {name}_b n ON n.b = r.b + 1, {name}_scale GROUP BY n.b))),
{name}_keys AS (SELECT open_time, unnest(chosen) AS c, unnest(range(1, len(chosen) + 1)) AS rank_in_bucket FROM {name}_run)"""


@query(
    "k23_exposure_penalty",
    with_tables(
        "cand",
        f"""SELECT c.i AS row_id, CAST(rank_in_bucket AS INTEGER) AS rank_in_bucket, {r("-c.a")} AS penalised_score FROM pen_keys""",
        sequential_cte("pen", "cand", "trade_score", 0.75, 3),
    ),
)
def exposure_penalty(t):
    c = stored(t.candidates.select("row_id", "symbol", "open_time", "trade_score"))
    out = select.exposure_penalty(c, "trade_score", 0.75, 3)
    return out.select("row_id", "rank_in_bucket", rnd("penalised_score").alias("penalised_score"))


@query(
    "k24_filled_sizes",
    with_tables(
        "art",
        f"""SELECT fold_id, CAST(row_position = 7 AS INTEGER) AS size_filled, count(*) AS rows, {r("avg(CASE WHEN row_position = 7 THEN med ELSE position_size END)", 3)} AS mean_size
        FROM art JOIN (SELECT fold_id AS f, quantile_cont(position_size, 0.5) AS med FROM art WHERE selected_by_topk = 1 GROUP BY 1) ON f = fold_id GROUP BY 1, 2""",
    ),
)
def filled_sizes(t):
    a = t.artifact.select("source", "fold_id", "position_size", "selected_by_topk", "row_position")
    rows = a.withColumn("position_size", F.when(F.col("row_position") != 7, F.col("position_size")))
    out = select.fill_sizes(a, rows)
    return out.groupBy("fold_id", "size_filled").agg(n_rows(), rnd(F.avg("position_size"), 3).alias("mean_size"))


K25_SCOPES = {"decision": "decision_bucket_id", "execution": "execution_bucket_id", "period": "period_bucket_id"}
K25_ID = "CASE WHEN candidate_id IS NOT NULL THEN 'candidate:' || candidate_id WHEN stable_row_id IS NOT NULL THEN 'stable:' || stable_row_id ELSE source || ':' || fold_id || ':' || row_position END"
K25_RANKS = ", ".join(
    f"rank() OVER (PARTITION BY {c} ORDER BY hybrid_score DESC, symbol, row_id) AS rank_within_{k}_bucket, count(*) OVER (PARTITION BY {c}) AS candidate_count_within_{k}_bucket" for k, c in K25_SCOPES.items()
)


@query(
    "k25_annotations",
    with_tables(
        "art",
        f"""SELECT row_id, {K25_RANKS},
        CASE WHEN selected_by_threshold = 0 THEN 'threshold' WHEN selected_by_score_edge = 0 THEN 'score_edge' WHEN selected_by_symbol_filter = 0 THEN 'symbol_filter'
          WHEN selected_by_topk = 0 THEN 'ranking' WHEN executed = 0 THEN 'execution' ELSE '' END AS rejection_stage FROM (SELECT *, {K25_ID} AS row_id FROM art)""",
    ),
)
def annotations(t):
    a = t.artifact.withColumn("row_id", arts.row_id(t.artifact))
    flags = ["selected_by_threshold", "selected_by_score_edge", "selected_by_symbol_filter", "selected_by_topk", "executed", "configured_top_k"]
    narrow = a.select("row_id", "symbol", "hybrid_score", *K25_SCOPES.values(), *[c for c in flags if c in a.columns])
    out = select.annotate(narrow, "hybrid_score", K25_SCOPES)
    kinds = [f"{x}_within_{k}_bucket" for k in K25_SCOPES for x in ("rank", "candidate_count")]
    return out.select("row_id", *kinds, "rejection_stage")


query("k26_position_size", with_tables("cand", f"SELECT row_id, {r('least(1000.0, quote_volume * 0.01)', 3)} AS size FROM cand"))(
    lambda t: t.candidates.select("row_id", rnd(select.position_size(), 3).alias("size"))
)
