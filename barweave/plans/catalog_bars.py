"""Base, leader and breadth features, outcomes and exits over hourly bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import rnd
from ..operators import exits, features, labels, select
from .bindings import LEADERS, r, with_tables
from .registry import query

WINDOW = 5
LEADER_MAP = {"btc": LEADERS[0], "eth": LEADERS[1]}


def clip(x: str, lo, hi) -> str:
    return f"(CASE WHEN ({x}) IS NOT NULL THEN greatest({float(lo)}, least({float(hi)}, {x})) END)"


def ratio(n: str, d: str) -> str:
    return f"(CASE WHEN ({d}) = 0 THEN 0.0 ELSE ({n}) / ({d}) END)"


STEPS_CTE = f"""steps AS (
  SELECT *, row_number() OVER w AS rn, {clip(ratio("taker_buy_base_volume", "volume"), 0, 1)} AS tb,
         close / lag(close) OVER w - 1 AS step,
         {ratio("volume", "lag(volume) OVER w + 1e-12")} - 1 AS dv, {ratio("trades", "lag(trades) OVER w + 1e-12")} - 1 AS dn
  FROM bars WINDOW w AS (PARTITION BY symbol, month ORDER BY open_time))"""
W = "PARTITION BY symbol, month ORDER BY open_time"
PAST = f"({W} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)"
RECENT = f"({W} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"
UPTO = f"({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def ret(k: int) -> str:
    return f"coalesce({clip(f'close / lag(close, {k}) OVER ({W}) - 1', -1, 1)}, 0.0)"


def mean(c: str, frame: str = PAST) -> str:
    return f"coalesce(avg({c}) OVER {frame}, 0.0)"


def sd(c: str, frame: str = PAST) -> str:
    s = f"stddev_pop({c}) OVER {frame}"
    return f"(CASE WHEN {s} IS NULL OR {s} < 1e-12 THEN 1.0 ELSE {s} END)"


def zscore(c: str, frame: str = PAST) -> str:
    return clip(f"({c} - {mean(c, frame)}) / {sd(c, frame)}", -20, 20)


def run(green: bool) -> str:
    other = "close < open" if green else "close >= open"
    return f"CAST(rn - coalesce(max(CASE WHEN {other} THEN rn END) OVER {UPTO}, 0) AS DOUBLE)"


SPAN = "greatest(0.0, high - low)"
FEATURE_SQL = {
    "f01_short_returns": {f"ret_{k}m": ret(k) for k in (1, 3, 5)},
    "f02_long_returns": {f"ret_{k}m": ret(k) for k in (10, 15, 30, 60)},
    "f03_range": {"range_pct": clip(ratio("high - low", "close"), 0, 2)},
    "f04_candle_return": {"candle_return": clip(ratio("close - open", "open"), -1, 1)},
    "f05_logs": {
        "log_volume": "ln(1 + greatest(0.0, volume))",
        "log_quote_volume": "ln(1 + greatest(0.0, quote_volume))",
        "log_trades": "ln(1 + greatest(0.0, trades))",
    },
    "f06_taker_ratio": {
        "taker_buy_ratio": "tb",
        "taker_buy_ratio_change": f"coalesce({clip(f'tb - lag(tb) OVER ({W})', -1, 1)}, 0.0)",
        "taker_buy_imbalance": clip("2 * tb - 1", -1, 1),
    },
    "f07_volume_change": {"volume_change": f"coalesce({clip('dv', -10, 10)}, 0.0)"},
    "f08_volatility": {
        "rolling_volatility_60m": f"CASE WHEN rn > 60 THEN {clip(f'stddev_pop(step) OVER {RECENT}', 0, 1)} ELSE 0.0 END"
    },
    "f09_volume_mean": {"rolling_volume_mean_60m": f"ln(1 + {mean('volume')})"},
    "f10_zscores": {
        "rolling_volume_zscore_60m": zscore("volume"),
        "rolling_trade_count_zscore_60m": zscore("trades"),
    },
    "f11_relative_volume": {"relative_volume_previous_hour": clip(ratio("volume", f"{mean('volume')} + 1e-12"), 0, 50)},
    "f12_recent_extremes": {
        "distance_from_recent_high_60m": clip(f"close / max(high) OVER {RECENT} - 1", -1, 1),
        "distance_from_recent_low_60m": clip(f"close / min(low) OVER {RECENT} - 1", -1, 1),
    },
    "f13_candle_runs": {"consecutive_green_candles": run(True), "consecutive_red_candles": run(False)},
    "f14_accelerations": {
        "volume_acceleration": f"coalesce({clip(f'dv - lag(dv) OVER ({W})', -20, 20)}, 0.0)",
        "trade_count_acceleration": f"coalesce({clip(f'dn - lag(dn) OVER ({W})', -20, 20)}, 0.0)",
    },
    "f15_candle_shape": {
        "candle_body_range_ratio": clip(ratio("abs(close - open)", SPAN), 0, 1),
        "upper_wick_pct": clip(ratio("greatest(0.0, high - greatest(open, close))", SPAN), 0, 1),
        "lower_wick_pct": clip(ratio("greatest(0.0, least(open, close) - low)", SPAN), 0, 1),
    },
    "f16_day_extremes": {
        "distance_from_high_24h": clip(f"close / max(high) OVER ({W} ROWS BETWEEN 1439 PRECEDING AND CURRENT ROW) - 1", -1, 1),
        "distance_from_low_24h": clip(f"close / min(low) OVER ({W} ROWS BETWEEN 1439 PRECEDING AND CURRENT ROW) - 1", -1, 1),
    },
    "f17_quote_volume": {
        "rolling_quote_volume_mean_60m": f"ln(1 + {mean('quote_volume')})",
        "rolling_quote_volume_zscore_60m": zscore("quote_volume"),
        "relative_quote_volume_previous_hour": clip(ratio("quote_volume", f"{mean('quote_volume')} + 1e-12"), 0, 50),
    },
    "f18_taker_history": {
        "taker_buy_ratio_mean_60m": clip(mean("tb"), 0, 1),
        "taker_buy_ratio_zscore_60m": zscore("tb"),
    },
}


def _register_features() -> None:
    for name, columns in FEATURE_SQL.items():
        body = ", ".join(f"{r(sql)} AS {col}" for col, sql in columns.items())
        wanted = list(columns)

        def run_one(t, wanted=wanted):
            return features.base(t.bars).select("symbol", "open_time", *[rnd(c).alias(c) for c in wanted])

        query(name, with_tables("bars", f"SELECT symbol, open_time, {body} FROM steps", STEPS_CTE))(run_one)


_register_features()

# The day extremes again with a 24-row window, so that blocks are crossed many times.
query(
    "f16_block_extremes",
    with_tables(
        "bars",
        f"""SELECT symbol, open_time,
        {r(clip(f"close / max(high) OVER ({W} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) - 1", -1, 1))} AS distance_from_high_24h,
        {r(clip(f"close / min(low) OVER ({W} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) - 1", -1, 1))} AS distance_from_low_24h FROM bars""",
    ),
)(
    lambda t: features.base(t.bars, day_rows=24).select(
        "symbol", "open_time", rnd("distance_from_high_24h").alias("distance_from_high_24h"),
        rnd("distance_from_low_24h").alias("distance_from_low_24h"),
    )
)


@query(
    "f19_eligible_rows",
    with_tables(
        "bars",
        f"""SELECT symbol, open_time FROM (SELECT symbol, open_time, row_number() OVER ({W}) AS rn,
        count(*) OVER (PARTITION BY symbol, month) AS n FROM bars) WHERE rn > 60 AND rn + {WINDOW} <= n""",
    ),
)
def eligible_rows(t):
    df = features.with_eligibility(features.base(t.bars), WINDOW)
    return df.filter("eligible").select("symbol", "open_time")


def _leader_sql() -> str:
    measures = {f"return_{k}m": ret(k) for k in (5, 15, 60, 240, 1440)}
    for k in (60, 240):
        frame = f"({W} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
        measures[f"volatility_{k}m"] = f"CASE WHEN rn > {k} THEN {clip(f'stddev_pop(step) OVER {frame}', 0, 1)} ELSE 0.0 END"
    for k in (60, 1440):
        measures[f"volume_zscore_{k}m"] = zscore("volume", f"({W} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)")
    return ", ".join(f"{sql} AS {name}" for name, sql in measures.items())


LEADER_CTE = f"leaders AS (SELECT symbol, month, open_time, {_leader_sql()} FROM steps WHERE symbol IN {LEADERS})"


def _leader_query(name: str, measures: list[str]) -> None:
    cols = ", ".join(f"{r(m)} AS {m}" for m in measures)

    def run_one(t):
        table = features.leader_table(t.bars, LEADER_MAP)
        parts = [
            table.filter(F.col(f"_has_{a}") == 1).select(
                F.lit(s).alias("symbol"), "open_time", *[rnd(f"{a}_{m}").alias(m) for m in measures]
            )
            for a, s in LEADER_MAP.items()
        ]
        return parts[0].unionByName(parts[1])

    query(name, with_tables("bars", f"SELECT symbol, open_time, {cols} FROM leaders", STEPS_CTE, LEADER_CTE))(run_one)


_leader_query("g01_leader_returns", [f"return_{k}m" for k in (5, 15, 60, 240, 1440)])
_leader_query("g02_leader_volatility", ["volatility_60m", "volatility_240m"])
_leader_query("g03_leader_volume_zscore", ["volume_zscore_60m", "volume_zscore_1440m"])


def _joined_leaders(columns: str) -> str:
    return f"""SELECT s.symbol, s.open_time, {columns} FROM
    (SELECT *, {ret(5)} AS r5, {ret(15)} AS r15, {ret(60)} AS r60, {zscore("volume")} AS vz FROM steps) s
    LEFT JOIN leaders b ON b.symbol = '{LEADERS[0]}' AND b.month = s.month AND b.open_time = s.open_time
    LEFT JOIN leaders e ON e.symbol = '{LEADERS[1]}' AND e.month = s.month AND e.open_time = s.open_time"""


@query(
    "g04_leader_match",
    with_tables(
        "bars",
        _joined_leaders(
            f"""{r("coalesce(b.return_60m, 0.0)")} AS btc_return_60m, {r("coalesce(e.volatility_60m, 0.0)")} AS eth_volatility_60m,
            CASE WHEN b.symbol IS NULL THEN 1.0::DOUBLE ELSE 0.0 END AS btc_regime_missing,
            CASE WHEN e.symbol IS NULL THEN 1.0::DOUBLE ELSE 0.0 END AS eth_regime_missing"""
        ),
        STEPS_CTE,
        LEADER_CTE,
    ),
)
def leader_match(t):
    df = features.regime(features.base(t.bars), t.bars, LEADER_MAP)
    return df.select(
        "symbol", "open_time", rnd("btc_return_60m").alias("btc_return_60m"),
        rnd("eth_volatility_60m").alias("eth_volatility_60m"), "btc_regime_missing", "eth_regime_missing",
    )


G5 = {f"symbol_return_minus_{a}_{k}m": clip(f"r{k} - coalesce({s}.return_{k}m, 0.0)", -1, 1) for a, s in (("btc", "b"), ("eth", "e")) for k in (5, 15, 60)}
G5["symbol_volume_zscore_minus_btc_volume_zscore_60m"] = clip("vz - coalesce(b.volume_zscore_60m, 0.0)", -20, 20)


@query(
    "g05_minus_leader",
    with_tables("bars", _joined_leaders(", ".join(f"{r(s)} AS {c}" for c, s in G5.items())), STEPS_CTE, LEADER_CTE),
)
def minus_leader(t):
    df = features.regime(features.base(t.bars), t.bars, LEADER_MAP)
    return df.select("symbol", "open_time", *[rnd(c).alias(c) for c in G5])


MIN_SYMBOLS = 5
BREADTH_CTE = f"""rets AS (SELECT symbol, month, open_time, quote_volume, {ret(5)} AS r5, {ret(15)} AS r15, {ret(60)} AS r60,
  CASE WHEN rn > 5 THEN {ret(5)} END AS k5, CASE WHEN rn > 15 THEN {ret(15)} END AS k15, CASE WHEN rn > 60 THEN {ret(60)} END AS k60 FROM steps),
per_time AS (SELECT month, open_time, count(k5) AS n5, count(k15) AS n15, count(k60) AS n60,
  avg(CAST(k5 > 0 AS INTEGER)) AS up5, avg(CAST(k15 > 0 AS INTEGER)) AS up15, avg(CAST(k60 > 0 AS INTEGER)) AS up60,
  avg(k5) AS a5, avg(k15) AS a15, avg(k60) AS a60, quantile_cont(k15, 0.5) AS m15, sum(quote_volume) AS qv FROM rets GROUP BY 1, 2),
market AS (SELECT *, least(n5, n15, n60) >= {MIN_SYMBOLS} AS enough,
  (qv - coalesce(avg(qv) OVER p, 0.0)) / (CASE WHEN stddev_pop(qv) OVER p IS NULL OR stddev_pop(qv) OVER p < 1e-12 THEN 1.0 ELSE stddev_pop(qv) OVER p END) AS qz
  FROM per_time WINDOW p AS (PARTITION BY month ORDER BY open_time ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))"""


def gate(x: str) -> str:
    return f"CASE WHEN enough THEN {x} ELSE 0.0 END"


def _breadth_query(name: str, columns: dict[str, str]) -> None:
    body = ", ".join(f"{r(sql)} AS {c}" for c, sql in columns.items())

    def run_one(t):
        table = features.breadth_table(features.base(t.bars), MIN_SYMBOLS)
        return table.select("open_time", *[rnd(c).alias(c) for c in columns])

    query(name, with_tables("bars", f"SELECT open_time, {body} FROM market", STEPS_CTE, BREADTH_CTE))(run_one)


_breadth_query("h01_share_up", {f"market_breadth_up_{k}m": gate(f"up{k}") for k in (5, 15, 60)})
_breadth_query(
    "h02_market_returns",
    {**{f"market_average_return_{k}m": gate(clip(f"a{k}", -1, 1)) for k in (5, 15, 60)},
     "market_median_return_15m": gate(clip("m15", -1, 1))},
)
_breadth_query("h03_market_volume_zscore", {"market_quote_volume_zscore_60m": gate(clip("qz", -20, 20))})
_breadth_query("h04_minimum_symbols", {"market_breadth_missing": "CASE WHEN enough THEN 0.0 ELSE 1.0 END"})

H5 = {f"symbol_return_minus_market_{k}m": clip(f"r{k} - {gate(clip(f'a{k}', -1, 1))}", -1, 1) for k in (5, 15, 60)}


@query(
    "h05_minus_market",
    with_tables(
        "bars",
        f"""SELECT s.symbol, s.open_time, {", ".join(f"{r(s)} AS {c}" for c, s in H5.items())} FROM rets s
        JOIN market m ON m.month = s.month AND m.open_time = s.open_time""",
        STEPS_CTE,
        BREADTH_CTE,
    ),
)
def minus_market(t):
    df = features.breadth(features.base(t.bars), MIN_SYMBOLS)
    return df.select("symbol", "open_time", *[rnd(c).alias(c) for c in H5])


# Outcomes. Bars of the events table move a lot, so targets are wide.
TARGET, STOP = 0.5, 0.4
STEPS = range(1, WINDOW + 1)
LEADS = ", ".join(f"lead({c}, {j}) OVER ({W}) AS {c}{j}" for c in ("high", "low", "close") for j in STEPS)


def first_index(cond: str) -> str:
    """cond holds {j} for the bar number"""
    return "CASE " + " ".join(f"WHEN {cond.format(j=j)} THEN {j}" for j in STEPS) + f" ELSE {WINDOW + 1} END"


HELD = {j: f"greatest(close * {1 + TARGET}, close{j})" for j in STEPS}
DECLINE = (
    "(CASE " + " ".join(f"WHEN hit < {j} AND close{j} < {HELD[j - 1]} THEN {HELD[j - 1]}" for j in range(2, WINDOW + 1))
    + f" ELSE {HELD[WINDOW]} END) / close - 1"
)
OUT_CTE = f"""outs AS (SELECT *, close{WINDOW} / close - 1 AS forward_return,
  greatest({", ".join(f"high{j}" for j in STEPS)}) / close - 1 AS mfe, least({", ".join(f"low{j}" for j in STEPS)}) / close - 1 AS mae,
  {first_index(f"high{{j}} >= close * {1 + TARGET}")} AS hit, {first_index(f"low{{j}} <= close * {1 - STOP}")} AS stopped
  FROM (SELECT symbol, month, open_time, close, quote_volume, {LEADS} FROM bars) WHERE close{WINDOW} IS NOT NULL),
labelled AS (SELECT *, CAST(hit < stopped AS INTEGER) AS label,
  CASE WHEN hit < stopped THEN {TARGET} WHEN stopped <= {WINDOW} THEN -{STOP} ELSE forward_return END AS trade_return FROM outs)"""


def outcomes(t, **how):
    conf = {"window": WINDOW, "target": TARGET, "stop": STOP, "growth": TARGET, **how}
    return labels.outcomes(t.bars, **conf).filter("forward_return IS NOT NULL")


def shown(df, *columns):
    keys = ["symbol", "open_time"] + (["label"] if "label" in columns else [])
    return df.select(*keys, *[rnd(c).alias(c) for c in columns if c != "label"])


query("l01_forward_return", with_tables("bars", f"SELECT symbol, open_time, {r('forward_return')} AS forward_return FROM outs", OUT_CTE))(
    lambda t: shown(outcomes(t), "forward_return")
)
query(
    "l02_excursions",
    with_tables("bars", f"SELECT symbol, open_time, {r('mfe')} AS max_future_high_return, {r('mae')} AS max_future_low_return FROM outs", OUT_CTE),
)(lambda t: shown(outcomes(t), "max_future_high_return", "max_future_low_return"))
query(
    "l03_future_high_label",
    with_tables(
        "bars",
        f"""SELECT symbol, open_time, CAST(mfe >= {TARGET} AS INTEGER) AS label,
        {r(f"CASE WHEN mfe >= {TARGET} THEN {TARGET} ELSE forward_return END")} AS trade_return FROM outs""",
        OUT_CTE,
    ),
)(lambda t: shown(outcomes(t, mode="future_high"), "label", "trade_return"))
query(
    "l04_target_stop_label",
    with_tables("bars", f"SELECT symbol, open_time, label, {r('trade_return')} AS trade_return FROM labelled", OUT_CTE),
)(lambda t: shown(outcomes(t), "label", "trade_return"))
query(
    "l05_tie_policies",
    with_tables(
        "bars",
        f"""SELECT 'stop_first' AS tie, count(*) AS rows, sum(CAST(hit < stopped AS INTEGER))::BIGINT AS positives FROM outs
        UNION ALL SELECT 'target_first', count(*), sum(CAST(hit <= {WINDOW} AND hit <= stopped AS INTEGER))::BIGINT FROM outs
        UNION ALL SELECT 'skip', count(*), sum(CAST(hit < stopped AS INTEGER))::BIGINT FROM outs WHERE NOT (hit <= {WINDOW} AND hit = stopped)""",
        OUT_CTE,
    ),
)(
    lambda t: outcomes(t).selectExpr("'stop_first' AS tie", "label")
    .unionByName(outcomes(t, tie="target_first").selectExpr("'target_first' AS tie", "label"))
    .unionByName(outcomes(t, tie="skip").selectExpr("'skip' AS tie", "label"))
    .groupBy("tie").agg(F.count(F.lit(1)).alias("rows"), F.sum("label").alias("positives"))
)
query(
    "l06_first_decline_exit",
    with_tables(
        "bars",
        f"""SELECT symbol, open_time, label, {r(f"CASE WHEN label = 1 THEN {DECLINE} ELSE trade_return END")} AS trade_return FROM labelled""",
        OUT_CTE,
    ),
)(lambda t: shown(outcomes(t, exit_mode="first_decline"), "label", "trade_return"))

VOL_CTE = f"""vols AS (SELECT symbol, open_time, {FEATURE_SQL["f08_volatility"]["rolling_volatility_60m"]} AS vol FROM steps)"""


@query(
    "l07_regression_targets",
    with_tables(
        "bars",
        f"""SELECT l.symbol, l.open_time, {r("trade_return - 0.0015")} AS net, {r("greatest(-0.1, least(0.1, trade_return))")} AS clipped,
        {r("trade_return / (vol + 1e-6)", 3)} AS risk_adjusted, {r("trade_return")} AS inverted
        FROM labelled l JOIN vols v ON v.symbol = l.symbol AND v.open_time = l.open_time""",
        STEPS_CTE, OUT_CTE, VOL_CTE,
    ),
)
def regression_targets(t):
    df = labels.outcomes(features.base(t.bars), WINDOW, target=TARGET, stop=STOP).filter("forward_return IS NOT NULL")
    df = df.withColumn("risk_adjusted", labels.regression_target("risk_adjusted"))
    return df.select(
        "symbol", "open_time",
        rnd(labels.regression_target("net")).alias("net"),
        rnd(labels.regression_target("clipped")).alias("clipped"),
        rnd("risk_adjusted", 3).alias("risk_adjusted"),
        rnd(labels.invert_risk_adjusted("risk_adjusted")).alias("inverted"),
    )


UTILITY = "trade_return - 0.001 - 0.0005 - 0.0002 - 0.001 - 0.1 * greatest(0.0, -mae)"


def utilities(t):
    u = labels.net_utility(latency=0.0002, margin=0.001, adverse=0.1)
    return outcomes(t).withColumn("utility", u)


query("l08_net_utility", with_tables("bars", f"SELECT symbol, open_time, {r(UTILITY)} AS utility FROM labelled", OUT_CTE))(
    lambda t: shown(utilities(t), "utility")
)


@query(
    "l09_relevance_grades",
    with_tables(
        "bars",
        f"""SELECT mode, CAST(grade AS INTEGER) AS grade, count(*) AS rows FROM (
          SELECT u, 'utility_tail' AS mode, CASE WHEN u <= 0 THEN 0 WHEN u >= s THEN 4 WHEN u >= f THEN 3 WHEN u >= w THEN 1 ELSE 0 END AS grade FROM graded
          UNION ALL SELECT u, 'train_quantiles', CASE WHEN u <= 0 THEN 0 WHEN u >= s THEN 4 WHEN u >= f THEN 3 WHEN u >= w THEN 2 ELSE 1 END FROM graded)
        GROUP BY 1, 2""",
        OUT_CTE,
        f"utils AS (SELECT open_time, {UTILITY} AS u FROM labelled)",
        """cuts AS (SELECT quantile_cont(u, 0.25) AS w, quantile_cont(u, 0.5) AS f, quantile_cont(u, 0.75) AS s FROM utils
          WHERE u > 0 AND open_time < 1705708800000)""",
        "graded AS (SELECT * FROM utils, cuts)",
    ),
)
def relevance_grades(t):
    df = utilities(t).select("open_time", "utility")
    cuts = labels.grade_cuts(df.filter("open_time < 1705708800000"), "utility", 0.25, 0.5, 0.75)
    parts = [labels.relevance(df, cuts, "utility", m).withColumn("mode", F.lit(m)) for m in ("utility_tail", "train_quantiles")]
    return parts[0].unionByName(parts[1]).groupBy("mode", "grade").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "l10_decision_groups",
    with_tables(
        "trades",
        """SELECT g AS decision_group, count(*) AS rows FROM (SELECT trade_time // 60000 // 240 AS g FROM trades) GROUP BY 1 HAVING count(*) >= 50""",
    ),
)
def decision_groups(t):
    df = labels.decision_groups(t.trades.withColumn("open_time", F.col("trade_time")), 240, 50)
    return df.groupBy("decision_group").agg(F.count(F.lit(1)).alias("rows"))


HORIZON, ACTIVATION, PULLBACK, HARD_STOP = 6, 0.2, 0.1, 0.4
PATH_CTE = f"""paths AS (SELECT symbol, open_time, {", ".join(f"lead(close, {j}) OVER ({W}) / close - 1 AS r{j}" for j in range(1, HORIZON + 1))} FROM bars),
walk AS (SELECT symbol, open_time, j, ret, max(ret) OVER (PARTITION BY symbol, open_time ORDER BY j) AS best FROM (
  {" UNION ALL ".join(f"SELECT symbol, open_time, {j} AS j, r{j} AS ret FROM paths WHERE r{HORIZON} IS NOT NULL" for j in range(1, HORIZON + 1))})),
exits AS (SELECT DISTINCT ON (symbol, open_time) symbol, open_time, j, ret, reason FROM (
  SELECT *, CASE WHEN ret <= -{HARD_STOP} THEN 'stop_loss' WHEN best >= {ACTIVATION} AND best - ret >= {PULLBACK} - 1e-12 THEN 'trailing_stop'
    WHEN j = {HORIZON} THEN 'max_holding_time' END AS reason FROM walk) WHERE reason IS NOT NULL ORDER BY symbol, open_time, j)"""


def exited(t):
    df = exits.path(t.bars, HORIZON).filter("future_returns IS NOT NULL")
    return df.withColumn("exit", exits.trailing(exits.require_path(), ACTIVATION, PULLBACK, HARD_STOP))


query(
    "q01_future_path",
    with_tables("bars", f"SELECT symbol, open_time, {', '.join(f'{r(f'r{j}')} AS r{j}' for j in range(1, HORIZON + 1))} FROM paths WHERE r{HORIZON} IS NOT NULL", PATH_CTE),
)(
    lambda t: exits.path(t.bars, HORIZON).filter("future_returns IS NOT NULL").select(
        "symbol", "open_time", *[rnd(F.col("future_returns")[j - 1]).alias(f"r{j}") for j in range(1, HORIZON + 1)]
    )
)
query(
    "q02_trailing_stop",
    with_tables("bars", f"SELECT symbol, open_time, CAST(j AS INTEGER) AS exit_bar, {r('ret')} AS exit_return, reason AS exit_reason FROM exits", PATH_CTE),
)(lambda t: exited(t).select("symbol", "open_time", "exit.exit_bar", rnd("exit.exit_return").alias("exit_return"), "exit.exit_reason"))
query(
    "q03_fixed_exit",
    with_tables("bars", f"SELECT symbol, open_time, {WINDOW} AS exit_bar, {r('trade_return')} AS exit_return, 'fixed_horizon' AS exit_reason FROM labelled", OUT_CTE),
)(
    lambda t: outcomes(t).withColumn("exit", exits.fixed(WINDOW)).select(
        "symbol", "open_time", "exit.exit_bar", rnd("exit.exit_return").alias("exit_return"), "exit.exit_reason"
    )
)
Q4_COLS = f"""count(*) AS trades, {r("avg(j)")} AS average_exit_bar, {r("avg(ret)")} AS average_dynamic_return,
{r("avg(fixed)")} AS average_fixed_return, {r("avg(ret - fixed)")} AS dynamic_minus_fixed"""
query(
    "q04_exit_summary",
    with_tables(
        "bars",
        f"""SELECT reason AS exit_reason, {Q4_COLS} FROM both_exits GROUP BY 1 UNION ALL SELECT 'all', {Q4_COLS} FROM both_exits""",
        PATH_CTE,
        f"both_exits AS (SELECT e.*, p.r{HORIZON} AS fixed FROM exits e JOIN paths p ON p.symbol = e.symbol AND p.open_time = e.open_time)",
    ),
)(
    lambda t: exits.summary(exited(t).withColumn("fixed", F.element_at("future_returns", -1)), "exit", "fixed").select(
        "exit_reason", "trades",
        *[rnd(c).alias(c) for c in ("average_exit_bar", "average_dynamic_return", "average_fixed_return", "dynamic_minus_fixed")],
    )
)


@query(
    "x00_momentum_top1",
    with_tables(
        "bars",
        f"""SELECT count(*) AS picks, sum(label)::BIGINT AS hits, {r("avg(label)")} AS precision, {r("avg(trade_return)")} AS mean_return,
        {r("avg(trade_return - 0.0015)")} AS mean_net_return, count(DISTINCT symbol) AS active_symbols FROM (
          SELECT l.*, row_number() OVER (PARTITION BY l.open_time ORDER BY m.ret60 DESC, l.symbol) AS place FROM (
            SELECT symbol, open_time, CAST(mfe >= {TARGET} AS INTEGER) AS label,
              CASE WHEN mfe >= {TARGET} THEN {TARGET} ELSE forward_return END AS trade_return FROM outs) l
          JOIN (SELECT symbol, open_time, rn, {ret(60)} AS ret60 FROM steps) m ON m.symbol = l.symbol AND m.open_time = l.open_time
          WHERE rn > 60) WHERE place = 1""",
        STEPS_CTE,
        OUT_CTE,
    ),
)
def momentum_top1(t):
    """Which bars move up within the next five, and how well a one-hour momentum score finds them."""
    df = labels.outcomes(features.base(t.bars), WINDOW, mode="future_high", growth=TARGET)
    scored = df.filter((F.col("_row") > features.HOUR) & F.col("forward_return").isNotNull())
    top = select.topk(scored, 1, ["open_time"], [F.desc("ret_60m"), F.col("symbol")])
    return top.agg(
        F.count(F.lit(1)).alias("picks"),
        F.sum("label").alias("hits"),
        rnd(F.avg("label")).alias("precision"),
        rnd(F.avg("trade_return")).alias("mean_return"),
        rnd(F.avg(F.col("trade_return") - 0.0015)).alias("mean_net_return"),
        F.countDistinct("symbol").alias("active_symbols"),
    )
