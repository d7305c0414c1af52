"""Queries over insider filings, regime, sizing, signals, stops and profit."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import bars, indicators, insider, trading
from ..sources import fixtures as fx
from ..sources.fixtures import AS_OF, with_tables
from .market import BREADTH_CTE, INDICATORS_CTE, breadth, rounded

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: Filings end with the bars; this day has forty-five days of them before it.
FILED = "2001-07-01"


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


# --- insider ----------------------------------------------------------------------------------------------

INSIDER = """,
    fw AS (SELECT *, date_diff('day', CAST(ts AS DATE), DATE '2001-07-01') AS age FROM filings WHERE code IN ('P', 'S') AND ts >= TIMESTAMP '2001-05-17' AND ts < TIMESTAMP '2001-07-02'),
    w AS (SELECT *, CASE WHEN is_c_suite THEN 1.0::DOUBLE WHEN is_officer THEN 0.7::DOUBLE WHEN is_director THEN 0.5::DOUBLE ELSE 0 END * least(1, value / 1e6) * greatest(0, 1 - age / 45::DOUBLE)
                 * CASE WHEN is_plan AND code = 'S' THEN 0 ELSE 1 END AS weight FROM fw),
    kb AS (SELECT * FROM candles WHERE ts <= TIMESTAMP '2001-07-01'),
    kr AS (SELECT *, lag(close) OVER (PARTITION BY instrument_id ORDER BY ts) AS prev, row_number() OVER (PARTITION BY instrument_id ORDER BY ts DESC) AS rn FROM kb),
    ka AS (SELECT instrument_id, count(*) AS n, max(close) FILTER (WHERE rn = 1) AS last_close, avg(greatest(high - low, abs(high - prev), abs(low - prev))) FILTER (WHERE rn <= 14) AS atr FROM kr WHERE rn <= 120 GROUP BY instrument_id),
    si AS (SELECT instrument_id, min(CAST(ts AS DATE)) AS since FROM fw GROUP BY instrument_id),
    af AS (SELECT kr.instrument_id, arg_min(close, ts) AS at_filing FROM kr JOIN si USING (instrument_id) WHERE rn <= 120 AND CAST(ts AS DATE) >= since GROUP BY kr.instrument_id),
    mv AS (SELECT instrument_id, CASE WHEN n >= 20 AND at_filing > 0 AND atr > 0 THEN (last_close - at_filing) / atr END AS move_atr FROM si LEFT JOIN ka USING (instrument_id) LEFT JOIN af USING (instrument_id)),
    md AS (SELECT *, CASE WHEN move_atr IS NULL OR abs(move_atr) <= 1 THEN 1 WHEN abs(move_atr) >= 3 THEN 0 ELSE 1 - (abs(move_atr) - 1) / 2 END AS damping FROM mv),
    ag AS (SELECT instrument_id, coalesce(sum(weight) FILTER (WHERE code = 'P'), 0) AS b, coalesce(sum(weight) FILTER (WHERE code = 'S' AND is_c_suite), 0) AS s,
           coalesce(sum(value) FILTER (WHERE code = 'P' AND weight > 0), 0) AS buy_value, coalesce(sum(value) FILTER (WHERE code = 'S' AND is_c_suite AND weight > 0), 0) AS sell_value, count(*) AS filings FROM w GROUP BY instrument_id),
    sc AS (SELECT *, CASE WHEN b > 0 THEN 50 + 50 * (b / (b + 1)) * damping END AS insider_score, 0.4::DOUBLE * (CASE WHEN s > 0 THEN s / (s + 1) ELSE 0 END) * damping AS insider_penalty FROM ag LEFT JOIN md USING (instrument_id))"""
_INS = with_tables("candles", "filings") + INSIDER


@query("n1_filing_weight", _INS + " SELECT accession, line_index, instrument_id, value, round(weight, 6) AS weight FROM w")
def _(spark, d):
    return rounded(insider.weighted(fx.filings(spark, d), FILED).select("accession", "line_index", "instrument_id", "value", "weight"))


@query("n2_insider_score", _INS + " SELECT instrument_id, round(insider_score, 5) AS insider_score, round(insider_penalty, 5) AS insider_penalty FROM sc WHERE insider_score IS NOT NULL OR insider_penalty > 0")
def _(spark, d):
    return rounded(insider.scores(fx.filings(spark, d), fx.candles(spark, d), FILED).select("instrument_id", "insider_score", "insider_penalty"), 5)


@query("n3_move_since_filing", _INS + " SELECT instrument_id, round(move_atr, 5) AS move_atr, round(damping, 5)::DOUBLE AS damping FROM md")
def _(spark, d):
    return rounded(insider.moves(fx.filings(spark, d), fx.candles(spark, d), FILED), 5)


@query("n4_insider_pressure", _INS + " SELECT instrument_id, round(insider_penalty, 5) AS insider_penalty, round(move_atr, 5) AS move_atr FROM sc WHERE insider_penalty > 0")
def _(spark, d):
    return rounded(insider.pressure(fx.filings(spark, d), fx.candles(spark, d), FILED), 5)


@query("a12_insider_aggregate", _INS + " SELECT instrument_id, round(buy_value, 2) AS buy_value, round(sell_value, 2) AS sell_value, filings FROM sc WHERE insider_score IS NOT NULL OR insider_penalty > 0")
def _(spark, d):
    return rounded(insider.scores(fx.filings(spark, d), fx.candles(spark, d), FILED).select("instrument_id", "buy_value", "sell_value", "filings"), 2)


@query("a12_insider_details", _INS + " SELECT instrument_id, n::INTEGER AS n, accession, code, value FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY ts, accession, line_index, value) AS n FROM w WHERE weight > 0 AND (code = 'P' OR is_c_suite)) WHERE n <= 6")
def _(spark, d):
    return insider.details(fx.filings(spark, d), FILED)


@query("j19_filing_to_first_bar", _INS + " SELECT instrument_id, at_filing FROM af")
def _(spark, d):
    f = insider.recent(fx.filings(spark, d), FILED).groupBy("instrument_id").agg(F.min(F.to_date("ts")).alias("since"))
    c = bars.newest_first(fx.candles(spark, d).where(F.col("ts") <= F.lit(FILED).cast("timestamp")), 120)
    rows = c.join(f, "instrument_id").where(F.to_date("ts") >= F.col("since"))
    return rows.groupBy("instrument_id").agg(F.min_by("close", "ts").alias("at_filing"))


@query("st4_filing_upsert", """SELECT l_orderkey AS accession, l_linenumber AS line_index, arg_max(l_extendedprice, r) AS value, arg_max(l_suppkey, r) AS instrument_id, arg_min(l_returnflag, r) AS code
    FROM (SELECT *, row(l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) AS r FROM lineitem) GROUP BY ALL""")
def _(spark, d):
    # a line that is read again, as (accession, line) repeats in the table, replaces what was read before; its code stays as first read
    li = fx.read(spark, d, "lineitem")
    read_at = F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    reads = li.select(F.col("l_orderkey").alias("accession"), F.col("l_linenumber").alias("line_index"), F.col("l_extendedprice").alias("value"), F.col("l_suppkey").alias("instrument_id"), F.col("l_returnflag").alias("code"), read_at.alias("retrieved_at"))
    old = reads.where("retrieved_at.l_shipdate < TIMESTAMP '1999-01-01'")
    return bars.upsert(old, reads.where("retrieved_at.l_shipdate >= TIMESTAMP '1999-01-01'"), ("code",), ["accession", "line_index"]).drop("retrieved_at")


@query("a15_filing_counters", with_tables("filings") + " SELECT count(*) AS seen, count(DISTINCT (accession, line_index)) AS stored, count(*) FILTER (WHERE code IN ('P', 'S') AND (is_c_suite OR is_officer OR is_director)) AS signalling FROM filings")
def _(spark, d):
    senior = F.col("code").isin("P", "S") & (F.col("is_c_suite") | F.col("is_officer") | F.col("is_director"))
    f = fx.filings(spark, d)
    keys = f.groupBy("accession", "line_index").agg(F.count(F.lit(1)).alias("n"), F.count_if(senior).alias("s"))
    return keys.agg(F.sum("n").alias("seen"), F.count(F.lit(1)).alias("stored"), F.sum("s").alias("signalling"))


# --- regime -----------------------------------------------------------------------------------------------

_READ = """WITH rd AS (SELECT event_type AS series, CAST(ts AS DATE) AS day, round(avg(value), 4) AS vix, count(*) FILTER (WHERE event_id % 2 = 0) / count(*) AS breadth, max(event_id) % 3 <> 0 AS sp500_uptrend,
    CASE WHEN max(event_id) % 5 <> 0 THEN max(event_id) % 4 <> 0 END AS world_uptrend, round(min(value) - 1, 4) AS curve, round(max(value), 4) AS ratio FROM events GROUP BY ALL),
    rs AS (SELECT *, greatest(0.55, round(1 - (CASE WHEN vix >= 30 THEN 0.15::DOUBLE WHEN vix >= 20 THEN 0.07::DOUBLE ELSE 0 END + CASE WHEN breadth <= 0.3 THEN 0.15::DOUBLE WHEN breadth <= 0.45 THEN 0.07::DOUBLE ELSE 0 END
      + CASE WHEN NOT sp500_uptrend THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN NOT world_uptrend THEN 0.07::DOUBLE ELSE 0 END), 4))::DOUBLE AS risk_factor FROM rd),
    rp AS (SELECT *, CASE WHEN risk_factor >= 0.99 THEN 'normal' WHEN risk_factor >= 0.85 THEN 'cautious' WHEN risk_factor >= 0.7 THEN 'defensive' ELSE 'risk-off' END AS posture FROM rs)"""


def readings(spark, d):
    top = F.max("event_id")
    e = fx.read(spark, d, "events").groupBy(F.col("event_type").alias("series"), F.to_date("ts").alias("day"))
    return e.agg(
        F.round(F.avg("value"), 4).alias("vix"), (F.count_if(F.col("event_id") % 2 == 0) / F.count(F.lit(1))).alias("breadth"), (top % 3 != 0).alias("sp500_uptrend"),
        F.when(top % 5 != 0, top % 4 != 0).alias("world_uptrend"), F.round(F.min("value") - 1, 4).alias("curve"), F.round(F.max("value"), 4).alias("ratio"),
    )


@query("r8_regime_score", _READ + " SELECT series, day, risk_factor, posture FROM rp")
def _(spark, d):
    return trading.regime(readings(spark, d)).select("series", "day", "risk_factor", "posture")


@query("r7_current_factor", _READ + " SELECT coalesce(greatest(0.55, least(1, arg_max(risk_factor, day))), 1)::DOUBLE AS risk_factor FROM rp WHERE series = 'click'")
def _(spark, d):
    return trading.current_factor(trading.regime(readings(spark, d)).where("series = 'click'"))


@query("r9_daily_reading", f"WITH {BREADTH_CTE}, {_READ.removeprefix('WITH ')} SELECT series, day, vix, risk_factor, posture, (SELECT round(count(*) FILTER (last > mean) / nullif(count(*), 0), 6) FROM br) AS market_breadth FROM rp WHERE day = (SELECT max(day) FROM rp)")
def _(spark, d):
    r = trading.regime(readings(spark, d))
    last = r.agg(F.max("day").alias("day"))
    own = breadth(spark, d).select(F.round("breadth", 6).alias("market_breadth"))
    return r.join(F.broadcast(last), "day").join(F.broadcast(own), F.lit(True)).select("series", "day", "vix", "risk_factor", "posture", "market_breadth")


@query("w5_previous_snapshot", _READ + " SELECT series, day, lag(posture) OVER (PARTITION BY series ORDER BY day) AS previous FROM rp")
def _(spark, d):
    return trading.regime(readings(spark, d)).select("series", "day", F.lag("posture").over(Window.partitionBy("series").orderBy("day")).alias("previous"))


def _cross_sql(c: str, level: float) -> str:
    return f"CASE WHEN p.p_{c} < {level} AND {c} >= {level} THEN '{c} above {level:.0f}' WHEN p.p_{c} >= {level} AND {c} < {level} THEN '{c} below {level:.0f}' END"


_ALERTS = ["CASE WHEN nth = 1 THEN 'first reading' END", "CASE WHEN p_posture <> posture THEN 'posture ' || p_posture || ' -> ' || posture END", "CASE WHEN p_sp500_uptrend <> sp500_uptrend THEN CASE WHEN sp500_uptrend THEN 'golden cross' ELSE 'death cross' END END"]
_ALERTS += [_cross_sql(c, x) for c, xs in (("curve", (0.0,)), ("vix", trading.VIX_LEVELS), ("ratio", trading.RATIO_LEVELS)) for x in xs]


@query("st11_regime_alerts", _READ + f""", p AS (SELECT *, {', '.join(f'lag({c}) OVER w AS p_{c}' for c in ('posture', 'sp500_uptrend', 'curve', 'vix', 'ratio'))}, row_number() OVER w AS nth FROM rp WINDOW w AS (PARTITION BY series ORDER BY day))
    SELECT series, day, alert FROM (SELECT series, day, unnest([{', '.join(_ALERTS)}]) AS alert FROM p) WHERE alert IS NOT NULL""")
def _(spark, d):
    return trading.regime_alerts(trading.regime(readings(spark, d)))


_RATIO = """WITH v AS (SELECT user_id % 50 AS country, CASE WHEN event_type IN ('view', 'click') THEN 'equities' ELSE 'gdp' END AS series, CASE WHEN event_id % 5 <> 0 THEN value END AS value, ts, event_id FROM events WHERE event_type <> 'error'),
    n AS (SELECT country, arg_max(value, row(ts, event_id)) FILTER (series = 'equities' AND value IS NOT NULL) AS equities, arg_max(value, row(ts, event_id)) FILTER (series = 'gdp' AND value IS NOT NULL) AS gdp FROM v GROUP BY country)"""


@query("a10_buffett_ratio", _RATIO + " SELECT country, equities, gdp, CASE WHEN gdp <> 0 THEN round(equities / 1000 / gdp * 100, 6) END AS ratio FROM n")
def _(spark, d):
    kind = F.when(F.col("event_type").isin("view", "click"), "equities").otherwise("gdp")
    series = fx.read(spark, d, "events").where("event_type <> 'error'").select((F.col("user_id") % 50).alias("country"), kind.alias("series"), F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value"), "ts", "event_id")
    return rounded(trading.equities_to_gdp(series)).select("country", *[F.col(c) for c in ("equities", "gdp", "ratio")])


@query("j18_index_proxy", with_tables("candles") + """, r AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY ts DESC) AS rn FROM candles WHERE instrument_id IN (3, 5, 8)),
    m AS (SELECT instrument_id, count(*) AS n, avg(close) FILTER (WHERE rn <= 200) AS ma200 FROM r GROUP BY instrument_id)
    SELECT arg_min(instrument_id, CASE instrument_id WHEN 8 THEN 1 WHEN 3 THEN 2 ELSE 3 END) AS proxy FROM m WHERE n >= 200 AND ma200 > 0""")
def _(spark, d):
    ind = indicators.indicators(fx.candles(spark, d).where("instrument_id IN (3, 5, 8)"), 400, ["n_bars", "sma200"])
    preference = F.when(F.col("instrument_id") == 8, 1).when(F.col("instrument_id") == 3, 2).otherwise(3)
    return ind.where("n_bars >= 200 AND sma200 > 0").agg(F.min_by("instrument_id", preference).alias("proxy"))


# --- sizing and signals -----------------------------------------------------------------------------------

IND = with_tables("candles") + INDICATORS_CTE


@query("r1_proposal_sizing", IND.replace("rn <= 300", "rn <= 60") + """, p AS (SELECT instrument_id, n_bars, last_close AS entry, last_close - atr14 * 0.25::DOUBLE AS stop, atr14 * 0.25::DOUBLE AS dist, atr14, instrument_id % 17 = 0 AS suspended, instrument_id IN (SELECT o_orderkey % 97 FROM orders WHERE o_orderkey % 8 = 1) AS pending FROM ind),
    q AS (SELECT *, least(1e6 * 0.01::DOUBLE / dist, 1e6 * 0.1::DOUBLE / entry) AS n FROM p),
    rf AS (SELECT *, CASE WHEN suspended THEN 'suspended' WHEN n_bars < 20 THEN 'not enough history' WHEN NOT entry > 0 THEN 'no entry price' WHEN atr14 IS NULL OR atr14 <= 0 THEN 'no stop distance' WHEN stop <= 0 THEN 'stop at or below zero' WHEN n < 1e-8 THEN 'sized to zero' WHEN pending THEN 'pending already' END AS reason FROM q)
    SELECT instrument_id, round(entry, 7) AS entry, round(stop, 4) AS stop, reason, CASE WHEN reason IS NULL THEN round(n, 4) END AS quantity, CASE WHEN reason IS NULL THEN round(n * entry, 1) END AS position_value, CASE WHEN reason IS NULL THEN round(n * dist, 1) END AS risk_amount, CASE WHEN reason IS NULL THEN round(n * dist / 1e6, 5) END AS risk_share FROM rf""")
def _(spark, d):
    ind = indicators.indicators(fx.candles(spark, d), 60, ["n_bars", "last_close", "atr14"])
    pending = fx.read(spark, d, "orders").where("o_orderkey % 8 = 1").select((F.col("o_orderkey") % 97).alias("instrument_id"), F.lit(True).alias("p")).distinct()
    rows = ind.join(pending, "instrument_id", "left").withColumns({"suspended": F.col("instrument_id") % 17 == 0, "has_pending": F.coalesce("p", F.lit(False))})
    digits = {"entry": 7, "stop": 4, "quantity": 4, "position_value": 1, "risk_amount": 1, "risk_share": 5}
    return trading.proposals(rows, F.lit(1e6), multiple=0.25).select("instrument_id", "reason", *[F.round(c, n).alias(c) for c, n in digits.items()])


LIMITS = {"multiple": 0.5, "positions": 10, "trades": 5, "risk": 0.01, "position": 0.10, "instrument": 0.20, "open_risk": 0.05, "correlation": 0.80, "exposure": 0.50}


def candidates(spark, d):
    k = F.col("instrument_id")
    ind = indicators.indicators(fx.candles(spark, d), 300, ["n_bars", "last_close", "atr14"])
    return ind.withColumns({
        "configured": k % 29 != 2, "halted": k % 19 == 0, "stale": k % 23 == 1, "open_positions": (k % 12).cast("int"), "is_new": k % 2 == 0, "trades_today": (k % 7).cast("int"), "equity": F.lit(1e6),
        "equity_ceiling": F.when(k % 6 == 3, (k % 5) * 200000.0), "cash": (k % 10) * 20000.0, "held_value": (k % 5) * 60000.0, "open_risk": (k % 6) * 10000.0, "regime": F.lit(0.85),
        "monetary_cap": F.when(k % 4 == 1, 5000.0), "correlation": (k % 10) / 10.0, "exposure": (k % 4) / 4.0,
    })


_CAND = IND + """, k AS (SELECT instrument_id, n_bars, last_close AS e, atr14, atr14 * 0.5::DOUBLE AS dist, instrument_id % 19 = 0 AS halted, instrument_id % 23 = 1 AS stale, CASE WHEN instrument_id % 6 = 3 THEN least(1e6, (instrument_id % 5) * 200000.0::DOUBLE) ELSE 1e6 END AS eq FROM ind),
    c AS (SELECT *, eq * 0.01::DOUBLE * 0.85::DOUBLE / dist AS c0, eq * 0.1::DOUBLE / e AS c1, greatest(eq * 0.2::DOUBLE - (instrument_id % 5) * 60000.0::DOUBLE, 0) / e AS c2, least((instrument_id % 10) * 20000.0::DOUBLE, eq) / e AS c3,
          greatest(eq * 0.05::DOUBLE - (instrument_id % 6) * 10000.0::DOUBLE, 0) / dist AS c4, CASE WHEN instrument_id % 4 = 1 THEN 5000 / e END AS c5, instrument_id % 10 > 8 AND instrument_id % 4 > 2 AS reduced FROM k),
    m AS (SELECT *, least(c0, c1, c2, c3, c4, c5) AS q FROM c),
    dz AS (SELECT *, CASE WHEN instrument_id % 29 = 2 THEN 'no configuration' WHEN halted THEN 'halted' WHEN stale THEN 'stale' WHEN instrument_id % 2 = 0 AND instrument_id % 12 >= 10 THEN 'position cap' WHEN instrument_id % 7 >= 5 THEN 'trade cap' WHEN n_bars < 20 THEN 'not enough history'
          WHEN NOT e > 0 THEN 'no entry price' WHEN atr14 IS NULL OR atr14 <= 0 THEN 'no stop distance' WHEN e - dist <= 0 THEN 'stop at or below zero' WHEN eq <= 0 THEN 'no equity' WHEN q <= 0 THEN 'sized to zero' END AS reason FROM m)"""


@query("r3_risk_evaluate", _CAND + """ SELECT instrument_id, reason, CASE WHEN reason IS NULL THEN round(q * CASE WHEN reduced THEN 0.5 ELSE 1 END, 4) END AS quantity, CASE WHEN reason IS NULL THEN round(q * CASE WHEN reduced THEN 0.5 ELSE 1 END * dist, 1) END AS risk_amount FROM dz""")
def _(spark, d):
    return trading.evaluate(candidates(spark, d), LIMITS).select("instrument_id", "reason", F.round("quantity", 4).alias("quantity"), F.round("risk_amount", 1).alias("risk_amount"))


@query("r4_binding_cap", _CAND + """, bc AS (SELECT *, CASE q WHEN c0 THEN 'risk_budget' WHEN c1 THEN 'max_position_pct' WHEN c2 THEN 'max_instrument_pct' WHEN c3 THEN 'available_cash' WHEN c4 THEN 'max_total_open_risk' ELSE 'monetary_cap' END AS binding FROM dz WHERE reason IS NULL)
    SELECT instrument_id, binding, binding || ';market regime x0.85' || CASE WHEN reduced THEN ';correlation_reduction' ELSE '' END AS applied FROM bc""")
def _(spark, d):
    return trading.evaluate(candidates(spark, d), LIMITS).where("reason IS NULL").select("instrument_id", "binding", F.concat_ws(";", "applied").alias("applied"))


@query("r5_correlation_cut", _CAND + " SELECT instrument_id, reduced FROM dz")
def _(spark, d):
    return trading.evaluate(candidates(spark, d), LIMITS).select("instrument_id", "reduced")


@query("r6_held_value", with_tables("intents") + " SELECT account, instrument_id, round(sum(quantity * coalesce(exit_price, fill_price)), 8) AS held_value FROM intents WHERE status = 'RECONCILED' GROUP BY ALL")
def _(spark, d):
    i = fx.intents(spark, d).where("status = 'RECONCILED'")
    return rounded(i.groupBy("account", "instrument_id").agg(F.sum(F.col("quantity") * F.coalesce("exit_price", "fill_price")).alias("held_value")), 8)


@query("a9_correlated_exposure", with_tables("candles") + """, t AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY ts DESC) AS rn FROM candles QUALIFY rn <= 121),
    q AS (SELECT instrument_id, rn, close / lag(close) OVER (PARTITION BY instrument_id ORDER BY ts) - 1 AS ret FROM t), a AS (SELECT * FROM q WHERE rn <= 120), b AS (SELECT * FROM a WHERE instrument_id = 0),
    c AS (SELECT a.instrument_id, corr(a.ret, b.ret) AS r FROM a JOIN b ON a.rn = b.rn GROUP BY a.instrument_id),
    v AS (SELECT instrument_id, arg_max(close, ts) * 10 AS value FROM candles GROUP BY instrument_id)
    SELECT round(coalesce(sum(value) FILTER (WHERE r > 0.05), 0) / 1e6, 5) AS exposure FROM v JOIN c USING (instrument_id)""")
def _(spark, d):
    c = fx.candles(spark, d)
    corr = indicators.correlation(c, c.where("instrument_id = 0"), 120)
    value = bars.latest(c).select("instrument_id", (F.col("close") * 10).alias("value"))
    return rounded(value.join(corr, "instrument_id").agg((F.coalesce(F.sum(F.when(F.col("correlation") > 0.05, F.col("value"))), F.lit(0.0)) / 1e6).alias("exposure")), 5)


def contexts(spark, d):
    ind = indicators.indicators(fx.candles(spark, d), 120, ["n_bars", "last_close", "boll_low", "boll_mid", "boll_high", "rsi14", "atr14"])
    k = F.col("instrument_id")
    return ind.withColumns({"held": F.when(k % 3 == 0, 0.0).otherwise((k % 3) * 10.0), "insider_penalty": F.when(k % 4 == 1, (k % 8) / 20.0), "move_atr": F.when(k % 5 != 0, (k % 7) - 3.5)})


_CTX = with_tables("candles") + INDICATORS_CTE.replace("rn <= 300", "rn <= 120") + """, x AS (SELECT *, CASE WHEN instrument_id % 3 = 0 THEN 0 ELSE (instrument_id % 3) * 10.0::DOUBLE END AS held, CASE WHEN instrument_id % 4 = 1 THEN (instrument_id % 8) / 20.0::DOUBLE END AS pen,
      CASE WHEN instrument_id % 5 <> 0 THEN (instrument_id % 7) - 3.5::DOUBLE END AS mv FROM ind),
    s AS (SELECT *, CASE WHEN boll_mid IS NULL OR rsi14 IS NULL OR atr14 IS NULL OR NOT last_close > 0 THEN NULL WHEN held > 0 AND pen >= 0.1 AND (mv IS NULL OR mv > -1) THEN 'insider_exit'
      WHEN held <= 0 AND last_close <= boll_low * 1.6 AND rsi14 <= 55 AND atr14 / last_close >= 0.02 THEN 'entry' WHEN held > 0 AND last_close >= boll_mid THEN 'mean_exit' END AS kind FROM x)"""


@query("r10_mean_reversion_signals", _CTX.replace("boll_low * 1.6", "boll_low") + " SELECT instrument_id, kind, CASE kind WHEN 'entry' THEN 'BUY' ELSE 'SELL' END AS side, round(CASE kind WHEN 'entry' THEN least(1, 0.5 + (boll_low - last_close) / (boll_high - boll_low)) ELSE 1 END, 6)::DOUBLE AS conviction, CASE WHEN kind <> 'entry' THEN held END::DOUBLE AS target_quantity FROM s WHERE kind IS NOT NULL")
def _(spark, d):
    return rounded(trading.mean_reversion(contexts(spark, d), oversold=55.0))


@query("r11_exits", _CTX.replace("boll_low * 1.6", "boll_low") + " SELECT instrument_id, kind FROM s WHERE kind LIKE '%exit'")
def _(spark, d):
    return trading.mean_reversion(contexts(spark, d)).where("side = 'SELL'").select("instrument_id", "kind")


@query("r12_skipped_short_history", with_tables("candles") + " SELECT instrument_id, count(*) AS n_bars, 'only ' || count(*) || ' of 530 bars' AS reason FROM candles GROUP BY instrument_id HAVING count(*) < 530")
def _(spark, d):
    n = bars.counts(fx.candles(spark, d), 530).where("NOT has_history")
    return n.select("instrument_id", "n_bars", F.concat(F.lit("only "), F.col("n_bars").cast("string"), F.lit(" of 530 bars")).alias("reason"))


@query("r13_decision_outcomes", _CTX.replace("boll_low * 1.6", "boll_low") + """ SELECT instrument_id, CASE WHEN instrument_id % 23 = 1 THEN 'rejected' WHEN instrument_id % 19 = 0 AND kind = 'entry' THEN 'rejected' WHEN kind <> 'entry' AND held <= 0 THEN 'skipped' WHEN instrument_id % 2 = 0 THEN 'executed' ELSE 'proposed' END AS outcome,
    CASE WHEN kind <> 'entry' AND instrument_id % 23 <> 1 AND instrument_id % 2 = 0 THEN held END::DOUBLE AS quantity FROM s WHERE kind IS NOT NULL""")
def _(spark, d):
    c = contexts(spark, d)
    k = F.col("instrument_id")
    s = trading.mean_reversion(c, oversold=55.0).join(c.select("instrument_id", "held"), "instrument_id")
    return trading.decide(s.withColumns({"stale": k % 23 == 1, "halted": k % 19 == 0, "auto": k % 2 == 0})).select("instrument_id", "outcome", "quantity")


@query("r14_strategy_registry", _CTX.replace("boll_low * 1.6", "boll_low").replace("rsi14 <= 55", "rsi14 <= 35") + " SELECT 'mean_reversion' AS strategy, instrument_id, kind FROM s WHERE kind IS NOT NULL")
def _(spark, d):
    c = contexts(spark, d)
    made = [f(c).select(F.lit(name).alias("strategy"), "instrument_id", "kind") for name, f in trading.STRATEGIES.items()]
    out = made[0]
    for other in made[1:]:
        out = out.unionByName(other)
    return out


# --- portfolio --------------------------------------------------------------------------------------------


@query("a4_realised_pnl", with_tables("intents") + " SELECT account, CAST(closed_at AS DATE) AS day, round(sum((exit_price - fill_price) * quantity), 8) AS realised FROM intents WHERE closed_at IS NOT NULL AND exit_price IS NOT NULL AND fill_price IS NOT NULL GROUP BY ALL")
def _(spark, d):
    return rounded(trading.realised(fx.intents(spark, d)), 8)


@query("a5_trades_a_day", with_tables("intents") + " SELECT CAST(created_at AS DATE) AS day, count(*) AS trades FROM intents GROUP BY ALL")
def _(spark, d):
    return fx.intents(spark, d).groupBy(F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("trades"))


for _name, _flag, _where in (("a6_open_risk", False, ""), ("a6_open_risk_without_closed", True, " AND closed_at IS NULL")):

    @query(_name, with_tables("intents") + f" SELECT account, round(sum(greatest(fill_price - stop_price, 0) * quantity), 8) AS open_risk FROM intents WHERE status IN ('SUBMITTED', 'RECONCILED') AND stop_price IS NOT NULL AND fill_price IS NOT NULL{_where} GROUP BY account")
    def _(spark, d, flag=_flag):
        return rounded(trading.open_risk(fx.intents(spark, d), flag), 8)


def positions(spark, d):
    i = fx.intents(spark, d).where("status = 'RECONCILED' AND fill_price IS NOT NULL")
    return i.groupBy("account", "instrument_id").agg(F.sum("quantity").alias("quantity"), (F.sum(F.col("quantity") * F.col("fill_price")) / F.sum("quantity")).alias("average_price"))


_POS = ", ps AS (SELECT account, instrument_id, sum(quantity) AS quantity, sum(quantity * fill_price) / sum(quantity) AS average_price FROM intents WHERE status = 'RECONCILED' AND fill_price IS NOT NULL GROUP BY ALL), lc AS (SELECT instrument_id, arg_max(CASE WHEN instrument_id % 7 <> 2 THEN close END, ts) AS price FROM candles GROUP BY instrument_id)"


@query("po2_mark_to_market", with_tables("intents", "candles") + _POS + " SELECT account, instrument_id, quantity, round((price - average_price) * quantity, 8) AS unrealised FROM ps LEFT JOIN lc USING (instrument_id)")
def _(spark, d):
    latest = bars.latest(fx.candles(spark, d)).withColumn("close", F.when(F.col("instrument_id") % 7 != 2, F.col("close")))  # some have no price
    return rounded(trading.mark_to_market(positions(spark, d), latest).select("account", "instrument_id", "quantity", "unrealised"), 8)


@query("a7_account_totals", with_tables("intents", "candles") + _POS + " SELECT account, round(sum(quantity * coalesce(price, average_price)), 3) AS invested, round(1000 + sum(quantity * coalesce(price, average_price)), 3) AS total, round(sum(quantity * coalesce(price, average_price)) - 1000, 3) AS result FROM ps LEFT JOIN lc USING (instrument_id) GROUP BY account")
def _(spark, d):
    latest = bars.latest(fx.candles(spark, d)).withColumn("close", F.when(F.col("instrument_id") % 7 != 2, F.col("close")))  # some have no price
    totals = trading.account_totals(trading.mark_to_market(positions(spark, d), latest), F.lit(1000.0), F.lit(2000.0))
    return rounded(rounded(totals, 9), 3)  # a sum that is half a thousandth is not decided by the order of its parts


_EOD = with_tables("intents") + ", r AS (SELECT account, CAST(closed_at AS DATE) AS day, sum((exit_price - fill_price) * quantity) AS realised, count(*) AS closed FROM intents WHERE closed_at IS NOT NULL AND exit_price IS NOT NULL AND fill_price IS NOT NULL GROUP BY ALL), e AS (SELECT *, 100000 + sum(realised) OVER (PARTITION BY account ORDER BY day) AS equity FROM r)"


def end_of_day(spark, d):
    asc = Window.partitionBy("account").orderBy("day")
    return trading.realised(fx.intents(spark, d)).withColumn("equity", 100000 + F.sum("realised").over(asc))


@query("a8_end_of_day", _EOD + " SELECT account, day, round(realised, 3) AS realised, round(equity, 3) AS equity, round(equity - lag(equity) OVER (PARTITION BY account ORDER BY day), 3) AS change FROM e")
def _(spark, d):
    e = end_of_day(spark, d)
    return rounded(e.withColumn("change", F.col("equity") - F.lag("equity").over(Window.partitionBy("account").orderBy("day"))), 3)


@query("w4_equity_change", _EOD + " SELECT account, day, round(lag(equity) OVER (PARTITION BY account ORDER BY day), 3) AS previous FROM e")
def _(spark, d):
    return rounded(end_of_day(spark, d).select("account", "day", F.lag("equity").over(Window.partitionBy("account").orderBy("day")).alias("previous")), 3)


@query("a17_held_quantity", with_tables("intents") + " SELECT instrument_id, sum(quantity) AS quantity FROM intents WHERE status = 'RECONCILED' GROUP BY instrument_id")
def _(spark, d):
    return fx.intents(spark, d).where("status = 'RECONCILED'").groupBy("instrument_id").agg(F.sum("quantity").alias("quantity"))


@query("po3_close_intents", with_tables("intents") + " SELECT intent_id, CASE WHEN exit_price <= stop_price THEN 'stop' WHEN exit_price > fill_price THEN 'target' ELSE 'flatten' END AS reason, exit_price FROM intents WHERE closed_at IS NOT NULL")
def _(spark, d):
    why = F.when(F.col("exit_price") <= F.col("stop_price"), "stop").when(F.col("exit_price") > F.col("fill_price"), "target").otherwise("flatten")
    return fx.intents(spark, d).where("closed_at IS NOT NULL").select("intent_id", why.alias("reason"), "exit_price")


@query("po4_open_intents", with_tables("intents") + " SELECT intent_id, account FROM intents WHERE status = 'RECONCILED' AND closed_at IS NULL")
def _(spark, d):
    return fx.intents(spark, d).where("status = 'RECONCILED' AND closed_at IS NULL").select("intent_id", "account")


#: Each account stepped through its fills: cash, and of its five instruments the quantities and average prices.
_FOLD = """WITH RECURSIVE e AS MATERIALIZED (SELECT o_custkey AS account, (o_orderkey % 5)::INTEGER + 1 AS slot, o_orderkey % 3 <> 0 AS buy, (1 + o_orderkey % 4)::DOUBLE AS n, o_totalprice / 1000 AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nth FROM orders),
    s AS (SELECT DISTINCT account, 0::BIGINT AS nth, 1000.0::DOUBLE AS cash, [NULL, NULL, NULL, NULL, NULL]::DOUBLE[] AS held, [NULL, NULL, NULL, NULL, NULL]::DOUBLE[] AS cost, 0::BIGINT AS rejected FROM e
          UNION ALL
          SELECT account, nth, cash + CASE WHEN bought THEN -(n * p) WHEN sold THEN n * p ELSE 0 END, CASE WHEN bought OR sold THEN list_transform(range(1, 6), lambda i: CASE WHEN i = slot THEN have + CASE WHEN bought THEN n ELSE -n END ELSE held[i] END) ELSE held END,
                 CASE WHEN bought THEN list_transform(range(1, 6), lambda i: CASE WHEN i = slot THEN (have * coalesce(cost[slot], 0) + n * p) / (have + n) ELSE cost[i] END) ELSE cost END, rejected + (NOT bought AND NOT sold)::BIGINT
          FROM (SELECT e.*, s.cash, s.held, s.cost, s.rejected, coalesce(s.held[e.slot], 0) AS have, e.buy AND e.n * e.p <= s.cash AS bought, NOT e.buy AND e.n <= coalesce(s.held[e.slot], 0) AS sold FROM s JOIN e ON e.account = s.account AND e.nth = s.nth + 1)),
    z AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY account ORDER BY nth DESC) = 1)
    SELECT account, k - 1 AS instrument_id, held[k] AS quantity, cost[k] AS average_price, cash, rejected FROM z, range(1, 6) t(k) WHERE held[k] IS NOT NULL"""


@query("po1_position_fold", _FOLD)
def _(spark, d):
    k = F.col("o_orderkey")
    fills = fx.read(spark, d, "orders").select(k.alias("fill_id"), F.col("o_custkey").alias("account"), (k % 5).alias("instrument_id"), F.when(k % 3 == 0, "SELL").otherwise("BUY").alias("side"), (1 + k % 4).cast("double").alias("quantity"), (F.col("o_totalprice") / 1000).alias("price"), F.col("o_orderdate").alias("ts"))
    return trading.fold_positions(fills, 1000.0)


# --- stops ------------------------------------------------------------------------------------------------


@query("st6_protective_stops", with_tables("intents", "candles") + """, l AS (SELECT instrument_id, arg_max(low, ts) AS low FROM candles GROUP BY instrument_id), s AS (SELECT intent_id, i.instrument_id, stop_price, quantity, intent_id % 4 * 5.0::DOUBLE AS position, low FROM intents i LEFT JOIN l USING (instrument_id) WHERE stop_price IS NOT NULL)
    SELECT intent_id, CASE WHEN position <= 0 THEN 'cancelled' WHEN low <= stop_price THEN 'filled' ELSE 'open' END AS state, CASE WHEN position > 0 AND low <= stop_price THEN stop_price END AS price, CASE WHEN position > 0 AND low <= stop_price THEN least(quantity, position) END AS filled FROM s""")
def _(spark, d):
    stops = fx.intents(spark, d).where("stop_price IS NOT NULL").withColumn("position", F.col("intent_id") % 4 * 5.0)
    return trading.stop_triggers(stops, bars.latest(fx.candles(spark, d)))


@query("st7_trailing_stop", with_tables("candles") + """, p AS (SELECT *, lag(close) OVER w AS prev, row_number() OVER w AS idx FROM candles WINDOW w AS (PARTITION BY instrument_id ORDER BY ts)),
    t AS (SELECT *, CASE WHEN prev IS NOT NULL THEN greatest(high - low, abs(high - prev), abs(low - prev)) END AS tr FROM p),
    a AS (SELECT *, CASE WHEN idx >= 20 THEN close - avg(tr) OVER (PARTITION BY instrument_id ORDER BY ts ROWS 13 PRECEDING) * 0.5 END AS c FROM t)
    SELECT instrument_id, ts, round(max(CASE WHEN c > 0 THEN c END) OVER (PARTITION BY instrument_id ORDER BY ts), 5) AS stop FROM a""")
def _(spark, d):
    return rounded(trading.ratchet(fx.candles(spark, d), 0.5), 5)


@query("st8_time_stop", with_tables("intents") + " SELECT intent_id, floor((epoch(TIMESTAMP '2001-11-05') - epoch(created_at)) / 86400)::BIGINT AS days FROM intents WHERE status = 'RECONCILED' AND closed_at IS NULL AND floor((epoch(TIMESTAMP '2001-11-05') - epoch(created_at)) / 86400) >= 900")
def _(spark, d):
    return trading.time_stops(fx.intents(spark, d), AS_OF, 900).select("intent_id", "days")


@query("st14_daily_loss_guard", with_tables("intents") + ", r AS (SELECT account, CAST(closed_at AS DATE) AS day, sum((exit_price - fill_price) * quantity) AS realised FROM intents WHERE closed_at IS NOT NULL AND exit_price IS NOT NULL AND fill_price IS NOT NULL GROUP BY ALL) SELECT account, day, 'daily_loss' AS kind FROM r WHERE realised <= -500")
def _(spark, d):
    return trading.realised(fx.intents(spark, d)).where("realised <= -500").select("account", "day", F.lit("daily_loss").alias("kind"))

