"""Queries over bars, indicators and scores, with the same queries as SQL."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bars, indicators, scoring
from ..sources import fixtures as fx
from ..sources.fixtures import AS_OF, with_tables
from ..sources.scratch import folder, stored

QUERIES: dict = {}
SQL: dict[str, str] = {}
QUALITY_SQL = "CASE WHEN volume < 10 THEN 'SUSPECT' ELSE 'OK' END"


def quality():
    return F.when(F.col("volume") < 10, "SUSPECT").otherwise("OK")


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to ``digits`` places, so that engines that sum in another order agree."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- bars -------------------------------------------------------------------------------------------------


#: A table on the four-part key: daily and weekly bars, raw and adjusted, which share timestamps on Mondays. Some bars
#: are incoherent.
SERIES_CTE = with_tables("candles").removeprefix("WITH ") + """,
    wk AS (SELECT instrument_id, date_trunc('week', ts) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM candles GROUP BY ALL),
    iv AS (SELECT '1d' AS "interval", * FROM candles UNION ALL SELECT '1w', * FROM wk),
    sr AS (SELECT 'raw' AS series_type, * REPLACE (CASE WHEN day(ts) = 13 THEN low / 2 ELSE high END AS high) FROM iv UNION ALL SELECT 'adjusted', * REPLACE (open / 2 AS open, high / 2 AS high, low / 2 AS low, close / 2 AS close) FROM iv),
    sq AS (SELECT *, CASE WHEN high >= low AND high >= open AND high >= close AND low <= open AND low <= close AND open > 0 AND close > 0 THEN 'OK' ELSE 'SUSPECT' END AS quality FROM sr)"""


def series(daily):
    week = F.date_trunc("week", "ts")
    weekly = daily.groupBy("instrument_id", week.alias("w")).agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume")).withColumnRenamed("w", "ts")
    both = daily.withColumn("interval", F.lit("1d")).unionByName(weekly.withColumn("interval", F.lit("1w")))
    price = ("open", "high", "low", "close")
    raw = F.struct(F.lit("raw").alias("series_type"), *[F.when(F.dayofmonth("ts") == 13, F.col("low") / 2).otherwise(F.col("high")).alias(c) if c == "high" else F.col(c) for c in price])
    adjusted = F.struct(F.lit("adjusted").alias("series_type"), *[(F.col(c) / 2).alias(c) for c in price])
    each = both.select("instrument_id", "interval", "ts", "volume", F.inline(F.array(raw, adjusted)))
    return bars.with_quality(each)


def stored_series(spark, d):
    """``series`` as a table cut by interval and series type: four cuts, which every task writes its rows of."""
    rows, path = series(fx.candles(spark, d)), folder(spark, "series")
    rows.write.partitionBy("interval", "series_type").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


_ASKED = (("1d", "raw", False, 100), ("1w", "adjusted", True, 40), ("1d", "adjusted", True, 5), ("1w", "raw", True, None))


@query("s1_candle_scan", f"WITH {SERIES_CTE}" + " UNION ALL ".join(f"""
    (SELECT "interval", series_type, instrument_id, ts, open, high, low, close, volume FROM sq WHERE "interval" = '{i}' AND series_type = '{t}' AND ts >= TIMESTAMP '1998-01-01' AND ts <= TIMESTAMP '2001-06-30' {"AND quality = 'OK'" if ok else ""}
     AND ts + INTERVAL {1 if i == "1d" else 7} DAY <= TIMESTAMP '2001-06-28' {f"QUALIFY row_number() OVER (PARTITION BY instrument_id ORDER BY ts DESC) <= {n}" if n else ""})""" for i, t, ok, n in _ASKED))  # fmt: skip
def _(spark: SparkSession, d: str) -> DataFrame:
    table = stored_series(spark, d)
    found = [bars.scan(table, "1998-01-01", "2001-06-30", n, as_of="2001-06-28", interval=i, series_type=t, tradable_only=ok) for i, t, ok, n in _ASKED]
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out.select("interval", "series_type", "instrument_id", "ts", "open", "high", "low", "close", "volume")


@query("s2_latest_candle", with_tables("candles") + "SELECT instrument_id, max(ts) AS ts, arg_max(open, ts) AS open, arg_max(high, ts) AS high, arg_max(low, ts) AS low, arg_max(close, ts) AS close, arg_max(volume, ts) AS volume FROM candles GROUP BY instrument_id")
def _(spark, d):
    return bars.latest(fx.candles(spark, d))


@query("s3_latest_timestamps", "SELECT l_suppkey AS instrument_id, max(l_shipdate) AS latest_ts FROM lineitem GROUP BY l_suppkey")
def _(spark, d):
    return bars.latest_times(fx.read(spark, d, "lineitem").select(F.col("l_suppkey").alias("instrument_id"), F.col("l_shipdate").alias("ts")))


@query("s4_candle_counts", "SELECT l_suppkey AS instrument_id, count(DISTINCT l_shipdate) AS n_bars, count(DISTINCT l_shipdate) >= 530 AS has_history FROM lineitem GROUP BY l_suppkey")
def _(spark, d):
    return bars.counts(fx.candles(spark, d), 530)


@query("s5_candle_upsert", f"""WITH {SERIES_CTE}, o AS (SELECT instrument_id, "interval", ts, series_type, open, high, low, close, 'USD' AS currency, quality, TIMESTAMP '2001-09-01' AS retrieved_at FROM sq WHERE ts < TIMESTAMP '2001-09-01'),
    n AS (SELECT instrument_id, "interval", ts, series_type, open, high, low, CASE WHEN day(ts) % 5 = 0 THEN high * 2 ELSE close END AS close, 'GBP' AS currency, TIMESTAMP '2001-11-05' AS retrieved_at FROM sq WHERE ts >= TIMESTAMP '2001-08-15' AND series_type = 'raw'),
    m AS (SELECT *, CASE WHEN high >= low AND high >= open AND high >= close AND low <= open AND low <= close AND open > 0 AND close > 0 THEN 'OK' ELSE 'SUSPECT' END AS quality FROM n)
    SELECT instrument_id, "interval", ts, series_type, coalesce(m.close, o.close) AS close, coalesce(o.currency, m.currency) AS currency, coalesce(m.quality, o.quality) AS quality, coalesce(m.retrieved_at, o.retrieved_at) AS retrieved_at
    FROM o FULL JOIN m USING (instrument_id, "interval", ts, series_type)""")
def _(spark, d):
    s = series(stored(fx.candles(spark, d), "daily"))
    at = lambda df, currency, when: df.withColumns({"currency": F.lit(currency), "retrieved_at": F.lit(when).cast("timestamp")})
    corrected = F.when(F.dayofmonth("ts") % 5 == 0, F.col("high") * 2).otherwise(F.col("close"))
    batch = s.where("ts >= TIMESTAMP '2001-08-15' AND series_type = 'raw'").withColumn("close", corrected)
    out = bars.upsert(at(s.where("ts < TIMESTAMP '2001-09-01'"), "USD", "2001-09-01"), bars.with_quality(at(batch, "GBP", "2001-11-05")), first_wins=("currency",))
    return out.select("instrument_id", "interval", "ts", "series_type", "close", "currency", "quality", "retrieved_at")


@query("s6_purge_unclosed", with_tables("candles") + "SELECT instrument_id, ts, close FROM candles WHERE ts + INTERVAL 1 DAY <= TIMESTAMP '2001-10-15 12:00:00'")
def _(spark, d):
    return bars.purge_unclosed(fx.candles(spark, d), "2001-10-15 12:00:00").select("instrument_id", "ts", "close")


@query("s7_mark_stale", with_tables("candles") + f"SELECT instrument_id, ts, CASE WHEN ts < TIMESTAMP '1997-01-01' AND {QUALITY_SQL} = 'OK' THEN 'STALE' ELSE {QUALITY_SQL} END AS quality FROM candles")
def _(spark, d):
    return bars.mark_stale(fx.candles(spark, d).select("instrument_id", "ts", quality().alias("quality")), "1997-01-01")


@query("s21_chart_export", with_tables("candles") + "SELECT instrument_id, ts, open, high, low, close, volume FROM candles QUALIFY row_number() OVER (PARTITION BY instrument_id ORDER BY ts DESC) <= 20")
def _(spark, d):
    return bars.scan(fx.candles(spark, d), limit=20, closed_only=False)


@query("s22_sample_scan", with_tables("instruments") + "SELECT instrument_id, ticker FROM instruments ORDER BY md5(CAST(instrument_id AS VARCHAR) || 'seed'), instrument_id LIMIT 7")
def _(spark, d):
    return bars.sample(fx.instruments(spark, d), 7, "seed").select("instrument_id", "ticker")


@query("f1_coherent_bars", with_tables("candles") + "SELECT count(*) AS n, count(*) FILTER (WHERE high >= low AND high >= open AND high >= close AND low <= open AND low <= close AND open > 0 AND close > 0) AS n_coherent FROM candles")
def _(spark, d):
    return fx.candles(spark, d).agg(F.count(F.lit(1)).alias("n"), F.count_if(bars.coherent()).alias("n_coherent"))


@query("f2_bar_closed", with_tables("candles") + "SELECT instrument_id, count(*) FILTER (WHERE ts + INTERVAL 7 DAY <= TIMESTAMP '2001-10-01') AS n_closed FROM candles GROUP BY instrument_id")
def _(spark, d):
    closed = bars.is_closed(F.col("ts"), F.lit("1w"), F.lit("2001-10-01").cast("timestamp"))
    return fx.candles(spark, d).groupBy("instrument_id").agg(F.count_if(closed).alias("n_closed"))


@query("f17_annualisation", "SELECT DISTINCT o_orderpriority AS priority, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 252 WHEN '2' THEN 52 WHEN '3' THEN 1764 WHEN '4' THEN 6552 ELSE 252 END AS factor FROM orders")
def _(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ["1d", "1w", "1h", "15m", "none"])), F.substring("o_orderpriority", 1, 1).cast("int"))
    return fx.read(spark, d, "orders").select(F.col("o_orderpriority").alias("priority"), bars.annualisation(kind).alias("factor")).distinct()


@query("a1_coverage_summary", with_tables("candles") + f"""
    SELECT instrument_id, count(*) AS n_bars, min(ts) AS first_ts, max(ts) AS last_ts, count(*) FILTER (WHERE {QUALITY_SQL} <> 'OK') AS not_ok,
           CAST(epoch(TIMESTAMP '2001-11-05') - epoch(max(ts)) AS BIGINT) AS age_seconds FROM candles GROUP BY instrument_id""")
def _(spark, d):
    return bars.coverage(fx.candles(spark, d).withColumn("quality", quality()), AS_OF)


_FRESH = with_tables("candles") + f""", q AS (SELECT instrument_id, max(ts) AS last_ts, arg_max({QUALITY_SQL}, ts) AS quality FROM candles GROUP BY instrument_id),
    f AS (SELECT p_partkey AS instrument_id, coalesce(last_ts < TIMESTAMP '2001-11-05' - INTERVAL 5 DAY, true) AS is_stale,
          CASE WHEN last_ts IS NULL THEN 'UNAVAILABLE' WHEN last_ts < TIMESTAMP '2001-11-05' - INTERVAL 5 DAY THEN 'STALE' ELSE quality END AS freshness FROM part LEFT JOIN q ON p_partkey = instrument_id)"""


def _freshness(spark, d):
    own = fx.candles(spark, d).withColumn("quality", quality())
    listed = fx.read(spark, d, "part").select(F.col("p_partkey").alias("instrument_id"))  # most of which have no bars
    return bars.freshness(listed, own, AS_OF, 5)


@query("p2_is_stale", _FRESH + "SELECT instrument_id, is_stale FROM f")
def _(spark, d):
    return _freshness(spark, d).select("instrument_id", "is_stale")


@query("p3_assess_freshness", _FRESH + "SELECT instrument_id, freshness FROM f")
def _(spark, d):
    return _freshness(spark, d).select("instrument_id", "freshness")


@query("a11_stale_count", _FRESH + "SELECT count(*) AS n, count(*) FILTER (WHERE is_stale) AS n_stale FROM f")
def _(spark, d):
    return _freshness(spark, d).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_stale").alias("n_stale"))


@query("p7_scannable", "SELECT l_suppkey AS instrument_id FROM lineitem WHERE l_shipdate + INTERVAL 1 DAY <= TIMESTAMP '2001-11-05' GROUP BY l_suppkey HAVING count(DISTINCT l_shipdate) >= 30")
def _(spark, d):
    return bars.counts(bars.purge_unclosed(fx.candles(spark, d), AS_OF), 30).where("has_history").select("instrument_id")


@query("u5_gaps", with_tables("candles") + """, days AS (SELECT DISTINCT l_shipdate AS ts FROM lineitem)
    SELECT s_suppkey AS instrument_id, d.ts FROM supplier CROSS JOIN days d LEFT JOIN candles c ON c.instrument_id = s_suppkey AND c.ts = d.ts WHERE c.ts IS NULL""")
def _(spark, d):
    days = fx.read(spark, d, "lineitem").select(F.col("l_shipdate").alias("ts")).distinct()
    calendar = days.agg(F.collect_list("ts").alias("days"))  # a calendar: one entry a day
    schedule = fx.instruments(spark, d).select("instrument_id").join(F.broadcast(calendar), F.lit(True)).select("instrument_id", F.explode("days").alias("ts"))
    return bars.gaps(fx.candles(spark, d), schedule)


@query("w3_recency_rank", with_tables("candles") + "SELECT instrument_id, ts, row_number() OVER (PARTITION BY instrument_id ORDER BY ts DESC)::INTEGER AS rn FROM candles")
def _(spark, d):
    return bars.newest_first(fx.candles(spark, d)).select("instrument_id", "ts", "rn")


def breadth(spark: SparkSession, d: str) -> DataFrame:
    """Share of eligible instruments whose last close is above the mean of their last 200 closes."""
    ranked = bars.newest_first(fx.candles(spark, d).select("instrument_id", "ts", "close"), 200)
    eligible = fx.instruments(spark, d).where("scanner_eligible AND NOT suspended").select("instrument_id")
    one = ranked.join(eligible, "instrument_id").groupBy("instrument_id")
    per = one.agg(F.max(F.when(F.col("rn") == 1, F.col("close"))).alias("last"), F.avg("close").alias("mean"), F.count(F.lit(1)).alias("n")).where("n = 200")
    out = per.agg(F.count(F.lit(1)).alias("n_instruments"), F.count_if(F.col("last") > F.col("mean")).alias("n_above"))
    return out.withColumn("breadth", F.when(F.col("n_instruments") > 0, F.col("n_above") / F.col("n_instruments")))


#: The last close and the mean of 200 closes of each eligible instrument (br)
BREADTH_CTE = with_tables("candles", "instruments").removeprefix("WITH ") + """,
    e200 AS (SELECT instrument_id, close, row_number() OVER (PARTITION BY instrument_id ORDER BY ts DESC) AS rn FROM candles JOIN instruments USING (instrument_id) WHERE scanner_eligible AND NOT suspended),
    br AS (SELECT instrument_id, max(close) FILTER (WHERE rn = 1) AS last, avg(close) AS mean FROM e200 WHERE rn <= 200 GROUP BY instrument_id HAVING count(*) = 200)"""
query("a2_market_breadth", f"WITH {BREADTH_CTE} SELECT count(*) AS n_instruments, count(*) FILTER (WHERE last > mean) AS n_above, CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE last > mean) / count(*) END AS breadth FROM br")(breadth)


# --- indicators -------------------------------------------------------------------------------------------

LOADED = """,
    b AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY ts DESC) AS rn FROM candles QUALIFY rn <= 300),
    l AS (SELECT *, lag(close) OVER w AS prev, row_number() OVER w AS idx, count(*) OVER (PARTITION BY instrument_id) AS n FROM b WINDOW w AS (PARTITION BY instrument_id ORDER BY ts)),
    r AS (SELECT *, CASE WHEN prev <> 0 THEN close / prev - 1 END AS ret, CASE WHEN prev IS NOT NULL THEN greatest(high - low, abs(high - prev), abs(low - prev)) END AS tr,
          CASE WHEN idx >= 50 THEN avg(close) OVER (PARTITION BY instrument_id ORDER BY ts ROWS 49 PRECEDING) END AS sma50,
          CASE WHEN idx >= 200 THEN avg(close) OVER (PARTITION BY instrument_id ORDER BY ts ROWS 199 PRECEDING) END AS sma200,
          max(CASE WHEN rn <= 252 THEN close END) OVER w AS peak252, max(CASE WHEN rn <= 60 THEN close END) OVER w AS peak60, max(CASE WHEN rn <= 20 THEN close END) OVER w AS peak20,
          CASE WHEN idx <= 15 THEN n - 15 ELSE n - idx END AS pow0, CASE WHEN idx <= 15 THEN n - 25 WHEN idx <= n - 10 THEN n - 10 - idx END AS pow10 FROM l WINDOW w AS (PARTITION BY instrument_id ORDER BY ts))"""


def _rsi_sql(power: str, need: int) -> str:
    side = lambda move: f"sum(pow(13 / 14::DOUBLE, {power}) / 14 * greatest({move}, 0)) FILTER (WHERE prev IS NOT NULL AND {power} IS NOT NULL)"
    gain, loss = side("close - prev"), side("prev - close")
    return f"CASE WHEN max(n) >= {need} THEN CASE WHEN {loss} = 0 THEN 100 ELSE 100 - 100 / (1 + {gain} / {loss}) END END"


def _ret_sql(k: int) -> str:
    past = f"max(close) FILTER (WHERE rn = {k + 1})"
    return f"CASE WHEN {past} > 0 THEN max(close) FILTER (WHERE rn = 1) / {past} - 1 END"


def _slope_sql(s: str) -> str:
    level = f"max({s}) FILTER (WHERE rn = 1)"
    return f"CASE WHEN count({s}) FILTER (WHERE rn <= 21) >= 2 AND {level} > 0 THEN regr_slope({s}, idx) FILTER (WHERE rn <= 21) / {level} END"


_F = lambda p: f"FILTER (WHERE rn <= {p})"
_HI, _LO, _NOW = f"max(close) {_F(252)}", f"min(close) {_F(252)}", f"max(close) {_F(1)}"
_MEAN, _SD = f"avg(close) {_F(20)}", f"stddev_pop(close) {_F(20)}"
_MOVES = f"max(n) >= 20 AND {_SD} > 0"
INDICATOR_SQL = {
    "n_bars": "max(n)", "last_ts": "max(ts)", "last_close": _NOW, "sma20": f"CASE WHEN max(n) >= 20 THEN {_MEAN} END", "sma50": f"max(sma50) {_F(1)}", "sma200": f"max(sma200) {_F(1)}",
    **{f"ret{k}": _ret_sql(k) for k in (21, 63, 126, 252)},
    "vol20": f"CASE WHEN max(n) >= 21 THEN stddev_samp(ret) {_F(20)} * sqrt(252) END", "vol60": f"CASE WHEN max(n) >= 61 THEN stddev_samp(ret) {_F(60)} * sqrt(252) END",
    **{f"downside{p}": f"CASE WHEN max(n) > {p} THEN sqrt(avg(pow(least(ret, 0), 2)) {_F(p)}) * sqrt(252) END" for p in (20, 60)},
    **{f"drawdown{p}": f"CASE WHEN max(n) >= 2 THEN max(CASE WHEN peak{p} > 0 THEN (peak{p} - close) / peak{p} ELSE 0 END) {_F(p)} END" for p in (20, 60, 252)},
    "worst_day252": f"CASE WHEN max(n) >= 2 THEN greatest(-min(ret) {_F(252)}, 0) END", "avg_volume20": f"CASE WHEN max(n) >= 20 THEN avg(volume) {_F(20)} END",
    "avg_traded20": f"CASE WHEN max(n) >= 20 THEN avg(close * volume) {_F(20)} END", "zero_volume20": "count(*) FILTER (WHERE rn <= 20 AND volume = 0)",
    "stale_price20": "count(*) FILTER (WHERE rn <= 20 AND close = prev)", "slope50": _slope_sql("sma50"), "slope200": _slope_sql("sma200"), "rsi14": _rsi_sql("pow0", 15),
    "rsi14_10_ago": _rsi_sql("pow10", 25), "from_high": f"CASE WHEN {_HI} > 0 THEN ({_HI} - {_NOW}) / ({_HI}) END", "from_low": f"CASE WHEN {_LO} > 0 THEN ({_NOW} - {_LO}) / ({_LO}) END",
    "range_position": f"CASE WHEN max(n) >= 2 AND {_HI} > {_LO} THEN ({_NOW} - {_LO}) / ({_HI} - {_LO}) END", "atr14": f"CASE WHEN max(n) >= 15 THEN avg(tr) {_F(14)} END",
    "boll_mid": f"CASE WHEN {_MOVES} THEN {_MEAN} END", "boll_low": f"CASE WHEN {_MOVES} THEN {_MEAN} - 2 * {_SD} END", "boll_high": f"CASE WHEN {_MOVES} THEN {_MEAN} + 2 * {_SD} END",
    "boll_position": f"CASE WHEN {_MOVES} THEN ({_NOW} - ({_MEAN} - 2 * {_SD})) / (4 * {_SD}) END", "low20": f"min(close) {_F(20)}",
}
INDICATORS_CTE = LOADED + ",\n ind AS (SELECT instrument_id, " + ", ".join(f"{v} AS {k}" for k, v in INDICATOR_SQL.items()) + " FROM r GROUP BY instrument_id)"
_DIGITS = {"avg_traded20": 3}


def _indicator_query(name: str, columns: Iterable[str]) -> None:
    columns = list(columns)

    def run(spark: SparkSession, d: str) -> DataFrame:
        out = indicators.indicators(fx.candles(spark, d), 300, columns)
        return out.select("instrument_id", *[F.round(c, _DIGITS.get(c, 6)).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes[1:]])

    whole = {"n_bars", "zero_volume20", "stale_price20"}
    cols = ", ".join(f"{c}" if c in whole else f"round({c}, {_DIGITS.get(c, 6)}) AS {c}" for c in columns)
    query(name, with_tables("candles") + INDICATORS_CTE + f" SELECT instrument_id, {cols} FROM ind")(run)


for _name, _columns in {
    "i1_simple_moving_average": ["sma20", "sma50", "sma200"], "i4_trailing_return": ["ret21", "ret63", "ret126", "ret252"], "i5_annualised_volatility": ["vol20", "vol60"], "i6_downside_deviation": ["downside20", "downside60"],
    "i7_max_drawdown": ["drawdown20", "drawdown60", "drawdown252"], "i8_largest_daily_loss": ["worst_day252"], "i9_average_volume": ["avg_volume20"], "i10_average_traded_value": ["avg_traded20"],
    "i11_zero_volume_days": ["zero_volume20"], "i12_stale_price_days": ["stale_price20"], "i13_sma_slope": ["slope50", "slope200"], "i14_rsi": ["rsi14", "rsi14_10_ago"], "i15_distance_from_high": ["from_high"],
    "i16_distance_from_low": ["from_low"], "i17_position_in_range": ["range_position"], "i18_average_true_range": ["atr14"], "i19_bollinger_bands": ["boll_low", "boll_mid", "boll_high"], "i20_bollinger_position": ["boll_position"],
}.items():
    _indicator_query(_name, _columns)


@query("i2_sma_series", with_tables("candles") + LOADED + " SELECT instrument_id, ts, round(sma50, 6) AS sma FROM r")
def _(spark, d):
    return rounded(indicators.moving_averages(fx.candles(spark, d), 50))


@query("i3_daily_returns", with_tables("candles") + LOADED + " SELECT instrument_id, ts, round(ret, 6) AS ret FROM r WHERE prev IS NOT NULL")
def _(spark, d):
    return rounded(indicators.daily_returns(fx.candles(spark, d)))


@query("i21_relative_momentum", with_tables("candles") + INDICATORS_CTE + " SELECT i.instrument_id, round(i.ret126 - b.ret126, 6) AS relative_momentum FROM ind i, (SELECT ret126 FROM ind WHERE instrument_id = 0) b")
def _(spark, d):
    ind = indicators.indicators(fx.candles(spark, d), 300, ["ret126"])
    bench = ind.where("instrument_id = 0").select(F.col("ret126").alias("b"))
    return rounded(ind.join(F.broadcast(bench), F.lit(True)).select("instrument_id", (F.col("ret126") - F.col("b")).alias("relative_momentum")))


for _name, _align, _on in (("i22_rolling_correlation", "position", "a.rn = b.rn"), ("j6_date_aligned_correlation", "date", "a.ts = b.ts")):

    @query(_name, with_tables("candles") + f""", t AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY ts DESC) AS rn FROM candles QUALIFY rn <= 121),
        q AS (SELECT instrument_id, ts, rn, close / lag(close) OVER (PARTITION BY instrument_id ORDER BY ts) - 1 AS ret FROM t),
        a AS (SELECT * FROM q WHERE rn <= 120), b AS (SELECT * FROM a WHERE instrument_id = 0)
        SELECT a.instrument_id, round(CASE WHEN stddev_pop(a.ret) > 0 AND stddev_pop(b.ret) > 0 AND count(b.ret) >= 120 THEN corr(a.ret, b.ret) END, 6) AS correlation FROM a JOIN b ON {_on} GROUP BY a.instrument_id""")
    def _(spark, d, align=_align):
        c = fx.candles(spark, d)
        return rounded(indicators.correlation(c, c.where("instrument_id = 0"), 120, align))


@query("w8_positional_tail", with_tables("candles") + """, t AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY ts DESC) AS rn FROM candles QUALIFY rn <= 21),
    q AS (SELECT instrument_id, ts, rn, close / lag(close) OVER (PARTITION BY instrument_id ORDER BY ts) - 1 AS ret FROM t) SELECT instrument_id, ts, rn::INTEGER AS nth, round(ret, 6) AS ret FROM q WHERE rn <= 20""")
def _(spark, d):
    rows = bars.newest_first(indicators.daily_returns(fx.candles(spark, d), 21))
    return rounded(rows.where("rn <= 20").select("instrument_id", "ts", F.col("rn").alias("nth"), "ret"))


@query("i23_preferred_close", with_tables("candles") + """, t AS (SELECT *, CASE WHEN instrument_id % 2 = 0 OR volume >= 10 THEN close * 0.5 END AS adj, row_number() OVER (PARTITION BY instrument_id ORDER BY ts DESC) AS rn FROM candles QUALIFY rn <= 300)
    SELECT instrument_id, ts, CASE WHEN count(adj) OVER (PARTITION BY instrument_id) = count(*) OVER (PARTITION BY instrument_id) THEN adj ELSE close END AS preferred FROM t""")
def _(spark, d):
    adjusted = F.when((F.col("instrument_id") % 2 == 0) | (F.col("volume") >= 10), F.col("close") * 0.5)
    return indicators.preferred_close(fx.candles(spark, d).withColumn("adjusted_close", adjusted))


@query("i24_series_arrays", with_tables("candles") + LOADED + """, s AS (SELECT instrument_id, list(ts ORDER BY ts) AS ts, list(close ORDER BY ts) AS close, list(volume ORDER BY ts) AS volume FROM r GROUP BY instrument_id)
    SELECT instrument_id, len(close)::INTEGER AS n, ts[1] AS first_ts, ts[-1] AS last_ts, close[1] AS first_close, close[-1] AS last_close, round(list_sum([close[i] * i FOR i IN range(1, len(close) + 1)]), 2) AS weighted_close, round(list_sum([volume[i] * i FOR i IN range(1, len(volume) + 1)]), 2) AS weighted_volume FROM s""")
def _(spark, d):
    s = indicators.series(fx.candles(spark, d))
    weighted = lambda c: F.round(F.aggregate(F.transform(c, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x), 2)
    return s.select("instrument_id", F.size("close").alias("n"), F.col("ts")[0].alias("first_ts"), F.element_at("ts", -1).alias("last_ts"), F.col("close")[0].alias("first_close"), F.element_at("close", -1).alias("last_close"), weighted("close").alias("weighted_close"), weighted("volume").alias("weighted_volume"))


@query("i25_cross_state", with_tables("candles") + INDICATORS_CTE + " SELECT instrument_id, sma50 > sma200 AS golden, round(last_close / sma200 - 1, 6) AS distance FROM ind")
def _(spark, d):
    ind = indicators.indicators(fx.candles(spark, d), 300, ["sma50", "sma200", "last_close"])
    return rounded(ind.select("instrument_id", (F.col("sma50") > F.col("sma200")).alias("golden"), (F.col("last_close") / F.col("sma200") - 1).alias("distance")))


@query("w6_running_peak", with_tables("candles") + LOADED + " SELECT instrument_id, ts, peak252 AS peak FROM r")
def _(spark, d):
    return indicators.loaded(fx.candles(spark, d)).select("instrument_id", "ts", F.col("peak252").alias("peak"))


# --- scores -----------------------------------------------------------------------------------------------

_C = lambda x: f"CASE WHEN ({x}) IS NOT NULL THEN greatest(0, least(1, {x})) END"
_B = lambda t: f"CASE WHEN {t} THEN 1.0::DOUBLE WHEN NOT ({t}) THEN 0.0::DOUBLE END"
# strength, whether it is positive, and the text of every signal
_PCT = lambda x, form="%.1f%%", n=1: f"printf('{form}', round_even(({x}) * 100, {n}))"
_WHOLE = lambda x: f"format('{{:,}}', round_even({x}, 0)::BIGINT)"
_EITHER = lambda t, yes, no, strength=None: (strength or _B(t), t, f"CASE WHEN {t} THEN '{yes}' ELSE '{no}' END")
_UP = lambda x, name: (_C(f"0.5 + ({x}) / 0.4::DOUBLE"), f"({x}) > 0", f"'{name} is ' || {_PCT(x, '%+.1f%%')}")
_SAFE = lambda x, bad, name: (_C(f"1 - {x} / {bad}::DOUBLE"), f"{_C(f'1 - {x} / {bad}::DOUBLE')} >= 0.5", f"'{name} is ' || {_PCT(x)}")
SIGNALS_SQL = {
    "trend": {"price_above_sma50": _EITHER("last_close > sma50", "Price is above its 50-day average", "Price is below its 50-day average"),
              "price_above_sma200": _EITHER("last_close > sma200", "Price is above its 200-day average", "Price is below its 200-day average"),
              "sma50_above_sma200": _EITHER("sma50 > sma200", "50-day average is above the 200-day average", "50-day average is below the 200-day average"),
              "sma200_slope": _EITHER("slope200 > 0", "Long-term trend is rising", "Long-term trend is falling", _C("0.5 + slope200 / 0.002::DOUBLE"))},
    "momentum": {"return_1m": _UP("ret21", "1m return"), "return_3m": _UP("ret63", "3m return"), "return_6m": _UP("ret126", "6m return"), "return_12m": _UP("ret252", "12m return"),
                 "relative_momentum_12m": _UP("ret252 - bench_ret252", "12-month return vs benchmark"), "relative_momentum_vs_sector": _UP("ret252 - sector_ret252", "12-month return vs its sector")},
    "risk": {"volatility_20d": _SAFE("vol20", 0.6, "20-day volatility"), "volatility_60d": _SAFE("vol60", 0.6, "60-day volatility"), "max_drawdown_1y": _SAFE("drawdown252", 0.5, "1-year max drawdown"),
             "downside_deviation_60d": _SAFE("downside60", 0.4, "downside deviation"), "largest_daily_loss_1y": _SAFE("worst_day252", 0.2, "largest 1-day loss")},
    "liquidity": {"avg_traded_value_20d": (_C("CASE WHEN avg_traded20 IS NOT NULL THEN log10(greatest(avg_traded20, 1)) / 6 END"), "log10(greatest(avg_traded20, 1)) / 6 >= 0.5", f"'20-day average traded value is ' || {_WHOLE('avg_traded20')}"),
                  "avg_volume_20d": (_C("avg_volume20 / 1e6"), "avg_volume20 >= 100000", f"'20-day average volume is ' || {_WHOLE('avg_volume20')}"),
                  "zero_volume_days_20d": (_C("1 - zero_volume20 / 5.0::DOUBLE"), "zero_volume20 = 0", "zero_volume20 || ' zero-volume day(s) in 20'"),
                  "stale_price_days_20d": (_C("1 - stale_price20 / 5.0::DOUBLE"), "stale_price20 <= 1", "stale_price20 || ' stale-price day(s) in 20'")},
    "positioning": {"distance_from_52w_high": (_C("1 - from_high / 0.5::DOUBLE"), "from_high < 0.25", f"{_PCT('from_high')} || ' below the 52-week high'"),
                    "position_in_52w_range": (_C("range_position"), "range_position >= 0.5", f"'At the ' || {_PCT('range_position', '%.0f%%', 0)} || ' mark of its 52-week range'"),
                    "distance_from_52w_low": (_C("from_low"), "from_low > 0.2", f"{_PCT('from_low')} || ' above the 52-week low'")},
    "sector": {"sector_above_200d": _EITHER("sector_close > sector_sma200", "Sector is above its 200-day average", "Sector is below its 200-day average"),
               "sector_trend_rising": _EITHER("sector_slope200 > 0", "Sector trend is rising", "Sector trend is falling", _C("0.5 + sector_slope200 / 0.002::DOUBLE")),
               "sector_momentum_3m": _UP("sector_ret63", "Sector 3m return"), "sector_momentum_6m": _UP("sector_ret126", "Sector 6m return")},
}
SIGNAL_SQL = {c: {k: v[0] for k, v in own.items()} for c, own in SIGNALS_SQL.items()}
_M = lambda xs: f"list_avg([x FOR x IN [{', '.join(xs)}] IF x IS NOT NULL])"
_POINTS = {k: f"{scoring.CATEGORY_MAX[k]}::DOUBLE * coalesce({_M(v.values())}, 0.5)" for k, v in SIGNAL_SQL.items()}
_KNOWN = " + ".join(f"(({x}) IS NOT NULL)::INT" for v in SIGNAL_SQL.values() for x in v.values())
_TURN = "0.5 + (rsi14 - rsi14_10_ago) / 20"
_PARTS = {
    "reversal_score": [_C(f"({_C(_TURN)}) + CASE WHEN rsi14_10_ago < 40 AND rsi14 < 60 THEN 0.2::DOUBLE ELSE 0 END"), _C("0.5 + (last_close / sma20 - 1) / 0.1::DOUBLE"), f"CASE WHEN ret126 < 0 THEN {_C('ret21 / 0.1::DOUBLE')} END",
                       f"CASE WHEN from_low <= 0.15 THEN {_C('from_low / 0.15::DOUBLE')} ELSE {_C('1 - (from_low - 0.15::DOUBLE) / 0.35::DOUBLE')} END", f"CASE WHEN downside60 > 0 THEN {_C('1 - downside20 / downside60')} END"],
    "price_value": [_C("from_high / 0.4::DOUBLE"), _C("1 - range_position"), _C("0.5 + (CASE WHEN sma200 > 0 THEN 1 - last_close / sma200 END) / 0.4::DOUBLE"), _C("(70 - rsi14) / 40")],
    "fundamental_value": [f"CASE WHEN trailing_pe > 0 THEN {_C('1 / trailing_pe / 0.1::DOUBLE')} END", f"CASE WHEN price_to_book > 0 THEN {_C('1 - (price_to_book - 1) / 4')} END",
                          f"CASE WHEN trailing_pe > 0 AND price_to_book > 0 THEN {_C('(1 - sqrt(trailing_pe * price_to_book / 22.5::DOUBLE)) / 0.5::DOUBLE')} END",
                          f"CASE WHEN trailing_pe > 0 AND earnings_growth > 0 THEN {_C('(2 - trailing_pe / (100 * earnings_growth)) / 1.5::DOUBLE')} END", f"CASE WHEN dividend_yield >= 0 THEN {_C('dividend_yield / 0.04::DOUBLE')} END"],
    "fundamental_quality": [f"CASE WHEN trailing_pe > 0 THEN {_C('1 - (trailing_pe - 10) / 30')} END", _C("profit_margin / 0.3::DOUBLE"), _C("0.5 + revenue_growth / 0.4::DOUBLE"), f"CASE WHEN debt_to_equity >= 0 THEN {_C('1 - debt_to_equity / 200')} END"],
}
SCORES_CTE = INDICATORS_CTE + f""",
    proxies AS (SELECT sector, min(instrument_id) AS proxy_id FROM instruments GROUP BY sector),
    proxy AS (SELECT sector, last_close AS sector_close, sma200 AS sector_sma200, slope200 AS sector_slope200, ret63 AS sector_ret63, ret126 AS sector_ret126, ret252 AS sector_ret252 FROM ind JOIN proxies ON instrument_id = proxy_id WHERE n_bars >= 30),
    ctx AS (SELECT ind.*, sector, sector_close, sector_sma200, sector_slope200, sector_ret63, sector_ret126, sector_ret252, bench_ret252 FROM ind JOIN instruments USING (instrument_id) LEFT JOIN proxy USING (sector)
            LEFT JOIN (SELECT ret252 AS bench_ret252 FROM ind WHERE instrument_id = 0) ON true WHERE n_bars >= 30),
    fund AS (SELECT instrument_id, arg_max(trailing_pe, as_of) FILTER (WHERE true) AS x FROM fundamentals GROUP BY instrument_id),
    f AS (SELECT * FROM fundamentals WHERE as_of <= DATE '2001-11-05' QUALIFY row_number() OVER (PARTITION BY instrument_id ORDER BY as_of DESC) = 1),
    core AS (SELECT ctx.*, {', '.join(f'{v} AS {k}_points' for k, v in _POINTS.items())}, ({_KNOWN}) / 26.0::DOUBLE AS completeness FROM ctx),
    s AS (SELECT core.*, f.* EXCLUDE (instrument_id), trend_points + momentum_points + risk_points + liquidity_points + positioning_points + sector_points AS core_score,
          0.5 * completeness + 0.5 * least(1, n_bars / 252.0::DOUBLE) AS confidence, 100 * {_M(_PARTS['reversal_score'])} AS reversal_score, coalesce(100 * {_M(_PARTS['price_value'])}, 50) AS price_value,
          100 * {_M(_PARTS['fundamental_value'])} AS fundamental_value, 100 * {_M(_PARTS['fundamental_quality'])} AS fundamental_quality, 100 * {_M(SIGNAL_SQL['sector'].values())} AS sector_score
          FROM core LEFT JOIN f USING (instrument_id)),
    v AS (SELECT *, 100 * coalesce({_M(['fundamental_quality / 100', _M(SIGNAL_SQL['risk'].values()), _M(SIGNAL_SQL['liquidity'].values())])}, 0.5) AS quality_score,
          CASE WHEN fundamental_value IS NOT NULL THEN 0.65::DOUBLE * price_value + 0.35::DOUBLE * fundamental_value ELSE price_value END AS value_score FROM s),
    fin AS (SELECT *, round(greatest(0, least(100, (0.3::DOUBLE * coalesce(round(fundamental_value, 2), 0) + 0.29::DOUBLE * round(price_value, 2) + 0.05::DOUBLE * coalesce(round(reversal_score, 2), 0) + 0.12::DOUBLE * round(quality_score, 2) + 0.09::DOUBLE * coalesce(round(sector_score, 2), 0))
          / (0.41::DOUBLE + CASE WHEN fundamental_value IS NULL THEN 0 ELSE 0.3::DOUBLE END + CASE WHEN reversal_score IS NULL THEN 0 ELSE 0.05::DOUBLE END + CASE WHEN sector_score IS NULL THEN 0 ELSE 0.09::DOUBLE END) * CASE WHEN fundamental_value IS NULL THEN 0.9::DOUBLE ELSE 1 END)), 2) AS final_score,
          (epoch(TIMESTAMP '2001-11-05') - epoch(last_ts)) / 86400 AS freshness_days FROM v)"""
_SCORES_CTE = with_tables("candles", "instruments", "fundamentals") + SCORES_CTE.replace("""    fund AS (SELECT instrument_id, arg_max(trailing_pe, as_of) FILTER (WHERE true) AS x FROM fundamentals GROUP BY instrument_id),\n""", "")


def indicator_table(spark: SparkSession, d: str) -> DataFrame:
    """All indicators, stored: a row an instrument, read three times by the scan (itself, proxies, benchmark)."""
    return stored(indicators.indicators(fx.candles(spark, d), 300), "indicators")


def scores(spark: SparkSession, d: str) -> DataFrame:
    ind = indicator_table(spark, d)
    return scoring.score_all(ind, fx.instruments(spark, d), fx.fundamentals(spark, d), AS_OF)


def _score_query(name: str, columns: list[str]) -> None:
    cols = ", ".join(f"round({c}, 5) AS {c}" for c in columns)
    query(name, _SCORES_CTE + f" SELECT instrument_id, {cols} FROM fin")(lambda spark, d: rounded(scores(spark, d).select("instrument_id", *columns), 5))


for _name, _columns in {
    "c1_category_points": [f"{k}_points" for k in SIGNAL_SQL], "c8_core_score": ["core_score", "completeness", "confidence"], "c10_reversal_score": ["reversal_score"], "c11_quality_score": ["quality_score"],
    "c12_price_value": ["price_value"], "c13_blended_value": ["value_score"], "c14_fundamental_value": ["fundamental_value"], "c15_fundamental_quality": ["fundamental_quality"], "c18_sector_factor": ["sector_score"], "c17_final_score": ["final_score"],
}.items():
    _score_query(_name, _columns)

for _name, _cat in {"c2_trend_signals": "trend", "c3_momentum_signals": "momentum", "c4_risk_signals": "risk", "c5_liquidity_signals": "liquidity", "c6_positioning_signals": "positioning", "c7_sector_signals": "sector"}.items():

    @query(_name, _SCORES_CTE + " SELECT instrument_id, " + ", ".join(f"round({v}, 6) AS x_{k}" for k, v in SIGNAL_SQL[_cat].items()) + " FROM ctx")
    def _(spark, d, cat=_cat):
        ind = indicator_table(spark, d)
        rows = scoring.with_signals(scoring.with_context(ind.where(F.col("n_bars") >= 30), fx.instruments(spark, d)), cat)
        return rounded(rows.select("instrument_id", *[f"x_{k}" for k in scoring.signal_names()[cat]]))


_ALL = [(k, v) for s in SIGNALS_SQL.values() for k, v in s.items()]
_LIST = lambda what, test: f"array_to_string([p.{what} FOR p IN [" + ", ".join(f"{{'name': '{k}', 'known': ({x}) IS NOT NULL, 'positive': {pos}, 'text': {text}}}" for k, (x, pos, text) in _ALL) + f"] IF {test}], ';')"


@query("c9_signal_lists", _SCORES_CTE + f" SELECT instrument_id, {_LIST('text', 'p.known AND p.positive')} AS positive, {_LIST('text', 'p.known AND NOT p.positive')} AS negative, {_LIST('name', 'NOT p.known')} AS missing FROM ctx")
def _(spark, d):
    ind = indicator_table(spark, d)
    lists = scoring.signal_lists(scoring.with_signals(scoring.with_context(ind.where(F.col("n_bars") >= 30), fx.instruments(spark, d))))
    return lists.select("instrument_id", *[F.concat_ws(";", c).alias(c) for c in ("positive", "negative", "missing")])


@query("c16_primary_score", _SCORES_CTE + " SELECT instrument_id, round(core_score * 0.6 + coalesce(fundamental_value, 50) * 0.4, 5) AS primary_score FROM fin")
def _(spark, d):
    return rounded(scores(spark, d).select("instrument_id", scoring.primary_score(F.col("core_score"), F.col("fundamental_value"), 0.6, 0.4).alias("primary_score")), 5)


@query("c19_scan_job", _SCORES_CTE + " SELECT instrument_id, final_score, CASE WHEN final_score >= 75 THEN 'screening_candidate' WHEN final_score >= 60 THEN 'watchlist_candidate' ELSE 'does_not_pass' END AS classification, round(freshness_days, 2) AS freshness_days, tradable FROM fin JOIN instruments USING (instrument_id)")
def _(spark, d):
    out = scores(spark, d).join(fx.instruments(spark, d).select("instrument_id", "tradable"), "instrument_id")
    return out.select("instrument_id", "final_score", "classification", F.round("freshness_days", 2).alias("freshness_days"), "tradable")


@query("c20_run_summary", _SCORES_CTE + """ SELECT (SELECT count(*) FROM instruments) AS considered, count(*) AS scored, count(*) FILTER (WHERE final_score >= 75) AS n_screening_candidate,
    count(*) FILTER (WHERE final_score >= 60 AND final_score < 75) AS n_watchlist_candidate, count(*) FILTER (WHERE final_score < 60) AS n_does_not_pass, (SELECT count(*) FROM instruments) - count(*) AS skipped FROM fin""")
def _(spark, d):
    return scoring.run_summary(fx.instruments(spark, d), scores(spark, d))


@query("f23_clamp_and_saturate", "SELECT o_orderkey, greatest(0, least(1, o_totalprice / 300000)) AS clamped, (o_totalprice / 300000) / (o_totalprice / 300000 + 1) AS saturated FROM orders")
def _(spark, d):
    x = F.col("o_totalprice") / 300000
    return fx.read(spark, d, "orders").select("o_orderkey", scoring.clamp01(x).alias("clamped"), scoring.saturate(x).alias("saturated"))


@query("f24_classify", "SELECT o_orderkey, CASE WHEN o_totalprice / 5000 >= 75 THEN 'screening_candidate' WHEN o_totalprice / 5000 >= 60 THEN 'watchlist_candidate' ELSE 'does_not_pass' END AS class FROM orders")
def _(spark, d):
    return fx.read(spark, d, "orders").select("o_orderkey", scoring.classify(F.col("o_totalprice") / 5000).alias("class"))
