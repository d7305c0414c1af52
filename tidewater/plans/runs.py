"""Queries over runs that count what they do, provider chains, catalogue search, mapping confirmation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bars, runs, selection, trading, upkeep
from ..sources import fixtures as fx
from ..sources.fixtures import AS_OF, with_tables
from . import catalogue, desk

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def supplier(spark, d):
    return fx.read(spark, d, "supplier")


def key():
    return F.col("s_suppkey")


# --- runs -------------------------------------------------------------------------------------------------

_INGEST = with_tables("candles") + """, q AS (SELECT s_suppkey AS instrument_id, CASE WHEN s_suppkey % 8 <> 0 THEN 'Y' || s_suppkey END AS symbol FROM supplier ORDER BY s_suppkey % 10, s_suppkey LIMIT 70),
    fd AS (SELECT 'Y' || instrument_id AS symbol, instrument_id, ts, close * 3 AS close, CASE WHEN instrument_id % 6 = 1 THEN 'timeout' END AS error FROM candles WHERE ts > TIMESTAMP '2001-06-01' AND instrument_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)),
    a AS (SELECT * FROM fd JOIN q USING (symbol, instrument_id)),
    r AS (SELECT instrument_id, symbol, coalesce(n, 0) AS candles_written, error, CASE WHEN symbol IS NULL THEN 'no active mapping' WHEN error IS NULL AND coalesce(n, 0) = 0 THEN 'no new bars' END AS skipped_reason
          FROM q LEFT JOIN (SELECT instrument_id, count(DISTINCT ts) FILTER (error IS NULL) AS n, max(error) AS error FROM a GROUP BY 1) USING (instrument_id))"""


def _ingested(spark, d):
    c = fx.candles(spark, d).select("instrument_id", "ts", "close")
    queue = supplier(spark, d).select(key().alias("instrument_id"), F.when(key() % 8 != 0, F.concat(F.lit("Y"), key().cast("string"))).alias("symbol"))
    k = F.col("instrument_id")
    carried = supplier(spark, d).where("s_acctbal > 0").select(key().alias("instrument_id"))  # what the vendor has
    feed = c.where("ts > TIMESTAMP '2001-06-01'").join(carried, "instrument_id")
    feed = feed.select(F.concat(F.lit("Y"), k.cast("string")).alias("symbol"), F.when(k % 6 == 1, "timeout").alias("error"), "ts", (F.col("close") * 3).alias("close"), F.lit(2).alias("retrieved_at"))
    old = c.where("ts < TIMESTAMP '2001-09-01'").withColumn("retrieved_at", F.lit(1))
    return runs.ingestion_run(queue, feed, old, [k % 10, k], 70)


@query("a14_ingestion_totals", _INGEST + " SELECT count(*) AS processed, sum(candles_written)::BIGINT AS written, count(error) AS failed, count(skipped_reason) AS skipped, count(symbol) AS attempted FROM r")
def _(spark, d):
    return runs.totals_row(spark, _ingested(spark, d)[2])


@query("a14_ingestion_rows", _INGEST + " SELECT * FROM r")
def _(spark, d):
    return _ingested(spark, d)[0]


@query("a14_ingested_candles", _INGEST + " SELECT instrument_id, count(*) AS n_bars, round(sum(close), 4) AS closes FROM (SELECT instrument_id, ts, arg_max(close, r) AS close FROM (SELECT instrument_id, ts, close, 1 AS r FROM candles WHERE ts < TIMESTAMP '2001-09-01' UNION ALL SELECT instrument_id, ts, close, 2 FROM a WHERE error IS NULL) GROUP BY ALL) GROUP BY 1")
def _(spark, d):
    return _ingested(spark, d)[1].groupBy("instrument_id").agg(F.count(F.lit(1)).alias("n_bars"), F.round(F.sum("close"), 4).alias("closes"))


@query("a13_strategy_totals", desk._CTX.replace("boll_low * 1.6", "boll_low") + """, o AS (SELECT instrument_id % 23 = 1 AS stale, CASE WHEN instrument_id % 23 = 1 THEN 'rejected' WHEN instrument_id % 19 = 0 AND kind = 'entry' THEN 'rejected' WHEN kind <> 'entry' AND held <= 0 THEN 'skipped' WHEN instrument_id % 2 = 0 THEN 'executed' ELSE 'proposed' END AS outcome FROM s WHERE kind IS NOT NULL)
    SELECT count(*) AS signals, count(*) FILTER (outcome = 'executed') AS executed, count(*) FILTER (outcome = 'rejected') AS rejected, count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (stale) AS stale FROM o""")
def _(spark, d):
    c, k = desk.contexts(spark, d), F.col("instrument_id")
    s = trading.mean_reversion(c, oversold=55.0).join(c.select("instrument_id", "held"), "instrument_id")
    made = trading.decide(s.withColumns({"stale": k % 23 == 1, "halted": k % 19 == 0, "auto": k % 2 == 0}))
    return runs.totals_row(spark, runs.strategy_run(made)[1])


#: Who asks for which interval at which provider, and what the providers have: bars of an hour and of a quarter.
_INTRADAY = """WITH rq AS (SELECT DISTINCT user_id AS instrument_id, ['1h', '15m', '1d', '1h'][user_id % 4 + 1] AS "interval", ['live', 'daily', 'fast'][user_id % 3 + 1] AS provider FROM events),
    mp AS (SELECT DISTINCT user_id AS instrument_id, ['live', 'daily', 'fast'][user_id % 3 + 1] AS provider, 'S' || user_id AS symbol FROM events WHERE event_type = 'error' AND value > 20),
    fd AS (SELECT 'S' || user_id AS symbol, p AS provider, i AS "interval", CASE i WHEN '1h' THEN date_trunc('hour', ts) ELSE time_bucket(INTERVAL 15 MINUTE, ts) END AS ts, max(value) AS close FROM events, unnest(['live', 'fast', 'daily']) a(p), unnest(['1h', '15m']) b(i) WHERE value > 0 GROUP BY ALL),
    gd AS (SELECT rq.*, symbol, CASE WHEN "interval" = '1d' THEN '1d is not an intraday interval' WHEN provider = 'daily' THEN 'daily does not provide intraday data' WHEN symbol IS NULL THEN 'no active ' || provider || ' mapping' END AS guard FROM rq LEFT JOIN mp USING (instrument_id, provider)),
    gt AS (SELECT gd.instrument_id, "interval", provider, fd.ts, fd.close FROM gd JOIN fd USING (provider, symbol, "interval") WHERE guard IS NULL AND fd.ts >= TIMESTAMP '2024-01-30')"""


def _intraday(spark, d):
    e, u = fx.read(spark, d, "events"), F.col("user_id")
    own = F.element_at(F.array(*map(F.lit, ("live", "daily", "fast"))), (u % 3 + 1).cast("int")).alias("provider")
    wanted = F.element_at(F.array(*map(F.lit, ("1h", "15m", "1d", "1h"))), (u % 4 + 1).cast("int")).alias("interval")
    symbol = F.concat(F.lit("S"), u.cast("string")).alias("symbol")
    requests = e.select(u.alias("instrument_id"), wanted, own).distinct().withColumn("start", F.lit("2024-01-30").cast("timestamp"))
    mapped = e.where("event_type = 'error' AND value > 20").select(u.alias("instrument_id"), own, symbol).distinct()
    at = {"1h": F.date_trunc("hour", "ts"), "15m": F.window("ts", "15 minutes")["start"]}
    made = [e.where("value > 0").groupBy(symbol, ts.alias("ts")).agg(F.max("value").alias("close")).withColumn("interval", F.lit(i)) for i, ts in at.items()]
    feed = made[0].unionByName(made[1]).withColumn("provider", F.explode(F.array(*map(F.lit, ("live", "fast", "daily")))))
    feed = feed.withColumns({"series_type": F.lit("raw"), "retrieved_at": F.lit(2)})
    old = made[0].where("ts < TIMESTAMP '2024-01-30 12:00:00'").select(F.substring("symbol", 2, 9).cast("long").alias("instrument_id"), "ts", (F.col("close") * 0).alias("close"), "interval", F.lit("raw").alias("series_type"), F.lit(1).alias("retrieved_at"))
    known = spark.createDataFrame([("live", True), ("fast", True), ("daily", False)], "provider string, supports_intraday boolean")
    return runs.intraday_run(requests, known, mapped, feed, old)


@query("p12_intraday_guard", _INTRADAY + """ SELECT instrument_id, "interval", provider, coalesce(n, 0) AS candles_written, coalesce(guard, CASE WHEN n IS NULL THEN 'no candles for the requested window' END) AS skipped_reason
    FROM gd LEFT JOIN (SELECT instrument_id, "interval", provider, count(DISTINCT ts) AS n FROM gt GROUP BY ALL) USING (instrument_id, "interval", provider)""")
def _(spark, d):
    return _intraday(spark, d)[0]


@query("p12_intraday_candles", _INTRADAY + """ SELECT coalesce(g.instrument_id, o.instrument_id) AS instrument_id, coalesce(g."interval", '1h') AS "interval", count(*) AS n_bars, round(sum(coalesce(g.close, 0)), 4) AS closes
    FROM (SELECT substr(symbol, 2)::BIGINT AS instrument_id, ts FROM fd WHERE "interval" = '1h' AND provider = 'live' AND ts < TIMESTAMP '2024-01-30 12:00:00') o FULL JOIN gt g ON g.instrument_id = o.instrument_id AND g.ts = o.ts AND g."interval" = '1h' GROUP BY 1, 2""")
def _(spark, d):
    after = _intraday(spark, d)[1]
    return after.groupBy("instrument_id", "interval").agg(F.count(F.lit(1)).alias("n_bars"), F.round(F.sum("close"), 4).alias("closes"))


_ATTEMPTS = with_tables("fundamentals", "instruments") + """, tries AS (SELECT venue, CASE WHEN instrument_id % 12 <> 0 THEN 'E' || instrument_id END AS symbol, instrument_id % 10 <> 3 AS found, market_cap, trailing_pe, price_to_book, dividend_yield, profit_margin
          FROM instruments JOIN fundamentals USING (instrument_id) WHERE as_of = DATE '2001-10-01'),
    h AS (SELECT *, symbol IS NOT NULL AND found AS there FROM tries)"""
_HIT = "there AND coalesce(market_cap, trailing_pe, price_to_book, dividend_yield, profit_margin) IS NOT NULL"


def _covered(spark, d):
    k = F.col("instrument_id")
    f = fx.fundamentals(spark, d).where("as_of = DATE '2001-10-01'")
    rows = fx.instruments(spark, d).select("instrument_id", "venue").join(f, "instrument_id")
    return runs.coverage_run(rows.select("venue", F.when(k % 12 != 0, F.concat(F.lit("E"), k.cast("string"))).alias("symbol"), (k % 10 != 3).alias("found"), *runs.COVERED))


@query("a16_field_coverage", _ATTEMPTS + f" SELECT count(*) AS attempted, count(*) FILTER (symbol IS NULL) AS unsupported, count(*) FILTER (symbol IS NOT NULL AND NOT found) AS not_found, count(*) FILTER ({_HIT}) AS had_data, "
       + ", ".join(f"count({c}) FILTER (there) AS {c}" for c in runs.COVERED) + " FROM h")
def _(spark, d):
    return runs.totals_row(spark, _covered(spark, d)[1])


@query("a16_venue_coverage", _ATTEMPTS + f" SELECT venue, count(*) AS attempts, count(*) FILTER ({_HIT}) AS hits, count(*) FILTER ({_HIT}) / count(*) AS hit_ratio FROM h GROUP BY venue")
def _(spark, d):
    return _covered(spark, d)[0]


_PROFILES = """WITH st AS (SELECT s_suppkey AS instrument_id, CASE WHEN s_suppkey % 3 = 0 THEN 'Old' || s_suppkey % 4 END AS sector, CASE s_suppkey % 5 WHEN 0 THEN 'Mills' WHEN 1 THEN '' END AS industry, s_suppkey % 9 <> 2 AS asked FROM supplier),
    pr AS (SELECT p_partkey AS instrument_id, CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'Sector ' || p_size % 4 END AS new_sector, CASE WHEN p_size % 3 <> 0 THEN p_brand END AS new_industry, CASE WHEN p_size % 2 = 0 THEN p_size::DOUBLE END AS trailing_pe,
                  CASE WHEN p_size % 5 = 0 THEN p_size / 10 END AS price_to_book, NULL::DOUBLE AS profit_margin, NULL::DOUBLE AS dividend_yield FROM part WHERE p_size > 5),
    j AS (SELECT st.*, pr.* EXCLUDE (instrument_id), new_sector <> '' AS known FROM st LEFT JOIN pr USING (instrument_id))"""


def _enriched(spark, d):
    kept = supplier(spark, d).select(
        key().alias("instrument_id"), F.when(key() % 3 == 0, F.concat(F.lit("Old"), (key() % 4).cast("string"))).alias("sector"), F.when(key() % 5 == 0, "Mills").when(key() % 5 == 1, "").alias("industry"), (key() % 9 != 2).alias("asked")
    )
    size = F.col("p_size")
    none = F.lit(None).cast("double")
    profiles = fx.read(spark, d, "part").where("p_size > 5").select(
        F.col("p_partkey").alias("instrument_id"), F.when(size % 4 == 1, "").when(size % 4 > 1, F.concat(F.lit("Sector "), (size % 4).cast("string"))).alias("new_sector"), F.when(size % 3 != 0, F.col("p_brand")).alias("new_industry"),
        F.when(size % 2 == 0, size.cast("double")).alias("trailing_pe"), F.when(size % 5 == 0, size / 10).alias("price_to_book"), none.alias("profit_margin"), none.alias("dividend_yield"),
    )
    return runs.enrichment_run(kept, profiles, AS_OF)


@query("in3_enrichment", _PROFILES + " SELECT instrument_id, CASE WHEN asked AND known THEN new_sector ELSE sector END AS sector, CASE WHEN asked AND coalesce(industry, '') = '' THEN coalesce(nullif(new_industry, ''), 'Unclassified') ELSE industry END AS industry FROM j")
def _(spark, d):
    return _enriched(spark, d)[0]


@query("in3_snapshots", _PROFILES + f" SELECT instrument_id, DATE '{AS_OF}' AS as_of, trailing_pe, price_to_book, profit_margin, dividend_yield FROM j WHERE asked")
def _(spark, d):
    return _enriched(spark, d)[1]


@query("in3_enrichment_counts", _PROFILES + " SELECT count(*) AS attempted, count(*) FILTER (known) AS classified, count(*) FILTER (known IS NOT TRUE) AS unclassified, count(*) FILTER (coalesce(trailing_pe, price_to_book) IS NOT NULL) AS with_fundamentals FROM j WHERE asked")
def _(spark, d):
    return runs.totals_row(spark, _enriched(spark, d)[2])


_CHAIN = ("alpha", "beta", "gamma")


@query("in4_provider_fallback", with_tables("candles") + """, n AS (SELECT s_suppkey AS i, p, CASE p WHEN 1 THEN 'alpha' WHEN 2 THEN 'beta' ELSE 'gamma' END AS provider, (SELECT count(*) FROM candles c WHERE c.instrument_id = s_suppkey AND c.ts > TIMESTAMP '2001-10-22' + p * INTERVAL 3 DAY) AS bars FROM supplier, range(1, 4) t(p) WHERE s_acctbal > 0),
    a AS (SELECT *, CASE (i + p) % 4 WHEN 0 THEN 'not configured' WHEN 1 THEN CASE WHEN i % 3 = 0 THEN 'quota exhausted' END END AS error, CASE WHEN bars = 0 THEN 'no new bars' END AS skipped FROM n),
    o AS (SELECT i, min(p) FILTER (error IS NULL AND skipped IS NULL) AS first FROM a GROUP BY i)
    SELECT s_suppkey AS instrument_id, w.provider AS served_by, coalesce(w.bars, 0) AS candles_written, CASE WHEN o.i IS NULL THEN 'no provider in the chain' WHEN first IS NULL THEN 'gamma: ' || coalesce(z.error, z.skipped) END AS unserved
    FROM supplier LEFT JOIN o ON o.i = s_suppkey LEFT JOIN a w ON w.i = s_suppkey AND w.p = o.first LEFT JOIN a z ON z.i = s_suppkey AND z.p = 3""")
def _(spark, d):
    names = F.array(*map(F.lit, _CHAIN))
    asked = supplier(spark, d).where("s_acctbal > 0").select(key().alias("instrument_id"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("p"))  # some instruments have no provider at all
    recent = fx.candles(spark, d).where("ts > TIMESTAMP '2001-10-25'").select("instrument_id", "ts")
    late = F.count_if(F.col("ts") > F.timestamp_seconds(F.unix_timestamp(F.lit("2001-10-22").cast("timestamp")) + F.col("p") * 3 * 86400))
    n = asked.join(recent, "instrument_id", "left").groupBy("instrument_id", "p").agg(late.alias("candles_written"))
    k = (F.col("instrument_id") + F.col("p")) % 4
    error = F.when(k == 0, "not configured").when((k == 1) & (F.col("instrument_id") % 3 == 0), "quota exhausted")
    answers = n.select("instrument_id", F.element_at(names, F.col("p").cast("int")).alias("provider"), error.alias("error"), F.when(F.col("candles_written") == 0, "no new bars").alias("skipped_reason"), "candles_written")
    return runs.provider_chain(supplier(spark, d).select(key().alias("instrument_id")), answers, list(_CHAIN))


# --- catalogue --------------------------------------------------------------------------------------------

_LISTED = """WITH i AS (SELECT s_suppkey AS instrument_id, s_name AS name, 'T' || s_suppkey AS ticker, CASE WHEN s_suppkey % 5 <> 0 THEN 'XS' || lpad((s_suppkey * 7)::VARCHAR, 10, '0') END AS isin, ['DISCOVERED', 'MAPPING_REQUIRED', 'DATA_BACKFILL', 'PAPER_ACTIVE'][s_suppkey % 4 + 1] AS lifecycle_state,
    s_suppkey % 4 = 0 AS bot_universe, s_suppkey % 17 = 0 AS suspended FROM supplier)"""
_STATES = ("DISCOVERED", "MAPPING_REQUIRED", "DATA_BACKFILL", "PAPER_ACTIVE")
#: What is asked, the same as SQL, size and offset of the page
_SEARCHES = {
    "by name": ({"text": " SUPPLIER#00000001 "}, "name ILIKE '%supplier#00000001%'", 4, 3),
    "by ticker": ({"text": "t2"}, "name ILIKE '%t2%' OR ticker ILIKE '%t2%' OR isin ILIKE '%t2%'", 50, 0),
    "by isin": ({"text": "xs00000000"}, "isin ILIKE '%xs00000000%'", 50, 5),
    "by ids": ({"ids": [3, 5, 17, 99999999]}, "instrument_id IN (3, 5, 17, 99999999)", 50, 0),
    "no ids": ({"ids": []}, "false", 50, 0),
    "state": ({"lifecycle_state": "DATA_BACKFILL"}, "lifecycle_state = 'DATA_BACKFILL'", 10, 10),
    "bots": ({"bot_universe_only": True, "tradable_only": True}, "bot_universe AND NOT suspended", 500, 0),
    "all of it": ({"text": "sup", "ids": [4, 8, 9, 68], "bot_universe_only": True, "tradable_only": True, "lifecycle_state": "DISCOVERED"}, "name ILIKE '%sup%' AND instrument_id IN (4, 8, 9, 68) AND bot_universe AND NOT suspended AND lifecycle_state = 'DISCOVERED'", 50, 0),
    "anything": ({}, "true", 7, 2),
}


@query("p4_catalogue_search", _LISTED + " UNION ALL ".join(f" (SELECT '{name}' AS asked, instrument_id, name, (SELECT count(*) FROM i WHERE {rule}) AS total FROM i WHERE {rule} ORDER BY name LIMIT {size} OFFSET {offset})" for name, (_, rule, size, offset) in _SEARCHES.items()))
def _(spark, d):
    listed = supplier(spark, d).select(
        key().alias("instrument_id"), F.col("s_name").alias("name"), F.concat(F.lit("T"), key().cast("string")).alias("ticker"), F.when(key() % 5 != 0, F.concat(F.lit("XS"), F.lpad((key() * 7).cast("string"), 10, "0"))).alias("isin"),
        F.element_at(F.array(*map(F.lit, _STATES)), (key() % 4 + 1).cast("int")).alias("lifecycle_state"), (key() % 4 == 0).alias("bot_universe"), (key() % 17 == 0).alias("suspended"),
    )
    pages = [selection.page_with_total(selection.search(listed, **asked), ["name"], size, offset).select(F.lit(name).alias("asked"), "instrument_id", "name", "total") for name, (asked, _, size, offset) in _SEARCHES.items()]
    out = pages[0]
    for other in pages[1:]:
        out = out.unionByName(other)
    return out


@query("p6_refresh_candidates", with_tables("instruments") + ", m AS (SELECT p_partkey % 97 AS instrument_id, p_partkey % 6 <> 0 AS is_active, CASE WHEN p_size > 6 THEN TIMESTAMP '2001-11-01' + p_size % 10 * INTERVAL 1 DAY END AS retry_after FROM part) SELECT instrument_id FROM instruments WHERE NOT suspended AND (bot_universe OR scanner_eligible) AND instrument_id IN (SELECT instrument_id FROM m WHERE is_active AND (retry_after IS NULL OR retry_after <= TIMESTAMP '2001-11-05'))")
def _(spark, d):
    k = F.col("p_partkey")
    rest = F.timestamp_seconds(F.unix_timestamp(F.lit("2001-11-01").cast("timestamp")) + F.col("p_size") % 10 * 86400)
    m = fx.read(spark, d, "part").select((k % 97).alias("instrument_id"), (k % 6 != 0).alias("is_active"), F.when(F.col("p_size") > 6, rest).alias("retry_after"))
    return selection.refresh_candidates(fx.instruments(spark, d), m, AS_OF).select("instrument_id")


_LISTS = {
    "proposals": ("orders", "o_orderkey", "o_orderdate", "o_orderstatus = 'P'", 25),
    "halts": ("events", "event_id", "ts", "event_type = 'error'", 20),
    "decisions": ("lineitem", "l_orderkey", "l_shipdate", "l_returnflag = 'A' AND l_linenumber = 1", 30),
    "summaries": ("orders", "o_custkey", "o_orderdate", "o_orderkey % 2 = 0", 30),
}


@query("t8_newest_listing", "SELECT * FROM " + " UNION ALL SELECT * FROM ".join(f"(SELECT '{name}' AS listing, {key} AS id, {at} AS at_time FROM {table} WHERE {rule} GROUP BY ALL ORDER BY {at} DESC, {key} DESC LIMIT {n})" for name, (table, key, at, rule, n) in _LISTS.items()))
def _(spark, d):
    out = None
    for name, (table, key, at, rule, n) in _LISTS.items():
        rows = fx.read(spark, d, table).where(rule).select(F.lit(name).alias("listing"), F.col(key).alias("id"), F.col(at).alias("at_time")).distinct()
        found = selection.page(rows, [F.col("at_time").desc(), F.col("id").desc()], n)
        out = found if out is None else out.unionByName(found)
    return out


@query("st15_scan_cursor", with_tables("instruments") + f", {catalogue.RESULTS}, {catalogue.NEWEST}, q AS (SELECT s_suppkey AS instrument_id FROM supplier ORDER BY s_suppkey % 10, s_suppkey LIMIT 70)" + """
    SELECT i.instrument_id, CASE WHEN n.instrument_id IS NOT NULL THEN DATE '2001-11-05' ELSE last_scanned_on END AS last_scanned_on, CASE WHEN q.instrument_id IS NOT NULL THEN DATE '2001-11-05' END AS last_attempt_on
    FROM instruments i LEFT JOIN (SELECT instrument_id FROM newest WHERE score > 30) n USING (instrument_id) LEFT JOIN q USING (instrument_id)""")
def _(spark, d):
    now = F.lit(AS_OF).cast("date")
    scored = catalogue.newest(spark, d).where("score > 30").select("instrument_id", now.alias("scanned"))
    tried = _ingested(spark, d)[0].select("instrument_id", now.alias("last_attempt_on"))  # those that the run reached, whatever came of it
    out = fx.instruments(spark, d).join(scored, "instrument_id", "left").join(tried, "instrument_id", "left")
    return out.select("instrument_id", F.coalesce("scanned", "last_scanned_on").alias("last_scanned_on"), "last_attempt_on")


_CONFIRMED = catalogue._MAPPED + """, ml AS (SELECT instrument_id, provider, CASE WHEN taken THEN answer ELSE symbol END AS symbol, coalesce(confirmed, false) AS confirmed, CASE WHEN taken AND asks_signal THEN true ELSE coalesce(is_signal_source, false) AND NOT moved END AS sig FROM mv),
    cf AS (SELECT o_orderkey % 120 AS instrument_id, o_orderkey % 3 AS provider, CASE WHEN min(o_orderkey) % 4 = 0 THEN 'U' || min(o_orderkey % 120) END AS override, bool_or(o_orderpriority = '1-URGENT') AS as_signal FROM orders WHERE o_orderkey % 5 = 0 GROUP BY ALL),
    bt AS (SELECT ml.*, cf.instrument_id IS NOT NULL AS asked, override, as_signal, min(CASE WHEN cf.instrument_id IS NOT NULL AND as_signal THEN provider END) OVER (PARTITION BY instrument_id) AS chosen FROM ml LEFT JOIN cf USING (instrument_id, provider))"""


def _confirmed(spark, d):
    mapped, required = catalogue._resolved_mappings(spark, d)
    k = F.col("o_orderkey")
    said = catalogue.orders(spark, d).where(k % 5 == 0).groupBy((k % 120).alias("instrument_id"), (k % 3).alias("provider"))
    said = said.agg(F.when(F.min("o_orderkey") % 4 == 0, F.lit("U")).alias("u"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("as_signal"))
    said = said.select("instrument_id", "provider", F.concat("u", F.col("instrument_id").cast("string")).alias("override"), "as_signal")
    states = mapped.select("instrument_id").distinct().join(required, "instrument_id", "left").withColumn("lifecycle_state", F.coalesce("lifecycle_state", F.lit("DISCOVERED")))
    return upkeep.confirm(mapped, states, said)


@query("st16_confirmed_mappings", _CONFIRMED + " SELECT instrument_id, provider, coalesce(override, symbol) AS symbol, confirmed OR asked AS confirmed, CASE WHEN chosen IS NOT NULL THEN chosen = provider ELSE sig END AS is_signal_source, CASE WHEN override <> symbol THEN 'manual_user_override' END AS resolution FROM bt")
def _(spark, d):
    return _confirmed(spark, d)[0]


@query("st16_confirmed_states", _CONFIRMED + ", rq AS (SELECT DISTINCT instrument_id FROM mv WHERE taken AND requires_confirmation) SELECT instrument_id, CASE WHEN rq.instrument_id IS NULL THEN 'DISCOVERED' WHEN bool_or(asked) THEN 'DATA_BACKFILL' ELSE 'MAPPING_REQUIRED' END AS lifecycle_state FROM bt LEFT JOIN rq USING (instrument_id) GROUP BY instrument_id, rq.instrument_id")
def _(spark, d):
    return _confirmed(spark, d)[1]
