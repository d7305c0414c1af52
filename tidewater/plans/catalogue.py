"""Queries over selections, joins of the catalogue, event-driven state, quotas and audit chains."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import bars, lifecycle, selection, upkeep
from ..sources import fixtures as fx
from ..sources.fixtures import AS_OF, with_tables
from ..sources.scratch import parts_of, stored
from . import market
from .market import rounded

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def orders(spark, d):
    return fx.read(spark, d, "orders")


def results(spark, d):
    """Scan results: an order is one result of an instrument."""
    k = F.col("o_orderkey")
    return orders(spark, d).select(k.alias("result_id"), (k % 97).alias("instrument_id"), F.col("o_orderdate").alias("created_at"), (F.col("o_totalprice") / 5000).alias("score"), (k % 5 != 0).alias("tradable"), (F.floor(k / 500)).alias("run_id"))


RESULTS = "results AS (SELECT o_orderkey AS result_id, o_orderkey % 97 AS instrument_id, o_orderdate AS created_at, o_totalprice / 5000 AS score, o_orderkey % 5 <> 0 AS tradable, o_orderkey // 500 AS run_id FROM orders)"
NEWEST = "newest AS (SELECT * FROM results QUALIFY row_number() OVER (PARTITION BY instrument_id ORDER BY created_at DESC, result_id DESC) = 1)"


def newest(spark, d):
    rest = ["result_id", "created_at", "score", "tradable", "run_id"]
    return results(spark, d).groupBy("instrument_id").agg(F.max_by(F.struct(*rest), F.struct("created_at", "result_id")).alias("r")).select("instrument_id", "r.*")


# --- rankings ---------------------------------------------------------------------------------------------


@query("w1_latest_result", f"WITH {RESULTS}, {NEWEST} SELECT instrument_id, result_id, created_at, score FROM newest")
def _(spark, d):
    return newest(spark, d).select("instrument_id", "result_id", "created_at", "score")


@query("w2_top_by_latest_score", f"WITH {RESULTS}, {NEWEST} SELECT instrument_id, score FROM newest ORDER BY score DESC, instrument_id LIMIT 20")
def _(spark, d):
    return newest(spark, d).select("instrument_id", "score").orderBy(F.col("score").desc(), "instrument_id").limit(20)


@query("t1_results_by_score", f"WITH {RESULTS} SELECT result_id, score FROM results ORDER BY score DESC, result_id LIMIT 50")
def _(spark, d):
    return selection.page(results(spark, d).select("result_id", "score"), [F.col("score").desc(), "result_id"], 50)


@query("t2_rotation_sweep", with_tables("instruments") + " SELECT instrument_id, last_scanned_on FROM instruments WHERE scanner_eligible AND NOT suspended AND tradable ORDER BY last_scanned_on NULLS FIRST, instrument_id LIMIT 30")
def _(spark, d):
    return selection.rotation(fx.instruments(spark, d), 30, True).select("instrument_id", "last_scanned_on")


@query("t3_refresh_queue", with_tables("instruments") + " SELECT instrument_id FROM instruments ORDER BY bot_universe DESC, last_scanned_on NULLS FIRST, instrument_id LIMIT 40")
def _(spark, d):
    return fx.instruments(spark, d).orderBy(F.col("bot_universe").desc(), F.col("last_scanned_on").asc_nulls_first(), "instrument_id").limit(40).select("instrument_id")


WINDOWS = "wn AS (SELECT p_partkey AS instrument_id, coalesce(greatest(max(l_shipdate) - INTERVAL 10 DAY, TIMESTAMP '1999-11-06'), TIMESTAMP '1999-11-06') AS start FROM part LEFT JOIN lineitem ON l_suppkey = p_partkey GROUP BY p_partkey)"


def windows(spark, d):
    last = bars.latest_times(fx.candles(spark, d))
    listed = fx.read(spark, d, "part").select(F.col("p_partkey").alias("instrument_id"))  # most of which have no bars
    start = F.coalesce(F.greatest(F.col("latest_ts") - F.expr("INTERVAL 10 DAYS"), F.lit("1999-11-06").cast("timestamp")), F.lit("1999-11-06").cast("timestamp"))
    return listed.join(last, "instrument_id", "left").select("instrument_id", start.alias("start"))


@query("st2_refresh_windows", f"WITH {WINDOWS} SELECT instrument_id, start FROM wn")
def _(spark, d):
    return windows(spark, d)


@query("t4_fetch_chunks", f"WITH {WINDOWS}, n AS (SELECT *, (row_number() OVER (ORDER BY start DESC, instrument_id) - 1) // 25 AS chunk FROM wn) SELECT chunk, greatest(min(start), TIMESTAMP '1999-11-06') AS chunk_start, count(*) AS n FROM n GROUP BY chunk")
def _(spark, d):
    return selection.chunks(windows(spark, d), 25, "1999-11-06", lambda df: stored(df, "chunks"))


@query("t5_strategy_universe", f"WITH {RESULTS} SELECT instrument_id, score FROM results WHERE run_id = (SELECT max(run_id) FROM results WHERE run_id % 3 <> 0) AND tradable ORDER BY score DESC, instrument_id, result_id LIMIT 20")
def _(spark, d):
    r = results(spark, d)
    last = r.where("run_id % 3 <> 0").agg(F.max("run_id").alias("run_id"))
    return r.join(F.broadcast(last), "run_id").where("tradable").orderBy(F.col("score").desc(), "instrument_id", "result_id").limit(20).select("instrument_id", "score")


@query("t6_pinned_first", f"WITH {RESULTS}, {NEWEST} SELECT instrument_id, instrument_id % 10 = 3 AS pinned FROM newest ORDER BY instrument_id % 10 <> 3, score DESC, instrument_id LIMIT 15")
def _(spark, d):
    pinned = F.col("instrument_id") % 10 == 3
    return newest(spark, d).orderBy(F.when(pinned, 0).otherwise(1), F.col("score").desc(), "instrument_id").limit(15).select("instrument_id", pinned.alias("pinned"))


@query("t7_newest_filing", with_tables("filings") + " SELECT instrument_id, accession, nth = 1 AS processed FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY ts DESC, accession DESC, line_index DESC, value DESC) AS nth FROM filings WHERE code = 'P') WHERE nth <= 3")
def _(spark, d):
    order = Window.partitionBy("instrument_id").orderBy(F.col("ts").desc(), F.col("accession").desc(), F.col("line_index").desc(), F.col("value").desc())
    rows = fx.filings(spark, d).where("code = 'P'").withColumn("nth", F.row_number().over(order)).where("nth <= 3")
    return rows.select("instrument_id", "accession", (F.col("nth") == 1).alias("processed"))


# --- sets -------------------------------------------------------------------------------------------------


@query("u1_three_tiers", with_tables("instruments") + f""", {RESULTS}, {NEWEST},
    t AS (SELECT instrument_id, 0 AS tier, instrument_id::DOUBLE AS pos, 'watchlist' AS reason FROM instruments WHERE instrument_id % 20 = 1 UNION ALL
          SELECT * FROM (SELECT instrument_id, 1, -score, 'top' FROM newest ORDER BY score DESC, instrument_id LIMIT 20) UNION ALL SELECT instrument_id, 2, coalesce(epoch(last_scanned_on), 0)::DOUBLE, 'rotation' FROM instruments),
    b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY instrument_id ORDER BY tier, pos) = 1)
    SELECT instrument_id, tier, reason FROM b WHERE instrument_id IN (SELECT instrument_id FROM instruments WHERE scanner_eligible AND NOT suspended) ORDER BY tier, pos, instrument_id LIMIT 30""")
def _(spark, d):
    i = fx.instruments(spark, d)
    top = newest(spark, d).orderBy(F.col("score").desc(), "instrument_id").limit(20)
    age = F.coalesce(F.unix_timestamp(F.col("last_scanned_on").cast("timestamp")), F.lit(0)).cast("double")
    tiers = [("watchlist", i.where("instrument_id % 20 = 1"), F.col("instrument_id").cast("double")), ("top", top, -F.col("score")), ("rotation", i, age)]
    return selection.tiered(tiers, i.where("scanner_eligible AND NOT suspended"), 30)


@query("u2_watchlist_order", "SELECT o_custkey AS list_id, o_orderkey % 97 AS instrument_id, min(o_orderdate) AS pinned_at FROM orders GROUP BY ALL")
def _(spark, d):
    return orders(spark, d).groupBy(F.col("o_custkey").alias("list_id"), (F.col("o_orderkey") % 97).alias("instrument_id")).agg(F.min("o_orderdate").alias("pinned_at"))


@query("u3_delisted", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-06-01')")
def _(spark, d):
    seen = fx.read(spark, d, "lineitem").where("l_shipdate >= TIMESTAMP '2001-06-01'").select(F.col("l_partkey").alias("p_partkey"))
    return fx.read(spark, d, "part").join(seen, "p_partkey", "left_anti").select("p_partkey")


@query("u4_universe_union", f"WITH {RESULTS}, {NEWEST}, k AS (SELECT instrument_id FROM newest ORDER BY score DESC, instrument_id LIMIT 10) SELECT instrument_id, 'ranked' AS why FROM k UNION ALL SELECT DISTINCT instrument_id, 'held' FROM newest WHERE instrument_id % 9 = 2 AND instrument_id NOT IN (SELECT instrument_id FROM k)")
def _(spark, d):
    n = newest(spark, d)
    return selection.universe(n.orderBy(F.col("score").desc(), "instrument_id").limit(10), n.where("instrument_id % 9 = 2"))


@query("u6_pins_not_shown", f"WITH {RESULTS}, {NEWEST} SELECT s_suppkey AS instrument_id FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey NOT IN (SELECT instrument_id FROM newest WHERE score > 30)")
def _(spark, d):
    pins = fx.instruments(spark, d).where("instrument_id % 3 = 0").select("instrument_id")
    return pins.join(newest(spark, d).where("score > 30"), "instrument_id", "left_anti")


@query("u7_watched_shown", f"WITH {RESULTS}, {NEWEST} SELECT s_suppkey AS instrument_id FROM supplier WHERE s_suppkey % 3 = 0 INTERSECT SELECT instrument_id FROM newest WHERE score > 30")
def _(spark, d):
    pins = fx.instruments(spark, d).where("instrument_id % 3 = 0").select("instrument_id")
    return pins.intersect(newest(spark, d).where("score > 30").select("instrument_id"))


@query("u8_universe_ids", "SELECT DISTINCT o_custkey, unnest(['id-' || o_orderkey % 50, 'id-' || o_orderkey % 7]) AS id FROM orders")
def _(spark, d):
    ident = lambda n: F.concat(F.lit("id-"), (F.col("o_orderkey") % n).cast("string"))
    ids, weights = F.array(ident(50), F.lit("broken id")), F.create_map(ident(7), F.lit(1.0))
    every = orders(spark, d).select("o_custkey", F.explode(F.array_union(ids, F.map_keys(weights))).alias("id"))
    return every.where(F.col("id").rlike(r"^id-\d+$")).distinct()


# --- filters ----------------------------------------------------------------------------------------------


@query("p5_result_filters", f"WITH {RESULTS} SELECT result_id, score FROM results WHERE run_id = 3 AND score >= 40 AND tradable")
def _(spark, d):
    return results(spark, d).where("run_id = 3 AND score >= 40 AND tradable").select("result_id", "score")


@query("p11_preflight", "SELECT o_orderkey, array_to_string([x FOR x IN [CASE WHEN o_orderkey % 2 = 0 THEN 'not armed' END, CASE WHEN o_orderkey % 3 = 0 THEN 'halted' END, CASE WHEN o_orderkey % 5 = 0 THEN 'stale' END] IF x IS NOT NULL], ',') AS blockers, CASE WHEN o_orderkey % 2 = 0 THEN 'not armed' WHEN o_orderkey % 3 = 0 THEN 'halted' WHEN o_orderkey % 5 = 0 THEN 'stale' END AS first_blocker FROM orders")
def _(spark, d):
    checks = [F.when(F.col("o_orderkey") % n == 0, text) for n, text in ((2, "not armed"), (3, "halted"), (5, "stale"))]
    return orders(spark, d).select("o_orderkey", F.concat_ws(",", F.array_compact(F.array(*checks))).alias("blockers"), F.coalesce(*checks).alias("first_blocker"))


# --- joins ------------------------------------------------------------------------------------------------


@query("j1_eligible_bars", with_tables("candles", "instruments") + " SELECT instrument_id, count(*) AS n FROM candles JOIN instruments USING (instrument_id) WHERE scanner_eligible AND NOT suspended GROUP BY instrument_id")
def _(spark, d):
    eligible = fx.instruments(spark, d).where("scanner_eligible AND NOT suspended").select("instrument_id")
    return fx.candles(spark, d).join(eligible, "instrument_id").groupBy("instrument_id").agg(F.count(F.lit(1)).alias("n"))


_MAPS = "mp AS (SELECT p_partkey % 97 AS instrument_id, p_size AS priority, p_brand AS symbol, p_partkey, p_partkey % 6 <> 0 AS is_active FROM part)"


def mappings(spark, d):
    return fx.read(spark, d, "part").select((F.col("p_partkey") % 97).alias("instrument_id"), F.col("p_size").alias("priority"), F.concat("p_brand", F.lit("-"), F.col("p_partkey").cast("string")).alias("symbol"), (F.col("p_partkey") % 6 != 0).alias("is_active"))


_MAPS = "mp AS (SELECT p_partkey % 97 AS instrument_id, p_size AS priority, p_brand || '-' || p_partkey AS symbol, p_partkey % 6 <> 0 AS is_active FROM part)"
_FIRST = f"WITH {_MAPS}, fm AS (SELECT * FROM mp WHERE is_active QUALIFY row_number() OVER (PARTITION BY instrument_id ORDER BY priority, symbol) = 1)"


@query("j2_active_mapping", _FIRST + " SELECT instrument_id, priority, symbol FROM fm")
def _(spark, d):
    return selection.first_mapping(mappings(spark, d)).select("instrument_id", "priority", "symbol")


@query("j3_latest_fundamentals", with_tables("fundamentals") + " SELECT instrument_id, max(as_of) AS as_of, arg_max_null(trailing_pe, as_of) AS trailing_pe FROM fundamentals WHERE as_of <= DATE '2001-09-30' GROUP BY instrument_id".replace("arg_max_null(trailing_pe, as_of)", "max(trailing_pe)"))
def _(spark, d):
    from ..operators.scoring import latest_fundamentals

    return latest_fundamentals(fx.fundamentals(spark, d), "2001-09-30").select("instrument_id", "as_of", "trailing_pe")


@query("j4_sector_proxy", with_tables("instruments") + " SELECT i.instrument_id, p.proxy_id FROM instruments i LEFT JOIN (SELECT sector, min(instrument_id) AS proxy_id FROM instruments GROUP BY sector) p USING (sector)")
def _(spark, d):
    i = fx.instruments(spark, d)
    proxy = i.groupBy("sector").agg(F.min("instrument_id").alias("proxy_id"))
    return i.join(F.broadcast(proxy), "sector", "left").select("instrument_id", "proxy_id")


@query("j5_benchmark_join", with_tables("candles") + " SELECT a.instrument_id, round(a.c / b.c, 6) AS relative FROM (SELECT instrument_id, arg_max(close, ts) AS c FROM candles GROUP BY instrument_id) a, (SELECT arg_max(close, ts) AS c FROM candles WHERE instrument_id = 0) b")
def _(spark, d):
    last = bars.latest(fx.candles(spark, d)).select("instrument_id", "close")
    bench = last.where("instrument_id = 0").select(F.col("close").alias("b"))
    return rounded(last.join(F.broadcast(bench), F.lit(True)).select("instrument_id", (F.col("close") / F.col("b")).alias("relative")))


@query("j7_tradable_flag", "SELECT s_suppkey AS instrument_id, s_suppkey IN (SELECT p_partkey FROM part WHERE p_size > 20) AS tradable FROM supplier")
def _(spark, d):
    ids = fx.read(spark, d, "part").where("p_size > 20").select(F.col("p_partkey").alias("instrument_id"), F.lit(True).alias("t")).distinct()
    return fx.instruments(spark, d).select("instrument_id").join(ids, "instrument_id", "left").select("instrument_id", F.coalesce("t", F.lit(False)).alias("tradable"))


@query("j8_backfill_candidates", f"WITH {_MAPS} SELECT s_suppkey AS instrument_id, s_name AS ticker FROM supplier WHERE s_suppkey NOT IN (SELECT instrument_id FROM mp WHERE priority < 3) AND s_suppkey IN (SELECT p_partkey FROM part WHERE p_size > 10) ORDER BY s_name LIMIT 30")
def _(spark, d):
    i = fx.instruments(spark, d).select("instrument_id", "ticker")
    listed = fx.read(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("instrument_id"))
    return i.join(mappings(spark, d).where("priority < 3"), "instrument_id", "left_anti").join(listed, "instrument_id", "left_semi").orderBy("ticker").limit(30)


@query("j9_enrichment_candidates", with_tables("fundamentals") + ", mp AS (SELECT p_partkey % 130 AS instrument_id, p_partkey % 6 <> 0 AS is_active FROM part) SELECT DISTINCT instrument_id FROM mp WHERE is_active AND instrument_id NOT IN (SELECT instrument_id FROM fundamentals)")
def _(spark, d):
    m = fx.read(spark, d, "part").select((F.col("p_partkey") % 130).alias("instrument_id"), (F.col("p_partkey") % 6 != 0).alias("is_active"))  # some of which no supplier has
    return m.where("is_active").select("instrument_id").distinct().join(fx.fundamentals(spark, d).select("instrument_id"), "instrument_id", "left_anti")


_BATCH = "bt AS (SELECT DISTINCT CASE WHEN c_custkey % 3 <> 0 THEN 'ISIN' || c_custkey % 150 END AS isin, 'V' || c_nationkey % 5 AS venue, 'T' || c_custkey % 40 AS ticker FROM customer), kn AS (SELECT s_suppkey AS instrument_id, 'ISIN' || s_suppkey AS isin, 'V' || s_nationkey % 5 AS venue, 'T' || s_suppkey AS ticker FROM supplier)"
_RES = f"WITH {_BATCH}, rs AS (SELECT bt.*, k1.instrument_id AS i1, k2.i2 FROM bt LEFT JOIN kn k1 ON bt.isin = k1.isin LEFT JOIN (SELECT venue, ticker, min(instrument_id) AS i2 FROM kn GROUP BY ALL) k2 ON bt.venue = k2.venue AND bt.ticker = k2.ticker)"


def resolved(spark, d):
    text = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    c = fx.read(spark, d, "customer")
    batch = c.select(F.when(F.col("c_custkey") % 3 != 0, text("ISIN", F.col("c_custkey") % 150)).alias("isin"), text("V", F.col("c_nationkey") % 5).alias("venue"), text("T", F.col("c_custkey") % 40).alias("ticker"))
    s = fx.read(spark, d, "supplier")
    known = s.select(F.col("s_suppkey").alias("instrument_id"), text("ISIN", F.col("s_suppkey")).alias("isin"), text("V", F.col("s_nationkey") % 5).alias("venue"), text("T", F.col("s_suppkey")).alias("ticker"))
    return selection.resolve(batch, known)


@query("j10_identity_resolution", _RES + " SELECT isin, venue, ticker, coalesce(i1, i2) AS instrument_id, CASE WHEN i1 IS NOT NULL THEN 'isin' WHEN i2 IS NOT NULL THEN 'ticker' ELSE 'new' END AS tier, isin IS NULL AS needs_confirmation FROM rs")
def _(spark, d):
    return resolved(spark, d)


_ENDS = ("l_EQ", "_US_EQ", "d_EQ", "p_EQ", "_odd")
_PLACES = ("XLON", "XNAS", "XETR", "XPAR", None)
_SYNC = """WITH li AS (SELECT 'T' || c_custkey % 140 || ['l_EQ', '_US_EQ', 'd_EQ', 'p_EQ', '_odd'][c_nationkey % 5 + 1] AS broker_ticker, 'T' || c_custkey % 140 AS bare, ['XLON', 'XNAS', 'XETR', 'XPAR', NULL][c_nationkey % 5 + 1] AS venue,
        arg_min(CASE WHEN c_custkey % 3 <> 0 THEN 'ISIN' || c_custkey % 150 END, c_custkey) FILTER (WHERE true) AS isin0, min(c_custkey) AS k FROM customer GROUP BY ALL),
    ls AS (SELECT broker_ticker, bare, venue, CASE WHEN k % 3 <> 0 THEN 'ISIN' || k % 150 END AS isin, k % 8 <> 0 AS available FROM li),
    st AS (SELECT 'T' || p_partkey % 170 || ['l_EQ', '_US_EQ', 'd_EQ', 'p_EQ', '_odd'][p_partkey % 5 + 1] AS broker_ticker, bool_or(p_size > 10) AS is_available FROM part GROUP BY ALL),
    kn AS (SELECT s_suppkey AS instrument_id, CASE WHEN s_suppkey % 4 <> 0 THEN 'ISIN' || s_suppkey END AS isin, ['XLON', 'XNAS', 'XETR', 'XPAR', NULL][s_nationkey % 5 + 1] AS venue, 'T' || s_suppkey AS ticker FROM supplier),
    m1 AS (SELECT broker_ticker, min(instrument_id) AS i1 FROM ls JOIN kn ON ls.isin = kn.isin AND (ls.venue IS NULL OR ls.venue = kn.venue) GROUP BY ALL),
    m2 AS (SELECT broker_ticker, min(instrument_id) AS i2, arg_min(kn.isin IS NULL, instrument_id) AS no_isin FROM ls JOIN kn ON ls.venue = kn.venue AND bare = ticker GROUP BY ALL),
    r AS (SELECT ls.*, i1, i2, coalesce(no_isin, false) AS no_isin, row_number() OVER (PARTITION BY coalesce(i1, i2) IS NULL, CASE WHEN isin IS NOT NULL THEN 'i' || isin || coalesce(venue, '') WHEN venue IS NOT NULL THEN 'b' || bare || venue ELSE 't' || broker_ticker END ORDER BY broker_ticker) AS nth
          FROM ls LEFT JOIN m1 USING (broker_ticker) LEFT JOIN m2 USING (broker_ticker)),
    t AS (SELECT *, CASE WHEN i1 IS NOT NULL THEN 'isin' WHEN i2 IS NOT NULL THEN 'ticker' WHEN nth = 1 THEN 'new' WHEN isin IS NOT NULL THEN 'isin' ELSE 'ticker' END AS tier FROM r),
    ch AS (SELECT broker_ticker, CASE WHEN broker_ticker IN (SELECT broker_ticker FROM st) THEN 'updated' ELSE 'created' END AS action, tier, coalesce(i1, i2) AS instrument_id, i1 IS NULL AND no_isin AND isin IS NOT NULL AS fills_isin,
                  tier = 'new' AND isin IS NULL AS needs_confirmation, available FROM t
           UNION ALL SELECT broker_ticker, 'delisted', NULL, NULL, NULL, NULL, false FROM st WHERE is_available AND broker_ticker NOT IN (SELECT broker_ticker FROM ls))
    """.replace("arg_min(CASE WHEN c_custkey % 3 <> 0 THEN 'ISIN' || c_custkey % 150 END, c_custkey) FILTER (WHERE true) AS isin0, ", "")


def _one_of(key, *choices):
    return F.element_at(F.array(*map(F.lit, choices)), (key % len(choices) + 1).cast("int"))


def synced(spark, d):
    text = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    c = fx.read(spark, d, "customer")
    first = c.groupBy(F.concat(text("T", F.col("c_custkey") % 140), _one_of(F.col("c_nationkey"), *_ENDS)).alias("broker_ticker")).agg(F.min("c_custkey").alias("k"))
    listing = first.select("broker_ticker", F.when(F.col("k") % 3 != 0, text("ISIN", F.col("k") % 150)).alias("isin"), (F.col("k") % 8 != 0).alias("available"))
    kept = fx.read(spark, d, "part").groupBy(F.concat(text("T", F.col("p_partkey") % 170), _one_of(F.col("p_partkey"), *_ENDS)).alias("broker_ticker")).agg(F.bool_or(F.col("p_size") > 10).alias("is_available"))
    k = F.col("s_suppkey")
    known = fx.read(spark, d, "supplier").select(k.alias("instrument_id"), F.when(k % 4 != 0, text("ISIN", k)).alias("isin"), _one_of(F.col("s_nationkey"), *_PLACES).alias("venue"), text("T", k).alias("ticker"))
    return upkeep.sync_catalogue(listing, kept, known)


@query("in1_instrument_sync", _SYNC + "SELECT * FROM ch")
def _(spark, d):
    return synced(spark, d)


@query("in1_sync_counts", _SYNC + """SELECT count(*) FILTER (WHERE action <> 'delisted') AS listed, count(*) FILTER (WHERE action = 'created') AS created, count(*) FILTER (WHERE action = 'updated') AS updated, count(*) FILTER (WHERE action = 'delisted') AS delisted,
    count(*) FILTER (WHERE tier = 'new') AS instruments_created, count(*) FILTER (WHERE tier = 'isin') AS matched_by_isin, count(*) FILTER (WHERE needs_confirmation) AS needing_confirmation FROM ch""")
def _(spark, d):
    return upkeep.sync_counts(synced(spark, d))


@query("j11_unique_ticker", "SELECT c_nationkey % 7 * 100 + c_custkey % 211 AS ticker, min(c_custkey) AS instrument_id FROM customer GROUP BY ALL HAVING count(*) = 1")
def _(spark, d):
    rows = fx.read(spark, d, "customer").select((F.col("c_nationkey") % 7 * 100 + F.col("c_custkey") % 211).alias("ticker"), F.col("c_custkey").alias("instrument_id"))
    return selection.unique_match(rows, "ticker", "instrument_id")


@query("j12_match_confidence", "SELECT s_suppkey, CASE WHEN p_partkey IS NULL THEN NULL WHEN p_size % 2 = 0 THEN 1.0 ELSE 0.6 END::DOUBLE AS confidence, CASE WHEN p_partkey IS NULL THEN 'unresolved' WHEN p_size % 2 = 0 THEN 'verified' ELSE 'needs confirmation' END AS state FROM supplier LEFT JOIN part ON p_partkey = s_suppkey AND p_size > 15")
def _(spark, d):
    info = fx.read(spark, d, "part").where("p_size > 15").select(F.col("p_partkey").alias("s_suppkey"), (F.col("p_size") % 2 == 0).alias("same"))
    out = fx.read(spark, d, "supplier").select("s_suppkey").join(info, "s_suppkey", "left")
    return out.select("s_suppkey", F.when(F.col("same"), 1.0).when(~F.col("same"), 0.6).alias("confidence"), F.when(F.col("same"), "verified").when(~F.col("same"), "needs confirmation").otherwise("unresolved").alias("state"))


@query("j13_reconciliation", with_tables("intents") + " SELECT intent_id, 'order missing' AS problem FROM intents WHERE status = 'SUBMITTED' AND intent_id NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT intent_id, 'no price' FROM intents WHERE status = 'RECONCILED' AND fill_price IS NULL")
def _(spark, d):
    i = fx.intents(spark, d)
    venue = fx.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("intent_id"))
    missing = i.where("status = 'SUBMITTED'").join(venue, "intent_id", "left_anti").select("intent_id", F.lit("order missing").alias("problem"))
    return missing.unionByName(i.where("status = 'RECONCILED' AND fill_price IS NULL").select("intent_id", F.lit("no price").alias("problem")))


@query("j14_pending_intents", with_tables("intents") + " SELECT intent_id, CASE WHEN intent_id IN (SELECT l_orderkey FROM lineitem) THEN 'RECONCILED' ELSE 'ABANDONED' END AS status FROM intents WHERE status = 'SUBMITTED'")
def _(spark, d):
    seen = fx.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("intent_id"), F.lit(True).alias("seen")).distinct()
    out = fx.intents(spark, d).where("status = 'SUBMITTED'").join(seen, "intent_id", "left")
    return out.select("intent_id", F.when(F.col("seen"), "RECONCILED").otherwise("ABANDONED").alias("status"))


@query("j15_filled_stops", with_tables("intents") + " SELECT intent_id, max(l_shipdate) AS closed_at FROM intents JOIN lineitem ON l_orderkey = intent_id WHERE stop_price IS NOT NULL AND l_returnflag = 'R' GROUP BY intent_id")
def _(spark, d):
    filled = fx.read(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("intent_id")).agg(F.max("l_shipdate").alias("closed_at"))
    return fx.intents(spark, d).where("stop_price IS NOT NULL").select("intent_id").join(filled, "intent_id")


@query("j16_results_for_display", with_tables("instruments") + f", {RESULTS} SELECT result_id, ticker, venue FROM results LEFT JOIN instruments USING (instrument_id) WHERE score > 60")
def _(spark, d):
    names = fx.instruments(spark, d).select("instrument_id", "ticker", "venue")
    return results(spark, d).where("score > 60").join(names, "instrument_id", "left").select("result_id", "ticker", "venue")


@query("j17_pending_guard", f"WITH {RESULTS} SELECT result_id FROM results WHERE score > 50 AND instrument_id NOT IN (SELECT instrument_id FROM results WHERE run_id = 1 AND NOT tradable)")
def _(spark, d):
    r = results(spark, d)
    pending = r.where("run_id = 1 AND NOT tradable").select("instrument_id")
    return r.where("score > 50").join(pending, "instrument_id", "left_anti").select("result_id")


@query("j20_symbol_fan_out", f"WITH {_MAPS}, p AS (SELECT split_part(symbol, '-', 1) AS symbol, instrument_id FROM mp) SELECT symbol, count(DISTINCT instrument_id) AS instruments FROM p GROUP BY symbol")
def _(spark, d):
    m = mappings(spark, d).select(F.substring_index("symbol", "-", 1).alias("symbol"), "instrument_id").distinct()
    return m.groupBy("symbol").agg(F.count(F.lit(1)).alias("instruments"))


@query("j21_execution_idempotency", with_tables("intents") + " SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT intent_id FROM intents WHERE status NOT IN ('FAILED', 'ABANDONED'))")
def _(spark, d):
    live = fx.intents(spark, d).where("status NOT IN ('FAILED', 'ABANDONED')").select(F.col("intent_id").alias("o_orderkey"))
    return orders(spark, d).join(live, "o_orderkey", "left_anti").select("o_orderkey")


@query("j22_venue_ticker", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN CAST(s_suppkey AS VARCHAR) ELSE p_name END AS ticker FROM supplier LEFT JOIN part ON p_partkey = s_suppkey AND p_size > 25")
def _(spark, d):
    broker = fx.read(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("s_suppkey"), "p_name")
    out = fx.read(spark, d, "supplier").select("s_suppkey").join(broker, "s_suppkey", "left")
    return out.select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, F.col("s_suppkey").cast("string")).otherwise(F.col("p_name")).alias("ticker"))


# --- catalogue pipelines ----------------------------------------------------------------------------------


@query("a3_pipeline_funnel", f"WITH {_MAPS}, n AS (SELECT l_suppkey, count(DISTINCT l_shipdate) AS n FROM lineitem GROUP BY l_suppkey) SELECT count(*) FILTER (WHERE s_suppkey % 5 <> 0) AS tradable, count(*) FILTER (WHERE s_suppkey IN (SELECT instrument_id FROM mp WHERE is_active)) AS mapped, count(n) AS candled, count(*) FILTER (WHERE n >= 530) AS scannable FROM supplier LEFT JOIN n ON l_suppkey = s_suppkey")
def _(spark, d):
    mapped = mappings(spark, d).where("is_active").select("instrument_id", F.lit(1).alias("m")).distinct()
    out = fx.instruments(spark, d).join(mapped, "instrument_id", "left").join(bars.counts(fx.candles(spark, d), 530), "instrument_id", "left")
    return out.agg(F.count_if("tradable").alias("tradable"), F.count("m").alias("mapped"), F.count("n_bars").alias("candled"), F.count_if("has_history").alias("scannable"))


_MICS = ("XNAS", "XLON", "XETR", "XTSE", "XPAR", None)
_BACK = with_tables("candles") + f""", {_MAPS}, ii AS (SELECT s_suppkey AS instrument_id, CASE WHEN s_suppkey % 13 = 0 THEN 'W' || s_suppkey || '_WAR' ELSE 's' || s_suppkey END AS ticker, ['XNAS', 'XLON', 'XETR', 'XTSE', 'XPAR', NULL][s_nationkey % 6 + 1] AS venue FROM supplier),
    sy AS (SELECT instrument_id, CASE WHEN instrument_id % 13 <> 0 THEN 'S' || instrument_id || CASE venue WHEN 'XNAS' THEN '' WHEN 'XLON' THEN '.L' WHEN 'XETR' THEN '.DE' WHEN 'XPAR' THEN '.PA' END END AS symbol FROM ii),
    fd AS (SELECT c.*, close * 2 AS again FROM candles c WHERE ts > TIMESTAMP '2000-10-01' AND instrument_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)), fed AS (SELECT fd.* FROM fd JOIN sy USING (instrument_id) WHERE symbol IS NOT NULL),
    bf AS (SELECT sy.instrument_id, symbol, symbol IS NOT NULL AND sy.instrument_id NOT IN (SELECT instrument_id FROM mp WHERE priority < 3) AS mapping_created, CASE WHEN symbol IS NULL THEN 'unsupported' WHEN n IS NULL THEN 'no data' ELSE 'ingested' END AS status,
           coalesce(n, 0) AS candles_written FROM sy LEFT JOIN (SELECT instrument_id, count(*) AS n FROM fed GROUP BY ALL) USING (instrument_id)),
    bk AS (SELECT instrument_id, ts, arg_max(close, r) AS close FROM (SELECT instrument_id, ts, close, 1 AS r FROM candles WHERE ts <= TIMESTAMP '2001-03-01' UNION ALL SELECT instrument_id, ts, again, 2 FROM fed) GROUP BY ALL)"""


def _backfilled(spark, d):
    k = F.col("s_suppkey")
    ticker = F.when(k % 13 == 0, F.concat(F.lit("W"), k.cast("string"), F.lit("_WAR"))).otherwise(F.concat(F.lit("s"), k.cast("string")))
    instruments = fx.read(spark, d, "supplier").select(k.alias("instrument_id"), ticker.alias("ticker"), _one_of(F.col("s_nationkey"), *_MICS).alias("venue"))
    c = fx.candles(spark, d).select("instrument_id", "ts", "close")
    have = mappings(spark, d).where("priority < 3").select("instrument_id")
    names = upkeep.map_by_ticker(instruments, have).select("instrument_id", "symbol")
    carried = fx.read(spark, d, "supplier").where("s_acctbal > 0").select(k.alias("instrument_id"))  # what the vendor has
    feed = c.where("ts > TIMESTAMP '2000-10-01'").join(carried, "instrument_id").join(names, "instrument_id").select("symbol", "ts", (F.col("close") * 2).alias("close"), F.lit(2).alias("retrieved_at"))
    return upkeep.backfill(instruments, have, feed, c.where("ts <= TIMESTAMP '2001-03-01'").withColumn("retrieved_at", F.lit(1)))


@query("in2_backfill", _BACK + " SELECT * FROM bf")
def _(spark, d):
    return _backfilled(spark, d)[0]


@query("in2_backfill_counts", _BACK + " SELECT status, count(*) AS n, count(*) FILTER (WHERE mapping_created) AS mapped, sum(candles_written)::BIGINT AS candles_written FROM bf GROUP BY status")
def _(spark, d):
    rows = _backfilled(spark, d)[0].groupBy("status")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("mapping_created").alias("mapped"), F.sum("candles_written").alias("candles_written"))


@query("in2_backfilled_candles", _BACK + " SELECT instrument_id, count(*) AS n_bars, round(sum(close), 4) AS closes FROM bk GROUP BY instrument_id")
def _(spark, d):
    return rounded(_backfilled(spark, d)[1].groupBy("instrument_id").agg(F.count(F.lit(1)).alias("n_bars"), F.sum("close").alias("closes")), 4)


@query("in5_sector_proxies", """WITH w AS (SELECT * FROM (VALUES """ + ", ".join(f"('{k}', '{v}', {i})" for i, (k, v) in enumerate(upkeep.SECTOR_PROXIES.items())) + """) AS t(symbol, name, i)),
    mp AS (SELECT p_partkey % 16 AS i, p_partkey AS instrument_id FROM part WHERE p_partkey % 16 < 6), fd AS (SELECT l_suppkey % 14 AS i, l_shipdate AS ts FROM lineitem WHERE l_suppkey % 14 > 2)
    SELECT symbol, name, (SELECT min(instrument_id) FROM mp WHERE mp.i = w.i) AS instrument_id, NOT EXISTS (FROM mp WHERE mp.i = w.i) AS created, (SELECT count(DISTINCT ts) FROM fd WHERE fd.i = w.i) AS candles_written FROM w""")
def _(spark, d):
    names = F.array(*map(F.lit, (*upkeep.SECTOR_PROXIES, *("OTHER",) * 5)))
    m = fx.read(spark, d, "part").where("p_partkey % 16 < 6").select(F.element_at(names, (F.col("p_partkey") % 16 + 1).cast("int")).alias("symbol"), F.col("p_partkey").alias("instrument_id"))
    feed = fx.read(spark, d, "lineitem").where("l_suppkey % 14 > 2").select(F.element_at(names, (F.col("l_suppkey") % 14 + 1).cast("int")).alias("symbol"), F.col("l_shipdate").alias("ts"))
    return upkeep.ensure_proxies(m, feed)


_NAMED = "nm AS (SELECT DISTINCT o_orderkey % 130 AS instrument_id FROM orders WHERE o_orderpriority = '1-URGENT')"


@query("in6_on_demand_refresh", _BACK + market.SCORES_CTE.replace("FROM candles QUALIFY", "FROM nb QUALIFY").replace(""",
    b AS""", """,
    nb AS (SELECT instrument_id, ts, close AS open, close AS high, close AS low, close, 1000.0::DOUBLE AS volume FROM bk), """ + ", ".join(fx.CTE[t] for t in ("instruments", "fundamentals")) + """,
    b AS""", 1).replace("""    fund AS (SELECT instrument_id, arg_max(trailing_pe, as_of) FILTER (WHERE true) AS x FROM fundamentals GROUP BY instrument_id),\n""", "") + f""", {_NAMED},
    rs AS (SELECT nm.instrument_id, candles_written, final_score, CASE WHEN status = 'unsupported' THEN 'venue not supported' WHEN status IS NULL THEN 'unknown instrument' WHEN coalesce(nbars, 0) < 30 THEN 'not enough history' END AS reason
           FROM nm LEFT JOIN bf USING (instrument_id) LEFT JOIN (SELECT instrument_id, count(*) AS nbars FROM bk GROUP BY ALL) USING (instrument_id) LEFT JOIN fin USING (instrument_id))
    SELECT instrument_id, true AS is_ad_hoc, candles_written, CASE WHEN reason IS NULL THEN final_score END AS final_score,
           CASE WHEN reason IS NULL THEN CASE WHEN final_score >= 75 THEN 'screening_candidate' WHEN final_score >= 60 THEN 'watchlist_candidate' ELSE 'does_not_pass' END END AS classification, reason FROM rs""")
def _(spark, d):
    from ..operators import indicators, scoring

    rows, after = _backfilled(spark, d)
    after = stored(after.select("instrument_id", "ts", *[F.col("close").alias(c) for c in ("open", "high", "low", "close")], F.lit(1000.0).alias("volume")), "refreshed")
    named = orders(spark, d).where("o_orderpriority = '1-URGENT'").select((F.col("o_orderkey") % 130).alias("instrument_id")).distinct()
    ind = stored(indicators.indicators(after, 300), "refreshed")
    scored = scoring.score_all(ind, fx.instruments(spark, d), fx.fundamentals(spark, d), AS_OF)
    return upkeep.refresh_named(named, rows, scored, bars.counts(after, scoring.LEAST_BARS))


# --- state ------------------------------------------------------------------------------------------------


@query("st5_empty_fetch_backoff", """WITH f AS (SELECT user_id AS symbol, ts, event_id, CASE event_type WHEN 'click' THEN 'ok' WHEN 'error' THEN 'error' ELSE 'empty' END AS outcome FROM events), c AS (SELECT *, sum((outcome = 'ok')::INT) OVER (PARTITION BY symbol ORDER BY ts DESC, event_id DESC) AS s FROM f WHERE outcome <> 'error'),
    g AS (SELECT symbol, count(*) FILTER (WHERE s = 0) AS empties, max(ts) FILTER (WHERE s = 0) AS last FROM c GROUP BY symbol) SELECT symbol, empties, CASE WHEN empties >= 3 THEN CAST(last AS DATE) + 30 END AS retry_after FROM g""")
def _(spark, d):
    e = F.col("event_type")
    outcome = F.when(e == "click", "ok").when(e == "error", "error").otherwise("empty")
    return lifecycle.backoff(fx.read(spark, d, "events").select(F.col("user_id").alias("symbol"), "ts", F.col("event_id").alias("fetch_id"), outcome.alias("outcome")))


@query("st9_proposal_expiry", "SELECT o_orderkey AS proposal_id, CASE WHEN o_orderdate + INTERVAL 60 DAY <= coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + CAST(o_orderkey % 100 AS INTEGER) * INTERVAL 1 DAY END, TIMESTAMP '2001-09-15') THEN 'expired' ELSE coalesce(CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'approved' ELSE 'rejected' END END, 'pending') END AS state FROM orders")
def _(spark, d):
    k = F.col("o_orderkey")
    p = orders(spark, d).select(k.alias("proposal_id"), (F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS")).alias("expires_at"))
    made = orders(spark, d).where(k % 3 == 0).select(k.alias("proposal_id"), F.when(k % 2 == 0, "approved").otherwise("rejected").alias("decision"), F.timestamp_seconds(F.unix_timestamp("o_orderdate") + (k % 100) * 86400).alias("decided_at"))
    return lifecycle.proposal_states(p, made, "2001-09-15")


_DECIDE = """WITH p AS (SELECT o_orderkey AS proposal_id, CASE WHEN o_orderstatus = 'P' AND o_orderkey % 3 = 0 THEN 'rejected' ELSE 'pending' END AS status, o_orderdate + CAST(o_orderkey % 200 AS INTEGER) * INTERVAL 1 DAY AS expires_at, o_custkey % 6 = 0 AS suspended FROM orders),
    a AS (SELECT l_orderkey AS proposal_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_extendedprice) AS nth, CASE WHEN l_partkey % 3 = 0 THEN 'reject' ELSE 'approve' END AS action, l_shipdate AS acted FROM lineitem),
    t AS (SELECT *, CASE WHEN action = 'reject' THEN 'rejected' WHEN expires_at <= acted THEN 'expired' WHEN NOT suspended THEN 'approved' END AS to_ FROM a JOIN p USING (proposal_id)),
    x AS (SELECT *, status <> 'pending' OR coalesce(max((to_ IS NOT NULL)::INT) OVER (PARTITION BY proposal_id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS done FROM t),
    m AS (SELECT * FROM x WHERE NOT done AND to_ IS NOT NULL)
    """


def _decided(spark, d):
    k = F.col("o_orderkey")
    status = F.when((F.col("o_orderstatus") == "P") & (k % 3 == 0), "rejected").otherwise("pending")
    p = orders(spark, d).select(k.alias("proposal_id"), status.alias("status"), F.timestamp_seconds(F.unix_timestamp("o_orderdate") + (k % 200) * 86400).alias("expires_at"), (F.col("o_custkey") % 6 == 0).alias("suspended"))
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber", "l_partkey", "l_extendedprice"))
    lines = fx.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate")
    n = parts_of(lines.count(), lines)
    p = p.repartition(n, "proposal_id")
    a = lines.repartition(n, "l_orderkey").select(F.col("l_orderkey").alias("proposal_id"), nth.alias("nth"), F.when(F.col("l_partkey") % 3 == 0, "reject").otherwise("approve").alias("action"), F.col("l_shipdate").alias("at"))
    return lifecycle.decide(p, a, "2000-06-01")


@query("r2_proposal_decisions", _DECIDE + "SELECT p.proposal_id, coalesce(m.to_, CASE WHEN p.status = 'pending' AND p.expires_at <= TIMESTAMP '2000-06-01' THEN 'expired' END, p.status) AS status, CASE WHEN m.to_ IN ('approved', 'rejected') THEN m.acted END AS decided_at FROM p LEFT JOIN m USING (proposal_id)")
def _(spark, d):
    return _decided(spark, d)[0]


@query("r2_decision_outcomes", _DECIDE + "SELECT proposal_id, nth, action, CASE WHEN done THEN 'not actionable' WHEN to_ IS NULL THEN 'suspended' ELSE to_ END AS outcome FROM x".replace("nth, action", "nth::INTEGER AS nth, action"))
def _(spark, d):
    return _decided(spark, d)[1]


#: Each provider's day stepped through its requests: calls granted so far, and the calls of the minute.
_ADMIT = """WITH RECURSIVE e AS MATERIALIZED (SELECT event_type AS provider, CAST(ts AS DATE) AS day, date_trunc('minute', ts) AS minute, event_id, user_id % 5 <= 2 AS critical, row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id) AS nth FROM events),
    s AS (SELECT DISTINCT provider, day, 0::BIGINT AS nth, NULL::BIGINT AS request_id, 0 AS used, NULL::TIMESTAMP AS minute, 0 AS n, NULL::BOOLEAN AS granted, NULL::VARCHAR AS reason FROM e
          UNION ALL
          SELECT provider, day, nth, event_id, used + (NOT spent AND calls <= 3)::INTEGER, CASE WHEN spent THEN held ELSE minute END, CASE WHEN spent THEN n ELSE calls END, NOT spent AND calls <= 3,
                 CASE WHEN spent AND critical THEN 'reserve exhausted' WHEN spent THEN 'daily limit' WHEN calls > 3 THEN 'minute limit' WHEN used >= 40 THEN 'reserve' ELSE 'within budget' END
          FROM (SELECT e.*, s.used, s.n, s.minute AS held, s.used >= CASE WHEN e.critical THEN 45 ELSE 40 END AS spent, CASE WHEN e.minute = s.minute THEN s.n + 1 ELSE 1 END AS calls FROM s JOIN e ON e.provider = s.provider AND e.day = s.day AND e.nth = s.nth + 1))
    SELECT request_id, granted, reason FROM s WHERE nth > 0"""


@query("st13_quota_admission", _ADMIT)
def _(spark, d):
    e = fx.read(spark, d, "events")
    log = e.select(F.col("event_type").alias("provider"), F.to_date("ts").alias("day"), "ts", F.col("event_id").alias("request_id"), (F.col("user_id") % 5).cast("int").alias("priority"))
    return lifecycle.admit(log, daily=40, reserve=5, minute=3)


_MAPPED = """WITH st AS (SELECT p_partkey % 97 AS instrument_id, p_partkey % 3 AS provider, 'P' || min(p_partkey) AS symbol, bool_or(p_size > 48) AS confirmed, min(p_partkey) % 2 = 0 AS is_signal_source FROM part GROUP BY ALL),
    an AS (SELECT s_suppkey AS instrument_id, 1 AS provider, CASE WHEN s_suppkey % 7 <> 0 THEN 'A' || s_suppkey END AS answer, s_suppkey % 4 = 0 AS requires_confirmation, s_suppkey % 5 <> 0 AS asks_signal FROM supplier),
    bo AS (SELECT *, answer IS NOT NULL AND NOT coalesce(confirmed, false) AS taken FROM st FULL JOIN an USING (instrument_id, provider)),
    mv AS (SELECT *, bool_or(taken AND coalesce(asks_signal, false)) OVER (PARTITION BY instrument_id) AS moved FROM bo)
    """


def _resolved_mappings(spark, d):
    k, s = F.col("p_partkey"), F.col("s_suppkey")
    text = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    kept = fx.read(spark, d, "part").groupBy((k % 97).alias("instrument_id"), (k % 3).alias("provider")).agg(text("P", F.min("p_partkey")).alias("symbol"), F.bool_or(F.col("p_size") > 48).alias("confirmed"), (F.min("p_partkey") % 2 == 0).alias("is_signal_source"))
    answers = fx.read(spark, d, "supplier").select(s.alias("instrument_id"), F.lit(1).cast("long").alias("provider"), F.when(s % 7 != 0, text("A", s)).alias("answer"), (s % 4 == 0).alias("requires_confirmation"), (s % 5 != 0).alias("asks_signal"))
    return upkeep.resolve_mappings(kept, answers)


@query("st16_mapping_lifecycle", _MAPPED + """SELECT instrument_id, provider, CASE WHEN taken THEN answer ELSE symbol END AS symbol, coalesce(confirmed, false) AS confirmed, CASE WHEN taken AND asks_signal THEN true ELSE coalesce(is_signal_source, false) AND NOT moved END AS is_signal_source,
    CASE WHEN coalesce(confirmed, false) AND asks_signal IS NOT NULL THEN 'already confirmed by user' WHEN asks_signal IS NULL THEN 'not asked' WHEN answer IS NULL THEN 'not identified' WHEN symbol IS NULL THEN 'created' ELSE 'updated' END AS outcome FROM mv""")
def _(spark, d):
    return _resolved_mappings(spark, d)[0]


@query("st16_mapping_required", _MAPPED + "SELECT DISTINCT instrument_id, 'MAPPING_REQUIRED' AS lifecycle_state FROM mv WHERE taken AND requires_confirmation")
def _(spark, d):
    return _resolved_mappings(spark, d)[1]


@query("st18_suspension", with_tables("instruments") + " SELECT i.instrument_id, CASE WHEN hit IS NOT NULL THEN 'SUSPENDED' ELSE 'ACTIVE' END AS state, hit AS suspended_at FROM instruments i LEFT JOIN (SELECT user_id % 211 AS instrument_id, max(ts) AS hit FROM events WHERE event_type = 'error' GROUP BY ALL) e USING (instrument_id)")
def _(spark, d):
    e = fx.read(spark, d, "events").where("event_type = 'error'").groupBy((F.col("user_id") % 211).alias("instrument_id")).agg(F.max("ts").alias("suspended_at"))
    out = fx.instruments(spark, d).select("instrument_id").join(e, "instrument_id", "left")
    return out.select("instrument_id", F.when(F.col("suspended_at").isNotNull(), "SUSPENDED").otherwise("ACTIVE").alias("state"), "suspended_at")
