"""Queries over payload readers, row rules and validation, on payloads that Spark builds from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normalise as nm
from ..sources import fixtures as fx
from ..sources import readers
from ..sources.fixtures import with_tables

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


def _pick(key: str, *values):
    """The value of a fixed list that a key's residue picks, as a Column."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values) + 1).cast("int"))


def _pick_sql(key: str, *values) -> str:
    return f"[{', '.join('NULL' if v is None else chr(39) + v.replace(chr(39), chr(39) * 2) + chr(39) for v in values)}][CAST({key} % {len(values)} AS INTEGER) + 1]"


# --- row rules --------------------------------------------------------------------------------------------


@query("f3_bar_stamp", """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN date_trunc('day', o_orderdate) ELSE o_orderdate + INTERVAL 13 HOUR - INTERVAL 2 HOUR END AS ts FROM orders""")
def _(spark, d):
    raw = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" 13:00:00+02:00"))
    return orders(spark, d).select("o_orderkey", nm.bar_stamp(raw, F.when(F.col("o_orderkey") % 2 == 0, "1d").otherwise("1h")).alias("ts"))


_RAW = ("1.5", "NaN", "Infinity", "abc", "-2e3", None)


@query("f4_numeric_cleaning", "SELECT o_orderkey, [1.5, NULL, NULL, NULL, -2000.0, NULL][CAST(o_orderkey % 6 AS INTEGER) + 1]::DOUBLE AS x FROM orders")
def _(spark, d):
    return orders(spark, d).select("o_orderkey", nm.number(_pick("o_orderkey", *_RAW)).alias("x"))


@query("f5_normalise_price", f"SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice / 100 ELSE o_totalprice END AS price FROM orders")
def _(spark, d):
    return orders(spark, d).select("o_orderkey", nm.normalise_price(F.col("o_totalprice"), _pick("o_orderkey", "GBX", "USD", None)).alias("price"))


#: (symbol, currency, unit): pence by their three spellings, every known currency, unknown ones and none by symbol
_UNITS = (
    ("A", "GBp", "GBX"), ("A.L", "GBp ", "GBX"), ("B", "GBX", "GBX"), ("B", "gbx", "GBX"), ("A.L", "GBP", "GBP"), ("A.L", "gbp", "GBP"), ("A", "USD", "USD"), ("A.L", "usd", "USD"), ("A", "EUR", "EUR"),
    ("A", "chf", "CHF"), ("A", "SEK", "SEK"), ("A", "NOK", "NOK"), ("A", "DKK", "DKK"), ("A", "PLN", "PLN"), ("A", "CZK", "CZK"), ("A", "HUF", "HUF"), ("A", "CAD", "USD"), ("A.L", "AUD", "GBX"),
    ("C.L", None, "GBX"), ("c.l", None, "GBX"), ("D.LX", "", "USD"), ("E", None, "USD"),
)


@query("f6_infer_price_unit", f"SELECT o_orderkey, {_pick_sql('o_orderkey', *(u for *_, u in _UNITS))} AS unit FROM orders")
def _(spark, d):
    unit = nm.infer_unit(_pick("o_orderkey", *(s for s, *_ in _UNITS)), _pick("o_orderkey", *(c for _, c, _ in _UNITS)))
    return orders(spark, d).select("o_orderkey", unit.alias("unit"))


@query("f7_major_unit", f"SELECT o_orderkey, o_orderkey % 3 = 0 AS is_minor, {_pick_sql('o_orderkey', 'GBP', 'USD', 'EUR')} AS major FROM orders")
def _(spark, d):
    unit = _pick("o_orderkey", "GBX", "USD", "EUR")
    return orders(spark, d).select("o_orderkey", (unit == "GBX").alias("is_minor"), nm.major_unit(unit).alias("major"))


#: What brokers write, and the vendor's notation of it
_TICKERS = {
    "brk/b ": "BRK-B", "BRK_A": "BRK-A", "ABC_": "ABC", "abc_/-": "ABC", "xyz/W": "XYZ-W", "FOO_WS": "FOO-WS", "FOO-WT": "FOO-WT", "foo_war": None, "FOO_WARB": None, "BAR_RTS": None, "bar_rgt_1": None,
    "WARP": "WARP", "a_b-c-": "A-B-C", "PLAIN": "PLAIN", "\t x \n": "X", "": None, "  ": None, "_/-": None,
}


@query("f8_ticker_notation", f"SELECT o_orderkey, {_pick_sql('o_orderkey', *_TICKERS.values())} AS ticker FROM orders")
def _(spark, d):
    return orders(spark, d).select("o_orderkey", nm.ticker(_pick("o_orderkey", *_TICKERS)).alias("ticker"))


@query("f29_symbol_repair", f"SELECT o_orderkey, coalesce({_pick_sql('o_orderkey', *_TICKERS.values())}, {_pick_sql('o_orderkey', *_TICKERS)}) AS symbol, {_pick_sql('o_orderkey', *_TICKERS.values())} IS NOT NULL AS is_active FROM orders")
def _(spark, d):
    raw = _pick("o_orderkey", *_TICKERS)
    fixed = nm.ticker(raw)
    return orders(spark, d).select("o_orderkey", F.coalesce(fixed, raw).alias("symbol"), fixed.isNotNull().alias("is_active"))


_VENUES = (*nm.US_VENUES, *nm.SUFFIXES, "XTSE", None)
_BROKER_CODES = ("AAPL_US_EQ", "VODl_EQ", "SAPd_EQ", "AIRp_EQ", "ASMLa_EQ", "ENIm_EQ", "SANe_EQ", "NESNs_EQ", "ROG_SW_EQ", "RAW_thing", "X_EQ", "PLAIN")
_FOREIGN = "CASE {venue} WHEN 'XLON' THEN {0} WHEN 'XETR' THEN {1} WHEN 'XPAR' THEN {2} WHEN 'XAMS' THEN {3} WHEN 'XMIL' THEN {4} WHEN 'XMAD' THEN {5} WHEN 'XSWX' THEN {6} WHEN 'XSTO' THEN {7} WHEN 'XHEL' THEN {8} WHEN 'XCSE' THEN {9} WHEN 'XOSL' THEN {10} WHEN 'XDUB' THEN {11} WHEN 'XLIS' THEN {12} WHEN 'XBRU' THEN {13} WHEN 'XWBO' THEN {14} WHEN 'XWAR' THEN {15} END"
_VENUE_SQL = _pick_sql("o_orderkey", *_VENUES)
_venue_codes = lambda *codes: _FOREIGN.format(*[f"'{c}'" for c in codes], venue=f"({_VENUE_SQL})")
_IS_US = f"({_VENUE_SQL}) IN ('XNAS', 'XNYS', 'ARCX', 'BATS')"


@query("f9_vendor_symbol", f"SELECT o_orderkey, 'T' || CASE WHEN {_IS_US} THEN '' ELSE {_venue_codes('.L', '.DE', '.PA', '.AS', '.MI', '.MC', '.SW', '.ST', '.HE', '.CO', '.OL', '.IR', '.LS', '.BR', '.VI', '.WA')} END AS symbol FROM orders")
def _(spark, d):
    return orders(spark, d).select("o_orderkey", nm.vendor_symbol(F.lit("T"), _pick("o_orderkey", *_VENUES)).alias("symbol"))


@query("f10_second_vendor_symbol", f"SELECT o_orderkey, 'T.' || CASE WHEN {_IS_US} THEN 'US' ELSE {_venue_codes('LSE', 'XETRA', 'PA', 'AS', 'MI', 'MC', 'SW', 'ST', 'HE', 'CO', 'OL', 'IR', 'LS', 'BR', 'VI', 'WAR')} END AS symbol FROM orders")
def _(spark, d):
    return orders(spark, d).select("o_orderkey", nm.second_vendor_symbol(F.lit("T"), _pick("o_orderkey", *_VENUES)).alias("symbol"))


@query("f11_broker_ticker", f"SELECT o_orderkey, {_pick_sql('o_orderkey', 'XNAS', 'XLON', 'XETR', 'XPAR', 'XAMS', 'XMIL', 'XMAD', 'XSWX', 'XSWX', None, None, None)} AS venue, {_pick_sql('o_orderkey', 'AAPL', 'VOD', 'SAP', 'AIR', 'ASML', 'ENI', 'SAN', 'NESN', 'ROG', 'RAW', 'X', 'PLAIN')} AS bare FROM orders")
def _(spark, d):
    code = _pick("o_orderkey", *_BROKER_CODES)
    return orders(spark, d).select("o_orderkey", nm.broker_venue(code).alias("venue"), nm.broker_bare(code).alias("bare"))


#: Broker codes of instruments and of order states, each with its meaning here
_KINDS = {
    "STOCK": "stock", "REIT": "stock", "ETF": "etf", "ETC": "etc", "TRUST": "trust", "CORPACT": "unknown", "CRYPTOCURRENCY": "unknown", "CVR": "unknown", "FOREX": "unknown", "FUTURES": "unknown",
    "INDEX": "unknown", "WARRANT": "unknown", "WEIRD": "unknown", None: "unknown",
}
_STATES = {
    "LOCAL": "pending", "UNCONFIRMED": "pending", "NEW": "submitted", "CONFIRMED": "submitted", "SUBMITTED": "submitted", "REPLACING": "submitted", "REPLACED": "submitted", "CANCELLING": "submitted",
    "PARTIALLY_FILLED": "partially_filled", "FILLED": "filled", "CANCELLED": "cancelled", "REJECTED": "rejected", "EXPIRED": "expired", "ODD": "unknown", None: "unknown",
}


@query("f12_settlement", f"SELECT o_orderkey, {_pick_sql('o_orderkey', 'GBP', 'USD', 'EUR')} AS settles, {_pick_sql('o_orderkey', *_KINDS.values())} AS kind FROM orders")
def _(spark, d):
    kind = nm.lookup(nm.KINDS, _pick("o_orderkey", *_KINDS), "unknown")
    return orders(spark, d).select("o_orderkey", nm.settlement_currency(_pick("o_orderkey", "GBX", None, "EUR")).alias("settles"), kind.alias("kind"))


_TITLES = (
    "Chief Financial Officer", "Chief Legal & Compliance Officer", "President", "President and CEO", "EVP and President, Retail", "Vice President", "Senior Vice-President", "SVP, CFO", "VP Sales", "Director", None, "",
    *(f"{c.upper()} & Chair" for c in nm.CHIEFS),
)


@query("f13_c_suite_title", f"SELECT o_orderkey, o_orderkey % {len(_TITLES)} IN (0, 1, 2, 3, 7) OR o_orderkey % {len(_TITLES)} >= 12 AS c_suite FROM orders")
def _(spark, d):
    return orders(spark, d).select("o_orderkey", nm.is_c_suite(_pick("o_orderkey", *_TITLES)).alias("c_suite"))


@query("f14_accession_id", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '0001234567-24-' || lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0') ELSE right('https://example.org/no-id/' || CAST(o_orderkey AS VARCHAR), 32) END AS accession FROM orders")
def _(spark, d):
    k = F.col("o_orderkey").cast("string")
    plain = F.concat(F.lit("https://example.org/a/000123456724"), F.lpad((F.col("o_orderkey") % 1000000).cast("string"), 6, "0"), F.lit(".txt"))
    url = F.when(F.col("o_orderkey") % 2 == 0, plain).otherwise(F.concat(F.lit("https://example.org/no-id/"), k))
    return orders(spark, d).select("o_orderkey", nm.accession(url).alias("accession"))


@query("f16_value_usd", "SELECT l_orderkey, l_linenumber, round_even(CAST(l_quantity AS DECIMAL(20,4)) * CAST(l_discount AS DECIMAL(18,6)) / 1, 2)::DOUBLE AS value_usd FROM lineitem")
def _(spark, d):
    v = F.bround(F.col("l_quantity").cast("decimal(20,4)") * F.col("l_discount").cast("decimal(18,6)"), 2)
    return fx.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", v.cast("double").alias("value_usd"))


@query("f18_spread_and_fields", with_tables("fundamentals") + """ SELECT instrument_id, as_of, (trailing_pe IS NOT NULL)::INTEGER + (price_to_book IS NOT NULL)::INTEGER + (profit_margin IS NOT NULL)::INTEGER + (revenue_growth IS NOT NULL)::INTEGER
    + (earnings_growth IS NOT NULL)::INTEGER + (debt_to_equity IS NOT NULL)::INTEGER + (dividend_yield IS NOT NULL)::INTEGER + (market_cap IS NOT NULL)::INTEGER AS n_fields, trailing_pe - price_to_book AS spread FROM fundamentals""")
def _(spark, d):
    f = fx.fundamentals(spark, d)
    return f.select("instrument_id", "as_of", nm.known_fields(*[F.col(c) for c in f.columns[2:]]).alias("n_fields"), (F.col("trailing_pe") - F.col("price_to_book")).alias("spread"))


@query("f19_enum_quarantine", "SELECT o_orderstatus, count(*) AS n, o_orderstatus IN ('O', 'F') AS valid FROM orders GROUP BY o_orderstatus")
def _(spark, d):
    return orders(spark, d).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")).withColumn("valid", nm.any_of(F.col("o_orderstatus"), ("O", "F")))


@query("f20_masked_account", "SELECT c_custkey, '****' || CASE WHEN length(c_name) <= 4 THEN '' ELSE right(c_name, 4) END AS account FROM customer")
def _(spark, d):
    return fx.read(spark, d, "customer").select("c_custkey", nm.masked(F.col("c_name")).alias("account"))


@query("f21_redaction", """SELECT event_id, to_json({'a': {'b': [{'c': {'d': {'token': '[redacted]', 'note': event_type}}}]}, 'Password': '[redacted]', 'headers': json_object(['Api_Key', 'apikey', 'Authorization', 'session_token', 'private_key', 'encrypted_api_key', 'Secret', 'TOKEN', 'accept'][event_id % 9 + 1],
    CASE WHEN event_id % 9 < 8 THEN '[redacted]' ELSE event_type END)})::VARCHAR AS payload FROM events""")
def _(spark, d):
    key = F.element_at(F.array(*map(F.lit, ("Api_Key", "apikey", "Authorization", "session_token", "private_key", "encrypted_api_key", "Secret", "TOKEN", "accept"))), (F.col("event_id") % 9 + 1).cast("int"))
    e = F.col("event_type")
    inner = F.struct(F.struct(F.struct(e.alias("token"), e.alias("note")).alias("d")).alias("c"))
    rows = fx.read(spark, d, "events").select("event_id", F.struct(F.struct(F.array(inner).alias("b")).alias("a"), e.alias("Password"), F.create_map(key, e).alias("headers"), F.struct(e.alias("id")).alias("api_key")).alias("payload"))
    return rows.select("event_id", F.to_json(nm.redact(F.col("payload"), rows.schema["payload"].dataType)).alias("payload"))


@query("f22_json_safe_metrics", "SELECT event_id, round(value / 3, 6) AS a, CAST(NULL AS DOUBLE) AS b FROM events")
def _(spark, d):
    m = nm.json_safe(F.create_map(F.lit("a"), F.col("value") / 3, F.lit("b"), F.lit(float("nan"))))
    return fx.read(spark, d, "events").select("event_id", m["a"].alias("a"), m["b"].alias("b"))


@query("f25_saturate", "SELECT event_id, CASE WHEN value > 0 THEN value / (value + 1) ELSE 0 END AS s FROM events")
def _(spark, d):
    from ..operators.scoring import saturate

    return fx.read(spark, d, "events").select("event_id", saturate(F.col("value")).alias("s"))


@query("f27_order_validation", f"SELECT o_orderkey, {_pick_sql('o_orderkey', None, 'quantity must be positive', 'limit price required', 'stop price required')} AS problem FROM orders")
def _(spark, d):
    q = F.when(F.col("o_orderkey") % 4 == 1, 0.0).otherwise(1.0)
    none = F.lit(None).cast("double")
    return orders(spark, d).select("o_orderkey", nm.order_problem(_pick("o_orderkey", "market", "market", "limit", "stop"), q, none, none).alias("problem"))


@query("f28_explanations", "SELECT l_orderkey, l_linenumber, printf('%+.1f%%', (l_discount - 0.05) * 100) AS text FROM lineitem")
def _(spark, d):
    return fx.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", nm.signed_percent(F.col("l_discount") - 0.05).alias("text"))


@query("f30_broker_vocabularies", f"SELECT o_orderkey, {_pick_sql('o_orderkey', *_STATES.values())} AS status, {_pick_sql('o_orderkey', *_KINDS.values())} AS kind FROM orders")
def _(spark, d):
    status = nm.lookup(nm.ORDER_STATES, _pick("o_orderkey", *_STATES), "unknown")
    return orders(spark, d).select("o_orderkey", status.alias("status"), nm.lookup(nm.KINDS, _pick("o_orderkey", *_KINDS), "unknown").alias("kind"))


_QUALITY = ("ok", "stale", "suspect", "conflicted", "incomplete", "unavailable", None)


@query("p10_status_predicates", f"SELECT o_orderkey, coalesce({_pick_sql('o_orderkey', *_STATES.values())} IN ('filled', 'cancelled', 'rejected', 'expired'), false) AS terminal, coalesce({_pick_sql('o_orderkey', *_QUALITY)} = 'ok', false) AS tradable FROM orders")
def _(spark, d):
    s = nm.lookup(nm.ORDER_STATES, _pick("o_orderkey", *_STATES), "unknown")
    return orders(spark, d).select("o_orderkey", nm.any_of(s, nm.TERMINAL_STATES).alias("terminal"), nm.any_of(_pick("o_orderkey", *_QUALITY), ("ok",)).alias("tradable"))


# --- readers ----------------------------------------------------------------------------------------------


def wide(spark, d):
    """A vendor's wide frame: text columns, pence, some bars incomplete or incoherent."""
    broken = F.when(F.dayofmonth("ts") == 13, "NaN").otherwise(F.col("close").cast("string"))
    high = F.when(F.dayofmonth("ts") == 7, F.col("low") / 2).otherwise(F.col("high"))
    return fx.candles(spark, d).select("instrument_id", F.col("ts").alias("Date"), F.col("open").alias("Open"), high.alias("High"), F.col("low").alias("Low"), broken.alias("Close"), F.col("volume").alias("Volume"))


@query("s8_wide_to_candles", with_tables("candles") + " SELECT instrument_id, ts, open / 100 AS open, high / 100 AS high, low / 100 AS low, close / 100 AS close, volume FROM candles WHERE day(ts) NOT IN (7, 13)")
def _(spark, d):
    return readers.wide_frame(wide(spark, d), unit="GBX")


@query("s9_multi_symbol_split", with_tables("candles") + " SELECT CAST(floor(instrument_id / 50) AS BIGINT) AS chunk, 'S' || instrument_id % 50 AS symbol, ts, open, close FROM candles")
def _(spark, d):
    # a vendor's frame holds fifty symbols as columns; each chunk of fifty instruments is one such frame
    # the bars that there are meet as a list, not as a hundred cells each, and become columns row by row
    long = fx.candles(spark, d).select(F.floor(F.col("instrument_id") / 50).alias("chunk"), "ts", (F.col("instrument_id") % 50).alias("slot"), "open", "close")
    held = long.repartition("chunk", "ts").groupBy("chunk", "ts").agg(F.map_from_entries(F.collect_list(F.struct("slot", F.struct("open", "close")))).alias("bars"))
    cells = [F.try_element_at("bars", F.lit(i).cast("long"))[f.lower()].alias(f"S{i}|{f}") for i in range(50) for f in ("Open", "Close")]
    return readers.split_symbols(held.select("chunk", "ts", *cells), ["Open", "Close"], ["chunk", "ts"])


@query("s10_json_series", "SELECT event_type AS symbol, ts, value AS close FROM events WHERE event_id % 10 <> 3 AND event_type <> 'error'")
def _(spark, d):
    bad = F.when(F.col("event_id") % 10 == 3, "oops").otherwise(F.col("value").cast("string"))
    item = F.struct(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("datetime"), bad.alias("close"))
    payload = fx.read(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.collect_list(item).alias("values"))
    status = F.when(F.col("event_type") == "error", "error").otherwise("ok")
    return readers.json_series(payload.select(F.to_json(F.struct(status.alias("status"), F.struct(F.col("event_type").alias("symbol")).alias("meta"), "values")).alias("payload")))


@query("s11_json_fundamentals", with_tables("fundamentals") + " SELECT instrument_id, as_of, coalesce(nullif(CASE WHEN instrument_id % 4 = 0 THEN 0 ELSE trailing_pe END, 0), price_to_book) AS trailing_pe, market_cap FROM fundamentals")
def _(spark, d):
    f = fx.fundamentals(spark, d)
    pe = F.when(F.col("instrument_id") % 4 == 0, 0.0).otherwise(F.col("trailing_pe"))
    body = F.struct(F.struct(pe.alias("TrailingPE")).alias("Valuation"), F.struct(F.col("price_to_book").alias("PERatio"), F.col("market_cap").alias("MarketCapitalization")).alias("Highlights"))
    return readers.json_fundamentals(f.select("instrument_id", "as_of", F.to_json(body).alias("payload")))


@query("s12_profile_fields", with_tables("fundamentals") + " SELECT instrument_id, as_of, CASE WHEN dividend_yield * 30 > 1 THEN dividend_yield * 30 / 100 ELSE dividend_yield * 30 END AS dividend_yield FROM fundamentals")
def _(spark, d):
    return fx.fundamentals(spark, d).select("instrument_id", "as_of", readers.yield_as_share(F.col("dividend_yield") * 30).alias("dividend_yield"))


@query("s13_economic_series", "SELECT event_type AS series, arg_max(value, ts) AS value FROM events WHERE event_id % 3 <> 0 GROUP BY event_type")
def _(spark, d):
    raw = F.when(F.col("event_id") % 6 == 0, ".").when(F.col("event_id") % 3 == 0, "").otherwise(F.col("value").cast("string"))
    return readers.newest_value(fx.read(spark, d, "events").select(F.col("event_type").alias("series"), F.col("ts").alias("date"), raw.alias("raw")))


_XML_SQL = """SELECT o_orderkey AS accession, 'Chief Executive Officer' AS title, i - 1 AS line_index, CASE WHEN (o_orderkey + i) % 2 = 0 THEN 'P' ELSE 'S' END AS code, (o_orderkey % 100 + i)::DOUBLE AS shares, 24.5::DOUBLE AS price
    FROM orders, (VALUES (1), (2)) AS v(i)"""


@query("s14_ownership_xml", _XML_SQL.replace("i - 1 AS", "(i - 1)::INTEGER AS"))
def _(spark, d):
    line = lambda i: F.format_string(
        "<nonDerivativeTransaction><transactionCode>%s</transactionCode><shares>%d</shares><price>24.5</price></nonDerivativeTransaction>",
        F.when((F.col("o_orderkey") + i) % 2 == 0, "P").otherwise("S"), F.col("o_orderkey") % 100 + i,
    )
    doc = F.concat(F.lit("<ownershipDocument><officerTitle>Chief Executive Officer</officerTitle>"), line(1), line(2), F.lit("</ownershipDocument>"))
    return readers.ownership_lines(orders(spark, d).select(F.col("o_orderkey").alias("accession"), doc.alias("xml")))


@query("f15_filing_fields", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'A & <B>' ELSE 'plain' END AS name, o_orderkey % 3 IN (0, 1) AS flag, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) END AS filed FROM orders")
def _(spark, d):
    name = F.when(F.col("o_orderkey") % 2 == 0, "A &amp; &lt;B&gt;").otherwise("plain")
    flag = _pick("o_orderkey", "1", "true", "0").isin("1", "true")
    raw = F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("-05:00"))).otherwise("none")
    return orders(spark, d).select("o_orderkey", nm.unescape(name).alias("name"), flag.alias("flag"), F.try_to_date(F.substring(raw, 1, 10)).alias("filed"))


@query("s15_feed_links", "SELECT DISTINCT '0001234567-24-' || lpad(CAST(event_id // 2 % 1000000 AS VARCHAR), 6, '0') AS accession FROM events")
def _(spark, d):
    link = lambda x: F.format_string('<a href="/x/0001234567-24-%06d%s">f</a>', F.floor(F.col("event_id") / 2) % 1000000, F.lit(x))
    page = F.concat(link("-index.htm"), link(".txt"), link("-index.htm"))
    return readers.feed_links(fx.read(spark, d, "events").select(page.alias("page"))).select("accession")


_DIFF = ("+| [ACME](http://x) | CEO | $2,500,000 |", "-| [OLD](http://y) | CFO | $9,000,000 |", "+|---|---|---|", "+| [BETA](http://z) | VP | $3,000,000 |", "+| [CEE](http://w) | Chief Technology Officer [bio](http://b) | $1,000,000 |")


@query("s16_markdown_diff", "SELECT o_orderkey, [0, 2, 3, 4][i] AS line_no, ['ACME', 'BETA', 'CEE'][i] AS company, ['CEO', 'VP', 'Chief Technology Officer'][i] AS role, [2500000, 3000000, 1000000][i]::DOUBLE AS amount FROM orders, (VALUES (1), (2), (3)) v(i)".replace("[0, 2, 3, 4][i] AS line_no", "[0, 3, 4][i]::INTEGER AS line_no"))
def _(spark, d):
    return readers.diff_rows(orders(spark, d).select("o_orderkey", F.lit("\n".join(_DIFF)).alias("diff")))


@query("f26_insider_gate", "SELECT o_orderkey, 'ACME' AS company FROM orders")
def _(spark, d):
    rows = readers.diff_rows(orders(spark, d).select("o_orderkey", F.lit("\n".join(_DIFF)).alias("diff")))
    return rows.where(nm.is_c_suite(F.col("role")) & (F.col("amount") > 1_000_000)).select("o_orderkey", "company")


@query("s17_broker_catalogue", "SELECT p_partkey, p_name AS name, p_size IS NULL OR p_size < 10 AS supports_fractional FROM (SELECT p_partkey, p_name, CASE WHEN p_size = 7 THEN 10 ELSE p_size END AS p_size FROM part)")
def _(spark, d):
    body = F.to_json(F.struct(F.col("p_name").alias("name"), F.when(F.col("p_size") != 7, F.col("p_size") / 10).alias("minTradeQuantity")))
    return readers.broker_catalogue(fx.read(spark, d, "part").select("p_partkey", body.alias("payload")))


@query("s18_broker_orders", f"SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, (o_orderkey % 10 + 1)::DOUBLE AS quantity, {_pick_sql('o_orderkey', *_STATES.values())} AS status FROM orders")
def _(spark, d):
    sign = F.when(F.col("o_orderkey") % 2 == 0, 1.0).otherwise(-1.0)
    body = F.to_json(F.struct((sign * (F.col("o_orderkey") % 10 + 1)).alias("quantity"), _pick("o_orderkey", *_STATES).alias("status")))
    return readers.broker_orders(orders(spark, d).select("o_orderkey", body.alias("payload")))


@query("p1_candle_validation", with_tables("candles") + """, c AS (SELECT instrument_id, ts, CASE WHEN day(ts) = 7 THEN low / 2 ELSE high END AS high, open, low, close, CASE WHEN instrument_id % 9 = 4 AND day(ts) = 3 THEN 'EUR' ELSE 'USD' END AS currency FROM candles),
    k AS (SELECT *, max((currency <> 'USD')::INT) OVER (PARTITION BY instrument_id) = 1 AS rejected, NOT (high >= low AND high >= open AND high >= close) AS broken FROM c)
    SELECT instrument_id, count(*) FILTER (WHERE NOT rejected AND NOT broken) AS accepted, count(*) FILTER (WHERE NOT rejected AND broken) AS suspicious, bool_or(rejected) AS unit_mismatch FROM k GROUP BY instrument_id""")
def _(spark, d):
    c = fx.candles(spark, d).withColumn("high", F.when(F.dayofmonth("ts") == 7, F.col("low") / 2).otherwise(F.col("high")))
    euro = (F.col("instrument_id") % 9 == 4) & (F.dayofmonth("ts") == 3)
    rows = readers.validate(c.withColumn("currency", F.when(euro, "EUR").otherwise("USD")), F.lit("USD"))
    return rows.groupBy("instrument_id").agg(F.count_if(F.col("verdict") == "accepted").alias("accepted"), F.count_if(F.col("verdict") == "SUSPICIOUS_MOVE").alias("suspicious"), F.bool_or(F.col("verdict") == "UNIT_MISMATCH").alias("unit_mismatch"))


@query("s20_quality_events", with_tables("candles") + " SELECT instrument_id, 'SUSPICIOUS_MOVE' AS kind, count(*) AS n FROM candles WHERE day(ts) = 7 GROUP BY instrument_id")
def _(spark, d):
    c = fx.candles(spark, d).withColumn("high", F.when(F.dayofmonth("ts") == 7, F.col("low") / 2).otherwise(F.col("high")))
    rows = readers.validate(c.withColumn("currency", F.lit("USD")), F.lit("USD")).where("verdict <> 'accepted'")
    return rows.groupBy("instrument_id", F.col("verdict").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
