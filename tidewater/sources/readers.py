"""Readers of vendor payloads: wide frames, JSON, XML, feeds and markdown, as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalise as nm
from ..operators.bars import coherent
from .scratch import stored

#: Instruments of another unit that are sent to all tasks.
WRONG_UNITS = 200_000


def wide_frame(frame: DataFrame, unit: str = "USD") -> DataFrame:
    """Vendor columns to candles: numbers cleaned, unit normalised, incomplete and incoherent bars dropped."""
    types = dict(frame.dtypes)
    read = lambda c: nm.number(F.col(c) if types[c] == "double" else F.col(c).cast("string"))
    price = lambda c: nm.normalise_price(read(c), F.lit(unit)).alias(c.lower())
    # a generator, since filters are not pushed below one: they would read every text again for each comparison
    bar = F.struct(*[price(c) for c in ("Open", "High", "Low", "Close")], read("Volume").alias("volume"))
    rows = frame.select("instrument_id", F.col("Date").alias("ts"), F.inline(F.array(bar)))
    return rows.dropna(subset=["open", "high", "low", "close"]).where(coherent())


def split_symbols(frame: DataFrame, fields: list[str], key: list[str]) -> DataFrame:
    """Columns named ``symbol|field`` to one row a symbol and key; symbols without values give none."""
    symbols = dict.fromkeys(c.split("|")[0] for c in frame.columns if "|" in c)
    cell = lambda s: F.struct(F.lit(s).alias("symbol"), *[F.col(f"`{s}|{f}`").alias(f.lower()) for f in fields])
    rows = frame.select(*key, F.explode(F.array(*map(cell, symbols))).alias("x")).select(*key, "x.*")
    return rows.dropna("all", subset=[f.lower() for f in fields])


SERIES = "status string, meta struct<symbol: string>, values array<struct<datetime: string, close: string>>"


def json_series(payloads: DataFrame) -> DataFrame:
    """A time-series payload to rows; failed payloads and unreadable values are left out."""
    p = payloads.select(F.from_json("payload", SERIES).alias("p")).where("p.status <> 'error'")
    rows = p.select(F.col("p.meta.symbol").alias("symbol"), F.explode("p.values").alias("v"))
    return rows.select("symbol", F.try_to_timestamp(F.col("v.datetime")).alias("ts"), nm.number(F.col("v.close")).alias("close")).where("ts IS NOT NULL AND close IS NOT NULL")


FUNDAMENTALS = "Valuation struct<TrailingPE: double>, Highlights struct<PERatio: double, MarketCapitalization: double>"


def json_fundamentals(payloads: DataFrame) -> DataFrame:
    """A ratio of zero counts as missing, and the second place is asked; other columns stay."""
    p = payloads.withColumn("p", F.from_json("payload", FUNDAMENTALS))
    pe = F.coalesce(F.nullif(F.col("p.Valuation.TrailingPE"), F.lit(0.0)), F.col("p.Highlights.PERatio"))
    return p.select(*[c for c in payloads.columns if c != "payload"], pe.alias("trailing_pe"), F.col("p.Highlights.MarketCapitalization").alias("market_cap"))


def yield_as_share(x: Column) -> Column:
    """Yields above one are percentages."""
    return F.when(x > 1, x / 100).otherwise(x)


def newest_value(rows: DataFrame) -> DataFrame:
    """(series, date, raw) -> the newest value of each series that is neither a dot nor empty."""
    known = rows.where(~F.col("raw").isin(".", "")).withColumn("value", nm.number(F.col("raw")))
    return known.where("value IS NOT NULL").groupBy("series").agg(F.max_by("value", "date").alias("value"))


def ownership_lines(filings: DataFrame) -> DataFrame:
    """Filing XML to its transaction lines, header fields repeated, lines numbered from 0."""
    field = lambda c, tag: F.regexp_extract(c, f"<{tag}>(.*?)</{tag}>", 1)
    blocks = F.regexp_extract_all("xml", F.lit(r"(?s)<nonDerivativeTransaction>(.*?)</nonDerivativeTransaction>"), F.lit(1))
    rows = filings.select("accession", nm.unescape(field(F.col("xml"), "officerTitle")).alias("title"), F.posexplode(blocks).alias("line_index", "block"))
    block = F.col("block")
    return rows.select("accession", "title", "line_index", field(block, "transactionCode").alias("code"), nm.number(field(block, "shares")).alias("shares"), nm.number(field(block, "price")).alias("price"))


def feed_links(pages: DataFrame) -> DataFrame:
    """Distinct filing index links, the first of each accession."""
    found = pages.select(F.explode(F.regexp_extract_all("page", F.lit('href="([^"]*-index\\.htm)"'), F.lit(1))).alias("url"))
    return found.withColumn("accession", nm.accession(F.col("url"))).groupBy("accession").agg(F.min("url").alias("url"))


def diff_rows(diffs: DataFrame) -> DataFrame:
    """Added table rows of a markdown diff: company, role without links, amount."""
    rows = diffs.select("o_orderkey", F.posexplode(F.split("diff", "\n")).alias("line_no", "line"))
    added = rows.where(F.col("line").rlike(r"^\+[^+].*\|.*\|") & ~F.col("line").rlike(r"^\+\s*\|[\s:|-]+$"))
    cell = F.split(F.regexp_replace("line", r"^\+\s*\|", ""), r"\|")
    company = F.regexp_extract(F.trim(cell[0]), nm.LINK, 1)
    role = F.trim(F.regexp_replace(cell[1], r"\[[^\]]*\]\([^)]*\)", ""))
    return added.select("o_orderkey", "line_no", company.alias("company"), role.alias("role"), F.regexp_replace(cell[2], r"[^0-9.]", "").try_cast("double").alias("amount"))


def broker_catalogue(payloads: DataFrame) -> DataFrame:
    p = payloads.withColumn("p", F.from_json("payload", "name string, minTradeQuantity double"))
    return p.select("p_partkey", F.col("p.name").alias("name"), (F.coalesce(F.col("p.minTradeQuantity"), F.lit(1.0)) < 1).alias("supports_fractional"))


def broker_orders(payloads: DataFrame) -> DataFrame:
    """The sign of a quantity is the side; unknown states are ``unknown``."""
    p = payloads.withColumn("p", F.from_json("payload", "quantity double, status string"))
    q = F.col("p.quantity")
    return p.select("o_orderkey", F.when(q >= 0, "buy").otherwise("sell").alias("side"), F.abs(q).alias("quantity"), nm.lookup(nm.ORDER_STATES, F.col("p.status"), "unknown").alias("status"))


def validate(candles: DataFrame, expected: Column) -> DataFrame:
    """``verdict``: accepted, SUSPICIOUS_MOVE for incoherent bars, UNIT_MISMATCH for a whole instrument.

    Instruments of another unit are few where a feed is sound; bars are only moved where these are too many to send to all.
    """
    wrong = candles.where(F.col("currency") != expected).select(F.col("instrument_id").alias("_wrong")).distinct()
    if (found := stored(wrong, "units")).count() <= WRONG_UNITS:
        found = F.broadcast(found)
    rows = candles.join(found.withColumn("_is", F.lit(True)), F.col("instrument_id").eqNullSafe(F.col("_wrong")), "left")
    return rows.withColumn("verdict", F.when(F.col("_is"), "UNIT_MISMATCH").when(~coherent(), "SUSPICIOUS_MOVE").otherwise("accepted")).drop("_wrong", "_is")
