"""Upkeep of the catalogue: broker sync, symbol mappings, backfill, sector proxies, on-demand refresh.

Each operator takes the stored rows and what a broker or vendor returned, and gives the rows that change,
with what happened to each; nothing is written here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalise as nm
from . import bars, scoring

#: The sector proxies, by symbol.
SECTOR_PROXIES = {
    "XLK": "Technology Select Sector SPDR Fund", "XLF": "Financial Select Sector SPDR Fund", "XLV": "Health Care Select Sector SPDR Fund", "XLY": "Consumer Discretionary Select Sector SPDR Fund",
    "XLP": "Consumer Staples Select Sector SPDR Fund", "XLE": "Energy Select Sector SPDR Fund", "XLI": "Industrial Select Sector SPDR Fund", "XLB": "Materials Select Sector SPDR Fund",
    "XLRE": "Real Estate Select Sector SPDR Fund", "XLU": "Utilities Select Sector SPDR Fund", "XLC": "Communication Services Select Sector SPDR Fund",
}


def sync_catalogue(listing: DataFrame, stored: DataFrame, known: DataFrame) -> DataFrame:
    """What a broker's listing changes: a row for every listed ticker and every delisted one.

    listing: broker_ticker (one row each), isin, name, available. stored: broker_ticker, is_available.
    known: instrument_id, isin, venue, ticker. action: created, updated, or delisted (stored as available
    but not listed; kept, as positions refer to it). tier: how the instrument was identified: by ISIN (on
    the venue, if the ticker tells one), else by venue and ticker, else a new instrument; of several rows of
    one new instrument the first by ticker makes it and the others match it. An instrument found by ticker
    that lacks an ISIN takes the listing's (fills_isin). A new one without ISIN needs confirmation.
    """
    rows = listing.withColumns({"venue": nm.broker_venue(F.col("broker_ticker")), "bare": nm.broker_bare(F.col("broker_ticker"))})
    k = known.select("instrument_id", F.col("isin").alias("k_isin"), F.col("venue").alias("k_venue"), F.col("ticker").alias("k_ticker"))
    by_isin = rows.join(k, (F.col("isin") == F.col("k_isin")) & (F.col("venue").isNull() | (F.col("venue") == F.col("k_venue"))))
    by_isin = by_isin.groupBy("broker_ticker").agg(F.min("instrument_id").alias("i1"))
    by_name = rows.join(k, (F.col("venue") == F.col("k_venue")) & (F.col("bare") == F.col("k_ticker")))
    by_name = by_name.groupBy("broker_ticker").agg(F.min_by(F.struct("instrument_id", F.col("k_isin").isNull().alias("bare_isin")), "instrument_id").alias("i2"))
    out = rows.join(by_isin, "broker_ticker", "left").join(by_name, "broker_ticker", "left")
    found = F.coalesce("i1", "i2.instrument_id")
    identity = F.when(F.col("isin").isNotNull(), F.concat_ws("|", F.lit("isin"), "isin", "venue")).when(F.col("venue").isNotNull(), F.concat_ws("|", F.lit("name"), "bare", "venue")).otherwise(F.concat_ws("|", F.lit("ticker"), "broker_ticker"))
    nth = F.row_number().over(Window.partitionBy(found.isNull(), identity).orderBy("broker_ticker"))
    tier = F.when(F.col("i1").isNotNull(), "isin").when(F.col("i2").isNotNull(), "ticker").when(nth == 1, "new").when(F.col("isin").isNotNull(), "isin").otherwise("ticker")
    out = out.withColumns({"instrument_id": found, "tier": tier, "fills_isin": F.col("i1").isNull() & F.coalesce("i2.bare_isin", F.lit(False)) & F.col("isin").isNotNull()})
    had = stored.select("broker_ticker", F.lit(True).alias("had"))
    out = out.join(had, "broker_ticker", "left").withColumn("action", F.when(F.col("had"), "updated").otherwise("created"))
    out = out.withColumn("needs_confirmation", (F.col("tier") == "new") & F.col("isin").isNull())
    gone = stored.where("is_available").join(listing.select("broker_ticker"), "broker_ticker", "left_anti")
    columns = ["broker_ticker", "action", "tier", "instrument_id", "fills_isin", "needs_confirmation", "available"]
    return out.select(*columns).unionByName(gone.select("broker_ticker", F.lit("delisted").alias("action"), F.lit(False).alias("available")), allowMissingColumns=True)


def sync_counts(changes: DataFrame) -> DataFrame:
    is_ = lambda c, v: F.count_if(F.col(c) == v)
    return changes.agg(
        F.count_if(F.col("action") != "delisted").alias("listed"), is_("action", "created").alias("created"), is_("action", "updated").alias("updated"), is_("action", "delisted").alias("delisted"),
        is_("tier", "new").alias("instruments_created"), is_("tier", "isin").alias("matched_by_isin"), F.count_if("needs_confirmation").alias("needing_confirmation"),
    )


def resolve_mappings(stored: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mappings after a vendor was asked, and instruments that have to be confirmed.

    stored: instrument_id, provider, symbol, confirmed, is_signal_source, one row a pair of the first two.
    answers: instrument_id, provider, asks_signal (is it to be the signal source), and answer (NULL: not
    identified) with requires_confirmation. A mapping that a user confirmed stays as it is. Else an answer
    replaces or makes the mapping; if it becomes the signal source, the instrument's other mappings stop
    being that. An answer below the ISIN tier holds the instrument at MAPPING_REQUIRED.
    """
    a = answers.select("instrument_id", "provider", "answer", "requires_confirmation", "asks_signal")
    both = stored.join(a, ["instrument_id", "provider"], "full")
    taken = F.col("answer").isNotNull() & ~F.coalesce("confirmed", F.lit(False))
    both = both.withColumn("taken", taken).withColumn("moves", F.col("taken") & F.col("asks_signal"))
    moved = F.max("moves").over(Window.partitionBy("instrument_id"))
    was = F.coalesce("is_signal_source", F.lit(False))
    outcome = (
        F.when(F.coalesce("confirmed", F.lit(False)) & F.col("asks_signal").isNotNull(), "already confirmed by user").when(F.col("asks_signal").isNull(), "not asked")
        .when(F.col("answer").isNull(), "not identified").when(F.col("symbol").isNull(), "created").otherwise("updated")
    )
    out = both.select(
        "instrument_id", "provider", F.when(F.col("taken"), F.col("answer")).otherwise(F.col("symbol")).alias("symbol"), F.coalesce("confirmed", F.lit(False)).alias("confirmed"),
        F.when(F.col("moves"), True).otherwise(was & ~moved).alias("is_signal_source"), outcome.alias("outcome"),
    )
    held = both.where(F.col("taken") & F.col("requires_confirmation")).select("instrument_id", F.lit("MAPPING_REQUIRED").alias("lifecycle_state")).distinct()
    return out, held


def confirm(mappings: DataFrame, lifecycle: DataFrame, confirmed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mappings after, instruments' states after) a user confirmed some mappings.

    mappings: instrument_id, provider, symbol, confirmed, is_signal_source. lifecycle: instrument_id,
    lifecycle_state. confirmed: instrument_id, provider, override (a symbol of the user's, or NULL), as_signal
    (it becomes the one signal source of its instrument; the first provider in order if several ask).
    Confirming a mapping that does not exist does nothing. An instrument that waited for its mapping goes on to
    its history; other states stay.
    """
    key = ["instrument_id", "provider"]
    both = mappings.join(confirmed.withColumn("asked", F.lit(True)), key, "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
    chosen = both.where("asked AND as_signal").groupBy("instrument_id").agg(F.min("provider").alias("chosen"))
    own = F.col("asked") & F.col("override").isNotNull() & (F.col("override") != "")
    manual = own & (F.col("override") != F.col("symbol"))
    after = both.join(chosen, "instrument_id", "left").select(
        *key, F.when(own, F.col("override")).otherwise(F.col("symbol")).alias("symbol"), (F.col("confirmed") | F.col("asked")).alias("confirmed"),
        F.when(F.col("chosen").isNotNull(), F.col("chosen") == F.col("provider")).otherwise(F.col("is_signal_source")).alias("is_signal_source"),
        F.when(F.coalesce(manual, F.lit(False)), "manual_user_override").alias("resolution"),
    )
    done = both.where("asked").select("instrument_id", F.lit(True).alias("done")).distinct()
    moved = F.col("done").isNotNull() & (F.col("lifecycle_state") == "MAPPING_REQUIRED")
    states = lifecycle.join(done, "instrument_id", "left").select("instrument_id", F.when(moved, "DATA_BACKFILL").otherwise(F.col("lifecycle_state")).alias("lifecycle_state"))
    return after, states


def map_by_ticker(instruments: DataFrame, mappings: DataFrame) -> DataFrame:
    """instrument_id, symbol and whether its mapping is new; symbol is NULL where the venue is not supported."""
    symbol = nm.vendor_symbol(nm.ticker(F.col("ticker")), F.col("venue"))
    have = mappings.select("instrument_id", F.lit(True).alias("have")).distinct()
    out = instruments.select("instrument_id", symbol.alias("symbol")).join(have, "instrument_id", "left")
    return out.select("instrument_id", "symbol", (F.col("symbol").isNotNull() & F.col("have").isNull()).alias("mapping_created"))


def backfill(instruments: DataFrame, mappings: DataFrame, feed: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a row an instrument, candles after): map by ticker and venue, then upsert what the vendor returned.

    feed: symbol and the columns of stored candles but instrument_id. status: unsupported (no symbol),
    no data, or ingested.
    """
    mapped = map_by_ticker(instruments, mappings)
    batch = feed.join(mapped.where("symbol IS NOT NULL").select("instrument_id", "symbol"), "symbol").drop("symbol")
    written = batch.groupBy("instrument_id").agg(F.count_distinct("ts").alias("n"))
    status = F.when(F.col("symbol").isNull(), "unsupported").when(F.col("n").isNull(), "no data").otherwise("ingested")
    rows = mapped.join(written, "instrument_id", "left")
    rows = rows.select("instrument_id", "symbol", "mapping_created", status.alias("status"), F.coalesce("n", F.lit(0)).cast("long").alias("candles_written"))
    return rows, bars.upsert(stored, batch.select(*stored.columns))


def ensure_proxies(mappings: DataFrame, feed: DataFrame) -> DataFrame:
    """A row for each sector proxy: the instrument that its symbol maps to, or one to be made, and candles to ingest."""
    spark = mappings.sparkSession
    wanted = spark.createDataFrame(list(SECTOR_PROXIES.items()), "symbol string, name string")
    have = mappings.groupBy("symbol").agg(F.min("instrument_id").alias("instrument_id"))
    n = feed.groupBy("symbol").agg(F.count_distinct("ts").alias("candles_written"))
    out = F.broadcast(wanted).join(have, "symbol", "left").join(n, "symbol", "left")
    return out.select("symbol", "name", "instrument_id", F.col("instrument_id").isNull().alias("created"), F.coalesce("candles_written", F.lit(0)).cast("long").alias("candles_written"))


def refresh_named(named: DataFrame, backfilled: DataFrame, scored: DataFrame, counts: DataFrame) -> DataFrame:
    """The named instruments after map, ingest and score: the ad-hoc score, or why there is none.

    backfilled: rows of ``backfill``; scored: rows of the scan; counts: instrument_id, n_bars stored.
    """
    out = named.select("instrument_id").join(backfilled.select("instrument_id", "status", "candles_written"), "instrument_id", "left")
    out = out.join(counts.select("instrument_id", "n_bars"), "instrument_id", "left").join(scored.select("instrument_id", "final_score", "classification"), "instrument_id", "left")
    reason = F.when(F.col("status") == "unsupported", "venue not supported").when(F.col("status").isNull(), "unknown instrument").when(F.coalesce("n_bars", F.lit(0)) < scoring.LEAST_BARS, "not enough history")
    score = lambda c: F.when(reason.isNull(), F.col(c)).alias(c)
    return out.select("instrument_id", F.lit(True).alias("is_ad_hoc"), "candles_written", score("final_score"), score("classification"), reason.alias("reason"))


def ranked_by_range(rows: DataFrame, order: list[Column], store) -> DataFrame:
    """``rows`` with ``nth`` from 0 in the order: ranked within ranges that Spark's samples cut, each started where the ranges before end.

    store: writes a DataFrame and reads it again, so that ranges stay as they were cut.
    """
    dealt = store(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    out = dealt.join(F.broadcast(starts), "_part").withColumn("nth", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1 + F.col("_start"))
    return out.drop("_part", "_start")
