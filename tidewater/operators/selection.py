"""Selections, rankings and set operations over the catalogue."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .upkeep import ranked_by_range


def page(df: DataFrame, order: list, size: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(size)


def search(
    instruments: DataFrame, text: str | None = None, ids: Sequence[int] | None = None, lifecycle_state: str | None = None, bot_universe_only: bool = False, tradable_only: bool = False
) -> DataFrame:
    """Instruments whose name, ticker or ISIN holds the text, whatever its case, within what else is asked.

    % and _ of a text stand for any text and any character. An empty set of ids finds nothing; no set asks for none.
    """
    if ids is not None:
        instruments = instruments.where(F.col("instrument_id").isin(*ids) if ids else F.lit(False))
    if text:
        pattern = f"%{text.strip()}%"
        instruments = instruments.where(F.col("name").ilike(pattern) | F.col("ticker").ilike(pattern) | F.col("isin").ilike(pattern))
    if lifecycle_state:
        instruments = instruments.where(F.col("lifecycle_state") == lifecycle_state)
    if bot_universe_only:
        instruments = instruments.where("bot_universe")
    return instruments.where("NOT suspended") if tradable_only else instruments


def page_with_total(found: DataFrame, order: list, size: int, offset: int = 0) -> DataFrame:
    """A page, each row with the number of rows of all pages."""
    return page(found, order, size, offset).join(F.broadcast(found.agg(F.count(F.lit(1)).alias("total"))), F.lit(True))


def refresh_candidates(instruments: DataFrame, mappings: DataFrame, as_of: str) -> DataFrame:
    """Instruments to refresh: not suspended, in the bot universe or eligible, with an active mapping that does not rest.

    mappings: instrument_id, is_active, retry_after (NULL: never rested). A rest that ends at ``as_of`` is over.
    """
    due = F.col("retry_after").isNull() | (F.col("retry_after") <= F.lit(as_of).cast("timestamp"))
    ready = mappings.where(F.col("is_active") & due).select("instrument_id")
    return instruments.where("NOT suspended AND (bot_universe OR scanner_eligible)").join(ready, "instrument_id", "left_semi")


def rotation(instruments: DataFrame, pool: int, tradable_only: bool = False) -> DataFrame:
    """Eligible instruments, those scanned longest ago (or never) first."""
    rows = instruments.where("scanner_eligible AND NOT suspended")
    rows = rows.where("tradable") if tradable_only else rows
    return rows.orderBy(F.col("last_scanned_on").asc_nulls_first(), "instrument_id").limit(pool)


def tiered(tiers: list[tuple[str, DataFrame, Column]], eligible: DataFrame, cap: int) -> DataFrame:
    """Union of tiers; an instrument belongs to the first that has it; eligible ones only, at most ``cap``.

    tiers: (name, rows with instrument_id, order within the tier).
    """
    rows = [df.select("instrument_id", F.lit(i).alias("tier"), F.lit(name).alias("reason"), order.alias("pos")) for i, (name, df, order) in enumerate(tiers)]
    both = reduce(DataFrame.unionByName, rows)
    best = both.groupBy("instrument_id").agg(F.min(F.struct("tier", "pos", "reason")).alias("t"))
    kept = best.join(eligible.select("instrument_id"), "instrument_id", "left_semi")
    return kept.orderBy("t.tier", "t.pos", "instrument_id").limit(cap).select("instrument_id", F.col("t.tier").alias("tier"), F.col("t.reason").alias("reason"))


def chunks(windows: DataFrame, size: int, floor: str, store) -> DataFrame:
    """Fetch plan: newest starts first, ``size`` instruments a chunk, each chunk from its earliest start.

    store: as in ``upkeep.ranked_by_range``, which numbers the plan without one task that holds it all.
    """
    numbered = ranked_by_range(windows, [F.col("start").desc(), F.col("instrument_id")], store).withColumn("chunk", F.floor(F.col("nth") / size))
    start = F.greatest(F.min("start"), F.lit(floor).cast("timestamp"))
    return numbered.groupBy("chunk").agg(start.alias("chunk_start"), F.count(F.lit(1)).alias("n"))


def universe(ranked: DataFrame, held: DataFrame) -> DataFrame:
    """Ranked instruments and then held ones that are not ranked."""
    more = held.select("instrument_id").distinct().join(ranked.select("instrument_id"), "instrument_id", "left_anti")
    return ranked.select("instrument_id", F.lit("ranked").alias("why")).unionByName(more.select("instrument_id", F.lit("held").alias("why")))


def first_mapping(mappings: DataFrame) -> DataFrame:
    """The active mapping of lowest priority number of each instrument."""
    order = Window.partitionBy("instrument_id").orderBy("priority", "symbol")
    return mappings.where("is_active").withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def unique_match(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) where exactly one row has the key."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.first(value).alias(value)).where("n = 1").drop("n")


def resolve(batch: DataFrame, known: DataFrame) -> DataFrame:
    """Identity by ISIN, then by venue and ticker, else new; the batch is made distinct first.

    batch, known: isin, venue, ticker; known: instrument_id.
    """
    rows = batch.dropDuplicates(["isin", "venue", "ticker"])
    by_isin = unique_match(known.where("isin IS NOT NULL"), "isin", "instrument_id").withColumnRenamed("instrument_id", "i1")
    by_name = known.groupBy("venue", "ticker").agg(F.min("instrument_id").alias("i2"))
    out = rows.join(by_isin, "isin", "left").join(by_name, ["venue", "ticker"], "left")
    tier = F.when(F.col("i1").isNotNull(), "isin").when(F.col("i2").isNotNull(), "ticker").otherwise("new")
    return out.select("isin", "venue", "ticker", F.coalesce("i1", "i2").alias("instrument_id"), tier.alias("tier"), F.col("isin").isNull().alias("needs_confirmation"))
