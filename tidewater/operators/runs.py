"""Runs that count while they write: ingestion, enrichment, strategy decisions; chains of providers.

Totals are observed in the job that writes a run's rows (``DataFrame.observe``), so nothing is read again for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.scratch import stored
from . import bars

#: The fields by whose presence coverage is judged, and those that make a profile useful.
COVERED = ("market_cap", "trailing_pe", "price_to_book", "dividend_yield", "profit_margin")
USEFUL = ("trailing_pe", "price_to_book", "profit_margin", "dividend_yield")
UNCLASSIFIED = "Unclassified"


def counted(rows: DataFrame, name: str, **totals: Column) -> tuple[DataFrame, dict]:
    """``rows`` written and read again, and totals over them from the job that wrote them."""
    seen = Observation(name)
    kept = stored(rows.observe(seen, *[F.coalesce(c, F.lit(0)).cast("long").alias(k) for k, c in totals.items()]), name)
    return kept, seen.get


def totals_row(spark, totals: dict) -> DataFrame:
    return spark.createDataFrame([tuple(totals.values())], ", ".join(f"{k} long" for k in totals))


def ingestion_run(queue: DataFrame, feed: DataFrame, candles: DataFrame, order: list[Column], budget: int) -> tuple[DataFrame, DataFrame, dict]:
    """(a row for each instrument that was reached, candles after, totals of the run).

    queue: instrument_id, symbol (NULL: no mapping). feed: what the vendor has, symbol, error (NULL: none) and the
    columns of stored candles but instrument_id; a row with an error has no bar. The vendor answers ``budget``
    instruments of the queue in its order; the rest keep their place and are not processed. An instrument without
    a mapping or without bars is skipped with a reason, one whose answer has an error failed.
    """
    reached = queue.orderBy(*order).limit(budget)
    answers = feed.join(reached.where("symbol IS NOT NULL").select("instrument_id", "symbol"), "symbol")
    batch = answers.where("error IS NULL").select(*candles.columns)
    per = answers.groupBy("instrument_id").agg(F.count_distinct(F.when(F.col("error").isNull(), F.col("ts"))).alias("n"), F.max("error").alias("error"))
    rows = reached.join(per, "instrument_id", "left")
    why = F.when(F.col("symbol").isNull(), "no active mapping").when(F.col("error").isNull() & (F.coalesce("n", F.lit(0)) == 0), "no new bars")
    rows = rows.select("instrument_id", "symbol", F.coalesce("n", F.lit(0)).cast("long").alias("candles_written"), "error", why.alias("skipped_reason"))
    kept, totals = counted(
        rows, "ingestion", processed=F.count(F.lit(1)), written=F.sum("candles_written"), failed=F.count("error"), skipped=F.count("skipped_reason"), attempted=F.count_if(F.col("symbol").isNotNull())
    )
    return kept, bars.upsert(candles, batch), totals


#: Intervals below a day.
INTRADAY = tuple(k for k, seconds in bars.BAR_SECONDS.items() if seconds < 86_400)


def intraday_run(requests: DataFrame, providers: DataFrame, mappings: DataFrame, feed: DataFrame, candles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a row for each request, candles after): intraday bars of the providers that serve them.

    requests: instrument_id, interval, provider, start (of the window). providers: provider, supports_intraday.
    mappings: instrument_id, provider, symbol, which are only read, so an empty answer does not feed the backoff.
    feed: provider, symbol and the columns of candles but instrument_id. candles: on the four-part key, raw series.
    """
    rows = requests.join(F.broadcast(providers), "provider", "left").join(mappings, ["instrument_id", "provider"], "left")
    guard = (
        F.when(~F.col("interval").isin(*INTRADAY), F.concat("interval", F.lit(" is not an intraday interval")))
        .when(~F.coalesce("supports_intraday", F.lit(False)), F.concat("provider", F.lit(" does not provide intraday data")))
        .when(F.col("symbol").isNull(), F.concat(F.lit("no active "), "provider", F.lit(" mapping")))
    )
    rows = stored(rows.withColumn("guard", guard), "intraday")
    asked = rows.where("guard IS NULL").select("instrument_id", "interval", "provider", "symbol", "start")
    got = asked.join(feed, ["provider", "symbol", "interval"]).where("ts >= start")
    n = got.groupBy("instrument_id", "interval", "provider").agg(F.count_distinct("ts").alias("n"))
    out = rows.join(n, ["instrument_id", "interval", "provider"], "left")
    why = F.coalesce("guard", F.when(F.col("n").isNull(), "no candles for the requested window"))
    out = out.select("instrument_id", "interval", "provider", F.coalesce("n", F.lit(0)).cast("long").alias("candles_written"), why.alias("skipped_reason"))
    return out, bars.upsert(candles, got.select(*candles.columns))


def strategy_run(decisions: DataFrame) -> tuple[DataFrame, dict]:
    """Decisions (outcome, stale) written, and how many signals there were and what became of them."""
    out = F.col("outcome")
    return counted(decisions, "strategy", signals=F.count(F.lit(1)), executed=F.count_if(out == "executed"), rejected=F.count_if(out == "rejected"), skipped=F.count_if(out == "skipped"), stale=F.count_if("stale"))


def enrichment_run(instruments: DataFrame, profiles: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame, dict]:
    """(instruments after, a snapshot of every one that was asked for, totals).

    instruments: instrument_id, sector, industry, asked. profiles: instrument_id, new_sector, new_industry and
    fundamentals. A profile's sector replaces the stored one; an industry fills only an empty one, with
    ``Unclassified`` if the profile has none. Every attempt writes a snapshot, an empty one too.
    """
    rows = instruments.join(profiles, "instrument_id", "left")
    told = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    useful = F.coalesce(*[F.when(F.col(c).isNotNull(), True) for c in USEFUL], F.lit(False))
    industry = F.when(told("industry"), F.col("industry")).otherwise(F.when(told("new_industry"), F.col("new_industry")).otherwise(UNCLASSIFIED))
    after = rows.withColumns(
        {"sector": F.when(F.col("asked") & told("new_sector"), F.col("new_sector")).otherwise(F.col("sector")), "industry": F.when(F.col("asked"), industry).otherwise(F.col("industry"))}
    )
    asked = F.col("asked")
    known = asked & F.coalesce(told("new_sector"), F.lit(False))
    kept, totals = counted(
        after.withColumns({"classified": known, "useful": asked & useful}), "enrichment", attempted=F.count_if(asked), classified=F.count_if("classified"), unclassified=F.count_if(asked & ~F.col("classified")),
        with_fundamentals=F.count_if("useful"),
    )
    fields = [c for c in profiles.columns if c not in ("instrument_id", "new_sector", "new_industry")]
    return kept.select("instrument_id", "sector", "industry"), kept.where("asked").select("instrument_id", F.lit(as_of).cast("date").alias("as_of"), *fields), totals


def coverage_run(attempts: DataFrame) -> tuple[DataFrame, dict]:
    """(by venue: attempts, hits and their ratio, totals over all attempts).

    attempts: venue, symbol (NULL: unsupported venue), found, and the fields of ``COVERED``. A hit has one of them.
    """
    there = F.col("symbol").isNotNull() & F.col("found")
    has = {c: there & F.col(c).isNotNull() for c in COVERED}
    hit = F.coalesce(*[F.when(x, True) for x in has.values()], F.lit(False))
    totals = {"attempted": F.count(F.lit(1)), "unsupported": F.count_if(F.col("symbol").isNull()), "not_found": F.count_if(F.col("symbol").isNotNull() & ~F.col("found")), "had_data": F.count_if(hit)}
    kept, seen = counted(attempts, "coverage", **totals, **{c: F.count_if(x) for c, x in has.items()})
    by = kept.groupBy("venue").agg(F.count(F.lit(1)).alias("attempts"), F.count_if(hit).alias("hits"))
    return by.withColumn("hit_ratio", F.col("hits") / F.col("attempts")), seen


def provider_chain(instruments: DataFrame, answers: DataFrame, chain: list[str]) -> DataFrame:
    """instrument_id, served_by, candles_written and, where no provider of the chain serves it, why the last one did not.

    answers: instrument_id, provider, error (not configured, quota spent, down), skipped_reason, candles_written.
    One pass over all providers' answers; the first in the chain that gives neither error nor reason serves.
    """
    rank = F.array_position(F.array(*map(F.lit, chain)), F.col("provider"))
    why = F.coalesce("error", "skipped_reason")
    rows = answers.where(rank > 0).select("instrument_id", rank.alias("rank"), "provider", "candles_written", F.when(why.isNotNull(), F.concat_ws(": ", "provider", why)).alias("reason"))
    best = F.min_by(F.struct("provider", "candles_written"), F.when(F.col("reason").isNull(), F.col("rank"))).alias("s")
    per = rows.groupBy("instrument_id").agg(best, F.max_by("reason", "rank").alias("last"))
    out = instruments.select("instrument_id").join(per, "instrument_id", "left")
    reason = F.when(F.col("s.provider").isNull(), F.coalesce("last", F.lit("no provider in the chain")))
    return out.select("instrument_id", F.col("s.provider").alias("served_by"), F.coalesce("s.candles_written", F.lit(0)).cast("long").alias("candles_written"), reason.alias("unserved"))
