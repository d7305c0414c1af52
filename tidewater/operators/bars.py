"""Candle tables: scans, latest bars, upserts, coverage, freshness and gaps.

Every operator takes ``as_of`` where a live system would ask for the time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of each bar size and bars of a year.
BAR_SECONDS = {"1m": 60, "5m": 300, "15m": 900, "1h": 3600, "4h": 14400, "1d": 86400, "1w": 604800}
BARS_A_YEAR = {"1d": 252, "1w": 52, "1h": 1764, "15m": 6552}
KEY = ["instrument_id", "interval", "ts", "series_type"]


def bar_seconds(interval: Column) -> Column:
    return F.element_at(F.create_map(*[x for k, v in BAR_SECONDS.items() for x in (F.lit(k), F.lit(v))]), interval)


def annualisation(interval: Column) -> Column:
    """Bars a year of an interval; 252 for those that are not listed."""
    known = F.create_map(*[x for k, v in BARS_A_YEAR.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(known, interval), F.lit(252))


def is_closed(ts: Column, interval: Column, as_of: Column) -> Column:
    """A bar that opens at ``ts`` has ended by ``as_of``; the very end counts."""
    return F.unix_timestamp(ts) + bar_seconds(interval) <= F.unix_timestamp(as_of)


def newest_first(df: DataFrame, n: int | None = None, key: str = "instrument_id", order: str = "ts") -> DataFrame:
    """``rn`` counts each instrument's bars from the newest; only the newest ``n`` stay."""
    out = df.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc())))
    return out if n is None else out.where(F.col("rn") <= n)


def scan(
    bars: DataFrame, start: str | None = None, end: str | None = None, limit: int | None = None, closed_only: bool = True, as_of: str | None = None, interval: str = "1d",
    series_type: str = "raw", tradable_only: bool = False,
) -> DataFrame:
    """Bars of an interval and series with start <= ts <= end, the newest ``limit`` of each instrument; closed ones, and ones fit for trading, if asked.

    Tables without an interval or series hold one of them. On a table that is cut by these the filters choose folders.
    """
    for column, value in (("interval", interval), ("series_type", series_type)):
        if column in bars.columns:
            bars = bars.where(F.col(column) == value)
    if start:
        bars = bars.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end:
        bars = bars.where(F.col("ts") <= F.lit(end).cast("timestamp"))
    if closed_only and as_of:
        bars = bars.where(is_closed(F.col("ts"), F.lit(interval), F.lit(as_of).cast("timestamp")))
    if tradable_only:
        bars = bars.where("quality = 'OK'")
    return newest_first(bars, limit).drop("rn") if limit else bars


def latest(bars: DataFrame) -> DataFrame:
    """The newest bar of each instrument."""
    rest = [c for c in bars.columns if c != "instrument_id"]
    return bars.groupBy("instrument_id").agg(F.max_by(F.struct(*rest), "ts").alias("bar")).select("instrument_id", "bar.*")


def latest_times(bars: DataFrame) -> DataFrame:
    return bars.groupBy("instrument_id").agg(F.max("ts").alias("latest_ts"))


def counts(bars: DataFrame, least: int) -> DataFrame:
    out = bars.groupBy("instrument_id").agg(F.count(F.lit(1)).alias("n_bars"))
    return out.withColumn("has_history", F.col("n_bars") >= least)


def coherent(o="open", h="high", low="low", c="close") -> Column:
    """The high is highest, the low lowest, and open and close are positive."""
    o, h, low, c = map(F.col, (o, h, low, c))
    return (h >= low) & (h >= o) & (h >= c) & (low <= o) & (low <= c) & (o > 0) & (c > 0)


def with_quality(bars: DataFrame) -> DataFrame:
    """What a fetched bar's quality is when it is stored."""
    return bars.withColumn("quality", F.when(coherent(), "OK").otherwise("SUSPECT"))


def upsert(
    stored: DataFrame, batch: DataFrame, first_wins: tuple[str, ...] = ("currency", "price_unit", "is_adjusted"), key: list[str] | None = None, dealt: tuple[str, ...] = (),
) -> DataFrame:
    """One row a key: the values that were read last, but ``first_wins`` columns as first stored.

    Rows are dealt as they are, since few keys have two and buffers are wider than rows, and sorted by a hash of the key
    first, which tells keys apart at once. ``dealt`` are columns that the key decides, by which rows are dealt instead; they stay.
    """
    key = [*dealt, *(key or [c for c in KEY if c in stored.columns])]
    rest = [c for c in stored.columns if c not in key]
    kept = [c for c in first_wins if c in rest]
    rows = stored.unionByName(batch).repartition(*(dealt or key)).withColumn("_hash", F.xxhash64(*key)).groupBy("_hash", *key)
    last = F.max_by(F.struct(*rest), "retrieved_at").alias("last")
    firsts = [F.min_by(c, "retrieved_at").alias(f"first_{c}") for c in kept]
    return rows.agg(last, *firsts).select(*key, *[F.col(f"first_{c}").alias(c) if c in kept else F.col(f"last.{c}").alias(c) for c in rest])


def purge_unclosed(bars: DataFrame, as_of: str, interval: str = "1d") -> DataFrame:
    return bars.where(is_closed(F.col("ts"), F.lit(interval), F.lit(as_of).cast("timestamp")))


def mark_stale(bars: DataFrame, older_than: str) -> DataFrame:
    old = (F.col("ts") < F.lit(older_than).cast("timestamp")) & (F.col("quality") == "OK")
    return bars.withColumn("quality", F.when(old, "STALE").otherwise(F.col("quality")))


def coverage(bars: DataFrame, as_of: str) -> DataFrame:
    return bars.groupBy("instrument_id").agg(
        F.count(F.lit(1)).alias("n_bars"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_if(F.col("quality") != "OK").alias("not_ok"),
        (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.max("ts"))).alias("age_seconds"),
    )


def freshness(instruments: DataFrame, bars: DataFrame, as_of: str, most_days: int) -> DataFrame:
    """UNAVAILABLE without a bar, STALE if the newest is older than ``most_days``, else its own quality."""
    last = bars.groupBy("instrument_id").agg(F.max("ts").alias("last_ts"), F.max_by("quality", "ts").alias("quality"))
    age = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("last_ts")
    stale = F.coalesce(age > most_days * 86400, F.lit(True))
    state = F.when(F.col("last_ts").isNull(), "UNAVAILABLE").when(stale, "STALE").otherwise(F.col("quality"))
    return instruments.select("instrument_id").join(last, "instrument_id", "left").select("instrument_id", stale.alias("is_stale"), state.alias("freshness"))


def gaps(bars: DataFrame, schedule: DataFrame) -> DataFrame:
    """(instrument_id, ts) of the schedule that have no bar."""
    return schedule.join(bars.select("instrument_id", "ts"), ["instrument_id", "ts"], "left_anti")


def sample(instruments: DataFrame, n: int, seed: str) -> DataFrame:
    """``n`` instruments in an order that only the seed decides."""
    return instruments.orderBy(F.md5(F.concat(F.col("instrument_id").cast("string"), F.lit(seed))), "instrument_id").limit(n)
