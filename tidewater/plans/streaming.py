"""Queries that run streams over the tables until they are drained, and sinks read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import trading
from ..sources import fixtures as fx
from ..sources import sinks
from ..sources.fixtures import with_tables
from ..sources.scratch import folder
from ..streaming import streams
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


def drop(parts: list[DataFrame], path: str) -> str:
    """Write each part as files of its own, as many as the cluster has cores; a stream takes a part's files a batch."""
    for k, part in enumerate(parts):
        part.repartition(streams.files_of_a_part(part.sparkSession)).write.mode("append" if k else "overwrite").parquet(path)
    return path


def drop_candles(parts: list[DataFrame], path: str) -> tuple[str, int]:
    """Write each part in the files that it is made in, and the most files of a part: bars are upserted by key, whatever batch they come in."""
    most, before = 1, 0
    for k, part in enumerate(parts):
        part.write.mode("append" if k else "overwrite").parquet(path)
        files = len(part.sparkSession.read.schema(streams.CANDLES).parquet(path).inputFiles())
        most, before = max(most, files - before), files
    return path, most


def _vendor(spark, d):
    c = fx.candles(spark, d)
    return c.withColumn("currency", F.lit("USD")).withColumn("retrieved_at", F.lit("2001-09-01").cast("timestamp"))


@query("st1_incremental_ingestion", with_tables("candles") + " SELECT instrument_id, ts, CASE WHEN ts >= TIMESTAMP '2000-01-01' THEN close * 1.0 ELSE close END AS close, volume FROM candles")
def _(spark, d):
    c, base = _vendor(spark, d), folder(spark, "st1")
    old = c.where("ts < TIMESTAMP '2000-02-01'").withColumn("volume", F.col("volume") + 1)
    again = c.where("ts < TIMESTAMP '2000-01-15'").withColumn("retrieved_at", F.lit("2001-10-01").cast("timestamp"))
    new = c.where("ts >= TIMESTAMP '2000-01-10'").withColumn("retrieved_at", F.lit("2001-11-01").cast("timestamp"))
    source, files = drop_candles([old, again, new], f"{base}/in")
    streams.ingest_candles(spark, source, f"{base}/table", f"{base}/check", files)
    return streams.read_current(spark, f"{base}/table", streams.CANDLES).select("instrument_id", "ts", "close", "volume")


@query("st3_closed_bar_gate", with_tables("candles") + " SELECT instrument_id, count(*) AS n, max(ts) AS last_ts FROM candles WHERE ts + INTERVAL 1 DAY <= TIMESTAMP '2001-08-01' GROUP BY instrument_id")
def _(spark, d):
    c, base = _vendor(spark, d), folder(spark, "st3")
    source, files = drop_candles([c], f"{base}/in")
    streams.ingest_candles(spark, source, f"{base}/table", f"{base}/check", files, as_of="2001-08-01")
    return streams.read_current(spark, f"{base}/table", streams.CANDLES).groupBy("instrument_id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts"))


@query("st4_stream_dedupe", "SELECT event_id, event_type FROM events")
def _(spark, d):
    e, base = fx.read(spark, d, "events").select("event_id", "ts", "event_type"), folder(spark, "st4")
    schema = "event_id long, ts timestamp, event_type string"
    source = drop([e, e.where("event_id % 2 = 0")], f"{base}/in")
    streams.dedupe_filings(spark, source, schema, f"{base}/out", f"{base}/check", ["event_id"], "60 days")
    return spark.read.schema(schema).parquet(f"{base}/out").select("event_id", "event_type")


@query("st_hourly_bars", "SELECT date_trunc('hour', ts) AS ts, event_type, max(value) AS high, min(value) AS low, count(*) AS n FROM events WHERE value > 0 AND date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY ALL")
def _(spark, d):
    e, base = fx.read(spark, d, "events").select("ts", "event_type", "value"), folder(spark, "hours")
    streams.hourly_bars(spark, drop([e], f"{base}/in"), "ts timestamp, event_type string, value double", f"{base}/out", f"{base}/check")
    return spark.read.schema("ts timestamp, event_type string, high double, low double, n long").parquet(f"{base}/out")


@query("st7_stream_ratchet", with_tables("candles") + " SELECT instrument_id, ts, round(max(close - high * 0.1) OVER (PARTITION BY instrument_id ORDER BY ts), 6) AS stop FROM candles")
def _(spark, d):
    c, base = fx.candles(spark, d).select("instrument_id", "ts", (F.col("close") - F.col("high") * 0.1).alias("candidate")), folder(spark, "st7")
    source = drop([c.where("ts < TIMESTAMP '1998-01-01'"), c.where("ts >= TIMESTAMP '1998-01-01'")], f"{base}/in")
    streams.ratchet_stops(spark, source, f"{base}/out", f"{base}/check")
    return rounded(spark.read.schema("instrument_id long, ts timestamp, stop double").option("recursiveFileLookup", "true").parquet(f"{base}/out"))


#: Each symbol stepped through its fetches: how many were empty, and until when it rests.
_RESTS = """WITH RECURSIVE f AS (SELECT user_id % 50 AS symbol, ts, event_id, CASE event_type WHEN 'click' THEN 'ok' WHEN 'error' THEN 'error' ELSE 'empty' END AS outcome FROM events),
    e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, event_id) AS nth FROM f),
    s AS (SELECT DISTINCT symbol, 0::BIGINT AS nth, 0 AS n, NULL::TIMESTAMP AS until, NULL::TIMESTAMP AS began FROM e
          UNION ALL
          SELECT symbol, nth, CASE WHEN resting THEN n WHEN outcome = 'error' THEN m WHEN outcome = 'ok' THEN 0 ELSE m + 1 END, CASE WHEN resting THEN until WHEN outcome = 'empty' AND m = 2 THEN ts + INTERVAL 5 DAY END,
                 CASE WHEN NOT resting AND outcome = 'empty' AND m = 2 THEN ts END
          FROM (SELECT e.symbol, e.nth, e.ts, e.outcome, s.n, s.until, coalesce(e.ts < s.until, false) AS resting, CASE WHEN e.ts >= s.until THEN 0 ELSE s.n END AS m FROM s JOIN e ON e.symbol = s.symbol AND e.nth = s.nth + 1))
    SELECT symbol, 'start' AS what, began AS ts FROM s WHERE began IS NOT NULL UNION ALL SELECT symbol, 'end', began + INTERVAL 5 DAY FROM s WHERE began + INTERVAL 5 DAY < (SELECT max(ts) FROM events)"""


@query("st5_stream_backoff", _RESTS)
def _(spark, d):
    t = F.col("event_type")
    e = fx.read(spark, d, "events").select((F.col("user_id") % 50).alias("symbol"), "ts", F.col("event_id").alias("fetch_id"), F.when(t == "click", "ok").when(t == "error", "error").otherwise("empty").alias("outcome"))
    base = folder(spark, "st5")
    weeks = ["2024-01-01", "2024-01-08", "2024-01-15", "2024-01-22", "2024-01-31"]
    source = drop([e.where((F.col("ts") >= F.lit(a).cast("timestamp")) & (F.col("ts") < F.lit(b).cast("timestamp"))) for a, b in zip(weeks, weeks[1:], strict=False)], f"{base}/in")
    streams.count_empties(spark, source, f"{base}/out", f"{base}/check", rest_days=5)
    return spark.read.schema("symbol long, what string, ts timestamp").parquet(f"{base}/out")


@query("s19_snapshot_sink", with_tables("intents") + " SELECT account, CAST(closed_at AS DATE) AS day, round(sum((exit_price - fill_price) * quantity), 8) AS realised FROM intents WHERE closed_at IS NOT NULL AND exit_price IS NOT NULL AND fill_price IS NOT NULL GROUP BY ALL")
def _(spark, d):
    rows, path = trading.realised(fx.intents(spark, d)).withColumn("month", F.date_format("day", "yyyy-MM")), folder(spark, "s19")
    sinks.write_snapshot(rows, path, ["month"])
    sinks.write_snapshot(rows.where("month >= '2000-01'"), path, ["month"])
    back = spark.read.schema("account long, day date, realised double, month string").parquet(path)
    return rounded(back.select("account", "day", "realised"), 8)
