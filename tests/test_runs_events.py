"""Event logs and runs against plain loops: halts, watchlists, the audit chain, counted runs, provider chains, candles on the full key."""

import random

import pytest
from pyspark.sql import functions as F

from tidewater.functions import normalise as nm
from tidewater.operators import bars, lifecycle, runs, selection, upkeep
from tidewater.sources import sinks
from tidewater.streaming import streams

HALT = "event_id long, ts timestamp, action string, kind string, scope string, instrument_id long, strategy string, reason string, by_user long"


def stamp(k):
    return f"2024-01-{1 + k // 20:02d} {k % 20:02d}:00:00"


def halt_log(seed, n=300):
    rng, rows = random.Random(seed), []
    for k in range(n):
        scope = rng.choice(["global", "instrument", "instrument", "strategy"])
        rows.append((k, stamp(k // 2), rng.choice(["activate"] * 4 + ["clear", "clear_kind"]), rng.choice("ab"), scope, rng.randrange(3) if scope == "instrument" else None, None, f"r{k}", rng.choice([None, None, 7])))
    return rows


def slow_halts(rows):
    """Every period, by stepping through the log."""
    active, done = {}, []
    for _, ts, action, kind, scope, target, _, reason, user in sorted(rows, key=lambda r: (r[1], r[0])):
        key = (kind, scope, target)
        if action == "activate":
            active.setdefault(key, (reason, user, ts))
        elif action == "clear" and key in active:
            done.append((*key, *active.pop(key), ts, "clear"))
        elif action == "clear_kind":
            for k in [k for k, (_, by, _) in active.items() if k[0] == kind and by is None]:
                done.append((*k, *active.pop(k), ts, "clear_kind"))
    return sorted(done + [(*k, *a, None, None) for k, a in active.items()], key=str)


@pytest.mark.parametrize("seed", range(4))
def test_halt_periods_step_by_step(spark, seed):
    rows = halt_log(seed)
    frame = spark.createDataFrame([(r[0], None, *r[2:]) for r in rows], HALT).drop("ts").join(spark.createDataFrame([(r[0], r[1]) for r in rows], "event_id long, at string"), "event_id")
    got = lifecycle.halt_periods(frame.select("event_id", F.to_timestamp("at").alias("ts"), *HALT.replace(" long", "").replace(" string", "").replace(" timestamp", "").split(", ")[2:])).collect()
    text = lambda t: None if t is None else str(t)
    assert sorted(((r["kind"], r["scope"], r["instrument_id"], r["reason"], r["by_user"], text(r["activated_at"]), text(r["cleared_at"]), r["cleared_by"]) for r in got), key=str) == slow_halts(rows)


def test_a_global_halt_blocks_every_instrument_and_hides_their_own(spark):
    rows = [("2024-01-01", "kill", "global", None), ("2024-01-01", "loss", "instrument", 1), ("2024-01-02", "loss", "instrument", 1), ("2024-01-02", "x", "strategy", None)]
    active = spark.createDataFrame(rows, "at string, kind string, scope string, instrument_id long")
    got = lifecycle.blocking_halts(active, spark.createDataFrame([(1,), (2,)], "instrument_id long")).collect()
    assert sorted(map(tuple, got)) == [("2024-01-01", 1, "kill", "global"), ("2024-01-01", 2, "kill", "global"), ("2024-01-02", 1, "loss", "instrument")]


def test_reconciliation_halts_once_and_clears_once(spark):
    runs_ = [(1, "2024-01-01", "A", 0), (2, "2024-01-02", "A", 3), (3, "2024-01-03", "B", 1), (4, "2024-01-04", "A", 0), (5, "2024-01-05", "A", 0), (6, "2024-01-06", "B", 2)]
    frame = spark.createDataFrame(runs_, "run_id long, day string, broker string, discrepancies long").select("run_id", F.to_timestamp("day").alias("ts"), "broker", "discrepancies")
    want = [("A: 3 discrepancies", "2024-01-02", "2024-01-04"), ("B: 2 discrepancies", "2024-01-06", "None")]
    for told in (frame, frame.unionByName(frame)):
        got = lifecycle.halt_periods(lifecycle.reconciliation_events(told)).collect()
        assert sorted((r["reason"], str(r["activated_at"])[:10], str(r["cleared_at"])[:10]) for r in got) == want


def test_watchlist_stays(spark):
    log = [
        (1, 0, "add", 1, 10, "first"), (2, 1, "add", 1, 11, None), (3, 2, "add", 1, 10, None), (4, 3, "add", 1, 10, "second"), (5, 4, "remove", 1, 11, None), (6, 5, "remove", 1, 11, None),
        (7, 6, "add", 1, 11, "again"), (8, 7, "add", 2, 10, None), (9, 8, "remove", 2, 10, None), (10, 9, "remove", 2, 99, None),
    ]
    frame = spark.createDataFrame([(i, stamp(t), *rest) for i, t, *rest in log], "event_id long, at string, action string, list_id long, instrument_id long, note string").withColumn("ts", F.to_timestamp("at")).drop("at")
    stays = lifecycle.memberships(frame)
    got = sorted((r["list_id"], r["instrument_id"], r["event_id"], r["note"], r["removed_at"] is not None) for r in stays.collect())
    assert got == [(1, 10, 1, "second", False), (1, 11, 2, None, True), (1, 11, 7, "again", False), (2, 10, 8, None, True)]
    listed = lifecycle.watchlist(stays, spark.createDataFrame([(10, True), (11, False)], "instrument_id long, has_history boolean")).collect()
    assert sorted((r["list_id"], r["place"], r["instrument_id"], r["scannable"]) for r in listed) == [(1, 1, 10, True), (1, 2, 11, False)]


def test_one_chain_is_verified_by_all_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        events = spark.createDataFrame([(0, i, "k", f'text "{i}" é\\') for i in range(500)], "chain long, event_id long, kind string, summary string")
        chain = lifecycle.append_chain(events).cache()
        assert lifecycle.verify_chain(chain).count() == 0
        s = F.col("sequence")
        broken = chain.where("sequence <> 200").withColumns({"summary": F.when(s == 100, "changed").otherwise(F.col("summary")), "sequence": F.when(s == 300, 301).when(s == 301, 300).otherwise(s)})
        got = sorted((r["sequence"], r["problem"]) for r in lifecycle.verify_chain(broken).collect())
        assert got == [(100, "hash"), (201, "link"), (300, "hash"), (300, "link"), (301, "hash"), (301, "link"), (302, "link")]
        # gaps in the numbers alone are no problem
        apart = lifecycle.linked(chain.withColumn("sequence", s * 10)).where("NOT ok_link")
        assert apart.count() == 0
        rows = lifecycle.linked(chain)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_ingestion_counts_what_it_writes(spark):
    queue = spark.createDataFrame([(1, "A"), (2, "B"), (3, None), (4, "D"), (5, "E")], "instrument_id long, symbol string")
    feed = spark.createDataFrame([("A", None, "d1", 1.0, 2), ("A", None, "d2", 2.0, 2), ("B", "timeout", None, None, 2), ("E", None, "d1", 9.0, 2)], "symbol string, error string, ts string, close double, retrieved_at int")
    candles = spark.createDataFrame([(1, "d1", 0.5, 1), (5, "d0", 5.0, 1)], "instrument_id long, ts string, close double, retrieved_at int")
    rows, after, totals = runs.ingestion_run(queue, feed, candles, [F.col("instrument_id")], 4)
    assert totals == {"processed": 4, "written": 2, "failed": 1, "skipped": 2, "attempted": 3}
    assert sorted((r["instrument_id"], r["candles_written"], r["error"], r["skipped_reason"]) for r in rows.collect()) == [(1, 2, None, None), (2, 0, "timeout", None), (3, 0, None, "no active mapping"), (4, 0, None, "no new bars")]
    assert sorted((r["instrument_id"], r["ts"], r["close"]) for r in after.collect()) == [(1, "d1", 1.0), (1, "d2", 2.0), (5, "d0", 5.0)]
    none = runs.ingestion_run(queue.limit(0), feed, candles, [F.col("instrument_id")], 4)[2]
    assert none == {"processed": 0, "written": 0, "failed": 0, "skipped": 0, "attempted": 0}


def test_intraday_runs_are_guarded(spark):
    """Only intraday intervals of providers that have them are fetched; an empty answer is a reason and nothing else."""
    requests = spark.createDataFrame([(1, "1h", "live"), (2, "1d", "live"), (3, "1h", "daily"), (4, "15m", "live"), (5, "1h", "live"), (6, "1h", "other")], "instrument_id long, interval string, provider string").withColumn("start", F.lit(10))
    providers = spark.createDataFrame([("live", True), ("daily", False)], "provider string, supports_intraday boolean")
    mappings = spark.createDataFrame([(k, p, f"S{k}") for k, p in ((1, "live"), (2, "live"), (3, "daily"), (4, "live"))], "instrument_id long, provider string, symbol string")
    columns = "symbol string, provider string, interval string, ts int, series_type string, close double, retrieved_at int"
    feed = spark.createDataFrame([("S1", "live", "1h", 9, "raw", 1.0, 2), ("S1", "live", "1h", 10, "raw", 2.0, 2), ("S1", "live", "15m", 11, "raw", 3.0, 2), ("S2", "live", "1d", 12, "raw", 4.0, 2), ("S3", "daily", "1h", 12, "raw", 5.0, 2)], columns)
    old = spark.createDataFrame([(1, "1h", 10, "raw", 0.5, 1), (1, "1d", 10, "raw", 0.7, 1)], "instrument_id long, interval string, ts int, series_type string, close double, retrieved_at int")
    rows, after = runs.intraday_run(requests, providers, mappings, feed, old)
    assert {r["instrument_id"]: (r["candles_written"], r["skipped_reason"]) for r in rows.collect()} == {
        1: (1, None), 2: (0, "1d is not an intraday interval"), 3: (0, "daily does not provide intraday data"), 4: (0, "no candles for the requested window"), 5: (0, "no active live mapping"),
        6: (0, "other does not provide intraday data"),
    }
    assert sorted((r["interval"], r["close"]) for r in after.collect()) == [("1d", 0.7), ("1h", 2.0)]


def test_enrichment_fills_and_always_leaves_a_snapshot(spark):
    kept = spark.createDataFrame([(1, "Old", None, True), (2, "Old", "Kept", True), (3, None, "", True), (4, None, None, False)], "instrument_id long, sector string, industry string, asked boolean")
    profiles = spark.createDataFrame([(1, "New", "Steel", 9.0), (2, "", "Other", None), (4, "New", "Steel", 1.0)], "instrument_id long, new_sector string, new_industry string, trailing_pe double")
    profiles = profiles.withColumns({c: F.lit(None).cast("double") for c in ("price_to_book", "profit_margin", "dividend_yield")})
    after, snapshots, totals = runs.enrichment_run(kept, profiles, "2024-01-01")
    assert sorted(map(tuple, after.collect()), key=str) == [(1, "New", "Steel"), (2, "Old", "Kept"), (3, None, "Unclassified"), (4, None, None)]
    assert sorted((r["instrument_id"], r["trailing_pe"]) for r in snapshots.collect()) == [(1, 9.0), (2, None), (3, None)]
    assert totals == {"attempted": 3, "classified": 1, "unclassified": 2, "with_fundamentals": 1}


def test_coverage_counts_fields_and_misses(spark):
    rows = [("X", "a", True, 1.0, None), ("X", "b", True, None, None), ("X", "c", False, 1.0, 2.0), ("Y", None, False, None, None), ("Y", "e", True, None, 5.0)]
    frame = spark.createDataFrame(rows, "venue string, symbol string, found boolean, market_cap double, trailing_pe double").withColumns({c: F.lit(None).cast("double") for c in runs.COVERED[2:]})
    by, seen = runs.coverage_run(frame)
    assert (seen["attempted"], seen["unsupported"], seen["not_found"], seen["had_data"], seen["market_cap"], seen["trailing_pe"], seen["profit_margin"]) == (5, 1, 1, 2, 1, 1, 0)
    assert sorted(map(tuple, by.collect())) == [("X", 3, 1, 1 / 3), ("Y", 2, 1, 0.5)]


def test_provider_chain_gives_the_first_that_serves_or_the_last_reason(spark):
    answers = [
        (1, "a", None, None, 5), (1, "b", None, None, 7), (2, "a", "quota spent", None, None), (2, "b", None, None, 3), (3, "a", None, "no new bars", 0), (3, "b", "not configured", None, None),
        (4, "b", None, "symbol unknown", 0), (5, "other", None, None, 9),
    ]
    frame = spark.createDataFrame(answers, "instrument_id long, provider string, error string, skipped_reason string, candles_written long")
    got = runs.provider_chain(spark.range(1, 6).withColumnRenamed("id", "instrument_id"), frame, ["a", "b"])
    assert sorted(map(tuple, got.collect())) == [
        (1, "a", 5, None), (2, "b", 3, None), (3, None, 0, "b: not configured"), (4, None, 0, "b: symbol unknown"), (5, None, 0, "no provider in the chain"),
    ]


def test_confirming_what_was_resolved(spark):
    kept = spark.createDataFrame([(1, 1, "OLD", False, True), (1, 2, "ALT", False, False)], "instrument_id long, provider long, symbol string, confirmed boolean, is_signal_source boolean")
    answers = spark.createDataFrame([(1, 1, "NEW", True, True), (2, 1, "TWO", True, True)], "instrument_id long, provider long, answer string, requires_confirmation boolean, asks_signal boolean")
    mapped, required = upkeep.resolve_mappings(kept, answers)
    states = spark.createDataFrame([(1, "PAPER_ACTIVE")], "instrument_id long, lifecycle_state string").where("false").unionByName(required.select("instrument_id", "lifecycle_state"))
    said = spark.createDataFrame([(1, 2, "MINE", True), (9, 1, None, True)], "instrument_id long, provider long, override string, as_signal boolean")
    after, moved = upkeep.confirm(mapped, states, said)
    rows = {(r["instrument_id"], r["provider"]): r for r in after.collect()}
    assert rows[1, 2]["symbol"] == "MINE" and rows[1, 2]["confirmed"] and rows[1, 2]["is_signal_source"] and rows[1, 2]["resolution"] == "manual_user_override"
    assert not rows[1, 1]["is_signal_source"] and rows[1, 1]["symbol"] == "NEW" and rows[2, 1]["is_signal_source"]
    assert dict(map(tuple, moved.collect())) == {1: "DATA_BACKFILL", 2: "MAPPING_REQUIRED"}
    assert dict(map(tuple, upkeep.confirm(mapped, moved.withColumn("lifecycle_state", F.lit("PAPER_ACTIVE")), said)[1].collect()))[1] == "PAPER_ACTIVE"


def test_search_and_refresh_candidates(spark):
    rows = [(1, "Acme", "ACM", None, "S", True, False), (2, "Other", "OTH", "XS0ACM", "T", False, False), (3, "acme two", "A2", None, "S", False, True)]
    listed = spark.createDataFrame(rows, "instrument_id long, name string, ticker string, isin string, lifecycle_state string, bot_universe boolean, suspended boolean")
    ids = lambda **asked: sorted(r[0] for r in selection.search(listed, **asked).collect())
    assert ids(text=" acm ") == [1, 2, 3] and ids(text="acm", tradable_only=True) == [1, 2] and ids(ids=[]) == [] and ids(ids=[2, 9]) == [2] and ids() == [1, 2, 3]
    assert ids(lifecycle_state="S", bot_universe_only=True) == [1]
    page = selection.page_with_total(selection.search(listed), ["name"], 1, 1).collect()
    assert [(r["name"], r["total"]) for r in page] == [("Other", 3)]
    able = listed.withColumn("scanner_eligible", F.lit(True))
    m = spark.createDataFrame([(1, True, None), (2, True, "2024-02-02"), (2, False, None), (3, True, None)], "instrument_id long, is_active boolean, until string").select("instrument_id", "is_active", F.to_timestamp("until").alias("retry_after"))
    assert [r[0] for r in selection.refresh_candidates(able, m, "2024-02-01").select("instrument_id").collect()] == [1]
    assert sorted(r[0] for r in selection.refresh_candidates(able, m, "2024-02-02").select("instrument_id").collect()) == [1, 2]


def test_candles_on_the_full_key(spark, tmp_path):
    """Intervals and series share timestamps without clashing; a scan reads only the folders it asks for."""
    rows = [(1, i, "2024-01-01", s, 1.0, 2.0, 1.0, c, "USD", 1) for i in ("1d", "1w") for s, c in (("raw", 1.5), ("adjusted", 0.9))]
    schema = "instrument_id long, interval string, day string, series_type string, open double, high double, low double, close double, currency string, retrieved_at int"
    made = lambda rows: bars.with_quality(spark.createDataFrame(rows, schema).withColumn("ts", F.to_timestamp("day")).drop("day"))
    old = made(rows)
    new = made([(1, "1d", "2024-01-01", "raw", 1.0, 2.0, 1.0, 9.0, "GBP", 2)])
    after = bars.upsert(old, new, first_wins=("currency",))
    got = {(r["interval"], r["series_type"]): (r["close"], r["currency"], r["quality"]) for r in after.collect()}
    assert got == {("1d", "raw"): (9.0, "USD", "SUSPECT"), ("1w", "raw"): (1.5, "USD", "OK"), ("1d", "adjusted"): (0.9, "USD", "SUSPECT"), ("1w", "adjusted"): (0.9, "USD", "SUSPECT")}
    path = f"file://{tmp_path}/series"
    sinks.write_snapshot(after, path, ["interval", "series_type"])
    table = spark.read.schema(after.schema).parquet(path)
    found = bars.scan(table, interval="1w", series_type="raw", tradable_only=True, limit=3)
    assert [(r["interval"], r["close"]) for r in found.collect()] == [("1w", 1.5)]
    assert bars.scan(table, interval="1d", series_type="raw", tradable_only=True).count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(interval" in plan and "series_type" in plan.split("PartitionFilters")[1].split("]")[0]


def test_rests_start_and_end_by_themselves(spark, tmp_path):
    fetches = [(1, "2024-01-01"), (1, "2024-01-02"), (1, "2024-01-03"), (1, "2024-01-04"), (1, "2024-01-09"), (2, "2024-01-01"), (3, "2024-01-20")]
    rows = [(s, d, k, "ok" if s == 3 else "empty") for k, (s, d) in enumerate(fetches)]
    frame = spark.createDataFrame(rows, "symbol long, day string, fetch_id long, outcome string").select("symbol", F.to_timestamp("day").alias("ts"), "fetch_id", "outcome")
    source = f"{tmp_path}/in"
    for k, (a, b) in enumerate([("2024-01-01", "2024-01-05"), ("2024-01-05", "2024-01-10"), ("2024-01-10", "2024-02-01")]):
        frame.where(F.col("ts").between(a, b)).repartition(streams.files_of_a_part(spark)).write.mode("append" if k else "overwrite").parquet(source)
    streams.count_empties(spark, source, f"{tmp_path}/out", f"{tmp_path}/check", rest_days=5)
    got = sorted((r["symbol"], r["what"], str(r["ts"])[:10]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(1, "end", "2024-01-08"), (1, "start", "2024-01-03")]


def values(spark, make, *rows):
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r[0] for r in frame.orderBy("i").select(make(F.col("x"))).collect()]


def test_vocabularies(spark):
    states = {"LOCAL": "pending", "UNCONFIRMED": "pending", "NEW": "submitted", "CONFIRMED": "submitted", "SUBMITTED": "submitted", "REPLACING": "submitted", "REPLACED": "submitted", "CANCELLING": "submitted", "PARTIALLY_FILLED": "partially_filled", "FILLED": "filled", "CANCELLED": "cancelled", "REJECTED": "rejected", "EXPIRED": "expired", "?": "unknown", None: "unknown"}
    assert values(spark, lambda x: nm.lookup(nm.ORDER_STATES, x, "unknown"), *states) == list(states.values()) and len(nm.ORDER_STATES) == 13
    kinds = {"STOCK": "stock", "REIT": "stock", "ETF": "etf", "ETC": "etc", "TRUST": "trust"} | dict.fromkeys(("CORPACT", "CRYPTOCURRENCY", "CVR", "FOREX", "FUTURES", "INDEX", "WARRANT", "?"), "unknown")
    assert values(spark, lambda x: nm.lookup(nm.KINDS, x, "unknown"), *kinds) == list(kinds.values()) and len(nm.KINDS) == 12
    units = {"GBp": "GBX", "GBX": "GBX", "GBp ": "GBX", "GBP": "GBP", "usd": "USD", "PLN": "PLN", "CZK": "CZK", "HUF": "HUF", "CAD": "GBX", "": "GBX", None: "GBX"}
    assert values(spark, lambda x: nm.infer_unit(F.lit("vod.l"), x), *units) == list(units.values())
    assert values(spark, lambda x: nm.infer_unit(x, F.lit("CAD")), "A", "A.L", None) == ["USD", "GBX", "USD"]
    tickers = {" brk/b": "BRK-B", "AVAV_": "AVAV", "XYZ/W": "XYZ-W", "A_WAR": None, "a_rts1": None, "B_RGT": None, "": None, "__": None, None: None, "-a-": "-A"}
    assert values(spark, nm.ticker, *tickers) == list(tickers.values())
