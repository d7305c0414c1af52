"""Hand-made cases of broker sync, mappings, backfill, proposals, risk decisions and ordered folds."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewater.operators import bars, indicators, lifecycle, selection, trading, upkeep
from tidewater.sources import readers
from tidewater.sources.scratch import stored

DAY = dt.datetime(2001, 1, 1)


def test_sync_creates_updates_delists_and_is_idempotent(spark):
    listing = [("AAAl_EQ", "I1", True), ("BBB_US_EQ", None, True), ("CCCd_EQ", "I9", False), ("CCCd2d_EQ", "I9", True), ("DDD_odd", None, True), ("EEEp_EQ", "I5", True), ("BBBz_odd", "I2", True), ("QQQl_EQ", None, True)]
    stored = [("AAAl_EQ", True), ("ZZZl_EQ", True), ("YYYl_EQ", False)]
    known = [(1, "I1", "XLON", "AAA"), (2, "I2", "XNAS", "BBB"), (3, "I1", "XNAS", "AAA"), (5, None, "XPAR", "EEE")]
    frames = (
        spark.createDataFrame(listing, "broker_ticker string, isin string, available boolean"), spark.createDataFrame(stored, "broker_ticker string, is_available boolean"),
        spark.createDataFrame(known, "instrument_id long, isin string, venue string, ticker string"),
    )
    got = {r["broker_ticker"]: (r["action"], r["tier"], r["instrument_id"], r["fills_isin"], r["needs_confirmation"]) for r in upkeep.sync_catalogue(*frames).collect()}
    assert got == {
        "AAAl_EQ": ("updated", "isin", 1, False, False), "BBB_US_EQ": ("created", "ticker", 2, False, False), "CCCd2d_EQ": ("created", "new", None, False, False),
        "CCCd_EQ": ("created", "isin", None, False, False), "DDD_odd": ("created", "new", None, False, True), "EEEp_EQ": ("created", "ticker", 5, True, False),
        "BBBz_odd": ("created", "isin", 2, False, False), "QQQl_EQ": ("created", "new", None, False, True), "ZZZl_EQ": ("delisted", None, None, None, None),
    }
    counts = upkeep.sync_counts(upkeep.sync_catalogue(*frames)).first().asDict()
    assert counts == {"listed": 8, "created": 7, "updated": 1, "delisted": 1, "instruments_created": 3, "matched_by_isin": 3, "needing_confirmation": 2}
    after = frames[0].select("broker_ticker", F.col("available").alias("is_available"))
    again = upkeep.sync_counts(upkeep.sync_catalogue(frames[0], after, frames[2])).first().asDict()
    assert (again["created"], again["updated"], again["delisted"]) == (0, 8, 0)


def test_confirmed_mappings_stay_and_signal_sources_move(spark):
    stored = [(1, 1, "a", True, True), (2, 1, "b", False, False), (2, 2, "c", False, True), (3, 1, "d", False, True), (5, 2, "e", True, True)]
    answers = [(1, 1, "A", True, True), (2, 1, "B", True, True), (3, 1, None, True, True), (4, 1, "D", False, False), (5, 1, "E", False, True)]
    out, held = upkeep.resolve_mappings(
        spark.createDataFrame(stored, "instrument_id long, provider long, symbol string, confirmed boolean, is_signal_source boolean"),
        spark.createDataFrame(answers, "instrument_id long, provider long, answer string, requires_confirmation boolean, asks_signal boolean"),
    )
    got = {(r["instrument_id"], r["provider"]): (r["symbol"], r["confirmed"], r["is_signal_source"], r["outcome"]) for r in out.collect()}
    assert got == {
        (1, 1): ("a", True, True, "already confirmed by user"), (2, 1): ("B", False, True, "updated"), (2, 2): ("c", False, False, "not asked"), (3, 1): ("d", False, True, "not identified"),
        (4, 1): ("D", False, False, "created"), (5, 1): ("E", False, True, "created"), (5, 2): ("e", True, False, "not asked"),
    }
    assert [r["instrument_id"] for r in held.collect()] == [2]


def test_backfill_maps_ingests_and_counts(spark):
    instruments = spark.createDataFrame([(1, "aa/b", "XLON"), (2, "bb", "XTSE"), (3, "cc", "XNAS"), (4, "dd_WAR", "XNAS")], "instrument_id long, ticker string, venue string")
    feed = spark.createDataFrame([("AA-B.L", DAY, 2.0, 2), ("AA-B.L", DAY + dt.timedelta(1), 3.0, 2), ("XX", DAY, 9.0, 2)], "symbol string, ts timestamp, close double, retrieved_at int")
    stored = spark.createDataFrame([(1, DAY, 1.0, 1), (3, DAY, 7.0, 1)], "instrument_id long, ts timestamp, close double, retrieved_at int")
    mapped = spark.createDataFrame([(3, "CC")], "instrument_id long, symbol string")
    rows, after = upkeep.backfill(instruments, mapped, feed, stored)
    assert sorted(tuple(r) for r in rows.collect()) == [(1, "AA-B.L", True, "ingested", 2), (2, None, False, "unsupported", 0), (3, "CC", False, "no data", 0), (4, None, False, "unsupported", 0)]
    assert sorted((r["instrument_id"], r["close"]) for r in after.collect()) == [(1, 2.0), (1, 3.0), (3, 7.0)]
    proxies = {r["symbol"]: (r["created"], r["candles_written"]) for r in upkeep.ensure_proxies(spark.createDataFrame([(8, "XLK")], "instrument_id long, symbol string"), feed.withColumn("symbol", F.lit("XLE"))).collect()}
    assert len(proxies) == 11 and proxies["XLK"] == (False, 0) and proxies["XLE"] == (True, 2) and sum(c for c, _ in proxies.values()) == 10


def test_proposals_are_decided_once(spark):
    at = lambda n: DAY + dt.timedelta(days=n)
    p = spark.createDataFrame([(1, "pending", at(10), False), (2, "pending", at(10), True), (3, "pending", at(2), False), (4, "approved", at(10), False), (5, "pending", at(4), False), (6, "pending", at(10), False)], "proposal_id long, status string, expires_at timestamp, suspended boolean")
    a = [(1, 1, "approve", at(3)), (1, 2, "reject", at(4)), (2, 1, "approve", at(3)), (2, 2, "reject", at(20)), (3, 1, "approve", at(2)), (3, 2, "reject", at(3)), (4, 1, "reject", at(1))]
    after, outcomes = lifecycle.decide(p, spark.createDataFrame(a, "proposal_id long, nth int, action string, at timestamp"), "2001-01-06")
    assert {r["proposal_id"]: (r["status"], r["decided_at"]) for r in after.collect()} == {1: ("approved", at(3)), 2: ("rejected", at(20)), 3: ("expired", None), 4: ("approved", None), 5: ("expired", None), 6: ("pending", None)}
    assert sorted((r["proposal_id"], r["nth"], r["outcome"]) for r in outcomes.collect()) == [(1, 1, "approved"), (1, 2, "not actionable"), (2, 1, "suspended"), (2, 2, "rejected"), (3, 1, "expired"), (3, 2, "not actionable"), (4, 1, "not actionable")]


LIMITS = {"multiple": 2.0, "positions": 3, "trades": 5, "risk": 0.01, "position": 0.10, "instrument": 0.20, "open_risk": 0.05, "correlation": 0.80, "exposure": 0.50}
SOUND = {"configured": True, "halted": False, "stale": False, "open_positions": 0, "is_new": True, "trades_today": 0, "n_bars": 60, "last_close": 50.0, "atr14": 2.0, "equity": 100_000.0, "equity_ceiling": None, "cash": 100_000.0, "held_value": 0.0, "open_risk": 0.0, "regime": 1.0, "monetary_cap": None, "correlation": 0.1, "exposure": 0.9}


@pytest.mark.parametrize(("change", "quantity", "binding", "reason"), [
    ({}, 200.0, "max_position_pct", None), ({"configured": False, "halted": True}, None, None, "no configuration"), ({"halted": True, "stale": True}, None, None, "halted"), ({"stale": True}, None, None, "stale"),
    ({"open_positions": 3}, None, None, "position cap"), ({"open_positions": 3, "is_new": False}, 200.0, "max_position_pct", None), ({"trades_today": 5}, None, None, "trade cap"), ({"n_bars": 19}, None, None, "not enough history"),
    ({"atr14": None}, None, None, "no stop distance"), ({"atr14": 25.0}, None, None, "stop at or below zero"), ({"equity_ceiling": 0.0}, None, None, "no equity"), ({"equity_ceiling": 20_000.0}, 40.0, "max_position_pct", None),
    ({"equity_ceiling": 200_000.0}, 200.0, "max_position_pct", None), ({"monetary_cap": 2500.0}, 50.0, "monetary_cap", None), ({"monetary_cap": 10_000.0}, 200.0, "max_position_pct", None), ({"held_value": 15_000.0}, 100.0, "max_instrument_pct", None),
    ({"cash": 1000.0}, 20.0, "available_cash", None), ({"open_risk": 4900.0}, 25.0, "max_total_open_risk", None), ({"atr14": 5.0, "regime": 0.55}, 55.0, "risk_budget", None), ({"correlation": 0.9}, 100.0, "max_position_pct", None),
    ({"correlation": 0.9, "exposure": 0.5}, 200.0, "max_position_pct", None), ({"cash": 0.0}, None, None, "sized to zero"),
])
def test_risk_gates_and_caps(spark, change, quantity, binding, reason):
    kinds = "instrument_id long, " + ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'int' if isinstance(v, int) else 'double'}" for k, v in SOUND.items())
    r = trading.evaluate(spark.createDataFrame([(1, *(SOUND | change).values())], kinds), LIMITS).first()
    assert (r["quantity"], r["binding"], r["reason"]) == (quantity, binding, reason)
    if quantity:
        row = SOUND | change
        assert r["risk_amount"] == pytest.approx(quantity * row["atr14"] * 2)
        assert r["applied"] == [binding] + (["market regime x0.55"] if row["regime"] < 1 else []) + (["correlation_reduction"] if r["reduced"] else [])


def test_proposal_sizing_and_its_refusals(spark):
    rows = [(1, 60, 50.0, 2.0, False, False), (2, 60, 50.0, 2.0, True, False), (3, 60, 50.0, 2.0, False, True), (4, 19, 50.0, 2.0, False, True), (5, 60, 50.0, 25.0, False, False), (6, 60, 50.0, 8.0, False, False)]
    out = trading.proposals(spark.createDataFrame(rows, "instrument_id long, n_bars int, last_close double, atr14 double, suspended boolean, has_pending boolean"), F.lit(100_000.0))
    got = {r["instrument_id"]: (r["quantity"], r["position_value"], r["risk_amount"], r["risk_share"], r["reason"]) for r in out.collect()}
    assert got == {1: (200.0, 10_000.0, 800.0, 0.008, None), 2: (None,) * 4 + ("suspended",), 3: (None,) * 4 + ("pending already",), 4: (None,) * 4 + ("not enough history",), 5: (None,) * 4 + ("stop at or below zero",), 6: (62.5, 3125.0, 1000.0, 0.01, None)}


def test_chunks_number_all_rows_in_order(spark):
    windows = spark.createDataFrame([(i, DAY + dt.timedelta(days=i * 7 % 31)) for i in range(100)], "instrument_id long, start timestamp").repartition(7)
    got = {r["chunk"]: (r["chunk_start"], r["n"]) for r in selection.chunks(windows, 30, "2001-01-05", lambda df: stored(df, "chunks")).collect()}
    order = sorted(((DAY + dt.timedelta(days=i * 7 % 31), i) for i in range(100)), key=lambda x: (-x[0].timestamp(), x[1]))
    assert got == {k: (max(min(s for s, _ in order[k * 30 : k * 30 + 30]), dt.datetime(2001, 1, 5)), len(order[k * 30 : k * 30 + 30])) for k in range(4)}


def test_folds_hold_over_many_batches(spark):
    """Days and chains that are longer than an Arrow batch and share tasks with others."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(f"p{i % 3}", DAY.date() + dt.timedelta(days=i % 2), DAY + dt.timedelta(minutes=i), i, 3) for i in range(120)]
        got = lifecycle.admit(spark.createDataFrame(rows, "provider string, day date, ts timestamp, request_id long, priority int"), 15, 1, 2).collect()
        assert len(got) == 120 and sum(r["granted"] for r in got) == 6 * 15 and {r["request_id"] for r in got if not r["granted"]} == set(range(90, 120))
        chain = lifecycle.append_chain(spark.createDataFrame([(i % 3, i, "k", str(i)) for i in range(100)], "chain long, event_id long, kind string, summary string")).cache()
        assert lifecycle.verify_chain(chain).count() == 0 and [r["n"] for r in chain.groupBy("chain").agg(F.max("sequence").alias("n")).orderBy("chain").collect()] == [34, 33, 33]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_series_arrays(spark):
    rows = [(1, DAY + dt.timedelta(days=d), float(d), None if d == 2 else 10.0 * d) for d in (3, 1, 2, 0)] + [(2, DAY, 5.0, 1.0)]
    frame = spark.createDataFrame(rows, "instrument_id long, ts timestamp, close double, volume double").withColumns({c: F.col("close") for c in ("open", "high", "low")})
    got = {r["instrument_id"]: (r["close"], r["volume"]) for r in indicators.series(frame, 3).collect()}
    assert got == {1: ([1.0, 2.0, 3.0], [10.0, 0.0, 30.0]), 2: ([5.0], [1.0])}


def test_wide_frame_reads_each_text_once(spark):
    rows = [(1, DAY, 100.0, 120.0, 90.0, "110", 5.0), (1, DAY + dt.timedelta(days=1), 100.0, 120.0, 90.0, "NaN", 5.0), (2, DAY, 100.0, 80.0, 90.0, "110", 5.0), (3, DAY, float("inf"), 120.0, 90.0, "110", 5.0), (4, DAY, 100.0, 120.0, 90.0, "110", float("nan"))]
    frame = spark.createDataFrame(rows, "instrument_id long, Date timestamp, Open double, High double, Low double, Close string, Volume double")
    got = readers.wide_frame(frame, "GBX")
    assert sorted(map(tuple, got.collect())) == [(1, DAY, 1.0, 1.2, 0.9, 1.1, 5.0), (4, DAY, 1.0, 1.2, 0.9, 1.1, None)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Filter" in x and "as double" in x.lower()]


def test_joins_of_lines_have_partitions_by_their_number(spark, sf_dir, monkeypatch):
    from tidewater.plans import catalogue
    from tidewater.sources import fixtures, scratch

    monkeypatch.setattr(scratch, "TASK_ROWS", 500)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for made in (*catalogue._decided(spark, sf_dir), fixtures.filings(spark, sf_dir)):
            assert made.rdd.getNumPartitions() >= fixtures.read(spark, sf_dir, "lineitem").count() // 500
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_validation_moves_no_bars_and_an_upsert_moves_them_once(spark, monkeypatch):
    rows = [(1, DAY, 1.0, 2.0, 0.5, 1.5, 1.0, "USD"), (1, DAY, 1.0, 0.5, 0.5, 1.5, 1.0, None), (2, DAY, 1.0, 2.0, 0.5, 1.5, 1.0, "EUR"), (2, DAY, 1.0, 2.0, 0.5, 1.5, 1.0, "USD"), (None, DAY, 1.0, 2.0, 0.5, 1.5, 1.0, "EUR")]
    frame = spark.createDataFrame(rows, "instrument_id long, ts timestamp, open double, high double, low double, close double, volume double, currency string")
    for most in (0, 200_000):
        monkeypatch.setattr(readers, "WRONG_UNITS", most)
        out = readers.validate(frame, F.lit("USD"))
        assert sorted((r["instrument_id"] or 0, r["verdict"]) for r in out.collect()) == [(0, "UNIT_MISMATCH"), (1, "SUSPICIOUS_MOVE"), (1, "accepted"), (2, "UNIT_MISMATCH"), (2, "UNIT_MISMATCH")]
    assert "Window" not in _plan(out)
    kept = frame.select("instrument_id", "ts", "close", F.lit(DAY).alias("retrieved_at"))
    assert bars.upsert(kept, kept)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_candle_queries_move_and_hold_no_more_than_bars(spark, sf_dir, monkeypatch):
    from tidewater.plans import ingest, market
    from tidewater.sources import sinks

    def refused(*a):
        raise AssertionError("the table is made without another shuffle")

    monkeypatch.setattr(sinks, "write_snapshot", refused)
    assert market.stored_series(spark, sf_dir).select("interval", "series_type").distinct().count() == 4
    assert "max(CASE" not in _plan(ingest.QUERIES["s9_multi_symbol_split"](spark, sf_dir))
    assert "l_suppkey" not in _plan(market.QUERIES["s5_candle_upsert"](spark, sf_dir))


def test_stops_are_carried_from_batch_to_batch(spark, tmp_path):
    """Without a Python call for each instrument; unknown candidates raise nothing."""
    from tidewater.streaming import streams

    lots = [[(1, 1, 5.0), (1, 0, 9.0), (2, 0, None), (3, 0, 4.0)], [(1, 2, 8.0), (1, 3, 11.0), (2, 1, 2.0), (4, 1, float("nan"))], [(3, 5, 1.0), (2, 5, 1.0)]]
    n = streams.files_of_a_part(spark)
    for k, lot in enumerate(lots):
        rows = spark.createDataFrame([(i, DAY + dt.timedelta(days=t), c) for i, t, c in lot], "instrument_id long, ts timestamp, candidate double")
        rows.repartition(n, "ts").write.mode("append").parquet(f"{tmp_path}/in")
        streams.ratchet_stops(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check")
    got = spark.read.schema("instrument_id long, ts timestamp, stop double").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/out")
    low = float("-inf")
    assert sorted((r["instrument_id"], (r["ts"] - DAY).days, r["stop"]) for r in got.collect()) == [(1, 0, 9.0), (1, 1, 9.0), (1, 2, 9.0), (1, 3, 11.0), (2, 0, low), (2, 1, 2.0), (2, 5, 2.0), (3, 0, 4.0), (3, 5, 4.0), (4, 1, low)]
    assert (tmp_path / "out-best").exists()
