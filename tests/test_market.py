"""Hand-computed values and invariants of the market operators, and queries against their SQL."""

import datetime as dt
import hashlib
import json
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidewater.functions import normalise as nm
from tidewater.operators import bars, indicators, insider, lifecycle, scoring, selection, trading
from tidewater.plans import registry

DAY = dt.datetime(2001, 1, 1)


def candles(spark, closes, instrument=1, volume=500_000.0):
    rows = [(instrument, DAY + dt.timedelta(days=i), c, c * 1.01, c * 0.99, c, volume) for i, c in enumerate(map(float, closes))]
    return spark.createDataFrame(rows, "instrument_id long, ts timestamp, open double, high double, low double, close double, volume double")


def one(spark, closes, *names):
    return indicators.indicators(candles(spark, closes), 300, list(names)).first()


def wilder(closes, p=14):
    d = np.diff(closes)
    gain, loss = np.maximum(d, 0), np.maximum(-d, 0)
    g, l = gain[:p].mean(), loss[:p].mean()  # noqa: E741
    for a, b in zip(gain[p:], loss[p:], strict=True):
        g, l = (g * (p - 1) + a) / p, (l * (p - 1) + b) / p  # noqa: E741
    return 100.0 if l == 0 else 100 - 100 / (1 + g / l)


def test_bollinger_uses_the_population_deviation(spark):
    closes = [8, 9, 11, 12] * 5
    r = one(spark, closes, "boll_low", "boll_mid", "boll_high")
    sd = np.std(closes)
    assert r["boll_mid"] == pytest.approx(10) and r["boll_high"] - 10 == pytest.approx(2 * sd) and 10 - r["boll_low"] == pytest.approx(2 * sd)


@pytest.mark.parametrize("n", [10, 15, 40, 300])
def test_rsi_equals_the_recursion(spark, n):
    closes = 100 * np.cumprod(1 + np.random.default_rng(n).normal(0, 0.02, n))
    got = one(spark, closes, "rsi14", "rsi14_10_ago")
    assert got["rsi14"] is None if n < 15 else got["rsi14"] == pytest.approx(wilder(closes))
    assert got["rsi14_10_ago"] is None if n < 25 else got["rsi14_10_ago"] == pytest.approx(wilder(closes[:-10]))


def test_volatility_of_seeded_returns(spark):
    closes = 100 * np.cumprod(1 + np.random.default_rng(42).normal(0, 0.01, 300))
    r = one(spark, closes, "vol60", "vol20", "downside60", "drawdown252")
    rets = np.diff(closes) / closes[:-1]
    assert r["vol60"] == pytest.approx(rets[-60:].std(ddof=1) * math.sqrt(252))
    assert r["downside60"] == pytest.approx(math.sqrt(np.mean(np.minimum(rets[-60:], 0) ** 2)) * math.sqrt(252))
    window = closes[-252:]
    assert r["drawdown252"] == pytest.approx(np.max(1 - window / np.maximum.accumulate(window)))


def test_too_little_data_is_null(spark):
    r = one(spark, [1, 2, 3], "sma20", "sma50", "ret21", "vol20", "rsi14", "atr14", "boll_mid", "zero_volume20", "slope50")
    assert all(r[k] is None for k in ("sma20", "sma50", "ret21", "vol20", "rsi14", "atr14", "boll_mid", "slope50")) and r["zero_volume20"] == 0


def test_flat_prices(spark):
    r = one(spark, [5.0] * 60, "boll_mid", "range_position", "stale_price20", "rsi14", "drawdown60")
    assert r["boll_mid"] is None and r["range_position"] is None and r["stale_price20"] == 20 and r["rsi14"] == 100 and r["drawdown60"] == 0


def test_preferred_close_is_all_or_nothing(spark):
    c = candles(spark, [1, 2, 3]).withColumn("adjusted_close", F.when(F.col("close") > 1, F.col("close") / 2))
    assert [r["preferred"] for r in indicators.preferred_close(c).orderBy("ts").collect()] == [1, 2, 3]
    assert [r["preferred"] for r in indicators.preferred_close(c, 2).orderBy("ts").collect()] == [1, 1.5]


def test_missing_signals_are_not_penalised(spark):
    row = spark.range(1).select(*[F.lit(x).cast("double").alias(n) for n, x in (("a", 0.8), ("b", None), ("c", 0.4))])
    got = row.select(scoring.category_points(20.0, *map(F.col, "abc")), scoring.category_points(20.0, F.col("b")), scoring.clamp01(F.col("b")), scoring.classify(F.lit(75.0)), scoring.classify(F.lit(59.9))).first()
    assert tuple(got) == (pytest.approx(12.0), 10.0, None, "screening_candidate", "does_not_pass")


def test_rising_series_outscores_falling_one(spark):
    up = candles(spark, 100 * 1.001 ** np.arange(300), 1)
    down = candles(spark, 100 * 0.998 ** np.arange(300), 2)
    names = spark.createDataFrame([(1, 0), (2, 1)], "instrument_id long, sector int")
    none = "instrument_id long, as_of date, trailing_pe double, price_to_book double, profit_margin double, revenue_growth double, earnings_growth double, debt_to_equity double, dividend_yield double, market_cap double"
    out = {r["instrument_id"]: r for r in scoring.score_all(indicators.indicators(up.union(down)), names, spark.createDataFrame([], none), "2001-11-05").collect()}
    assert out[1]["core_score"] > out[2]["core_score"] and all(0 <= r[k] <= 100 for r in out.values() for k in ("core_score", "final_score", "quality_score", "price_value"))


def test_price_normalisation_is_not_idempotent(spark):
    p = nm.normalise_price(F.lit(250.0), F.lit("GBX"))
    assert spark.range(1).select(p, nm.normalise_price(p, F.lit("GBX"))).first() == (2.5, 0.025)


def test_upsert_keeps_first_currency_and_last_values_and_replays(spark):
    schema = "instrument_id long, ts timestamp, close double, currency string, retrieved_at timestamp"
    old = spark.createDataFrame([(1, DAY, 1.0, "USD", DAY)], schema)
    new = spark.createDataFrame([(1, DAY, 2.0, "EUR", DAY + dt.timedelta(1)), (2, DAY, 3.0, "EUR", DAY)], schema)
    once = bars.upsert(old, new)
    assert sorted(map(tuple, once.select("instrument_id", "close", "currency").collect())) == [(1, 2.0, "USD"), (2, 3.0, "EUR")]
    assert sorted(map(str, bars.upsert(once, new).collect())) == sorted(map(str, bars.upsert(bars.upsert(once, new), new).collect()))


def test_regime_floor_and_tri_state(spark):
    rows = [(40.0, 0.1, False, False), (None, None, None, None), (25.0, 0.5, True, True)]
    got = [tuple(r) for r in trading.regime(spark.createDataFrame(rows, "vix double, breadth double, sp500_uptrend boolean, world_uptrend boolean")).select("risk_factor", "posture").collect()]
    assert got == [(0.55, "risk-off"), (1.0, "normal"), (0.93, "cautious")]


def test_smallest_cap_prefers_the_first_of_equals(spark):
    cap = spark.range(1).select(trading.smallest_cap({"a": F.lit(2.0), "b": F.lit(1.0), "c": F.lit(1.0)}).alias("c")).first()["c"]
    assert (cap["value"], cap["name"]) == (1.0, "b")


def test_ledger_rejects_debt_and_short_sales(spark):
    fills = [(1, 7, 3, "BUY", 10.0, 50.0, 1), (2, 7, 3, "BUY", 10.0, 70.0, 2), (3, 7, 3, "SELL", 5.0, 80.0, 3), (4, 7, 3, "SELL", 100.0, 80.0, 4), (5, 8, 1, "BUY", 1.0, 5000.0, 1)]
    frame = spark.createDataFrame(fills, "fill_id long, account long, instrument_id long, side string, quantity double, price double, ts long")
    assert [tuple(r) for r in trading.fold_positions(frame, 1000.0).collect()] == [(7, 3, 5.0, 50.0, 900.0, 2)]


def test_quota_counts_minutes_for_refused_calls(spark):
    at = lambda m, s: DAY + dt.timedelta(minutes=m, seconds=s)
    rows = [("p", DAY.date(), at(0, i), i, 3) for i in range(4)] + [("p", DAY.date(), at(1, 0), 4, 3), ("p", DAY.date(), at(2, 0), 5, 3), ("p", DAY.date(), at(2, 1), 6, 1), ("p", DAY.date(), at(2, 2), 7, 1)]
    got = {r["request_id"]: r["reason"] for r in lifecycle.admit(spark.createDataFrame(rows, "provider string, day date, ts timestamp, request_id long, priority int"), 3, 1, 2).collect()}
    assert got == {0: "within budget", 1: "within budget", 2: "minute limit", 3: "minute limit", 4: "within budget", 5: "daily limit", 6: "reserve", 7: "reserve exhausted"}


def test_audit_chain(spark):
    rows = [(1, i, "k", f'say "{i}" é') for i in range(5)] + [(2, 9, "k", "x")]
    chain = lifecycle.append_chain(spark.createDataFrame(rows, "chain long, event_id long, kind string, summary string"))
    assert lifecycle.verify_chain(chain).count() == 0
    first = chain.where("chain = 2").first()
    body = json.dumps({"chain": 2, "kind": "k", "previous": "0" * 64, "sequence": 1, "summary": "x"}, sort_keys=True, separators=(",", ":"))
    assert first["event_hash"] == hashlib.sha256(body.encode()).hexdigest()
    broken = chain.withColumn("previous_hash", F.when(F.col("sequence") == 3, "0" * 64).otherwise(F.col("previous_hash")))
    assert {(r["sequence"], r["problem"]) for r in lifecycle.verify_chain(broken).collect()} == {(3, "hash"), (3, "link")}


def test_a_chain_is_hashed_in_ranges(spark):
    """Chains that span ranges, share one, or end with it; every hash is that of a plain loop."""
    rows = [(c, i * 3 % 101, "k" if i % 4 else None, f'{c} "{i}" é\n') for c, n in ((0, 60), (1, 7), (2, 1), (5, 45)) for i in range(n)]
    frame = spark.createDataFrame(rows, "chain long, event_id long, kind string, summary string").repartition(3)
    got = sorted(map(tuple, lifecycle.append_chain(frame, rows_a_part=10).collect()))
    want, last = [], {}
    for c, i, kind, summary in sorted(rows, key=lambda r: r[:2]):
        n, previous = last.get(c, (0, lifecycle.GENESIS))
        body = lifecycle.canonical({"chain": c, "sequence": n + 1, "kind": kind, "summary": summary, "previous": previous})
        last[c] = (n + 1, hashlib.sha256(body.encode()).hexdigest())
        want.append((c, i, kind, summary, n + 1, previous, last[c][1]))
    assert got == want
    assert lifecycle.append_chain(frame.limit(0)).count() == 0


def test_a_task_sorts_a_range_of_a_chain(spark):
    frame = spark.range(40).selectExpr("0L AS chain", "id AS event_id", "'k' AS kind", "'s' AS summary")
    files = lifecycle.append_chain(frame, rows_a_part=10).inputFiles()
    assert len({f.rsplit("/", 2)[1] for f in files}) > 1


def test_sales_count_for_chiefs_only(spark):
    rows = [(1, 0, 1, "S", DAY, 2e6, False, True, False, False), (2, 0, 2, "S", DAY, 2e6, True, False, False, False), (3, 0, 3, "P", DAY, 5e5, False, False, True, False), (4, 0, 4, "S", DAY, 2e6, True, False, False, True)]
    f = spark.createDataFrame(rows, "accession long, line_index int, instrument_id long, code string, ts timestamp, value double, is_c_suite boolean, is_officer boolean, is_director boolean, is_plan boolean")
    got = {r["instrument_id"]: (r["insider_score"], r["insider_penalty"]) for r in insider.scores(f, candles(spark, [1.0, 2.0], 9), "2001-01-01").collect()}
    assert got == {2: (None, pytest.approx(0.2)), 3: (pytest.approx(50 + 50 * 0.25 / 1.25), 0.0)}


def test_first_tier_wins(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "instrument_id long")
    out = selection.tiered([("a", ids(1, 2), F.col("instrument_id")), ("b", ids(2, 3, 4), -F.col("instrument_id"))], ids(1, 2, 3, 4), 3)
    assert [(r["instrument_id"], r["reason"]) for r in out.collect()] == [(1, "a"), (2, "a"), (4, "b")]


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


SAMPLE = ["s1_candle_scan", "s5_candle_upsert", "a2_market_breadth", "i14_rsi", "i18_average_true_range", "c8_core_score", "c19_scan_job", "s10_json_series", "p1_candle_validation", "n2_insider_score", "st11_regime_alerts", "r3_risk_evaluate", "r10_mean_reversion_signals", "st7_trailing_stop", "u1_three_tiers", "j10_identity_resolution", "st1_incremental_ingestion", "st5_stream_backoff", "au2_chain_verification"]


def plain(v):
    return round(v, 4) if isinstance(v, float) else v.replace(tzinfo=None) if isinstance(v, dt.datetime) else v


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = registry.queries()[name](spark, sf_dir)
    found = con.sql(registry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    rows = lambda many, names: sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in many), key=str)
    assert rows(map(tuple, df.collect()), df.columns) == rows(found.fetchall(), found.columns)


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())
