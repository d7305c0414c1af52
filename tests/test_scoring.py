"""Every signal, its polarity and text, the factors and the final score against plain loops, and every entry of the row-rule tables."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.functions import normalise as nm
from tidewater.operators import indicators, scoring

DAY = dt.datetime(2001, 1, 1)
FUNDAMENTALS = ("trailing_pe", "price_to_book", "profit_margin", "revenue_growth", "earnings_growth", "debt_to_equity", "dividend_yield", "market_cap")


def clamp(x):
    return max(0.0, min(1.0, x))


def mean(xs):
    xs = [x for x in xs if x is not None]
    return sum(xs) / len(xs) if xs else None


def sma(c, p):
    return float(np.mean(c[-p:])) if len(c) >= p else None


def ret(c, k):
    return c[-1] / c[-1 - k] - 1 if len(c) > k and c[-1 - k] > 0 else None


def slope(c):
    points = [float(np.mean(c[i - 200 : i])) for i in range(200, len(c) + 1)][-21:]
    return float(np.polyfit(range(len(points)), points, 1)[0]) / points[-1] if len(points) >= 2 and points[-1] > 0 else None


def downside(c, p):
    r = np.diff(c) / c[:-1]
    return math.sqrt(np.mean(np.minimum(r[-p:], 0) ** 2)) * math.sqrt(252) if len(r) >= p else None


def volatility(c, p):
    r = np.diff(c) / c[:-1]
    return float(r[-p:].std(ddof=1)) * math.sqrt(252) if len(r) >= p else None


def rsi(c, p=14):
    if len(c) < p + 1:
        return None
    d = np.diff(c)
    gain, loss = np.maximum(d, 0), np.maximum(-d, 0)
    g, lo = gain[:p].mean(), loss[:p].mean()
    for a, b in zip(gain[p:], loss[p:], strict=True):
        g, lo = (g * (p - 1) + a) / p, (lo * (p - 1) + b) / p
    return 100.0 if lo == 0 else 100 - 100 / (1 + g / lo)


def slow_signals(c, v, bench, sector):
    """name -> (strength, positive), or None if it is missing."""
    out = {}

    def put(name, value, strength, positive):
        out[name] = None if value is None else (clamp(strength(value)), bool(positive(value)))

    price, s50, s200 = c[-1], sma(c, 50), sma(c, 200)
    put("price_above_sma50", s50, lambda s: float(price > s), lambda s: price > s)
    put("price_above_sma200", s200, lambda s: float(price > s), lambda s: price > s)
    put("sma50_above_sma200", s200, lambda s: float(s50 > s), lambda s: s50 > s)
    put("sma200_slope", slope(c), lambda s: 0.5 + s / 0.002, lambda s: s > 0)
    up = lambda name, x: put(name, x, lambda r: 0.5 + r / 0.4, lambda r: r > 0)
    for m, k in ((1, 21), (3, 63), (6, 126), (12, 252)):
        up(f"return_{m}m", ret(c, k))
    less = lambda a, b: None if a is None or b is None else a - b
    up("relative_momentum_12m", less(ret(c, 252), ret(bench, 252)))
    up("relative_momentum_vs_sector", less(ret(c, 252), ret(sector, 252)) if sector is not None else None)
    low = lambda name, x, bad: put(name, x, lambda r: 1 - r / bad, lambda r: clamp(1 - r / bad) >= 0.5)
    year = c[-252:]
    low("volatility_20d", volatility(c, 20), 0.6)
    low("volatility_60d", volatility(c, 60), 0.6)
    low("max_drawdown_1y", float(np.max(1 - year / np.maximum.accumulate(year))), 0.5)
    low("downside_deviation_60d", downside(c, 60), 0.4)
    low("largest_daily_loss_1y", max(0.0, float(-np.min((np.diff(c) / c[:-1])[-252:]))), 0.2)
    put("avg_traded_value_20d", float(np.mean((c * v)[-20:])), lambda x: math.log10(max(x, 1)) / 6, lambda x: math.log10(max(x, 1)) / 6 >= 0.5)
    put("avg_volume_20d", float(np.mean(v[-20:])), lambda x: x / 1e6, lambda x: x >= 100_000)
    put("zero_volume_days_20d", int(np.sum(v[-20:] == 0)), lambda x: 1 - x / 5, lambda x: x == 0)
    put("stale_price_days_20d", int(np.sum(np.diff(c)[-20:] == 0)), lambda x: 1 - x / 5, lambda x: x <= 1)
    hi, lo = year.max(), year.min()
    put("distance_from_52w_high", (hi - price) / hi, lambda x: 1 - x / 0.5, lambda x: x < 0.25)
    put("position_in_52w_range", (price - lo) / (hi - lo), lambda x: x, lambda x: x >= 0.5)
    put("distance_from_52w_low", (price - lo) / lo, lambda x: x, lambda x: x > 0.2)
    s = sector if sector is not None else np.array([])
    put("sector_above_200d", sma(s, 200), lambda x: float(s[-1] > x), lambda x: s[-1] > x)
    put("sector_trend_rising", slope(s) if len(s) > 200 else None, lambda x: 0.5 + x / 0.002, lambda x: x > 0)
    up("sector_momentum_3m", ret(s, 63))
    up("sector_momentum_6m", ret(s, 126))
    return out


def slow_scores(c, v, bench, sector, f):
    x = slow_signals(c, v, bench, sector)
    names = list(x)
    strengths = {k: y and y[0] for k, y in x.items()}
    parts = {"trend": names[:4], "momentum": names[4:10], "risk": names[10:15], "liquidity": names[15:19], "positioning": names[19:22], "sector": names[22:]}
    means = {k: mean([strengths[n] for n in own]) for k, own in parts.items()}
    core = sum(scoring.CATEGORY_MAX[k] * (0.5 if m is None else m) for k, m in means.items())
    turn, before = rsi(c), rsi(c[:-10])
    rev = []
    if before is not None:
        rev.append(clamp(clamp(0.5 + (turn - before) / 20) + (0.2 if before < 40 and turn < 60 else 0)))
    rev.append(clamp(0.5 + (c[-1] / sma(c, 20) - 1) / 0.1))
    if (six := ret(c, 126)) is not None and six < 0:
        rev.append(clamp(ret(c, 21) / 0.1))
    off = (c[-1] - c[-252:].min()) / c[-252:].min()
    rev.append(clamp(off / 0.15) if off <= 0.15 else clamp(1 - (off - 0.15) / 0.35))
    if (d60 := downside(c, 60)) and d60 > 0:
        rev.append(clamp(1 - downside(c, 20) / d60))
    hi, lo = c[-252:].max(), c[-252:].min()
    cheap = [clamp((hi - c[-1]) / hi / 0.4), clamp(1 - (c[-1] - lo) / (hi - lo))]
    if (s200 := sma(c, 200)) is not None:
        cheap.append(clamp(0.5 + (s200 - c[-1]) / s200 / 0.4))
    cheap.append(clamp((70 - turn) / 40))
    pe, pb, margin, growth, earnings, debt, dividend = (f.get(k) for k in FUNDAMENTALS[:7])
    value = []
    if pe and pe > 0:
        value.append(clamp(1 / pe / 0.1))
    if pb and pb > 0:
        value.append(clamp(1 - (pb - 1) / 4))
    if pe and pe > 0 and pb and pb > 0:
        value.append(clamp((1 - math.sqrt(pe * pb / 22.5)) / 0.5))
    if pe and pe > 0 and earnings and earnings > 0:
        value.append(clamp((2 - pe / (earnings * 100)) / 1.5))
    if dividend is not None and dividend >= 0:
        value.append(clamp(dividend / 0.04))
    sound = []
    if pe and pe > 0:
        sound.append(clamp(1 - (pe - 10) / 30))
    if margin is not None:
        sound.append(clamp(margin / 0.3))
    if growth is not None:
        sound.append(clamp(0.5 + growth / 0.4))
    if debt is not None and debt >= 0:
        sound.append(clamp(1 - debt / 200))
    hundred = lambda xs: None if mean(xs) is None else 100 * mean(xs)
    factors = {
        "fundamental_value": hundred(value), "price_cheapness": hundred(cheap), "reversal": hundred(rev), "quality": 100 * mean([mean(sound), means["risk"], means["liquidity"]]),
        "sector": hundred([strengths[n] for n in parts["sector"]]),
    }
    weights = {"fundamental_value": 0.30, "price_cheapness": 0.29, "reversal": 0.05, "quality": 0.12, "sector": 0.09}
    known = {k: round(y, 2) for k, y in factors.items() if y is not None}
    final = sum(weights[k] * y for k, y in known.items()) / sum(weights[k] for k in known) * (1 if factors["fundamental_value"] is not None else 0.9)
    return x, core, factors, final


def test_signals_factors_and_final_score(spark):
    rng = np.random.default_rng(3)
    n = {0: 300, 1: 300, 2: 260, 3: 90, 4: 35, 5: 300, 6: 300}
    drift = {0: 0.0005, 1: 0.002, 2: -0.003, 3: 0.001, 4: 0.0, 5: 0.004, 6: -0.001}
    closes = {i: np.round(50 * np.cumprod(1 + rng.normal(drift[i], 0.004 * (i + 1), n[i])), 2) for i in n}
    closes[6][-3:] = closes[6][-4]
    volumes = {i: rng.integers(0, 3, n[i]) * 10.0 ** (i + 1) for i in n}
    sectors = {0: 0, 1: 1, 2: 1, 3: 0, 4: 2, 5: 1, 6: 3}
    proxy = {s: min(i for i, x in sectors.items() if x == s) for s in sectors.values()}
    f = {1: (8.0, 1.2, 0.2, 0.1, 0.15, 50.0, 0.03), 2: (-3.0, 0.5, -0.1, -0.3, None, -20.0, None), 3: (25.0, None, None, None, 0.1, 150.0, 0.0), 5: (None,) * 7}
    facts = {i: dict(zip(FUNDAMENTALS, row, strict=False)) for i, row in f.items()}
    rows = [(i, DAY + dt.timedelta(days=k), float(x), float(x), float(x), float(x), float(volumes[i][k])) for i in n for k, x in enumerate(closes[i])]
    candles = spark.createDataFrame(rows, "instrument_id long, ts timestamp, open double, high double, low double, close double, volume double")
    names = spark.createDataFrame(list(sectors.items()), "instrument_id long, sector int")
    snapshots = spark.createDataFrame([(i, dt.date(2001, 1, 1), *row, 1.0) for i, row in f.items()], "instrument_id long, as_of date, " + ", ".join(f"{k} double" for k in FUNDAMENTALS))
    ind = indicators.indicators(candles)
    got = {r["instrument_id"]: r for r in scoring.score_all(ind, names, snapshots, "2001-11-05").collect()}
    lists = {r["instrument_id"]: r for r in scoring.signal_lists(scoring.with_signals(scoring.with_context(ind, names))).collect()}
    assert set(got) == set(n)
    for i in n:
        x, core, factors, final = slow_scores(closes[i], volumes[i], closes[0], closes[proxy[sectors[i]]], facts.get(i, {}))
        for name, y in x.items():
            assert (got[i][f"x_{name}"] is None) == (y is None), (i, name)
            if y is not None:
                assert got[i][f"x_{name}"] == pytest.approx(y[0], abs=1e-9), (i, name)
        assert got[i]["core_score"] == pytest.approx(core)
        for name, column in {"fundamental_value": "fundamental_value", "price_cheapness": "price_value", "reversal": "reversal_score", "quality": "quality_score", "sector": "sector_score"}.items():
            assert got[i][column] == (None if factors[name] is None else pytest.approx(factors[name])), (i, name)
        assert got[i]["final_score"] == pytest.approx(final, abs=0.011)
        assert got[i]["classification"] == ("screening_candidate" if got[i]["final_score"] >= 75 else "watchlist_candidate" if got[i]["final_score"] >= 60 else "does_not_pass")
        assert lists[i]["missing"] == [k for k, y in x.items() if y is None]
        assert len(lists[i]["positive"]) == sum(y is not None and y[1] for y in x.values())
        assert len(lists[i]["negative"]) == sum(y is not None and not y[1] for y in x.values())
    assert "1m return is %+.1f%%" % (100 * ret(closes[1], 21)) in lists[1]["positive"] + lists[1]["negative"]


def test_signals_at_their_edges(spark):
    """A zero return is no plus, one stale day is, a zero-volume day is not, commas stand between thousands."""
    row = {"last_close": 10.0, "sma50": 10.0, "ret21": 0.0, "zero_volume20": 1, "stale_price20": 1, "avg_volume20": 100_000.0, "avg_traded20": 1_234_567.5, "from_high": 0.25, "from_low": 0.2, "range_position": 0.5, "vol20": 0.3}
    need = ["sma200", "slope200", "ret63", "ret126", "ret252", "bench_ret252", "sector_ret252", "vol60", "drawdown252", "downside60", "worst_day252", "sector_close", "sector_sma200", "sector_slope200", "sector_ret63", "sector_ret126"]
    frame = spark.range(1).select(F.lit(1).alias("instrument_id"), *[F.lit(v).alias(k) for k, v in row.items()], *[F.lit(None).cast("double").alias(k) for k in need])
    got = scoring.signal_lists(scoring.with_signals(frame)).first()
    assert got["positive"] == [
        "20-day volatility is 30.0%", "20-day average traded value is 1,234,568", "20-day average volume is 100,000", "1 stale-price day(s) in 20", "At the 50% mark of its 52-week range",
    ]
    assert got["negative"] == ["Price is below its 50-day average", "1m return is +0.0%", "1 zero-volume day(s) in 20", "25.0% below the 52-week high", "20.0% above the 52-week low"]
    assert len(got["missing"]) == 16


def test_percentages_round_ties_to_even_and_keep_their_sign(spark):
    x = F.col("x")
    rows = spark.createDataFrame([(-0.0004,), (0.0004,), (0.1225,), (0.039499999999999997,), (1.0605,)], "x double")
    got = rows.select(scoring.percent(x, "%+.1f%%"), scoring.percent(x, "%.0f%%", 0), scoring.whole(x * 1000)).collect()
    assert [tuple(r) for r in got] == [("-0.0%", "-0%", "0"), ("+0.0%", "0%", "0"), ("+12.2%", "12%", "122"), ("+4.0%", "4%", "40"), ("+106.0%", "106%", "1,060")]


def test_final_score_blends_known_factors_only(spark):
    ask = lambda penalty, **x: spark.range(1).select(scoring.final_score({k: F.lit(x.get(k)).cast("double") for k in scoring.FACTOR_WEIGHTS}, F.lit(penalty).cast("double"))).first()[0]
    assert ask(None) == 0.0
    assert ask(None, fundamental_value=80.0, price_cheapness=50.0) == round((0.3 * 80 + 0.29 * 50) / 0.59, 2)
    assert ask(None, price_cheapness=50.0) == 45.0
    assert ask(0.4, fundamental_value=100.0, insider=100.0) == 60.0
    assert ask(1.5, fundamental_value=100.0) == 0.0 and ask(-1.0, fundamental_value=100.0) == 100.0


def values(spark, make, *rows):
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r[0] for r in frame.orderBy("i").select(make(F.col("x"))).collect()]


def test_venue_tables(spark):
    first = {"XNAS": "T", "XNYS": "T", "ARCX": "T", "BATS": "T", "XLON": "T.L", "XETR": "T.DE", "XPAR": "T.PA", "XAMS": "T.AS", "XMIL": "T.MI", "XMAD": "T.MC", "XSWX": "T.SW", "XSTO": "T.ST", "XHEL": "T.HE", "XCSE": "T.CO", "XOSL": "T.OL", "XDUB": "T.IR", "XLIS": "T.LS", "XBRU": "T.BR", "XWBO": "T.VI", "XWAR": "T.WA", "XTSE": None, None: None}
    assert values(spark, lambda x: nm.vendor_symbol(F.lit("T"), x), *first) == list(first.values())
    second = dict.fromkeys(("XNAS", "XNYS", "ARCX", "BATS"), "T.US") | {"XLON": "T.LSE", "XETR": "T.XETRA", "XPAR": "T.PA", "XAMS": "T.AS", "XBRU": "T.BR", "XMIL": "T.MI", "XMAD": "T.MC", "XSWX": "T.SW", "XWBO": "T.VI", "XLIS": "T.LS", "XDUB": "T.IR", "XSTO": "T.ST", "XHEL": "T.HE", "XCSE": "T.CO", "XOSL": "T.OL", "XWAR": "T.WAR", "XASE": None, None: None}
    assert values(spark, lambda x: nm.second_vendor_symbol(F.lit("T"), x), *second) == list(second.values())
    broker = {"Al_EQ": "XLON", "A_US_EQ": "XNAS", "Ad_EQ": "XETR", "Ap_EQ": "XPAR", "Aa_EQ": "XAMS", "Am_EQ": "XMIL", "Ae_EQ": "XMAD", "As_EQ": "XSWX", "A_SW_EQ": "XSWX", "A_EQ": None, "A_UK_EQ": None, "A": None}
    assert values(spark, nm.broker_venue, *broker) == list(broker.values())
    assert values(spark, nm.broker_bare, *broker) == ["A"] * 12


def test_titles(spark):
    chiefs = [f"the {x.upper()}" for x in ("ceo", "cfo", "cto", "coo", "cio", "cmo", "clo", "cao", "chro", "ciso", "cro", "cco", "cdo")]
    yes = [*chiefs, "Chief Executive Officer", "chief legal & compliance officer", "President", "President and Vice-Chair", "EVP & Chief Financial Officer", "Senior Vice President, CFO"]
    no = ["EVP and President", "svp, president of retail", "SVP President", "Vice President", "Vice-President", "VP", "Officer", "", None, "CEOs", "Director"]
    assert values(spark, nm.is_c_suite, *yes) == [True] * len(yes) and values(spark, nm.is_c_suite, *no) == [False] * len(no)


def test_redaction_reaches_six_levels_and_all_keys(spark):
    keys = ("api_key", "apikey", "authorization", "password", "secret", "token", "session_token", "private_key", "encrypted_api_key")
    flat = spark.range(1).select(F.create_map(*[F.lit(x) for k in (*keys, "API_KEY", "cookie", "session", "tokens") for x in (k, "v")]).alias("m"))
    got = flat.select(nm.redact(F.col("m"), flat.schema["m"].dataType)).first()[0]
    assert all(got[k] == "[redacted]" for k in (*keys, "API_KEY")) and got["cookie"] == got["session"] == got["tokens"] == "v"
    for depth in range(9):
        inner = F.struct(F.lit("v").alias("Token"), F.lit(1).alias("n"))
        for _ in range(depth):
            inner = F.struct(inner.alias("x"))
        frame = spark.range(1).select(inner.alias("p"))
        text = frame.select(F.to_json(nm.redact(F.col("p"), frame.schema["p"].dataType))).first()[0]
        assert ("[redacted]" in text) == (depth <= 6) and '"n":1' in text
    lists = spark.range(1).select(F.array(F.struct(F.lit(5).alias("secret"), F.lit("k").alias("a"))).alias("p"))
    assert lists.select(F.to_json(nm.redact(F.col("p"), lists.schema["p"].dataType))).first()[0] == '[{"a":"k"}]'
