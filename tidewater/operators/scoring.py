"""Transparent scores of 26 signals in six categories, and the factors blended into a final score.

Every signal is a strength in 0..1 or NULL; a missing signal leaves both numerator and denominator.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import cache
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Category maxima, class thresholds and names, factor weights, penalties.
CATEGORY_MAX = {"trend": 20.0, "momentum": 20.0, "risk": 15.0, "liquidity": 15.0, "positioning": 10.0, "sector": 20.0}
SCREENING, WATCHLIST = 75.0, 60.0
CLASSES = ("screening_candidate", "watchlist_candidate", "does_not_pass")
FACTOR_WEIGHTS = {"fundamental_value": 0.30, "price_cheapness": 0.29, "reversal": 0.05, "quality": 0.12, "sector": 0.09, "insider": 0.15}
NO_FUNDAMENTALS_PENALTY, LEAST_BARS, FULL_HISTORY, ALL_SIGNALS = 0.10, 30, 252, 26


def clamp01(x: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def saturate(x: Column) -> Column:
    return F.when(x > 0, x / (x + 1)).otherwise(0.0)


def flag(test: Column) -> Column:
    return F.when(test, 1.0).when(~test, 0.0)


def mean_known(*xs: Column) -> Column:
    """Mean of those that are not NULL; NULL if all are."""
    n = sum((x.isNotNull().cast("int") for x in xs), F.lit(0))
    return F.when(n > 0, sum((F.coalesce(x, F.lit(0.0)) for x in xs), F.lit(0.0)) / n)


def category_points(most: float, *xs: Column) -> Column:
    return most * F.coalesce(mean_known(*xs), F.lit(0.5))


def classify(score: Column, screening: float = SCREENING, watchlist: float = WATCHLIST) -> Column:
    return F.when(score >= screening, CLASSES[0]).when(score >= watchlist, CLASSES[1]).otherwise(CLASSES[2])


class Signal(NamedTuple):
    """A signal's raw strength (held to 0..1 later), whether it speaks for the instrument, and its text."""

    strength: Column
    positive: Column
    text: Column


def half_even(x: Column, digits: int) -> Column:
    """A double to ``digits`` places, ties to even; what rounds to nothing keeps its sign (-0.0)."""
    return F.rint(x * 10.0**digits) / 10.0**digits


def percent(x: Column, form: str = "%.1f%%", digits: int = 1) -> Column:
    """A share as a percentage, ties to even."""
    return F.format_string(form, half_even(x * 100, digits))


def whole(x: Column) -> Column:
    """A number without decimals and with commas between thousands."""
    return F.format_string("%,d", half_even(x, 0).cast("long"))


def _choice(test: Column, yes: str, no: str, strength: Column | None = None) -> Signal:
    return Signal(flag(test) if strength is None else strength, test, F.when(test, yes).otherwise(no))


def _return(x: Column, name: str) -> Signal:
    return Signal(0.5 + x / 0.4, x > 0, F.concat(F.lit(f"{name} is "), percent(x, "%+.1f%%")))


def _low(x: Column, bad: float, name: str) -> Signal:
    return Signal(1 - x / bad, clamp01(1 - x / bad) >= 0.5, F.concat(F.lit(f"{name} is "), percent(x)))


def trend_signals() -> dict[str, Signal]:
    c, s50, s200, slope = (F.col(x) for x in ("last_close", "sma50", "sma200", "slope200"))
    return {
        "price_above_sma50": _choice(c > s50, "Price is above its 50-day average", "Price is below its 50-day average"),
        "price_above_sma200": _choice(c > s200, "Price is above its 200-day average", "Price is below its 200-day average"),
        "sma50_above_sma200": _choice(s50 > s200, "50-day average is above the 200-day average", "50-day average is below the 200-day average"),
        "sma200_slope": _choice(slope > 0, "Long-term trend is rising", "Long-term trend is falling", 0.5 + slope / 0.002),
    }


def momentum_signals() -> dict[str, Signal]:
    out = {f"return_{m}m": _return(F.col(f"ret{k}"), f"{m}m return") for m, k in ((1, 21), (3, 63), (6, 126), (12, 252))}
    return out | {
        "relative_momentum_12m": _return(F.col("ret252") - F.col("bench_ret252"), "12-month return vs benchmark"),
        "relative_momentum_vs_sector": _return(F.col("ret252") - F.col("sector_ret252"), "12-month return vs its sector"),
    }


def risk_signals() -> dict[str, Signal]:
    return {
        "volatility_20d": _low(F.col("vol20"), 0.60, "20-day volatility"), "volatility_60d": _low(F.col("vol60"), 0.60, "60-day volatility"),
        "max_drawdown_1y": _low(F.col("drawdown252"), 0.50, "1-year max drawdown"), "downside_deviation_60d": _low(F.col("downside60"), 0.40, "downside deviation"),
        "largest_daily_loss_1y": _low(F.col("worst_day252"), 0.20, "largest 1-day loss"),
    }


def liquidity_signals() -> dict[str, Signal]:
    value, volume, zero, stale = (F.col(x) for x in ("avg_traded20", "avg_volume20", "zero_volume20", "stale_price20"))
    depth = F.log10(F.greatest(value, F.lit(1.0))) / 6
    return {
        "avg_traded_value_20d": Signal(F.when(value.isNotNull(), depth), depth >= 0.5, F.concat(F.lit("20-day average traded value is "), whole(value))),
        "avg_volume_20d": Signal(volume / 1e6, volume >= 100_000, F.concat(F.lit("20-day average volume is "), whole(volume))),
        "zero_volume_days_20d": Signal(1 - zero / 5.0, zero == 0, F.format_string("%d zero-volume day(s) in 20", zero)),
        "stale_price_days_20d": Signal(1 - stale / 5.0, stale <= 1, F.format_string("%d stale-price day(s) in 20", stale)),
    }


def positioning_signals() -> dict[str, Signal]:
    high, place, low = (F.col(x) for x in ("from_high", "range_position", "from_low"))
    return {
        "distance_from_52w_high": Signal(1 - high / 0.5, high < 0.25, F.concat(percent(high), F.lit(" below the 52-week high"))),
        "position_in_52w_range": Signal(place, place >= 0.5, F.concat(F.lit("At the "), percent(place, "%.0f%%", 0), F.lit(" mark of its 52-week range"))),
        "distance_from_52w_low": Signal(low / 1.0, low > 0.20, F.concat(percent(low), F.lit(" above the 52-week low"))),
    }


def sector_signals() -> dict[str, Signal]:
    close, sma, slope = (F.col(x) for x in ("sector_close", "sector_sma200", "sector_slope200"))
    return {
        "sector_above_200d": _choice(close > sma, "Sector is above its 200-day average", "Sector is below its 200-day average"),
        "sector_trend_rising": _choice(slope > 0, "Sector trend is rising", "Sector trend is falling", 0.5 + slope / 0.002),
        "sector_momentum_3m": _return(F.col("sector_ret63"), "Sector 3m return"), "sector_momentum_6m": _return(F.col("sector_ret126"), "Sector 6m return"),
    }


CATEGORIES = {"trend": trend_signals, "momentum": momentum_signals, "risk": risk_signals, "liquidity": liquidity_signals, "positioning": positioning_signals, "sector": sector_signals}


def _clamped(rows: DataFrame, raw: dict[str, Column]) -> DataFrame:
    """Add columns held to 0..1; two projections, so that each raw expression is evaluated once."""
    out = rows.withColumns({f"_{k}": v for k, v in raw.items()}).withColumns({k: clamp01(F.col(f"_{k}")) for k in raw})
    return out.drop(*[f"_{k}" for k in raw])


def with_signals(rows: DataFrame, *categories: str) -> DataFrame:
    """Add the strength of every signal of the categories (all without any) as a column ``x_<name>``."""
    raw = {f"x_{k}": v for name, make in CATEGORIES.items() if not categories or name in categories for k, v in make().items()}
    return _clamped(rows, {k: v.strength for k, v in raw.items()})


@cache
def signal_names() -> dict[str, tuple[str, ...]]:
    return {name: tuple(make()) for name, make in CATEGORIES.items()}


def _x(category: str) -> list[Column]:
    return [F.col(f"x_{k}") for k in signal_names()[category]]


def with_strengths(rows: DataFrame) -> DataFrame:
    """Add every signal as ``x_<name>`` and every part of the factor scores as ``<score>_<n>``, all in 0..1."""
    raw = {f"x_{k}": v.strength for make in CATEGORIES.values() for k, v in make().items()}
    return _clamped(rows, raw | {f"{name}_{i}": part for name, make in PARTS.items() for i, part in enumerate(make())})


@cache
def part_names() -> dict[str, tuple[str, ...]]:
    return {name: tuple(f"{name}_{i}" for i in range(len(make()))) for name, make in PARTS.items()}


def part_mean(name: str) -> Column:
    """100 x the mean of the known parts of a factor score; NULL without any."""
    return 100 * mean_known(*map(F.col, part_names()[name]))


def with_context(ind: DataFrame, instruments: DataFrame, benchmark: int = 0) -> DataFrame:
    """Join each instrument's sector proxy (the sector's smallest instrument) and the benchmark's row.

    Both are rows of the same indicator table; the lookups have a row a sector and one row.
    """
    proxies = instruments.groupBy("sector").agg(F.min("instrument_id").alias("proxy_id"))
    proxy = (
        ind.join(F.broadcast(proxies), ind["instrument_id"] == F.col("proxy_id"))
        .where(F.col("n_bars") >= LEAST_BARS)
        .select("sector", F.col("last_close").alias("sector_close"), *[F.col(c).alias(f"sector_{c}") for c in ("sma200", "slope200", "ret63", "ret126", "ret252")])
    )
    bench = ind.where(F.col("instrument_id") == benchmark).select(F.col("ret252").alias("bench_ret252"))
    out = ind.join(instruments.select("instrument_id", "sector"), "instrument_id").join(F.broadcast(proxy), "sector", "left")
    return out.join(F.broadcast(bench), F.lit(True), "left")


def core_columns() -> dict[str, Column]:
    """Category points and completeness of rows with signals."""
    names = signal_names()
    known = sum((x.isNotNull().cast("int") for name in names for x in _x(name)), F.lit(0))
    return {**{f"{name}_points": category_points(CATEGORY_MAX[name], *_x(name)) for name in names}, "completeness": known / ALL_SIGNALS}


def signal_lists(rows: DataFrame) -> DataFrame:
    """Texts of the known signals that speak for and against, and names of the missing ones, in the order of the signals."""
    each = {k: v for make in CATEGORIES.values() for k, v in make().items()}
    all_ = F.array(*[F.struct(F.lit(k).alias("name"), F.col(f"x_{k}").isNotNull().alias("known"), v.positive.alias("positive"), v.text.alias("text")) for k, v in each.items()])
    pick = lambda test, what: F.transform(F.filter("_signals", test), lambda s: s[what])
    return rows.withColumn("_signals", all_).select(
        "instrument_id", pick(lambda s: s["known"] & s["positive"], "text").alias("positive"), pick(lambda s: s["known"] & ~s["positive"], "text").alias("negative"), pick(lambda s: ~s["known"], "name").alias("missing")
    )


def reversal_parts() -> list[Column]:
    """RSI turn, reclaim of the 20-day mean, weak half-year turning, off the low, calmer fall."""
    turn = clamp01(0.5 + (F.col("rsi14") - F.col("rsi14_10_ago")) / 20)
    bounce = F.when((F.col("rsi14_10_ago") < 40) & (F.col("rsi14") < 60), 0.2).otherwise(0.0)
    off = F.col("from_low")
    return [
        turn + bounce, 0.5 + (F.col("last_close") / F.col("sma20") - 1) / 0.10, F.when(F.col("ret126") < 0, F.col("ret21") / 0.10),
        F.when(off <= 0.15, off / 0.15).otherwise(1 - (off - 0.15) / 0.35), F.when(F.col("downside60") > 0, 1 - F.col("downside20") / F.col("downside60")),
    ]


def price_value_parts() -> list[Column]:
    """Far from the high, low in the range, below the long mean, oversold."""
    discount = F.when(F.col("sma200") > 0, 1 - F.col("last_close") / F.col("sma200"))
    return [F.col("from_high") / 0.4, 1 - F.col("range_position"), 0.5 + discount / 0.4, (70 - F.col("rsi14")) / 40]


def fundamental_value_parts() -> list[Column]:
    pe, pb, g, dy = (F.col(c) for c in ("trailing_pe", "price_to_book", "earnings_growth", "dividend_yield"))
    return [
        F.when(pe > 0, 1 / pe / 0.10), F.when(pb > 0, 1 - (pb - 1) / 4), F.when((pe > 0) & (pb > 0), (1 - F.sqrt(pe * pb / 22.5)) / 0.5),
        F.when((pe > 0) & (g > 0), (2 - pe / (100 * g)) / 1.5), F.when(dy >= 0, dy / 0.04),
    ]


def fundamental_quality_parts() -> list[Column]:
    pe, margin, growth, debt = (F.col(c) for c in ("trailing_pe", "profit_margin", "revenue_growth", "debt_to_equity"))
    return [F.when(pe > 0, 1 - (pe - 10) / 30), margin / 0.30, 0.5 + growth / 0.4, F.when(debt >= 0, 1 - debt / 200)]


PARTS = {"reversal_score": reversal_parts, "price_value": price_value_parts, "fundamental_value": fundamental_value_parts, "fundamental_quality": fundamental_quality_parts}


def blended_value(price: Column, fundamental: Column) -> Column:
    return F.when(fundamental.isNotNull(), 0.65 * price + 0.35 * fundamental).otherwise(price)


def primary_score(momentum: Column, value: Column, momentum_weight: float = 0.5, value_weight: float = 0.5) -> Column:
    """Two axes; a missing value counts as 50; zero weights give momentum."""
    total = momentum_weight + value_weight
    return momentum if total <= 0 else (momentum * momentum_weight + F.coalesce(value, F.lit(50.0)) * value_weight) / total


def final_score(factors: Mapping[str, Column], penalty: Column, weights: Mapping[str, float] = FACTOR_WEIGHTS) -> Column:
    """Weighted mean of the known factors, cut without fundamental value and by the insider penalty; two places."""
    total = sum((F.when(x.isNotNull(), weights[k]).otherwise(0.0) for k, x in factors.items()), F.lit(0.0))
    score = sum((F.coalesce(x, F.lit(0.0)) * weights[k] for k, x in factors.items()), F.lit(0.0)) / total
    cut = F.when(factors["fundamental_value"].isNull(), 1 - NO_FUNDAMENTALS_PENALTY).otherwise(1.0) * (1 - F.coalesce(clamp01(penalty), F.lit(0.0)))
    return F.when(total > 0, F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score * cut)), 2)).otherwise(0.0)


def latest_fundamentals(snapshots: DataFrame, as_of: str) -> DataFrame:
    rest = [c for c in snapshots.columns if c != "instrument_id"]
    newest = F.max_by(F.struct(*rest), "as_of").alias("f")
    return snapshots.where(F.col("as_of") <= F.lit(as_of).cast("date")).groupBy("instrument_id").agg(newest).select("instrument_id", "f.*")


def score_all(ind: DataFrame, instruments: DataFrame, snapshots: DataFrame, as_of: str, insider: DataFrame | None = None) -> DataFrame:
    """The scan: every instrument with enough bars, its factors, final score and class.

    A handful of projections, each over columns of the one before, so that nothing is evaluated twice.
    """
    rows = with_context(ind.where(F.col("n_bars") >= LEAST_BARS), instruments).join(latest_fundamentals(snapshots, as_of), "instrument_id", "left")
    rows = rows.join(insider, "instrument_id", "left") if insider is not None else rows.withColumns({"insider_score": F.lit(None).cast("double"), "insider_penalty": F.lit(None).cast("double")})
    first = {"price_value": F.coalesce(part_mean("price_value"), F.lit(50.0)), "_risk": mean_known(*_x("risk")), "_liquidity": mean_known(*_x("liquidity")), "sector_score": 100 * mean_known(*_x("sector"))}
    first |= {name: part_mean(name) for name in ("reversal_score", "fundamental_value", "fundamental_quality")}
    rows = with_strengths(rows).withColumns(core_columns() | first)
    quality = mean_known(F.col("fundamental_quality") / 100, F.col("_risk"), F.col("_liquidity"))
    rows = rows.withColumns({
        "core_score": sum((F.col(f"{name}_points") for name in CATEGORIES), F.lit(0.0)),
        "confidence": clamp01(0.5 * F.col("completeness") + 0.5 * clamp01(F.col("n_bars") / float(FULL_HISTORY))),
        "quality_score": 100 * F.coalesce(quality, F.lit(0.5)), "value_score": blended_value(F.col("price_value"), F.col("fundamental_value")),
    })
    names = {"fundamental_value": "fundamental_value", "price_cheapness": "price_value", "reversal": "reversal_score", "quality": "quality_score", "sector": "sector_score", "insider": "insider_score"}
    factors = {k: F.round(F.col(c), 2) if k != "insider" else F.col(c) for k, c in names.items()}
    age = (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("last_ts")) / 86400
    rows = rows.withColumns({"final_score": final_score(factors, F.col("insider_penalty")), "freshness_days": age})
    return rows.withColumn("classification", classify(F.col("final_score")))


def run_summary(considered: DataFrame, scored: DataFrame) -> DataFrame:
    """Considered, scored, skipped, and how many of each class."""
    n = considered.agg(F.count(F.lit(1)).alias("considered"))
    s = scored.agg(F.count(F.lit(1)).alias("scored"), *[F.count_if(F.col("classification") == c).alias(f"n_{c}") for c in CLASSES])
    return n.join(s, F.lit(True)).withColumn("skipped", F.col("considered") - F.col("scored"))
