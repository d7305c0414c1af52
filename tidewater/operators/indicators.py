"""Technical indicators of every instrument in one window pass and one aggregation.

All bars of an instrument meet in one shuffle. Too little data gives NULL, never a guess. ``bars`` is how
many of the newest bars are loaded; path-dependent indicators start at the first of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bars import newest_first

YEAR = 252


def loaded(candles: DataFrame, bars: int = 300) -> DataFrame:
    """The newest ``bars`` with prev, ret, tr, smas; rn counts from the newest, idx from the oldest, n all."""
    asc = Window.partitionBy("instrument_id").orderBy("ts")
    sma = lambda p: F.when(F.col("idx") >= p, F.avg("close").over(asc.rowsBetween(1 - p, 0)))
    out = (
        newest_first(candles.select("instrument_id", "ts", "open", "high", "low", "close", F.coalesce("volume", F.lit(0.0)).alias("volume")), bars)
        .withColumn("prev", F.lag("close").over(asc))
        .withColumn("idx", F.row_number().over(asc))
    )
    c, p, h, low = (F.col(x) for x in ("close", "prev", "high", "low"))
    return (
        out.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("instrument_id")))
        .withColumn("ret", F.when(p != 0, c / p - 1))
        .withColumn("tr", F.when(p.isNotNull(), F.greatest(h - low, F.abs(h - p), F.abs(low - p))))
        .withColumn("sma50", sma(50))
        .withColumn("sma200", sma(200))
        .withColumn("peak252", F.max(F.when(F.col("rn") <= 252, c)).over(asc.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("peak60", F.max(F.when(F.col("rn") <= 60, c)).over(asc.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("peak20", F.max(F.when(F.col("rn") <= 20, c)).over(asc.rowsBetween(Window.unboundedPreceding, 0)))
    )


def last(p: int, value: Column) -> Column:
    """``value`` on the newest ``p`` bars, NULL before."""
    return F.when(F.col("rn") <= p, value)


def _enough(p: int, value: Column) -> Column:
    return F.when(F.max("n") >= p, value)


def wilder(value: Column, period: int, skip: int = 0) -> Column:
    """Wilder's smoothed mean in closed form, as if the newest ``skip`` bars were absent."""
    q, n, i = (period - 1) / period, F.col("n") - skip, F.col("idx")
    power = F.when(i <= period + 1, n - period - 1).when(i <= n, n - i)
    return F.sum(F.when(F.col("prev").isNotNull(), F.pow(F.lit(q), power) / period * value))


def rsi(period: int = 14, skip: int = 0) -> Column:
    move = F.col("close") - F.col("prev")
    gain, loss = wilder(F.greatest(move, F.lit(0.0)), period, skip), wilder(F.greatest(-move, F.lit(0.0)), period, skip)
    return _enough(period + 1 + skip, F.when(loss == 0, 100.0).otherwise(100 - 100 / (1 + gain / loss)))


def _return(k: int) -> Column:
    """Return over ``k`` bars: needs the bar before them and a positive price there."""
    past, now = F.max(F.when(F.col("rn") == k + 1, F.col("close"))), F.max(last(1, F.col("close")))
    return F.when(past > 0, now / past - 1)


def _slope(sma: str, w: int = 21) -> Column:
    level = F.max(last(1, F.col(sma)))
    points = F.count(last(w, F.col(sma)))
    return F.when((points >= 2) & (level > 0), F.regr_slope(last(w, F.col(sma)), F.col("idx")) / level)


def _drawdown(p: int) -> Column:
    c, peak = F.col("close"), F.col(f"peak{p}")
    return F.when(F.max("n") >= 2, F.max(last(p, F.when(peak > 0, (peak - c) / peak).otherwise(0.0))))


def _high() -> Column:
    return F.max(last(252, F.col("close")))


def _low() -> Column:
    return F.min(last(252, F.col("close")))


def _now() -> Column:
    return F.max(last(1, F.col("close")))


def _mean20() -> Column:
    return _enough(20, F.avg(last(20, F.col("close"))))


def _sd20() -> Column:
    return _enough(20, F.stddev_pop(last(20, F.col("close"))))


def _volatility(p: int) -> Column:
    return _enough(p + 1, F.stddev_samp(last(p, F.col("ret"))) * F.sqrt(F.lit(float(YEAR))))


def _downside(p: int) -> Column:
    return _enough(p + 1, F.sqrt(F.avg(last(p, F.pow(F.least("ret", F.lit(0.0)), 2)))) * F.sqrt(F.lit(float(YEAR))))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom)


#: Every indicator, as what makes its aggregate over the loaded bars of an instrument.
INDICATORS: dict[str, Callable[[], Column]] = {
    "n_bars": lambda: F.max("n"), "last_ts": lambda: F.max("ts"), "last_close": _now, "sma20": _mean20,
    "sma50": lambda: F.max(last(1, F.col("sma50"))), "sma200": lambda: F.max(last(1, F.col("sma200"))),
    "ret21": lambda: _return(21), "ret63": lambda: _return(63), "ret126": lambda: _return(126), "ret252": lambda: _return(252),
    "vol20": lambda: _volatility(20), "vol60": lambda: _volatility(60),
    "downside20": lambda: _downside(20), "downside60": lambda: _downside(60),
    "drawdown20": lambda: _drawdown(20), "drawdown60": lambda: _drawdown(60), "drawdown252": lambda: _drawdown(252),
    "worst_day252": lambda: _enough(2, F.greatest(-F.min(last(YEAR, F.col("ret"))), F.lit(0.0))),
    "avg_volume20": lambda: _enough(20, F.avg(last(20, F.col("volume")))),
    "avg_traded20": lambda: _enough(20, F.avg(last(20, F.col("close") * F.col("volume")))),
    "zero_volume20": lambda: F.count_if(last(20, F.col("volume")) == 0),
    "stale_price20": lambda: F.count_if(last(20, F.col("close")) == F.col("prev")),
    "slope50": lambda: _slope("sma50"), "slope200": lambda: _slope("sma200"), "rsi14": rsi, "rsi14_10_ago": lambda: rsi(14, 10),
    "from_high": lambda: _ratio(_high() - _now(), _high()), "from_low": lambda: _ratio(_now() - _low(), _low()),
    "range_position": lambda: F.when((F.max("n") >= 2) & (_high() > _low()), (_now() - _low()) / (_high() - _low())),
    "atr14": lambda: _enough(15, F.avg(last(14, F.col("tr")))),
    "boll_mid": lambda: F.when(_sd20() > 0, _mean20()), "boll_low": lambda: F.when(_sd20() > 0, _mean20() - 2 * _sd20()), "boll_high": lambda: F.when(_sd20() > 0, _mean20() + 2 * _sd20()),
    "boll_position": lambda: F.when(_sd20() > 0, (_now() - (_mean20() - 2 * _sd20())) / (4 * _sd20())),
    "low20": lambda: F.min(last(20, F.col("close"))),
}


def indicators(candles: DataFrame, bars: int = 300, names: list[str] | None = None) -> DataFrame:
    """One row an instrument; ``names`` picks indicators, all without it."""
    rows = loaded(candles, bars).groupBy("instrument_id")
    return rows.agg(*[INDICATORS[k]().alias(k) for k in (names or INDICATORS)])


def series(candles: DataFrame, bars: int = 300, names: tuple[str, ...] = ("open", "high", "low", "close", "volume")) -> DataFrame:
    """The newest ``bars`` bars of each instrument as arrays in the order of time, ``bars`` long at most; no volume counts as 0."""
    volume = F.coalesce("volume", F.lit(0.0)).alias("volume")
    rows = newest_first(candles.select("instrument_id", "ts", *[volume if c == "volume" else c for c in names]), bars)
    held = rows.groupBy("instrument_id").agg(F.array_sort(F.collect_list(F.struct("ts", *names))).alias("s"))
    return held.select("instrument_id", *[F.col(f"s.{c}").alias(c) for c in ("ts", *names)])


def moving_averages(candles: DataFrame, p: int, bars: int = 300) -> DataFrame:
    """Every loaded bar with its simple moving average, NULL until ``p`` bars are there."""
    asc = Window.partitionBy("instrument_id").orderBy("ts")
    out = newest_first(candles, bars).withColumn("idx", F.row_number().over(asc))
    return out.select("instrument_id", "ts", F.when(F.col("idx") >= p, F.avg("close").over(asc.rowsBetween(1 - p, 0))).alias("sma"))


def daily_returns(candles: DataFrame, bars: int = 300) -> DataFrame:
    rows = loaded(candles, bars).where("prev is not null")
    return rows.select("instrument_id", "ts", "ret")


def preferred_close(candles: DataFrame, bars: int = 300) -> DataFrame:
    """The adjusted close if every loaded bar of the instrument has one, else the raw close."""
    whole = Window.partitionBy("instrument_id")
    rows = newest_first(candles, bars)
    use = F.count("adjusted_close").over(whole) == F.count(F.lit(1)).over(whole)
    return rows.select("instrument_id", "ts", F.when(use, F.col("adjusted_close")).otherwise(F.col("close")).alias("preferred"))


def correlation(left: DataFrame, right: DataFrame, p: int, align: str = "position") -> DataFrame:
    """Correlation of the last ``p`` returns of ``left``'s instruments with the one series ``right``.

    align: "position" pairs the k-th newest returns whatever their dates; "date" pairs equal dates.
    """
    a = newest_first(daily_returns(left, p + 1)).where(F.col("rn") <= p)
    b = newest_first(daily_returns(right, p + 1)).where(F.col("rn") <= p).select(F.col("rn").alias("b_rn"), F.col("ts").alias("b_ts"), F.col("ret").alias("b_ret"))
    on = a["rn"] == F.col("b_rn") if align == "position" else a["ts"] == F.col("b_ts")
    moves = (F.stddev_pop("ret") > 0) & (F.stddev_pop("b_ret") > 0) & (F.count("b_ret") >= p)
    return a.join(F.broadcast(b), on).groupBy("instrument_id").agg(F.when(moves, F.corr("ret", "b_ret")).alias("correlation"))
