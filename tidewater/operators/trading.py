"""Regime, sizing, strategy signals, stops, profit and exposure."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bars import newest_first

#: Regime floor, cuts and levels; alert levels; sizing defaults.
LEAST_FACTOR, FULL_CUT, MILD_CUT = 0.55, 0.15, 0.07
VIX_ELEVATED, VIX_HIGH, BREADTH_WEAK, BREADTH_POOR = 20.0, 30.0, 0.45, 0.30
VIX_LEVELS, RATIO_LEVELS = (20.0, 30.0, 40.0), (150.0, 175.0, 200.0, 225.0, 250.0)
STEP = 8


def regime(readings: DataFrame) -> DataFrame:
    """vix, breadth, sp500_uptrend, world_uptrend -> risk_factor, posture, reasons; a missing input cuts nothing."""
    v, b = F.col("vix"), F.col("breadth")
    rules = [
        (v >= VIX_HIGH, FULL_CUT, "vix high"), ((v >= VIX_ELEVATED) & (v < VIX_HIGH), MILD_CUT, "vix elevated"), (b <= BREADTH_POOR, FULL_CUT, "breadth poor"),
        ((b <= BREADTH_WEAK) & (b > BREADTH_POOR), MILD_CUT, "breadth weak"), (~F.col("sp500_uptrend"), FULL_CUT, "index below its mean"), (~F.col("world_uptrend"), MILD_CUT, "world below its mean"),
    ]
    cut = sum((F.when(t, c).otherwise(0.0) for t, c, _ in rules), F.lit(0.0))
    factor = F.greatest(F.lit(LEAST_FACTOR), F.round(1 - cut, 4))
    posture = F.when(factor >= 0.99, "normal").when(factor >= 0.85, "cautious").when(factor >= 0.70, "defensive").otherwise("risk-off")
    reasons = F.array_compact(F.array(*[F.when(t, text) for t, _, text in rules]))
    return readings.withColumns({"risk_factor": factor, "posture": posture, "reasons": reasons})


def current_factor(snapshots: DataFrame) -> DataFrame:
    """The newest snapshot's factor, held to its range; 1 without any."""
    newest = F.max_by("risk_factor", "day")
    return snapshots.agg(F.coalesce(F.greatest(F.lit(LEAST_FACTOR), F.least(F.lit(1.0), newest)), F.lit(1.0)).alias("risk_factor"))


def crossed(before: Column, now: Column, level: float) -> Column:
    return F.when((before < level) & (now >= level), "above").when((before >= level) & (now < level), "below")


def regime_alerts(snapshots: DataFrame, key: str = "series", day: str = "day") -> DataFrame:
    """One row for each change against the reading before; the first reading always alerts."""
    order = Window.partitionBy(key).orderBy(day)
    before = {c: F.lag(c).over(order).alias(f"p_{c}") for c in ("posture", "sp500_uptrend", "curve", "vix", "ratio")}
    rows = snapshots.select("*", *before.values(), F.row_number().over(order).alias("nth"))
    changed = lambda c: F.col(f"p_{c}") != F.col(c)
    alerts = [F.when(F.col("nth") == 1, "first reading"), F.when(changed("posture"), F.concat(F.lit("posture "), "p_posture", F.lit(" -> "), "posture"))]
    alerts += [F.when(changed("sp500_uptrend"), F.when(F.col("sp500_uptrend"), "golden cross").otherwise("death cross"))]
    for c, levels in (("curve", (0.0,)), ("vix", VIX_LEVELS), ("ratio", RATIO_LEVELS)):
        alerts += [F.concat(F.lit(f"{c} "), crossed(F.col(f"p_{c}"), F.col(c), level), F.lit(f" {level:.0f}")) for level in levels]
    return rows.select(key, day, F.explode(F.array_compact(F.array(*alerts))).alias("alert"))


def floor_step(x: Column, digits: int = STEP) -> Column:
    """Round down to a step, in decimals."""
    return F.floor(x.cast(f"decimal(38,{digits + 6})"), digits)


def proposals(ind: DataFrame, equity: Column, risk: float = 0.01, multiple: float = 2.0, most: float = 0.10) -> DataFrame:
    """Entry, stop, quantity, value and risk, or the first reason to refuse, of rows with n_bars, last_close, atr14.

    suspended, has_pending: whether the instrument is suspended, and has a pending proposal already. The
    newest 60 bars are what indicators should be of.
    """
    entry, distance = F.col("last_close"), F.col("atr14") * multiple
    stop = F.bround(entry - distance, STEP)
    quantity = floor_step(F.least(F.bround(equity * risk, 4) / distance, equity * most / entry))
    reason = (
        F.when(F.col("suspended"), "suspended").when(F.col("n_bars") < 20, "not enough history").when(~(entry > 0), "no entry price")
        .when(F.col("atr14").isNull() | (F.col("atr14") <= 0), "no stop distance").when(stop <= 0, "stop at or below zero").when(equity <= 0, "no equity")
        .when(quantity <= 0, "sized to zero").when(F.col("has_pending"), "pending already")
    )
    known = lambda x: F.when(reason.isNull(), x)
    amount = F.bround(quantity.cast("double") * distance, 4)
    return ind.select(
        "instrument_id", entry.alias("entry"), stop.alias("stop"), known(quantity.cast("double")).alias("quantity"), known(F.bround(quantity.cast("double") * entry, 4)).alias("position_value"),
        known(amount).alias("risk_amount"), known(F.bround(amount / equity, 6)).alias("risk_share"), reason.alias("reason"),
    )


def smallest_cap(caps: dict[str, Column]) -> Column:
    """struct(value, order, name) of the smallest cap; the first of equal ones."""
    return F.array_min(F.array(*[F.struct(v.alias("value"), F.lit(i).alias("nth"), F.lit(k).alias("name")) for i, (k, v) in enumerate(caps.items())]))


def evaluate(rows: DataFrame, limits: dict[str, float]) -> DataFrame:
    """The risk decision of candidates: gates in order, then caps of which the smallest wins.

    rows: instrument_id, configured (a risk configuration is active; without one all is refused), halted,
    stale, open_positions, is_new, trades_today, n_bars, last_close, atr14, equity, equity_ceiling (what a
    live session was armed with, NULL: none), cash, held_value, open_risk, regime, monetary_cap (NULL: none),
    correlation, exposure. applied: the binding cap, the regime where it cuts, the correlation cut.
    """
    entry, equity = F.col("last_close"), F.least("equity", "equity_ceiling")
    distance = F.col("atr14") * limits["multiple"]
    gate = (
        F.when(~F.coalesce("configured", F.lit(False)), "no configuration").when(F.col("halted"), "halted").when(F.col("stale"), "stale")
        .when(F.col("is_new") & (F.col("open_positions") >= limits["positions"]), "position cap").when(F.col("trades_today") >= limits["trades"], "trade cap")
        .when(F.col("n_bars") < 20, "not enough history").when(~(entry > 0), "no entry price").when(F.col("atr14").isNull() | (F.col("atr14") <= 0), "no stop distance")
        .when(entry - distance <= 0, "stop at or below zero").when(equity <= 0, "no equity")
    )
    zero = F.lit(0.0)
    cap = smallest_cap({
        "risk_budget": equity * limits["risk"] * F.col("regime") / distance, "max_position_pct": equity * limits["position"] / entry,
        "max_instrument_pct": F.greatest(equity * limits["instrument"] - F.col("held_value"), zero) / entry, "available_cash": F.least(F.col("cash"), equity) / entry,
        "max_total_open_risk": F.greatest(equity * limits["open_risk"] - F.col("open_risk"), zero) / distance, "monetary_cap": F.coalesce(F.col("monetary_cap") / entry, F.lit(float("inf"))),
    })
    reduce = (F.col("correlation") > limits["correlation"]) & (F.col("exposure") > limits["exposure"])
    out = rows.withColumn("cap", cap).withColumn("reduced", F.coalesce(reduce, F.lit(False)))
    quantity = floor_step(F.col("cap.value") * F.when(F.col("reduced"), 0.5).otherwise(1.0))
    reason = F.coalesce(gate, F.when(quantity <= 0, "sized to zero"))
    known = lambda x: F.when(reason.isNull(), x)
    applied = F.array_compact(F.array(F.col("cap.name"), F.when(F.col("regime") < 1, F.concat(F.lit("market regime x"), F.col("regime").cast("string"))), F.when(F.col("reduced"), "correlation_reduction")))
    return out.select(
        "instrument_id", known(quantity.cast("double")).alias("quantity"), known(F.col("cap.name")).alias("binding"), known(applied).alias("applied"), "reduced",
        known(F.floor((quantity.cast("double") * distance).cast("decimal(38,10)"), 4).cast("double")).alias("risk_amount"), reason.alias("reason"),
    )


def mean_reversion(rows: DataFrame, oversold: float = 35.0, least_atr: float = 0.02, veto: float = 0.10, most_drop: float = 1.0) -> DataFrame:
    """BUY below the lower band when flat; SELL at the middle band or, first, on insider selling.

    rows: instrument_id, n_bars, last_close, boll_low, boll_mid, boll_high, rsi14, atr14, held, and
    insider_penalty and move_atr where there are any.
    """
    c, low, mid, high = (F.col(x) for x in ("last_close", "boll_low", "boll_mid", "boll_high"))
    ready = mid.isNotNull() & F.col("rsi14").isNotNull() & F.col("atr14").isNotNull() & (c > 0)
    leave = (F.col("held") > 0) & (F.col("insider_penalty") >= veto) & (F.col("move_atr").isNull() | (F.col("move_atr") > -most_drop))
    enter = (F.col("held") <= 0) & (c <= low) & (F.col("rsi14") <= oversold) & (F.col("atr14") / c >= least_atr)
    kind = F.when(~ready, None).when(leave, "insider_exit").when(enter, "entry").when((F.col("held") > 0) & (c >= mid), "mean_exit")
    out = rows.withColumn("kind", kind).where("kind IS NOT NULL")
    conviction = F.when(F.col("kind") == "entry", F.least(F.lit(1.0), 0.5 + F.when(high > low, (low - c) / (high - low)).otherwise(0.0))).otherwise(1.0)
    side = F.when(F.col("kind") == "entry", "BUY").otherwise("SELL")
    return out.select("instrument_id", "kind", side.alias("side"), conviction.alias("conviction"), F.when(side == "SELL", F.col("held")).alias("target_quantity"))


#: Strategies by name: functions of a context DataFrame.
STRATEGIES: dict[str, Callable[[DataFrame], DataFrame]] = {"mean_reversion": mean_reversion}


def decide(signals: DataFrame) -> DataFrame:
    """Outcome of a signal by its gates: stale, halted, held, auto."""
    sell = F.col("side") == "SELL"
    outcome = F.when(F.col("stale"), "rejected").when(F.col("halted") & ~sell, "rejected").when(sell & (F.col("held") <= 0), "skipped").when(F.col("auto"), "executed").otherwise("proposed")
    quantity = F.when(sell & (outcome == "executed"), F.least("held", "target_quantity"))
    return signals.withColumn("outcome", outcome).withColumn("quantity", quantity)


def open_risk(intents: DataFrame, exclude_closed: bool = False) -> DataFrame:
    """Sum of (fill - stop) x quantity over live intents of each account, where it is positive."""
    live = intents.where(F.col("status").isin("SUBMITTED", "RECONCILED") & F.col("stop_price").isNotNull() & F.col("fill_price").isNotNull())
    if exclude_closed:
        live = live.where("closed_at IS NULL")
    return live.groupBy("account").agg(F.sum(F.greatest(F.col("fill_price") - F.col("stop_price"), F.lit(0.0)) * F.col("quantity")).alias("open_risk"))


def realised(intents: DataFrame) -> DataFrame:
    """Profit realised an account and day; rows without a leg are left out."""
    done = intents.where("closed_at IS NOT NULL AND exit_price IS NOT NULL AND fill_price IS NOT NULL")
    return done.groupBy("account", F.to_date("closed_at").alias("day")).agg(F.sum((F.col("exit_price") - F.col("fill_price")) * F.col("quantity")).alias("realised"))


def mark_to_market(positions: DataFrame, latest: DataFrame) -> DataFrame:
    """Unrealised profit of open positions, NULL where there is no price."""
    out = positions.where("quantity <> 0").join(latest.select("instrument_id", F.col("close").alias("price")), "instrument_id", "left")
    return out.withColumn("unrealised", (F.col("price") - F.col("average_price")) * F.col("quantity"))


def account_totals(positions: DataFrame, cash: Column, start: Column) -> DataFrame:
    worth = F.sum(F.col("quantity") * F.coalesce("price", "average_price"))
    out = positions.groupBy("account").agg(worth.alias("invested"))
    return out.withColumn("total", cash + F.col("invested")).withColumn("result", F.col("total") - start)


def ratchet(candles: DataFrame, multiple: float = 2.0) -> DataFrame:
    """The trailing stop of every bar: close - ATR x multiple from 20 bars on, never lower than before."""
    asc = Window.partitionBy("instrument_id").orderBy("ts")
    prev = F.lag("close").over(asc)
    tr = F.when(prev.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)))
    rows = candles.withColumn("tr", tr).withColumn("idx", F.row_number().over(asc))
    atr = F.avg("tr").over(asc.rowsBetween(-13, 0))
    rows = rows.withColumn("candidate", F.when(F.col("idx") >= 20, F.col("close") - atr * multiple)).withColumn("candidate", F.when(F.col("candidate") > 0, F.col("candidate")))
    return rows.select("instrument_id", "ts", F.max("candidate").over(asc.rowsBetween(Window.unboundedPreceding, 0)).alias("stop"))


def stop_triggers(stops: DataFrame, latest: DataFrame) -> DataFrame:
    """Sell stops against the newest bar: filled at the stop price, cancelled without a position, else open."""
    out = stops.join(latest.select("instrument_id", "low"), "instrument_id", "left")
    state = F.when(F.col("position") <= 0, "cancelled").when(F.col("low") <= F.col("stop_price"), "filled").otherwise("open")
    return out.select("intent_id", state.alias("state"), F.when(state == "filled", F.col("stop_price")).alias("price"), F.when(state == "filled", F.least("quantity", "position")).alias("filled"))


def time_stops(intents: DataFrame, as_of: str, most_days: int) -> DataFrame:
    """Open intents held for so many whole days; 0 switches it off."""
    days = F.floor((F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("created_at")) / 86400)
    return intents.where("status = 'RECONCILED' AND closed_at IS NULL").withColumn("days", days).where((F.col("days") >= most_days) & (F.lit(most_days) > 0))


def fold_positions(fills: DataFrame, start_cash: float) -> DataFrame:
    """Positions and cash of each account after its fills in order: average cost, no short, no debt.

    The running cash ties an account's instruments together, so accounts are dealt to tasks, sorted, and
    folded row by row; a task holds one account's positions at a time, not its fills.
    """
    import pandas as pd

    names = ["account", "instrument_id", "quantity", "average_price", "cash", "rejected"]

    def fold(frames):
        account, cash, held, cost, rejected = None, start_cash, {}, {}, 0
        for frame in frames:
            done = []
            for who, i, side, n, p in frame[["account", "instrument_id", "side", "quantity", "price"]].itertuples(index=False):
                if who != account:
                    done += [(account, k, held[k], cost[k], cash, rejected) for k in sorted(held)]
                    account, cash, held, cost, rejected = who, start_cash, {}, {}, 0
                have = held.get(i, 0.0)
                if side == "BUY" and n * p <= cash:
                    cash -= n * p
                    cost[i] = (have * cost.get(i, 0.0) + n * p) / (have + n)
                    held[i] = have + n
                elif side == "SELL" and 0 < n <= have:
                    cash += n * p
                    held[i] = have - n
                else:
                    rejected += 1
            yield pd.DataFrame(done, columns=names)
        yield pd.DataFrame([(account, k, held[k], cost[k], cash, rejected) for k in sorted(held)], columns=names)

    ordered = fills.repartition("account").sortWithinPartitions("account", "ts", "fill_id")
    return ordered.mapInPandas(fold, "account long, instrument_id long, quantity double, average_price double, cash double, rejected long")


def newest_result(results: DataFrame, order: str = "created_at") -> DataFrame:
    return newest_first(results, 1, order=order).drop("rn")


def equities_to_gdp(series: DataFrame, scale: float = 1000.0) -> DataFrame:
    """country, equities, gdp and ratio: the newest known value of each series, equities scaled to gdp's unit, in percent of it.

    series: country, series (equities or gdp), value (NULL: not published), ts, event_id. NULL where either is missing or gdp is 0.
    """
    newest = lambda s: F.max_by("value", F.when((F.col("series") == s) & F.col("value").isNotNull(), F.struct("ts", "event_id"))).alias(s)
    out = series.groupBy("country").agg(newest("equities"), newest("gdp"))
    return out.withColumn("ratio", F.when(F.col("gdp") != 0, F.col("equities") / scale / F.col("gdp") * 100))
