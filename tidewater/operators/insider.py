"""Insider filings: weights, scores, and how much of them the price has already taken in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bars import newest_first
from .indicators import indicators
from .scoring import saturate

#: Days a filing counts, dollars of a full filing, role weights, caps.
LOOKBACK_DAYS, FULL_USD, PLAN_DAMPING, NEUTRAL, MOST_BUY, MOST_SELL = 45, 1_000_000.0, 0.0, 50.0, 50.0, 0.40
ROLE_WEIGHTS = {"is_c_suite": 1.0, "is_officer": 0.7, "is_director": 0.5}


def recent(filings: DataFrame, as_of: str) -> DataFrame:
    """Purchases and sales of the last LOOKBACK_DAYS days."""
    age = F.datediff(F.lit(as_of).cast("date"), F.col("ts"))
    return filings.withColumn("age", age).where((F.col("age") >= 0) & (F.col("age") <= LOOKBACK_DAYS) & F.col("code").isin("P", "S"))


def filing_weight() -> Column:
    role = F
    for name, w in ROLE_WEIGHTS.items():
        role = role.when(F.col(name), w)
    weight = role.otherwise(0.0) * F.least(F.lit(1.0), F.coalesce("value", F.lit(0.0)) / FULL_USD) * F.greatest(F.lit(0.0), 1 - F.col("age") / LOOKBACK_DAYS)
    return weight * F.when(F.col("is_plan") & (F.col("code") == "S"), PLAN_DAMPING).otherwise(1.0)


def weighted(filings: DataFrame, as_of: str) -> DataFrame:
    return recent(filings, as_of).withColumn("weight", filing_weight())


def moves(filings: DataFrame, candles: DataFrame, as_of: str) -> DataFrame:
    """Move in average true ranges since the first bar on or after the earliest filing, and its damping."""
    since = recent(filings, as_of).groupBy("instrument_id").agg(F.min(F.to_date("ts")).alias("since"))
    known = candles.where(F.col("ts") <= F.lit(as_of).cast("timestamp"))
    window = newest_first(known, 120).join(since, "instrument_id").where(F.to_date("ts") >= F.col("since"))
    first = window.groupBy("instrument_id").agg(F.min_by("close", "ts").alias("at_filing"))
    ind = indicators(known, 120, ["n_bars", "last_close", "atr14"])
    move = F.when((F.col("n_bars") >= 20) & (F.col("at_filing") > 0) & (F.col("atr14") > 0), (F.col("last_close") - F.col("at_filing")) / F.col("atr14"))
    out = since.join(ind, "instrument_id", "left").join(first, "instrument_id", "left").withColumn("move_atr", move)
    m = F.abs("move_atr")
    return out.select("instrument_id", "move_atr", F.when(m <= 1, 1.0).when(m >= 3, 0.0).when(m.isNotNull(), 1 - (m - 1) / 2).otherwise(1.0).alias("damping"))


def scores(filings: DataFrame, candles: DataFrame, as_of: str) -> DataFrame:
    """insider_score (NULL without purchases) and insider_penalty of instruments with filings that say something."""
    w = F.when((F.col("code") == "S") & ~F.col("is_c_suite"), 0.0).otherwise(F.col("weight"))
    counted = weighted(filings, as_of).withColumn("w", w)
    buys, sells = F.sum(F.when(F.col("code") == "P", F.col("w"))), F.sum(F.when(F.col("code") == "S", F.col("w")))
    value = lambda code: F.sum(F.when((F.col("code") == code) & (F.col("w") > 0), F.col("value")).otherwise(0.0))
    per = counted.groupBy("instrument_id").agg(
        F.coalesce(buys, F.lit(0.0)).alias("buy_points"), F.coalesce(sells, F.lit(0.0)).alias("sell_points"), value("P").alias("buy_value"), value("S").alias("sell_value"), F.count(F.lit(1)).alias("filings")
    )
    out = per.join(moves(filings, candles, as_of), "instrument_id", "left")
    damping = F.coalesce("damping", F.lit(1.0))
    score = F.when(F.col("buy_points") > 0, NEUTRAL + MOST_BUY * saturate(F.col("buy_points")) * damping)
    penalty = MOST_SELL * saturate(F.col("sell_points")) * damping
    return out.withColumn("insider_score", score).withColumn("insider_penalty", penalty).where("insider_score IS NOT NULL OR insider_penalty > 0")


def pressure(filings: DataFrame, candles: DataFrame, as_of: str) -> DataFrame:
    return scores(filings, candles, as_of).where("insider_penalty > 0").select("instrument_id", "insider_penalty", "move_atr")


def details(filings: DataFrame, as_of: str, n: int = 6) -> DataFrame:
    """The first ``n`` counted filings of each instrument."""
    counted = weighted(filings, as_of).where("weight > 0 AND (code = 'P' OR is_c_suite)")
    order = Window.partitionBy("instrument_id").orderBy("ts", "accession", "line_index", "value")
    return counted.withColumn("n", F.row_number().over(order)).where(F.col("n") <= n).select("instrument_id", "n", "accession", "code", "value")
