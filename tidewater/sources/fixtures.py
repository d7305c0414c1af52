"""Market tables derived from the star-schema test tables, for queries and tests.

Every table has its twin in ``CTE``: the same rule as SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import parts_of

#: The day on which all market queries look at the data: after the last bar.
AS_OF = "2001-11-05"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars: one instrument a supplier, prices from line items by ship date.

    First and last are by order, line and part, packed in one number (part below 10^15, line below 1000): buffers of
    fixed width are combined by hash, a struct's would be sorted on both sides of the shuffle.
    """
    at = lambda c, power: F.col(c).cast("decimal(19,0)") * F.lit(10**power).cast("decimal(19,0)")
    order = (at("l_orderkey", 18) + at("l_linenumber", 15) + F.col("l_partkey")).cast("decimal(38,0)")
    lines = read(spark, sf_dir, "lineitem").withColumn("p", F.col("l_extendedprice") / F.col("l_quantity"))
    return lines.groupBy(F.col("l_suppkey").alias("instrument_id"), F.col("l_shipdate").alias("ts")).agg(
        F.min_by("p", order).alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", order).alias("close"), F.sum("l_quantity").alias("volume")
    )


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (read(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    k = F.col("s_suppkey")
    return (
        s.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"])
        .join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"])
        .select(
            k.alias("instrument_id"), F.col("s_name").alias("ticker"), F.col("n_name").alias("venue"), F.col("r_name").alias("country_group"), (F.col("n_nationkey") % 11).alias("sector"),
            (k % 17 == 0).alias("suspended"), (k % 4 == 0).alias("bot_universe"), (k % 3 != 0).alias("scanner_eligible"), (k % 5 != 0).alias("tradable"),
            F.when(k % 6 == 0, None).otherwise(F.date_sub(F.lit("2001-11-01").cast("date"), (k % 30).cast("int"))).alias("last_scanned_on"),
        )
    )


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots an instrument; fixed residues are NULL."""
    k = F.col("s_suppkey")
    days = F.explode(F.array(F.lit("2001-06-01").cast("date"), F.lit("2001-10-01").cast("date")))
    late = (F.month("as_of") == 10).cast("int")
    return (
        read(spark, sf_dir, "supplier")
        .select(k, "s_acctbal", days.alias("as_of"))
        .select(
            k.alias("instrument_id"), "as_of",
            F.when(k % 7 != 0, 5.0 + k % 40 + late).alias("trailing_pe"), F.when(k % 9 != 0, 0.5 + (k % 9) * 0.5).alias("price_to_book"),
            ((k % 25) / 100.0).alias("profit_margin"), F.when(k % 11 != 0, ((k % 31) - 10) / 100.0).alias("revenue_growth"), (((k % 29) - 8) / 100.0).alias("earnings_growth"),
            F.when(k % 13 != 0, (k % 150).cast("double")).alias("debt_to_equity"), ((k % 6) / 100.0).alias("dividend_yield"), (F.col("s_acctbal") * 1e6).alias("market_cap"),
        )
    )


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insider lines: an order is a filing, its lines are transactions. Both meet in partitions of counted lines."""
    li, o = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    n = parts_of(li.count(), li)
    li, o = li.repartition(n, "l_orderkey"), o.repartition(n, "o_orderkey")
    code = F.when(F.col("l_returnflag") == "A", "P").when(F.col("l_returnflag") == "R", "S").otherwise("M")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(
        F.col("l_orderkey").alias("accession"), F.col("l_linenumber").alias("line_index"), F.col("l_suppkey").alias("instrument_id"), code.alias("code"), F.col("l_shipdate").alias("ts"),
        F.col("l_extendedprice").alias("value"), (F.col("o_orderpriority") == "1-URGENT").alias("is_c_suite"), (F.col("o_orderpriority") == "2-HIGH").alias("is_officer"),
        (F.col("o_orderpriority") == "3-MEDIUM").alias("is_director"), (F.col("l_linenumber") % 5 == 0).alias("is_plan"),
    )


def intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade intents: an order is an intent of its customer's account."""
    k = F.col("o_orderkey")
    status = F.when(k % 7 == 0, "FAILED").when(k % 7 < 3, "SUBMITTED").otherwise("RECONCILED")
    price = F.col("o_totalprice") / 1000
    return read(spark, sf_dir, "orders").select(
        k.alias("intent_id"), F.col("o_custkey").alias("account"), (k % 97).alias("instrument_id"), status.alias("status"), F.col("o_orderdate").alias("created_at"),
        (1 + k % 20).cast("double").alias("quantity"), F.when(k % 11 != 0, price).alias("fill_price"), F.when(k % 5 != 0, price * 0.9).alias("stop_price"),
        F.when(k % 3 == 0, price * (0.8 + (k % 9) * 0.05)).alias("exit_price"), F.when(k % 3 == 0, F.col("o_orderdate") + F.expr("INTERVAL 20 DAYS")).alias("closed_at"),
    )


CTE = {
    "candles": """candles AS (
        SELECT l_suppkey AS instrument_id, l_shipdate AS ts, arg_min(p, k) AS open, max(p) AS high, min(p) AS low, arg_max(p, k) AS close, sum(l_quantity) AS volume
        FROM (SELECT *, l_extendedprice / l_quantity AS p, row(l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_discount, l_tax) AS k FROM lineitem)
        GROUP BY l_suppkey, l_shipdate)""",
    "instruments": """instruments AS (
        SELECT s_suppkey AS instrument_id, s_name AS ticker, n_name AS venue, r_name AS country_group, n_nationkey % 11 AS sector,
               s_suppkey % 17 = 0 AS suspended, s_suppkey % 4 = 0 AS bot_universe, s_suppkey % 3 <> 0 AS scanner_eligible, s_suppkey % 5 <> 0 AS tradable,
               CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE DATE '2001-11-01' - CAST(s_suppkey % 30 AS INTEGER) END AS last_scanned_on
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "fundamentals": """fundamentals AS (
        SELECT s_suppkey AS instrument_id, as_of,
               CASE WHEN s_suppkey % 7 <> 0 THEN 5.0::DOUBLE + s_suppkey % 40 + (CASE WHEN month(as_of) = 10 THEN 1 ELSE 0 END) END AS trailing_pe,
               CASE WHEN s_suppkey % 9 <> 0 THEN 0.5::DOUBLE + (s_suppkey % 9) * 0.5::DOUBLE END AS price_to_book, (s_suppkey % 25) / 100.0::DOUBLE AS profit_margin,
               CASE WHEN s_suppkey % 11 <> 0 THEN ((s_suppkey % 31) - 10) / 100.0::DOUBLE END AS revenue_growth, ((s_suppkey % 29) - 8) / 100.0::DOUBLE AS earnings_growth,
               CASE WHEN s_suppkey % 13 <> 0 THEN (s_suppkey % 150)::DOUBLE END AS debt_to_equity, (s_suppkey % 6) / 100.0::DOUBLE AS dividend_yield, s_acctbal * 1e6::DOUBLE AS market_cap
        FROM supplier CROSS JOIN (VALUES (DATE '2001-06-01'), (DATE '2001-10-01')) AS d(as_of))""",
    "filings": """filings AS (
        SELECT l_orderkey AS accession, l_linenumber AS line_index, l_suppkey AS instrument_id,
               CASE l_returnflag WHEN 'A' THEN 'P' WHEN 'R' THEN 'S' ELSE 'M' END AS code, l_shipdate AS ts, l_extendedprice AS value,
               o_orderpriority = '1-URGENT' AS is_c_suite, o_orderpriority = '2-HIGH' AS is_officer, o_orderpriority = '3-MEDIUM' AS is_director, l_linenumber % 5 = 0 AS is_plan
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "intents": """intents AS (
        SELECT o_orderkey AS intent_id, o_custkey AS account, o_orderkey % 97 AS instrument_id,
               CASE WHEN o_orderkey % 7 = 0 THEN 'FAILED' WHEN o_orderkey % 7 < 3 THEN 'SUBMITTED' ELSE 'RECONCILED' END AS status, o_orderdate AS created_at,
               (1 + o_orderkey % 20)::DOUBLE AS quantity, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice / 1000 END AS fill_price,
               CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice / 1000 * 0.9::DOUBLE END AS stop_price,
               CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice / 1000 * (0.8::DOUBLE + (o_orderkey % 9) * 0.05::DOUBLE) END AS exit_price,
               CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 20 DAY END AS closed_at
        FROM orders)""",
}


def with_tables(*names: str) -> str:
    return "WITH " + ",\n".join(CTE[n] for n in names)
