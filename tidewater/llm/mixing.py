"""Mixing sources to target weights with hash-threshold histograms.

Every document has a fixed hash. A source's target is a number of whole copies of all its documents
plus a budget of words; the budget goes to the documents whose hash is below a threshold. To find it,
words are summed by source and hash bucket, the nested cumulative sums give the bucket in which the
budget runs out, and only that bucket is refined by the next bits. Documents are then filtered
against their source's threshold: nothing is sorted, and a hot source costs a bounded histogram.
Everything is DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, lookup, table

#: Bits of the hash that one histogram level looks at, and how many levels there are.
LEVEL_BITS, LEVELS = 10, 5


def row_hash(*columns: Column) -> Column:
    """50 bits of the MD5 of the columns as text; a null is told from an empty text."""
    line = F.concat(*[F.concat(F.coalesce(c.cast("string"), F.lit("\x00")), F.lit("\x01")) for c in columns])
    return F.shiftright(F.conv(F.substring(F.md5(line), 1, 13), 16, 10).cast("long"), 52 - LEVEL_BITS * LEVELS)


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """(source, source_size) -> with weight and target.

    Sources in code point order, null last, get the weights in turn. All words are shared by weight;
    a target stops at ``cap`` times its source's size and the excess is reshared by weight until none
    is above: the water level L with sum(min(cap * size, L * weight)) = all words. Only four sums of
    each round reach the driver. Sources are ranked within ranges of them, which Spark's sampled
    splitters cut, and a range starts where the ones before it end; no task ranks all.
    """
    order = F.col("source").asc_nulls_last()
    dealt = table(sizes.repartitionByRange(order).withColumn("part", F.spark_partition_id()))
    parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(parts), F.lit(0)).alias("before"))
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1)
    ranked = ranked.join(F.broadcast(before), "part").withColumn("rank", F.col("rank") + F.col("before"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = table(ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(cap))).alias("most")))
    level, stopped = None, 0
    while True:
        is_free = F.lit(True) if level is None else F.col("most") >= F.lit(level) * F.col("weight")
        row = ranked.agg(
            F.sum("source_size").alias("all"),
            F.coalesce(F.sum(F.when(~is_free, F.col("most"))), F.lit(0.0)).alias("fixed"),
            F.coalesce(F.sum(F.when(is_free, F.col("weight"))), F.lit(0.0)).alias("free"),
            F.count_if(~is_free).alias("n"),
        ).first()
        if level is not None and (row["n"] == stopped or not row["free"]):
            break
        level, stopped = ((row["all"] or 0) - row["fixed"]) / row["free"] if row["free"] else 0.0, row["n"]
    return ranked.select("source", "source_size", "weight", F.least("most", F.lit(float(level)) * F.col("weight")).alias("target"))


def mix_to_weights(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (1, 2, 3),
    cap: float = 3.0,
    hash_of: Column | None = None,
) -> DataFrame:
    """One row for each row of ``docs``: id_col, source, size, source_size, target, copies, taken.

    size: words of the text, 0 for null or empty. copies: how often the mix takes the document, at most
    ``cap`` rounded up and never above ``cap`` where it is whole; taken: copies times size. A source's
    taken words differ from its target by less than its largest document, or the rows that share one
    hash. Reruns agree, since the hash depends on identifier and text alone, or on ``hash_of`` (50 bits
    of a long) if that is given; rows that repeat both are taken alike, rows that share or lack an
    identifier are not. A null source is a source of its own, the last. No words at all: targets 0. An
    empty table gives no rows.
    """
    slim = table(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            word_count(F.col(text_col)).alias("size"),
            (row_hash(F.col(id_col), F.col(text_col)) if hash_of is None else hash_of).alias("h"),
        )
    )
    targets = source_targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    targets = table(
        targets.withColumn("copies", whole.cast("long")).withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size"))
    )
    few = targets.count()
    bounds = targets.where("budget > 0").select(F.col("source").alias("b_source"), "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("held"))
    for level in range(LEVELS):
        rest = LEVEL_BITS * (LEVELS - 1 - level)
        inside = F.col("source").eqNullSafe(F.col("b_source")) & (F.shiftrightunsigned("h", rest + LEVEL_BITS) == F.col("prefix"))
        cells = (
            slim.join(lookup(bounds, few), inside)
            .groupBy("b_source", "budget", "below", F.shiftrightunsigned("h", rest).alias("cell"))
            .agg(F.sum("size").alias("held"))
        )
        upto = F.col("below") + F.sum("held").over(Window.partitionBy("b_source").orderBy("cell"))
        bounds = table(
            cells.withColumn("upto", upto)
            .where(F.col("upto") > F.col("budget"))
            .groupBy("b_source", "budget")
            .agg(F.min(F.struct("cell", (F.col("upto") - F.col("held")).alias("below"), "held")).alias("first"))
            .select("b_source", "budget", F.col("first.cell").alias("prefix"), "first.below", "first.held")
        )
    nearer = (F.col("budget") - F.col("below")) * 2 > F.col("held")
    plan = targets.join(
        lookup(bounds.select("b_source", (F.col("prefix") + nearer.cast("long")).alias("threshold")), few),
        F.col("source").eqNullSafe(F.col("b_source")),
        "left",
    ).select(F.col("source").alias("p_source"), "source_size", "target", F.col("copies").alias("base"), F.coalesce("threshold", F.lit(0)).alias("threshold"))
    copies = F.col("base") + (F.col("h") < F.col("threshold")).cast("long")
    return (
        slim.join(lookup(plan, few), F.col("source").eqNullSafe(F.col("p_source")))
        .select(F.col("id").alias(id_col), "source", "size", "source_size", "target", copies.alias("copies"))
        .withColumn("taken", F.col("copies") * F.col("size"))
    )
