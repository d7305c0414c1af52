"""Exact deduplication with a log-structured merge index of text digests.

Rows are dealt to memtables. A memtable is combined in the scan's tasks and flushed as one sorted run:
(digest, kept identifier, rows), a Parquet table bucketed by the digest and sorted in its buckets. Runs
live on levels; as soon as a level holds two, compaction merges them to a run of the next level: bucket
meets bucket, so both are read in order and nothing is shuffled, and the kept identifier of a digest is
the smallest (or largest) of both. The last run's digests of more than one row are the index's hits; a
blocked Bloom filter of them is asked before a row's bytes go anywhere, and the rows that pass are
verified: they are grouped by digest *and* text, so texts whose digests clash come apart, and what the
filter let through in vain is a group of one.

Only ids and digests are shuffled for the whole table. Texts move only for hits, combined in each task,
so that a text that a third of all rows share costs one row a task; beyond 67 million repeated digests,
where the filter is too large to broadcast, all texts move once to be asked for. Everything is DataFrame
operations.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lookup, shared_dir, table

#: Memtables of a build.
MEMTABLES = 4
#: Digests that one 64-bit word of the filter holds on average, and the bits that each sets in it.
WORD_DIGESTS, WORD_BITS = 8, 3
#: Words of the filter that one row holds when it is broadcast, and bytes up to which it is (67 million repeated digests).
PACK, MOST_BYTES = 1024, 1 << 26


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


class MergeIndex:
    """Sorted runs of (digest, keep_id, group_size) on levels, merged two by two."""

    def __init__(self, spark, keep: str = "min"):
        self.spark, self.keep = spark, keep
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[DataFrame | None] = []
        self.names: list[str] = []

    def _sorted_run(self, rows: DataFrame) -> DataFrame:
        """Write rows that are dealt by digest as a table of sorted buckets."""
        name = f"tidewater_run_{uuid.uuid4().hex}"
        path = f"{shared_dir(self.spark)}/tidewater/{name}"
        rows.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(name)
        self.names.append(name)
        return self.spark.read.table(name)

    def flush(self, memtable: DataFrame) -> None:
        """Add (id, digest) rows as a run of level 0, and compact the levels that are full."""
        kept = F.min("id") if self.keep == "min" else F.max("id")
        run = self._sorted_run(memtable.groupBy("digest").agg(kept.alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
        for level, held in enumerate(self.levels):
            if held is None:
                self.levels[level] = run
                return
            run, self.levels[level] = self.compact(held, run), None
        self.levels.append(run)

    def compact(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """Merge two runs to one, bucket by bucket."""
        best = F.least if self.keep == "min" else F.greatest
        right = right.select("digest", F.col("keep_id").alias("r_id"), F.col("group_size").alias("r_size"))
        both = left.join(right.hint("merge"), "digest", "full")
        size = F.coalesce("group_size", F.lit(0).cast("long")) + F.coalesce("r_size", F.lit(0).cast("long"))
        return self._sorted_run(both.select("digest", best("keep_id", "r_id").alias("keep_id"), size.alias("group_size")))

    def merged(self) -> DataFrame:
        """All levels as one run."""
        runs = [r for r in self.levels if r is not None]
        while len(runs) > 1:
            runs = [self.compact(runs[0], runs[1]), *runs[2:]]
        self.levels = runs
        return runs[0]

    def drop(self) -> None:
        """Forget the runs' names; their files go with the shared folder."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _word(digest: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(words))


def _mask(digest: Column) -> Column:
    """The bits of a digest in its word of the filter."""
    bits = F.xxhash64(digest, F.lit("bits"))
    mask = F.lit(0).cast("long")
    for k in range(WORD_BITS):
        place = F.pmod(F.shiftrightunsigned(bits, 6 * k), F.lit(64)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return mask


def bloom_filter(digests: DataFrame, words: int) -> DataFrame:
    """(word, bits): a blocked Bloom filter, each digest setting its bits in one 64-bit word."""
    return table(digests.groupBy(_word(F.col("digest"), words).alias("word")).agg(F.bit_or(_mask(F.col("digest"))).alias("bits")))


def may_hold(rows: DataFrame, filter_words: DataFrame, words: int, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The rows whose digest the filter may hold: all that it holds and few others.

    A filter of ``most_bytes`` or less is broadcast, packed, and no row moves. A larger one is joined by word,
    which moves all rows once.
    """
    mask = _mask(F.col("digest"))
    asked = rows.withColumn("word", _word(F.col("digest"), words))
    if words * 8 > most_bytes:
        asked = asked.join(filter_words, "word")
    else:
        place = (F.col("word") % PACK).cast("int")
        entries = F.map_from_entries(F.collect_list(F.struct(place, "bits")))  # PACK entries at most
        bits = F.transform(F.sequence(F.lit(0), F.lit(PACK - 1)), lambda k: F.coalesce(F.try_element_at(F.col("held"), k), F.lit(0).cast("long")))
        packed = table(filter_words.groupBy(F.floor(F.col("word") / PACK).alias("pack")).agg(entries.alias("held")).select("pack", bits.alias("packed")))
        asked = asked.withColumn("pack", F.floor(F.col("word") / PACK)).join(F.broadcast(packed), "pack").withColumn("bits", F.get("packed", (F.col("word") % PACK).cast("int"))).drop("pack", "packed")
    return asked.where(F.col("bits").bitwiseAND(mask) == mask).drop("word", "bits")


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "min",
    digest: Callable[[Column], Column] = sha256_digest,
    memtables: int = MEMTABLES,
) -> DataFrame:
    """One row for each row of ``docs``: id_col, keep_id, group_size, kept, digest.

    A null text counts as empty; empty texts equal each other. Texts are compared unchanged, whole and
    in bytes. keep: "min" or "max" identifier of a group stays. Repeated rows (same id and text) count
    each, and are kept alike. A null id never wins over another id; a group of null ids alone has a
    null keep_id and is kept. An empty table gives no rows. Other columns of ``docs`` are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), text.alias("body"), digest(text).alias("digest"))
    slim = table(keyed.select("id", "digest", F.pmod(F.xxhash64("id"), F.lit(memtables)).alias("memtable")), by="memtable")
    index = MergeIndex(docs.sparkSession, keep)
    try:
        for k in range(memtables):
            index.flush(slim.where(F.col("memtable") == k).select("id", "digest"))
        groups = table(index.merged().where("group_size > 1"))
    finally:
        index.drop()
    few = groups.count()
    words = max(1, few // WORD_DIGESTS)
    hits = may_hold(keyed, bloom_filter(groups, words), words)
    kept = F.min("id") if keep == "min" else F.max("id")
    variants = hits.groupBy("digest", "body").agg(kept.alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    verified = table(
        variants.groupBy("digest").agg(
            F.count(F.lit(1)).alias("variants"),
            F.max("keep_id").alias("keep_id"),
            F.max("group_size").alias("group_size"),
        )
    )
    same = table(verified.where("variants = 1 AND group_size > 1").select("digest", "keep_id", "group_size"))
    out = slim.select("id", "digest").join(lookup(same, few), "digest", "left")
    clashes = verified.where("variants > 1").select("digest")
    if not clashes.isEmpty():
        apart = hits.join(clashes, "digest").join(variants.join(clashes, "digest"), ["digest", "body"])
        out = out.join(clashes, "digest", "left_anti").unionByName(apart.select("digest", "id", "keep_id", "group_size"))
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.when(F.col("group_size").isNull(), F.lit(True)).otherwise(F.col("id").eqNullSafe(F.col("keep_id"))), F.lit(True)).alias("kept"),
        "digest",
    )
