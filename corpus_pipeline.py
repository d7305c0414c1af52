"""From raw documents to packed training sequences, one operator a stage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; each is written as Parquet and read
again as the next one's docs. All but the last return the columns of ``documents``, whatever others there
are, and decide row by row: rows are numbered, so null or repeated identifiers neither hide a row nor take
others along. A null text counts as empty. No rows in give no rows out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import exact_dedup, mixing, packing, quality, queries, simhash_wide
from tidewater.llm.common import lookup, table

#: Documents that score below this are rejected.
LEAST_QUALITY = 0.7


def _free(docs: DataFrame, name: str) -> str:
    """``name``, with underscores until no column is called so."""
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    return name


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number for each row, written so that every later read sees the same numbers; its column."""
    row = _free(docs, "_row")
    return table(docs.withColumn(row, F.monotonically_increasing_id())), row


def _without(docs: DataFrame, row: str, rows: DataFrame) -> DataFrame:
    """The numbered ``docs`` whose number is not in ``rows``, without numbers."""
    rows = table(rows.select(row))
    return docs.join(lookup(rows, rows.count()), row, "left_anti").drop(row)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the rows that the quality classifier rejects; empty texts have one score, and repeated rows have theirs alike."""
    model = queries.quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    docs, row = _numbered(docs)
    scores = quality.score_quality(docs, model, id_col=row)
    return _without(docs, row, scores.where(F.col("score") < LEAST_QUALITY))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row with the largest identifier stays, one without if none has any; so one of repeated rows."""
    docs, row = _numbered(docs)
    keyed = docs.select(F.struct("doc_id", row).alias("_key"), "text")
    return _without(docs, row, exact_dedup.exact_duplicates(keyed, id_col="_key", keep="max").where("not kept").select(f"_key.{row}"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row with the smallest identifier stays, one without if none has any.

    Texts link whose sets of five-word shingles share 0.8 of all their shingles or more; texts without words
    are one group.
    """
    docs, row = _numbered(docs)
    found = table(simhash_wide.near_components(docs, row, shingle=5, similarity=0.8))
    groups = table(found.groupBy("component_id").count().where("count > 1").select("component_id"))
    inside = table(found.join(lookup(groups, groups.count()), "component_id").join(docs.select(row, "doc_id"), row))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row))
    kept = table(inside.groupBy("component_id").agg(first.alias("first")).select(f"first.{row}"))
    return _without(docs, row, inside.join(lookup(kept, kept.count()), row, "left_anti"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take every row as often as the mix does: not at all, once, or repeatedly, three times at most.

    A null source is one of its own. Rows that repeat identifier and text are taken alike.
    """
    columns = docs.columns
    docs, row = _numbered(docs)
    copies = _free(docs, "_copies")
    plan = mixing.mix_to_weights(docs, id_col=row, hash_of=mixing.row_hash(F.col("doc_id"), F.col("text")))
    plan = table(plan.where("copies <> 1").select(row, F.col("copies").cast("int").alias(copies)))
    out = docs.join(lookup(plan, plan.count()), row, "left").withColumn(copies, F.coalesce(copies, F.lit(1))).where(F.col(copies) > 0)
    return out.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*columns)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 4096 tokens, a row for each piece; an empty text is its end token alone."""
    import public_tokenizers

    return packing.pack_best_fit(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("simhash near-dedup", near_stage),
    ("mixing sources", mix_stage),
    ("best-fit packing", pack_stage),
]

#: SQL cannot express the classifier, the fingerprints or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = table(docs)
    return docs
