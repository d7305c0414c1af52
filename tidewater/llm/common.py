"""Small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed by the operator contracts: a word is a run of bytes that are none of these six.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Rows above which a lookup side is joined by shuffle instead of broadcast.
BROADCAST_ROWS = 200_000

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a temporary folder; a cluster gets an error, as a
    folder of one machine would be invisible to the others.
    """
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="spark-tidewater-")
    return _own_dirs[app]


def written(df: DataFrame, by: str | None = None) -> tuple[DataFrame, str]:
    """``table(df, by)`` and the folder that it is in, to be removed when a later table replaces it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewater/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def table(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, survives lost executors.

    by: an integer column of few values whose rows get a folder each, so that a filter on it reads only these.
    """
    return written(df, by)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Delete the folder of a table that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def lookup(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` to join with: broadcast if its counted ``rows`` are few, else left to a shuffle join."""
    return F.broadcast(df) if rows <= most else df


def id_crc(id_col: str) -> Column:
    """crc32 of the identifier's decimal text; 0 for a null identifier."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")), F.lit(0))


def text_batches(batches: Iterator, most: int = 1 << 21) -> Iterator:
    """Arrow batches cut so that each has at most about ``most`` text bytes (one row at least).

    The batches need a string column ``text``.
    """
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(), dtype=np.int64)
        first = 0
        while first < batch.num_rows:
            start = upto[first - 1] if first else 0
            stop = max(first + 1, int(np.searchsorted(upto, start + most, "right")))
            yield batch.slice(first, stop - first)
            first = stop


def sample_by_id(rows: DataFrame, id_col: str, most: int, count: int) -> DataFrame:
    """About ``most`` of ``count`` rows at most, those whose identifier has the smallest hash of 62 bits."""
    share = min(1.0, most / max(1, count))
    return rows if share == 1.0 else rows.where(F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit("sample")), 2) < int(share * (1 << 62)))
