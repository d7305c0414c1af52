"""Working folders that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; a local master without one gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="spark-market-"))
    return f"{base.rstrip('/')}/market/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read again, for results that are small beside what they are made from and used often."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that a task sorts or groups at a time.
TASK_ROWS = 250_000


def parts_of(rows: int, df: DataFrame) -> int:
    """Partitions for a shuffle of ``rows`` rows, so that what a task holds does not grow with them: one a core at least."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
