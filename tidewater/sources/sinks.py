"""Sinks: snapshots by natural key, results by run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_snapshot(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace exactly the partitions that ``df`` has rows for; writing the same day twice changes nothing.

    Rows of a partition come together, and a large partition is split over tasks and files.
    """
    df.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_results(df: DataFrame, path: str, run_id: int) -> None:
    """Append a run's results; JSON columns stay maps and arrays."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


def write_quality_events(rejected: DataFrame, path: str) -> None:
    """Append rejected rows with why; the accepted ones are written elsewhere."""
    rejected.write.mode("append").partitionBy("kind").parquet(path)
