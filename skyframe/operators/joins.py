"""Joins with dimensions, and how rows are dealt out to tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dimension(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """The right side of a join with a dimension: broadcast if a count finds at most `most_rows` rows in it, else merge-joined."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df.hint("merge")


def dealt(df: DataFrame, rows: int, *keys: str, per_task: int = 250_000) -> DataFrame:
    """df dealt out by keys to a number of tasks that grows with its number of rows, so that what a task sorts or groups does not.

    Spark's own number of partitions is fixed, and it merges those under 64 MB as compressed. Small tables are left to it.
    """
    n = -(-rows // per_task)
    return df.repartition(n, *keys) if n > 4 else df
