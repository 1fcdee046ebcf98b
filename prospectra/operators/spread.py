"""Few bytes that become much work, dealt out to all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def partitions(rows: DataFrame, each: int = 4) -> int:
    """So many partitions for each core of the executors."""
    return each * rows.sparkSession.sparkContext.defaultParallelism


def spread(rows: DataFrame) -> DataFrame:
    """The rows in four partitions for each core.

    A row group of a file is read by one task.  Where narrow rows are made wide
    or costly, one group can hold a million of them, so they are dealt out first.
    """
    return rows.repartition(partitions(rows))
