"""How the rows of a read table lie over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of files that are worth a task of their own, and that one task reads at most by Spark's default.
LEAST_BYTES, MOST_BYTES = 1 << 20, 128 << 20


def spread(table: DataFrame) -> DataFrame:
    """The rows of a table as read, dealt over all cores where its files would leave cores idle.

    Spark splits files between row groups only, so a table in a few small files is a few tasks however many cores there are. Where the files are
    fewer than the cores and hold less than a full split for each, the rows move once; tables of any other size are returned as they are, without a
    shuffle. Filters and column choices still reach the scan. Rows are the same; their order isn't kept."""
    spark = table.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    tasks = min(cores, size // LEAST_BYTES)
    if size >= cores * MOST_BYTES or tasks < 2 or len(table.inputFiles()) >= tasks:
        return table
    return table.repartition(tasks)
