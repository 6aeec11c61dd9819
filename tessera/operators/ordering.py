"""Numbering rows inside groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.sources.scratch import written


def numbered(rows: DataFrame, group: str, order: list[str | Column], to: str = "position") -> DataFrame:
    """rows with their place inside `group`, from 0, in the given order; rows of a null group are one group.

    A window over a group would gather it in one task. Here rows are cut into ranges on (group, order), so a large group lies in many ranges; each row
    is numbered inside its range, and a range adds the counts of the group's earlier ranges. Rows that are equal in group and order are numbered in any
    order. The ranges are written once, so numbers stay the same when a task is run again."""
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = rows.repartitionByRange(F.col(group), *by).sortWithinPartitions(F.col(group), *by).withColumn("__id", F.monotonically_increasing_id())
    ranged = written(ranged, "ranges").withColumn("__range", F.shiftright("__id", 33))
    parts = ranged.groupBy(F.col(group).alias("__group"), F.col("__range").alias("__in")).agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))
    before = F.sum("__n").over(W.partitionBy("__group").orderBy("__in").rowsBetween(W.unboundedPreceding, -1))  # a row for each range of the group
    parts = parts.select("__group", "__in", (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__shift"))
    found = ranged.join(parts, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__range") == F.col("__in")))
    return found.select(*rows.columns, (F.col("__id") + F.col("__shift")).alias(to))
