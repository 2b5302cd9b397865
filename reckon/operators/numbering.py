"""Consecutive numbers within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from reckon.durable import stash

#: Bits of ``monotonically_increasing_id`` that count the rows of a partition.
_ROW_BITS = 33


def numbered(rows: DataFrame, group: str, order: list[str | Column], name: str) -> DataFrame:
    """Add ``name``: 1, 2, 3, ... within each ``group`` in an order of rows.

    Rows are dealt to partitions by ranges of group and order and sorted there; a row's number is its place in its
    partition plus what earlier partitions hold of its group. So a group spreads over as many partitions as it needs,
    and only one row for each group and partition meets in a window. Rows that agree in the whole order are numbered as they
    stand, once and for all, as the sorted rows are written. A null group is a group.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, group, *order).sortWithinPartitions(group, *order).withColumn("__row", F.monotonically_increasing_id())
    placed = stash(placed.withColumn("__part", F.shiftright("__row", _ROW_BITS)), "numbered-rows")
    parts = placed.groupBy(F.col(group).alias("__group"), F.col("__part").alias("__of")).agg(F.count(F.lit(1)).alias("__n"), F.min("__row").alias("__first"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy("__group").orderBy("__of").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = stash(parts.withColumn("__before", before).drop("__n"), "number-starts")
    out = placed.join(starts, placed[group].eqNullSafe(starts["__group"]) & (F.col("__part") == F.col("__of")))
    return out.withColumn(name, F.col("__row") - F.col("__first") + F.col("__before") + 1).drop("__row", "__part", "__group", "__of", "__first", "__before")
