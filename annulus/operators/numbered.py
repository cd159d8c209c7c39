"""Places of rows in large groups, without one task for a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import shared_root

_ROW_BITS = 33  # of monotonically_increasing_id, below the partition's number


def numbered(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """Adds each row's place, from 1, among those of equal ``by``, in the total order ``order``.

    Rows are dealt by range and sorted in each partition; what each partition holds of a group then
    tells where the next one goes on. Meant for narrow rows: they are checkpointed.
    """
    shared_root(df.sparkSession)
    ranged = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("__at", F.monotonically_increasing_id())
    ranged = ranged.withColumn("__part", F.shiftright("__at", _ROW_BITS)).checkpoint()
    held = ranged.groupBy(*by, "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = F.sum("__n").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    # groups and partitions, not rows, bound this table
    starts = held.withColumn("__start", F.coalesce(before, F.lit(0))).drop("__n")
    place = (F.col("__start") + F.col("__at") - F.col("__first") + 1).cast("int")
    return ranged.join(starts, [*by, "__part"]).withColumn(name, place).drop("__at", "__part", "__first", "__start")
