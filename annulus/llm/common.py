"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import shared_root

#: A word is a longest run of anything but space, tab, line feed, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
_ROW_BITS = 33  # of monotonically_increasing_id, below the partition's number
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def id_text() -> Column:
    """doc_id as text, for pandas: with a null in it, a batch of longs would become doubles and lose digits."""
    return F.col("doc_id").cast("string").alias("doc_id")


def id_back(df: DataFrame) -> DataFrame:
    return df.withColumn("doc_id", F.col("doc_id").cast("long"))


def by_bytes(batch: pa.RecordBatch, most: int = 16 << 20, column: str | int = "text") -> Iterator[pa.RecordBatch]:
    """Slices of the batch whose texts have ``most`` bytes together, or one longer text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < batch.num_rows:
        yield batch.slice(start)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialises ``df`` in the cluster's shared checkpoint folder and drops its lineage.

    Its shuffle files go when it is written: a job of many steps holds those of one step at a time. Nothing else reads
    them, since the plan that wrote them is made here and run once.
    """
    spark = df.sparkSession
    shared_root(spark)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        once = df.select("*")  # a plan takes the setting when it is made
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return once.checkpoint()


def quoted(name: str) -> str:
    """A column's name as it stands, dots and backticks included."""
    return "`" + name.replace("`", "``") + "`"


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_digest(text: Column) -> Column:
    """16 bytes by which a text is known; a null one counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def content_of(text: Column, doc_id: Column) -> Column:
    """A hash of the text that, with the id (0 for a null one), tells a row from all rows but its repetitions."""
    return F.xxhash64(F.coalesce(text, F.lit("")), doc_id.isNull(), text.isNull())


def with_ordinal(df: DataFrame, order: list, name: str = "ordinal") -> DataFrame:
    """Adds each row's 0-based place in ``order``, without a window over the whole table.

    Rows are dealt by range and sorted inside each partition; a table with one row per partition then
    gives each partition its start. Meant for narrow rows: they are checkpointed.
    """
    at = "__at"
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()))
    part = F.shiftright(at, _ROW_BITS)
    sizes = ranged.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start"))
    # one row per partition of the sort: bounded by the number of partitions, not by the data
    joined = ranged.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return joined.withColumn(name, F.col("__start") + F.col(at).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))).drop("__part", "__start", at)
