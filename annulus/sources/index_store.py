"""Indexes kept as Parquet under a path that names every setting they depend on, and checked when they are loaded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import cache_token

#: Columns by which an index is known to be of the vectors it was made from.
VECTORS = ("vec_id", "embedding")
_MANIFEST = "index_digest string, held long, dims int, folded long, summed decimal(38,0), part string, part_size long, part_offset long"


def index_path(root: str, kind: str, digest: str, **settings) -> str:
    """A path that tells the settings and holds the digest of all that the index was made from."""
    told = "_".join(f"{k}-{cache_token(str(v))}" for k, v in sorted(settings.items()))
    return f"{root.rstrip('/')}/{cache_token(kind)}_{told}_{cache_token(digest)}"


def content(rows: DataFrame) -> tuple:
    """Number of rows, dimensions, and two hashes of the vectors (of all columns, if there are none) that don't depend on their order."""
    columns = [c for c in VECTORS if c in rows.columns] or sorted(rows.columns)
    dims = F.max(F.size("embedding")) if "embedding" in columns else F.lit(0)
    return tuple(
        rows.agg(
            F.count(F.lit(1)),
            F.coalesce(dims, F.lit(0)).cast("int"),
            F.coalesce(F.bit_xor(F.xxhash64(*columns)), F.lit(0).cast("long")),
            F.coalesce(F.sum(F.xxhash64(*reversed(columns), F.lit(1)).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")),
        ).first()
    )


def _sizes(rows: DataFrame, partition: str | None) -> list[tuple[str | None, int]]:
    """part and its rows, in order: as many as there are lists."""
    part = F.col(partition) if partition else F.lit(None).cast("string")
    found = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part")
    return [(None if r.part is None else str(r.part), r.n) for r in found.collect()]


def save(index: DataFrame, path: str, digest: str, partition: str | None = None, within: str | None = None) -> None:
    """Written by ``partition``; a large one is dealt to several tasks and files, by ranges of ``within``.

    The manifest is written last, from what lies there: an index without it is unfinished.
    """
    if partition:
        index = index.repartitionByRange(*(c for c in (partition, within) if c))
    writer = index.write.partitionBy(partition) if partition else index.write
    writer.mode("overwrite").parquet(f"{path}/data")
    spark = index.sparkSession
    stored = spark.read.schema(index.schema).parquet(f"{path}/data")
    rows, offset, whole = [], 0, content(stored)
    for part, n in _sizes(stored, partition):
        rows.append((digest, *whole, part, n, offset))
        offset += n
    rows = rows or [(digest, *whole, None, 0, 0)]
    told = spark.createDataFrame(rows, _MANIFEST)
    if partition:
        told = told.withMetadata("part", {"column": partition})
    told.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/manifest")


def list_sizes(spark: SparkSession, path: str) -> DataFrame:
    """list_id, list_size and list_offset of an index stored by list, from its manifest alone."""
    return manifest(spark, path).select(F.col("part").cast("int").alias("list_id"), F.col("part_size").alias("list_size"), F.col("part_offset").alias("list_offset"))


def load(spark: SparkSession, path: str, digest: str, source: DataFrame | None = None) -> DataFrame:
    """The stored index. ValueError if it was made with other settings, if it isn't what its manifest says, or if ``source`` has other vectors.

    Sizes and offsets of lists are checked always, from the files' footers; ``source``, the vectors that the caller
    holds now, by number, dimensions and hashes.
    """
    told = manifest(spark, path)
    rows, column = sorted(told.collect(), key=lambda r: r.part_offset), told.schema["part"].metadata.get("column")
    if {r.index_digest for r in rows} != {digest}:
        raise ValueError(f"{path} holds another index than {digest}")
    stored, offset = spark.read.parquet(f"{path}/data"), 0
    for r in rows:
        if r.part_offset != offset or r.part_size < 0:
            raise ValueError(f"{path}: list {r.part} begins at {r.part_offset}, not {offset}")
        offset += r.part_size
    if offset != rows[0].held or dict(_sizes(stored, column)) != {r.part: r.part_size for r in rows if r.part_size}:
        raise ValueError(f"{path}: its lists aren't of the {rows[0].held} rows that were stored")
    if source is not None and content(source) != (rows[0].held, rows[0].dims, rows[0].folded, rows[0].summed):
        raise ValueError(f"{path} was made from other vectors")
    return stored


def csr_invariants(lists: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row: vectors, lists, first_offset, last_offset, monotone and dense (positions of every list run from 1 to its size)."""
    from ..operators.kmeans import offsets

    off = offsets(sizes)
    ends = off.agg(F.count(F.lit(1)).alias("lists"), F.min("list_offset").alias("first_offset"), F.max(F.col("list_offset") + F.col("list_size")).alias("last_offset"), F.min(F.col("list_size") >= 0).alias("monotone"))
    held = lists.groupBy("list_id").agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("last"), F.countDistinct("pos").alias("places"))
    dense = held.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("vectors"), F.coalesce(F.min((F.col("n") == F.col("last")) & (F.col("n") == F.col("places"))), F.lit(True)).alias("dense"))
    return ends.crossJoin(dense)
