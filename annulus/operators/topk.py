"""Top-k by the total order (dist, vec_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_k(scored: DataFrame, k: int, by: tuple[str, ...] = ("qid",), order: tuple[str, ...] = ("dist", "vec_id"), rank: str = "rank") -> DataFrame:
    """The ``k`` first rows of each group, with their rank from 1. Spark ranks before the shuffle as well as after it."""
    placed = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return scored.withColumn(rank, placed).where(F.col(rank) <= k)


def merge(parts: DataFrame, k: int) -> DataFrame:
    """The k best of what shards or blocks found; rows without an id are padding."""
    return top_k(parts.where(F.col("vec_id").isNotNull()).select("qid", "dist", "vec_id"), k)


def as_array(ranked: DataFrame) -> DataFrame:
    """qid and hits: one array of (dist, vec_id) per query, best first."""
    return ranked.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "dist", "vec_id"))), lambda s: F.struct(s["dist"].alias("dist"), s["vec_id"].alias("vec_id"))).alias("hits"))


def padded(ranked: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exactly k rows per query; ranks without a hit have null dist and vec_id."""
    slots = queries.select("qid").distinct().withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(k))))
    return slots.join(ranked.select("qid", "rank", "dist", "vec_id"), ["qid", "rank"], "left")
