"""Checks of shapes, and recall against exact results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shape(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """One row: rows, dim_min, dim_max."""
    return vectors.agg(F.count(F.lit(1)).alias("rows"), F.min(F.size(column)).alias("dim_min"), F.max(F.size(column)).alias("dim_max"))


def validate(base: DataFrame, queries: DataFrame, truth: DataFrame, k: int) -> None:
    """Raises ValueError unless dimensions agree, every query has ground truth, and that reaches k."""
    b, q = shape(base).first(), shape(queries, "qv").first()
    if b.rows and q.rows and (b.dim_min, b.dim_max) != (q.dim_min, q.dim_max) or b.dim_min != b.dim_max:
        raise ValueError(f"dimensions differ: base {b.dim_min} to {b.dim_max}, queries {q.dim_min} to {q.dim_max}")
    per = truth.groupBy("qid").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("queries"), F.min("n").alias("least")).first()
    if per.queries != q.rows:
        raise ValueError(f"{q.rows} queries, but ground truth for {per.queries}")
    if q.rows and per.least < k:
        raise ValueError(f"ground truth has {per.least} neighbours, {k} are needed")


def recall(found: DataFrame, truth: DataFrame, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by,) qid, hits, recall: the share of the k true neighbours found; the divisor is k even if fewer came."""
    best = truth.where(F.col("rank") <= k).select("qid", "vec_id")
    hits = found.join(best, ["qid", "vec_id"]).groupBy(*by, "qid").agg(F.countDistinct("vec_id").alias("hits"))
    asked = found.select(*by).distinct().crossJoin(truth.select("qid").distinct()) if by else truth.select("qid").distinct()
    return asked.join(hits, [*by, "qid"], "left").select(*by, "qid", F.coalesce("hits", F.lit(0)).alias("hits"), (F.coalesce("hits", F.lit(0)) / k).alias("recall"))
