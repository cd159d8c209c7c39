"""The coarse quantiser: seeded k-means by inner-product distance, and inverted lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import shared_root
from .numbered import numbered

#: Bytes of centroids that are sent to the executors at most.
CENTROID_BYTES = 1 << 30
#: Ids of the training sample and of seeds that are broadcast at most; more of them are joined.
BROADCAST_IDS = 2_000_000
_SLICE = 256


def stride(n: int, train: int) -> int:
    return max(1, n // max(1, train))


def sample_ids(spark: SparkSession, n: int, train: int) -> DataFrame:
    """vec_id of the training sample: every stride-th id, around the end."""
    return spark.range(min(train, n)).select((F.col("id") * stride(n, train) % n).alias("vec_id"))


def seed_ids(spark: SparkSession, n: int, nlist: int, train: int) -> DataFrame:
    s = stride(n, train)
    return spark.range(nlist).select(F.col("id").cast("int").alias("list_id"), ((F.col("id") * s * 7 + F.col("id") * 13) % n).alias("vec_id"))


def reseed_ids(spark: SparkSession, n: int, nlist: int, iteration: int) -> DataFrame:
    """Where a list that lost all its vectors starts anew after ``iteration`` (from 0)."""
    return spark.range(nlist).select(F.col("id").cast("int").alias("list_id"), (((F.col("id") + 1) * 7919 + (iteration + 1) * 104729) % n).alias("vec_id"))


def _nearest(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid, the lowest of equals: equal centroids may differ in the last bit of a product."""
    return np.argmin(np.round(1 - rows @ centroids.T, 12), axis=1).astype(np.int32)


def shared(spark: SparkSession, centroids: np.ndarray) -> Broadcast:
    """The centroids, sent to each executor once; ValueError if they are too many for that."""
    if centroids.nbytes > CENTROID_BYTES:
        raise ValueError(f"{centroids.nbytes} bytes of centroids are over {CENTROID_BYTES}: train fewer lists")
    return spark.sparkContext.broadcast(centroids)


def assign(base: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, list_id, embedding. Only the centroids are sent out."""
    sent = shared(base.sparkSession, centroids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                rows = np.stack(batch["embedding"].to_numpy())
                batch["list_id"] = np.concatenate([_nearest(rows[at : at + _SLICE].astype(np.float64), sent.value) for at in range(0, len(rows), _SLICE)])
                yield batch[["vec_id", "list_id", "embedding"]]

    return base.select("vec_id", "embedding").mapInPandas(run, "vec_id long, list_id int, embedding array<float>")


def partial_sums(sample: DataFrame, centroids: np.ndarray) -> DataFrame:
    """list_id, n, sums: a row for each task and list, with the sum of its vectors as one array; a task adds up all its batches first."""
    sent = shared(sample.sparkSession, centroids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, counts = np.zeros_like(sent.value), np.zeros(len(sent.value), np.int64)
        for batch in batches:
            if len(batch):
                rows = np.stack(batch["embedding"].to_numpy()).astype(np.float64)
                lists = _nearest(rows, sent.value)
                np.add.at(sums, lists, rows)
                counts += np.bincount(lists, minlength=len(counts))
        some = np.flatnonzero(counts)
        if len(some):
            yield pd.DataFrame({"list_id": some.astype(np.int32), "n": counts[some], "sums": list(sums[some])})

    return sample.select("embedding").mapInPandas(run, "list_id int, n long, sums array<double>")


def step(sample: DataFrame, centroids: np.ndarray, fallback: np.ndarray) -> np.ndarray:
    """One Lloyd iteration: means of the assigned vectors; a list without any gets its row of ``fallback``."""

    def mean(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"list_id": part["list_id"].iloc[:1], "mean": [np.sum(np.stack(part["sums"].to_numpy()), axis=0) / part["n"].sum()]})

    means = partial_sums(sample, centroids).groupBy("list_id").applyInPandas(mean, "list_id int, mean array<double>").toPandas()  # a row a list
    moved = fallback.copy()
    if len(means):
        moved[means["list_id"].to_numpy()] = np.stack(means["mean"].to_numpy())
    return moved


def train(base: DataFrame, nlist: int, iterations: int, train_n: int) -> list[np.ndarray]:
    """Centroids before the first and after each iteration. ``base`` is read once: sample and seeds are written."""
    spark, n = base.sparkSession, base.count()
    shared_root(spark)
    sampled = sample_ids(spark, n, train_n).select("vec_id", F.lit(-1).alias("role"), F.lit(0).alias("list_id"))
    seeds = [seed_ids(spark, n, nlist, train_n), *(reseed_ids(spark, n, nlist, i) for i in range(iterations))]
    wanted = sampled
    for role, ids in enumerate(seeds):
        wanted = wanted.unionByName(ids.select("vec_id", F.lit(role).alias("role"), "list_id"))
    few = min(train_n, n) + nlist * len(seeds) <= BROADCAST_IDS
    held = base.select("vec_id", "embedding").join(F.broadcast(wanted) if few else wanted, "vec_id").checkpoint()

    def seeded(role: int) -> np.ndarray:
        rows = held.where(F.col("role") == role).select("list_id", "embedding").toPandas().sort_values("list_id")
        return np.stack(rows["embedding"].to_numpy()).astype(np.float64)

    sample, steps = held.where("role = -1"), [seeded(0)]
    for i in range(iterations):
        steps.append(step(sample, steps[-1], seeded(i + 1)))
    return steps


def centroid_table(spark: SparkSession, centroids: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "list_id int, centroid array<double>")


def inverted_lists(assigned: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``assigned`` with pos, from 1 in each list (of each shard), by ascending id."""
    return numbered(assigned, [*by, "list_id"], ["vec_id"], "pos")


def list_sizes(assigned: DataFrame, nlist: int) -> DataFrame:
    """list_id, list_size; lists without vectors are there with 0."""
    every = assigned.sparkSession.range(nlist).select(F.col("id").cast("int").alias("list_id"))
    return every.join(assigned.groupBy("list_id").agg(F.count(F.lit(1)).alias("list_size")), "list_id", "left").select("list_id", F.coalesce("list_size", F.lit(0)).alias("list_size"))


def offsets(sizes: DataFrame) -> DataFrame:
    """list_id, list_size, list_offset: where each list begins. One window over as many rows as lists."""
    before = Window.orderBy("list_id").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("list_offset", F.coalesce(F.sum("list_size").over(before), F.lit(0)))


def probes(queries: DataFrame, centroids: np.ndarray, nprobe: int) -> DataFrame:
    """qid, qv, list_id, dist, probe_rank of each query's nearest lists."""
    sent = shared(queries.sparkSession, centroids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), _SLICE):
                some = batch.iloc[at : at + _SLICE]
                dist = np.round(1 - np.stack(some["qv"].to_numpy()).astype(np.float64) @ sent.value.T, 12)
                near = np.argsort(dist, axis=1, kind="stable")[:, :nprobe]
                n = near.shape[1]
                yield pd.DataFrame({"qid": np.repeat(some["qid"].to_numpy(np.int64), n), "qv": [v for v in some["qv"] for _ in range(n)], "list_id": near.ravel().astype(np.int32), "dist": np.take_along_axis(dist, near, axis=1).ravel(), "probe_rank": np.tile(np.arange(1, n + 1, dtype=np.int32), len(some))})

    kind = dict(queries.dtypes)["qv"]
    return queries.select("qid", "qv").mapInPandas(run, f"qid long, qv {kind}, list_id int, dist double, probe_rank int")
