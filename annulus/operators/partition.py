"""Sharding strategies and the balance of the work they deal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import splitmix_shard


def block_id(ids: Column, n: int, shards: int) -> Column:
    """Shard r owns the ids from n*r/shards up to n*(r+1)/shards, in integer division."""
    return F.floor(((ids + 1) * shards - 1) / F.lit(n)).cast("int")


def cyclic(ids: Column, shards: int) -> Column:
    return F.pmod(ids, F.lit(shards)).cast("int")


def random_hash(ids: Column, shards: int) -> Column:
    return splitmix_shard(ids, shards)


def contiguous_list(lists: Column, nlist: int, shards: int) -> Column:
    return F.least(F.floor(lists * shards / F.lit(nlist)).cast("int"), F.lit(shards - 1))


def greedy_list(sizes: DataFrame, shards: int) -> DataFrame:
    """list_id, list_size, shard: lists from the largest, each to the shard with the least work so far, the lowest of equals.

    ``sizes`` has one row per list, as many as the index has centroids, so one array holds them.
    """
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("list_size")).alias("less"), "list_id")))
    loads = F.array_repeat(F.lit(0).cast("long"), shards)
    start = F.struct(loads.alias("loads"), F.array().cast("array<int>").alias("owners"))

    def deal(state: Column, item: Column) -> Column:
        owner = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int") - 1
        grown = F.transform(state["loads"], lambda load, i: F.when(i == owner, load - item["less"]).otherwise(load))
        return F.struct(grown.alias("loads"), F.array_append(state["owners"], owner).alias("owners"))

    one = sizes.agg(ordered.alias("lists")).withColumn("owners", F.aggregate("lists", start, deal)["owners"])
    each = one.select(F.explode(F.arrays_zip("lists", "owners")).alias("x"))
    return each.select(F.col("x.lists.list_id").alias("list_id"), (-F.col("x.lists.less")).alias("list_size"), F.col("x.owners").alias("shard"))


def owned(df: DataFrame, strategy: str, n: int, shards: int) -> DataFrame:
    """``df`` (vec_id) with its shard by an id strategy."""
    rule = {"block-id": lambda c: block_id(c, n, shards), "cyclic": lambda c: cyclic(c, shards), "random-hash": lambda c: random_hash(c, shards)}[strategy]
    return df.withColumn("shard", rule(F.col("vec_id")))


def dealt(assigned: DataFrame, sizes: DataFrame, strategy: str, n: int, nlist: int, shards: int) -> DataFrame:
    """``assigned`` (vec_id, list_id) with its shard by any strategy; ``sizes`` has one row per list."""
    if strategy == "contiguous-list":
        return assigned.withColumn("shard", contiguous_list(F.col("list_id"), nlist, shards))
    if strategy == "greedy-list":
        return assigned.join(F.broadcast(greedy_list(sizes, shards).select("list_id", "shard")), "list_id")  # one row per list
    return owned(assigned, strategy, n, shards)


def _id_rules(n: int, shards: int) -> dict[str, Column]:
    return {"block-id": block_id(F.col("vec_id"), n, shards), "cyclic": cyclic(F.col("vec_id"), shards), "random-hash": random_hash(F.col("vec_id"), shards)}


def _by_shard(vectors: DataFrame, sizes: DataFrame, n: int, nlist: int, counts: tuple[int, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """strategy, np, shard, (by,) work: how many vectors every strategy gives each shard at every number of shards, from one scan of ``vectors``."""
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("strategy"), F.lit(c).alias("np"), shard.alias("shard")) for c in counts for s, shard in _id_rules(n, c).items())))
    work = vectors.select(*by, each.alias("x")).groupBy(*by, "x.strategy", "x.np", "x.shard").agg(F.count(F.lit(1)).alias("work")).select("strategy", "np", "shard", *by, "work")
    for c in counts:
        held = (*by, F.col("list_size").alias("work"))
        whole = sizes.select(F.lit("contiguous-list").alias("strategy"), F.lit(c).alias("np"), contiguous_list(F.col("list_id"), nlist, c).alias("shard"), *held)
        greedy = greedy_list(sizes, c).select(F.lit("greedy-list").alias("strategy"), F.lit(c).alias("np"), "shard", *held)
        work = work.unionByName(whole).unionByName(greedy)
    return work


def _balance(work: DataFrame) -> DataFrame:
    """strategy, np, work_min, work_avg, work_max, imbalance_ratio of strategy, np, shard, work."""
    work = work.groupBy("strategy", "np", "shard").agg(F.sum("work").alias("work"))
    least = F.when(F.count(F.lit(1)) < F.col("np"), F.lit(0)).otherwise(F.min("work"))  # a shard without any has no row
    found = work.groupBy("strategy", "np").agg(least.alias("work_min"), (F.sum("work") / F.col("np")).alias("work_avg"), F.max("work").alias("work_max"))
    return found.withColumn("imbalance_ratio", F.when(F.col("work_avg") > 0, F.round(F.col("work_max") / F.col("work_avg"), 6)).otherwise(F.lit(0.0)))


def swept(vectors: DataFrame, sizes: DataFrame, n: int, nlist: int, counts: tuple[int, ...]) -> DataFrame:
    """The balance of the vectors (vec_id) that every strategy deals, at every number of shards."""
    return _balance(_by_shard(vectors, sizes, n, nlist, counts))


def search_work(assigned: DataFrame, sizes: DataFrame, probes: DataFrame, n: int, nlist: int, counts: tuple[int, ...]) -> DataFrame:
    """The balance of the candidates that a search visits: ``assigned`` (vec_id, list_id), ``probes`` (list_id and the number of its probes).

    Vectors are counted by list and shard before the probes are known of, so no candidate is made.
    """
    held = _by_shard(assigned, sizes, n, nlist, counts, ("list_id",))
    return _balance(held.join(probes, "list_id").select("strategy", "np", "shard", (F.col("work") * F.col("probes")).alias("work")))


def work_balance(sharded: DataFrame, shards: int) -> DataFrame:
    """One row: work_min, work_avg, work_max and imbalance_ratio, the largest over the average; empty shards count."""
    every = sharded.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    work = every.join(sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("work")), "shard", "left").select(F.coalesce("work", F.lit(0)).alias("work"))
    found = work.agg(F.min("work").alias("work_min"), F.avg("work").alias("work_avg"), F.max("work").alias("work_max"))
    return found.withColumn("imbalance_ratio", F.when(F.col("work_avg") > 0, F.round(F.col("work_max") / F.col("work_avg"), 6)).otherwise(F.lit(0.0)))
