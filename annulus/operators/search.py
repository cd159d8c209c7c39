"""Exact and list-pruned search: blocks of vectors against blocks of queries, one matrix product each."""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import shared_root
from .topk import top_k

_HITS = "qid long, dist double, vec_id long"


#: Queries that are scored at a time: their distances to a block are some 16 MB.
_SLICE = 256


def _local_top(queries: pd.DataFrame, held: pd.DataFrame, k: int) -> pd.DataFrame:
    if not len(queries) or not len(held):
        return pd.DataFrame({"qid": np.empty(0, np.int64), "dist": np.empty(0), "vec_id": np.empty(0, np.int64)})
    ids = held["vec_id"].to_numpy(np.int64)
    order = np.argsort(ids, kind="stable")
    ids, rows = ids[order], np.stack(held["embedding"].to_numpy())[order].astype(np.float64)
    qids, found = queries["qid"].to_numpy(np.int64), []
    for at in range(0, len(queries), _SLICE):
        asked = np.stack(queries["qv"].iloc[at : at + _SLICE].to_numpy()).astype(np.float64)
        dist = np.round(1 - asked @ rows.T, 12)  # equal vectors tie, whatever their place in the product
        reach = np.partition(dist, k - 1, axis=1)[:, k - 1 : k] if k < len(ids) else np.inf
        query, place = np.nonzero(dist <= reach)  # the k nearest and all that tie with the last of them
        near = dist[query, place]
        best = np.lexsort((place, near, query))
        first = np.searchsorted(query, query[best])  # where a query's hits begin
        best = best[np.arange(len(best)) - first < k]
        found.append(pd.DataFrame({"qid": qids[at + query[best]], "dist": near[best], "vec_id": ids[place[best]]}))
    return pd.concat(found)


def _bin_top(queries: pd.DataFrame, held: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest of each query within those lists of a bin that it probes: one product a list, merged here."""
    parts = {name: part for name, part in held.groupby("list_id")}
    found = pd.concat([_local_top(part, parts.get(name, held.iloc[:0]), k) for name, part in queries.groupby("list_id")] or [_local_top(queries, held, k)])
    if len(parts) < 2:
        return found
    qid, dist, vec_id = (found[c].to_numpy() for c in ("qid", "dist", "vec_id"))
    order = np.lexsort((vec_id, dist, qid))
    sorted_ids = qid[order]
    best = order[np.arange(len(order)) - np.searchsorted(sorted_ids, sorted_ids) < k]
    return found.iloc[best]


def local_hits(base: DataFrame, queries: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k nearest within each group of ``keys``: base (keys, vec_id, embedding), queries (keys, qid, qv)."""
    held = base.select(*keys, "vec_id", "embedding").groupBy(*keys)
    asked = queries.select(*keys, "qid", "qv")
    return asked.toDF(*asked.columns).groupBy(*keys).cogroup(held).applyInPandas(lambda a, b: _local_top(a, b, k), _HITS)


def blocks(base: DataFrame, queries: DataFrame, block: int = 8192) -> tuple[DataFrame, DataFrame]:
    """Both sides dealt into blocks, so that each vector meets each query once, at one (block, query_block)."""
    n, m = base.count(), queries.count()
    parts, query_blocks = max(1, -(-n // block)), max(1, -(-m // block))
    held = base.withColumns({"block": F.pmod(F.xxhash64("vec_id"), F.lit(parts)), "query_block": F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))})
    asked = queries.withColumns({"query_block": F.pmod(F.xxhash64("qid"), F.lit(query_blocks)).cast("int"), "block": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))})
    return held, asked


def exact(base: DataFrame, queries: DataFrame, k: int, block: int = 8192) -> DataFrame:
    """qid, rank, dist, vec_id of the k nearest of all ``base``. Both sides meet block by block, whatever their size."""
    held, asked = blocks(base, queries, block)
    return top_k(local_hits(held, asked, ["block", "query_block"], k), k).select("qid", "rank", "dist", "vec_id")


def products(base: DataFrame, queries: DataFrame, block: int = 1024) -> DataFrame:
    """qid, vec_id, ip of each query with every vector: the output is all pairs, dealt like ``exact``'s blocks."""
    held, asked = blocks(base, queries, block)
    keys = ["block", "query_block"]

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"qid": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "ip": np.empty(0)})
        ip = np.stack(a["qv"].to_numpy()).astype(np.float64) @ np.stack(b["embedding"].to_numpy()).astype(np.float64).T
        return pd.DataFrame({"qid": np.repeat(a["qid"].to_numpy(), len(b)), "vec_id": np.tile(b["vec_id"].to_numpy(), len(a)), "ip": ip.ravel()})

    asked, held = asked.select(*keys, "qid", "qv"), held.select(*keys, "vec_id", "embedding")
    return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(run, "qid long, vec_id long, ip double")


def first(queries: DataFrame, most: int, place: str | Column = "qid") -> DataFrame:
    """The queries of the first ``most`` places, from 0: their number is the smaller of both."""
    return queries.where((F.col(place) if isinstance(place, str) else place) < most)


def candidates(lists: DataFrame, probes: DataFrame) -> DataFrame:
    """(qid, vec_id, list_id) of every vector in a probed list: an equi-join, so partitions of a stored index are pruned."""
    return lists.select("list_id", "vec_id").join(probes.select("qid", "list_id"), "list_id").select("qid", "vec_id", "list_id")


def tiles(sizes: DataFrame, probes: DataFrame, of_list: list[str], block: int) -> DataFrame:
    """of_list, blocks, query_blocks, bin: into how many blocks a probed list's vectors and queries are dealt. Written: a row a list.

    ``sizes`` has of_list and list_size. Blocks are dealt by hashes and filled a little less, so that
    none has more than ``block`` rows but by an odd chance. Lists of one block share bins, from 0, of about half a
    block of vectors and of queries; the bin of others is -1.
    """
    fill = max(1.0, block - 6 * block**0.5)
    shared_root(probes.sparkSession)
    asked = probes.groupBy("list_id").agg(F.count(F.lit(1)).alias("asked"))
    there = sizes.where("list_size > 0").select(*of_list, "list_size").join(asked, "list_id")
    dealt = there.select(*of_list, "list_size", "asked", F.ceil(F.col("list_size") / fill).cast("int").alias("blocks"), F.ceil(F.col("asked") / fill).cast("int").alias("query_blocks")).checkpoint()
    small = (F.col("blocks") == 1) & (F.col("query_blocks") == 1)
    held = dealt.where(small).agg(F.sum("list_size"), F.sum("asked")).first()
    bins = max(1, -(-2 * max(held[0] or 0, held[1] or 0) // block))
    return dealt.select(*of_list, "blocks", "query_blocks", F.when(small, F.pmod(F.xxhash64("list_id"), F.lit(bins))).otherwise(F.lit(-1)).cast("int").alias("bin"))


def ivf(lists: DataFrame, probes: DataFrame, k: int, by: tuple[str, ...] = (), block: int = 8192, sizes: DataFrame | None = None) -> DataFrame:
    """qid, (by,) rank, dist, vec_id of the k nearest among the probed lists, per group of ``by`` such as the shard.

    ``lists`` has list_id, vec_id, embedding; ``probes`` has qid, qv, list_id. A list's vectors and the queries
    that probe it are both dealt into blocks by a hash of their ids, and each pair of blocks is a tile: one
    matrix product in one task; tiles of short lists share a task. ``sizes`` (by, list_id, list_size) spares counting the lists. Of lists stored
    by list_id only the probed ones are read.
    """
    hits = tile_hits(lists, probes, k, by, block, sizes).where("qid IS NOT NULL")
    return top_k(hits, k, (*by, "qid")).select(*by, "qid", "rank", "dist", "vec_id")


def timed_ivf(lists: DataFrame, probes: DataFrame, k: int, by: tuple[str, ...] = (), block: int = 8192, sizes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """As ``ivf``, and the microseconds that tasks took for each group of ``by``: by, tiles, search_us. Both are of one run, written."""
    shared_root(lists.sparkSession)
    raw = tile_hits(lists, probes, k, by, block, sizes).checkpoint()
    times = raw.where("qid IS NULL").groupBy(*by).agg(F.count(F.lit(1)).alias("tiles"), F.sum("dist").alias("search_us"))
    return top_k(raw.where("qid IS NOT NULL"), k, (*by, "qid")).select(*by, "qid", "rank", "dist", "vec_id"), times


def tile_hits(lists: DataFrame, probes: DataFrame, k: int, by: tuple[str, ...], block: int, sizes: DataFrame | None) -> DataFrame:
    """by, qid, dist, vec_id: the k nearest of each query within each tile; and for each tile a row without qid whose dist is its time."""
    of_list = [*by, "list_id"]
    if sizes is None:
        sizes = lists.groupBy(*of_list).agg(F.count(F.lit(1)).alias("list_size"))
    # one row per probed list (and shard), as many as the index has centroids
    dealt = F.broadcast(tiles(sizes, probes, of_list, block).where("query_blocks > 0"))
    keys = [*by, "bin", "alone", "block", "query_block"]
    alone = F.when(F.col("bin") < 0, F.col("list_id")).otherwise(F.lit(-1)).alias("alone")
    place = lambda name, parts: F.pmod(F.xxhash64(name), F.col(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    held = lists.join(dealt, of_list).withColumns({"alone": alone, "block": place("vec_id", "blocks")}).withColumn("query_block", each("query_blocks"))
    asked = probes.join(dealt, "list_id").withColumns({"alone": alone, "query_block": place("qid", "query_blocks")}).withColumn("block", each("blocks"))
    types = dict(lists.dtypes)

    def run(key, a, b):
        began = time.perf_counter()
        found = _bin_top(a, b, k).astype({"qid": "Int64", "vec_id": "Int64"})
        took = pd.DataFrame({"qid": pd.array([pd.NA], "Int64"), "dist": [(time.perf_counter() - began) * 1e6], "vec_id": pd.array([pd.NA], "Int64")})
        return pd.concat([found, took]).assign(**dict(zip(by, key, strict=False)))[[*by, "qid", "dist", "vec_id"]]

    asked, held = asked.select(*keys, "list_id", "qid", "qv"), held.select(*keys, "list_id", "vec_id", "embedding")
    asked = asked.toDF(*asked.columns)  # names of its own, apart from the lists it was joined with
    schema = ", ".join([*(f"{c} {types[c]}" for c in by), _HITS])
    return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(run, schema)
