"""Navigable small-world graphs, one per shard: built and searched where the shard's vectors are.

Written from the published paper (Malkov and Yashunin, arXiv:1603.09320): layered graphs, greedy
descent, best-first search with a candidate list of size ef, and neighbours picked so that they
don't stand behind one another. A shard is one group, so shards must fit a task's memory:
``shards_for`` raises their number with the data. Every query meets every shard, so walks grow with queries
times shards; a block of queries walks a graph together.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .topk import merge


class Graph:
    def __init__(self, m: int, ef_construction: int, seed: int = 100):
        self.m, self.ef, self.random = m, ef_construction, np.random.default_rng(seed)
        self.layers: list[np.ndarray] = []  # layer -> node -> neighbours, then -1
        self.entry = -1

    @classmethod
    def build(cls, ids: np.ndarray, rows: np.ndarray, m: int, ef_construction: int) -> Graph:
        """In ascending order of id."""
        graph, order = cls(m, ef_construction), np.argsort(ids, kind="stable")
        graph.ids, graph.rows = ids[order], rows[order]
        levels = np.floor(-np.log(1 - graph.random.random(len(ids))) / np.log(max(2, m))).astype(int)
        graph.layers = [np.full((len(ids), m if layer else 2 * m), -1, np.int32) for layer in range(int(levels.max(initial=0)) + 1)]
        top = -1
        for node, level in enumerate(levels.tolist()):
            graph._insert(node, level, top)
            if level > top:
                top, graph.entry = level, node
        return graph

    def _insert(self, node: int, level: int, top: int) -> None:
        if self.entry < 0:
            return
        query, at = self.rows[node : node + 1], np.array([[self.entry]])
        for layer in range(top, level, -1):
            at = self._walk(query, at, 1, layer).argmin(axis=1)[:, None]
        for layer in range(min(level, top), -1, -1):
            near, links = self._walk(query, at, self.ef, layer)[0], self.layers[layer]
            found = np.argsort(near, kind="stable")[: self.ef]
            found = found[np.isfinite(near[found])]
            picked = self._pick(found, near[found], self.m)
            links[node, : len(picked)] = picked
            for other in picked.tolist():
                held = links[other]
                if held[-1] < 0:
                    held[int((held >= 0).sum())] = node
                else:
                    both = np.append(held, node)
                    dist = 1 - self.rows[both] @ self.rows[other]
                    order = np.lexsort((both, dist))
                    links[other] = self._pick(both[order], dist[order], len(held))
            at = found[None, :]

    def _pick(self, nodes: np.ndarray, dist: np.ndarray, most: int) -> np.ndarray:
        """The nearest, but none that is nearer to one picked before; then the rest, nearest first."""
        rows = self.rows[nodes]
        nearer = 1 - rows @ rows.T < dist  # of each node, which others are nearer to it than to the query
        behind, picked = np.zeros(len(nodes), bool), []
        for i in range(len(nodes)):
            if len(picked) == most:
                break
            if not behind[i]:
                picked.append(i)
                behind[i + 1 :] |= nearer[i, i + 1 :]
        others = np.ones(len(nodes), bool)
        others[picked] = False
        return np.concatenate([nodes[picked], nodes[others][: most - len(picked)]])

    def _walk(self, queries: np.ndarray, at: np.ndarray, ef: int, layer: int) -> np.ndarray:
        """A row for each query: its distances to the nodes that a best-first walk from ``at`` meets, infinite to the others.

        All queries walk at once, and each goes on from all of its ``ef`` nearest that it has not gone on from;
        it ends where there is none.
        """
        links, n = self.layers[layer], len(self.rows)
        near = np.full((len(queries), n), np.inf)
        ahead, seen = np.zeros(near.shape, bool), np.zeros((len(queries), n + 1), bool)
        seen[:, n] = True  # what an absent neighbour (-1) points to
        fresh = np.zeros(seen.shape, bool)
        fresh[np.arange(len(queries))[:, None], at] = True
        while True:
            met = np.count_nonzero(fresh)
            if not met:
                return near
            if 8 * met > near.size:  # so many that their distances are cheaper as a matrix product than one by one
                np.copyto(near, 1 - queries @ self.rows.T, where=fresh[:, :n])
            else:
                q, node = np.nonzero(fresh)
                near[q, node] = 1 - np.einsum("ij,ij->i", queries[q], self.rows[node])
            ahead |= fresh[:, :n]
            seen |= fresh
            if ef < n:
                front = ahead & (near <= np.partition(near, ef - 1, axis=1)[:, ef - 1 : ef])
            else:
                front = ahead
            q, node = np.nonzero(front)
            ahead[q, node] = False
            fresh[:] = False
            fresh[q[:, None], links[node]] = True
            fresh &= ~seen

    def search_all(self, queries: np.ndarray, k: int, ef: int, at_once: int = 1 << 15) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of queries, dist and id of the ``k`` nearest that are found for each, and of those as near as the last; some queries at a time."""
        parts, step = [], max(1, at_once // max(1, len(self.ids)))
        for start in range(0, len(queries) if self.entry >= 0 else 0, step):
            some = queries[start : start + step]
            at = np.full((len(some), 1), self.entry)
            for layer in range(len(self.layers) - 1, 0, -1):
                at = self._walk(some, at, 1, layer).argmin(axis=1)[:, None]
            near = np.round(self._walk(some, at, max(k, ef), 0), 12)
            least = np.partition(near, k - 1, axis=1)[:, k - 1 : k] if k < near.shape[1] else np.inf
            q, node = np.nonzero((near <= least) & np.isfinite(near))
            parts.append((start + q, near[q, node], self.ids[node]))
        none = (np.zeros(0, int), np.zeros(0), np.zeros(0, np.int64))
        return tuple(map(np.concatenate, zip(none, *parts, strict=True)))


def nearest(place: np.ndarray, dist: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Which are the ``k`` nearest of each place, by distance and id."""
    order = np.lexsort((ids, dist, place))
    place = place[order]
    first = np.searchsorted(place, place)
    return order[np.arange(len(place)) - first < k]


def shards_for(n: int, shards: int, most: int = 4096) -> int:
    """At least ``shards``, and as many as keep a graph at ``most`` vectors."""
    return max(shards, -(-n // most))


def build(sharded: DataFrame, m: int, ef_construction: int, shards: int | None = None) -> DataFrame:
    """shard, size, graph (binary): one graph per shard of ``sharded`` (shard, vec_id, embedding). Empty shards have none.

    With their number, ``shards`` get a task each; else Spark may join small ones.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        graph = Graph.build(pdf["vec_id"].to_numpy(np.int64), np.stack(pdf["embedding"].to_numpy()).astype(np.float64), m, ef_construction)
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "size": [len(pdf)], "graph": [pickle.dumps(graph)]})

    held = sharded.select("shard", "vec_id", "embedding")
    if shards:
        held = held.repartitionByRange(shards, "shard")
    return held.groupBy("shard").applyInPandas(run, "shard int, size long, graph binary")


def search(graphs: DataFrame, queries: DataFrame, k: int, ef: int, block: int = 4096) -> DataFrame:
    """qid, rank, dist, vec_id: every query against every shard's graph, in blocks of queries, and the merged best.

    ``graphs`` is read twice: hand in a written table.
    """
    from pyspark.sql import functions as F

    blocks = max(1, -(-queries.count() // block))
    told = graphs.agg(F.max("shard").alias("last"), F.max("size").alias("size")).first()
    shards = (told["last"] or 0) + 1
    # shards of some 8,192 vectors share a task, which merges what they find; with few shards, fewer of them do
    together = max(1, 8192 // (told["size"] or 1))
    tiles = min(shards, max(-(-shards // together), -(-4 * queries.sparkSession.sparkContext.defaultParallelism // blocks)))
    asked = queries.select("qid", "qv", F.pmod(F.xxhash64("qid"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"))
    held = graphs.select(F.pmod("shard", F.lit(tiles)).alias("tile"), "graph").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"qid": [], "dist": [], "vec_id": []})
        asked = np.stack(left["qv"].to_numpy()).astype(np.float64)
        parts = [pickle.loads(blob).search_all(asked, k, ef) for blob in right["graph"]]  # written by build()
        place, dist, ids = map(np.concatenate, zip(*parts, strict=True))
        best = nearest(place, dist, ids, k)
        return pd.DataFrame({"qid": left["qid"].to_numpy()[place[best]], "dist": dist[best], "vec_id": ids[best]})

    asked = asked.toDF(*asked.columns)  # names of its own, apart from the graphs it was joined with
    hits = asked.groupBy("tile", "block").cogroup(held.groupBy("tile", "block")).applyInPandas(run, "qid long, dist double, vec_id long")
    return merge(hits, k).select("qid", "rank", "dist", "vec_id")
