"""Exact top-k search by inner product: the threshold algorithm over sorted per-dimension lists.

Vectors are dealt into blocks of bounded size, queries too, and each pair of blocks is one group of
a cogrouped job. In a group every dimension has its list of the block's vectors in order of the
component. A query reads all lists in step, from the high end where its component is positive and
the low end where it is negative, scores each vector it meets in full, and stops when the bound, the
query against the components last read, lies below its kth score: no vector unread can then enter,
nor tie. A first pass searches one block for each query; its kth score goes along to all other
blocks, where a bound below it ends the search at once. The k best of each block meet in a ranked
window per query.

Components are quantised to floor(scale * x), x as double. Scores are exact at every magnitude:
double sums where they stay below 2**53, long sums below 2**63, Python's integers beyond. A score
among the best that isn't a long raises an OverflowError.

Edge cases: vectors that are null, or hold a null, NaN or infinite component, take no part; empty
vectors score 0 with each other; only vectors of one length are compared. Equal scores go by the
smaller vec_id. Rows that repeat a vec_id are candidates each, but never of a query with that id; a
query id that repeats is asked once, with the smallest of its vectors. A null vec_id is never a
query, and as a candidate goes after all others of its score. Fewer candidates than k give all of
them; an empty table gives no rows. Only vec_id and embedding are read.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

_LAST_ID = np.iinfo(np.int64).max
_DOUBLES, _LONGS = 1 << 53, 1 << 63


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vectors.where(F.col("embedding").isNotNull() & sound).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding"))


def _matrix(rows: pd.Series, scale: float) -> np.ndarray:
    """floor(scale * x) of every component: doubles that are whole numbers, or integers where one of them is infinite."""
    held = np.stack(rows.to_numpy()).astype(np.float64)
    with np.errstate(over="ignore"):
        found = np.floor(scale * held)
    if np.isfinite(found).all():
        return found
    exact = [[int(f) if math.isfinite(f) else math.floor(Fraction(scale) * Fraction(x)) for x, f in zip(*pair, strict=True)] for pair in zip(held.tolist(), found.tolist(), strict=True)]
    return np.array(exact, object)


def _largest(rows: np.ndarray) -> int:
    return int(max(abs(rows.max()), abs(rows.min()))) if rows.size else 0


def _as_integers(rows: np.ndarray) -> np.ndarray:
    return np.array([[int(x) for x in row] for row in rows.tolist()], object).reshape(rows.shape)


def _matched(queries: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in a type that holds every score, and every sum on the way to it, exactly."""
    q, r = _largest(queries), _largest(rows)
    most = max(q, r, q * r * max(1, rows.shape[1]))
    if most < _DOUBLES:
        return queries.astype(np.float64), rows.astype(np.float64)
    if most < _LONGS:
        return queries.astype(np.int64), rows.astype(np.int64)
    return _as_integers(queries), _as_integers(rows)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(ids) > 4 * k:  # all that reach the kth score
        reach = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[reach], scores[reach]
    # by score, then id; scores may be Python's integers
    order = np.argsort(ids, kind="stable")
    order = order[np.argsort(-scores[order], kind="stable")][:k]
    return ids[order], scores[order]


class SortedLists:
    """A block's vectors with one list of rows per dimension, ascending by component."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.lists = np.argsort(rows, axis=0, kind="stable")
        self.sorted = np.take_along_axis(rows, self.lists, axis=0)
        self.read = 0  # vectors scored, over all searches

    def search(self, query: np.ndarray, own: int, k: int, floor: int | None = None, step: int = 32) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best ``k`` but ``own``; of those below ``floor``, some may be left out."""
        n = len(self.ids)
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        seen = self.ids == own
        ids, scores = np.empty(0, np.int64), np.empty(0, self.rows.dtype)
        depth = 0
        while depth < n:
            # what a vector that no list has shown yet can reach
            bound = query[up] @ self.sorted[n - max(1, depth), up] + query[down] @ self.sorted[max(1, depth) - 1, down]
            if (floor is not None and bound < floor) or (depth and len(ids) == k and bound < scores[-1]):
                break
            until = min(n, depth + step)
            met = np.zeros(n, bool)
            if until == n or len(up) + len(down) == 0:
                until, met[:] = n, True
            else:
                met[self.lists[n - until : n - depth, up]] = True
                met[self.lists[depth:until, down]] = True
            met &= ~seen
            seen |= met
            new = np.flatnonzero(met)
            self.read += len(new)
            ids, scores = _best(np.r_[ids, self.ids[new]], np.r_[scores, self.rows[new] @ query], k)
            depth, step = until, 2 * step
        return ids, scores


def _long(score) -> int:
    if not -_LONGS <= int(score) < _LONGS:
        raise OverflowError(f"a score of {int(score)} is no long")
    return int(score)


def _search_blocks(left: pd.DataFrame, right: pd.DataFrame, k: int, scale: float) -> pd.DataFrame:
    """query_id, vec_id, score of the best in a block; ``left`` may have floor, a score that others reach already."""
    found = []
    sizes = right["embedding"].map(len)
    for size, asked in left.groupby(left["embedding"].map(len)):
        held = right[sizes == size]
        if not len(held):
            continue
        queries, rows = _matched(_matrix(asked["embedding"], scale), _matrix(held["embedding"], scale))
        lists = SortedLists(held["vec_id"].to_numpy(np.int64), rows)
        floors = [None] * len(asked) if "floor" not in asked else [None if f is None else int(f) for f in asked["floor"]]
        for own, query, floor in zip(asked["query_id"].to_numpy(np.int64), queries, floors, strict=True):
            ids, scores = lists.search(query, own, k, floor)
            if floor is not None:
                ids, scores = ids[scores >= floor], scores[scores >= floor]
            found.append(pd.DataFrame({"query_id": own, "vec_id": ids, "score": np.array([_long(s) for s in scores], np.int64)}))
    return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype=np.int64)


def search(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, block: int = 8192, query_block: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows for each row where ``is_query`` holds.

    All queries meet all blocks: rows are sent once for each ``query_block`` queries.
    """
    rows = usable(vectors)
    queries = rows.where(F.col("vec_id").isNotNull() & is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("embedding").alias("embedding"))
    n, asked = rows.count(), rows.where(F.col("vec_id").isNotNull() & is_query).count()
    blocks, query_blocks = max(1, -(-n // block)), max(1, -(-asked // query_block))
    # dealt by place, not by id: no id can fill a block
    placed = rows.withColumn("vec_id", F.coalesce("vec_id", F.lit(_LAST_ID))).withColumn("block", F.pmod(F.monotonically_increasing_id(), F.lit(blocks)))
    if blocks > 1:
        placed = cut(placed)  # both passes must find a vector in one block
    dealt = placed.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    spread = F.xxhash64("query_id")
    asking = queries.withColumns({"query_block": F.pmod(spread, F.lit(query_blocks)).cast("int"), "home": F.pmod(F.shiftrightunsigned(spread, 20), F.lit(blocks))})
    keys, schema = ["block", "query_block"], "query_id long, vec_id long, score long"

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _search_blocks(left, right, k, scale)

    def met(sent: DataFrame) -> DataFrame:
        return sent.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(run, schema)

    local = met(asking.withColumnRenamed("home", "block"))
    if blocks > 1:
        local = cut(local)
        full = local.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
        # as text: in a batch with a null, longs would become doubles
        floors = full.select(F.col("query_id").alias("q"), F.when(F.col("n") >= k, F.col("least")).cast("string").alias("floor"))
        others = asking.join(floors, F.col("query_id") == F.col("q"), "left").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).where(F.col("block") != F.col("home"))
        local = local.unionByName(met(others.select("query_id", "embedding", "floor", *keys)))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    ranked = local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.when(F.col("vec_id") != _LAST_ID, F.col("vec_id")).alias("vec_id"), "score")
