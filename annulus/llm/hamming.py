"""All pairs of 64-bit fingerprints that differ in at most two bits, without comparing all.

A fingerprint has four blocks of 16 bits. Two differing bits touch at most two blocks, so a close
pair agrees in at least two; six tables, one for each two blocks, are keyed by these 32 bits. Pairs
that share a key are verified by their Hamming distance.

A bucket of over ``most`` fingerprints, as a large group of near copies makes, isn't joined with
itself. There the exact rule is: two fingerprints differ in at most two bits just if some word lies
within one bit of both. So each fingerprint of such buckets is sent to its 65 words within one bit,
and all that meet at a word are close: the work stays linear in the group.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RADIUS = 2
_BLOCKS, _WIDTH = 4, 16


def votes(hashes: np.ndarray) -> np.ndarray:
    """In how many of the 64-bit hashes each bit is set."""
    return np.unpackbits(hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(votes: np.ndarray, n: int) -> int:
    """The fingerprint, unsigned: a bit is 1 if it is set in over half of ``n`` hashes."""
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _keys(fp: Column) -> list[Column]:
    block = [F.shiftrightunsigned(fp, _WIDTH * i).bitwiseAND(F.lit((1 << _WIDTH) - 1)) for i in range(_BLOCKS)]
    return [F.shiftleft(block[i], _WIDTH).bitwiseOR(block[j]).bitwiseOR(F.lit(t << 2 * _WIDTH)) for t, (i, j) in enumerate(combinations(range(_BLOCKS), RADIUS))]


def _buckets(fps: DataFrame) -> DataFrame:
    """(fp, key, size): each fingerprint in its six buckets, with the number of fingerprints there."""
    keyed = fps.select("fp", F.explode(F.array(*_keys(F.col("fp")))).alias("key"))
    # not by a window: a group of near copies may fill a bucket, and a join's large keys can be split
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    return keyed.join(sizes, "key").select("fp", "key", "size")


def _words(fps: DataFrame) -> DataFrame:
    """(fp, word): each fingerprint with itself and the 64 words one bit away. Fingerprints are distinct, so a word has 65 at most."""
    flips = [F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64))]
    return fps.withColumn("word", F.explode(F.array(*flips)))


def close(fps: DataFrame, most: int = 64) -> tuple[DataFrame, DataFrame]:
    """From distinct ``fp``: verified pairs (a, b), a < b, of the usual buckets; and the fingerprints of the others (fp)."""
    placed = _buckets(fps)
    usual = placed.where(F.col("size") <= most).select("fp", "key")
    a, b = usual.select(F.col("fp").alias("a"), "key"), usual.select(F.col("fp").alias("b"), "key")
    pairs = a.join(b, "key").where((F.col("a") < F.col("b")) & (distance(F.col("a"), F.col("b")) <= RADIUS)).select("a", "b").distinct()
    return pairs, placed.where(F.col("size") > most).select("fp").distinct()


def edges(fps: DataFrame, most: int = 64) -> DataFrame:
    """(u, v): links that connect just the fingerprints that a chain of close pairs connects."""
    pairs, crowded = close(fps, most)
    met = _words(crowded).withColumn("v", F.min("fp").over(Window.partitionBy("word"))).where(F.col("fp") != F.col("v"))
    return pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(met.select(F.col("fp").alias("u"), "v").distinct())


def neighbours(counted: DataFrame, most: int = 64) -> DataFrame:
    """(fp, near): for distinct ``fp`` with ``n`` documents each, the documents at another fingerprint within the radius.

    In crowded buckets two close fingerprints meet at two words, so half the documents met there, less
    the 65 meetings with oneself, is the number.
    """
    fps = counted.select("fp")
    pairs, crowded = close(fps, most)
    crowd = crowded.join(counted, "fp")
    at = _words(crowd).withColumn("met", F.sum("n").over(Window.partitionBy("word")))
    inside = at.groupBy("fp").agg(((F.sum("met") - 65 * F.first("n")) / 2).cast("long").alias("near"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    marked = crowded.withColumn("in_crowd", F.lit(True))
    # a pair of two crowded fingerprints is counted at the words
    outer = both.join(marked.withColumnRenamed("fp", "a").withColumnRenamed("in_crowd", "crowd_a"), "a", "left").join(marked.withColumnRenamed("fp", "b").withColumnRenamed("in_crowd", "crowd_b"), "b", "left")
    outer = outer.where(F.col("crowd_a").isNull() | F.col("crowd_b").isNull()).join(counted.select(F.col("fp").alias("b"), "n"), "b").groupBy(F.col("a").alias("fp")).agg(F.sum("n").alias("near"))
    return outer.unionByName(inside).groupBy("fp").agg(F.sum("near").alias("near"))
