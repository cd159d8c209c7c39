"""Near copies by exact similarity: SimHash blocks and MinHash bands retrieve candidates, Jaccard of the shingle sets judges them.

Words and shingles are those of neardup: ``width`` words of the ASCII-lower-cased text, the whole sequence where there
are fewer. Similarity is shared distinct shingles over all distinct shingles of two texts, compared by
their XXH64. Texts link if it is ``least`` or more, and chains of links are groups.

First come the texts whose SimHash fingerprints, of the same shingles, differ in at most two bits: they are found by
pigeonhole blocks and verified by their distance (hamming), as in op8. Most pairs near ``least`` differ in more bits,
some ten of 64, so bands bring the others.

48 bands of six seeded minima: two texts of similarity 0.8 agree in no band with probability
(1 - 0.8 ** 6) ** 48, less than one in a million. Texts that share a band's key share a bucket. Pairs of
a bucket aren't enumerated: each text is compared with the bucket's first one, then with its last,
and only where a bucket still holds several groups is more to do. A group of very many near copies, which
most of them share with its first text, thus costs one comparison a text and bucket.

What is left is exact too, and stays within the open buckets: texts are compared only if they share one, however
chains of buckets connect them. Buckets of the same texts are one. Pairs inside a bucket's largest group
need nothing more, so the bucket's others, the outsiders, meet all of it, in blocks of ``block`` texts by
``block`` texts, each one product of incidence matrices. Of the buckets that two texts share only that with the
smallest key compares them, and texts of one group or of too different sizes aren't compared at all. Where buckets
overlap so much that the cluster they form sends fewer rows as a whole, it is dealt as one. Tasks
return only links that connect what they found, fewer than the texts they read.

Edge cases: null, empty and blank texts have one empty shingle and are alike; copies of a text, known by 128
bits, are one text here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hamming
from .common import cut, id_back, id_text, text_digest
from .graph import components, merged

BANDS, ROWS = 48, 6
_CHUNK = 128  # shingles times minima at once: small enough for a core's cache
_COLUMNS = 4096
_VOTERS = 1 << 15


def hashed(text: str | None, width: int, seed: int = 42) -> np.ndarray:
    """Hashes of the text's shingles, repeats included; of a blank text none."""
    words = (text or "").encode().lower().split()  # bytes: ASCII letters and white space only
    line, digest = memoryview(b" ".join(words)), xxhash.xxh64_intdigest
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: max(1, len(words) - width + 1)].tolist()
    ends = ends[min(width, len(words)) - 1 :].tolist() if words else []
    return np.array([digest(line[a:b], seed) for a, b in zip(starts, ends, strict=True)], np.uint64)


def distinct(hashes: np.ndarray, seed: int = 42) -> np.ndarray:
    """Sorted distinct hashes; without any, that of the empty shingle."""
    return np.unique(hashes) if len(hashes) else np.array([xxhash.xxh64_intdigest(b"", seed)], np.uint64)


def shingles(text: str | None, width: int, seed: int = 42) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    return distinct(hashed(text, width, seed), seed)


def fingerprint(hashes: np.ndarray) -> int:
    """The SimHash (signed long) of hashes with repeats, as neardup.simhash has it; 0 without any."""
    votes = sum((hamming.votes(hashes[at : at + _VOTERS]) for at in range(0, len(hashes), _VOTERS)), np.zeros(64, np.int64))
    return int(np.uint64(hamming.majority(votes, len(hashes))).view(np.int64))


def _seeds(seed: int) -> tuple[np.ndarray, np.ndarray]:
    drawn = np.random.default_rng(seed).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
    return drawn[0], drawn[1] | np.uint64(1)


def bands(hashes: np.ndarray, seeds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """One key (signed long) for each band."""
    flip, factor = seeds
    least = np.full(len(flip), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), _CHUNK):
            np.minimum(least, ((hashes[at : at + _CHUNK, None] ^ flip) * factor).min(axis=0), out=least)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each of ``left`` has in common with each of ``right``."""
    n, sets = len(left), [*left, *right]
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner, column = owner[times[column] > 1], column[times[column] > 1]
    column = np.unique(column, return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    shared = np.zeros((n, len(right)), np.int64)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        a, b = np.searchsorted(column, [at, at + _COLUMNS])
        held = np.zeros((len(sets), min(_COLUMNS, int(column[b - 1]) + 1 - at)), np.float32)
        held[owner[a:b], column[a:b] - at] = 1
        shared += (held[:n] @ held[n:].T).astype(np.int64)  # sums of up to _COLUMNS ones: exact
    return shared


def compared(cell: pd.DataFrame, band: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of a block's outsiders and of all others in it, and for each pair whether it is compared here.

    ``band`` is the bucket's key, or None for a cluster as a whole. A pair isn't compared if both are of one group, if its other
    direction is, if it shares no bucket, or if a bucket with a smaller key compares it.
    """
    outside = cell["outside"].to_numpy(bool)
    left, right = np.flatnonzero(outside), np.flatnonzero(~outside)
    label, names = cell["label"].to_numpy(), cell["content"].to_numpy()
    asked = label[left][:, None] != label[right]
    asked &= cell["main"].to_numpy(bool)[right] | (names[left][:, None] < names[right])
    keys = [np.asarray(of) if band is None else np.asarray(of)[np.asarray(of) < band] for of in cell["of"]]
    if len(left) and len(right) and any(map(len, keys)):
        both = _shared([keys[i] for i in left], [keys[i] for i in right]) > 0
        asked &= both if band is None else ~both
    return left, right, asked


def cell_links(cell: pd.DataFrame, band: int | None, least: float) -> list[tuple[int, int]]:
    """Pairs of contents that connect just what the cell's compared pairs of similarity ``least`` connect."""
    left, right, asked = compared(cell, band)
    sets, names = cell["shingles"].tolist(), cell["content"].tolist()
    sizes = np.array([len(s) for s in sets])
    a, b = sizes[left][:, None], sizes[right]
    asked &= np.minimum(a, b) >= least * np.maximum(a, b)
    rows, columns = asked.any(axis=1), asked.any(axis=0)
    left, right, asked = left[rows], right[columns], asked[np.ix_(rows, columns)]
    if not len(left):
        return []
    shared = _shared([sets[i] for i in left], [sets[i] for i in right])
    close = asked & (shared / (sizes[left][:, None] + sizes[right] - shared) >= least)
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root.setdefault(up, up)
            x = up
        return x

    found = []
    for i, j in np.argwhere(close).tolist():
        u, v = find(names[left[i]]), find(names[right[j]])
        if u != v:
            root[u] = v
            found.append((names[left[i]], names[right[j]]))
    return found


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The rows of pairs (u, v, ...) whose sets of shingles have similarity ``least`` or more."""
    n = sets.select("content", F.size("shingles").alias("n"))
    a, b = n.toDF("u", "n_u"), n.toDF("v", "n_v")
    # sizes first: of sets that differ too much in size, none is moved
    some = pairs.join(a, "u").join(b, "v").where(F.least("n_u", "n_v") >= F.lit(least) * F.greatest("n_u", "n_v"))
    held = some.join(sets.toDF("u", "of_u"), "u").join(sets.toDF("v", "of_v"), "v")
    shared = F.size(F.array_intersect("of_u", "of_v"))
    return held.select(*pairs.columns, "n_u", "n_v", shared.alias("shared")).where(F.col("shared") / (F.col("n_u") + F.col("n_v") - F.col("shared")) >= F.lit(least)).select(*pairs.columns)


def _labelled(members: DataFrame, linked: DataFrame) -> DataFrame:
    """Members (content, band) of the buckets that hold several groups of ``linked``, with their group as label, and with the bucket's first and last text and that one's group."""
    named = members.join(linked.toDF("content", "label"), "content", "left").select("content", "band", F.coalesce("label", "content").alias("label"))
    several = named.groupBy("band").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.min("content").alias("first"), F.max("content").alias("last"), F.max_by("label", "content").alias("last_label")).where("a < b")
    return named.join(several.select("band", "first", "last", "last_label"), "band")


def _cells(members: DataFrame, cell: str, block: int) -> DataFrame:
    """cell, its largest group, into how many blocks all (rows) and the outsiders (others) are dealt, and how many rows that sends (cost)."""
    sizes = members.select(F.col(cell).alias("cell"), "label", "content").distinct().groupBy("cell", "label").agg(F.count(F.lit(1)).alias("n"))
    each = sizes.groupBy("cell").agg(F.sum("n").alias("size"), F.max(F.struct("n", "label")).alias("most"))
    count = lambda n: F.ceil(n / block).cast("int")
    dealt = each.select("cell", F.col("most.label").alias("largest"), "size", (F.col("size") - F.col("most.n")).alias("out"), count(F.col("size")).alias("rows"), count(F.col("size") - F.col("most.n")).alias("others"))
    return dealt.withColumn("cost", F.col("size") * F.col("others") + F.col("out") * F.col("rows"))


def _met(open_: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """content, label, main, of, shingles, cell, whole, outside, and by what it is grouped: outsiders with the members that they meet.

    Buckets that a chain connects are a cluster. It is a cell itself (whole), if that sends no more rows than its buckets do,
    as in a crowd of near copies that share most buckets; else each of its buckets is one.
    """
    light = F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("content")).alias("x"), F.bit_xor(F.xxhash64("content", F.lit(1))).alias("y")
    kept = open_.groupBy("band").agg(*light).groupBy("n", "x", "y").agg(F.min("band").alias("band"))  # one of those with the same members
    named = components(open_.select(F.col("content").alias("u"), F.col("first").alias("v"))).toDF("content", "cluster")
    members = cut(open_.join(kept.select("band"), "band").select("content", "label", "band").join(named, "content"))
    buckets, clusters = cut(_cells(members, "band", block)), _cells(members, "cluster", block)
    apart = members.select("cluster", F.col("band").alias("cell")).distinct().join(buckets.select("cell", "cost"), "cell").groupBy("cluster").agg(F.sum("cost").alias("apart"))
    whole = cut(clusters.join(apart.withColumnRenamed("cluster", "cell"), "cell").where("cost <= apart").drop("apart"))
    of = members.groupBy("content").agg(F.collect_set("band").alias("of"))  # at most one for each of BANDS
    as_cluster = members.select("content", "label", F.col("cluster").alias("cell")).distinct().join(whole, "cell").withColumn("whole", F.lit(True))
    as_buckets = members.join(whole.select(F.col("cell").alias("cluster")), "cluster", "left_anti").select("content", "label", F.col("band").alias("cell")).join(buckets, "cell").withColumn("whole", F.lit(False))
    placed = cut(as_cluster.unionByName(as_buckets).withColumn("main", F.col("label") == F.col("largest")))
    bins = max(1, placed.count() // (8 * block))  # small cells share a task, about eight blocks' worth
    at = F.xxhash64("content", F.lit(1))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    out = placed.where(~F.col("main")).select("*", F.lit(True).alias("outside"), F.pmod(at, F.col("others")).cast("int").alias("i"), every("rows").alias("j"))
    all_ = placed.select("*", F.lit(False).alias("outside"), every("others").alias("i"), F.pmod(at, F.col("rows")).cast("int").alias("j"))
    large = F.col("rows") * F.col("others") > 1
    met = out.unionByName(all_).select("content", "label", "main", "cell", "whole", "outside", "i", "j", large.alias("large"), F.when(large, F.col("cell")).otherwise(F.pmod(F.xxhash64("cell"), F.lit(bins))).alias("deal"))
    return met.join(sets.join(of, "content"), "content")


def _by_fingerprint(texts: DataFrame) -> DataFrame:
    """(u, v), u > v, of texts (content, fp): those of one fingerprint with the first of them, and the first ones of fingerprints that differ in at most two bits."""
    firsts = cut(texts.groupBy("fp").agg(F.min("content").alias("first"), F.count(F.lit(1)).alias("n")))
    same = texts.join(firsts.where("n > 1"), "fp").where("content <> first").select(F.col("content").alias("u"), F.col("first").alias("v"))
    of = firsts.select("fp", "first")
    near = cut(hamming.edges(firsts.select("fp"))).join(of.toDF("u", "a"), "u").join(of.toDF("v", "b"), "v").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    return same.unionByName(near).distinct()


def _by_bands(texts: DataFrame) -> DataFrame:
    """content, band and root, the bucket's first text, of the texts (content, bands) that share a bucket."""
    placed = texts.select("content", F.explode("bands").alias("band")).distinct()
    roots = placed.groupBy("band").agg(F.min("content").alias("root"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return placed.join(roots, "band").select("content", "band", "root")


def content_groups(docs: DataFrame, width: int, seed: int = 42, least: float = 0.8, block: int = 256) -> DataFrame:
    """doc_id, content (the text's digest) and component of every row; a component is the digest of one text that it holds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seeds = _seeds(seed)
        for batch in batches:
            hashes = [hashed(t, width, seed) for t in batch["text"]]
            batch["fp"] = np.array([fingerprint(h) for h in hashes], np.int64)
            batch["bands"] = [bands(distinct(h, seed), seeds) for h in hashes]
            yield batch[["doc_id", "digest", "fp", "bands"]]

    def shingled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["shingles"] = [shingles(t, width, seed).view(np.int64) for t in batch["text"]]
            yield batch[["content", "shingles"]]

    def judge(rows: pd.DataFrame) -> pd.DataFrame:
        label = dict(zip(rows["content"].tolist(), rows["label"].tolist(), strict=True))
        found = [(label[u], label[v]) for (whole, cell), part in rows.groupby(["whole", "cell"]) for u, v in cell_links(part, None if whole else cell, least)]
        return pd.DataFrame({"u": pd.Series([u for u, _ in found], dtype="int64"), "v": pd.Series([v for _, v in found], dtype="int64")})

    rows = docs.select(id_text(), "text", text_digest(F.col("text")).alias("digest"))
    prints = cut(id_back(rows.mapInPandas(run, "doc_id string, digest binary, fp long, bands array<long>")).withColumn("row", F.monotonically_increasing_id()))
    # a text goes by the number of one of its rows: as exact as its digest, and half as long
    texts = prints.groupBy("digest").agg(F.min("row").alias("content"), F.min("doc_id").alias("at"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    near = cut(_by_fingerprint(texts.select("content", "fp")))
    members = cut(_by_bands(texts.select("content", "bands")))
    # one document for each text that has a candidate
    asked = members.select("content").union(near.select("u")).union(near.select("v")).distinct()
    one = asked.join(texts.select("content", "at", F.col("digest").alias("of")), "content")
    held = docs.select("doc_id", "text", text_digest(F.col("text")).alias("digest")).join(one, (F.col("digest") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("at")))
    sets = cut(held.select("content", "text").mapInPandas(shingled, "content long, shingles array<long>").dropDuplicates(["content"]))
    firsts = members.where("content <> root").select(F.col("content").alias("u"), F.col("root").alias("v"))
    linked = components(_verified(near.unionByName(firsts).distinct(), sets, least))
    members = members.select("content", "band")
    open_ = cut(_labelled(members, linked))
    # from here on groups are connected, by links between them
    if not open_.isEmpty():
        lasts = open_.where("label <> last_label").select(F.col("content").alias("u"), F.col("last").alias("v"), "label", "last_label").distinct()
        linked = merged(linked, _verified(lasts, sets, least).select(F.col("label").alias("u"), F.col("last_label").alias("v")))
        open_ = cut(_labelled(open_.select("content", "band"), linked))
        if not open_.isEmpty():
            linked = merged(linked, _met(open_, sets, block).groupBy("large", "deal", "i", "j").applyInPandas(judge, "u long, v long"))
    known = texts.select("content", "digest")
    named = linked.join(known.toDF("node", "content"), "node").join(known.toDF("component", "root"), "component").select("content", F.col("root").alias("component"))
    return prints.select("doc_id", F.col("digest").alias("content")).join(named, "content", "left").select("doc_id", "content", F.coalesce("component", "content").alias("component"))
