"""Suffix-array dedup: removes every byte covered by a long string that also starts in an earlier document.

A string of ``length`` bytes is given to one place in it, its anchor: the substring of ``seed`` bytes
with the smallest hash, leftmost of equals. Equal strings have equal anchors, so all that can match
meet under the anchor's hash, and consecutive strings with one anchor are one context, sent once. A
first, narrow exchange finds the anchors that more than one document has; only their contexts move,
each distinct one once for each group of documents.

A shard of contexts is one byte string. Its suffix array, by induced sorting, brings equal strings
together; permuted common prefixes of at least ``length`` bytes tell where; the smallest document of
each run is the first with that string. What comes back for a context is its strings that start
earlier, as a bit mask.

Of texts that are equal as a whole, found by a digest first, only that of the smallest document goes
through this; the others lose all their bytes, if they have ``length`` of them.

An anchor that occurs over ``crowded`` times, as a common phrase does, would fill a shard with its
contexts: its strings travel one by one instead, each to the shard of its own hash. A string has a row
for each group that holds it; beyond ``part_groups`` of these it is dealt to several shards, each of
which finds its first document there, and an aggregate joined back compares these firsts. What is known of an
anchor is a row for each group too: up to ``part_groups`` rows meet in a window, more are combined by an
aggregate and joined back, so no task has the rows of one phrase of the whole corpus.

A shard's contexts end after 2 x ``length`` - ``seed`` bytes. That bounds what the suffix array's sorting of
names compares: it is linear for strings of bounded repeats, as these are, and not for any string.

Edge cases: a null text counts as empty; texts shorter than ``length`` keep all; a null doc_id is
larger than every other; documents of the same id, and those without, don't remove from each other;
repeated rows get the same result each. Very long texts are read in chunks. An empty table gives an
empty result. Only doc_id and text are read, so other columns can have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, id_back, id_text
from .suffix import common_prefixes, suffix_array

_POS_BITS = 22
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_LAST = np.iinfo(np.int64).max
_TOLD_BITS = 24
_MOST_TIMES = (1 << _TOLD_BITS - 1) - 1
_USUAL, _CROWDED, _COPY = 0, 1, 2  # kinds of rows that come back to a group
_BYTE = np.random.default_rng(20).integers(0, 1 << 64, 256, np.uint64)  # a number for each byte, the same in every task


@dataclass(frozen=True)
class Plan:
    length: int = 50
    seed: int = 20
    crowded: int = 50_000
    group_bytes: int = 4 << 20
    shard_bytes: int = 2 << 20
    part_groups: int = 4096  # groups whose rows of one crowded string, or of one anchor, share a task

    def __post_init__(self):
        if not 0 < self.seed <= self.length:
            raise ValueError(f"a seed of {self.seed} bytes isn't within {self.length}")
        if self.length - self.seed + 1 > 62:
            raise ValueError(f"a context of {self.length} bytes and a seed of {self.seed} has more strings than a mask of 62 bits")


def _rolling(buf: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes at each place; products wrap."""
    with np.errstate(over="ignore"):
        return _mixed(buf, size)


def _mixed(buf: np.ndarray, size: int) -> np.ndarray:
    power, have, value, left = _MULTIPLIER, 1, _BYTE[buf], size
    done, result = 0, None
    while left:
        if left & 1:
            if result is None:
                result, done = value, have
            else:
                n = len(buf) - done - have + 1
                result, done = result[:n] * power + value[done : done + n], done + have
        left >>= 1
        if left:
            n = len(value) - have
            value, power, have = value[:n] * power + value[have : have + n], power * power, 2 * have
    result = (result ^ (result >> np.uint64(29))) * _MULTIPLIER
    return result ^ (result >> np.uint64(32))


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values


def runs(buf: np.ndarray, owner: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts of a buffer: first and last start of their strings, and the anchor's hash.

    ``owner`` tells the text that each byte is of; no string crosses texts.
    """
    n = len(buf) - plan.length + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 3
    hashes = _rolling(buf, plan.seed)
    packed = (hashes & ~np.uint64((1 << _POS_BITS) - 1)) | np.arange(len(hashes), dtype=np.uint64)
    anchor = (_sliding_min(packed, plan.length - plan.seed + 1) & np.uint64((1 << _POS_BITS) - 1)).astype(np.int64)
    inside = owner[:n] == owner[plan.length - 1 :]
    heads = np.flatnonzero(inside & np.r_[True, (anchor[1:] != anchor[:-1]) | ~inside[:-1]])
    tails = np.flatnonzero(inside & np.r_[(anchor[1:] != anchor[:-1]) | ~inside[1:], True])
    return heads, tails, hashes[anchor[heads]].view(np.int64)


def _chunks(docs: pd.DataFrame, plan: Plan) -> Iterator[tuple[np.ndarray, bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Contexts of a group, by buffers of bounded size: text's number and offset of each byte range, and its runs.

    Yields (rows of docs, their bytes, offset of each row in its text, start in the buffer, heads, tails, keys).
    """
    most = 1 << 20
    texts = [(t or "").encode() for t in docs["text"]]
    pending, size = [], 0
    pieces = ((i, at, t[at : at + most + plan.length - 1]) for i, t in enumerate(texts) for at in range(0, max(1, len(t) - plan.length + 1), most))

    def flush():
        data = b"".join(p for _, _, p in pending)
        lengths = np.array([len(p) for _, _, p in pending], np.int64)
        starts = np.cumsum(lengths) - lengths
        buf = np.frombuffer(data, np.uint8)
        heads, tails, keys = runs(buf, np.repeat(np.arange(len(pending)), lengths), plan)
        return np.array([i for i, _, _ in pending]), data, np.array([a for _, a, _ in pending]), starts, heads, tails, keys

    for piece in pieces:
        pending.append(piece)
        size += len(piece[2])
        if size > most:
            yield flush()
            pending, size = [], 0
    if pending:
        yield flush()


def _sorted_docs(docs: pd.DataFrame) -> pd.DataFrame:
    docs = docs.assign(text=[t if isinstance(t, str) else "" for t in docs["text"]])
    return docs.sort_values(["place"], kind="stable")


def _without(docs: pd.DataFrame, copies: pd.DataFrame) -> pd.DataFrame:
    """``docs`` without those that are copies of an earlier document."""
    if not len(copies) or not len(docs):
        return docs
    known = set(zip(copies["place"].tolist(), copies["digest"], strict=True))
    return docs[[x not in known for x in zip(docs["place"].tolist(), docs["digest"], strict=True)]]


def anchors_of(docs: pd.DataFrame, plan: Plan) -> pd.DataFrame:
    """key and told of every anchor of a group; told holds the group, the times, and if several documents have it."""
    if not len(docs):
        return pd.DataFrame({"key": np.empty(0, np.int64), "told": np.empty(0, np.int64)})
    docs = _sorted_docs(docs)
    places = docs["place"].to_numpy(np.int64)
    keys, at = [], []
    for rows, _, _, starts, heads, _, found in _chunks(docs, plan):
        keys.append(found)
        at.append(places[rows[np.searchsorted(starts, heads, side="right") - 1]] if len(heads) else np.empty(0, np.int64))
    keys, at = np.concatenate(keys), np.concatenate(at)
    order = np.argsort(keys, kind="stable")
    keys, at = keys[order], at[order]
    cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    lo, hi = (f.reduceat(at, cuts) if len(cuts) else at for f in (np.minimum, np.maximum))
    times = np.minimum(np.diff(np.r_[cuts, len(keys)]), _MOST_TIMES)
    return pd.DataFrame({"key": keys[cuts], "told": (np.int64(docs["group"].iloc[0]) << _TOLD_BITS) | (times << 1) | (lo < hi)})


def _contexts(docs: pd.DataFrame, keys: np.ndarray, crowded: np.ndarray, plan: Plan) -> Iterator[tuple]:
    """(row, (key, anchor if it is another, crowded), bytes, start in the text) of every context whose anchor is in the sorted ``keys``; of crowded ones, of every string."""
    for rows, data, offsets, starts, heads, tails, found in _chunks(docs, plan):
        at = np.minimum(np.searchsorted(keys, found), max(0, len(keys) - 1))
        hit = np.flatnonzero(keys[at] == found) if len(keys) else at[:0]
        piece = np.searchsorted(starts, heads[hit], side="right") - 1
        within = heads[hit] - starts[piece] + offsets[piece]
        for row, a, b, key, full, start in zip(rows[piece].tolist(), heads[hit].tolist(), tails[hit].tolist(), found[hit].tolist(), crowded[at[hit]].tolist(), within.tolist(), strict=True):
            if not full:
                yield row, (key, 0, False), data[a : b + plan.length], start
                continue
            for j in range(a, b + 1):
                one = data[j : j + plan.length]
                yield row, (xxhash.xxh3_64_intdigest(one) - (1 << 63), key, True), one, start + j - a


def contexts_of(docs: pd.DataFrame, wanted: pd.DataFrame, plan: Plan) -> pd.DataFrame:
    """key, anchor, context, told, lo: a group's distinct contexts under the wanted anchors, with their first document.

    Rows are narrow, for they cross an exchange: told holds the group, if the anchor is crowded, and if
    several documents have the context.
    """
    first: dict[tuple, int] = {}
    several: set[tuple] = set()
    if len(docs) and len(wanted):
        docs, wanted = _sorted_docs(docs), wanted.sort_values("key")
        places = docs["place"].tolist()
        for row, of, context, _ in _contexts(docs, wanted["key"].to_numpy(np.int64), wanted["crowded"].to_numpy(bool), plan):
            if first.setdefault((of, context), places[row]) < places[row]:
                several.add((of, context))
    keys = np.array([of for of, _ in first], np.int64).reshape(-1, 3)
    group = int(docs["group"].iloc[0]) if len(docs) else 0
    told = (group << 2) | (keys[:, 2] << 1) | np.fromiter((x in several for x in first), np.int64)
    return pd.DataFrame({"key": keys[:, 0], "anchor": keys[:, 1], "context": [c for _, c in first], "told": told, "lo": np.fromiter(first.values(), np.int64)})


def _earlier(contexts: list[bytes], first: np.ndarray, plan: Plan) -> list[int]:
    """For each distinct context the mask of its strings that start in a document before ``first`` of it, among these contexts."""
    lengths = np.array([len(c) + 1 for c in contexts], np.int64)
    starts = np.cumsum(lengths) - lengths
    text = np.r_[np.frombuffer(b"\0".join(contexts), np.uint8).astype(np.int64) + 2, 1, 0]
    text[starts[1:] - 1] = 1  # between two
    owner = np.repeat(np.arange(len(contexts)), lengths)
    order = suffix_array(text, 258)
    shared = common_prefixes(text, order, plan.length)
    inside = order < len(owner)
    inside[inside] = order[inside] + plan.length < starts[owner[order[inside]]] + lengths[owner[order[inside]]]
    begins = order[inside]
    # the least prefix shared on the way from one of them to the next
    at = np.flatnonzero(inside)
    cuts = np.flatnonzero(np.r_[True, np.minimum.reduceat(shared[: at[-1] + 1], np.r_[0, at[:-1] + 1])[1:] < plan.length])
    earliest = np.repeat(np.minimum.reduceat(first[owner[begins]], cuts), np.diff(np.r_[cuts, len(begins)]))
    masks = [0] * len(contexts)
    hit = earliest < first[owner[begins]]
    for c, j in zip(owner[begins[hit]].tolist(), (begins[hit] - starts[owner[begins[hit]]]).tolist(), strict=True):
        masks[c] |= 1 << j
    return masks


def matches_of(shard: pd.DataFrame, plan: Plan, parts: bool = False) -> pd.DataFrame:
    """group, kind, key, anchor, digest, lo, mask, several of each context of a shard; mask -1 stands for all its strings.

    With ``parts``, crowded strings are in other shards as well, and all of them come back.
    """
    keys, told = shard["key"].to_numpy(np.int64), shard["told"].to_numpy(np.int64)
    lo, texts = shard["lo"].to_numpy(np.int64), shard["context"].tolist()
    number: dict[tuple, int] = {}
    which = np.fromiter((number.setdefault(x, len(number)) for x in zip(keys.tolist(), texts, strict=True)), np.int64, len(texts))
    first = np.full(len(number), _LAST)
    np.minimum.at(first, which, lo)
    of_key = np.array([k for k, _ in number], np.int64)
    _, inverse, counts = np.unique(of_key, return_inverse=True, return_counts=True)
    several = np.flatnonzero(counts[inverse] > 1)  # an anchor with one context has nothing else to match
    mask = np.zeros(len(number), np.int64)
    if len(several):
        names = [*number]
        mask[several] = _earlier([names[i][1] for i in several.tolist()], first[several], plan)
    own = np.where(lo > first[which], np.int64(-1), mask[which])
    crowded = told & 2 != 0
    keep = np.flatnonzero((own != 0) | (told & 1 == 1) | (crowded if parts else False))
    return pd.DataFrame({"group": told[keep] >> 2, "kind": np.where(crowded[keep], _CROWDED, _USUAL).astype(np.int32), "key": keys[keep], "anchor": shard["anchor"].to_numpy(np.int64)[keep], "digest": [xxhash.xxh3_128_digest(texts[i]) for i in keep.tolist()], "lo": lo[keep], "mask": own[keep], "several": told[keep] & 1 == 1})


def removed_of(docs: pd.DataFrame, found: pd.DataFrame, plan: Plan, with_text: bool = False) -> pd.DataFrame:
    docs = _sorted_docs(docs) if len(docs) else docs
    texts = [t.encode() for t in docs["text"]]
    places = docs["place"].tolist()
    marks = [None] * len(texts)
    known = {(k, d): (lo, mask) for k, d, lo, mask in zip(found["key"].tolist(), map(bytes, found["digest"]), found["lo"].tolist(), found["mask"].tolist(), strict=True)}
    if known:
        crowded = found["kind"].to_numpy() == _CROWDED
        anchors, at = np.unique(np.where(crowded, found["anchor"].to_numpy(np.int64), found["key"].to_numpy(np.int64)), return_index=True)
        for row, (key, _, _), context, start in _contexts(docs, anchors, crowded[at], plan):
            hit = known.get((key, xxhash.xxh3_128_digest(context)))
            if hit is None:
                continue
            mask = -1 if places[row] > hit[0] else hit[1]
            if not mask:
                continue
            if marks[row] is None:
                marks[row] = np.zeros(len(texts[row]) + 1, np.int32)
            if mask == -1:
                marks[row][start] += 1
                marks[row][start + len(context)] -= 1
                continue
            for j in range(len(context) - plan.length + 1):
                if mask >> j & 1:
                    marks[row][start + j] += 1
                    marks[row][start + j + plan.length] -= 1
    rows = []
    for text, mark in zip(texts, marks, strict=True):
        removed = np.cumsum(mark[:-1]) > 0 if mark is not None else np.zeros(0, bool)
        kept = np.frombuffer(text, np.uint8)[~removed].tobytes() if mark is not None else text
        spans = int(removed[:1].sum() + (removed[1:] & ~removed[:-1]).sum())
        rows.append((len(text), int(removed.sum()), spans, hashlib.sha256(kept).hexdigest(), *([kept] if with_text else [])))
    made = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])], index=docs.index)
    return pd.concat([docs[["doc_id"]], made], axis=1)


def removed_whole(docs: pd.DataFrame, plan: Plan, with_text: bool = False) -> pd.DataFrame:
    """Of copies: all is gone, but texts too short for a match stay."""
    rows = []
    for text in (t.encode() for t in docs["text"]):
        kept = text if len(text) < plan.length else b""
        rows.append((len(text), len(text) - len(kept), int(len(kept) < len(text)), hashlib.sha256(kept).hexdigest(), *([kept] if with_text else [])))
    made = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])], index=docs.index)
    return pd.concat([docs[["doc_id"]], made], axis=1)


def _copies(dealt: DataFrame) -> DataFrame:
    """group, place, digest of the documents whose whole text an earlier one has."""
    light = dealt.select("group", "place", "digest")
    first = light.groupBy("digest").agg(F.min("place").alias("first"), F.max("place").alias("last")).where(F.col("first") < F.col("last"))
    return light.join(first.select("digest", "first"), "digest").where(F.col("place") > F.col("first")).select("group", "place", "digest").distinct()


def deduplicated(docs: DataFrame, plan: Plan = Plan(), *, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; with ``with_text`` the kept bytes.

    The texts cross one exchange, into groups of some ``group_bytes``, and are read from it three times.
    """
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes")).first()
    groups = max(1, -(-(size.bytes or 0) // plan.group_bytes))
    shards = max(1, -(-(size.bytes or 0) // plan.shard_bytes))
    place = F.coalesce(F.col("doc_id"), F.lit(_LAST)).cast("long")
    text = F.coalesce("text", F.lit(""))
    dealt = docs.select(id_text(), place.alias("place"), text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("digest"), F.pmod(F.xxhash64("doc_id", F.md5(text.cast("binary"))), F.lit(groups)).alias("group"))
    copies = cut(_copies(dealt)).toDF("group", "place", "digest")  # names of its own, apart from those of the texts
    in_groups, copied = dealt.groupBy("group"), copies.groupBy("group")
    anchors = in_groups.cogroup(copied).applyInPandas(lambda a, b: anchors_of(_without(a, b), plan), "key long, told long")
    parts = -(-groups // plan.part_groups)
    times = F.shiftright("told", 1).bitwiseAND(F.lit(_MOST_TIMES))
    of_key = {"groups": F.count(F.lit(1)), "several": F.max(F.col("told").bitwiseAND(F.lit(1))), "all": F.sum(times)}
    if parts == 1:  # an anchor has a row a group, so its window has ``part_groups`` rows at most
        seen = anchors.withColumns({c: x.over(Window.partitionBy("key")) for c, x in of_key.items()})
    else:  # combined before the shuffle and joined back, in a join that can be split
        anchors = cut(anchors)
        seen = anchors.join(anchors.groupBy("key").agg(*(x.alias(c) for c, x in of_key.items())).where((F.col("groups") > 1) | (F.col("several") == 1)), "key")
    zero = F.lit(0).cast("long")
    wanted = seen.where((F.col("groups") > 1) | (F.col("several") == 1)).select(F.shiftright("told", _TOLD_BITS).alias("group"), F.when(F.col("all") > plan.crowded, _CROWDED).otherwise(_USUAL).alias("kind"), "key", F.lit(b"").alias("digest"))
    marks = copies.select("group", F.lit(_COPY).alias("kind"), F.col("place").alias("key"), "digest")

    def gather(texts: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        copy = told["kind"].to_numpy() == _COPY
        wanted = told[~copy]
        return contexts_of(_without(texts, told[copy].rename(columns={"key": "place"})), wanted.assign(crowded=wanted["kind"] == _CROWDED), plan)

    contexts = in_groups.cogroup(wanted.unionByName(marks).groupBy("group")).applyInPandas(gather, "key long, anchor long, context binary, told long, lo long")
    salt = F.when(F.col("told").bitwiseAND(F.lit(2)) != 0, F.pmod(F.shiftright("told", 2), F.lit(parts))).otherwise(zero)
    shard = F.pmod(F.xxhash64("key", salt) if parts > 1 else F.xxhash64("key"), F.lit(shards)).alias("shard")
    found = contexts.groupBy(shard).applyInPandas(lambda pdf: matches_of(pdf, plan, parts > 1), "group long, kind int, key long, anchor long, digest binary, lo long, mask long, several boolean")
    if parts > 1:
        # a crowded string's first document over all its shards
        found = cut(found)
        crowded = F.col("kind") == _CROWDED
        least = found.where(crowded).groupBy(F.col("key").alias("of_key"), F.col("digest").alias("of_digest")).agg(F.min("lo").alias("least"))
        judged = found.where(crowded).join(least, (F.col("key") == F.col("of_key")) & (F.col("digest") == F.col("of_digest")))
        judged = judged.withColumn("mask", F.when(F.col("lo") > F.col("least"), F.lit(-1).cast("long")).otherwise(F.col("mask"))).select(*found.columns)
        found = found.where(~crowded).unionByName(judged).where((F.col("mask") != 0) | F.col("several"))
    found = found.drop("several")
    # no nulls, which pandas would make floats
    answers = found.unionByName(marks.withColumns({c: zero for c in ("anchor", "lo", "mask")}))

    def remove(texts: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        copy = told["kind"].to_numpy() == _COPY
        new = _without(texts, told[copy].rename(columns={"key": "place"}))
        made = [removed_of(new, told[~copy], plan, with_text)]
        if len(new) < len(texts):
            made.append(removed_whole(texts[~texts.index.isin(new.index)], plan, with_text))
        return pd.concat(made)

    schema = "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return id_back(in_groups.cogroup(answers.groupBy("group")).applyInPandas(remove, schema))
