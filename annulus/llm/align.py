"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Both tokenizers' tokens cut the same bytes. Tokens link where their byte ranges overlap, and offsets where
both end cut them into groups. In a task the tokens of many documents lie in two flat arrays of byte
ends; one state vector holds each document's pair of pointers, and every step advances all of them at
once: a step emits a link for each document, moves the pointer whose token ends first (both at a
cut), and drops finished documents from the state. Long documents enter the state as several lanes, from
one common end to another, so that steps don't grow with the longest text.

``tokenized`` encodes once and writes the ids; ``links`` and ``report`` merge from the written ids. The
count of a pair of ids is the number of links of the corpus that hold it. Counts are combined within tasks
before they are shuffled; where they are looked up, they are sent to the tasks in slices of a bounded
number of pairs, one pass over the ids for each, so no hot pair meets in one task.

Edge cases: texts that are null or empty, or whose tokens' bytes aren't a space and the text, have no
tokens. Strings of special tokens are plain text. Repeated rows and ids each have their own result, and
their links each count. Very long texts are merged whole. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path
from .bpe import PATTERN, Encoder, Vocabulary
from .common import by_bytes, cut

#: Tokens of a lane, about.
LANE = 512
#: Pairs whose counts are sent to the tasks at a time: 17 bytes each.
SLICE = 2_000_000
_SHIFT = 32
_TOKENS_AT_ONCE = 250_000
#: A run that the public encoder would take long for goes through the batched merge rounds.
_LONG_RUN = re.compile(r"\S{4000}|\s{4000}")


class Tokenizers:
    """A byte-level vocabulary (A) and a sentencepiece model (B), and the bytes of each of their ids."""

    def __init__(self, byte_level_path: str, pieces_path: str):
        self.vocabulary = Vocabulary(byte_level_path)
        self.special, self.vocabulary.special = set(self.vocabulary.special.values()), {}  # their strings are plain text here
        with open(pieces_path, "rb") as f:
            self.model = f.read()
        starts, lengths = self.vocabulary.token_starts.tolist(), self.vocabulary.token_lengths.tolist()
        self.of_a = [self.vocabulary.token_bytes[s : s + n].tobytes() for s, n in zip(starts, lengths, strict=True)]
        pieces = self.pieces()
        self.of_b = [bytes([int(pieces.id_to_piece(i)[3:-1], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("\u2581", " ").encode() for i in range(pieces.get_piece_size())]
        self.lengths = tuple(np.array([len(t) for t in of], np.int64) for of in (self.of_a, self.of_b))
        self.kinds = tuple("<u2" if len(of) <= 1 << 16 else "<u4" for of in (self.of_a, self.of_b))

    def pieces(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.model)

    def byte_level(self) -> Callable[[str], list[int]]:
        """Encodes a text with the vocabulary's tokens as ranks: its ids are in the order of its merges."""
        import tiktoken

        ranks = {t: i for i, t in enumerate(self.of_a) if t and i not in self.special}
        encode = tiktoken.Encoding("byte_level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        rounds = Encoder(self.vocabulary)
        return lambda text: rounds.encode_batch([text])[0].tolist() if _LONG_RUN.search(text) else encode(text)


def tokenized(docs: DataFrame, tokenizers: Tokenizers) -> DataFrame:
    """row, doc_id, a, b: both tokenizers' ids as little-endian integers of ``kinds``, written below the shared folder.

    No ids where their bytes aren't the text's.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(tokenizers)  # as large as their files

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        encode, pieces = known.byte_level(), known.pieces()
        for batch in batches:
            for some in by_bytes(batch, 1 << 20):
                found: tuple[list[bytes], list[bytes]] = ([], [])
                for text in some.column("text").to_pylist():
                    whole = b" " + text.encode() if text else b""
                    ids = (encode(" " + text), pieces.encode(text)) if text else ([], [])
                    if any(b"".join(map(of.__getitem__, x)) != whole for of, x in zip((known.of_a, known.of_b), ids, strict=True)):
                        ids = ([], [])
                    for column, kind, x in zip(found, known.kinds, ids, strict=True):
                        column.append(np.array(x, kind).tobytes())
                yield pa.RecordBatch.from_arrays([some.column("row"), some.column("doc_id"), *(pa.array(x, pa.binary()) for x in found)], names=["row", "doc_id", "a", "b"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    path = scratch_path(spark, "tokens")
    rows.mapInArrow(run, "row long, doc_id long, a binary, b binary").write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def lanes(ends_a: np.ndarray, ends_b: np.ndarray, counts_a: np.ndarray, counts_b: np.ndarray, length: int = LANE) -> tuple[np.ndarray, ...]:
    """Where lanes begin among the tokens of A and of B, and where each ends among those of A.

    A lane is a document; one of over ``length`` tokens is dealt into several, at the first end common to both
    tokenizers after every ``length`` tokens.
    """
    stop_a, stop_b = np.cumsum(counts_a), np.cumsum(counts_b)
    starts_a, starts_b = [stop_a - counts_a], [stop_b - counts_b]
    for d in np.flatnonzero(counts_a > length):
        own = np.arange(stop_a[d] - counts_a[d], stop_a[d] - 1)
        place = np.searchsorted(ends_b, ends_a[own])
        both = np.flatnonzero(ends_b[place] == ends_a[own])
        after = np.searchsorted(both, np.arange(length, len(own), length))
        cuts = np.unique(both[after[after < len(both)]])
        starts_a.append(own[cuts] + 1)
        starts_b.append(place[cuts] + 1)
    first_a, first_b = np.concatenate(starts_a), np.concatenate(starts_b)
    stops = np.concatenate([stop_a, *starts_a[1:]])
    full = np.concatenate([counts_a > 0, np.ones(len(first_a) - len(counts_a), bool)])
    first_a, first_b = np.sort(first_a[full]), np.sort(first_b[full])  # both in the order of the text
    return first_a, first_b, np.sort(stops[full])


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray, stop_a: np.ndarray) -> tuple[np.ndarray, ...]:
    """Links as places (i, j) in the order of the text, and for each whether a group ends with it.

    Each step takes the pointers of all lanes that aren't finished.
    """
    i, j, stop = first_a, first_b, stop_a
    steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(i):
        a, b = ends_a[i], ends_b[j]
        steps.append((i, j, a == b))
        i, j = i + (a <= b), j + (b <= a)
        going = i < stop
        if not going.all():
            i, j, stop = i[going], j[going], stop[going]
    if not steps:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    i, j, cut_here = (np.concatenate(x) for x in zip(*steps, strict=True))
    order = np.full(len(ends_a) + len(ends_b), -1)
    order[i + j] = np.arange(len(i))  # of two links of the whole batch the later one has the larger sum
    order = order[order >= 0]
    return i[order], j[order], cut_here[order]


def _flat(column: pa.BinaryArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows, and how many each has."""
    sizes = pc.binary_length(column).to_numpy().astype(np.int64) // np.dtype(kind).itemsize
    return np.frombuffer(b"".join(column.to_pylist()), kind).astype(np.int64), sizes


def _merged(batch: pa.RecordBatch, sent: tuple) -> tuple[np.ndarray, ...]:
    """Flat ids of A and B, how many each row has, and the links of the batch."""
    lengths, kinds = sent
    (a, na), (b, nb) = (_flat(batch.column(c), kind) for c, kind in zip(("a", "b"), kinds, strict=True))
    ends_a, ends_b = np.cumsum(lengths[0][a]), np.cumsum(lengths[1][b])
    return a, b, na, nb, *lockstep(ends_a, ends_b, *lanes(ends_a, ends_b, na, nb))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bounded number of tokens at a time, whole rows."""
    for batch in batches:
        yield from by_bytes(batch, 2 * _TOKENS_AT_ONCE, "a")


def links(tokens: DataFrame, tokenizers: Tokenizers) -> DataFrame:
    """row, doc_id, i, j (arrays: places of linked tokens in a and b, in the order of the text) and ends_group for each link."""
    shared = tokens.sparkSession.sparkContext.broadcast((tokenizers.lengths, tokenizers.kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _slices(batches):
            _, _, na, nb, i, j, ends = _merged(some, shared.value)
            row = np.repeat(np.arange(len(na)), na)[i]
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(na)))]).astype(np.int32))
            before_a, before_b = np.cumsum(na) - na, np.cumsum(nb) - nb
            arrays = (pa.array((i - before_a[row]).astype(np.int32)), pa.array((j - before_b[row]).astype(np.int32)), pa.array(ends))
            yield pa.RecordBatch.from_arrays([some.column("row"), some.column("doc_id"), *(pa.ListArray.from_arrays(offsets, x) for x in arrays)], names=["row", "doc_id", "i", "j", "ends_group"])

    return tokens.select("row", "doc_id", "a", "b").mapInArrow(run, "row long, doc_id long, i array<int>, j array<int>, ends_group array<boolean>")


def pair_counts(tokens: DataFrame, tokenizers: Tokenizers) -> DataFrame:
    """a, b, links, best: for each pair of linked ids the links of the corpus that hold it, and whether no pair of b has more."""
    shared = tokens.sparkSession.sparkContext.broadcast((tokenizers.lengths, tokenizers.kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, waiting = [], [], 0
        for some in _slices(batches):
            a, b, _, _, i, j, _ = _merged(some, shared.value)
            key, n = np.unique((a[i] << _SHIFT) | b[j], return_counts=True)
            keys.append(key)
            counts.append(n)
            waiting += len(key)
            if waiting > 4 * _TOKENS_AT_ONCE:
                yield _summed(keys, counts)
                keys, counts, waiting = [], [], 0
        if keys:
            yield _summed(keys, counts)

    def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        key, of = np.unique(np.concatenate(keys), return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.bincount(of, np.concatenate(counts), len(key)).astype(np.int64))], names=["key", "links"])

    parts = tokens.select("a", "b").mapInArrow(run, "key long, links long")
    each = cut(parts.groupBy("key").agg(F.sum("links").alias("links")).withColumn("b", F.col("key").bitwiseAND(F.lit((1 << _SHIFT) - 1)).cast("int")))
    top = each.groupBy("b").agg(F.max("links").alias("most"))  # as many rows as the vocabulary has ids
    return each.join(top, "b").select(F.shiftright("key", _SHIFT).cast("int").alias("a"), "b", "links", (F.col("links") == F.col("most")).alias("best"))


def _groups(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, ends: np.ndarray, names: list[str]) -> str:
    """a1,a2|b1;a3|b2,b3 of one document's ids, from the places where its groups end."""
    last_a, last_b = i[ends], j[ends]
    ends_a, ends_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    ends_a[last_a], ends_b[last_b] = 1, 2
    group_a, group_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b > 0) - (ends_b > 0)
    told = np.empty(len(a) + len(b), np.int64)  # id and what follows it
    told[np.arange(len(a)) + np.concatenate([[0], last_b + 1])[group_a]] = 3 * a + ends_a
    told[np.arange(len(b)) + (last_a + 1)[group_b]] = 3 * b + ends_b
    return "".join(map(names.__getitem__, told.tolist()))[:-1]


def _scored(tokens: DataFrame, lengths: Broadcast, counts: Broadcast, whole: bool) -> DataFrame:
    """What each row's links add up to under one slice of the counts; with ``whole`` also what doesn't depend on them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, best = counts.value
        names = [f"{t}{mark}" for t in range(max(map(len, lengths.value[0]))) for mark in ",|;"] if whole else []
        for some in _slices(batches):
            a, b, na, nb, i, j, ends = _merged(some, lengths.value)
            row, total = np.repeat(np.arange(len(na)), na)[i], len(na)
            key = (a[i] << _SHIFT) | b[j]
            place = np.minimum(np.searchsorted(known, key), max(0, len(known) - 1))
            here = known[place] == key if len(known) else np.zeros(len(key), bool)
            stop = np.cumsum(np.bincount(row, minlength=total))
            # sums of a row's links, as differences of running sums
            sums, n_best = (np.diff(np.concatenate([[0], np.cumsum(np.where(here, of[place], 0) if len(known) else np.zeros(len(key), np.int64))])[np.r_[0, stop]]) for of in (held, best.astype(np.int64)))
            columns = [some.column("row"), some.column("doc_id"), pa.array(n_best), pa.array(sums)]
            if whole:
                stop_a, stop_b = np.cumsum(na), np.cumsum(nb)
                digests = []
                for d in range(total):
                    f, g = stop_a[d] - na[d], stop_b[d] - nb[d]
                    own = slice(stop[d - 1] if d else 0, stop[d])
                    digests.append(hashlib.sha256(_groups(a[f : stop_a[d]], b[g : stop_b[d]], i[own] - f, j[own] - g, ends[own], names).encode()).hexdigest() if na[d] else "")
                n_groups = np.bincount(row, ends, total).astype(np.int64)
                columns += [pa.array(x) for x in (na, nb, n_groups, np.bincount(row, minlength=total))] + [pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[c.partition(" ")[0] for c in schema.split(", ")])

    schema = "row long, doc_id long, n_best long, count_sum long" + ", n_a long, n_b long, n_groups long, n_links long, groups_sha256 string" * whole
    return tokens.mapInArrow(run, schema)


def report(tokens: DataFrame, tokenizers: Tokenizers, most: int = SLICE) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of ``tokens``, a written table."""
    context = tokens.sparkSession.sparkContext
    lengths, counts = context.broadcast((tokenizers.lengths, tokenizers.kinds)), cut(pair_counts(tokens, tokenizers))
    parts = max(1, math.ceil(counts.count() / most))
    found = None
    for nth in range(parts):
        some = counts.where(F.pmod(F.xxhash64("a", "b"), F.lit(parts)) == nth) if parts > 1 else counts
        held = some.select((F.shiftleft(F.col("a").cast("long"), _SHIFT).bitwiseOR(F.col("b").cast("long"))).alias("key"), "links", "best").toArrow().sort_by("key")
        sent = context.broadcast(tuple(held[c].to_numpy() for c in ("key", "links", "best")))
        one = _scored(tokens.select("row", "doc_id", "a", "b"), lengths, sent, nth == 0)
        found = one if found is None else found.unionByName(one, allowMissingColumns=True)
    if parts > 1:
        rest = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
        found = found.groupBy("row").agg(*(F.sum(c).alias(c) for c in ("n_best", "count_sum")), *(F.max(c).alias(c) for c in rest))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
