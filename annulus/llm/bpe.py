"""Byte-level BPE: encoding by batched numpy merge rounds, and decoding.

The vocabulary file is read once on the driver and sent to the tasks as arrays; its size, not the
data's, bounds the broadcast. In a task, texts are split by the public pattern and each distinct
piece is merged once: the symbols of all new pieces of a batch lie in one flat array, and each round
looks up every adjacent pair in the sorted pair keys by binary search, takes each piece's lowest
rank and joins all its occurrences. Pieces that no pair fits drop out of the rounds.

Edge cases: a null text counts as empty and gives no tokens; repeated rows give repeated results; a
very long text is split piece by piece in chunks, so memory stays bounded. Only doc_id and text are
read, so other columns can have any name.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import id_back, id_text

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_NONE = np.iinfo(np.int64).max
_WIDTH = np.int64(1 << 32)


def _byte_characters() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of all the ranges, one after another."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)


class Vocabulary:
    """Merge table and token bytes as arrays, from a tokenizers JSON file of the byte-level kind."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte, ids = _byte_characters(), spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = {i: bytes(to_byte[c] for c in t) for t, i in ids.items()} | {i: t.encode() for t, i in special.items()}
        self.special = special
        self.byte_ids = np.empty(256, np.int64)
        for c, b in to_byte.items():
            self.byte_ids[b] = ids[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([ids[a] * int(_WIDTH) + ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.joined = np.array([ids[a + b] for a, b in pairs], np.int64)  # by rank
        lengths = np.array([len(tokens.get(i, b"")) for i in range(max(tokens) + 1)], np.int64)
        self.token_lengths, self.token_starts = lengths, np.cumsum(lengths) - lengths
        self.token_bytes = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(len(lengths))), np.uint8)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the pieces in one flat array, and how many each piece has."""
        lengths = np.array([len(p) for p in pieces], np.int64)
        symbols = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        ranks = self._pair_ranks(symbols, owner, np.arange(len(symbols)))  # of each symbol with the next one
        while len(symbols):
            heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[heads, len(owner)])
            lowest = np.minimum.reduceat(ranks, heads)
            if (lowest == _NONE).any():  # their symbols are final
                active = np.repeat(lowest < _NONE, sizes)
                done.append((symbols[~active], owner[~active]))
                symbols, owner, ranks = symbols[active], owner[active], ranks[active]
                lowest, sizes = lowest[lowest < _NONE], sizes[lowest < _NONE]
            place = np.flatnonzero(ranks == np.repeat(lowest, sizes))
            run = np.flatnonzero(np.r_[True, np.diff(place) != 1][: len(place)])  # of overlapping pairs, every second one counts
            nth = np.arange(len(place)) - np.repeat(run, np.diff(np.r_[run, len(place)]))
            place = place[nth % 2 == 0]
            symbols[place] = self.joined[ranks[place]]
            keep = np.ones(len(symbols), bool)
            keep[place + 1] = False
            changed = (np.cumsum(keep) - 1)[place]
            symbols, owner, ranks = symbols[keep], owner[keep], ranks[keep]
            changed = np.r_[changed, changed[changed > 0] - 1]
            ranks[changed] = self._pair_ranks(symbols, owner, changed)
        return self._collected(done, len(pieces))

    def _pair_ranks(self, symbols: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The rank of the pair that begins at each place; _NONE if no merge fits it or its piece ends there."""
        last = at == len(symbols) - 1
        after = np.where(last, at, at + 1)
        keys = symbols[at] * _WIDTH + symbols[after]
        found = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[found] == keys) & (owner[at] == owner[after]) & ~last, self.ranks[found], _NONE)

    @staticmethod
    def _collected(done: list, n: int) -> tuple[np.ndarray, np.ndarray]:
        symbols, owner = (np.concatenate(x) if x else np.empty(0, np.int64) for x in zip(*done, strict=True)) if done else (np.empty(0, np.int64),) * 2
        order = np.argsort(owner, kind="stable")
        return symbols[order].astype(np.uint32), np.bincount(owner.astype(np.int64), minlength=n)

    def decode(self, ids: np.ndarray) -> str:
        ids = ids.astype(np.int64)
        return self.token_bytes[_ranges(self.token_starts[ids], self.token_lengths[ids])].tobytes().decode("utf-8", "replace")


class Encoder:
    """Encodes texts, remembering the pieces it has merged; forgets them at ``most`` pieces."""

    def __init__(self, vocabulary: Vocabulary, most: int = 300_000, chunk: int = 200_000):
        self.vocabulary, self.most, self.chunk = vocabulary, most, chunk
        self.split = regex.compile(PATTERN)
        self.special = regex.compile("|".join(map(regex.escape, vocabulary.special))) if vocabulary.special else None
        self.forget()

    def forget(self) -> None:
        self.code: dict[str, int] = {}
        self.starts = self.lengths = np.empty(0, np.int64)
        self.flat = np.empty(0, np.uint32)

    def _pieces(self, text: str) -> Iterator[list[str]]:
        if len(text) <= self.chunk:
            yield self.split.findall(text)
            return
        found = (m[0] for m in self.split.finditer(text))
        while some := list(itertools.islice(found, self.chunk)):
            yield some

    def _learn(self, pieces: list[str]) -> None:
        """Merges the pieces that are new. May forget all others."""
        distinct = dict.fromkeys(pieces)
        new = [p for p in distinct if p not in self.code]
        if len(self.code) + len(new) > self.most and self.code:
            self.forget()
            new = list(distinct)
        if new:
            flat, counts = self.vocabulary.merge([p.encode() for p in new])
            self.code.update(zip(new, range(len(self.code), len(self.code) + len(new)), strict=True))
            self.starts = np.r_[self.starts, len(self.flat) + np.cumsum(counts) - counts]
            self.lengths, self.flat = np.r_[self.lengths, counts], np.r_[self.flat, flat]

    def _known(self, pieces: list[str]) -> np.ndarray:
        codes = np.fromiter(map(self.code.__getitem__, pieces), np.int64, len(pieces))
        return self.flat[_ranges(self.starts[codes], self.lengths[codes])]

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. Short texts share a round of merges."""
        out: list[np.ndarray] = []
        group: list[list[str]] = []
        waiting = 0

        def flush() -> None:
            nonlocal waiting
            self._learn([p for g in group for p in g])
            out.extend(map(self._known, group))
            group.clear()
            waiting = 0

        for text in texts:
            plain = self.special is None or not any(s in text for s in self.vocabulary.special)
            if plain and len(text) <= self.chunk:
                group.append(self.split.findall(text))
                waiting += len(text)
                if waiting > 4 * self.chunk:
                    flush()
                continue
            flush()
            out.append(self._long(text))
        flush()
        return out

    def _long(self, text: str) -> np.ndarray:
        parts, at = [], 0
        marks = [] if self.special is None else [*self.special.finditer(text)]
        for m in [*marks, None]:
            for pieces in self._pieces(text[at : m.start() if m else len(text)]):
                self._learn(pieces)
                parts.append(self._known(pieces))
            if m:
                parts.append(np.array([self.vocabulary.special[m[0]]], np.uint32))
                at = m.end()
        return np.concatenate([np.empty(0, np.uint32), *parts])


def encode(docs: DataFrame, vocabulary_path: str, *, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and with ``with_ids`` the ids and the decoded text."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary_path))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(shared.value)
        for batch in batches:
            rows = []
            for at in range(0, len(batch), 256):
                some = [t if isinstance(t, str) else "" for t in batch["text"].iloc[at : at + 256]]
                for ids in encoder.encode_batch(some):
                    text = encoder.vocabulary.decode(ids)
                    rows.append((len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), *((ids.astype(np.int64), text) if with_ids else ())))
            made = pd.DataFrame(rows, columns=names, index=batch.index)
            yield pd.concat([batch[["doc_id"]], made], axis=1)

    names = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if with_ids else [])]
    schema = "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded string" * with_ids
    return id_back(docs.select(id_text(), "text").mapInPandas(run, schema))


def decode(spark: SparkSession, encoded: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id and text from doc_id and ids; null ids give a null text."""
    shared = spark.sparkContext.broadcast(Vocabulary(vocabulary_path))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["text"] = [None if ids is None else shared.value.decode(np.asarray(ids)) for ids in batch["ids"]]
            yield batch[["doc_id", "text"]]

    return id_back(encoded.select(id_text(), "ids").mapInPandas(run, "doc_id string, text string"))
