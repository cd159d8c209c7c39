"""SimHash near-dedup: fingerprints over word shingles, pigeonhole blocks, verified Hamming distance.

A text's A-Z are lower-cased and its words taken; each shingle of ``width`` words (the whole sequence,
if there are fewer) votes with its XXH64. A bit of the fingerprint is 1 if it is set in over half of
the hashes. Documents link if their fingerprints differ in at most two bits, and chains of links are
groups. Copies share a fingerprint, so only distinct fingerprints are linked: a group of copies costs
one row in the joins.

Edge cases: a null, empty or blank text has fingerprint zero and is linked like any other; repeated
rows and repeated ids each get their row; a null id is never the smallest unless a group has no
other, then the component is null. An empty table gives an empty result. Very long texts are hashed
in chunks. Only doc_id and text are read (``deduplicated`` passes all columns on).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import hamming, minhash
from .common import cut, fresh, id_back, id_text, quoted, text_digest
from .graph import components

_CHUNK = 1 << 15


def simhash(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The fingerprint as an unsigned integer."""
    words = (text or "").encode().lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return 0
    line = memoryview(b" ".join(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: max(1, len(words) - width + 1)].tolist()
    ends = ends[min(width, len(words)) - 1 :].tolist()
    votes, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), _CHUNK):
        votes += hamming.votes(np.array([digest(line[a:b], seed) for a, b in zip(starts[at : at + _CHUNK], ends[at : at + _CHUNK], strict=True)], "<u8"))
    return hamming.majority(votes, len(starts))


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (signed long) and the text's hash of every document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["fp"] = np.array([simhash(t, width, seed) for t in batch["text"]], np.uint64).view(np.int64)
            yield batch[["doc_id", "fp", "content"]]

    return id_back(docs.select(id_text(), "text", F.xxhash64("text").alias("content")).mapInPandas(run, "doc_id string, fp long, content long"))


def groups(prints: DataFrame, most: int = 64) -> DataFrame:
    """``prints`` (doc_id, fp, ...) with ``component_id``. ``prints`` is read several times: hand in a written table."""
    roots = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("root")))
    linked = components(hamming.edges(roots.select("fp"), most))
    placed = roots.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    ids = placed.groupBy("component").agg(F.min("root").alias("component_id"))
    named = placed.join(ids, "component").select("fp", "component_id")
    return prints.join(named, "fp")


def near_duplicates(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    found = groups(cut(fingerprints(docs, width, seed)))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, width: int = 5, least: float = 0.8, seed: int = 42) -> DataFrame:
    """``docs`` with one document of each group: that with the smallest id, a null id last; of equal ids, the smallest digest of the text.

    Fingerprints retrieve first, by the same blocks and verified distance; similarity judges, and bands bring the
    pairs whose fingerprints are further apart.
    """
    return first_of_groups(docs, minhash.content_groups(docs, width, seed, least))


def first_of_groups(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """``docs`` with one document of each component of ``placed`` (doc_id, content, component), chosen as ``deduplicated`` does.

    Of rows that repeat id and text, that with the smallest hash of all other columns stays.
    """
    # a minimum is combined before the shuffle, however large the component
    first = placed.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "content")).alias("first"))
    of_id, of_text, rest, nth = (fresh(docs, c) for c in ("first_id", "first_content", "rest", "nth"))
    kept = cut(first.select(F.col("first.doc_id").alias(of_id), F.col("first.content").alias(of_text)))
    one = docs.join(kept, F.col("doc_id").eqNullSafe(F.col(of_id)) & (text_digest(F.col("text")) == F.col(of_text)), "left_semi")
    repeated = placed.groupBy("doc_id", "content").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    if repeated.join(kept, F.col("doc_id").eqNullSafe(F.col(of_id)) & (F.col("content") == F.col(of_text)), "left_semi").isEmpty():
        return one
    others = F.xxhash64(F.to_json(F.struct(*(F.col(quoted(c)) for c in docs.columns if c not in ("doc_id", "text")), F.lit(0).alias(rest))))
    # Spark ranks in each partition before the shuffle as well
    place = F.row_number().over(Window.partitionBy("doc_id", text_digest(F.col("text"))).orderBy(others, F.col("text").isNull()))
    return one.withColumn(nth, place).where(F.col(nth) == 1).drop(nth)
