"""The corpus pipeline: five stages from raw documents to token counts.

Each stage works on all that the one before kept, and returns the columns of ``documents`` but for the
last. Handed-over tables are Parquet in a cluster's check, and checkpoints in run().

Edge cases, in all stages: rows are never told apart by id alone, so null and repeated ids are documents
like any other; null texts count as empty, but stay null until they are tokens; very long texts are worked on
whole; columns of any other name pass through all stages but the last; an empty table gives an empty
result. What a stage does beyond that is with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from annulus.llm import bpe, mixing, neardup, quality, secrets
from annulus.llm.common import cut, table
from annulus.llm.queries import vocabulary_path
from annulus.sources.scratch import scratch_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labels of the stage's own documents.

    Null and empty texts are scored by their statistics, which are zero. With labels of one kind only, all
    documents get that label; with no label that fits a document, all stay. Repeated rows share a score.
    """
    return quality.accepted(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: texts whose sets of five-word shingles have similarity 0.8 or more.

    SimHash fingerprints retrieve through blocks and verified distance, and MinHash bands what is beyond two bits; exact
    similarity judges all. The smallest id stays, a null one only if there is no other; of equal ids one text, and of repeated rows one
    row, is chosen by its content. Null, empty and blank texts are one group.
    """
    return neardup.deduplicated(docs, width=5, least=0.8)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in them masked: each rule version scans against the ledger that the one before left. Null texts stay null, and repeated rows each stay."""
    return secrets.redacted(docs, secrets.in_turn(docs, scratch_path(spark, "ledger")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: each document as often as its source's target asks, at most three times.

    Null sources are one source. A document without words comes in the whole repetitions of its source; a source
    without any words has none, and its documents go.
    """
    return mixing.mixed_documents(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the mixed documents. Null texts have no tokens; repeated rows each get a row."""
    return bpe.encode(docs, vocabulary_path())


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_copies),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("bpe", encode_tokens),
]

#: Not in SQL: tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
