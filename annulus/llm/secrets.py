"""Secret scans over a content-addressed blob ledger.

A text is a blob, addressed by the SHA-256 of its bytes. The ledger has one row for each blob and
rule version that was ever scanned, with the findings; a scan reads the text of one document for each
pair that the ledger lacks, and findings go back by address to every document that holds the blob.
So copies and unchanged versions cost a hash and no scan.

Texts stay where they are read as long as the table that picks them is small: the blobs that several
documents hold or of which some version is known, or else the blobs to scan, or the blobs with
findings, when these are masked. Above a checked bound they cross one shuffle, with equal results.

Rules: the base kinds assign, access and hex (version ``base-1``), and further kinds (version
``extra-1``) for token formats whose prefix is public. Spans count code points, end exclusive.

Edge cases: a null text counts as empty; an empty text has no findings; repeated rows and ids, and
null ids, each get their row; very long texts are scanned whole. Only doc_id and text are read, so
other columns can have any name. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, quoted

BASE, EXTRA = "base-1", "extra-1"
#: Up to so many blobs, and findings of theirs, are broadcast to the texts; above, the join shuffles.
BROADCAST_BLOBS = 100_000
KINDS = ("assign", "access", "hex")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # the longest runs of at least 32: a shorter run can't begin a match

# Public prefixes of access tokens, and key headers.
_EXTRA = {
    "github": re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}"),
    "slack": re.compile(r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    "google": re.compile(r"\bAIza[A-Za-z0-9_-]{35}"),
    "jwt": re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    "private_key": re.compile(r"-----BEGIN (?:[A-Z]{1,12} ){0,3}PRIVATE KEY-----"),
}
_MARKS = ("gh", "xox", "AIza", "eyJ", "-----BEGIN")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Base matches that hold, by start and then kind as listed."""
    spans = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, k, b in sorted(spans)]


def extra_spans(text: str) -> list[tuple[int, int, str]]:
    if not any(m in text for m in _MARKS):
        return []
    return [(m.start(), m.end(), kind) for kind, rule in _EXTRA.items() for m in rule.finditer(text)]


RULES = {BASE: base_spans, EXTRA: extra_spans}
_FINDINGS = "array<struct<start: long, end: long, kind: string>>"


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _texts(docs: DataFrame, ledger: DataFrame | None, versions: tuple[str, ...], most: int) -> DataFrame:
    """blob, text and versions of one document, that with the smallest id, for each blob that has unseen versions."""
    paths = docs.select("doc_id", "text", blob_id(F.col("text")).alias("blob"))
    asked = F.array(*map(F.lit, versions))
    blobs = paths.groupBy(F.col("blob").alias("unseen")).agg(F.min("doc_id").alias("at"), F.count(F.lit(1)).alias("times"))
    if ledger is None:
        blobs = blobs.withColumn("versions", asked)
    else:
        known = ledger.where(F.col("version").isin(*versions)).groupBy(F.col("blob").alias("unseen")).agg(F.collect_set("version").alias("known"))
        blobs = blobs.join(known, "unseen", "left").select("unseen", "at", "times", F.array_except(asked, F.coalesce("known", F.array().cast("array<string>"))).alias("versions"))
    blobs = cut(blobs)
    here, first = F.col("blob") == F.col("unseen"), F.col("doc_id").eqNullSafe(F.col("at"))
    # what isn't simply scanned whole, and what is scanned at all: whichever is small goes to the texts
    odd, todo = blobs.where((F.col("times") > 1) | (F.size("versions") < len(versions))), blobs.where(F.size("versions") > 0)
    if odd.count() <= most:
        found = paths.join(F.broadcast(odd), here, "left").where(F.col("unseen").isNull() | (first & (F.size("versions") > 0)))
        return found.select("blob", "text", F.coalesce("versions", asked).alias("versions"))
    return paths.join(F.broadcast(todo) if todo.count() <= most else todo, here & first).select("blob", "text", "versions")


def scan(docs: DataFrame, ledger: DataFrame | None = None, versions: tuple[str, ...] = (BASE, EXTRA), most: int = BROADCAST_BLOBS) -> DataFrame:
    """New rows of the ledger: blob, version, findings, for the pairs that ``ledger`` lacks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(blob, v, [dict(zip(("start", "end", "kind"), s, strict=True)) for s in RULES[v](text or "")]) for blob, text, of in zip(batch["blob"], batch["text"], batch["versions"], strict=True) for v in of]
            yield pd.DataFrame(found, columns=["blob", "version", "findings"])

    return _texts(docs, ledger, versions, most).mapInPandas(run, f"blob string, version string, findings {_FINDINGS}").dropDuplicates(["blob", "version"])


def update(docs: DataFrame, path: str | None = None, versions: tuple[str, ...] = (BASE, EXTRA)) -> DataFrame:
    """The ledger after a scan of ``docs``. With ``path`` it is kept there as Parquet and only grows."""
    if path is None:
        return cut(scan(docs, None, versions))
    spark = docs.sparkSession
    schema = f"blob string, version string, findings {_FINDINGS}"
    spark.createDataFrame([], schema).write.mode("append").parquet(path)  # there, if there was none
    cut(scan(docs, spark.read.schema(schema).parquet(path), versions)).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def in_turn(docs: DataFrame, path: str, versions: tuple[str, ...] = (BASE, EXTRA)) -> DataFrame:
    """The ledger at ``path`` after one scan for each rule version, each against what the ones before it left there."""
    for version in versions:
        ledger = update(docs, path, (version,))
    return ledger


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def blob_findings(ledger: DataFrame, versions: tuple[str, ...] = (BASE, EXTRA)) -> DataFrame:
    """blob, base and spans (arrays in the order of start, then kind as listed) of the blobs that have findings."""
    rank = F.array(*map(F.lit, (*KINDS, *_EXTRA)))
    keyed = lambda s: F.struct(s["start"], F.array_position(rank, s["kind"]).alias("rank"), s["end"], s["kind"])
    # runs that scanned at the same time may both have left a pair
    hits = ledger.where(F.col("version").isin(*versions) & (F.size("findings") > 0)).dropDuplicates(["blob", "version"])
    found = hits.groupBy("blob").agg(F.flatten(F.collect_list(F.when(F.col("version") == BASE, F.col("findings")))).alias("base"), F.flatten(F.collect_list("findings")).alias("spans"))
    return found.select("blob", *(F.array_sort(F.transform(F.col(c), keyed)).alias(c) for c in ("base", "spans")))


def findings(docs: DataFrame, ledger: DataFrame, versions: tuple[str, ...] = (BASE, EXTRA)) -> DataFrame:
    """One row per document: doc_id, blob, base and spans."""
    return docs.select("doc_id", blob_id(F.col("text")).alias("blob")).join(blob_findings(ledger, versions), "blob", "left")


def _is(kind: str):
    return lambda x: x == F.lit(kind)


def report(docs: DataFrame, ledger: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    found = findings(docs, ledger)
    none = F.array().cast("array<struct<start: bigint, rank: bigint, end: bigint, kind: string>>")
    base, spans = F.coalesce("base", none), F.coalesce("spans", none)
    counts = [F.size(F.filter(F.transform(base, lambda s: s["kind"]), _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(spans).alias("spans"))


def redacted(docs: DataFrame, ledger: DataFrame, mark: str = "[SECRET]", most: int = BROADCAST_BLOBS) -> DataFrame:
    """``docs`` with every found span replaced by ``mark`` (overlapping spans by one), n_chars set anew."""

    def clean(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else _masked(t, zip(a, b, strict=True), mark) for t, a, b in zip(texts, starts, ends, strict=True)], dtype=object)

    clean.__annotations__ = {"texts": pd.Series, "starts": pd.Series, "ends": pd.Series, "return": pd.Series}  # names, not strings
    blob, starts, ends, new = (fresh(docs, c) for c in ("dirty_blob", "starts", "ends", "new_text"))
    dirty = blob_findings(ledger).select(F.col("blob").alias(blob), F.col("spans.start").alias(starts), F.col("spans.end").alias(ends))
    dirty = cut(dirty)
    held = dirty.agg(F.count(F.lit(1)).alias("blobs"), F.coalesce(F.sum(F.size(starts)), F.lit(0)).alias("spans")).first()
    few = held.blobs <= most and held.spans <= 10 * most
    joined = docs.join(F.broadcast(dirty) if few else dirty, blob_id(F.col("text")) == F.col(blob), "left")
    found = F.col(blob).isNotNull() & F.col("text").isNotNull()
    # only texts with findings go to Python
    joined = joined.withColumn(new, F.pandas_udf(clean, "string")(F.when(found, F.col("text")), starts, ends))
    made = {"text": F.when(found, F.col(new)).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(found, F.length(new).cast("long")).otherwise(F.col("n_chars"))
    return joined.select(*(made.get(c, F.col(quoted(c))).alias(c) for c in docs.columns))


def _masked(text: str, spans, mark: str) -> str:
    out, at = [], 0
    for a, b in spans:  # by start
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])
