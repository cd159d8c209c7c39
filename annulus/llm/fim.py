"""Fill-in-middle transformation: texts cut into prefix, middle and suffix, and put in another order.

Spark's expressions draw each document's numbers from its id; tasks do the rest on Arrow arrays: a
separator that UTF-8 has no use for is put before every unit, texts split at it into lists of units, the
lists are flattened with the row that each unit comes from, a unit's ordinal in its row gives its role,
each role's units are filtered and rebuilt into lists, and ``binary_join`` makes pieces of them.
A unit is a run of letters A to Z or any other single code point.

Edge cases: null and empty texts, and texts that hold one of the three marks, are plain: their output
is the text (empty for a null one). A null id draws like an empty one. Repeated rows give repeated
results, equal ids equal draws. A text is never split, however long: in a task, texts are taken some
16 MB at a time, or one by one if longer. Extra columns aren't read, so their names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes

#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percentages: of documents that are reordered, and of these, of documents whose suffix comes first.
REORDERED, SUFFIX_FIRST = 90, 20
_UNIT = rb"([A-Za-z]+|[^A-Za-z\x80-\xBF][\x80-\xBF]*)"  # over bytes: a code point's other bytes follow its first
_SEPARATOR = b"\xff"


def draws(doc_id: Column, salt: str = "1:", count: int = 4) -> list[Column]:
    """``count`` numbers below 2**32, the leading groups of eight hex digits of the salted id's SHA-256."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(count)]


def units(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The units of all texts (large_binary, no nulls) in one flat array, and the row of each."""
    marked = pc.replace_substring_regex(texts, pattern=_UNIT, replacement=_SEPARATOR + rb"\1")
    lists = pc.split_pattern(marked, pattern=_SEPARATOR)
    flat, rows = pc.list_flatten(lists), pc.list_parent_indices(lists)
    real = pc.greater(pc.binary_length(flat), 0)  # before the first separator there is nothing
    return pc.filter(flat, real), pc.filter(rows, real).to_numpy()


def pieces(flat: pa.Array, rows: np.ndarray, chosen: np.ndarray, n: int) -> pa.Array:
    """For each of ``n`` rows the chosen units joined: filtered, rebuilt as lists, joined."""
    kept = pc.filter(flat, pa.array(chosen))
    offsets = np.concatenate([[0], np.cumsum(np.bincount(rows[chosen], minlength=n))])
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), kept), pa.scalar(b"", pa.large_binary()))


def transformed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """doc_id, n, form, prefix_chars, middle_chars, output of doc_id, text, h1 to h4."""
    strings = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
    texts, total = strings.cast(pa.large_binary()), batch.num_rows
    h1, h2, h3, h4 = (batch.column(f"h{i}").to_numpy() for i in range(1, 5))
    flat, rows = units(texts)
    n = np.bincount(rows, minlength=total)
    ordinal = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
    a, b = h1 % (n + 1), h2 % (n + 1)
    low, high = np.minimum(a, b), np.maximum(a, b)
    prefix = pieces(flat, rows, ordinal < low[rows], total)
    middle = pieces(flat, rows, (ordinal >= low[rows]) & (ordinal < high[rows]), total)
    suffix = pieces(flat, rows, ordinal >= high[rows], total)
    marks = [pa.scalar(m.encode(), pa.large_binary()) for m in (PREFIX, SUFFIX, MIDDLE)]
    nothing = pa.scalar(b"", pa.large_binary())
    psm = pc.binary_join_element_wise(marks[0], prefix, marks[1], suffix, marks[2], middle, nothing)
    spm = pc.binary_join_element_wise(marks[1], suffix, marks[0], prefix, marks[2], middle, nothing)
    taken = pc.or_(pc.or_(pc.match_substring(strings, PREFIX), pc.match_substring(strings, SUFFIX)), pc.match_substring(strings, MIDDLE))
    plain = taken.to_numpy(zero_copy_only=False) | (n == 0) | (h3 % 100 >= REORDERED)
    suffix_first = h4 % 100 < SUFFIX_FIRST
    form = pc.if_else(pa.array(plain), "plain", pc.if_else(pa.array(suffix_first), "spm", "psm"))
    output = pc.if_else(pa.array(plain), texts, pc.if_else(pa.array(suffix_first), spm, psm))

    def characters(piece: pa.Array) -> pa.Array:
        length = pc.utf8_length(piece.cast(pa.large_string())).cast(pa.int64())
        return pc.if_else(pa.array(plain), pa.scalar(None, pa.int64()), length)

    columns = [batch.column("doc_id"), pa.array(n, pa.int64()), form.cast(pa.string()), characters(prefix), characters(middle), output.cast(pa.large_string())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and the output text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in by_bytes(batch):
                made = transformed(some)
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(made.columns, schema, strict=True)], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
    drawn = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(h.alias(f"h{i}") for i, h in enumerate(draws(F.col("doc_id")), 1)))
    return drawn.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that ``fill_in_middle`` made ``output`` of. Texts with marks stay plain, so the first of each mark is the real one."""
    rest = F.substring(output, len(PREFIX) + 1, 2**31 - 1)

    def parts(between: str) -> tuple[Column, Column, Column]:
        first = F.substring_index(rest, between, 1)
        after = F.substr(rest, F.length(first) + F.lit(len(between) + 1))
        second = F.substring_index(after, MIDDLE, 1)
        return first, second, F.substr(after, F.length(second) + F.lit(len(MIDDLE) + 1))

    prefix, suffix, middle = parts(SUFFIX)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(PREFIX)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)
