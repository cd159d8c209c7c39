"""Mixing sources to target weights by capped water-filling.

Every source has a size and a weight. The budget is dealt by weight; a source whose share is above
``max_epochs`` times its size is clamped there and the excess goes to the others by weight, until no
share is above its cap. Each source then gives whole repetitions of all its documents and, for the
rest, documents in a seeded order until the rest is used up; the document at that point gives only
its first words. So a source's taken words differ from its target by less than one word.

The seeded order is that of a digest of seed, id and text, so ids that are null or repeat don't lie
together. A source is known by where its rest ends: sums of blocks of the digest tell the block, and
only that block's documents are put in order. All other documents are taken or left by comparing
their digest with that of the end, so no text crosses a shuffle.

Edge cases: a null text has size 0; null sources form one source of their own; a source with no
words has target 0; repeated ids are separate documents; rows that repeat id and text stand together
in the order, and where the rest ends among them, as many as it covers are taken; a null id has a
place in the order like any other. An empty table gives an empty result. If every source is clamped,
the targets are the caps. A null or non-positive weight gives target 0. Only the columns named are
read, so other columns can have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, fresh, quoted, with_ordinal

#: Hex digits of the digest that make a block of a source's order: 16 ** 3 blocks a source.
_BLOCK_DIGITS = 3
_ROW_BITS = 33  # of monotonically_increasing_id, below the partition's number
#: Up to so many sources, one short row each, are broadcast to the documents; above, the join shuffles.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    """Not null, and another one for each source, null included."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def _order(doc_id: Column, text: Column, seed: int) -> Column:
    digest = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), digest).cast("binary"))


def water_fill(sources: DataFrame, max_epochs: float = 3.0, budget: float | None = None) -> DataFrame:
    """``sources`` (key, size, weight) with each one's ``target``.

    Each round is one aggregate over the table of sources and brings two numbers to the driver. The
    level only rises, so a clamped source stays clamped and the rounds end.
    """
    cap = F.col("size") * F.lit(float(max_epochs))
    weight = F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0))
    total = sources.agg(F.sum("size")).first()[0] or 0 if budget is None else budget
    clamped, before, level = F.lit(False), -1, 0.0
    while True:
        row = sources.agg(
            F.coalesce(F.sum(F.when(clamped, cap)), F.lit(0.0)).alias("held"),
            F.coalesce(F.sum(F.when(~clamped, weight)), F.lit(0.0)).alias("free"),
            F.count(F.when(clamped, 1)).alias("n"),
        ).first()
        if row.n == before or row.free <= 0:
            break
        before, level = row.n, (total - row.held) / row.free
        clamped = weight * F.lit(level) > cap
    return sources.withColumn("target", F.when(clamped, cap).otherwise(weight * F.lit(level)))


def cyclic_weights(sources: DataFrame, cycle: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """Weights dealt in turn to the sources by code point, null last; ``sources`` has key, source and size."""
    placed = with_ordinal(sources, [F.asc_nulls_last("source"), F.asc("key")])
    return placed.withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), (F.col("ordinal") % len(cycle) + 1).cast("int"))).drop("ordinal")


def _rows(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _key(F.col("source")).alias("key"), _order(F.col("doc_id"), F.col("text"), seed).alias("order"))


def _ends(rows: DataFrame, weights, max_epochs: float) -> DataFrame:
    """One row per source: key, source_size, target, whole, and where the rest ends.

    end is the digest of the document at which the rest ends (above all digests, if there is none),
    left the words that are left for the documents of that digest, times their number.
    """
    block = F.substring("order", 1, _BLOCK_DIGITS)
    # one row per source and block: what the prefix sums need, and no more
    blocks = cut(rows.groupBy("key", block.alias("block")).agg(F.sum("size").alias("block_size")))
    totals = blocks.groupBy("key").agg(F.sum("block_size").alias("size")).withColumn("source", F.when(F.col("key") != "n", F.expr("substring(key, 2)")))
    weighted = weights(totals) if callable(weights) else totals.join(weights.select(F.col("source").alias("w_source"), "weight"), F.col("source").eqNullSafe(F.col("w_source")), "left")
    targets = water_fill(cut(weighted.select("key", "size", "weight")), max_epochs).select("key", F.col("size").alias("source_size"), "target")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("whole", whole).withColumn("rest", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    upto = F.sum("block_size").over(Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    at = blocks.withColumn("upto", upto).join(targets.select("key", "rest"), "key").where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("block_size") <= F.col("rest")))
    at = at.select("key", "block", (F.col("rest") - F.col("upto") + F.col("block_size")).alias("free"))
    # only documents of the block where a source's rest ends; those with one digest are one row
    near = rows.withColumn("block", block).join(at, ["key", "block"]).groupBy("key", "free", "order").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("times"))
    upto = F.sum("size").over(Window.partitionBy("key").orderBy("order").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    end = near.withColumn("upto", upto).where((F.col("upto") > F.col("free")) & (F.col("upto") - F.col("size") <= F.col("free")))
    end = end.select("key", F.col("order").alias("end"), (F.col("free") - F.col("upto") + F.col("size")).alias("left"), "times")
    # as many rows as sources
    return cut(targets.join(end, "key", "left").select("key", "source_size", "target", "whole", F.coalesce("end", F.when(F.col("rest") > 0, F.lit("g")).otherwise(F.lit(""))).alias("end"), F.coalesce("left", F.lit(0)).alias("left"), F.coalesce("times", F.lit(1)).alias("times")))


def _joined(rows: DataFrame, ends: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(ends) if ends.count() <= BROADCAST_SOURCES else ends, "key")


def _dealt(joined: DataFrame, ends: DataFrame) -> DataFrame:
    """``joined`` (order, size, and the columns of ``ends``) with extra, the words of a further, partial repetition."""
    nth = F.lit(0)
    if not ends.where("times > 1").isEmpty():  # the end is among rows that repeat: each needs its place among them
        nth = F.col("nth")
        joined = _numbered(joined)
    last = F.greatest(F.lit(0), F.least(F.col("left") - nth * F.col("size"), F.col("size")))
    extra = F.when(F.col("order") < F.col("end"), F.col("size")).when(F.col("order") == F.col("end"), last).otherwise(F.lit(0))
    return joined.withColumn("extra", extra.cast("long"))


def _numbered(joined: DataFrame) -> DataFrame:
    """Adds nth, from 0, among the rows of the digest where their source ends; null elsewhere.

    Rows are counted by partition and then within it, so no digest has all its rows in one task.
    """
    held = cut(joined.withColumn("at", F.monotonically_increasing_id()))
    ended = held.where(F.col("order") == F.col("end")).select("key", F.shiftright("at", _ROW_BITS).alias("part"), "at")
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ended.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("key", "part").orderBy("at")) - 1
    placed = ended.withColumn("inside", inside).join(starts, ["key", "part"]).select("at", (F.col("start") + F.col("inside")).alias("nth"))
    return held.join(placed, "at", "left").drop("at")


def mix(docs: DataFrame, *, weights=cyclic_weights, max_epochs: float = 3.0, seed: int = 0) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, whole, extra, taken.

    ``weights`` is a function that adds ``weight`` to the table of sources (key, source, size), or a
    table (source, weight). A document is taken ``whole`` times in full and then its first ``extra``
    words: its size, none, or a part for the one document where the source's rest ends.
    """
    rows = cut(_rows(docs, seed))  # narrow: the words are counted once
    ends = _ends(rows, weights, max_epochs)
    dealt = _dealt(_joined(rows, ends), ends)
    return dealt.select("doc_id", "source", "size", "source_size", "target", "whole", "extra", (F.col("whole") * F.col("size") + F.col("extra")).alias("taken"))


def mixed_documents(docs: DataFrame, *, weights=cyclic_weights, max_epochs: float = 3.0, seed: int = 0) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: each document as often as it is taken, a last partial one cut after its words."""
    ends = _ends(cut(_rows(docs, seed)), weights, max_epochs)
    own = fresh(docs, "own")
    packed = docs.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias(own))
    get = {c: F.col(f"{own}.{quoted(c)}") for c in docs.columns}
    order = _order(get["doc_id"], get["text"], seed)
    joined = _joined(packed.select(own, _key(get["source"]).alias("key"), order.alias("order")), ends)
    # a document's size matters only where its source ends; elsewhere, if it has words
    size = F.when(F.col("order") == F.col("end"), word_count(get["text"])).otherwise(F.coalesce(get["text"].rlike(WORD), F.lit(False)).cast("long"))
    dealt = _dealt(joined.withColumn("size", size), ends).where((F.col("whole") > 0) | (F.col("extra") > 0))
    copies = F.sequence(F.lit(1), (F.col("whole") + F.when(F.col("extra") > 0, 1).otherwise(0)).cast("int"))
    some = dealt.withColumn("copy", F.explode(copies)).withColumn("part", (F.col("copy") > F.col("whole")) & (F.col("extra") < F.col("size")))
    some = some.withColumn("kept_text", F.when(F.col("part"), _head(get["text"], F.col("extra"))).otherwise(get["text"]))
    made = {"text": F.col("kept_text"), "n_chars": F.when(F.col("part"), F.length("kept_text").cast("long")).otherwise(get.get("n_chars", F.lit(None)))}
    return some.select(*(made.get(c, get[c]).alias(c) for c in docs.columns))


def _head(text: Column, words: Column) -> Column:
    """The first ``words`` words, one space between two."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"({WORD})")), 1, F.greatest(words, F.lit(0)).cast("int")), " ")
