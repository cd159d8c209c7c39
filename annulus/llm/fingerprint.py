"""Document fingerprints: SimHash over weighted terms, and permuted block tables to find the near ones.

Terms are a text's distinct words, lower-cased; each weighs its length, since long words tell texts
apart and short ones recur everywhere. The XXH64 of a term votes with its weight for 1 or against it
on each of 64 bits; the fingerprint has a 1 where the votes sum above zero. All of it is DataFrame
operations: two bits share a long sum, 32 sums hold all votes. A sum can't overflow, since the
weights of a text add up to less than 2**31.

hamming.neighbours() finds every fingerprint within the radius by block tables.

Edge cases: a null text counts as empty, and an empty or blank text has fingerprint zero. Documents
go by ascending doc_id, a null id last; rows with one id go by the hash of their text, and rows that
repeat both are one document in this order and get the same result each. After the last document
comes the first; a single document is its own next. An empty table gives an empty result. Only doc_id
and text are read, so other columns can have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hamming
from .common import cut, with_ordinal

_LANES = (1 << 32) + 1  # the lowest bit of both halves of a long
_KEY = ("id0", "content")  # of a document: never null, and spread evenly by any hash


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    content = F.xxhash64(text, F.col("doc_id").isNull())
    return docs.select(F.coalesce("doc_id", F.lit(0)).alias("id0"), content.alias("content"), text.alias("text"))


def terms(text: Column) -> Column:
    return F.array_distinct(F.split(F.lower(text), r"[\x20\x09-\x0D]+"))


def simhash(texts: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """``key`` and ``fp`` (signed long) from rows of ``key`` and ``text``; blank texts give no row."""
    # outer: for a plain explode the optimiser adds a filter on the array, which would be built twice
    voted = texts.select(*key, F.explode_outer(terms(F.col("text"))).alias("term")).where("term <> ''")
    voted = voted.select(*key, F.xxhash64("term").alias("h"), F.length("term").cast("long").alias("weight"))
    lane = [F.sum(F.shiftrightunsigned("h", j).bitwiseAND(F.lit(_LANES)) * F.col("weight")).alias(f"v{j}") for j in range(32)]
    sums = voted.groupBy(*key).agg(F.sum("weight").alias("total"), *lane)
    low = lambda j: F.col(f"v{j}").bitwiseAND(F.lit((1 << 32) - 1))
    high = lambda j: F.shiftrightunsigned(f"v{j}", 32)
    fp = F.lit(0).cast("long")
    for j in range(32):
        for votes, bit in ((low(j), j), (high(j), j + 32)):
            fp = fp.bitwiseOR(F.when(2 * votes > F.col("total"), F.lit(1 << bit if bit < 63 else -(1 << 63))).otherwise(F.lit(0).cast("long")))
    return sums.select(*key, fp.alias("fp"))


def successors(docs: DataFrame) -> DataFrame:
    """One row per document: id0, content, doc_id, n_chars, next_id0, next_content. No text is moved for it."""
    held = docs.select("doc_id", F.length(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("n_chars"), F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.col("doc_id").isNull()).alias("content"))
    light = held.groupBy("doc_id", "content").agg(F.max("n_chars").alias("n_chars"), F.count(F.lit(1)).alias("times"))
    placed = cut(with_ordinal(light, [F.asc_nulls_last("doc_id"), F.asc("content")])).withColumn("id0", F.coalesce("doc_id", F.lit(0)))
    n = placed.count()
    after = placed.select((F.pmod(F.col("ordinal") - 1, F.lit(max(n, 1)))).alias("ordinal"), F.col("id0").alias("next_id0"), F.col("content").alias("next_content"))
    return placed.join(after, "ordinal").drop("ordinal")


def edited(docs: DataFrame, order: DataFrame) -> DataFrame:
    """id0, content, text, edited: the last quarter of each text replaced by the start of the next document.

    Only that start is sent on, so beside one shuffle of the texts, read twice, a quarter of them moves.
    """
    texts = keyed(docs)
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    wanted = order.select(F.col("id0").alias("to_id0"), F.col("content").alias("to_content"), F.col("n_chars"), F.col("next_id0").alias("id0"), F.col("next_content").alias("content"))
    heads = texts.join(wanted, list(_KEY)).select("to_id0", "to_content", "n_chars", F.col("text").substr(F.lit(1), quarter).alias("head"))
    heads = heads.toDF("id0", "content", "n_chars", "head")
    kept = (F.col("n_chars") - F.floor(F.col("n_chars") / 4)).cast("int")
    return texts.join(heads, list(_KEY)).select(*_KEY, "text", F.concat(F.col("text").substr(F.lit(1), kept), "head").alias("edited"))


def _hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def likeness(a: Column, b: Column) -> Column:
    return 1 - hamming.distance(a, b) / F.lit(64.0)


def fingerprints(docs: DataFrame, most: int = 64) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, near_count of every document.

    near_count is the number of other documents within hamming.RADIUS bits of the fingerprint.
    """
    order = cut(successors(docs))
    # of rows that repeat, one is fingerprinted
    pairs = edited(docs, order)
    if not order.where("times > 1").isEmpty():
        pairs = pairs.dropDuplicates(list(_KEY))
    which = pairs.select(*_KEY, F.posexplode(F.array("text", "edited")).alias("edit", "text"))
    prints = simhash(which, (*_KEY, "edit"))
    wide = prints.groupBy(*_KEY).agg(F.max(F.when(F.col("edit") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("edit") == 1, F.col("fp"))).alias("edited_fp"))
    digests = pairs.select(*_KEY, F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    zero = F.lit(0).cast("long")
    made = digests.join(wide, list(_KEY), "left").join(order, list(_KEY))
    made = cut(made.withColumn("fp", F.coalesce("fp", zero)).withColumn("edited_fp", F.coalesce("edited_fp", zero)))
    counted = cut(made.groupBy("fp").agg(F.sum("times").alias("n")))
    near = counted.join(hamming.neighbours(counted, most), "fp", "left").select("fp", (F.col("n") - 1 + F.coalesce("near", zero)).alias("near_count"))
    following = made.select(F.col("id0").alias("next_id0"), F.col("content").alias("next_content"), F.col("fp").alias("next_fp"))
    full = made.join(following, ["next_id0", "next_content"]).join(near, "fp")
    full = full.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return full.select("doc_id", "n_chars", "edited_sha256", _hex(F.col("fp")).alias("fingerprint"), _hex(F.col("edited_fp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), "near_count")
