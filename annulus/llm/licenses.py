"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies.

Texts and templates become words (lower-cased runs of letters and digits) and shingles of five words.
A template of 16 or more shingles is cut into windows of 16, one at every place, a text into windows
of 16 that overlap by half. Templates that share a band of seeded minima with a text are candidates:
16 bands of two rows, so windows of Jaccard j meet with a chance of 1 - (1 - j ** 2) ** 16. Of 23
shingles of the template in a row, a text window holds 16 that are a window of the template (j = 1,
chance 1). The least that verifies is a template of 16 shingles of which 13 are left, in a row; a
text window then shares 11 of them at the worst, j = 11/21, chance 0.994. Longer ones have more
windows to meet in.

A shorter template can't fill such a window, and its windows are single shingles, one band of one row,
which meet for sure. A template of fewer than five words is one shingle of just its words, and a text
has windows of each such width too.

Candidates are then verified: the exact share of the template's distinct shingles among the text's
must be at least ``least``. Shingles are compared as strings there.

Only DataFrame operations are used. Texts are read twice and never shuffled unless there are more
candidates than a checked bound. A band's two minima are those of the shingles' hashes, each
with the bits of a seeded number turned over.

Edge cases: null and empty texts have no candidates, short ones only those they hold whole; what a
text matches depends on that text alone, so rows that share an id, or have none, each get what their
own text has; templates that are null or without words match nothing; no template gives no match.
Only doc_id and text, and template_id and text of the templates, are read, so other columns can have
any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import content_of, cut
from .license_texts import TEMPLATES

WIDTH = 5
#: Up to so many candidate pairs, two short columns, are broadcast to the texts; above, the join shuffles.
BROADCAST_PAIRS = 100_000
#: Bytes of the templates' bands that are broadcast at a time; more take as many passes over the texts.
BROADCAST_BYTES = 16 << 20
_KEY = ("id0", "content")


#: Shingles in a window, shingles from one of a text's windows to the next, bands, and minima in each.
WINDOW, STRIDE, BANDS, ROWS = 16, 8, 16, 2


def meets(jaccard: float) -> float:
    """The chance that two windows share a band."""
    return 1 - (1 - jaccard**ROWS) ** BANDS


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES.items()), "template_id string, text string")


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), "")


def _keyed(docs: DataFrame, carry: str = "text") -> DataFrame:
    """id0, content and ``carry``: the first two tell a row from all but its repetitions."""
    return docs.select(F.coalesce("doc_id", F.lit(0)).alias("id0"), content_of(F.col("text"), F.col("doc_id")).alias("content"), carry)


def _hashed(texts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``keys``, h (the words' hashes) and s (the shingles')."""
    # concat: makes arrays of plain longs of what transform() returns
    plain = lambda a: F.concat(a, F.array().cast("array<bigint>"))
    hashed = texts.select(*keys, plain(F.transform("words", lambda w: F.xxhash64(w))).alias("h"))
    each = F.transform(F.sequence(F.lit(0), F.greatest(F.size("h") - WIDTH, F.lit(0))), lambda i: _shingle(i, WIDTH))
    return hashed.select(*keys, "h", plain(each).alias("s"))


def _shingle(at: Column, width: int) -> Column:
    """The hash of the shingle of ``width`` words at a place; of all words, where there are fewer."""
    return F.xxhash64(*(F.get("h", at + i) for i in range(width)))


def _places(kind: int, size: Column, stride: int) -> Column:
    """Where windows begin, each as 8 * place + kind; ``size`` is the last place, which always is one."""
    last = F.greatest(size, F.lit(0))
    return F.concat(F.sequence(F.lit(kind), 8 * last + kind, F.lit(8 * stride)), F.array(8 * last + kind) if stride > 1 else F.array().cast("array<int>"))


def _bands(hashed: DataFrame, keys: tuple[str, ...], widths: list[int], stride: int, own: Column | None = None) -> DataFrame:
    """``keys`` and band (long) of every window; kind 0 are windows of 16, kind w single shingles of w words.

    ``own`` tells a row's only kind, else it has all of ``widths`` (0 for windows of 16).
    """
    places = {w: _places(w, F.size("h") - w, 1) if w else _places(0, F.size("s") - WINDOW, stride) for w in widths}
    every = F.concat(*places.values()) if own is None else F.coalesce(*(F.when(own == w, x) for w, x in places.items()))
    # outer: for a plain explode the optimiser adds a filter on the array, which would be built twice
    each = hashed.select(*keys, "h", "s", F.explode_outer(F.when(F.size("h") > 0, every)).alias("w")).where("w IS NOT NULL")
    each = each.select(*keys, "h", "s", F.shiftright("w", 3).alias("at"), F.col("w").bitwiseAND(F.lit(7)).alias("kind"))
    numbers = F.when(F.col("kind") == 0, F.array(*map(F.lit, range(BANDS)))).otherwise(F.array(F.lit(0)))
    each = each.select(*keys, "h", "s", "at", "kind", F.explode(numbers).alias("b"))
    each = each.select(*keys, "h", "s", "at", "kind", "b", *(F.xxhash64("b", F.lit(r)).alias(f"f{r}") for r in range(ROWS)))
    least = lambda r: F.least(*(F.get("s", F.col("at") + i).bitwiseXOR(F.col(f"f{r}")) for i in range(WINDOW)))
    # never null: a join on a column that may be null filters it first, and the minima would be taken twice
    made = F.xxhash64(*map(least, range(ROWS)), "b") if 0 in widths else F.lit(0).cast("long")
    for w in widths:
        if w:
            made = F.when(F.col("kind") == w, _shingle(F.col("at"), w)).otherwise(made)
    return each.select(*keys, made.alias("band"))


def candidates(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct (id0, content, template_id) that share a band. ``known`` has template_id and words."""
    hashed = cut(_hashed(known, ("template_id",)))
    n = F.size("h")
    own = F.when(n < WIDTH, n).when(n < WIDTH + WINDOW - 1, F.lit(WIDTH)).otherwise(F.lit(0))
    widths = sorted(r[0] for r in hashed.where(n > 0).select(own).distinct().collect())  # 0 to WIDTH at most
    if not widths:
        return docs.sparkSession.createDataFrame([], "id0 long, content long, template_id string")
    wanted = cut(_bands(hashed, ("template_id",), widths, 1, own).distinct())
    held = wanted.agg(F.coalesce(F.sum(F.octet_length("template_id") + 32), F.lit(0))).first()[0]
    passes, found = max(1, -(-held // BROADCAST_BYTES)), None
    texts = _keyed(docs).select(*_KEY, _words(F.col("text")).alias("words"))
    of_texts = _bands(_hashed(texts, _KEY), _KEY, widths, STRIDE)
    for k in range(passes):
        part = wanted.where(F.pmod("band", F.lit(passes)) == k) if passes > 1 else wanted
        some = of_texts.join(F.broadcast(part), "band").select(*_KEY, "template_id")
        found = some if found is None else found.unionByName(some)
    return found.distinct()


def _shingles(words: Column, width: int) -> Column:
    n = F.greatest(F.size(words) - width, F.lit(0))
    return F.when(F.size(words) > 0, F.array_distinct(F.transform(F.sequence(F.lit(0), n), lambda i: F.array_join(F.slice(words, i + 1, width), " ")))).otherwise(F.array().cast("array<string>"))


def matches(docs: DataFrame, known: DataFrame, least: float = 0.8) -> DataFrame:
    """id0, content, template_id, containment of every pair that reaches ``least``; one row for each row of ``docs``."""
    named = known.where(F.col("text").isNotNull() & F.col("template_id").isNotNull()).select("template_id", _words(F.col("text")).alias("words")).where(F.size("words") > 0)
    pairs = cut(candidates(docs, named))
    by_row = pairs.groupBy(*_KEY).agg(F.collect_list("template_id").alias("wanted"))  # at most all templates a row
    if pairs.count() <= BROADCAST_PAIRS:
        by_row = F.broadcast(by_row)
    hit = _keyed(docs).join(by_row, list(_KEY))
    # in two steps: inside a lambda, the expression of the words would be evaluated for each shingle
    own = hit.select(*_KEY, _words(F.col("text")).alias("words"), "wanted").select(*_KEY, "words", _shingles(F.col("words"), WIDTH).alias("own"), "wanted")
    each = own.select(*_KEY, "words", "own", F.explode("wanted").alias("template_id"))
    of = named.select("template_id", F.size("words").alias("n"), _shingles(F.col("words"), WIDTH).alias("of"), F.array_join("words", " ").alias("all"))
    size = of.agg(F.coalesce(F.sum(F.octet_length("all") * (WIDTH + 1)), F.lit(0))).first()[0]
    each = each.join(F.broadcast(of) if size <= BROADCAST_BYTES else of, "template_id")
    share = F.size(F.array_intersect("own", "of")) / F.size("of")
    # a template shorter than a shingle is there in whole or not at all
    whole = F.instr(F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")), F.concat(F.lit(" "), F.col("all"), F.lit(" "))) > 0
    contained = F.when(F.col("n") < WIDTH, whole.cast("double")).otherwise(share)
    return each.select(*_KEY, "template_id", contained.alias("containment")).where(F.col("containment") >= F.lit(least))


def report(docs: DataFrame, known: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, n_licenses, licenses (ids, comma-joined in order) and best, the highest containment, of every row of ``docs``."""
    # rows that repeat match alike; templates that share an id count once, with the best containment
    found = matches(docs, known, least).groupBy(*_KEY, "template_id").agg(F.max("containment").alias("containment"))
    found = found.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n_licenses"), F.array_join(F.array_sort(F.collect_list("template_id")), ",").alias("licenses"), F.max("containment").alias("best"))
    joined = _keyed(docs, "doc_id").join(found, list(_KEY), "left")
    return joined.select("doc_id", F.coalesce("n_licenses", F.lit(0).cast("long")).alias("n_licenses"), F.coalesce("licenses", F.lit("")).alias("licenses"), F.coalesce("best", F.lit(0.0)).alias("best"))


def scan(docs: DataFrame, known: DataFrame, least: float = 0.8) -> DataFrame:
    """One row for each (doc_id, template_id) found in some row of that id, with the best containment."""
    found = matches(docs, known, least)
    ids = _keyed(docs, "doc_id").distinct()
    return found.join(ids, list(_KEY)).groupBy("doc_id", "template_id").agg(F.max("containment").alias("containment"))
