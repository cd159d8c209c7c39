"""Line dedup: levelled sorted runs of line hashes, merge-joined.

A line's key is the line stripped of ASCII white space, A-Z lower-cased. ``LineRuns`` keeps what is known
of keys in sorted runs: tables bucketed and sorted by a 128-bit hash of the key, each row with the number
of documents that hold the key and the largest doc_id of them. A batch of documents adds a run of level
0; as soon as a level has ``fanout`` runs they are merged into one of the next level, so a row is written
once a level. Runs share their buckets, so merging them and joining a batch with them moves no row of
theirs. Which runs are valid stands in a small log that each change appends to: work that is lost with
a task or a driver leaves the earlier runs valid.

``update`` serves batch after batch: keys that no run holds are found by an anti-join with each run, and a
line that is common by now stays only if its key is new. ``deduplicated`` decides over a whole table,
where a line's fate depends on documents of every batch: all batches add their runs first, then the
documents are joined with the merged runs.

Edge cases: null and empty texts are one empty line. A row is a document; repeated rows and rows of equal
ids each count, and where a key's largest id is repeated each of its rows keeps its lines. A null id is below
all others. A row's repeated lines count once and go together. Very long texts and lines are read whole. All
columns but text are passed on; added names are n_lines and n_dropped, which replace columns of these names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import scratch_path
from .common import by_bytes, cut, fresh, quoted

#: Keys of at least so many code points, in at least so many documents, are common.
LEAST_CHARS, LEAST_DOCS = 40, 5
#: Common keys that are sent to the tasks at most (24 bytes each); with more of them, texts cross a shuffle.
FEW = 500_000
_SPACE = " \t\n\x0b\x0c\r"
_SEED_A, _SEED_B = 42, 43
_KEYS = "a long, b long, docs long, last long"


def _split(texts: pa.Array, least_chars: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """All lines in one flat array, each one's row, and the places and hashes (a, b) of lines whose key is long enough."""
    split = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), pattern="\n")
    flat, rows = pc.list_flatten(split), pc.list_parent_indices(split).to_numpy()
    keys = pc.ascii_lower(pc.utf8_trim(flat, characters=_SPACE))
    places = np.flatnonzero(pc.greater_equal(pc.utf8_length(keys), least_chars).to_numpy(zero_copy_only=False))
    found = keys.take(pa.array(places)).cast(pa.large_binary()).to_pylist()
    hashes = np.empty((len(places), 2), np.uint64)
    for side, seed in enumerate((_SEED_A, _SEED_B)):
        hashes[:, side] = np.fromiter((xxhash.xxh3_64_intdigest(k, seed) for k in found), np.uint64, len(found))
    return flat, rows, places, hashes.view(np.int64)


def keys_of(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """doc_id, a, b: the hashes of each row's distinct keys. A row is in one task, so no shuffle is needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in by_bytes(batch):
                _, rows, places, hashes = _split(some.column("text"), least_chars)
                once = np.unique(np.column_stack([rows[places], hashes]), axis=0)
                yield pa.RecordBatch.from_arrays([some.column("doc_id").take(pa.array(once[:, 0])), pa.array(once[:, 1]), pa.array(once[:, 2])], names=["doc_id", "a", "b"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, a long, b long")


def counted(keys: DataFrame) -> DataFrame:
    """a, b, docs, last of ``keys`` (doc_id, a, b); combined before the shuffle, however common a key is."""
    return keys.groupBy("a", "b").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("last"))


class LineRuns:
    """The runs below ``path``, in the cluster's shared storage. One writer at a time; readers see whole runs only."""

    def __init__(self, spark: SparkSession, path: str, fanout: int = 2, buckets: int | None = None):
        self.spark, self.path, self.fanout = spark, path.rstrip("/"), max(2, fanout)
        self.version, self.runs = 0, []  # runs: (name, level, buckets)
        if self._logged():
            log = spark.read.schema("version long, name string, level int, buckets int").parquet(f"{self.path}/log")
            newest = log.groupBy("version").agg(F.collect_list(F.struct("name", "level", "buckets")).alias("runs")).orderBy(F.desc("version")).first()  # a row a change
            self.version = newest.version
            self.runs = sorted(((r.name, r.level, r.buckets) for r in newest.runs if r.name), key=lambda r: (-r[1], r[0]))
        self.buckets = self.runs[0][2] if self.runs else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _logged(self) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/log")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _commit(self, runs: list[tuple[str, int, int]]) -> None:
        """One file with all valid runs: what a change began and didn't end is never read."""
        rows = [(self.version + 1, *r) for r in runs] or [(self.version + 1, None, None, None)]
        self.spark.createDataFrame(rows, "version long, name string, level int, buckets int").coalesce(1).write.mode("append").parquet(f"{self.path}/log")
        self.version, self.runs = self.version + 1, runs

    def _write(self, keys: DataFrame, level: int) -> tuple[str, int, int]:
        name = f"line_run_{self.version:08d}_{uuid.uuid4().hex}"
        rows = keys.select("a", "b", "docs", "last")
        rows.write.bucketBy(self.buckets, "a", "b").sortBy("a", "b").option("path", f"{self.path}/{name}").format("parquet").saveAsTable(name)
        return name, level, self.buckets

    def run(self, name: str, buckets: int) -> DataFrame:
        """One run, as the sorted and bucketed table that it was written as."""
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE TABLE {name} (a BIGINT, b BIGINT, docs BIGINT, last BIGINT) USING parquet CLUSTERED BY (a, b) SORTED BY (a, b) INTO {buckets} BUCKETS LOCATION '{self.path}/{name}'")
        return self.spark.table(name)

    def _merged(self, runs: list[tuple[str, int, int]]) -> DataFrame:
        """The runs joined two and two; of two runs' buckets equal ones meet, so a merge of two shuffles nothing."""
        if not runs:
            return self.spark.createDataFrame([], _KEYS)
        found = [self.run(name, buckets) for name, _, buckets in runs]
        while len(found) > 1:
            pairs = [found[i : i + 2] for i in range(0, len(found), 2)]
            found = [p[0] if len(p) == 1 else self._both(*p) for p in pairs]
        return found[0]

    @staticmethod
    def _both(one: DataFrame, other: DataFrame) -> DataFrame:
        more = other.select("a", "b", F.col("docs").alias("docs_"), F.col("last").alias("last_"))
        docs = F.coalesce("docs", F.lit(0)) + F.coalesce("docs_", F.lit(0))
        return one.join(more, ["a", "b"], "full").select("a", "b", docs.alias("docs"), F.greatest("last", "last_").alias("last"))

    def add(self, keys: DataFrame) -> None:
        """Adds a batch's counted keys as a run, and merges the runs of each level that is full."""
        runs = [*self.runs, self._write(keys, 0)]
        self._commit(runs)
        level = 0
        while len(full := [r for r in runs if r[1] == level]) >= self.fanout:
            runs = [*(r for r in runs if r[1] != level), self._write(self._merged(full), level + 1)]
            self._commit(runs)
            level += 1

    def merged(self) -> DataFrame:
        """a, b, docs, last over all runs."""
        return self._merged(self.runs)

    def unseen(self, keys: DataFrame) -> DataFrame:
        """``keys`` (a, b, ...) that no run holds: an anti-join with each run, newest first, that shuffles the batch only."""
        left = keys
        for name, _, buckets in reversed(self.runs):
            left = left.join(self.run(name, buckets).select("a", "b"), ["a", "b"], "left_anti")
        return left


def _found(a: np.ndarray, b: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Where each of ``hashes`` stands in ``a`` (ascending) and ``b``; -1 if it doesn't."""
    low, high = (np.searchsorted(a, hashes[:, 0], side) for side in ("left", "right"))
    at = np.full(len(hashes), -1)
    for nth in range(int((high - low).max(initial=0))):  # one round, unless keys share half their hash
        place = np.minimum(low + nth, len(a) - 1)
        fits = (low + nth < high) & (b[place] == hashes[:, 1])
        at[fits] = place[fits]
    return at


def _without(docs: DataFrame, marks: str | None, lost, least_chars: int) -> DataFrame:
    """``docs`` less the lines that ``lost`` flags: its arguments are a batch, its columns' places, and the rows and hashes of its long lines."""
    others = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped", marks)]
    place = {c: i for i, c in enumerate([*others, *([marks] if marks else []), "text"])}
    # columns go by place: any name is allowed
    taken = docs.select(*((F.col(quoted(c)) if c != "text" else F.col(c).cast("string")).alias(f"c{i}") for c, i in place.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in by_bytes(batch, column=place["text"]):
                flat, rows, places, hashes = _split(some.column(place["text"]), least_chars)
                gone = np.zeros(len(rows), bool)
                gone[places] = lost(some, place, rows[places], hashes)
                offsets = np.concatenate([[0], np.cumsum(np.bincount(rows[~gone], minlength=some.num_rows))])
                kept = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), flat.filter(pa.array(~gone)))
                text = pc.binary_join(kept, pa.scalar("\n", pa.large_string())).cast(pa.string())
                counts = (pa.array(np.bincount(x, minlength=some.num_rows), pa.int64()) for x in (rows, rows[gone]))
                yield pa.RecordBatch.from_arrays([*(some.column(place[c]) for c in others), text, *counts], names=[f.name for f in made])

    made = [*(taken.schema[place[c]] for c in others), T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
    return taken.mapInArrow(run, T.StructType(made)).toDF(*others, "text", "n_lines", "n_dropped")


def without_common(docs: DataFrame, common: DataFrame, least_chars: int = LEAST_CHARS, few: int = FEW) -> DataFrame:
    """``docs`` less their lines with a key of ``common`` (a, b, last, keep), but for those of doc_id ``last`` where ``keep``.

    Up to ``few`` keys go to the tasks and texts stay where they are. With more, each document's lost keys
    are found by a join on the hash and come to its row by a join on the id.
    """
    common = cut(common)
    if common.count() <= few:
        held = common.select("a", "b", "last", "keep").toArrow().sort_by("a")
        a, b, keep = (held[c].to_numpy() for c in ("a", "b", "keep"))
        shared = docs.sparkSession.sparkContext.broadcast((a, b, keep, pc.fill_null(held["last"], 0).to_numpy(), pc.is_null(held["last"]).to_numpy()))
        own = fresh(docs, "own_id")
        taken = docs.withColumn(own, F.col("doc_id").cast("long"))

        def lost(batch: pa.RecordBatch, place: dict[str, int], rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
            a, b, keep, last, none = shared.value
            at, ids = _found(a, b, hashes), batch.column(place[own])
            values, nulls = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), pc.is_null(ids).to_numpy(zero_copy_only=False)
            known = at >= 0
            gone = np.zeros(len(rows), bool)
            at, rows = at[known], rows[known]
            gone[known] = ~(keep[at] & (last[at] == values[rows]) & (none[at] == nulls[rows]))
            return gone

        return _without(taken, None, lost, least_chars).drop(own)
    keys = keys_of(docs, least_chars).join(common, ["a", "b"]).where(~(F.col("keep") & F.col("doc_id").eqNullSafe(F.col("last"))))
    owner, marks = fresh(docs, "owner"), fresh(docs, "marks")
    marked = keys.groupBy(F.col("doc_id").alias(owner)).agg(F.collect_set(F.struct("a", "b")).alias(marks))
    joined = docs.join(marked, F.col("doc_id").cast("long").eqNullSafe(F.col(owner)), "left").drop(owner)

    def lost_of_row(batch: pa.RecordBatch, place: dict[str, int], rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        lists = batch.column(place[marks])
        pairs, of = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
        listed = np.column_stack([of, pairs.field("a").to_numpy(), pairs.field("b").to_numpy()]).astype(np.int64)
        asked = np.column_stack([rows, hashes]).astype(np.int64)
        return np.isin(_wide(asked), _wide(listed))

    return _without(joined, marks, lost_of_row, least_chars)


def _wide(rows: np.ndarray) -> np.ndarray:
    """Rows of three longs as one comparable value each."""
    return np.ascontiguousarray(rows).view([("row", np.int64), ("a", np.int64), ("b", np.int64)]).ravel()


def update(runs: LineRuns, docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, few: int = FEW) -> DataFrame:
    """``docs`` after all batches before, and adds their keys to ``runs``.

    A key that runs and batch hold in ``least_docs`` documents is common. Where no run holds it, it
    stays in the batch's largest id; else it goes from the whole batch.
    """
    own = cut(counted(keys_of(docs, least_chars)))
    unseen = runs.unseen(own).where(F.col("docs") >= least_docs).select("a", "b", "last", F.lit(True).alias("keep"))
    before = runs.merged().select("a", "b", F.col("docs").alias("earlier"))
    seen = own.join(before, ["a", "b"]).where(F.col("docs") + F.col("earlier") >= least_docs).select("a", "b", "last", F.lit(False).alias("keep"))
    kept = without_common(docs, unseen.unionByName(seen), least_chars, few)
    runs.add(own)
    return kept


def batches_of(docs: DataFrame, count: int) -> list[DataFrame]:
    """``docs`` by ranges of doc_id, about as many rows in each; a null id is in the first. Files sorted by id are read once."""
    shares = [i / count for i in range(1, count)]
    bounds = docs.agg(F.percentile_approx("doc_id", shares, 1000).alias("at")).first()["at"] if shares else []
    bounds = sorted(set(bounds or []))
    if not bounds:
        return [docs]
    first = docs.where(F.col("doc_id").isNull() | (F.col("doc_id") <= bounds[0]))
    between = [docs.where((F.col("doc_id") > low) & (F.col("doc_id") <= high)) for low, high in zip(bounds, bounds[1:], strict=False)]
    return [first, *between, docs.where(F.col("doc_id") > bounds[-1])]


def deduplicated(docs: DataFrame, runs: LineRuns | None = None, batches: int = 4, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, few: int = FEW) -> DataFrame:
    """``docs`` with the common lines of the whole table, and of ``runs`` if given, left in the largest id only."""
    runs = runs or LineRuns(docs.sparkSession, scratch_path(docs.sparkSession, "lines"))
    for batch in batches_of(docs, batches):
        runs.add(counted(keys_of(batch, least_chars)))
    common = runs.merged().where(F.col("docs") >= least_docs).select("a", "b", "last", F.lit(True).alias("keep"))
    return without_common(docs, common, least_chars, few)
