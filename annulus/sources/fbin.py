"""Binary matrices: uint32 rows, uint32 dimensions, then the items row by row, little-endian."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes of a file that a task reads.
RANGE_BYTES = 64 << 20
_TYPES = {"float": ("<f4", "float"), "int": ("<i4", "int")}


def parsed(files: DataFrame, kind: str = "float", column: str = "embedding") -> DataFrame:
    """path, at (row of its file, from 0) and the vector, from path and content. A file is parsed in one task, in batches.

    A file shorter or longer than its header says raises an error.
    """
    code, name = _TYPES[kind]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"], strict=True):
                n, d = _shape(path, len(data), data[:8])
                rows = np.frombuffer(data, code, n * d, 8).reshape(n, d)
                for at in range(0, n, 4096):
                    yield pd.DataFrame({"path": path, "at": np.arange(at, min(n, at + 4096)), column: list(rows[at : at + 4096])})

    return files.select("path", "content").mapInPandas(parse, f"path string, at long, {column} array<{name}>")


def _located(path: str):
    """A store that pyarrow knows (local, HDFS, S3, GCS) and the place in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))


@dataclass
class Range(InputPartition):
    """Rows of one file, read by one task. ``start`` is the file's first place among all files."""

    path: str
    start: int
    dims: int
    first: int
    until: int


class BinaryMatrix(DataSource):
    """``spark.read.format("binary_matrix").load(path)``: one row per vector, numbered over all files in the order of their paths.

    Options: kind (float or int), id and column (names), range (bytes of a task). Headers are read on the driver and
    deal the files into ranges; only columns of the asked schema are made, and a file whose length its header doesn't ask for
    is an error. Files lie in a store that pyarrow knows.
    """

    @classmethod
    def name(cls) -> str:
        return "binary_matrix"

    def schema(self) -> str:
        kind = _TYPES[self.options.get("kind", "float")][1]
        return f"{self.options.get('id', 'vec_id')} long, {self.options.get('column', 'embedding')} array<{kind}>"

    def reader(self, schema: StructType) -> MatrixReader:
        return MatrixReader(schema.names, self.options)


class MatrixReader(DataSourceReader):
    def __init__(self, names: list[str], options: dict):
        self.names, self.path = names, options["path"]
        self.code = _TYPES[options.get("kind", "float")][0]
        self.id, self.most = options.get("id", "vec_id"), int(options.get("range", RANGE_BYTES))

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        store, at = _located(self.path)
        files = [store.get_file_info(at)]
        if files[0].type == fs.FileType.Directory:
            files = sorted((f for f in store.get_file_info(fs.FileSelector(at, recursive=True)) if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))), key=lambda f: f.path)
        found, start = [], 0
        for file in files:
            with store.open_input_file(file.path) as f:
                n, d = _shape(file.path, file.size, f.read(8))
            step = max(1, self.most // max(1, 4 * d))
            found += [Range(file.path, start, d, first, min(n, first + step)) for first in range(0, n, step)]
            start += n
        return found or [Range("", 0, 0, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        store, _ = _located(self.path)
        only_ids = self.names == [self.id]
        for at in range(part.first, part.until, 4096):
            count = min(part.until, at + 4096) - at
            columns = {self.id: pa.array(np.arange(part.start + at, part.start + at + count))}
            if not only_ids:
                with store.open_input_file(part.path) as f:
                    f.seek(8 + 4 * at * part.dims)
                    items = pa.array(np.frombuffer(f.read(4 * count * part.dims), self.code))
                offsets = pa.array(np.arange(count + 1, dtype=np.int32) * part.dims)
                columns |= {c: pa.ListArray.from_arrays(offsets, items) for c in self.names if c != self.id}
            yield pa.RecordBatch.from_arrays([columns[c] for c in self.names], names=self.names)


def _shape(path: str, length: int, head: bytes) -> tuple[int, int]:
    if len(head) < 8:
        raise ValueError(f"{path}: short header")
    n, d = np.frombuffer(head[:8], "<u4").tolist()
    if length != 8 + 4 * n * d:
        raise ValueError(f"{path}: {n} x {d} items need {8 + 4 * n * d} bytes, it has {length}")
    return n, d


def read(spark: SparkSession, path: str, kind: str = "float", id_name: str = "vec_id", column: str = "embedding", most: int = RANGE_BYTES, columns: list[str] | None = None) -> DataFrame:
    """One row per vector, numbered over all files in the order of their paths; of ``columns``, if given, only these.

    Read by ranges of ``most`` bytes through ``BinaryMatrix``. From a store that Spark reads but pyarrow doesn't know, a file
    is read whole by one task.
    """
    try:
        _located(path)
    except (pa.ArrowException, OSError):
        files = spark.read.format("binaryFile").load(path)
        heads = files.select("path", F.substring("content", 1, 4).alias("head"))
        rows = F.conv(F.hex(F.reverse("head")), 16, 10).cast("long")
        before = F.coalesce(F.sum(rows).over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        found = parsed(files, kind, column).join(heads.select("path", before.alias("start")), "path")
        return found.select((F.col("start") + F.col("at")).alias(id_name), column).select(*(columns or (id_name, column)))
    spark.dataSource.register(BinaryMatrix)
    source = spark.read.format("binary_matrix").options(kind=kind, id=id_name, column=column, range=most)
    if columns:
        types = {id_name: "long", column: f"array<{_TYPES[kind][1]}>"}
        source = source.schema(", ".join(f"{c} {types[c]}" for c in columns))
    return source.load(path)


def write(vectors: DataFrame, path: str, column: str = "embedding", kind: str = "float") -> int:
    """Each partition as one file below ``path``, in the order of its rows; the number of rows. A task that runs again replaces its file."""
    code = _TYPES[kind][0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [np.stack(b[column].to_numpy()).astype(code) for b in batches if len(b)]
        if rows:
            held = np.concatenate(rows)
            store, at = _located(path)
            store.create_dir(at)
            task = TaskContext.get()
            name, draft = f"{at}/part-{task.partitionId():06d}.bin", f"{at}/.draft-{task.taskAttemptId()}"
            with store.open_output_stream(draft) as f:
                f.write(np.array(held.shape, "<u4").tobytes() + held.tobytes())
            store.move(draft, name)
            yield pd.DataFrame({"n": [len(held)]})

    return vectors.select(column).mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
