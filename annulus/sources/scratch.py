"""Where a cluster's executors and driver can all write."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_root(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, which is set as checkpoint folder.

    Where it is unset, one is made on a local master only, where driver and executors are one process;
    a cluster without one is an error, since a machine's own folder isn't seen by the others.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if root is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            root = tempfile.mkdtemp(prefix="spark-checkpoint-")
        context.setCheckpointDir(root)
    return context.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the session's shared checkpoint folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, store = _at(spark, path)
    return store.exists(at)


def stamp(spark: SparkSession, path: str) -> str:
    """A digest of the names, lengths and times of all files at ``path``, in any store that Spark reads: no data is read."""
    at, store = _at(spark, path)
    files, found = store.listFiles(at, True), []
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath().toString()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()
