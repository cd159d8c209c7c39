"""Queries as a stream: each micro-batch is searched like a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def answer(queries: DataFrame, search: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Searches every batch of the streaming ``queries`` (qid, qv) and writes the hits under ``path``, a folder per batch.

    A batch that is run again after a failure replaces its folder, so hits are written once.
    """

    def write(batch: DataFrame, number: int) -> None:
        search(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
