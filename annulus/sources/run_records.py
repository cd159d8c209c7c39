"""Run records as CSV: a tolerant reader and an appending writer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import shared_root

# Fixed values.
#: Columns that are whole numbers and measures; all others are text.
COUNTS = ("np", "threads", "nodes", "ppn", "total_cores", "nlist", "nprobe", "k", "test_queries", "cache_hit", "work_min", "work_max", "M", "efConstruction", "efSearch")
MEASURES = ("recall", "latency_us", "bcast_us", "search_avg_us", "search_max_us", "gather_us", "merge_us", "candidate_count_avg", "work_avg", "imbalance_ratio", "build_avg_ms", "build_max_ms", "batch_time_ms", "qps")


#: Splits of files whose places are broadcast at most.
FEW_SPLITS = 1_000_000


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, seq (the line's number in its file, from 0) and line. Files are read by splits, several tasks for a large one.

    A split counts its own lines; what the splits before it hold tells where its numbers begin.
    """
    of_split = ["file", "split"]
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    held = text.groupBy(*of_split).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    shared_root(spark)
    starts = held.select(*of_split, "first_at", F.coalesce(before, F.lit(0)).alias("start")).checkpoint()
    side = F.broadcast(starts) if starts.count() <= FEW_SPLITS else starts
    return text.join(side, of_split).select("file", (F.col("start") + F.col("at") - F.col("first_at")).cast("int").alias("seq"), "line")


def read(spark: SparkSession, path: str, first: str = "run_id") -> DataFrame:
    """Records below a header that begins with ``first``; titles and blank lines above and between are skipped.

    Each file has its own header, wherever its splits begin; columns that a file lacks are null, files without one are skipped.
    Values that aren't numbers become null in number columns. seq is the line's number in its file.
    """
    lines = _lines(spark, path)
    heads = lines.where(F.col("line").startswith(first + ",")).groupBy("file").agg(F.min_by("line", "seq").alias("header"), F.min("seq").alias("at")).checkpoint()  # a row a file
    headers = sorted(r.header for r in heads.select("header").distinct().collect())  # as many as there are kinds of record
    if not headers:
        raise ValueError(f"{path}: no line begins with {first},")
    side = F.broadcast(heads) if heads.count() <= FEW_SPLITS else heads
    rows = lines.join(side, "file").where((F.col("seq") > F.col("at")) & (F.trim("line") != "") & ~F.col("line").startswith(first + ","))
    kinds, found = dict.fromkeys(COUNTS, "bigint") | dict.fromkeys(MEASURES, "double"), None
    for header in headers:
        names = header.split(",")
        parsed = F.from_csv("line", ", ".join(f"`{n}` string" for n in names)).alias("r")
        some = rows.where(F.col("header") == header).select("seq", parsed).select("seq", *(F.col(f"r.`{n}`").try_cast(kinds.get(n, "string")).alias(n) for n in names))
        found = some if found is None else found.unionByName(some, allowMissingColumns=True)
    return found


def append(record: DataFrame, path: str) -> None:
    """Adds records; every task writes its own file, so no lock is needed."""
    record.write.mode("append").option("header", True).csv(path)


def described(records: DataFrame, key: str = "run_id") -> DataFrame:
    """key, place, line: each record as ``column: value`` lines, as a report beside the CSV; nulls are empty."""
    told = F.array(*(F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in records.columns))
    return records.select(F.col(key), F.posexplode(told).alias("place", "line"))
