"""Exact medians of groups of any size, by distributed selection.

Groups of up to ``most`` values are sorted by the aggregate function, one group at a time. For larger ones a mergeable sketch
gives a narrow range about the middle; a second pass counts what lies below the range and, combined
before the shuffle, each value inside it; then ranks are running sums over these counts alone. A range
that should miss the middle ranks is replaced by the whole group, so results never depend on the sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import shared_root

#: Rows of a table with one row a group that are broadcast at most.
BROADCAST_GROUPS = 100_000


def group_sizes(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, bool]:
    """keys and __n, written, and whether the groups are few enough for their tables to be broadcast."""
    shared_root(rows.sparkSession)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).checkpoint()
    return sizes, sizes.count() <= BROADCAST_GROUPS


def joined_groups(rows: DataFrame, groups: DataFrame, keys: list[str], few: bool, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``groups`` (one row for each ``keys``); null keys are equal.

    ``few`` groups are broadcast; more are written first, so that both sides of the join are shuffled by it alone and
    a hot key can be split.
    """
    if not few:
        shared_root(rows.sparkSession)
        groups = groups.checkpoint()
    side = groups.toDF(*(f"__key{keys.index(c)}" if c in keys else c for c in groups.columns))
    on = F.lit(True)
    for i, key in enumerate(keys):
        on = on & F.col(key).eqNullSafe(F.col(f"__key{i}"))
    return rows.join(F.broadcast(side) if few else side, on, how).drop(*(f"__key{i}" for i in range(len(keys))))


def _middle(low: Column, high: Column) -> Column:
    return 0.5 * low + 0.5 * high


def _selected(rows: DataFrame, keys: list[str], metrics: list[str], few: bool, accuracy: int) -> DataFrame:
    """keys and a median of each metric, of groups that no task could hold."""
    around = F.array(F.lit(0.5 - 4 / accuracy), F.lit(0.5 + 4 / accuracy))
    sketches = rows.groupBy(*keys).agg(*(x for i, m in enumerate(metrics) for x in (F.count(m).alias(f"__n{i}"), F.percentile_approx(m, around, accuracy).alias(f"__range{i}"))))
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("metric"), F.col(m).cast("double").alias("value"), F.col(f"__n{i}").alias("n"), F.col(f"__range{i}")[0].cast("double").alias("low"), F.col(f"__range{i}")[1].cast("double").alias("high")) for i, m in enumerate(metrics)))).alias("x")
    values = joined_groups(rows.select(*keys, *dict.fromkeys(metrics)), sketches, keys, few).select(*keys, each).select(*keys, "x.*").where("value IS NOT NULL")
    by = [*keys, "metric"]

    def ranked(some: DataFrame, inside: Column) -> DataFrame:
        """keys, metric, and the values at the middle ranks; null where ``inside`` leaves them out."""
        counts = some.where(inside).groupBy(*by, "n", F.when(F.col("value") >= F.col("low"), F.col("value")).alias("at")).agg(F.count(F.lit(1)).alias("held"))
        upto = F.sum("held").over(Window.partitionBy(*by).orderBy(F.asc_nulls_first("at")).rowsBetween(Window.unboundedPreceding, 0))
        first, second = (F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1)
        at = counts.withColumn("upto", upto).withColumn("from", F.col("upto") - F.col("held"))
        return at.groupBy(*by).agg(*(F.max(F.when((F.col("from") < r) & (F.col("upto") >= r), F.col("at"))).alias(name) for name, r in (("first", first), ("second", second))))

    shared_root(rows.sparkSession)
    found = ranked(values, F.col("value") <= F.col("high")).checkpoint()
    missed = found.where("first IS NULL OR second IS NULL").select(*by)
    if not missed.isEmpty():
        whole = joined_groups(values.withColumns({"low": F.lit(float("-inf")), "high": F.lit(float("nan"))}), missed.withColumn("__again", F.lit(True)), by, few).drop("__again")
        found = found.where("first IS NOT NULL AND second IS NOT NULL").unionByName(ranked(whole, F.lit(True)))
    wide = found.groupBy(*keys).agg(*(F.max(F.when(F.col("metric") == i, _middle(F.col("first"), F.col("second")))).alias(f"__median{i}") for i in range(len(metrics))))
    return wide


def medians(rows: DataFrame, keys: list[str], metrics: list[str], sizes: DataFrame, few: bool, most: int = 100_000, accuracy: int = 10_000) -> DataFrame:
    """keys, __n (rows) and __median<i> of the i-th metric for each group; null where a group has no value. ``sizes`` and ``few`` are of ``group_sizes``."""
    names = [f"__median{i}" for i in range(len(metrics))]
    taken = rows.select(*dict.fromkeys([*keys, *metrics]))
    large = sizes.where(F.col("__n") > most)
    exact = [F.count(F.lit(1)).alias("__n"), *(F.median(m).alias(name) for m, name in zip(metrics, names, strict=True))]
    if large.isEmpty():
        return taken.groupBy(*keys).agg(*exact)
    marked = joined_groups(taken, large.select(*keys, F.lit(True).alias("__large")), keys, few, "left")
    small = marked.where("__large IS NULL").groupBy(*keys).agg(*exact)
    selected = joined_groups(large, _selected(marked.where("__large").drop("__large"), keys, metrics, few, accuracy), keys, few, "left")
    return small.unionByName(selected.select(*small.columns))
