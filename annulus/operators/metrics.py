"""Analysis of run records: grouped statistics, outliers, speedup, breakdown, comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import rounded
from .medians import BROADCAST_GROUPS, group_sizes, joined_groups
from .medians import medians as medians_of

# Fixed values.
#: (metric, factor over the group's median, whether latency must be over 1.10 times its own as well).
OUTLIER_RULES = (("latency_us", 1.15, False), ("gather_us", 4.0, True), ("search_max_us", 1.30, True))


def summary(runs: DataFrame, keys: list[str], metrics: list[str], digits: int = 4) -> DataFrame:
    """Mean of each metric and the number of runs, by configuration."""
    return runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("runs"), *(rounded(F.avg(m), digits).alias(f"{m}_mean") for m in metrics))


def mean_std(runs: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Mean and sample deviation of each metric, and the number of runs used."""
    pairs = [x for m in metrics for x in (rounded(F.avg(m), 4).alias(f"{m}_mean"), rounded(F.stddev_samp(m), 4).alias(f"{m}_std"))]
    return runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("used_count"), *pairs)


def _flags(middle: dict[str, Column], least_runs: int) -> Column:
    """The reasons of a run by its group's medians and __n; empty if there are none."""
    slow = F.col("latency_us") > 1.10 * middle["latency_us"]
    reasons = []
    for metric, factor, with_latency in OUTLIER_RULES:
        over = F.col(metric) > factor * middle[metric]
        if with_latency:
            over = over & (middle[metric] > 0) & slow
        reasons.append(F.when(over, F.lit(f"{metric} > {factor:.2f} x median")))
    return F.when(F.col("__n") >= least_runs, F.concat_ws("; ", *reasons)).otherwise(F.lit("")).alias("__reasons")


def outliers(runs: DataFrame, keys: list[str], least_runs: int = 4, least_left: int = 3, most: int = 100_000) -> DataFrame:
    """``runs`` with reasons and removed.

    In groups of at least ``least_runs``, a run is flagged if a metric is over its factor of the group's
    median; flagged runs are removed only if ``least_left`` stay. Medians are exact. Runs are counted by group first:
    groups of up to ``most`` runs take one shuffle, by the keys, and windows of that size; of larger ones no task holds a
    group, as medians and counts are one row a group, combined before the shuffle and joined back.
    """
    metrics = [m for m, _, _ in OUTLIER_RULES]
    middle = {m: F.col(f"__median{i}") for i, m in enumerate(metrics)}
    kept = F.count(F.when(F.col("__reasons") == "", 1))

    def by_windows(some: DataFrame) -> DataFrame:
        group = Window.partitionBy(*keys)
        held = some.withColumns({"__n": F.count(F.lit(1)).over(group)} | {f"__median{i}": F.median(m).over(group) for i, m in enumerate(metrics)})
        return held.select("*", _flags(middle, least_runs)).withColumn("__left", kept.over(group))

    def by_joins(some: DataFrame, sizes: DataFrame, few: bool) -> DataFrame:
        flagged = joined_groups(some, medians_of(some, keys, metrics, sizes, few, most), keys, few).select("*", _flags(middle, least_runs))
        return joined_groups(flagged, flagged.groupBy(*keys).agg(kept.alias("__left")), keys, few)

    sizes, _ = group_sizes(runs, keys)
    large = sizes.where(F.col("__n") > most)
    number = large.count()
    if not number:
        found = by_windows(runs)
    else:
        few = number <= BROADCAST_GROUPS
        marked = joined_groups(runs, large.select(*keys, F.lit(True).alias("__large")), keys, few, "left")
        small, crowded = (marked.where(x).drop("__large") for x in (F.col("__large").isNull(), F.col("__large").isNotNull()))
        found = by_windows(small).unionByName(by_joins(crowded, large, few))
    marked = found.withColumn("__removed", (F.col("__reasons") != "") & (F.col("__left") >= least_left))
    return marked.select(*runs.columns, F.when(F.col("__removed"), F.col("__reasons")).otherwise(F.lit("")).alias("reasons"), F.col("__removed").alias("removed"))


def cleaned(runs: DataFrame, keys: list[str]) -> DataFrame:
    return outliers(runs, keys).where(~F.col("removed")).select(*runs.columns)


def counted_summary(runs: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Means of the runs that stay after cleaning, with used_count and raw_count."""
    stays = ~F.col("removed")
    means = (rounded(F.avg(F.when(stays, F.col(m))), 8).alias(f"{m}_mean") for m in metrics)
    return outliers(runs, keys).groupBy(*keys).agg(F.count(F.when(stays, 1)).alias("used_count"), *means, F.count(F.lit(1)).alias("raw_count"))


def speedup(means: DataFrame, by: list[str], size: str, latency: str) -> DataFrame:
    """Adds speedup over each group's smallest size, and efficiency, speedup per unit of size."""
    first = F.first(latency).over(Window.partitionBy(*by).orderBy(size).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ratio = first / F.col(latency)
    return means.withColumns({"speedup": rounded(ratio), "efficiency": rounded(ratio / F.col(size))})


def breakdown(runs: DataFrame) -> DataFrame:
    """Adds other_us: latency that no stage accounts for, never below 0."""
    rest = F.col("latency_us") - F.col("bcast_us") - F.col("search_max_us") - F.col("gather_us") - F.col("merge_us")
    return runs.withColumn("other_us", rounded(F.greatest(F.lit(0.0), rest), 4))


def comm_ratio(runs: DataFrame) -> DataFrame:
    """Adds comm_pct, the share of communication and merging in the latency."""
    part = (F.col("bcast_us") + F.col("gather_us") + F.col("merge_us")) / F.col("latency_us") * 100
    return runs.withColumn("comm_pct", rounded(F.when(F.col("latency_us") > 0, part).otherwise(F.lit(0.0)), 4))


def compare(old: DataFrame, new: DataFrame, label: str, metric: str) -> DataFrame:
    """label, old, new and the ratio of two results with the same label."""
    both = old.select(label, F.col(metric).alias("old")).join(new.select(label, F.col(metric).alias("new")), label)
    return both.withColumn("ratio", rounded(F.col("new") / F.col("old")))


def baseline_align(means: DataFrame, baseline: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """``means`` with the baseline of the same keys and the difference; keys without one are left out."""
    return means.join(baseline, keys).withColumn("difference", rounded(F.col(metric) - F.col(f"baseline_{metric}"), 4))


def pick(runs: DataFrame, **values) -> DataFrame:
    """The runs of one configuration; ValueError if there is none."""
    found = runs.where(F.lit(True))
    for column, value in values.items():
        found = found.where(F.col(column) == F.lit(value))
    if found.isEmpty():
        raise ValueError(f"no run has {values}")
    return found


def best(means: DataFrame, metric: str, ties: list[str], ascending: bool = True) -> DataFrame:
    """The one best row."""
    return means.orderBy(F.col(metric).asc() if ascending else F.col(metric).desc(), *ties).limit(1)


def ordered(means: DataFrame, column: str, order: list[str]) -> DataFrame:
    """``means`` with position: the place of ``column`` in a given order, 0 for values not in it."""
    return means.withColumn("position", F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col(column)), F.lit(0)).cast("int"))


def latest(runs: DataFrame, sequence: str) -> DataFrame:
    """The run recorded last, by a sequence that ingestion keeps."""
    return runs.orderBy(F.desc(sequence)).limit(1)
