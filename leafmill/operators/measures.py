"""Aggregates with stated ties: modes, medians, shares, runs, bands and multisets.

Each is one aggregation, pre-combined on the map side, and at most a window
over its result; a group's rows never meet in a list unless the group is a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def smallest_mode(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """The most frequent value of each group, the smaller one of equals; nulls don't count."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    first = Window.partitionBy(*group).orderBy(F.col("n").desc(), value)
    return counts.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")


def top_share(rows: DataFrame, group: list[str], value: str, least: int = 60, share: float = 0.7) -> DataFrame:
    """How many values each group of ``least`` values has, the share of its most frequent one, and whether that is above ``share``."""
    t = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("n")).groupBy(*group).agg(F.sum("n").alias("n_values"), F.max("n").alias("most"))
    return t.where(F.col("n_values") >= least).select(*group, "n_values", F.round(F.col("most") / F.col("n_values"), 6).alias("top_share"), (F.col("most") > share * F.col("n_values")).alias("degenerate"))


def upper_median(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """The value in the middle of each group's values in order, the upper one of two; found by rank, so no group is a list."""
    order = Window.partitionBy(*group).orderBy(value)
    kept = rows.where(F.col(value).isNotNull()).withColumn("_k", F.row_number().over(order)).join(rows.groupBy(*group).agg(F.count(value).alias("_n")), group)
    return kept.where(F.col("_k") == F.floor(F.col("_n") / 2) + 1).select(*group, F.col(value).alias("upper_median"))


def largest(rows: DataFrame, group: list[str], size: Column, order: str) -> DataFrame:
    """The row of each group with the greatest size, the first in ``order`` of equals."""
    sized = rows.withColumn("size", size)
    return sized.groupBy(*group).agg(F.max_by(F.struct(order, "size"), F.struct("size", -F.col(order))).alias("b")).select(*group, "b.*")


def tallest(rows: DataFrame, group: list[str], size: Column, order: str, n: int) -> DataFrame:
    """The ``n`` rows of each group with the greatest size, first in ``order`` of equals, with their rank."""
    best = Window.partitionBy(*group).orderBy(F.col("size").desc(), order)
    return rows.withColumn("size", size).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n).select(*group, order, "size", "rank")


def bands(rows: DataFrame, group: list[str], low: str, high: str, gap: float = 0.0) -> DataFrame:
    """Stretches that the intervals of a group cover together; intervals nearer than ``gap`` make one."""
    order = Window.partitionBy(*group).orderBy(low, high)
    reach = F.max(high).over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = rows.where(F.col(low).isNotNull() & F.col(high).isNotNull()).withColumn("_s", F.coalesce((F.col(low) > reach + gap).cast("int"), F.lit(1)))
    numbered = starts.withColumn("band", F.sum("_s").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*group, "band").agg(F.min(low).alias("from"), F.max(high).alias("to"), F.count(F.lit(1)).alias("n"))


def multiset(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """How often each value comes in each group."""
    return rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))


def superset(old: DataFrame, new: DataFrame, group: list[str], value: str) -> DataFrame:
    """For each group of ``old`` whether ``new`` has every value at least as often, and how many are lacking."""
    a = multiset(old, group, value)
    b = multiset(new, group, value).withColumnRenamed("n", "m")
    lack = F.greatest(F.col("n") - F.coalesce("m", F.lit(0)), F.lit(0))
    return a.join(b, [*group, value], "left").groupBy(*group).agg((F.sum(lack) == 0).alias("kept"), F.sum(lack).alias("n_lacking"))
