"""SUM(val) by key over the rows that pass a filter, under several plans.

The logical query is one; what differs is how rows are dealt. Catalyst gives
partial and final hash aggregation, pushes the filter to the scan and reads only
the two columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def passing(df: DataFrame, threshold: int | float) -> DataFrame:
    """Rows with val over the threshold; the comparison is strict."""
    return df.filter(F.col("val") > F.lit(threshold))


def grouped_sum(df: DataFrame) -> DataFrame:
    """key, total: a group whose sum is 0 is present, a group without rows is not. Overflow raises (ANSI)."""
    return df.groupBy("key").agg(F.sum("val").alias("total"))


def threshold_sum(df: DataFrame, threshold: int | float) -> DataFrame:
    """Two-phase hash aggregation, the plan Catalyst chooses by itself."""
    return grouped_sum(passing(df, threshold))


def selected_sum(df: DataFrame, selection: Column) -> DataFrame:
    """Aggregation over a selection given as a predicate."""
    return grouped_sum(df.filter(selection))


def partial_sums(df: DataFrame, part: Column, threshold: int | float) -> DataFrame:
    """part, key, partial: the sums of each part by itself."""
    return passing(df.withColumn("part", part), threshold).groupBy("part", "key").agg(F.sum("val").alias("partial"))


def merge_partials(*partials: DataFrame) -> DataFrame:
    """key, total from tables with key and partial."""
    rows = partials[0].select("key", "partial")
    for more in partials[1:]:
        rows = rows.unionByName(more.select("key", "partial"))
    return rows.groupBy("key").agg(F.sum("partial").alias("total"))


def range_partitioned_sum(df: DataFrame, threshold: int | float, parts: int) -> DataFrame:
    """Sums dealt by sampled key ranges. Rows are summed by key before any exchange, so a hot key moves as one row a task."""
    return threshold_sum(df, threshold).repartitionByRange(parts, "key")


def adaptive_sum(df: DataFrame, threshold: int | float) -> DataFrame:
    """Sums dealt by key, in partitions that adaptive execution merges and splits by what they hold; no raw row moves."""
    return threshold_sum(df, threshold).hint("rebalance", "key")


def first_groups(totals: DataFrame, n: int = 10) -> DataFrame:
    """The groups with the smallest keys."""
    return totals.orderBy("key").limit(n)
