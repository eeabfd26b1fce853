"""Equi-joins of (key, payload) tables as sort-merge joins; Spark sorts, so inputs may come in any order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _sides(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    return left.select("key", F.col("payload").alias("lp")), right.select("key", F.col("payload").alias("rp"))


def inner_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """key, lp, rp: every pair of rows with equal keys. A NULL key matches nothing."""
    a, b = _sides(left, right)
    return a.hint("merge").join(b, "key").select("key", "lp", "rp")


def left_outer_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """key, lp, rp: as above, and left rows without a match once, with a NULL rp."""
    a, b = _sides(left, right)
    return a.hint("merge").join(b, "key", "left").select("key", "lp", "rp")
