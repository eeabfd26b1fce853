"""Zone maps: which batches a predicate cannot match, from their least and largest values.

Parquet row groups are skipped by Spark itself; a zone map as a table makes the
decision visible and works for batches of any definition.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.predicate import MIRROR, And, Col, In, Lit, Node, Op, Or


def zone_map(df: DataFrame, batch: Column, columns: Sequence[str]) -> DataFrame:
    """batch_id, n, and min_c and max_c of each column."""
    bounds = [f(c).alias(f"{name}_{c}") for c in columns for name, f in (("min", F.min), ("max", F.max))]
    return df.groupBy(batch.alias("batch_id")).agg(F.count("*").alias("n"), *bounds)


def prunable(node: Node, columns: Sequence[str]) -> Column:
    """True for a batch that no row of can match; false if unsure. ``columns`` are the predicate's, by position."""
    return (F.col("n") == 0) | _prunable(node, columns)


def _prunable(node: Node, columns: Sequence[str]) -> Column:
    if isinstance(node, And):
        return functools.reduce(operator.or_, [_prunable(c, columns) for c in node.children], F.lit(False))
    if isinstance(node, Or):
        return functools.reduce(operator.and_, [_prunable(c, columns) for c in node.children], F.lit(True))
    if isinstance(node, In):
        return functools.reduce(operator.and_, [_outside(columns[node.index], v) for v in node.values], F.lit(True))
    if not isinstance(node, Op):
        return F.lit(False)
    left, right, sign = node.left, node.right, node.sign
    if isinstance(left, Lit) and isinstance(right, Col):
        left, right, sign = right, left, MIRROR.get(sign, sign)
    if not (isinstance(left, Col) and isinstance(right, Lit)) or type(right.value) is not int:
        return F.lit(False)
    name, v = columns[left.index], right.value
    low, high = F.col(f"min_{name}"), F.col(f"max_{name}")
    rules = {">": high <= v, ">=": high < v, "<": low >= v, "<=": low > v, "=": _outside(name, v)}
    return rules.get(sign, F.lit(False))


def _outside(name: str, v: int) -> Column:
    return (F.lit(v) < F.col(f"min_{name}")) | (F.lit(v) > F.col(f"max_{name}"))


def scan_unpruned(df: DataFrame, batch: Column, zones: DataFrame, node: Node, columns: Sequence[str]) -> DataFrame:
    """Rows of the batches that may match. The zone map has a row a batch; Spark decides whether to broadcast it."""
    keep = zones.filter(~prunable(node, columns)).select("batch_id")
    return df.withColumn("batch_id", batch).join(keep, "batch_id", "left_semi")
