"""Command line: ``python -m tessera.report [rows] [keys] [threshold]`` compares plans of one aggregation.

Every plan runs over the same synthetic table. The report has a line a plan, with what it
read, what it exchanged and how long it took, and ends with the groups of the largest sums.
"""

from __future__ import annotations

import statistics
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.operators import aggregate
from tessera.operators.profile import profiled
from tessera.sources.synthetic import SyntheticTable

LARGEST = 5


def run(spark: SparkSession, rows: int = 10_000_000, keys: int = 100, threshold: int = 500, repeats: int = 5) -> list[str]:
    table = SyntheticTable(rows=rows, keys=keys).read(spark).select("key", "val").cache()
    table.count()
    parts = 4 * spark.sparkContext.defaultParallelism
    plans = {
        "two-phase": lambda df: aggregate.threshold_sum(df, threshold),
        "key ranges": lambda df: aggregate.range_partitioned_sum(df, threshold, parts),
        "rebalanced": lambda df: aggregate.adaptive_sum(df, threshold),
    }
    lines, results = [f"{rows} rows, {keys} keys, values over {threshold}; medians of {repeats} runs"], set()
    for name, plan in plans.items():
        profiled(table, plan, name, F.col("val") > threshold)  # compiles code
        runs = [profiled(table, plan, name, F.col("val") > threshold) for _ in range(repeats)]
        results |= {(r.rows_passed, r.groups, r.total) for r in runs}
        exchanges = plan(table)._jdf.queryExecution().executedPlan().toString().count("Exchange ")
        planned, executed = (statistics.median(r[c] for r in runs) / 1e6 for c in ("plan_ns", "execute_ns"))
        lines.append(f"{name}: passed {runs[0].rows_passed} of {runs[0].rows_read}, {runs[0].groups} groups, {exchanges} exchanges, planned in {planned:.1f} ms, run in {executed:.1f} ms")
    if len(results) != 1:
        raise AssertionError(f"the plans disagree: {sorted(results)}")
    top = aggregate.threshold_sum(table, threshold).orderBy(F.desc("total"), "key").limit(LARGEST).collect()
    table.unpersist()
    return [*lines, "largest sums: " + ", ".join(f"{r.total} (key {r.key})" for r in top)]


if __name__ == "__main__":
    session = SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").getOrCreate()
    print("\n".join(run(session, *map(int, sys.argv[1:4]))))
