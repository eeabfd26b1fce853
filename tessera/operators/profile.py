"""Measurement: timers, latency percentiles and observed row counts. Percentiles, never averages."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F

#: Reported percentiles.
POINTS = {"p50": 0.5, "p99": 0.99, "p999": 0.999, "p9999": 0.9999}


def latency_report(df: DataFrame, value: str, by: Sequence[str] = (), accuracy: int | None = None) -> DataFrame:
    """n, discrete percentiles and max of a column, for each group.

    Exact percentiles keep a count of each distinct value of a group in memory. With
    ``accuracy`` a summary of bounded size takes their place, whose values are off by at most n /
    ``accuracy`` ranks: for groups of many distinct values.
    """
    if accuracy:
        points = [F.percentile_approx(value, p, accuracy).alias(name) for name, p in POINTS.items()]
    else:
        points = [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").alias(name) for name, p in POINTS.items()]
    return df.groupBy(*by).agg(F.count(value).alias("n"), *points, F.max(value).alias("max"))


@dataclass
class Latencies:
    """Samples by stage, in nanoseconds."""

    samples: dict[str, list[int]] = field(default_factory=dict)

    @contextmanager
    def measure(self, stage: str) -> Iterator[None]:
        start = time.perf_counter_ns()
        try:
            yield
        finally:
            self.record(stage, time.perf_counter_ns() - start)

    def record(self, stage: str, ns: int) -> None:
        self.samples.setdefault(stage, []).append(ns)

    def reset(self) -> None:
        self.samples.clear()

    def __len__(self) -> int:
        return sum(map(len, self.samples.values()))

    def percentile(self, stage: str, p: float) -> int:
        """The smallest sample that at least the share ``p`` of samples does not exceed; 0 without samples."""
        ordered = sorted(self.samples.get(stage, []))
        return ordered[max(0, -(-int(p * 1e6) * len(ordered) // 1_000_000) - 1)] if ordered else 0

    def markdown(self, engine: str) -> list[str]:
        rows = []
        for stage, ns in self.samples.items():
            cells = [engine, stage, *(self.percentile(stage, p) for p in POINTS.values()), max(ns), len(ns)]
            rows.append("| " + " | ".join(map(str, cells)) + " |")
        return rows

    def summary(self) -> str:
        """Share of each stage in the whole; 0 % if nothing took time."""
        total = sum(map(sum, self.samples.values()))
        return "\n".join(f"{s}: {sum(ns)} ns ({100 * sum(ns) / total if total else 0:.1f}%)" for s, ns in self.samples.items())


def observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """The table, and metrics that fill as an action reads it."""
    watch = Observation(name)
    return df.observe(watch, *(c.alias(k) for k, c in metrics.items())), watch


def instrumented(plan: Callable[[], DataFrame], latencies: Latencies, repeats: int = 1) -> list:
    """Rows of a query; planning and execution are timed apart."""
    rows = []
    for _ in range(repeats):
        with latencies.measure("plan"):
            df = plan()
            df._jdf.queryExecution().executedPlan()
        with latencies.measure("execute"):
            rows = df.collect()
    return rows


def profiled(df: DataFrame, plan: Callable[[DataFrame], DataFrame], name: str, passes: Column) -> Row:
    """Run a plan over ``df`` and report it: rows read and passed, groups, the sum of totals, and the time of each stage.

    Counts are observed as the plan runs, so nothing is read twice.
    """
    latencies = Latencies()
    rows, watch = observed(df, f"read by {name}", rows_read=F.count("*"), rows_passed=F.count_if(passes))
    with latencies.measure("plan"):
        out, result = observed(plan(rows), f"returned by {name}", groups=F.count("*"), total=F.sum("total"))
        out._jdf.queryExecution().executedPlan()
    with latencies.measure("execute"):
        out.write.format("noop").mode("overwrite").save()
    read, returned = watch.get, result.get
    ns = {stage: latencies.samples[stage][0] for stage in ("plan", "execute")}
    return Row(plan=name, rows_read=read["rows_read"], rows_passed=read["rows_passed"], groups=returned["groups"], total=returned["total"], plan_ns=ns["plan"], execute_ns=ns["execute"])


@dataclass(frozen=True)
class Environment:
    """Context switches of this process and interrupts of the machine so far."""

    voluntary: int
    involuntary: int
    interrupts: int

    @classmethod
    def now(cls) -> Environment:
        status = dict(x.split(":", 1) for x in Path("/proc/self/status").read_text().splitlines() if ":" in x)
        stat = Path("/proc/stat").read_text().split("\nintr ", 1)
        return cls(int(status["voluntary_ctxt_switches"]), int(status["nonvoluntary_ctxt_switches"]), int(stat[1].split(" ", 1)[0]) if len(stat) > 1 else 0)

    def clean_until(self, later: Environment, most_interrupts: int = 10_000) -> tuple[bool, bool]:
        """Whether nothing preempted the process, and whether interrupts stayed few."""
        return later.involuntary == self.involuntary, later.interrupts - self.interrupts <= most_interrupts
