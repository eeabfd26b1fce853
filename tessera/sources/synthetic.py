"""Synthetic (key, val) rows: each row is a function of its id, so any partitioning gives the same table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: Modulus of the draws.
PRIME = 2**31 - 1


@dataclass(frozen=True)
class SyntheticTable:
    """Uniform keys in [0, keys) and values in [low, high)."""

    rows: int = 10_000_000
    keys: int = 100
    low: int = 0
    high: int = 1000
    seed: int = 42

    def draw(self, row_id: str, stream: int) -> str:
        """SQL of a number below 2^31 - 1 that a row id gives: steps modulo that prime, none of which leaves 64 bits."""
        first = f"(({row_id} % {PRIME} * 48271 + {row_id} / {PRIME} * 7919 + {(self.seed * 1009 + stream * 65537) % PRIME}) % {PRIME})".replace(" / ", " {div} ")
        second = f"(({first} * {first} + {row_id} % 8191 * 16807 + {stream}) % {PRIME})"
        return f"({second} * 69621 % {PRIME} * 40014 % {PRIME})"

    def columns(self, row_id: str, div: str) -> tuple[str, str]:
        """SQL of a row's key and value; ``div`` is the dialect's integer division."""
        key, val = (self.draw(row_id, k).replace("{div}", div) for k in (1, 2))
        return f"{key} % {self.keys}", f"{val} % {self.high - self.low} + {self.low}"

    def read(self, spark: SparkSession) -> DataFrame:
        key, val = self.columns("row_id", "div")
        return spark.range(self.rows).withColumnRenamed("id", "row_id").selectExpr("row_id", f"{key} AS key", f"{val} AS val")

    def sql(self) -> str:
        """The same table as a DuckDB query."""
        key, val = self.columns("row_id", "//")
        return f"SELECT row_id, {key} AS key, {val} AS val FROM (SELECT unnest(range({self.rows})) AS row_id) r"
