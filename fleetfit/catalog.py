"""The instance catalog: a small configuration object, never data.

Type order matters (it breaks ties between candidates), so the catalog keeps an ordinal per type.
Tables derived from it are local relations of known size. Up to ``BROADCAST_ROWS`` rows they ask to
be broadcast, whatever the session's threshold: a shuffle by instance type would gather a third of
the telemetry in one task. Beyond that the planner decides by their size.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetfit.session import local_rows

BROADCAST_ROWS = 100_000

TYPE_COLUMNS = {
    "ordinal": pa.int32(),
    "instance_type": pa.string(),
    "vcpu": pa.int32(),
    "memory_gb": pa.int32(),
    "base_price": pa.float64(),
}
MOVE_COLUMNS = {
    "current_instance_type": pa.string(),
    "candidate_instance_type": pa.string(),
    "candidate_ordinal": pa.int32(),
    "cpu_ratio": pa.float64(),
    "mem_ratio": pa.float64(),
}


def _small(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


@dataclass(frozen=True)
class InstanceType:
    name: str
    vcpu: int
    memory_gb: int
    base_price: float


@dataclass(frozen=True)
class InstanceCatalog:
    types: tuple[InstanceType, ...]

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, t.name, t.vcpu, t.memory_gb, t.base_price) for i, t in enumerate(self.types)]
        return _small(local_rows(spark, rows, TYPE_COLUMNS), len(rows))

    def ratios(self, moves: DataFrame) -> DataFrame:
        """``moves`` that name current and candidate type, with their capacity ratios; linear in the types.

        Moves of a type that the catalog does not have are left out."""
        table = self.table(moves.sparkSession)
        own = table.select(F.col("instance_type").alias("current_instance_type"), F.col("vcpu").alias("_cpu"), F.col("memory_gb").alias("_mem"))
        other = table.select(
            F.col("instance_type").alias("candidate_instance_type"), F.col("ordinal").alias("candidate_ordinal"), "vcpu", "memory_gb"
        )
        both = moves.join(own, "current_instance_type").join(other, "candidate_instance_type")
        ratio = {"cpu_ratio": F.col("_cpu") / F.col("vcpu"), "mem_ratio": F.col("_mem") / F.col("memory_gb")}
        return both.withColumns(ratio).drop("_cpu", "_mem", "vcpu", "memory_gb")

    def pairs(self, policy: str) -> list[tuple[InstanceType, InstanceType, int]]:
        """(current, candidate, candidate ordinal) for a policy.

        ``any``  every ordered pair, ``self`` each type with itself, ``cheaper`` every strictly
        cheaper type, ``cheaper_and_self`` both, ``step_down`` the next cheaper type, ``step_down_or_self`` the same with the
        cheapest type paired with itself.
        """
        by_price = sorted(enumerate(self.types), key=lambda item: (item[1].base_price, item[0]))
        prices = [t.base_price for _, t in by_price]
        out = []
        for own_ordinal, current in by_price:
            first = bisect_left(prices, current.base_price)
            cheaper = by_price[:first] if policy.startswith("cheaper") else by_price[max(first - 1, 0) : first]
            if policy == "any":
                chosen = list(enumerate(self.types))
            elif policy == "self":
                chosen = [(own_ordinal, current)]
            elif policy == "cheaper":
                chosen = cheaper
            elif policy == "cheaper_and_self":
                chosen = cheaper + [(own_ordinal, current)]
            elif policy == "step_down":
                chosen = cheaper[-1:]
            elif policy == "step_down_or_self":
                chosen = cheaper[-1:] or [(own_ordinal, current)]
            else:
                raise ValueError(f"unknown move policy: {policy}")
            out += [(current, candidate, ordinal) for ordinal, candidate in chosen]
        return out

    def moves(self, spark: SparkSession, policy: str) -> DataFrame:
        """Move table of a policy with the capacity ratios of each move."""
        rows = [
            (a.name, b.name, ordinal, a.vcpu / b.vcpu, a.memory_gb / b.memory_gb)
            for a, b, ordinal in self.pairs(policy)
        ]
        return _small(local_rows(spark, rows, MOVE_COLUMNS), len(rows))


# The three types every published run uses, in catalog order.
DEFAULT_CATALOG = InstanceCatalog(
    (
        InstanceType("small", 2, 8, 0.05),
        InstanceType("medium", 4, 16, 0.10),
        InstanceType("large", 8, 32, 0.20),
    )
)
