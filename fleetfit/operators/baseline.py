"""Measured baseline per environment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetfit import schemas as S
from fleetfit.operators.quantiles import NO_LARGE_GROUPS, LargeGroups, grouped

KEY = ["environment_id"]
CPU, MEMORY, LATENCY, REQUESTS, AVAILABILITY = S.METRICS


def _parts() -> dict[str, tuple[list[Column], dict[str, tuple[str, float]]]]:
    """Aggregates and percentiles of each metric family."""
    violations = F.count_if(F.col(AVAILABILITY) < S.AVAILABILITY_SLO)
    return {
        "cpu": (
            [F.avg(CPU).alias("mean_cpu"), F.max(CPU).alias("peak_cpu")],
            {"median_cpu": (CPU, 0.5), "p95_cpu": (CPU, 0.95)},
        ),
        "memory": (
            [F.avg(MEMORY).alias("mean_memory"), F.max(MEMORY).alias("peak_memory")],
            {"p95_memory": (MEMORY, 0.95)},
        ),
        "traffic": (
            [F.avg(REQUESTS).alias("mean_request_volume"), F.max(REQUESTS).alias("peak_request_volume")],
            {"p95_request_volume": (REQUESTS, 0.95)},
        ),
        "latency": (
            [F.avg(LATENCY).alias("mean_latency")],
            {"p95_latency": (LATENCY, 0.95), "p99_latency": (LATENCY, 0.99)},
        ),
        "reliability": (
            [F.avg(AVAILABILITY).alias("measured_availability"), violations.alias("slo_violations")],
            {},
        ),
    }


def baseline(
    telemetry: DataFrame,
    families: list[str] | None = None,
    large: LargeGroups = NO_LARGE_GROUPS,
    approx: bool = False,
) -> DataFrame:
    """One row per environment with the metrics of the chosen families (all by default).

    Everything asked for comes from one aggregation, and only the needed columns are read.
    """
    parts = _parts()
    aggregates: list[Column] = []
    percentiles: dict[str, tuple[str, float]] = {}
    for family in families or list(parts):
        plain, pct = parts[family]
        aggregates += plain
        percentiles |= pct
    return grouped(telemetry, KEY, percentiles, aggregates, large, approx)
