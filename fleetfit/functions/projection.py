"""Request and utilization projection of one telemetry row."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Traffic profiles and their multipliers.
PROFILES = ("steady", "peak", "bursty", "low-traffic", "seasonal")
PEAK_QUANTILE = 0.9
PEAK_FACTOR = 1.5
BURST_SHARE = 0.05
BURST_FACTOR = 3.0
LOW_TRAFFIC_FACTOR = 0.5
SEASON_AMPLITUDE = 0.3
SEASON_HOURS = 24.0


def seasonal_factor(position: Column) -> Column:
    """Daily wave by 0-based hour position within the environment."""
    return 1.0 + SEASON_AMPLITUDE * F.sin(2.0 * F.pi() * position / SEASON_HOURS)


def request_ratio(projected: Column, observed: Column) -> Column:
    """Projected over observed requests; an idle row divides by one and stays at zero load."""
    return projected / F.when(observed == 0, 1.0).otherwise(observed)


def projected_utilization(observed: Column, capacity_ratio: Column, ratio: Column, pressure: Column) -> Column:
    """Linear scaling with capacity and traffic, inflated by the assumed pressure; never clipped."""
    return observed * capacity_ratio * ratio * (1.0 + pressure)
