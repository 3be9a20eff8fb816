"""Latency and availability of a row under projected pressure."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fleetfit import schemas as S


def pressure(cpu: Column, memory: Column) -> Column:
    """The binding resource. Unknown when either side is unknown (greatest() would skip nulls)."""
    return F.when(cpu.isNotNull() & memory.isNotNull(), F.greatest(cpu, memory))


def latency_penalty(load: Column) -> Column:
    """Mild slope, queueing curve, saturation curve. No penalty for an unknown load.

    The curve drops where saturation starts, so the percentile of the latency must come from the
    rows and not from the percentile of the load.
    """
    comfort, full = S.COMFORT_PRESSURE, S.SATURATION_PRESSURE
    return (
        F.when(load >= full, 100.0 + F.pow(load - full, F.lit(2.0)))
        .when(load > comfort, 5.0 + F.pow(load - comfort, F.lit(1.5)))
        .when(load <= comfort, load / comfort * 5.0)
        .otherwise(0.0)
    )


def projected_latency(load: Column) -> Column:
    return F.lit(S.BASE_LATENCY_MS) + latency_penalty(load)


def projected_availability(load: Column) -> Column:
    degraded = 100.0 - (load - S.AVAILABILITY_PRESSURE) * 0.5
    return F.when(
        load > S.AVAILABILITY_PRESSURE, F.greatest(F.least(degraded, F.lit(100.0)), F.lit(0.0))
    ).otherwise(100.0)
