"""Risk, health and scenario labels, and prediction accuracy."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fleetfit import schemas as S

# Label thresholds.
MIGRATION_RISK = {"CRITICAL": 90.0, "HIGH": 80.0, "MEDIUM": 60.0}
PORTFOLIO_RISK = {"LOW": 60.0, "MEDIUM": 80.0}
BURSTY_STDDEV = 100.0
NORMAL_STDDEV = 50.0
HEALTH_MARGIN = 10.0
MAX_DEGRADED_CHECKPOINTS = 2

ROLLBACK = "ROLLBACK_REQUIRED"
DEGRADED = "DEGRADED"
STABLE = "STABLE"


def migration_risk(peak_cpu: Column, latency_ok: Column, availability_ok: Column) -> Column:
    """Risk of one move; unknown without a simulation, critical when a target breaks."""
    slo_broken = ~F.coalesce(latency_ok, F.lit(False)) | ~F.coalesce(availability_ok, F.lit(False))
    return (
        F.when(latency_ok.isNull() & availability_ok.isNull() & peak_cpu.isNull(), "UNKNOWN")
        .when(slo_broken | (peak_cpu > MIGRATION_RISK["CRITICAL"]), "CRITICAL")
        .when(peak_cpu > MIGRATION_RISK["HIGH"], "HIGH")
        .when(peak_cpu > MIGRATION_RISK["MEDIUM"], "MEDIUM")
        .otherwise("LOW")
    )


def portfolio_risk(peak_cpu: Column, selected: Column) -> Column:
    """Risk of the selected candidate; other bounds than the risk of a single move."""
    return (
        F.when(selected.isNull(), "UNKNOWN")
        .when(peak_cpu < PORTFOLIO_RISK["LOW"], "LOW")
        .when(peak_cpu < PORTFOLIO_RISK["MEDIUM"], "MEDIUM")
        .otherwise("HIGH")
    )


def operational_risk(decision: Column) -> Column:
    return F.when(decision == S.SAFE, "LOW").otherwise("HIGH")


def health(
    cpu: Column,
    memory: Column,
    latency: Column,
    availability: Column,
    latency_target: float = S.LATENCY_SLO_MS,
    availability_target: float = S.AVAILABILITY_SLO,
    max_cpu: float = S.MAX_SAFE_UTILIZATION,
    max_mem: float = S.MAX_SAFE_UTILIZATION,
) -> Column:
    """Health of one reading: limits first, then targets, then the margin below the limits."""
    near_limit = (cpu > max_cpu - HEALTH_MARGIN) | (memory > max_mem - HEALTH_MARGIN)
    return (
        F.when((cpu > max_cpu) | (memory > max_mem), ROLLBACK)
        .when((latency > latency_target) | (availability < availability_target) | near_limit, DEGRADED)
        .otherwise(STABLE)
    )


def health_verdict(any_rollback: Column, degraded: Column) -> Column:
    return F.when(any_rollback | (degraded > MAX_DEGRADED_CHECKPOINTS), ROLLBACK).otherwise(STABLE)


def scenario_class(request_stddev: Column) -> Column:
    """'bursty' or 'normal' by the spread of the request volume, null between the two bounds."""
    return F.when(request_stddev > BURSTY_STDDEV, "bursty").when(request_stddev < NORMAL_STDDEV, "normal")


def absolute_error(predicted: Column, observed: Column) -> Column:
    return F.abs(predicted - observed)


def percentage_error(predicted: Column, observed: Column) -> Column:
    return (
        F.when((observed == 0) & (predicted == 0), 0.0)
        .when(observed == 0, 100.0)
        .otherwise(F.abs(predicted - observed) / observed * 100.0)
    )
