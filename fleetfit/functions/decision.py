"""The safety gate: reason codes, reason texts and the decision label."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fleetfit import schemas as S
from fleetfit.functions.common import fixed

# Gate codes in reporting order.
NO_COST_BENEFIT = "NO_COST_BENEFIT"
LATENCY_SLO = "LATENCY_SLO_FAILURE"
AVAILABILITY_SLO = "AVAILABILITY_SLO_FAILURE"
CPU_LIMIT = "CPU_SATURATION"
MEMORY_LIMIT = "MEMORY_SATURATION"
NO_TELEMETRY = "MISSING_TELEMETRY"
LOW_QUALITY = "INVALID_TELEMETRY"
INCOMPLETE = "INSUFFICIENT_TELEMETRY"
NO_PRICE = "MISSING_PRICE"


def _gates() -> list[tuple[str, Column]]:
    """(code, fires) in reporting order. A null comparison does not fire."""
    c = F.col
    return [
        (NO_COST_BENEFIT, c("absolute_monthly_saving") <= 0),
        (LATENCY_SLO, ~c("latency_satisfied")),
        (AVAILABILITY_SLO, ~c("availability_satisfied")),
        (CPU_LIMIT, c("peak_cpu") > c("max_cpu")),
        (MEMORY_LIMIT, c("peak_mem") > c("max_mem")),
    ]


def _over_limit(metric: str, peak: str, bound: str) -> Column:
    limit = F.col(bound)
    # Whole limits print without a decimal point.
    shown = F.when(limit == F.floor(limit), F.floor(limit).cast("string")).otherwise(limit.cast("string"))
    return F.concat(
        F.lit(f"Projected peak {metric} = "), fixed(F.col(peak), 1), F.lit("% exceeds safe limit ("), shown, F.lit("%)")
    )


def _gate_texts() -> list[Column]:
    """The texts of the gates, in the same order."""
    latency, availability = F.col("projected_p95_latency"), F.col("projected_availability")
    return [
        F.lit("Candidate does not provide cost benefit."),
        F.concat(F.lit("Projected P95 latency = "), fixed(latency, 2), F.lit(" ms (Target violated)")),
        F.concat(F.lit("Projected availability = "), fixed(availability, 2), F.lit("% (Target violated)")),
        _over_limit("CPU", "peak_cpu", "max_cpu"),
        _over_limit("memory", "peak_mem", "max_mem"),
    ]


def _compact(items: list[Column]) -> Column:
    return F.array_compact(F.array(*items))


def blocking_codes(require_price: bool = False, require_complete: bool = False) -> Column:
    items = [F.when(fires, F.lit(code)) for code, fires in _gates()]
    if require_price:
        items.append(F.when(F.col("absolute_monthly_saving").isNull(), F.lit(NO_PRICE)))
    if require_complete:
        items.append(F.when(F.col("incomplete_rows") > 0, F.lit(INCOMPLETE)))
    return _compact(items)


def gate_decision(rows: Column, quality: Column, codes: Column) -> Column:
    """Label of a what-if row; ``rows`` null or 0 means there was nothing to simulate."""
    return (
        F.when(F.coalesce(rows, F.lit(0)) == 0, F.lit(S.INSUFFICIENT))
        .when(quality == "LOW", F.lit(S.INSUFFICIENT))
        .when(F.size(codes) > 0, F.lit(S.UNSAFE))
        .otherwise(F.lit(S.SAFE))
    )


def reason_codes(rows: Column, quality: Column, codes: Column) -> Column:
    return (
        F.when(F.coalesce(rows, F.lit(0)) == 0, F.array(F.lit(NO_TELEMETRY)))
        .when(quality == "LOW", F.array(F.lit(LOW_QUALITY)))
        .otherwise(codes)
    )


def reason_texts(decision: Column, rows: Column, require_price: bool = False, require_complete: bool = False) -> Column:
    items = [F.when(fires, text) for (_, fires), text in zip(_gates(), _gate_texts())]
    if require_price:
        items.append(
            F.when(F.col("absolute_monthly_saving").isNull(), F.lit("No price is known for one of the types."))
        )
    if require_complete:
        items.append(
            F.when(
                F.col("incomplete_rows") > 0,
                F.format_string("%d rows lack CPU or memory readings.", F.col("incomplete_rows")),
            )
        )
    return (
        F.when(F.coalesce(rows, F.lit(0)) == 0, F.array(F.lit("No telemetry available for simulation.")))
        .when(
            decision == S.INSUFFICIENT,
            F.array(F.lit("Data quality is too low to safely recommend rightsizing.")),
        )
        .when(
            decision == S.SAFE,
            F.array(F.lit("Cost decreases while SLO targets and resource limits remain satisfied.")),
        )
        .otherwise(_compact(items))
    )
