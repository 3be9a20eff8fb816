"""Trade-offs, explanations, stakeholder views and series for display."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from fleetfit import schemas as S
from fleetfit.functions import labels
from fleetfit.operators.projection import ENV
from fleetfit.operators.quantiles import NO_LARGE_GROUPS, LargeGroups, grouped
from fleetfit.operators.whatif import MOVE

# Texts of the views and explanations.
VIEW_LABEL = "SIMULATED STAKEHOLDER VALIDATION"
EVIDENCE = "All simulated metrics are within strict safety bounds."
PASSED_CHECKS = ["CPU < 90%", "Memory < 90%", "Latency SLO Met", "Availability SLO Met"]
FIVE_NUMBERS = {"low": 0.0, "q1": 0.25, "middle": 0.5, "q3": 0.75, "high": 1.0}


def tradeoff(result: DataFrame) -> DataFrame:
    """Candidate minus current, for what-if rows that hold each environment's move to itself.

    The current side is picked up by a window over an environment's few moves.
    """
    own = F.col("current_instance_type") == F.col("candidate_instance_type")
    moves = W.partitionBy(ENV, "current_instance_type", "variant_no")

    def current(name: str):
        return F.max(F.when(own, F.col(name))).over(moves)

    return (
        result.withColumns(
            {
                "cost_delta": F.col("simulated_monthly_cost") - current("baseline_monthly_cost"),
                "cpu_delta": F.col("peak_cpu") - current("peak_cpu"),
                "memory_delta": F.col("peak_mem") - current("peak_mem"),
                "latency_delta": F.col("projected_p95_latency") - current("projected_p95_latency"),
                "availability_delta": F.col("projected_availability") - current("projected_availability"),
                "resource_headroom": 100.0 - F.greatest("peak_cpu", "peak_mem"),
            }
        )
        .where(~own)
        .select(
            *MOVE,
            "cost_delta",
            "cpu_delta",
            "memory_delta",
            "latency_delta",
            "availability_delta",
            "resource_headroom",
        )
    )


def explain(decided: DataFrame) -> DataFrame:
    """Structured explanation per decided move, as a JSON document."""
    c = F.col
    safe = F.to_json(
        F.struct(
            F.lit("SAFE").alias("decision"),
            c("current_instance_type").alias("current_instance"),
            c("candidate_instance_type").alias("candidate"),
            c("absolute_monthly_saving").alias("cost_reduction"),
            c("peak_cpu").alias("cpu_projection"),
            c("peak_mem").alias("memory_projection"),
            c("projected_p95_latency").alias("latency_projection"),
            c("projected_availability").alias("availability_projection"),
            F.lit(EVIDENCE).alias("evidence"),
            F.array(*[F.lit(x) for x in PASSED_CHECKS]).alias("passed_checks"),
        )
    )
    blocked = F.to_json(
        F.struct(
            F.lit("BLOCKED").alias("decision"),
            c("candidate_instance_type").alias("candidate"),
            c("reasons").alias("exact_reason"),
            c("peak_cpu").alias("projected_cpu"),
            c("peak_mem").alias("projected_memory"),
            c("projected_p95_latency").alias("projected_latency"),
            c("projected_availability").alias("projected_availability"),
        ),
        {"ignoreNullFields": "false"},
    )
    return decided.select(
        *MOVE,
        F.when(c("decision") == S.SAFE, "SAFE").otherwise("BLOCKED").alias("verdict"),
        F.when(c("decision") == S.SAFE, safe).otherwise(blocked).alias("explanation"),
    )


def infrastructure_view(decided: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """Resource usage and safety per move; health from post-migration verdicts where there are any."""
    rows = decided
    if verdicts is None:
        health = F.when(F.col("decision") == S.SAFE, "HEALTHY").otherwise("N/A")
    else:
        rows = rows.join(verdicts.select(ENV, "verdict"), ENV, "left")
        health = F.coalesce("verdict", F.lit("N/A"))
    return rows.select(
        ENV,
        F.lit("INFRASTRUCTURE ENGINEER").alias("view"),
        F.col("peak_cpu").alias("resource_usage"),
        F.col("decision").alias("safety"),
        health.alias("health"),
        F.lit(VIEW_LABEL).alias("label"),
    )


def finops_view(summary: DataFrame) -> DataFrame:
    return summary.select(
        F.lit("FINOPS / COST MANAGER").alias("view"),
        F.col("current_monthly_cost").alias("cost"),
        F.col("potential_monthly_savings").alias("potential_savings"),
        F.concat(F.col("safe_environments").cast("string"), F.lit(" Safe")).alias("portfolio_health"),
        F.lit(VIEW_LABEL).alias("label"),
    )


def owner_view(decided: DataFrame) -> DataFrame:
    return decided.select(
        ENV,
        F.lit("SERVICE OWNER").alias("view"),
        F.col("projected_p95_latency").alias("latency"),
        F.col("projected_availability").alias("availability"),
        labels.operational_risk(F.col("decision")).alias("operational_risk"),
        F.lit(VIEW_LABEL).alias("label"),
    )


def baseline_delta(result: DataFrame, measured: DataFrame) -> DataFrame:
    """Projected minus measured P95 latency and availability."""
    return result.join(measured.select(ENV, "p95_latency", "measured_availability"), ENV).select(
        *MOVE,
        (F.col("projected_p95_latency") - F.col("p95_latency")).alias("latency_delta"),
        (F.col("projected_availability") - F.col("measured_availability")).alias("availability_delta"),
    )


def five_numbers(projected: DataFrame, large: LargeGroups = NO_LARGE_GROUPS) -> DataFrame:
    """Minimum, quartiles and maximum of measured and projected CPU per move, one row per series."""
    wanted = {
        f"{series}_{name}": (column, p)
        for series, column in (("Baseline", "cpu_utilization_pct"), ("Projected", "projected_cpu"))
        for name, p in FIVE_NUMBERS.items()
    }
    boxes = grouped(projected, MOVE, wanted, [], large)
    series = F.array(
        *[
            F.struct(
                F.lit(f"{name} CPU").alias("series"),
                *[F.col(f"{name}_{number}").alias(number) for number in FIVE_NUMBERS],
            )
            for name in ("Baseline", "Projected")
        ]
    )
    return boxes.select(*MOVE, F.explode(series).alias("_box")).select(*MOVE, "_box.*")


def trend(telemetry: DataFrame, environment_id: str) -> DataFrame:
    """CPU and request volume of one environment in time order."""
    rows = telemetry.where(F.col(ENV) == environment_id)
    return rows.select("timestamp", ENV, "cpu_utilization_pct", "request_volume").orderBy("timestamp")
