"""The central plan: one what-if result per (environment, current, candidate, variant)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetfit import schemas as S
from fleetfit.catalog import InstanceCatalog
from fleetfit.functions import decision as D
from fleetfit.operators import cost
from fleetfit.operators.projection import BASE, ENV, Variant, project_rows, with_variant_columns
from fleetfit.operators.quantiles import NO_LARGE_GROUPS, LargeGroups, grouped

MOVE = [ENV, "current_instance_type", "candidate_instance_type"]
RESULT_KEY = MOVE + ["variant_no"]


def evaluate_slo(projected: DataFrame, large: LargeGroups = NO_LARGE_GROUPS, approx: bool = False,
                 means: bool = False, completeness: bool = False) -> DataFrame:
    """P95 latency, availability, violation rate, peaks and row count of projected rows.

    Everything comes from a single aggregation, hence a single exchange.
    """
    aggregates = [
        F.count(F.lit(1)).alias("row_count"),
        F.avg("projected_availability").alias("projected_availability"),
        F.count_if(F.col("projected_availability") < F.col("availability_target")).alias("violations"),
        F.max("projected_cpu").alias("peak_cpu"),
        F.max("projected_memory").alias("peak_mem"),
    ]
    if means:
        aggregates += [
            F.avg("projected_cpu").alias("mean_projected_cpu"),
            F.avg("projected_memory").alias("mean_projected_memory"),
        ]
    if completeness:
        aggregates.append(F.count_if(F.col("pressure").isNull()).alias("incomplete_rows"))
    p95 = {"projected_p95_latency": ("projected_latency", 0.95)}
    out = grouped(projected, RESULT_KEY, p95, aggregates, large, approx)
    return out.withColumn("slo_violation_rate", F.col("violations") / F.col("row_count")).drop("violations")


def what_if(
    telemetry: DataFrame,
    moves: DataFrame,
    pricing: DataFrame,
    catalog: InstanceCatalog,
    policy: str = "any",
    variants: tuple[Variant, ...] = BASE,
    hours: Column | int | None = None,
    large: LargeGroups = NO_LARGE_GROUPS,
    approx: bool = False,
    means: bool = False,
    completeness: bool = False,
    unmoved: bool = False,
) -> DataFrame:
    """Projection, SLO evaluation, peaks and cost of every move of every environment.

    ``hours`` prices the move; by default the number of telemetry rows, as hourly readings.
    Environments without telemetry have no row. Telemetry that is already together by environment
    is expanded and aggregated without another exchange.
    """

    def evaluated(rows: DataFrame, groups: LargeGroups) -> DataFrame:
        projected = project_rows(rows, moves, catalog, policy, variants, groups, unmoved=unmoved)
        return evaluate_slo(projected, groups, approx, means, completeness)

    usual, big = large.apart(telemetry)
    if big is None:
        result = evaluated(usual, large)
    elif usual is None:
        result = evaluated(big, large)
    else:
        # Brought together before the expansion to moves and variants, not after it.
        result = evaluated(usual.repartition(ENV), NO_LARGE_GROUPS).unionByName(evaluated(big, large.inside()))
    result = with_variant_columns(result, variants)
    result = (
        result.withColumn("latency_satisfied", F.col("projected_p95_latency") <= F.col("latency_target"))
        .withColumn("availability_satisfied", F.col("projected_availability") >= F.col("availability_target"))
    )
    return cost.compare(result, pricing, catalog, F.col("row_count") if hours is None else hours)


def decide(
    result: DataFrame,
    quality: Column | None = None,
    require_price: bool = False,
    require_complete: bool = False,
    texts: bool = False,
) -> DataFrame:
    """Adds ``decision`` and ``reason_codes`` (and ``reasons`` on request) to what-if rows.

    Rows whose ``row_count`` is null or 0, and rows of LOW quality, are INSUFFICIENT DATA.
    """
    quality = F.lit("HIGH") if quality is None else quality
    rows = F.col("row_count")
    out = result.withColumn("_codes", D.blocking_codes(require_price, require_complete))
    out = out.withColumn("decision", D.gate_decision(rows, quality, F.col("_codes")))
    out = out.withColumn("reason_codes", D.reason_codes(rows, quality, F.col("_codes"))).drop("_codes")
    if texts:
        out = out.withColumn(
            "reasons", D.reason_texts(F.col("decision"), rows, require_price, require_complete)
        )
    return out


UNKNOWN_TYPE = "UNKNOWN_INSTANCE_TYPE"
UNKNOWN_TEXT = "Instance type is not in the catalog."


def keep_all_moves(moves: DataFrame, result: DataFrame) -> DataFrame:
    """What-if rows with an empty row for every move whose environment had no telemetry."""
    return moves.select(*MOVE).join(result, MOVE, "left")


def name_unknown_types(decided: DataFrame, catalog: InstanceCatalog) -> DataFrame:
    """Decided rows where a move from or to a type outside the catalog says so instead of missing telemetry."""
    types = catalog.table(decided.sparkSession).select("instance_type")
    out = decided
    for column, flag in (("current_instance_type", "_from"), ("candidate_instance_type", "_to")):
        out = out.join(types.select(F.col("instance_type").alias(column), F.lit(True).alias(flag)), column, "left")
    unknown = F.col("_from").isNull() | F.col("_to").isNull()
    changed = {"reason_codes": F.when(unknown, F.array(F.lit(UNKNOWN_TYPE))).otherwise(F.col("reason_codes"))}
    if "reasons" in decided.columns:
        changed["reasons"] = F.when(unknown, F.array(F.lit(UNKNOWN_TEXT))).otherwise(F.col("reasons"))
    return out.withColumns(changed).select(*decided.columns)


def fleet_moves(environments: DataFrame, catalog: InstanceCatalog, policy: str) -> DataFrame:
    """The moves of a policy for every registered environment of a known type."""
    return environments.join(catalog.moves(environments.sparkSession, policy), "current_instance_type")


def naive_step_down(telemetry: DataFrame, environments: DataFrame, catalog: InstanceCatalog) -> DataFrame:
    """The rule without a safety gate: mean CPU below the limit means one step down."""
    spark = telemetry.sparkSession
    averages = telemetry.groupBy(ENV).agg(F.avg("cpu_utilization_pct").alias("mean_cpu"))
    steps = catalog.moves(spark, "step_down").select(
        "current_instance_type", F.col("candidate_instance_type").alias("_step")
    )
    return (
        environments.select(ENV, "current_instance_type")
        .join(averages, ENV, "left")
        .join(steps, "current_instance_type", "left")
        # No telemetry: the null mean does not compare, so nothing is recommended.
        .withColumn("recommended", F.when(F.col("mean_cpu") < S.NAIVE_CPU_LIMIT, F.col("_step")))
        .withColumn("mean_cpu", F.coalesce("mean_cpu", F.lit(0.0)))
        .drop("_step")
    )
