"""Candidate search, ranking and one-step moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetfit import schemas as S
from fleetfit.catalog import InstanceCatalog
from fleetfit.operators.projection import ENV

# A candidate is only picked above this headroom (fixed value).
LEAST_HEADROOM = -1.0


def with_headroom(decided: DataFrame) -> DataFrame:
    spare = F.least(100.0 - F.col("peak_cpu"), 100.0 - F.col("peak_mem"))
    # Unknown CPU leaves the headroom unknown; with unknown memory the CPU side alone counts.
    return decided.withColumn("headroom", F.when(F.col("peak_cpu").isNotNull(), spare))


def keys_of(decided: DataFrame) -> list[str]:
    """A choice is made per environment and, where there are several, per set of assumptions."""
    return [c for c in (ENV, "variant_id") if c in decided.columns]


def _pick(decided: DataFrame, catalog: InstanceCatalog) -> tuple[DataFrame, Column, Column]:
    """Decided rows with headroom and ordinal, the chosen row and its order (null if not eligible)."""
    order = catalog.table(decided.sparkSession).select(
        F.col("instance_type").alias("candidate_instance_type"), F.col("ordinal").alias("candidate_ordinal")
    )
    rows = with_headroom(decided).join(order, "candidate_instance_type", "left")
    eligible = (F.col("decision") == S.SAFE) & (F.col("headroom") > LEAST_HEADROOM) & F.col("candidate_ordinal").isNotNull()
    chosen = F.struct(*[F.col(c) for c in rows.columns if c not in keys_of(decided)])
    return rows, chosen, F.when(eligible, F.struct(-F.col("headroom"), F.col("candidate_ordinal")))


def best_candidate(decided: DataFrame, catalog: InstanceCatalog) -> DataFrame:
    """The safe candidate of most headroom per environment and variant, ties by catalog order."""
    rows, chosen, order = _pick(decided, catalog)
    keys = keys_of(decided)
    return rows.where(order.isNotNull()).groupBy(*keys).agg(F.min_by(chosen, order).alias("_best")).select(*keys, "_best.*")


def best_or_none(decided: DataFrame, catalog: InstanceCatalog) -> DataFrame:
    """Per environment with telemetry (and variant): the best candidate (or nulls), its cost today and
    the best saving among the moves the gate blocks, in one aggregation.

    Expects what-if rows of the ``cheaper`` policy with ``unmoved`` environments kept.
    """
    rows, chosen, order = _pick(decided, catalog)
    blocked = F.col("candidate_instance_type").isNotNull() & (F.col("decision") != S.SAFE)
    keys = keys_of(decided)
    return (
        rows.groupBy(*keys)
        .agg(
            F.min_by(chosen, order).alias("_best"),
            F.max("baseline_monthly_cost").alias("current_monthly_cost"),
            F.max(F.when(blocked, F.col("absolute_monthly_saving"))).alias("best_unsafe_saving"),
            F.max("row_count").alias("readings"),
        )
        .select(
            *keys,
            "current_monthly_cost",
            "best_unsafe_saving",
            "readings",
            F.col("_best.candidate_instance_type").alias("selected_candidate"),
            *[F.col(f"_best.{c}").alias(c) for c in ("simulated_monthly_cost", "absolute_monthly_saving", "peak_cpu")],
        )
    )


def selection(environments: DataFrame, best: DataFrame) -> DataFrame:
    """Every registered environment with its best candidate, or NO SAFE RIGHTSIZING OPTION."""
    return (
        environments.select(ENV, "current_instance_type")
        .join(best.drop("current_instance_type"), ENV, "left")
        .withColumn("decision", F.coalesce("decision", F.lit(S.NO_OPTION)))
        .withColumnRenamed("candidate_instance_type", "selected_candidate")
    )


def prevented_by_gate(naive: DataFrame, decided_step_down: DataFrame) -> DataFrame:
    """Environments the naive rule would shrink although the gate blocks the same move."""
    blocked = decided_step_down.where(F.col("decision") != S.SAFE).select(
        *keys_of(decided_step_down), F.col("candidate_instance_type").alias("recommended"), "decision", "reason_codes"
    )
    return naive.where(F.col("recommended").isNotNull()).join(blocked, [ENV, "recommended"])
