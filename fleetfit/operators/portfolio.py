"""Fleet-wide roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fleetfit import schemas as S
from fleetfit.catalog import InstanceCatalog
from fleetfit.functions import labels
from fleetfit.operators.candidates import best_or_none
from fleetfit.operators.projection import BASE, ENV, Variant
from fleetfit.operators.quantiles import NO_LARGE_GROUPS, LargeGroups
from fleetfit.operators.ranking import position_in_table
from fleetfit.operators.whatif import decide, what_if


def detail(
    telemetry: DataFrame,
    environments: DataFrame,
    pricing: DataFrame,
    catalog: InstanceCatalog,
    large: LargeGroups = NO_LARGE_GROUPS,
    approx: bool = False,
    variant: Variant = BASE[0],
) -> DataFrame:
    """One row per registered environment: selected candidate, costs, decision, risk, reason.

    The what-if keeps environments without a cheaper type, so current costs and candidates come
    from the same pass over the telemetry.
    """
    result = what_if(
        telemetry, environments, pricing, catalog, "cheaper", (variant,), large=large, approx=approx, unmoved=True
    )
    best = best_or_none(decide(result), catalog).drop("variant_id")
    rows = environments.select(ENV, "current_instance_type").join(best, ENV, "left")
    selected = F.col("selected_candidate")
    chosen = selected.isNotNull()
    current = F.coalesce("current_monthly_cost", F.lit(0.0))
    decision = F.when(chosen, S.SAFE).otherwise(S.NO_OPTION)
    return rows.select(
        ENV,
        "current_instance_type",
        "selected_candidate",
        current.alias("current_monthly_cost"),
        F.when(chosen, F.col("simulated_monthly_cost")).otherwise(current).alias("candidate_cost"),
        F.when(chosen, F.col("absolute_monthly_saving")).otherwise(0.0).alias("potential_saving"),
        decision.alias("decision"),
        labels.portfolio_risk(F.col("peak_cpu"), selected).alias("risk"),
        F.when(chosen, "Safe").otherwise(S.NO_OPTION).alias("blocking_reason"),
        F.when(chosen, 0.0).otherwise(F.coalesce("best_unsafe_saving", F.lit(0.0))).alias("unsafe_saving"),
    )


def summary(details: DataFrame) -> DataFrame:
    safe = F.col("decision") == S.SAFE
    saving = F.col("potential_saving")
    totals = details.agg(
        F.count(F.lit(1)).alias("total_environments"),
        F.count_if(safe).alias("safe_environments"),
        F.count_if(~safe).alias("blocked_environments"),
        F.coalesce(F.sum("current_monthly_cost"), F.lit(0.0)).alias("current_monthly_cost"),
        F.coalesce(F.sum(F.when(safe, saving)), F.lit(0.0)).alias("potential_monthly_savings"),
        F.coalesce(F.sum(F.when(~safe, saving)), F.lit(0.0)).alias("blocked_potential_savings"),
    )
    return totals.withColumn("potential_annual_savings", F.col("potential_monthly_savings") * 12)


def blocked_savings(details: DataFrame) -> DataFrame:
    """Savings of blocked environments per current type.

    ``blocked_potential_savings`` is 0 by definition, as a blocked environment has no candidate;
    ``unsafe_savings`` is the best saving the gate refuses.
    """
    blocked = details.where(F.col("decision") != S.SAFE)
    return blocked.groupBy("current_instance_type").agg(
        F.count(F.lit(1)).alias("blocked_environments"),
        F.sum("potential_saving").alias("blocked_potential_savings"),
        F.sum("unsafe_saving").alias("unsafe_savings"),
    )


def step_down_rows(decided: DataFrame) -> DataFrame:
    """Decided one-step moves with outcome and risk."""
    return decided.select(
        ENV,
        "current_instance_type",
        "candidate_instance_type",
        "decision",
        F.when(F.col("decision") == S.SAFE, "SAFE").otherwise("BLOCKED").alias("outcome"),
        labels.migration_risk(
            F.col("peak_cpu"), F.col("latency_satisfied"), F.col("availability_satisfied")
        ).alias("risk"),
        F.coalesce("absolute_monthly_saving", F.lit(0.0)).alias("cost_saving"),
    )


def ranked(steps: DataFrame, environments: DataFrame, order: str = "seq") -> DataFrame:
    """Safe and blocked moves, each ranked by saving, ties in registry order."""
    rows = steps.join(environments.select(ENV, order), ENV)
    return position_in_table(rows, [F.col("cost_saving").desc(), F.col(order).asc()], "rank", restart="outcome")


def top_safe(steps: DataFrame, environments: DataFrame, n: int = 3, order: str = "seq") -> DataFrame:
    rows = steps.where("outcome = 'SAFE'").join(environments.select(ENV, order), ENV)
    return rows.orderBy(F.col("cost_saving").desc(), F.col(order).asc()).limit(n)


def metrics(steps: DataFrame, naive: DataFrame) -> DataFrame:
    """Evaluated, safe and blocked moves, and how many naive recommendations the gate stops."""
    rows = steps.join(naive.select(ENV, F.col("recommended").isNotNull().alias("_naive")), ENV, "left")
    blocked = F.col("outcome") == "BLOCKED"
    out = rows.agg(
        F.count(F.lit(1)).alias("evaluated"),
        F.count_if(~blocked).alias("safe"),
        F.count_if(blocked).alias("blocked"),
        F.count_if("_naive").alias("naive_recommended"),
        F.count_if(F.col("_naive") & blocked).alias("naive_blocked"),
    )
    return out.withColumn(
        "prevention_rate_pct",
        F.when(F.col("naive_recommended") > 0, F.col("naive_blocked") / F.col("naive_recommended") * 100.0).otherwise(100.0),
    )
