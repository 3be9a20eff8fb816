"""Scenario classes and the environment each scenario is shown on."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fleetfit.functions import labels
from fleetfit.operators.projection import ENV

# Scenario -> (needed class or any, needed current type).
SCENARIOS = {"normal": ("normal", "medium"), "peak": (None, "large"), "bursty": ("bursty", "medium")}


def classify(requests: DataFrame) -> DataFrame:
    """Sample standard deviation of the request volume per environment, and the class it gives."""
    spread = requests.groupBy(ENV).agg(F.stddev_samp("request_volume").alias("request_stddev"))
    return spread.withColumn("scenario_class", labels.scenario_class(F.col("request_stddev")))


def pick(environments: DataFrame, classes: DataFrame, order: str = "seq") -> DataFrame:
    """(scenario, environment): the first match in registry order, else the first environment.

    One aggregation with a map-side part; no environment list is sorted or collected.
    """
    rows = environments.select(ENV, "current_instance_type", order).join(
        classes.select(ENV, "scenario_class"), ENV, "left"
    )
    firsts = [F.min_by(ENV, order).alias("_first")]
    for name, (needed, instance) in SCENARIOS.items():
        match = F.col("current_instance_type") == instance
        if needed:
            match = match & (F.col("scenario_class") == needed)
        firsts.append(F.min_by(ENV, F.when(match, F.col(order))).alias(name))
    picked = rows.agg(*firsts)
    lines = F.array(
        *[
            F.struct(F.lit(n).alias("scenario"), F.coalesce(n, "_first").alias(ENV), F.col(n).isNotNull().alias("matched"))
            for n in SCENARIOS
        ]
    )
    return picked.select(F.explode(lines).alias("_line")).select("_line.*").where(F.col(ENV).isNotNull())


def experiment(picked: DataFrame, decided: DataFrame, measured: DataFrame) -> DataFrame:
    """The scenario report: decided what-if of each picked environment beside its baseline."""
    return picked.join(decided, ENV).join(
        measured.select(
            ENV, "mean_cpu", F.col("peak_cpu").alias("baseline_peak_cpu"), "peak_memory", "p95_latency", "measured_availability"
        ),
        ENV,
    )
