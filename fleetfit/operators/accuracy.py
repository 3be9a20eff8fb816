"""Prediction accuracy against observed readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fleetfit.functions import labels
from fleetfit.operators.projection import ENV
from fleetfit.operators.whatif import MOVE

# Metric name -> (predicted column, observed column).
COMPARED = {
    "CPU": ("peak_cpu", "cpu"),
    "Memory": ("peak_mem", "memory"),
    "P95 Latency": ("projected_p95_latency", "latency"),
    "Availability": ("projected_availability", "availability"),
}


def with_errors(rows: DataFrame, predicted: str = "predicted", observed: str = "observed") -> DataFrame:
    p, o = F.col(predicted), F.col(observed)
    return rows.withColumn("absolute_error", labels.absolute_error(p, o)).withColumn(
        "percentage_error", labels.percentage_error(p, o)
    )


def compare(predictions: DataFrame, observations: DataFrame) -> DataFrame:
    """One row per migrated environment and metric; a missing value counts as 0.

    An observation meets the prediction of the very move that was made: environment, type before
    and type after.
    """
    pairs = F.array(
        *[
            F.struct(
                F.lit(name).alias("metric"),
                F.coalesce(F.col(predicted), F.lit(0.0)).alias("predicted"),
                F.coalesce(F.col(observed), F.lit(0.0)).alias("observed"),
            )
            for name, (predicted, observed) in COMPARED.items()
        ]
    )
    joined = predictions.join(observations, MOVE)
    return with_errors(joined.select(ENV, F.explode(pairs).alias("_pair")).select(ENV, "_pair.*"))
