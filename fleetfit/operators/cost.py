"""Average prices and cost comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetfit import schemas as S
from fleetfit.catalog import InstanceCatalog

BROADCAST_TYPES = 10_000


def average_prices(pricing: DataFrame) -> DataFrame:
    """Mean hourly price per type over the whole price history."""
    return pricing.groupBy("instance_type").agg(F.avg("hourly_price").alias("hourly_avg"))


def compare(
    rows: DataFrame, pricing: DataFrame, catalog: InstanceCatalog, hours: Column | int = S.HOURS_PER_MONTH
) -> DataFrame:
    """Adds both hourly averages, both costs, the saving and its share to rows with a move.

    A type without prices leaves the costs null and the share 0. Prices are cut to the types of the
    catalog, so they are at most as many rows as the catalog has types; up to ``BROADCAST_TYPES``
    of them are broadcast (a shuffle by type would put a third of the fleet into one task).
    """
    listed = catalog.table(pricing.sparkSession).select("instance_type")
    prices = average_prices(pricing.join(listed, "instance_type", "left_semi"))
    if len(catalog.types) <= BROADCAST_TYPES:
        prices = F.broadcast(prices)
    hours = hours if isinstance(hours, Column) else F.lit(hours)
    priced = rows.join(
        prices.select(
            F.col("instance_type").alias("current_instance_type"), F.col("hourly_avg").alias("current_hourly_avg")
        ),
        "current_instance_type",
        "left",
    ).join(
        prices.select(
            F.col("instance_type").alias("candidate_instance_type"), F.col("hourly_avg").alias("candidate_hourly_avg")
        ),
        "candidate_instance_type",
        "left",
    )
    baseline = F.col("baseline_monthly_cost")
    saving = F.col("absolute_monthly_saving")
    return (
        priced.withColumn("baseline_monthly_cost", F.col("current_hourly_avg") * hours)
        .withColumn("simulated_monthly_cost", F.col("candidate_hourly_avg") * hours)
        .withColumn("absolute_monthly_saving", baseline - F.col("simulated_monthly_cost"))
        .withColumn("cost_reduction_pct", F.when(baseline > 0, saving / baseline * 100.0).otherwise(0.0))
    )
