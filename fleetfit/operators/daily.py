"""Baselines from daily counts of values, which new and late days update without a rescan of the telemetry.

The table holds, per environment, day, metric and value, how many readings have it. Counts add up, so a day that comes in
anew is written as the difference to what the table has of it; the exact percentiles, means and peaks of any span of days
come from the sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from fleetfit import schemas as S
from fleetfit.operators.baseline import AVAILABILITY, CPU, KEY, LATENCY, MEMORY, REQUESTS
from fleetfit.sources.commits import CommitTable

COUNTED = ["environment_id", "day", "metric", "value"]
COUNTS = T.StructType(
    [
        T.StructField("environment_id", T.StringType()),
        T.StructField("day", T.DateType()),
        T.StructField("metric", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("n", T.LongType()),
    ]
)


def counts_of(telemetry: DataFrame) -> DataFrame:
    """Daily counts of the values of clean telemetry, added up in the map tasks first; missing values do not count."""
    long = telemetry.select("environment_id", F.to_date("timestamp").alias("day"), *S.METRICS).unpivot(
        ["environment_id", "day"], S.METRICS, "metric", "value"
    )
    # Zeros of both signs are one value.
    long = long.where("value IS NOT NULL").withColumn("value", F.col("value") + F.lit(0.0))
    return long.groupBy(*COUNTED).agg(F.count(F.lit(1)).alias("n"))


def _added(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*COUNTED).agg(F.sum("n").alias("n")).where("n <> 0").sortWithinPartitions("day")


class DailyCounts:
    """The counts as a table of committed differences in folder ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.table = CommitTable(spark, path)

    def update(self, telemetry: DataFrame, batch: object, days: DataFrame | None = None, writer: str = "daily") -> bool:
        """Set the counts of days to those of ``telemetry``, which has all their clean readings.

        ``days`` (a column ``day``) names them; by default they are the days of the readings, so a day that has lost
        all its readings has to be named. False where this batch is known already. Of the table only those days are read.
        """
        if days is None:
            days = telemetry.select(F.to_date("timestamp").alias("day"))
        days = days.where("day IS NOT NULL").distinct()
        old = self.table.read(COUNTS).join(days, "day", "left_semi").select(*COUNTED, (-F.col("n")).alias("n"))
        new = counts_of(telemetry).where("day IS NOT NULL")
        done = self.table.append(_added(new.unionByName(old)), writer, batch)
        self.table.merge(_added, schema=COUNTS)
        return done

    def counts(self, first: object = None, last: object = None) -> DataFrame:
        """Counts per environment, metric and value of the days from ``first`` to ``last``."""
        rows = self.table.read(COUNTS)
        if first is not None:
            rows = rows.where(F.col("day") >= F.lit(first))
        if last is not None:
            rows = rows.where(F.col("day") <= F.lit(last))
        return rows.groupBy("environment_id", "metric", "value").agg(F.sum("n").alias("n")).where("n > 0")

    def baseline(self, first: object = None, last: object = None) -> DataFrame:
        """The 15 metrics of ``baseline.baseline`` from the counts alone."""

        def of(metric: str, column: str) -> Column:
            return F.when(F.col("metric") == metric, F.col(column))

        def mean(metric: str) -> Column:
            return F.sum(of(metric, "value") * F.col("n")) / F.sum(of(metric, "n"))

        def at(metric: str, p: float) -> Column:
            return F.percentile(of(metric, "value"), F.lit(p), F.col("n"))

        low = F.col("value") < S.AVAILABILITY_SLO
        return self.counts(first, last).groupBy(*KEY).agg(
            mean(CPU).alias("mean_cpu"),
            F.max(of(CPU, "value")).alias("peak_cpu"),
            at(CPU, 0.5).alias("median_cpu"),
            at(CPU, 0.95).alias("p95_cpu"),
            mean(MEMORY).alias("mean_memory"),
            F.max(of(MEMORY, "value")).alias("peak_memory"),
            at(MEMORY, 0.95).alias("p95_memory"),
            mean(REQUESTS).alias("mean_request_volume"),
            F.max(of(REQUESTS, "value")).alias("peak_request_volume"),
            at(REQUESTS, 0.95).alias("p95_request_volume"),
            mean(LATENCY).alias("mean_latency"),
            at(LATENCY, 0.95).alias("p95_latency"),
            at(LATENCY, 0.99).alias("p99_latency"),
            mean(AVAILABILITY).alias("measured_availability"),
            F.coalesce(F.sum(F.when(low, of(AVAILABILITY, "n"))), F.lit(0)).alias("slo_violations"),
        )
