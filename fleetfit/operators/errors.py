"""The error catalog and the failures it explains."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetfit.operators.projection import ENV
from fleetfit.session import local_rows

UNKNOWN_REASON = "Unknown error occurred."
MANUAL = "Manual intervention required."
REINGEST = "Check telemetry pipeline and re-ingest data."
ABORT = "Abort rightsizing. Monitor current instance."

# Error code, reason, recovery action.
ERRORS = [
    ("MISSING_TELEMETRY", "Telemetry data is missing.", REINGEST),
    ("INVALID_TELEMETRY", "Telemetry data is invalid or corrupt.", REINGEST),
    ("DUPLICATE_TELEMETRY", "Telemetry data contains duplicate timestamps.", REINGEST),
    ("UNKNOWN_ENVIRONMENT", "Environment ID not found in registry.", MANUAL),
    ("NEGATIVE_REQUEST_VOLUME", "Request volume contains negative values.", REINGEST),
    ("NEGATIVE_LATENCY", "Latency contains negative values.", REINGEST),
    ("CPU_SATURATION", "CPU utilization exceeds 100%.", ABORT),
    ("MEMORY_SATURATION", "Memory utilization exceeds 100%.", ABORT),
    ("LATENCY_SLO_FAILURE", "Latency exceeds SLO target.", ABORT),
    ("AVAILABILITY_SLO_FAILURE", "Availability falls below SLO target.", ABORT),
    ("INSUFFICIENT_TELEMETRY", "Not enough telemetry data points (e.g., < 24h).", REINGEST),
    ("NO_COST_BENEFIT", "Candidate instance does not provide cost savings.", ABORT),
    ("SAME_CANDIDATE", "Candidate instance is identical to current instance.", ABORT),
    ("NO_SAFE_CANDIDATE", "No candidate passed safety evaluation.", ABORT),
    ("MIGRATION_FAILURE", "Infrastructure migration execution failed.", "Retry migration or abort."),
    ("POST_MIGRATION_HEALTH_FAILURE", "Post-migration checkpoints deemed unhealthy.", "Trigger automatic rollback."),
    (
        "ROLLBACK_FAILURE",
        "Failed to restore original infrastructure state.",
        "CRITICAL: Escalate to SRE. Manual rollback required.",
    ),
    ("INVALID_AGENT_STATE", "Agent reached an unknown or invalid state.", MANUAL),
]

CODE_OF_RULE = {
    "duplicate": "DUPLICATE_TELEMETRY",
    "missing": "MISSING_TELEMETRY",
    "cpu": "INVALID_TELEMETRY",
    "memory": "INVALID_TELEMETRY",
    "requests": "NEGATIVE_REQUEST_VOLUME",
    "latency": "NEGATIVE_LATENCY",
    "availability": "INVALID_TELEMETRY",
    "unknown_environment": "UNKNOWN_ENVIRONMENT",
}


def error_table(spark: SparkSession) -> DataFrame:
    """The catalog as a table of 18 rows, small enough to broadcast in any session."""
    columns = {"error_code": pa.string(), "reason": pa.string(), "recovery_action": pa.string()}
    return F.broadcast(local_rows(spark, ERRORS, columns))


def explained(failures: DataFrame) -> DataFrame:
    """Adds reason and recovery action to rows with an ``error_code``, known or not."""
    return (
        failures.join(error_table(failures.sparkSession), "error_code", "left")
        .withColumn("reason", F.coalesce("reason", F.lit(UNKNOWN_REASON)))
        .withColumn("recovery_action", F.coalesce("recovery_action", F.lit(MANUAL)))
        .withColumn("status", F.lit("FAILED"))
    )


def telemetry_failures(tagged: DataFrame) -> DataFrame:
    """(environment, code, occurrences) of removed telemetry, from the tagged rows of validation."""
    codes = F.create_map(*[F.lit(x) for pair in CODE_OF_RULE.items() for x in pair])
    hits = F.array(
        F.struct(F.lit(CODE_OF_RULE["duplicate"]).alias("error_code"), (F.col("copies") - 1).alias("n")),
        F.struct(
            codes[F.col("failed_rule")].alias("error_code"),
            F.when(F.col("failed_rule").isNotNull(), 1).otherwise(0).cast("long").alias("n"),
        ),
    )
    rows = tagged.select(ENV, F.explode(hits).alias("_hit")).where("_hit.n > 0")
    return rows.groupBy(ENV, F.col("_hit.error_code").alias("error_code")).agg(F.sum("_hit.n").alias("occurrences"))


def decision_failures(decided: DataFrame) -> DataFrame:
    rows = decided.select(ENV, F.explode("reason_codes").alias("error_code"))
    return rows.groupBy(ENV, "error_code").agg(F.count(F.lit(1)).alias("occurrences"))


def error_events(tagged: DataFrame, decided: DataFrame) -> DataFrame:
    """Validation and decision failures per environment with reason and recovery action."""
    failures = (
        telemetry_failures(tagged)
        .withColumn("origin", F.lit("telemetry"))
        .unionByName(decision_failures(decided).withColumn("origin", F.lit("decision")))
    )
    return explained(failures)
