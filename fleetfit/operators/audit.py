"""Questions to the append-only audit ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetfit.operators.projection import ENV

# Event -> lifecycle status it puts an environment into.
STATUS_OF = {
    "MIGRATION_STARTED": "MIGRATING",
    "MIGRATION_EXECUTED": "MIGRATED",
    "POSTCHECK_PASSED": "COMPLETED",
    "MIGRATION_FAILED": "FAILED",
    "ROLLBACK_STARTED": "ROLLING_BACK",
    "ORIGINAL_CONFIGURATION_RESTORED": "ROLLED_BACK",
    "ROLLBACK_FAILED": "FAILED",
}
# The event vocabulary.
EVENTS = [
    "PRECHECK_STARTED",
    "PRECHECK_FAILED",
    "MIGRATION_BLOCKED",
    "MIGRATION_APPROVED",
    "MIGRATION_STARTED",
    "MIGRATION_EXECUTED",
    "MIGRATION_FAILED",
    "MIGRATION_STOPPED",
    "MONITORING_STARTED",
    "FAILURE_DETECTED",
    "POSTCHECK_PASSED",
    "PREDICTION_ACCURACY",
    "ROLLBACK_STARTED",
    "ROLLBACK_FAILED",
    "ORIGINAL_CONFIGURATION_RESTORED",
    "RESTORATION_VERIFIED",
]
# Events of an unattended run, kept in the same ledger.
AGENT_EVENTS = [
    "AGENT_VALIDATING",
    "AGENT_BLOCKED",
    "AGENT_APPROVED",
    "AGENT_EXECUTED",
    "AGENT_VERIFYING",
    "AGENT_ROLLED_BACK",
    "AGENT_COMPLETED",
]
WHEN = ("timestamp", "seq")


def _when() -> Column:
    return F.struct(*WHEN)


def events_of(audit: DataFrame, environment_id: str) -> DataFrame:
    """Events of one environment in write order."""
    return audit.where(F.col(ENV) == environment_id).orderBy(*WHEN)


def latest(audit: DataFrame) -> DataFrame:
    """The last event of each environment."""
    row = F.struct("timestamp", "seq", "event", "reason")
    return audit.groupBy(ENV).agg(F.max_by(row, _when()).alias("_last")).select(ENV, "_last.*")


def state(audit: DataFrame, environments: DataFrame | None = None) -> DataFrame:
    """Lifecycle status and instance type each environment is left in by its events.

    With the registry, environments without such events keep their registered type.
    """
    status = F.create_map(*[F.lit(x) for pair in STATUS_OF.items() for x in pair])[F.col("event")]
    instance = F.when(F.col("event") == "MIGRATION_EXECUTED", F.col("candidate_instance")).when(
        F.col("event") == "ORIGINAL_CONFIGURATION_RESTORED", F.col("current_instance")
    )
    left = (
        audit.withColumn("_status", status)
        .withColumn("_instance", instance)
        .groupBy(ENV)
        .agg(
            F.max_by("_status", F.when(F.col("_status").isNotNull(), _when())).alias("lifecycle_status"),
            F.max_by("_instance", F.when(F.col("_instance").isNotNull(), _when())).alias("instance_type"),
        )
    )
    if environments is None:
        return left
    registered = environments.select(ENV, F.col("current_instance_type").alias("_registered"))
    return (
        registered.join(left, ENV, "left")
        .withColumn("instance_type", F.coalesce("instance_type", "_registered"))
        .drop("_registered")
    )


def funnel(audit: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Event counts in one row, with approval, block and rollback rates."""
    counted = audit.agg(*[F.count_if(F.col("event") == e).alias(e.lower()) for e in EVENTS + (extra or [])])

    def rate(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole) * 100.0)

    return counted.withColumns(
        {
            "approval_rate_pct": rate("migration_approved", "precheck_started"),
            "block_rate_pct": rate("migration_blocked", "precheck_started"),
            "rollback_rate_pct": rate("original_configuration_restored", "migration_executed"),
        }
    )


def event_counts(audit: DataFrame) -> DataFrame:
    return audit.groupBy("event").agg(F.count(F.lit(1)).alias("events"))
