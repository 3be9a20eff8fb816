"""Post-migration monitoring over observed readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql import types as T

from fleetfit.functions import labels
from fleetfit.operators.projection import ENV
from fleetfit.operators.ranking import position_in_group
from fleetfit.session import written

CHECKPOINTS = 5
EXECUTED = "MIGRATION_EXECUTED"
READING = ["cpu", "memory", "latency", "availability"]
#: Rows of a window before they are numbered.
CANDIDATES = T.StructType(
    [
        T.StructField(ENV, T.StringType()),
        T.StructField("migration_seq", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        *[T.StructField(c, T.DoubleType()) for c in READING],
        T.StructField("reading_id", T.LongType()),
    ]
)


def classified(readings: DataFrame, **limits) -> DataFrame:
    """Readings with their health."""
    return readings.withColumn("health_status", labels.health(*[F.col(c) for c in READING], **limits))


def migrations(audit: DataFrame) -> DataFrame:
    """Executed migrations: (environment, migration_seq, migrated_at, current, candidate)."""
    return audit.where(F.col("event") == EXECUTED).select(
        ENV,
        F.col("seq").alias("migration_seq"),
        F.col("timestamp").alias("migrated_at"),
        "current_instance",
        "candidate_instance",
    )


def latest_migrations(audit: DataFrame) -> DataFrame:
    """The last executed migration of each environment."""
    done = migrations(audit)
    payload = F.struct("migration_seq", "migrated_at", "current_instance", "candidate_instance")
    return (
        done.groupBy(ENV)
        .agg(F.max_by(payload, F.struct("migrated_at", "migration_seq")).alias("_last"))
        .select(ENV, "_last.*")
    )


def window_after(
    executed: DataFrame, readings: DataFrame, checkpoints: int = CHECKPOINTS, keep: tuple[str, ...] = ()
) -> DataFrame:
    """The first readings at or after each migration, labelled T+0, T+1, ...

    An environment may have many migrations and very many readings, so the pairs are never built.
    Readings are numbered per environment; a migration sees how many readings precede it on the
    common time line and asks for the next numbers, which is an equality join.
    """
    order = F.date_trunc("minute", "ts")
    none = F.lit(None)
    line = readings.select(
        ENV, "ts", F.lit(1).alias("_kind"), none.cast("long").alias("migration_seq"), "reading_id", *READING
    ).unionByName(
        executed.select(ENV, F.col("migrated_at").alias("ts"), F.lit(0).alias("_kind"), "migration_seq"), allowMissingColumns=True
    )
    # At equal times the migration comes first, so a reading of that instant belongs to it. A reading's
    # own count is its number; both sides of the join below are read from the one numbered line.
    line = written(
        position_in_group(
            line, [ENV], order, ["ts", "_kind", "migration_seq", "reading_id"], "_seen", counted=F.col("_kind") == 1
        ),
        "time-line",
    )
    numbered = line.where("_kind = 1").select(ENV, "ts", F.col("_seen").alias("_nth"), *READING, *keep)
    wanted = line.where("_kind = 0").select(
        ENV, "migration_seq", F.posexplode(F.sequence(F.col("_seen") + 1, F.col("_seen") + checkpoints)).alias("_t", "_nth")
    )
    return (
        wanted.join(numbered, [ENV, "_nth"])
        .withColumn("checkpoint", F.concat(F.lit("T+"), F.col("_t").cast("string")))
        .withColumn("health_status", labels.health(*[F.col(c) for c in READING]))
        .select(ENV, "migration_seq", F.col("_t").alias("checkpoint_no"), "checkpoint", "ts", *READING, "health_status", *keep)
    )


def window_after_last(last: DataFrame, readings: DataFrame, checkpoints: int = CHECKPOINTS) -> DataFrame:
    """``window_after`` for one migration per environment, such as the last one.

    With one migration each, joining does not multiply readings, and the row-number filter leaves a
    few rows per environment and map task before anything is shuffled for it.
    """
    after = readings.join(last.select(ENV, "migration_seq", "migrated_at"), ENV).where(F.col("ts") >= F.col("migrated_at"))
    first = W.partitionBy(ENV).orderBy("ts", "reading_id")
    after = after.withColumn("_nth", F.row_number().over(first)).where(F.col("_nth") <= checkpoints)
    number = (F.col("_nth") - 1).cast("int")
    return (
        after.withColumn("checkpoint_no", number)
        .withColumn("checkpoint", F.concat(F.lit("T+"), number.cast("string")))
        .withColumn("health_status", labels.health(*[F.col(c) for c in READING]))
        .select(ENV, "migration_seq", "checkpoint_no", "checkpoint", "ts", *READING, "health_status")
    )


def finalised(checkpoints: DataFrame) -> DataFrame:
    """The checkpoints of migrations that are kept: those whose window does not ask for a rollback."""
    kept = verdicts(checkpoints, [ENV, "migration_seq"]).where(F.col("verdict") != labels.ROLLBACK)
    return checkpoints.join(kept.select(ENV, "migration_seq"), [ENV, "migration_seq"], "left_semi")


def first_readings(readings: DataFrame, checkpoints: int = CHECKPOINTS) -> DataFrame:
    """The first readings of each environment with their health.

    The row-number filter lets each map task drop all but its first few rows before the shuffle.
    """
    first = W.partitionBy(ENV).orderBy("ts", "reading_id")
    rows = readings.withColumn("_nth", F.row_number().over(first)).where(F.col("_nth") <= checkpoints)
    return classified(rows).withColumn("checkpoint_no", F.col("_nth") - 1).drop("_nth")


def verdicts(checkpoints: DataFrame, keys: list[str]) -> DataFrame:
    """ROLLBACK_REQUIRED if any checkpoint is, or if too many are degraded."""
    counted = checkpoints.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("checkpoints"),
        F.count_if(F.col("health_status") == labels.ROLLBACK).alias("rollback_checkpoints"),
        F.count_if(F.col("health_status") == labels.DEGRADED).alias("degraded_checkpoints"),
    )
    return counted.withColumn(
        "verdict", labels.health_verdict(F.col("rollback_checkpoints") > 0, F.col("degraded_checkpoints"))
    )


def rollback_list(audit: DataFrame, readings: DataFrame) -> DataFrame:
    """Environments to restore, with the type to restore, judged on their last migration."""
    last = latest_migrations(audit)
    judged = verdicts(window_after_last(last, readings), [ENV, "migration_seq"])
    return last.join(judged.where(F.col("verdict") == labels.ROLLBACK), [ENV, "migration_seq"]).select(
        ENV,
        "migration_seq",
        F.col("current_instance").alias("restore_instance"),
        F.col("candidate_instance").alias("migrated_instance"),
        "rollback_checkpoints",
        "degraded_checkpoints",
    )


def last_checkpoint(checkpoints: DataFrame) -> DataFrame:
    """The last checkpoint of each environment's window."""
    return (
        checkpoints.groupBy(ENV)
        .agg(F.max_by(F.struct(*READING), F.col("checkpoint_no")).alias("_last"))
        .select(ENV, "_last.*")
    )


def observed_moves(last: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """The last checkpoint of each migration that is kept, with the move that was made."""
    types = {"current_instance": "current_instance_type", "candidate_instance": "candidate_instance_type"}
    moves = last.select(ENV, *types).withColumnsRenamed(types)
    return last_checkpoint(finalised(checkpoints)).join(moves, ENV)
