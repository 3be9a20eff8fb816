"""Pre-migration gate over a table of migration requests."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from fleetfit import schemas as S
from fleetfit import session
from fleetfit.catalog import InstanceCatalog
from fleetfit.operators.projection import BASE, ENV, Variant
from fleetfit.operators.quantiles import NO_LARGE_GROUPS, LargeGroups
from fleetfit.operators.whatif import (
    UNKNOWN_TEXT,
    UNKNOWN_TYPE,
    decide,
    fleet_moves,
    keep_all_moves,
    name_unknown_types,
    what_if,
)

if TYPE_CHECKING:
    from fleetfit.plans.fleet import Fleet

# Audit events of the gate.
STARTED = "PRECHECK_STARTED"
FAILED = "PRECHECK_FAILED"
BLOCKED = "MIGRATION_BLOCKED"
APPROVED = "MIGRATION_APPROVED"

REQUEST = [ENV, "expected_current", "candidate_instance_type"]
LEDGER = T.StructType(
    [
        T.StructField(ENV, T.StringType()),
        T.StructField("current_instance", T.StringType()),
        T.StructField("candidate_instance", T.StringType()),
        T.StructField("seq", T.IntegerType()),
        T.StructField("event", T.StringType()),
        T.StructField("reason", T.StringType()),
    ]
)


def precheck(
    requests: DataFrame,
    state: DataFrame,
    telemetry: DataFrame,
    pricing: DataFrame,
    catalog: InstanceCatalog,
    large: LargeGroups = NO_LARGE_GROUPS,
    variant: Variant = BASE[0],
) -> DataFrame:
    """Requests with their outcome: first failing check, or the safety decision.

    ``state`` holds the registered type per environment, and its status (RUNNING where there is no
    such column). Only requests that pass the state checks are simulated, under the targets and
    limits of ``variant``.
    """
    checked = state_checked(requests, state)
    eligible = (
        checked.where(F.col("state_check").isNull())
        .select(ENV, F.col("expected_current").alias("current_instance_type"), "candidate_instance_type")
        .distinct()
    )
    decided = decided_moves(eligible, telemetry, pricing, catalog, large, variant)
    return with_outcome(checked.join(decided, REQUEST, "left"))


def state_checked(requests: DataFrame, state: DataFrame) -> DataFrame:
    """Requests beside the registered type and status, with the state check that they fail or null."""
    status = F.col("status") if "status" in state.columns else F.lit("RUNNING")
    registered = state.select(
        ENV, F.col("current_instance_type").alias("actual_current"), status.alias("status"), F.lit(True).alias("_found")
    )
    checked = requests.join(registered, ENV, "left")
    check = (
        F.when(F.col("_found").isNull(), "NOT_FOUND")
        .when(F.col("status") != "RUNNING", "NOT_RUNNING")
        .when(F.col("actual_current") != F.col("expected_current"), "INSTANCE_MISMATCH")
    )
    return checked.withColumn("state_check", check).drop("_found")


def decided_moves(
    moves: DataFrame,
    telemetry: DataFrame,
    pricing: DataFrame,
    catalog: InstanceCatalog,
    large: LargeGroups = NO_LARGE_GROUPS,
    variant: Variant = BASE[0],
) -> DataFrame:
    """The safety decision of every move, keyed as a request is."""
    result = keep_all_moves(moves, what_if(telemetry, moves, pricing, catalog, variants=(variant,), large=large))
    return name_unknown_types(decide(result, texts=True), catalog).select(
        ENV,
        F.col("current_instance_type").alias("expected_current"),
        "candidate_instance_type",
        "row_count",
        "decision",
        "reason_codes",
        "reasons",
    )


def snapshot(fleet: Fleet, variant: Variant = BASE[0]) -> DataFrame:
    """Stored decisions of all moves of the fleet: from each environment's own type to every type of the catalog.

    One pass over the telemetry; questions about single moves then read this table, which has a row
    per environment and type, sorted by environment so that a few of them are found by its statistics.
    """
    moves = fleet_moves(fleet.environments, fleet.catalog, "any").select(ENV, "current_instance_type", "candidate_instance_type")
    decided = decided_moves(moves, fleet.passes, fleet.pricing, fleet.catalog, fleet.large, variant)
    return session.written(decided.repartitionByRange(ENV).sortWithinPartitions(ENV), "decisions")


def precheck_from(requests: DataFrame, state: DataFrame, decisions: DataFrame) -> DataFrame:
    """``precheck`` against a snapshot of decisions: no telemetry is read.

    The snapshot is cut to the requested moves first, so it is the requests that are broadcast if they
    are few. A move that it lacks is one to or from a type outside the catalog.
    """
    checked = state_checked(requests, state)
    wanted = checked.where(F.col("state_check").isNull()).select(*REQUEST).distinct()
    rows = checked.join(decisions.join(wanted, REQUEST), REQUEST, "left")
    named = F.col("expected_current").isNotNull() & F.col("candidate_instance_type").isNotNull()
    unknown = F.col("decision").isNull() & F.col("state_check").isNull() & named
    known = {
        "reason_codes": F.when(unknown, F.array(F.lit(UNKNOWN_TYPE))).otherwise(F.col("reason_codes")),
        "reasons": F.when(unknown, F.array(F.lit(UNKNOWN_TEXT))).otherwise(F.col("reasons")),
    }
    return with_outcome(rows.withColumns(known))


def with_outcome(rows: DataFrame) -> DataFrame:
    """Adds the event, whether the request is approved, and the message of the ledger."""
    decision = F.when(F.col("state_check").isNull(), F.coalesce("decision", F.lit(S.INSUFFICIENT)))
    reasons = F.coalesce("reasons", F.array(F.lit("No telemetry available for simulation.")))
    rows = rows.withColumn("decision", decision)
    event = (
        F.when(F.col("state_check").isNotNull(), FAILED)
        .when(F.col("decision") == S.SAFE, APPROVED)
        .otherwise(BLOCKED)
    )
    message = (
        F.when(F.col("state_check") == "NOT_FOUND", F.concat(F.lit("Environment "), F.col(ENV), F.lit(" not found.")))
        .when(
            F.col("state_check") == "NOT_RUNNING",
            F.concat(F.lit("Environment "), F.col(ENV), F.lit(" is in status "), F.col("status"), F.lit(", expected RUNNING.")),
        )
        .when(
            F.col("state_check") == "INSTANCE_MISMATCH",
            F.concat(
                F.lit("Current instance mismatch: expected "), F.col("expected_current"), F.lit(", got "), F.col("actual_current")
            ),
        )
        .when(F.col("decision") == S.SAFE, "Safety checks passed.")
        .otherwise(
            F.concat(
                F.lit("Safety decision blocked migration: "),
                F.col("decision"),
                F.lit(". Reasons: ['"),
                F.concat_ws("', '", reasons),
                F.lit("']"),
            )
        )
    )
    return rows.withColumns({"event": event, "approved": event == APPROVED, "message": message})


def audit_rows(prechecked: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The two ledger entries of each request, in order; ``keep`` names further columns of the request."""
    entry = F.array(
        F.struct(F.lit(STARTED).alias("event"), F.lit("").alias("reason")),
        F.struct(F.col("event"), F.col("message").alias("reason")),
    )
    return prechecked.select(
        ENV,
        F.col("expected_current").alias("current_instance"),
        F.col("candidate_instance_type").alias("candidate_instance"),
        *keep,
        F.posexplode(entry).alias("seq", "_entry"),
    ).select(ENV, "current_instance", "candidate_instance", *keep, "seq", "_entry.event", "_entry.reason")
