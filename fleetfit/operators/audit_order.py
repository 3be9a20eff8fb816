"""Whether the ledger's events come in an order that the lifecycle allows.

An event takes an environment from one stage to the next; one that its stage does not allow is flagged and changes nothing.
So what an event means depends on all events before it, but a run of events is a function of the stage it begins in, and such
functions are put together in any grouping: events are folded in segments of bounded size, segments in groups of segments,
and the stage at the beginning of each is handed down the same way. No task holds the events of a large environment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetfit.operators.projection import ENV
from fleetfit.operators.ranking import position_in_group
from fleetfit.session import written

# The stages, the first one at the beginning, and the events that each allows with the stage they lead to.
LIFECYCLE = {
    "IDLE": {"PRECHECK_STARTED": "CHECKING"},
    "CHECKING": {"PRECHECK_FAILED": "IDLE", "MIGRATION_BLOCKED": "IDLE", "MIGRATION_APPROVED": "APPROVED"},
    "APPROVED": {"PRECHECK_STARTED": "CHECKING", "MIGRATION_STARTED": "MIGRATING"},
    "MIGRATING": {"MIGRATION_EXECUTED": "MIGRATED", "MIGRATION_FAILED": "IDLE"},
    "MIGRATED": {"MONITORING_STARTED": "MONITORING"},
    "MONITORING": {"POSTCHECK_PASSED": "COMPLETED", "FAILURE_DETECTED": "FAILING"},
    "COMPLETED": {"PREDICTION_ACCURACY": "IDLE", "PRECHECK_STARTED": "CHECKING"},
    "FAILING": {"MIGRATION_STOPPED": "STOPPED"},
    "STOPPED": {"ROLLBACK_STARTED": "ROLLING_BACK"},
    "ROLLING_BACK": {"ORIGINAL_CONFIGURATION_RESTORED": "RESTORED", "ROLLBACK_FAILED": "IDLE"},
    "RESTORED": {"RESTORATION_VERIFIED": "IDLE"},
}
STAGES = list(LIFECYCLE)
ORDERED_EVENTS = sorted({e for allowed in LIFECYCLE.values() for e in allowed})

#: Events of a segment, and segments of a group.
SEGMENT, GROUP = 1024, 256
WHEN = ["timestamp", "seq"]


def _stage_after(code: Column, stage: Column) -> Column:
    """Number of the stage after an event, null where the stage does not allow it; events of no lifecycle change nothing."""
    number = {s: i for i, s in enumerate(STAGES)}
    rows = [F.array(*[F.lit(number.get(LIFECYCLE[s].get(e), None)).cast("int") for s in STAGES]) for e in ORDERED_EVENTS]
    return F.when(code.isNull(), stage).otherwise(F.get(F.get(F.array(*rows), code), stage))


def _code() -> Column:
    known = F.create_map(*[x for i, e in enumerate(ORDERED_EVENTS) for x in (F.lit(e), F.lit(i))])
    return F.when(F.col("event").isNotNull(), F.get(F.map_values(F.map_filter(known, lambda k, _: k == F.col("event"))), F.lit(0)))


def _identity() -> Column:
    return F.array(*[F.lit(i) for i in range(len(STAGES))])


def _segments(audit: DataFrame, segment: int) -> DataFrame:
    """(environment, segment, its events in order), and for each stage it may begin in the one it ends in."""
    numbered = position_in_group(audit, [ENV], F.date_trunc("minute", "timestamp"), WHEN, "entry")
    event = F.struct("entry", _code().alias("code"), "event", *WHEN)
    rows = numbered.groupBy(ENV, F.floor((F.col("entry") - 1) / segment).alias("segment")).agg(
        F.sort_array(F.collect_list(event)).alias("events")
    )

    def step(ends: Column, e: Column) -> Column:
        return F.transform(ends, lambda s: F.coalesce(_stage_after(e["code"], s), s))

    return rows.withColumn("ends", F.aggregate("events", _identity(), step))


def _then(first: Column, second: Column) -> Column:
    """What two runs of events one after the other do."""
    return F.transform(first, lambda s: F.get(second, s))


def _begins(runs: DataFrame, group: int) -> DataFrame:
    """(environment, segment, stage at its beginning) for runs of events (environment, segment, ends)."""
    most = runs.agg(F.max("segment")).first()[0] or 0
    own = runs.groupBy(ENV, F.floor(F.col("segment") / group).alias("parent")).agg(
        F.sort_array(F.collect_list(F.struct("segment", "ends"))).alias("runs")
    )
    if most < group:
        own = own.withColumn("begin", F.lit(0))
    else:
        folded = own.select(ENV, F.col("parent").alias("segment"), F.aggregate("runs", _identity(), lambda e, r: _then(e, r["ends"])).alias("ends"))
        above = _begins(written(folded, "order-runs"), group)
        # A null environment is one like any other.
        same = own[ENV].eqNullSafe(above[ENV]) & (own["parent"] == above["segment"])
        own = own.join(above, same).select(own[ENV], "runs", "begin")
    found = F.aggregate(
        "runs",
        F.struct(F.col("begin").cast("int").alias("stage"), F.array().cast("array<struct<segment:bigint,begin:int>>").alias("found")),
        lambda acc, r: F.struct(
            F.get(r["ends"], acc["stage"]).alias("stage"),
            F.concat(acc["found"], F.array(F.struct(r["segment"].alias("segment"), acc["stage"].alias("begin")))).alias("found"),
        ),
    )
    return own.select(ENV, F.explode(found["found"]).alias("_f")).select(ENV, "_f.segment", "_f.begin")


def walked(audit: DataFrame, segment: int = SEGMENT, group: int = GROUP) -> DataFrame:
    """Per environment and segment: the stage it begins and ends in, its number of events, and the flagged ones in order."""
    runs = written(_segments(audit, segment), "order-segments")
    begins = _begins(runs.select(ENV, "segment", "ends"), group).withColumnsRenamed({ENV: "_env", "segment": "_segment"})
    rows = runs.join(begins, F.col(ENV).eqNullSafe(F.col("_env")) & (F.col("segment") == F.col("_segment")))
    flagged = "array<struct<entry:bigint,event:string,timestamp:timestamp_ntz,seq:bigint,stage:int>>"

    def step(acc: Column, e: Column) -> Column:
        after = _stage_after(e["code"], acc["stage"])
        entry = F.struct(
            e["entry"].alias("entry"), e["event"].alias("event"), e["timestamp"].alias("timestamp"),
            e["seq"].cast("long").alias("seq"), acc["stage"].alias("stage"),
        )
        return F.struct(
            F.coalesce(after, acc["stage"]).alias("stage"),
            F.when(after.isNull(), F.concat(acc["flagged"], F.array(entry))).otherwise(acc["flagged"]).cast(flagged).alias("flagged"),
        )

    start = F.struct(F.col("begin").cast("int").alias("stage"), F.array().cast(flagged).alias("flagged"))
    out = rows.withColumn("_walk", F.aggregate("events", start, step))
    return out.select(ENV, "segment", "begin", F.col("_walk.stage").alias("end"), F.size("events").alias("events"), F.col("_walk.flagged").alias("flagged"))


def _name(stage: Column) -> Column:
    return F.get(F.array(*[F.lit(s) for s in STAGES]), stage)


def out_of_order(audit: DataFrame, segment: int = SEGMENT, group: int = GROUP) -> DataFrame:
    """The events that their environment's stage did not allow, with that stage."""
    rows = walked(audit, segment, group).select(ENV, F.explode("flagged").alias("_f"))
    return rows.select(ENV, "_f.entry", "_f.timestamp", "_f.seq", "_f.event", _name(F.col("_f.stage")).alias("stage"))


def order_summary(audit: DataFrame, segment: int = SEGMENT, group: int = GROUP) -> DataFrame:
    """Per environment: events, the stage they leave it in, how many were out of order and the first of those."""
    rows = walked(audit, segment, group)
    first = F.min_by(F.get("flagged", F.lit(0)), F.when(F.size("flagged") > 0, F.col("segment")))
    return rows.groupBy(ENV).agg(
        F.sum("events").alias("events"),
        _name(F.max_by("end", "segment")).alias("stage"),
        F.sum(F.size("flagged")).alias("out_of_order"),
        first["entry"].alias("first_entry"),
        first["event"].alias("first_event"),
    )
