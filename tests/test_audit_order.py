"""The order of lifecycle events beside a walk through them one by one."""

import random
from datetime import timedelta

import pytest
from conftest import START
from pyspark.sql import functions as F

from fleetfit.operators import audit, audit_order

SCHEMA = "timestamp timestamp_ntz, seq long, environment_id string, current_instance string, candidate_instance string, event string, reason string"
GOOD = ["PRECHECK_STARTED", "MIGRATION_APPROVED", "MIGRATION_STARTED", "MIGRATION_EXECUTED", "MONITORING_STARTED"]
KEPT = [*GOOD, "POSTCHECK_PASSED", "PREDICTION_ACCURACY"]
ROLLED_BACK = [
    *GOOD, "FAILURE_DETECTED", "MIGRATION_STOPPED", "ROLLBACK_STARTED", "ORIGINAL_CONFIGURATION_RESTORED", "RESTORATION_VERIFIED"
]


def ledger(spark, events):
    """Events of environments in the given order; some at the same time, told apart by their number."""
    rows = [
        (START + timedelta(seconds=40 * (n // 2)), n, env, "large", "small", e, "") for env, own in events.items() for n, e in enumerate(own)
    ]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def walk(events):
    """(stage at the end, [(entry, event, stage)] of the events that were not allowed)."""
    stage, flagged = "IDLE", []
    for n, e in enumerate(events, 1):
        if e not in audit_order.ORDERED_EVENTS:
            continue
        after = audit_order.LIFECYCLE[stage].get(e)
        if after is None:
            flagged.append((n, e, stage))
        stage = after or stage
    return stage, flagged


def test_lifecycle_covers_the_vocabulary():
    assert set(audit_order.ORDERED_EVENTS) == set(audit.EVENTS)
    assert {n for allowed in audit_order.LIFECYCLE.values() for n in allowed.values()} == set(audit_order.STAGES)


def test_published_runs_are_in_order(spark):
    blocked = ["PRECHECK_STARTED", "MIGRATION_BLOCKED", "PRECHECK_STARTED", "PRECHECK_FAILED"]
    agent = [x for e in KEPT for x in (e, "AGENT_VERIFYING")]
    runs = {"kept": KEPT * 3, "back": ROLLED_BACK * 2 + KEPT, "blocked": blocked + KEPT, "agent": agent, "none": [None, "AGENT_BLOCKED"]}
    found = {r.environment_id: r for r in audit_order.order_summary(ledger(spark, runs)).collect()}
    assert {e: (r.out_of_order, r.stage) for e, r in found.items()} == {e: (0, "IDLE") for e in runs}
    assert audit_order.out_of_order(ledger(spark, runs)).count() == 0


@pytest.mark.parametrize("segment, group", [(1024, 256), (7, 3), (1, 2)])
def test_flagged_events(spark, segment, group):
    """Any order of events, in one segment, in many, and in groups of groups of segments: what a plain walk finds."""
    chance = random.Random(segment)
    runs = {f"e{k}": [chance.choice([*audit.EVENTS, "AGENT_APPROVED", "UNHEARD_OF"]) for _ in range(chance.choice([1, 5, 200]))] for k in range(12)}
    runs |= {"mixed": ROLLED_BACK * 9 + KEPT[3:] + KEPT * 9, None: ["MIGRATION_STARTED", *KEPT], "swapped": ["MIGRATION_EXECUTED", "MIGRATION_STARTED"]}
    table, want = ledger(spark, runs), {e: walk(own) for e, own in runs.items()}
    found = {r.environment_id: r for r in audit_order.order_summary(table, segment, group).collect()}
    assert {e: (r.stage, r.out_of_order, r.events) for e, r in found.items()} == {e: (s, len(f), len(runs[e])) for e, (s, f) in want.items()}
    assert {e: (r.first_entry, r.first_event) for e, r in found.items()} == {e: f[0][:2] if f else (None, None) for e, (_, f) in want.items()}
    rows = audit_order.out_of_order(table, segment, group).collect()
    assert sorted((str(r.environment_id), r.entry, r.event, r.stage) for r in rows) == sorted((str(e), *x) for e, (_, f) in want.items() for x in f)
    assert all(r.timestamp == START + timedelta(seconds=40 * (r.seq // 2)) and r.seq == r.entry - 1 for r in rows)


def test_an_environment_of_many_events_is_walked_in_several_tasks(spark):
    """A third of a million events of one environment: no segment has more than its share, and the walk is right."""
    many = spark.range(300_000).select(
        F.timestamp_seconds(F.col("id") * 7).cast("timestamp_ntz").alias("timestamp"),
        F.col("id").alias("seq"),
        F.lit("hot").alias("environment_id"),
        F.get(F.array(*[F.lit(e) for e in KEPT]), (F.col("id") % len(KEPT)).cast("int")).alias("event"),
    )
    twice = many.where("seq = 200000 + 3").withColumn("seq", F.lit(-1).cast("long"))
    walked = audit_order.walked(many.unionByName(twice), segment=512, group=16)
    assert walked.agg(F.max("events"), F.count(F.lit(1))).first()[:] == (512, 300_001 // 512 + 1)
    rows = audit_order.out_of_order(many.unionByName(twice), segment=512, group=16).collect()
    events = [KEPT[n % len(KEPT)] for n in range(300_000)]
    _, want = walk([*events[:200_003], events[200_003], *events[200_003:]])
    assert [(r.entry, r.event, r.stage) for r in rows] == want and len(want) == 1


def test_an_empty_ledger(spark):
    assert audit_order.order_summary(ledger(spark, {})).count() == 0
