"""Gate, monitoring, accuracy, audit and errors."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from conftest import START, telemetry_rows
from pyspark.sql import functions as F

from fleetfit.catalog import DEFAULT_CATALOG as CATALOG
from fleetfit.operators import accuracy, audit, errors, gate, health, validation
from fleetfit.schemas import TELEMETRY

LEDGER = (
    "environment_id string, seq long, timestamp timestamp_ntz, event string, reason string, "
    "current_instance string, candidate_instance string"
)
READING = (
    "environment_id string, ts timestamp_ntz, reading_id long, cpu double, memory double, latency double, availability double"
)


@pytest.fixture(scope="module")
def prechecked(spark, telemetry, registry, pricing):
    df = telemetry(telemetry_rows("a", [5.0] * 10), telemetry_rows("b", [80.0] * 10), telemetry_rows("c", [5.0] * 10))
    state = registry(a="medium", b="medium", c="medium", d="medium", s="medium")
    state = state.withColumn("status", F.when(F.col("environment_id") == "s", "STOPPED").otherwise("RUNNING"))
    requests = spark.createDataFrame(
        [("a", "medium", "small"), ("b", "medium", "small"), ("c", "large", "small"), ("d", "medium", "small"),
         ("s", "large", "small"), ("x", "medium", "small")],
        "environment_id string, expected_current string, candidate_instance_type string",
    )
    return gate.precheck(requests, state, df, pricing, CATALOG)


def test_precheck(prechecked):
    rows = {r.environment_id: r for r in prechecked.collect()}
    assert {e: r.event for e, r in rows.items()} == {
        "a": gate.APPROVED,
        "b": gate.BLOCKED,
        "c": gate.FAILED,
        "d": gate.BLOCKED,
        "s": gate.FAILED,
        "x": gate.FAILED,
    }
    assert [e for e, r in rows.items() if r.approved] == ["a"]
    assert rows["x"].message == "Environment x not found."
    assert rows["s"].message == "Environment s is in status STOPPED, expected RUNNING."
    assert rows["c"].message == "Current instance mismatch: expected large, got medium"
    assert rows["b"].message.startswith("Safety decision blocked migration: DO NOT RIGHTSIZE. Reasons: ['Projected P95")
    assert rows["d"].message == (
        "Safety decision blocked migration: INSUFFICIENT DATA. Reasons: ['No telemetry available for simulation.']"
    )


def test_gate_writes_two_entries_per_request(prechecked):
    entries = gate.audit_rows(prechecked).orderBy("environment_id", "seq").collect()
    assert len(entries) == 12 and {e.event for e in entries if e.seq == 0} == {gate.STARTED}
    assert [e.reason for e in entries if e.environment_id == "a"] == ["", "Safety checks passed."]


def test_window_after_equals_brute_force(spark):
    rng = np.random.default_rng(11)
    readings, events = [], []
    for i in range(2500):
        env = "hot" if rng.random() < 0.4 else f"e{rng.integers(0, 12)}"
        at = START + timedelta(minutes=int(rng.integers(0, 4000)))
        readings.append((env, at, i, float(rng.integers(0, 100)), 40.0, float(rng.integers(0, 300)), 100.0))
        if rng.random() < 0.2:
            events.append((env, i, at, health.EXECUTED, "", "medium", "small"))
    events.append(("quiet", 99999, START, health.EXECUTED, "", "medium", "small"))
    got = health.window_after(
        health.migrations(spark.createDataFrame(events, LEDGER)), spark.createDataFrame(readings, READING)
    ).collect()
    want = set()
    for env, seq, at, *_ in events:
        after = sorted((r[1], r[2], r[3]) for r in readings if r[0] == env and r[1] >= at)[:5]
        want |= {(env, seq, n, ts, cpu) for n, (ts, _, cpu) in enumerate(after)}
    assert {(r.environment_id, r.migration_seq, r.checkpoint_no, r.ts, r.cpu) for r in got} == want
    assert {r.checkpoint for r in got} == {f"T+{i}" for i in range(5)}


def test_window_after_the_last_migration_equals_the_general_form(spark):
    rng = np.random.default_rng(12)
    readings, events = [], []
    for i in range(1500):
        env, at = f"e{rng.integers(0, 9)}", START + timedelta(minutes=int(rng.integers(0, 900)))
        readings.append((env, at, i, float(rng.integers(0, 100)), 40.0, 60.0, 100.0))
        if rng.random() < 0.1:
            events.append((env, i, at, health.EXECUTED, "", "medium", "small"))
    last = health.latest_migrations(spark.createDataFrame(events, LEDGER))
    seen = spark.createDataFrame(readings, READING)
    general, special = health.window_after(last, seen), health.window_after_last(last, seen)
    assert sorted(general.collect()) == sorted(special.collect()) and special.columns == general.columns
    text = special._jdf.queryExecution().executedPlan().toString()
    assert text.count("WindowGroupLimit") == 2


@pytest.mark.parametrize(
    "cpus, latency, verdict",
    [
        ([50, 95, 50, 50, 50], 100.0, "ROLLBACK_REQUIRED"),  # one spike is enough
        ([50] * 5, 100.0, "STABLE"),
        ([85, 85, 50, 50, 50], 100.0, "STABLE"),  # two degraded are tolerated
        ([85, 85, 85, 50, 50], 100.0, "ROLLBACK_REQUIRED"),
        ([50] * 5, 500.0, "ROLLBACK_REQUIRED"),
    ],
)
def test_verdict(spark, cpus, latency, verdict):
    rows = [("a", START + timedelta(hours=i), i, float(c), 40.0, latency, 100.0) for i, c in enumerate(cpus)]
    judged = health.verdicts(health.first_readings(spark.createDataFrame(rows, READING)), ["environment_id"])
    assert judged.first().verdict == verdict


def test_rollback_list_judges_the_last_migration(spark):
    events = [
        ("a", 1, START, health.EXECUTED, "", "large", "medium"),
        ("a", 2, START + timedelta(days=1), health.EXECUTED, "", "medium", "small"),
        ("b", 3, START, health.EXECUTED, "", "medium", "small"),
    ]
    readings = [("a", START, 1, 99.0, 10.0, 10.0, 100.0), ("a", START + timedelta(days=2), 2, 50.0, 10.0, 10.0, 100.0),
                ("b", START + timedelta(days=2), 3, 99.0, 10.0, 10.0, 100.0)]
    got = health.rollback_list(spark.createDataFrame(events, LEDGER), spark.createDataFrame(readings, READING)).collect()
    assert [(r.environment_id, r.restore_instance) for r in got] == [("b", "medium")]


MOVE = "environment_id string, current_instance_type string, candidate_instance_type string"


def test_accuracy_compare_counts_missing_as_zero(spark):
    predictions = spark.createDataFrame(
        [("a", "large", "medium", 50.0, None, 55.0, 100.0), ("a", "large", "small", 99.0, 99.0, 99.0, 99.0)],
        f"{MOVE}, peak_cpu double, peak_mem double, projected_p95_latency double, projected_availability double",
    )
    seen = spark.createDataFrame(
        [("a", "large", "medium", 55.0, 0.0, None, 99.0)], f"{MOVE}, cpu double, memory double, latency double, availability double"
    )
    found = accuracy.compare(predictions, seen).collect()
    assert len(found) == 4  # the prediction of another move is none of this one
    rows = {r.metric: r for r in found}
    assert rows["CPU"].absolute_error == 5.0 and rows["CPU"].percentage_error == pytest.approx(500 / 55)
    assert rows["Memory"].percentage_error == 0.0 and rows["P95 Latency"].percentage_error == 100.0
    assert rows["Availability"].observed == 99.0


@pytest.fixture(scope="module")
def ledger(spark):
    def at(h):
        return datetime(2024, 1, 1, h)

    return spark.createDataFrame(
        [
            ("a", 1, at(1), "PRECHECK_STARTED", "", "large", "medium"),
            ("a", 2, at(2), "MIGRATION_APPROVED", "", "large", "medium"),
            ("a", 3, at(2), "MIGRATION_EXECUTED", "", "large", "medium"),
            ("a", 4, at(3), "POSTCHECK_PASSED", "", "large", "medium"),
            ("b", 5, at(1), "MIGRATION_EXECUTED", "", "medium", "small"),
            ("b", 6, at(2), "ROLLBACK_STARTED", "bad", "medium", "small"),
            ("b", 7, at(3), "ORIGINAL_CONFIGURATION_RESTORED", "", "medium", "small"),
            ("b", 8, at(3), "RESTORATION_VERIFIED", "", "medium", "small"),
        ],
        LEDGER,
    )


def test_ledger_questions(ledger, registry):
    assert {r.environment_id: r.event for r in audit.latest(ledger).collect()} == {
        "a": "POSTCHECK_PASSED",
        "b": "RESTORATION_VERIFIED",
    }
    state = {r.environment_id: r for r in audit.state(ledger, registry(a="large", b="medium", c="small")).collect()}
    assert (state["a"].lifecycle_status, state["a"].instance_type) == ("COMPLETED", "medium")
    assert (state["b"].lifecycle_status, state["b"].instance_type) == ("ROLLED_BACK", "medium")
    assert (state["c"].lifecycle_status, state["c"].instance_type) == (None, "small")
    assert [r.seq for r in audit.events_of(ledger, "a").collect()] == [1, 2, 3, 4]
    counts = audit.funnel(ledger).first()
    assert counts.migration_executed == 2 and counts.rollback_rate_pct == 50.0 and counts.approval_rate_pct == 100.0
    assert audit.funnel(ledger, audit.AGENT_EVENTS).first().agent_blocked == 0
    assert audit.state(ledger).count() == 2 and audit.event_counts(ledger).count() == 7


def test_error_catalog(spark):
    assert len(errors.ERRORS) == 18
    rows = spark.createDataFrame([("ROLLBACK_FAILURE",), ("NO_COST_BENEFIT",), ("???",)], "error_code string")
    got = {r.error_code: r for r in errors.explained(rows).collect()}
    assert got["ROLLBACK_FAILURE"].recovery_action.startswith("CRITICAL")
    assert got["NO_COST_BENEFIT"].recovery_action == errors.ABORT
    assert (got["???"].reason, got["???"].recovery_action) == (errors.UNKNOWN_REASON, errors.MANUAL)


def test_telemetry_failures(spark, registry):
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in TELEMETRY.fields) + ", nth long"
    rows = telemetry_rows("a", [10.0, None, 200.0]) + telemetry_rows("a", [1.0])
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema)
    got = {r.error_code: r.occurrences for r in errors.telemetry_failures(validation.tagged(df, ["nth"])).collect()}
    assert got == {"DUPLICATE_TELEMETRY": 1, "MISSING_TELEMETRY": 1, "INVALID_TELEMETRY": 1}
