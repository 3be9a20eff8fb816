"""Readers, merge and sinks on files."""

import pandas as pd
import pytest
from conftest import START, telemetry_rows
from pyspark.sql import functions as F

from fleetfit import schemas as S
from fleetfit.operators import audit, gate, portfolio, scenarios, validation, whatif
from fleetfit.operators.projection import Variant
from fleetfit.plans.fleet import folder_fleet
from fleetfit.schemas import INSUFFICIENT, SAFE, UNSAFE
from fleetfit.sources.commits import CommitTable
from fleetfit.sources import merge, readers, sinks


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """CSV tables as a user keeps them: a registry, prices, five histories and the pre-joined fact."""
    where = tmp_path_factory.mktemp("data")
    rows = telemetry_rows("a", [5.0] * 15) + telemetry_rows("b", [45.0, None] + [45.0] * 13)
    wide = pd.DataFrame(rows, columns=S.TELEMETRY_COLUMNS)
    for name, metric in S.HISTORIES.items():
        wide[[*S.KEYS, metric]].to_csv(where / f"{name}.csv", index=False)
    full = pd.concat([wide, wide.head(3).assign(cpu_utilization_pct=77.0)]).assign(instance_type="large")
    full.to_csv(where / "full_telemetry.csv", index=False)
    pd.DataFrame(
        {"environment_id": ["a", "b"], "service_name": ["x", "y"], "current_instance_type": ["large", "large"],
         "vcpu": [8, 8], "memory_gb": [32, 32]}
    ).to_csv(where / "environments.csv", index=False)
    pd.DataFrame(
        {"timestamp": [START] * 3, "region": ["r"] * 3, "instance_type": ["small", "medium", "large"], "hourly_price": [0.05, 0.1, 0.2]}
    ).to_csv(where / "pricing_history.csv", index=False)
    return str(where)


def test_csv_tables(spark, folder):
    registry = readers.environments(spark, folder)
    assert registry.select(S.ENVIRONMENTS.names).schema == S.ENVIRONMENTS
    assert {r.status for r in registry.collect()} == {"RUNNING"} and "seq" in registry.columns
    prices = readers.pricing(spark, folder)
    assert prices.columns == ["timestamp", "instance_type", "hourly_price"] and prices.count() == 3
    assert prices.agg(F.sum("hourly_price")).first()[0] == pytest.approx(0.35)
    one = readers.full_telemetry(spark, folder, environment_id="a")
    assert one.count() == 18 and one.where("cpu_utilization_pct is null").count() == 0


def test_fleet_from_histories(spark, folder):
    fleet = folder_fleet(spark, folder)
    assert fleet.telemetry.count() == 29  # one reading of b lacks its CPU
    rows = {r.environment_id: r for r in fleet.portfolio().collect()}
    assert rows["a"].selected_candidate == "medium" and rows["b"].selected_candidate == "medium"


def test_fleet_from_the_prejoined_fact_keeps_the_first_rows_of_the_file(spark, folder):
    fleet = folder_fleet(spark, folder, prejoined=True)
    assert fleet.telemetry.count() == 29 and fleet.telemetry.where("cpu_utilization_pct = 77").count() == 0
    assert "_row" not in fleet.telemetry.columns
    unchecked = folder_fleet(spark, folder, prejoined=True, validate=False)
    assert unchecked.telemetry.count() == 33


def test_simulating_named_moves(spark, folder):
    fleet = folder_fleet(spark, folder, prejoined=True)
    moves = [("a", "large", "small"), ("b", "large", "small"), ("nobody", "large", "small")]
    rows = {r.environment_id: r for r in fleet.simulate(moves).collect()}
    assert {e: r.decision for e, r in rows.items()} == {"a": SAFE, "b": UNSAFE, "nobody": INSUFFICIENT}
    swept = fleet.simulate(moves[:1], tuple(Variant(f"p{p}", cpu_pressure=p) for p in (0.0, 5.0)))
    assert {r.variant_id: r.decision for r in swept.collect()} == {"p0.0": SAFE, "p5.0": UNSAFE}


def test_every_question_on_a_folder(spark, folder, tmp_path):
    """Ranking, scenarios, gate and ledger need nothing that the tables do not have."""
    fleet = folder_fleet(spark, folder)
    steps = portfolio.step_down_rows(fleet.decided("step_down"))
    ranks = [(r.environment_id, r["rank"]) for r in portfolio.ranked(steps, fleet.environments).orderBy("rank").collect()]
    assert ranks == [("a", 1), ("b", 2)] or ranks == [("b", 1), ("a", 2)]
    assert portfolio.top_safe(steps, fleet.environments, 1).count() == 1
    picked = {r.scenario: r.environment_id for r in scenarios.pick(fleet.environments, scenarios.classify(fleet.telemetry)).collect()}
    assert picked == {"normal": "a", "peak": "a", "bursty": "a"}
    asked = [("a", "large", "medium"), ("a", "large", "tiny"), ("b", "medium", "small"), ("nobody", "large", "small")]
    requests = spark.createDataFrame(asked, "environment_id string, expected_current string, candidate_instance_type string")
    checked = gate.precheck(requests, fleet.environments, fleet.passes, fleet.pricing, fleet.catalog)
    rows = {(r.environment_id, r.candidate_instance_type): r for r in checked.collect()}
    assert rows["a", "medium"].event == gate.APPROVED and rows["b", "small"].state_check == "INSTANCE_MISMATCH"
    assert rows["nobody", "small"].state_check == "NOT_FOUND"
    assert rows["a", "tiny"].reason_codes == [whatif.UNKNOWN_TYPE] and whatif.UNKNOWN_TEXT in rows["a", "tiny"].message
    strict = gate.precheck(requests, fleet.environments, fleet.passes, fleet.pricing, fleet.catalog, variant=Variant(max_cpu=5.0))
    assert strict.where("candidate_instance_type = 'medium'").first().event == gate.BLOCKED
    ledger = str(tmp_path / "ledger")
    sinks.append_audit(sinks.stamped(gate.audit_rows(checked).drop("seq")), ledger, "gate", 0)
    assert audit.latest(readers.audit_log(spark, ledger)).count() == 3
    grades = fleet.grades.withColumn("quality", F.lit("LOW"))
    assert {r.decision for r in fleet.decided("step_down", grades=grades).collect()} == {INSUFFICIENT}


def test_ledger_as_csv(spark, tmp_path):
    path = tmp_path / "audit.csv"
    lines = ["timestamp,environment_id,current_instance,candidate_instance,event,reason"]
    lines += [f"2024-01-01T0{i}:00:00Z,a,large,medium,{e},r{i}" for i, e in enumerate(("PRECHECK_STARTED", "MIGRATION_EXECUTED"))]
    lines += ["2024-01-01T07:00:00+05:00,b,large,medium,MIGRATION_APPROVED,x"]
    path.write_text("\n".join(lines) + "\n")
    rows = readers.audit_log(spark, str(path), "csv")
    assert {r.environment_id: (r.event, r.timestamp.hour) for r in audit.latest(rows).collect()} == {
        "a": ("MIGRATION_EXECUTED", 1),
        "b": ("MIGRATION_APPROVED", 2),
    }


def test_repeated_moves_are_one_move(spark, folder):
    fleet = folder_fleet(spark, folder, prejoined=True)
    move = ("a", "large", "small")
    (once,) = fleet.simulate([move]).collect()
    twice = fleet.simulate([move, move]).collect()
    assert [(r.row_count, r.simulated_monthly_cost) for r in twice] == [(once.row_count, once.simulated_monthly_cost)] * 2


def test_a_type_outside_the_catalog_is_named(spark, folder):
    (row,) = folder_fleet(spark, folder, prejoined=True).simulate([("a", "large", "xlarge")]).collect()
    assert row.decision == INSUFFICIENT and row.reason_codes == [whatif.UNKNOWN_TYPE] and row.reasons == [whatif.UNKNOWN_TEXT]


def test_lookup(spark, folder):
    fleet = folder_fleet(spark, folder)
    wanted = spark.createDataFrame([("a",), ("nobody",)], "environment_id string")
    rows = {r.environment_id: r for r in readers.lookup(wanted, fleet.environments, fleet.telemetry).collect()}
    assert rows["a"].found and rows["a"].readings == 15 and not rows["nobody"].found and rows["nobody"].readings is None


def histories(spark, repeat=False):
    out = {}
    for n, (name, metric) in enumerate(S.HISTORIES.items()):
        rows = [(START, f"e{i}", float(i * 10 + n)) for i in range(6) if i != n]
        if repeat and n == 1:
            rows.append((START, "e5", 999.0))
        out[name] = spark.createDataFrame(rows, S.history_schema(metric))
    return out


def key(row):
    return tuple(str(v) for v in row)


def test_union_merge_equals_the_outer_joins(spark):
    parts = histories(spark)
    by_union = merge.merge_histories(parts).select(S.TELEMETRY_COLUMNS)
    by_joins = merge.merge_by_joins(parts).select(S.TELEMETRY_COLUMNS)
    assert sorted(by_union.collect(), key=key) == sorted(by_joins.collect(), key=key) and by_union.count() == 6


def test_duplicate_keys_multiply_rows(spark):
    parts = histories(spark, repeat=True)
    merged, joined = (f(parts).select(S.TELEMETRY_COLUMNS) for f in (merge.merge_histories, merge.merge_by_joins))
    assert merged.where("environment_id = 'e5'").count() == 2
    assert sorted(merged.collect(), key=key) == sorted(joined.collect(), key=key)


def test_null_keys_meet_no_other_row(spark):
    parts = {n: h.unionByName(h.limit(1).withColumn("timestamp", F.lit(None).cast("timestamp_ntz"))) for n, h in histories(spark).items()}
    merged, joined = (f(parts).select(S.TELEMETRY_COLUMNS) for f in (merge.merge_histories, merge.merge_by_joins))
    assert sorted(merged.collect(), key=key) == sorted(joined.collect(), key=key)


def test_histories_round_trip(spark, telemetry, tmp_path):
    df = telemetry(telemetry_rows("a", [1.0, 2.0]), telemetry_rows("b", [3.0]))
    sinks.write_histories(df, str(tmp_path))
    back = merge.merge_histories(readers.histories(spark, str(tmp_path), "parquet"))
    assert sorted(back.select(df.columns).collect(), key=key) == sorted(df.collect(), key=key)
    assert sinks.long_metrics(df).count() == 3 * len(S.METRICS)


def ledger_events(spark, reason="", n=1):
    return spark.createDataFrame(
        [("a", "large", "medium", "PRECHECK_STARTED", f"{reason}{i}") for i in range(n)],
        "environment_id string, current_instance string, candidate_instance string, event string, reason string",
    )


def test_ledger_appends(spark, tmp_path):
    """A batch of a writer is written once, however often its job is run; other writers and batches are others."""
    path, events = str(tmp_path / "ledger"), ledger_events(spark)
    written = [sinks.append_audit(sinks.stamped(events), path, w, b) for w, b in (("x", 0), ("x", 0), ("x", "1/é"), ("y", 0), ("x", 0))]
    assert written == [True, False, True, True, False]
    ledger = readers.audit_log(spark, path)
    assert ledger.count() == 3 and "event_date" in ledger.columns and ledger.where("timestamp is null").count() == 0
    assert "commit" not in ledger.columns


def test_a_crash_between_files_and_manifest(spark, tmp_path, monkeypatch):
    """Files without a manifest are not read; the repeated job writes anew, once."""
    path = str(tmp_path / "ledger")
    sinks.append_audit(sinks.stamped(ledger_events(spark, "first")), path, "w", 0)
    with monkeypatch.context() as m:
        m.setattr(CommitTable, "commit", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("driver lost")))
        with pytest.raises(RuntimeError):
            sinks.append_audit(sinks.stamped(ledger_events(spark, "second", 5)), path, "w", 1)
    assert len(list((tmp_path / "ledger" / "data").iterdir())) == 2
    assert readers.audit_log(spark, path).count() == 1
    assert sinks.append_audit(sinks.stamped(ledger_events(spark, "second", 5)), path, "w", 1)
    assert readers.audit_log(spark, path).count() == 6


def test_two_writers_of_one_batch(spark, tmp_path):
    """Of two jobs that write the same batch at once, the one whose manifest comes first counts."""
    table = CommitTable(spark, str(tmp_path / "t"))
    mine, theirs = (table.write(spark.range(n)) for n in (3, 4))
    assert table.commit("w.0", theirs) and not table.commit("w.0", mine)
    assert table.read().count() == 4 and not list((tmp_path / "t" / "commits").glob("_*"))


def test_merged_commits(spark, tmp_path):
    """Commits are merged level by level; what was merged is replaced, and its batches stay known."""
    table = CommitTable(spark, str(tmp_path / "t"))
    for k in range(9):
        assert table.append(spark.range(k, k + 2), "w", k)
        table.merge(lambda rows: rows.distinct(), after=3)
    assert sorted(c.level for c in table.live()) == [2]
    assert sorted(r.id for r in table.read().collect()) == list(range(10))
    assert not table.append(spark.range(100, 200), "w", 4) and table.read().count() == 10
    assert CommitTable(spark, str(tmp_path / "none")).read(spark.range(1).schema).count() == 0
    with pytest.raises(ValueError):
        CommitTable(spark, str(tmp_path / "none")).read()


def test_results_as_csv(spark, tmp_path):
    df = spark.createDataFrame([("a", ["X", "Y"], 1.5)], "environment_id string, reason_codes array<string>, v double")
    path = str(tmp_path / "results")
    sinks.write_results(df, path)
    row = spark.read.option("header", True).csv(path).first()
    assert (row.reason_codes, row.v) == ("X|Y", "1.5")


def test_schema_report_of_a_partial_table(spark, telemetry):
    df = telemetry(telemetry_rows("a", [1.0])).drop("latency_ms")
    assert [r.required_column for r in validation.schema_report(df).where("not present").collect()] == ["latency_ms"]
