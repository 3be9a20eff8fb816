"""Streams over several micro-batches against their batch forms."""

import bisect
import random
import time
from datetime import timedelta

import pytest
from conftest import START, TESTDATA, telemetry_rows
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from fleetfit import schemas as S
from fleetfit.operators import gate, health, validation
from fleetfit.plans.fleet import table_fleet
from fleetfit.schemas import TELEMETRY
from fleetfit.sources import adapters
from fleetfit.streaming import audit as stream_audit
from fleetfit.streaming import baseline as stream_baseline
from fleetfit.streaming import health as stream_health
from fleetfit.streaming import runner
from fleetfit.streaming import validate as stream_validate


@pytest.fixture(scope="module")
def events_folder(spark, tmp_path_factory):
    """The event table as five files in time order."""
    where = str(tmp_path_factory.mktemp("events"))
    events = adapters.table(spark, TESTDATA, "events")
    for i in range(5):
        events.where(F.col("event_id") % 1000 >= i * 200).where(F.col("event_id") % 1000 < (i + 1) * 200).coalesce(
            1
        ).write.mode("append").parquet(where)
    return where


def stream(spark, folder):
    return runner.folder_stream(spark, folder, adapters.SCHEMAS["events"], files_per_batch=1)


def test_verdicts_over_micro_batches(spark, events_folder):
    """Every migration, and each environment's last one, are judged as in the batch form."""
    readings = adapters.readings(spark, TESTDATA)
    executed = health.migrations(adapters.audit(spark, TESTDATA))
    want = health.verdicts(health.window_after(executed, readings), stream_health.MIGRATION)
    got = stream_health.judge(adapters.readings_of(stream(spark, events_folder)), executed, "test-health").select(want.columns)
    assert want.count() > 0 and got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_windows_are_closed_and_forgotten(spark, tmp_path):
    """Late readings inside the delay take their place, later ones do not; closed windows leave the state."""
    executed = spark.createDataFrame(
        [("a", 1, START), ("a", 2, START + timedelta(days=3)), ("b", 3, START)], "environment_id string, migration_seq long, migrated_at timestamp_ntz"
    )
    schema = "environment_id string, ts timestamp_ntz, reading_id long, cpu double, memory double, latency double, availability double"

    def batch(*rows):
        return spark.createDataFrame([(e, START + timedelta(hours=h), i, float(cpu), 20.0, 50.0, 100.0) for e, h, i, cpu in rows], schema)

    path = str(tmp_path / "windows")
    windows = stream_health.OpenWindows(spark, path, executed)
    feed = [
        batch(*[("a", h, h, 50) for h in (1, 3, 5, 7, 9, 11)], ("b", 1, 100, 50)),
        batch(("a", 2, 2, 99), ("a", 20, 20, 50)),  # late, inside the delay
        batch(("b", 60, 160, 50)),  # the first window of a is left behind
        batch(("a", 4, 4, 99), ("a", 73, 73, 50)),  # too late for it; the second one begins
    ]
    for k, rows in enumerate(feed):
        windows.add(rows, k)
    closed = sorted((r.migration_seq, r.reading_id) for r in windows.closed.read(health.CANDIDATES).collect())
    assert closed == [(1, i) for i in (1, 2, 3, 5, 7)]
    assert sorted((r.migration_seq, r.reading_id) for r in windows.open().collect()) == [(2, 73), (3, 100), (3, 160)]
    again = stream_health.OpenWindows(spark, path, executed)  # another process, and a micro-batch that is run again
    again.add(feed[1], 1)
    for k in range(4, 20):
        again.add(batch(("b", 100 + 4 * k, 200 + k, 50)), k)
    assert sorted(r.migration_seq for r in again.verdicts().collect()) == [1, 2, 3]
    assert {r.migration_seq for r in again.closed.read(health.CANDIDATES).collect()} == {1, 3}
    assert again.candidates.read(health.CANDIDATES).count() <= 12 and len(again.candidates.live()) <= 8


def test_sketched_baseline(spark, tmp_path):
    """The sketch's P95 is within its rank error; all else equals the exact form, and the state has a row per window."""
    random.seed(8)
    schema = "environment_id string, ts timestamp_ntz, cpu double, memory double, latency double, availability double"
    folder, values = str(tmp_path / "in"), {}
    for day in range(3):
        rows = []
        for env in ("a", "b"):
            values[env, day] = sorted(random.paretovariate(1.1) for _ in range(4000))
            rows += [(env, START + timedelta(days=day, seconds=i), v, 20.0, 50.0, 100.0 - i % 2) for i, v in enumerate(random.sample(values[env, day], 4000))]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    stream_of = lambda: runner.folder_stream(spark, folder, spark.read.parquet(folder).schema, files_per_batch=1)
    exact = runner.run_append(stream_baseline.windowed_baseline(stream_of()), "exact")
    for accuracy in (20, 500):
        found = runner.run_append(stream_baseline.windowed_baseline(stream_of(), accuracy=accuracy), "sketched")
        assert found.columns == exact.columns and found.count() == 4
        for got, want in zip(*(sorted(df.collect(), key=lambda r: (r.environment_id, r.window_start)) for df in (found, exact))):
            day = (got.window_start.replace(tzinfo=None) - START).days
            ranked = values[got.environment_id, day]
            assert abs(bisect.bisect_right(ranked, got.p95_cpu) - 0.95 * 4000) <= 4000 / accuracy + 1
            numbers = [k for k, v in want.asDict().items() if k != "p95_cpu" and isinstance(v, (int, float))]
            assert [got[k] for k in numbers] == pytest.approx([want[k] for k in numbers]) and len(numbers) == 8


def test_closed_windows(spark, events_folder):
    out = runner.run_append(
        stream_baseline.windowed_baseline(adapters.readings_of(stream(spark, events_folder))), "test-baseline"
    )
    last = adapters.readings(spark, TESTDATA).agg(F.max("ts")).first()[0]
    days = adapters.readings(spark, TESTDATA).select(F.to_date("ts").alias("d")).distinct().count()
    assert out.agg(F.max("window_end")).first()[0] <= last
    assert out.select("window_start").distinct().count() == days - 1
    assert out.select("window_start", "environment_id").distinct().count() == out.count()


@pytest.mark.parametrize(("length", "slide"), [("1 day", "1 hour"), ("5 hours", "2 hours")])
def test_sliding_windows_of_panes(spark, tmp_path, length, slide):
    """Late readings, null ids, times and values, over several micro-batches: as with a state row per window."""
    random.seed(4)
    schema = "environment_id string, ts timestamp_ntz, cpu double, memory double, latency double, availability double"
    folder = str(tmp_path / "in")
    for k in range(6):
        rows = [
            (e, START + timedelta(hours=20 * k + random.uniform(-30, 20)), random.choice([None, 1.0, 2.0, 5.0]), random.choice([None, 3.0]), 50.0 + k, 99.0 + i % 2)
            for e in ("a", "b", "", None) for i in range(12)
        ]
        spark.createDataFrame([*rows, ("a", None, 9.0, 9.0, 9.0, 9.0)], schema).coalesce(1).write.mode("append").parquet(folder)
    readings = lambda: runner.folder_stream(spark, folder, spark.read.parquet(folder).schema, files_per_batch=1)
    want = runner.run_append(stream_baseline.windowed_baseline(readings(), length, slide), "by-window")
    path = str(tmp_path / "windows")
    got = stream_baseline.sliding_baseline(readings(), length, slide, path=path)
    assert got.dtypes == want.dtypes
    by = lambda r: (str(r.window_start), str(r.environment_id))
    found, wanted = (sorted(df.collect(), key=by) for df in (got, want))
    assert len(found) == len(wanted) > 100
    for x, y in zip(found, wanted):
        assert list(x)[:3] == list(y)[:3] and list(x)[3:] == pytest.approx(list(y)[3:])
    again = stream_baseline.SlidingWindows(spark, path, readings().schema, length, slide)
    again.add(spark.read.parquet(folder), 3)  # a micro-batch that is run again
    again.finish()
    assert again.baselines().count() == len(found)


def test_sliding_state_has_a_reading_once(spark, tmp_path):
    """A row per pane is kept and one per run of equal windows is written, not 24 of each."""
    schema = "environment_id string, ts timestamp_ntz, cpu double, memory double, latency double, availability double"
    rows = [("a", START + timedelta(days=5 * i), float(i), 20.0, 50.0, 100.0) for i in range(4)]
    windows = stream_baseline.SlidingWindows(spark, str(tmp_path / "w"), spark.createDataFrame([], schema).schema, "1 day", "1 hour")
    windows.add(spark.createDataFrame(rows, schema), 0)
    windows.finish()
    assert windows.panes.read().count() == 4 and windows.closed.read().count() <= 2 * 3
    assert windows.baselines().count() == 24 * 3


def test_stream_validation_keeps_the_first_row_of_a_key(spark, registry, tmp_path):
    folder = str(tmp_path / "in")
    rows = telemetry_rows("a", [10.0, None, 500.0, 20.0] + [30.0] * 40)
    again = telemetry_rows("a", [11.0, 12.0]) + telemetry_rows("stranger", [1.0])
    schema = TELEMETRY.simpleString()[7:-1] + ",place:long"
    for place, part in ((2, again), (1, rows)):
        frame = spark.createDataFrame([(*r, place) for r in part], schema)
        frame.coalesce(1).write.mode("append").parquet(folder)
    source = spark.read.parquet(folder).schema
    telemetry = runner.folder_stream(spark, folder, source, files_per_batch=1)
    got = stream_validate.validated(telemetry, ["place"], registry(a="small")).collect()
    hours = {(r.timestamp.replace(tzinfo=None) - START) // timedelta(hours=1): r.cpu_utilization_pct for r in got}
    # The second hour's first row is invalid, whatever came in its place.
    assert hours == {0: 10.0, 3: 20.0} | {h: 30.0 for h in range(4, 44)}
    assert {r.environment_id for r in got} == {"a"}


def placed(spark, folder, *parts):
    schema = TELEMETRY.simpleString()[7:-1] + ",place:long"
    for place, rows in parts:
        spark.createDataFrame([(*r, place) for r in rows], schema).coalesce(1).write.mode("append").parquet(folder)


def test_validated_stream_is_the_batch_form(spark, registry, tmp_path):
    """Every day of the input, late first rows, null keys, and a run that goes on from the state of another."""
    folder, state, known = str(tmp_path / "in"), str(tmp_path / "state"), registry(a="small", b="large")
    nobody = [(None, "a", 1.0, 1.0, 1.0, 1.0, 1.0), (START, None, 1.0, 1.0, 1.0, 1.0, 1.0)]
    placed(spark, folder, (5, telemetry_rows("a", [20.0] * 60)), (6, telemetry_rows("b", [float("nan"), 300.0, 30.0])), (7, nobody))

    def once():
        stream = runner.folder_stream(spark, folder, spark.read.parquet(folder).schema, files_per_batch=1)
        got = stream_validate.validated(stream, ["place"], known, state)
        want = validation.clean(spark.read.parquet(folder), ["place"], known)
        rows = [sorted(map(tuple, df.select(*S.TELEMETRY_COLUMNS).collect())) for df in (got, want)]
        assert rows[0] == rows[1]
        return len(rows[0])

    assert once() == 61
    # Later, and days behind: first rows of keys that had others before, one of them invalid; a repeated one; a stranger's.
    placed(spark, folder, (1, telemetry_rows("a", [11.0, 500.0])), (9, telemetry_rows("b", [1.0])), (1, telemetry_rows("x", [1.0])))
    placed(spark, folder, *[(20 + i, telemetry_rows("a", [float(i)], start=START + timedelta(days=9, hours=i))) for i in range(8)])
    assert once() == 61 - 1 + 8
    assert once() == 68


def test_a_repeated_micro_batch_of_validation(spark, tmp_path):
    """A micro-batch that is run again changes nothing, also after its commit was merged; the state stays few commits."""
    schema = TELEMETRY.simpleString()[7:-1] + ",place:long"
    batches = [
        stream_validate.prepared(spark.createDataFrame([(*r, p) for r in telemetry_rows("a", [float(p), 5.0])], schema), ["place"])
        for p in (9, 8, 7, 6, 5, 4, 3, 2, 1, 0)
    ]
    state = stream_validate.FirstRows(spark, str(tmp_path / "state"), batches[0].schema, ["place"])
    for k, batch in enumerate(batches):
        state.add(batch, k)
    want = sorted(map(tuple, state.settled().collect()))
    assert [r[2] for r in want] == [0.0, 5.0] and len(state.table.live()) == 3
    for k in (0, 9, 4):
        state.add(batches[0], k)
    assert sorted(map(tuple, state.settled().collect())) == want
    assert [r.cpu_utilization_pct for r in state.settled(before=START + timedelta(hours=1)).collect()] == [0.0]


def test_a_repeated_micro_batch_does_not_repeat_its_rows(spark, tmp_path):
    path = str(tmp_path / "ledger")
    write = runner.batch_writer(path)
    first, second = spark.range(0, 10), spark.range(10, 15)
    write(first, 0)
    write(second, 1)
    write(first, 0)  # the batch is run again after a failure
    assert spark.read.parquet(path).count() == 15


def test_ledger_stream(spark, events_folder):
    fleet = table_fleet(spark, TESTDATA)
    requests = adapters.requests_of(stream(spark, events_folder), timed=True)
    ledger = stream_audit.decisions(requests, fleet.environments, gate.snapshot(fleet))
    asked = adapters.requests_of(adapters.table(spark, TESTDATA, "events"), timed=True)
    asked = asked.select(*gate.REQUEST, F.to_date("requested_at").alias("requested_on")).distinct()
    checked = gate.precheck(asked, fleet.environments, fleet.passes, fleet.pricing, fleet.catalog, fleet.large)
    want = gate.audit_rows(checked, ("requested_on",)).select(ledger.columns)
    assert ledger.exceptAll(want).count() == 0 and ledger.count() == want.count() > 0


def test_snapshot_decides_as_the_precheck_does(spark):
    """Known and unknown types, wrong current types, unregistered and stopped environments; and no telemetry is read."""
    fleet = table_fleet(spark, TESTDATA)
    rows = [(r.environment_id, r.current_instance_type) for r in fleet.environments.collect()]
    asked = [(e, c, t) for e, c in rows for t in ("small", "medium", "large", "tiny")] + [(e, "tiny", "small") for e, _ in rows[:3]]
    asked += [("nobody", "large", "small"), (None, "large", "small"), (rows[0][0], None, "small"), (rows[0][0], rows[0][1], None)]
    requests = spark.createDataFrame(asked * 2, "environment_id string, expected_current string, candidate_instance_type string")
    decisions = gate.snapshot(fleet)
    columns = [*gate.REQUEST, "state_check", "decision", "reason_codes", "event", "approved", "message"]
    got = gate.precheck_from(requests, fleet.environments, decisions).select(*columns)
    want = gate.precheck(requests, fleet.environments, fleet.passes, fleet.pricing, fleet.catalog).select(*columns)
    assert got.count() == want.count() == 2 * len(asked) and got.exceptAll(want).count() == 0
    files = gate.precheck_from(requests, fleet.environments, decisions).inputFiles()
    assert files and not any("lineitem" in f or "orders" in f for f in files)


def test_requests_are_forgotten(spark, tmp_path):
    """A repeated request of a day counts once, the next day's is a new one, and the state holds the open days only."""
    folder = str(tmp_path / "in")
    schema = "environment_id string, expected_current string, candidate_instance_type string, requested_at timestamp_ntz"
    for day in range(12):
        at = START + timedelta(days=day, hours=3)
        rows = [(f"env-{i}", "large", "small", at + timedelta(minutes=i)) for i in range(20)] * 2 + [("late", "large", "small", START)] * (day == 9)
        rows += [("timeless", "large", "small", None)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    requests = runner.folder_stream(spark, folder, spark.read.parquet(folder).schema, files_per_batch=1)
    seen, sizes = [], []

    class Progress(StreamingQueryListener):
        def onQueryStarted(self, event): ...
        def onQueryTerminated(self, event): ...
        def onQueryProgress(self, event):
            sizes.extend(s.numRowsTotal for s in event.progress.stateOperators)

    listener = Progress()
    spark.streams.addListener(listener)
    try:
        runner.run_each(stream_audit.once_per_period(requests), "test-requests", lambda batch, _: seen.extend(batch.collect()))
        for _ in range(100):
            if len(sizes) >= 12:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert len(seen) == 12 * 20 and {r.environment_id for r in seen} == {f"env-{i}" for i in range(20)}
    assert len(sizes) >= 12 and max(sizes) <= 4 * 20


def test_a_repeated_micro_batch_of_requests(spark, tmp_path):
    """The ledger has a micro-batch once, also where it is run again after the stream's own progress was lost."""
    fleet = table_fleet(spark, TESTDATA)
    decisions, folder, ledger = gate.snapshot(fleet), str(tmp_path / "in"), str(tmp_path / "ledger")
    asked = adapters.requests_of(adapters.table(spark, TESTDATA, "events"), timed=True)
    asked.coalesce(1).write.parquet(folder)
    counts = [
        stream_audit.decisions(runner.folder_stream(spark, folder, asked.schema), fleet.environments, decisions, ledger).count()
        for _ in range(2)
    ]
    assert counts[0] == counts[1] > 0
