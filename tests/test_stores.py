"""Tables that are kept up to date or laid out for a question: buckets, clusters, daily counts."""

import random
import uuid
from datetime import timedelta

import pytest
from conftest import START, TESTDATA, telemetry_rows
from pyspark.sql import functions as F
from test_sources import histories, key

from fleetfit import schemas as S
from fleetfit.operators import daily
from fleetfit.operators.baseline import baseline
from fleetfit.plans.fleet import table_fleet
from fleetfit.sources import merge
from fleetfit.sources.bucketed import BucketedHistories
from fleetfit.sources.clustered import ClusteredTelemetry
from fleetfit.sources.readers import lookup


def rows_of(df):
    return sorted(df.select(S.TELEMETRY_COLUMNS).collect(), key=key)


@pytest.fixture
def store(spark, tmp_path):
    return BucketedHistories(spark, f"t{uuid.uuid4().hex}", str(tmp_path / "buckets"), 4)


@pytest.mark.parametrize("repeat", [False, True])
def test_bucketed_merge_equals_the_outer_joins(spark, store, repeat):
    """Repeated and null keys too, in one write or in several."""
    parts = {n: h.unionByName(h.limit(1).withColumn("timestamp", F.lit(None).cast("timestamp_ntz"))) for n, h in histories(spark, repeat=repeat).items()}
    store.append(parts)
    assert rows_of(store.merged()) == rows_of(merge.merge_by_joins(parts))
    more = {n: h.withColumn("environment_id", F.when(F.col("environment_id") == "e1", "e1").otherwise("new")) for n, h in histories(spark).items()}
    store.append(more)
    both = {n: h.unionByName(more[n]) for n, h in parts.items()}
    assert rows_of(store.merged()) == rows_of(merge.merge_by_joins(both))


def test_bucketed_merge_shuffles_nothing(spark, store):
    store.append(histories(spark))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = store.merged()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert text.count("SortMergeJoin") == 5 and "Exchange" not in text


def test_bucketed_merge_broadcasts_nothing(spark, store, monkeypatch):
    """However few bytes the stored tables have: a row of theirs takes many times as much in the driver."""
    saved = []
    save = BucketedHistories._save
    monkeypatch.setattr(BucketedHistories, "_save", lambda self, rows, history: (saved.append(rows), save(self, rows, history)))
    store.append(histories(spark))
    store.append({n: h.withColumn("environment_id", F.lit("new")) for n, h in histories(spark).items()})
    keys = saved[-1]._jdf.queryExecution().executedPlan().toString()
    text = store.merged()._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in keys and "Broadcast" not in keys
    assert text.count("SortMergeJoin") == 5 and "Broadcast" not in text and "Exchange" not in text


def test_only_repeated_keys_are_merged_as_lists(spark):
    usual = merge.merge_histories(histories(spark))._jdf.queryExecution().executedPlan().toString()
    repeated = merge.merge_histories(histories(spark, repeat=True))._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in usual and "Exchange" not in usual
    assert "collect_list" in repeated and "LeftSemi" in repeated


@pytest.fixture(scope="module")
def clusters(spark, tmp_path_factory):
    telemetry = table_fleet(spark, TESTDATA).table
    found = ClusteredTelemetry(spark, str(tmp_path_factory.mktemp("clusters") / "t"))
    found.write(telemetry, rows_per_file=250)
    return found, telemetry


def test_one_environment_reads_few_files(spark, clusters):
    found, telemetry = clusters
    files = found.index().count()
    assert files >= 15 and found.index().agg(F.sum("readings")).first()[0] == telemetry.count()
    for (env,) in telemetry.select("environment_id").distinct().collect():
        one = found.of([env])
        own = telemetry.where(F.col("environment_id") == env)
        # Its own rows fill so many files; at both ends it shares one with a neighbour.
        assert len(one.inputFiles()) <= own.count() // 200 + 3 < files / 2
        assert rows_of(one) == rows_of(own)
    text = found.of(["env-000003"])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(environment_id" in text


def test_look_ups_of_few_and_of_many(spark, clusters, monkeypatch):
    found, telemetry = clusters
    registry = table_fleet(spark, TESTDATA).environments
    wanted = registry.select("environment_id").where("seq < 4").union(spark.sql("select 'nobody' union all select null"))
    want = sorted(lookup(wanted, registry, telemetry).select("environment_id", "found", "readings").collect(), key=key)
    for listed in (1000, 2):
        monkeypatch.setattr("fleetfit.sources.clustered.LISTED", listed)
        got = found.lookup(wanted, registry).select("environment_id", "found", "readings").collect()
        assert sorted(got, key=key) == want and len(want) == 6
    assert found.of(["zzz"]).count() == 0 == found.of([]).count()
    with pytest.raises(ValueError):
        found.of(["a", "b", "c"])


def test_a_large_environment_lies_in_several_files(spark, telemetry, tmp_path):
    rows = telemetry(telemetry_rows("a", [1.0] * 50), telemetry_rows("big", [2.0] * 2000), telemetry_rows("c", [3.0] * 50))
    found = ClusteredTelemetry(spark, str(tmp_path / "t"))
    found.write(rows, rows_per_file=300)
    assert len(found.of(["big"]).inputFiles()) >= 5 and found.of(["big"]).count() == 2000
    assert len(found.of(["a"]).inputFiles()) <= 2


# --- daily counts ------------------------------------------------------------------------------


def readings(telemetry, seed, days, environments=("a", "b", "c")):
    random.seed(seed)
    groups = []
    for e in environments:
        for d in days:
            n = random.randrange(1, 30)
            cpu = [random.choice([5.0, 7.5, 90.0, random.random() * 100]) for _ in range(n)]
            groups.append(
                telemetry_rows(e, cpu, [x / 2 for x in cpu], [50 + x for x in cpu], [x * 3 for x in cpu],
                               [random.choice([100.0, 99.0]) for _ in cpu], start=START + timedelta(days=d))
            )
    return telemetry(*groups)


def same_baseline(got, want):
    a, b = ({r.environment_id: r.asDict() for r in df.collect()} for df in (got, want))
    for row in [*a.values(), *b.values()]:
        row.pop("environment_id")
    assert a.keys() == b.keys() and sorted(got.columns) == sorted(want.columns)
    for env, row in a.items():
        assert row == pytest.approx(b[env], rel=1e-12)


def on(df, *days):
    return df.where(F.datediff(F.to_date("timestamp"), F.lit(START.date())).isin(*days))


def test_daily_counts_equal_a_full_recomputation(spark, telemetry, tmp_path):
    """New days, a day that comes in anew with other readings, one that loses all, repeated batches, and merged commits."""
    counts = daily.DailyCounts(spark, str(tmp_path / "counts"))
    first = readings(telemetry, 1, range(0, 20, 2))
    assert counts.update(first, 0) and not counts.update(first, 0)
    same_baseline(counts.baseline(), baseline(first))
    later = readings(telemetry, 2, [22], ("a", "d"))
    counts.update(later, 1)
    same_baseline(counts.baseline(), baseline(first.union(later)))
    anew = readings(telemetry, 3, [4], ("a", "e"))
    anew_days = on(anew, 4, 5)  # readings may run into the next day
    kept = first.where(~F.to_date("timestamp").isin([START.date() + timedelta(days=d) for d in (4, 5)]))
    counts.update(anew_days, 2, on(first, 4, 5).union(anew_days).select(F.to_date("timestamp").alias("day")))
    truth = kept.union(later).union(anew_days)
    same_baseline(counts.baseline(), baseline(truth))
    gone = on(truth, 0, 1).select(F.to_date("timestamp").alias("day"))
    counts.update(truth.limit(0), 3, gone)
    truth = truth.where(~F.to_date("timestamp").isin([START.date() + timedelta(days=d) for d in (0, 1)]))
    same_baseline(counts.baseline(), baseline(truth))
    for k in range(4, 12):
        counts.update(on(truth, 22), k)  # the same once more: no difference
    assert len(counts.table.live()) < 12 and not counts.update(first, 2)
    same_baseline(counts.baseline(), baseline(truth))
    some = [START.date() + timedelta(days=d) for d in (6, 12)]
    same_baseline(counts.baseline(*some), baseline(truth.where(F.to_date("timestamp").between(*some))))
    negative = counts.table.read(daily.COUNTS).groupBy(*daily.COUNTED).agg(F.sum("n").alias("n")).where("n < 0")
    assert negative.count() == 0


def test_daily_counts_without_readings(spark, telemetry, tmp_path):
    counts = daily.DailyCounts(spark, str(tmp_path / "counts"))
    assert counts.baseline().count() == 0
    counts.update(telemetry(telemetry_rows("a", [None, -0.0, 0.0])), 0)
    (row,) = counts.baseline().collect()
    assert (row.mean_cpu, row.p95_cpu, row.slo_violations) == (0.0, 0.0, 0)
    assert counts.counts().where("metric = 'cpu_utilization_pct'").first().n == 2
