"""Shape of the physical plans."""

import dataclasses
import re

import pytest
from conftest import TESTDATA

import __spark_entry__ as entry
from fleetfit.operators import validation
from fleetfit.operators.projection import Variant
from fleetfit.operators.quantiles import LargeGroups
from fleetfit.plans.fleet import table_fleet
from fleetfit.plans.oracle import ORACLES
from fleetfit.plans.registry import QUERIES
from fleetfit.sources import adapters

# Queries that write tables or run streams while they are built.
EAGER = {n for n in QUERIES if n.startswith(("sink_", "stream_"))} | {
    "port_ranked", "src_telemetry_merge", "src_metric_histories", "src_bucketed_merge", "src_clustered_lookup", "base_incremental"
}
LAZY = [n for n in QUERIES if n not in EAGER]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join_and_no_python_in_the_plan(spark, name):
    text = plan(QUERIES[name](spark, TESTDATA))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", text)
    assert not re.search("Python|Pandas|MapPartitions|FlatMapGroups", text)


def fact_exchanges(df) -> list[str]:
    """Keys of the exchanges of telemetry; the registry's are by type as well."""
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan(df))
    return [e for e in keys if "environment_id" in e and "instance_type" not in e]


def test_the_what_if_moves_the_telemetry_once(spark):
    (only,) = fact_exchanges(table_fleet(spark, TESTDATA).what_if("cheaper"))
    assert "timestamp" not in only


def test_profiles_and_baselines_share_that_exchange(spark):
    variants = tuple(Variant(p, profile=p) for p in ("peak", "bursty", "seasonal"))
    fleet = table_fleet(spark, TESTDATA)
    assert len(fact_exchanges(fleet.what_if("step_down", variants))) == 1
    assert len(fact_exchanges(fleet.baseline())) == 1


def test_without_automatic_broadcasts_only_the_registry_is_shuffled_to_the_telemetry(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(table_fleet(spark, TESTDATA).what_if("cheaper"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    keys = re.findall(r"Exchange hashpartitioning\((\w+)#", text)
    assert "SortMergeJoin [environment_id" in text and keys.count("environment_id") == 4  # the registry's rows are made distinct
    assert set(keys) == {"environment_id", "instance_type"}  # prices are aggregated by type


def test_a_large_environment_is_spread_by_time(spark):
    fleet = table_fleet(spark, TESTDATA)
    hot = dataclasses.replace(fleet)
    hot.__dict__["large"] = LargeGroups("environment_id", ids=("env-000003",))
    (only,) = fact_exchanges(hot.telemetry)
    assert "timestamp" in only
    columns = ["environment_id", "candidate_instance_type", "row_count", "peak_cpu", "decision"]
    usual, split = fleet.decided("cheaper").select(columns), hot.decided("cheaper").select(columns)
    assert usual.exceptAll(split).count() == 0 and split.exceptAll(usual).count() == 0


def test_duplicates_are_cut_before_the_shuffle(spark):
    raw = adapters.telemetry_raw(spark, TESTDATA)
    before, after = plan(validation.keep_first(raw, adapters.INGEST_ORDER)).split("Exchange hashpartitioning")
    assert "WindowGroupLimit" in before and "WindowGroupLimit" in after


def test_scans_read_needed_columns_only(spark):
    text = plan(QUERIES["src_env_lookup"](spark, TESTDATA))
    schemas = " ".join(re.findall(r"ReadSchema: struct<([^>]*)", text))
    assert "l_linestatus" not in schemas and "s_acctbal" not in schemas


def test_registry_and_oracles_name_the_same_queries():
    assert set(ORACLES) <= set(QUERIES)
    assert QUERIES.keys() <= entry.queries().keys()


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 10 and "selected_candidate" in df.columns
