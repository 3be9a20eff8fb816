"""Exact percentiles of groups of any size."""

import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetfit import session
from fleetfit.operators import quantiles as Q

PS = {"q0": 0.0, "q50": 0.5, "q90": 0.9, "q95": 0.95, "q100": 1.0}


def frame(spark, groups):
    rows = [(k, None if v is None else float(v)) for k, vs in groups.items() for v in vs]
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, "environment_id string, v double")


def expect(groups):
    return {k: [np.percentile([x for x in vs if x is not None], p * 100) for p in PS.values()] for k, vs in groups.items()}


def split(spark, groups):
    out = Q.split_percentiles(frame(spark, groups), ["environment_id"], {a: ("v", p) for a, p in PS.items()})
    return {r.environment_id: [r[a] for a in PS] for r in out.collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for key, values in want.items():
        assert np.allclose(got[key], values, rtol=1e-12, atol=1e-12), key


CASES = {
    "one value": [5.0],
    "one value repeated": [0.1 + 0.2] * 50,
    "two": [1.0, 2.0],
    "negative": [-5.5, -1.0, 0.0, -0.0, 3.25],
    "wide": [1e-300, 1e300, -1e300, 1.0, 1e-12],
    "with nulls": [1.0, None, 3.0],
    "close together": [1.0 + i * 2**-52 for i in range(40)],
}


def test_split_percentiles_on_hard_groups(spark):
    same(split(spark, CASES), expect(CASES))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e9, 1e9), min_size=1, max_size=200))
def test_split_percentiles_on_random_groups(spark, values):
    same(split(spark, {"g": values}), expect({"g": values}))


def test_hot_group_beside_small_ones(spark):
    rng = np.random.default_rng(0)
    groups = {"hot": list(rng.lognormal(3, 1, 20000))} | {f"e{i}": list(rng.normal(50, 5, 20)) for i in range(30)}
    df = frame(spark, groups)
    large = Q.find_large_groups(df, limit=1000)
    assert large and [r.environment_id for r in large.table.collect()] == ["hot"]
    out = Q.grouped(
        df, ["environment_id"], {a: ("v", p) for a, p in PS.items()}, [F.count(F.lit(1)).alias("n")], large
    )
    rows = {r.environment_id: r for r in out.collect()}
    same({k: [r[a] for a in PS] for k, r in rows.items()}, expect(groups))
    assert rows["hot"].n == 20000


def test_any_number_of_groups_may_be_large(spark):
    groups = {f"e{i}": [float(x * i) for x in range(30)] for i in range(600)} | {"small": [1.0]}
    df = frame(spark, groups)
    large = Q.find_large_groups(df, limit=10)
    assert large.table.count() == 600
    out = Q.grouped(df, ["environment_id"], {a: ("v", p) for a, p in PS.items()}, [], large)
    same({r.environment_id: [r[a] for a in PS] for r in out.collect()}, expect(groups))


def test_only_known_ids_make_a_group_large(spark):
    df = frame(spark, {"stranger": [float(x) for x in range(50)], "a": [1.0, 2.0]})
    known = spark.createDataFrame([("a",)], "environment_id string")
    assert Q.find_large_groups(df, limit=10) and not Q.find_large_groups(df, limit=10, known=known)


def test_small_tables_need_no_group_counts(spark):
    assert not Q.find_large_groups(frame(spark, CASES))


@pytest.mark.parametrize("large", [Q.NO_LARGE_GROUPS, Q.LargeGroups("environment_id", ids=("a",))])
def test_a_group_of_nulls_keeps_its_row(spark, large):
    df = frame(spark, {"a": [None, None]})
    (row,) = Q.grouped(df, ["environment_id"], {"p": ("v", 0.5)}, [F.count(F.lit(1)).alias("n")], large).collect()
    assert row.n == 2 and row.p is None


def test_exchanges_grow_with_the_input_and_leave_the_session_alone(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    assert session.partitions_for(spark, 10) == int(before)
    assert session.partitions_for(spark, 100 * session.ROWS_PER_PARTITION + 1) == 101
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
