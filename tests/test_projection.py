"""Workload projection and traffic profiles."""

import math

import numpy as np
import pytest
from conftest import telemetry_rows
from pyspark.sql import functions as F

from fleetfit.catalog import DEFAULT_CATALOG as CATALOG
from fleetfit.operators import projection as P
from fleetfit.operators.quantiles import NO_LARGE_GROUPS, LargeGroups


def project(df, envs, policy="step_down", variant=P.Variant(), large=NO_LARGE_GROUPS, keep=()):
    rows = P.project_rows(df, envs, CATALOG, policy, (variant,), large, keep=("timestamp", *keep))
    return rows.orderBy("environment_id", "timestamp").collect()


def test_capacity_ratio_and_pressure(telemetry, registry):
    df = telemetry(telemetry_rows("a", [20.0]))
    (row,) = project(df, registry(a="medium"), variant=P.Variant(cpu_pressure=0.1))
    assert row.projected_cpu == pytest.approx(44.0) and row.projected_memory == pytest.approx(40.0)


def test_pressure_on_the_same_type(telemetry, registry):
    df = telemetry(telemetry_rows("a", [20.0] * 24))
    rows = project(df, registry(a="medium"), "self", P.Variant(cpu_pressure=0.5))
    assert np.mean([r.projected_cpu for r in rows]) == pytest.approx(30.0)


def test_growth_scales_the_load_and_an_idle_row_stays_idle(telemetry, registry):
    df = telemetry(telemetry_rows("a", [20.0, 20.0], requests=[100.0, 0.0]))
    busy, idle = project(df, registry(a="medium"), variant=P.Variant(traffic_growth=0.5))
    assert busy.projected_cpu == pytest.approx(60.0) and busy.projected_requests == pytest.approx(150.0)
    assert idle.projected_cpu == 0.0 and idle.projected_memory == 0.0


def test_projection_is_not_clipped_and_missing_stays_missing(telemetry, registry):
    df = telemetry(telemetry_rows("a", [90.0, None]))
    high, missing = project(df, registry(a="medium"))
    assert high.projected_cpu == 180.0 and high.projected_latency == pytest.approx(50 + 100 + 80**2)
    assert missing.pressure is None and missing.projected_latency == 50.0 and missing.projected_availability == 100.0


def test_low_traffic(telemetry, registry):
    rows = project(telemetry(telemetry_rows("a", [20.0] * 5)), registry(a="medium"), variant=P.Variant(profile="low-traffic"))
    assert [r.projected_requests for r in rows] == [50.0] * 5


def test_peak_raises_the_top_tenth(telemetry, registry):
    requests = [float(x) for x in range(1, 21)]
    rows = project(
        telemetry(telemetry_rows("a", [20.0] * 20, requests=requests)), registry(a="medium"), variant=P.Variant(profile="peak")
    )
    bound = np.percentile(requests, 90)
    assert [r.projected_requests for r in rows] == [x * 1.5 if x >= bound else x for x in requests]


def test_seasonal_wave(telemetry, registry):
    rows = project(telemetry(telemetry_rows("a", [20.0] * 30)), registry(a="medium"), variant=P.Variant(profile="seasonal"))
    want = [100 * (1 + 0.3 * math.sin(2 * math.pi * i / 24)) for i in range(30)]
    assert np.allclose([r.projected_requests for r in rows], want)


@pytest.mark.parametrize("n, spikes", [(1, 1), (19, 1), (40, 2), (100, 5)])
def test_bursty_share(telemetry, registry, n, spikes):
    rows = project(telemetry(telemetry_rows("a", [20.0] * n)), registry(a="medium"), variant=P.Variant(profile="bursty"))
    assert sorted(r.projected_requests for r in rows) == [100.0] * (n - spikes) + [300.0] * spikes


@pytest.mark.parametrize("large", [LargeGroups("environment_id", ids=("a",)), LargeGroups("environment_id", every=True)])
def test_large_environments_get_the_same_profiles(telemetry, registry, large):
    rng = np.random.default_rng(5)
    groups = [telemetry_rows(e, [20.0] * n, requests=[float(x) for x in rng.integers(1, 60, n)]) for e, n in (("a", 150), ("b", 40))]
    df, envs = telemetry(*groups), registry(a="medium", b="large")
    for profile in ("peak", "bursty", "seasonal"):
        usual = project(df, envs, variant=P.Variant(profile=profile))
        assert project(df, envs, variant=P.Variant(profile=profile), large=large) == usual


@pytest.mark.parametrize("profile", ["steady", "peak", "bursty", "low-traffic", "seasonal"])
def test_null_times_and_repeated_keys_fare_alike_in_large_environments(telemetry, registry, profile):
    rng = np.random.default_rng(6)
    rows = telemetry_rows("a", [20.0] * 60, requests=[float(x) for x in rng.integers(1, 60, 60)])
    rows = [(None, *r[1:]) if i % 12 == 0 else r for i, r in enumerate(rows)] + rows[5:15] + rows[5:8]
    df, envs = telemetry(rows), registry(a="medium")
    usual = project(df, envs, variant=P.Variant(profile=profile))
    split = project(df, envs, variant=P.Variant(profile=profile), large=LargeGroups("environment_id", ids=("a",)))
    assert len(usual) == len(rows)
    values = lambda out: sorted((str(r.timestamp), r.projected_requests, r.projected_cpu) for r in out)
    assert values(split) == values(usual)


def test_unknown_profile_is_refused():
    with pytest.raises(ValueError):
        P.Variant(profile="spiky")


def test_empty_telemetry(telemetry, registry):
    df = telemetry(telemetry_rows("a", [20.0])).where(F.lit(False))
    assert project(df, registry(a="medium")) == []


def test_moves_of_the_catalog(spark):
    pairs = {p: [(a.name, b.name) for a, b, _ in CATALOG.pairs(p)] for p in ("cheaper", "step_down", "step_down_or_self", "self")}
    assert pairs["cheaper"] == [("medium", "small"), ("large", "small"), ("large", "medium")]
    assert pairs["step_down"] == [("medium", "small"), ("large", "medium")]
    assert pairs["step_down_or_self"][0] == ("small", "small")
    assert len(pairs["self"]) == 3 and len(CATALOG.pairs("any")) == 9
    with pytest.raises(ValueError):
        CATALOG.pairs("sideways")
