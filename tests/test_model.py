"""The composed what-if against a plain per-environment calculation on random telemetry."""

import math

import numpy as np
import pytest
from conftest import telemetry_rows

from fleetfit import schemas as S
from fleetfit.catalog import DEFAULT_CATALOG as CATALOG
from fleetfit.operators import whatif
from fleetfit.operators.projection import Variant
from fleetfit.operators.quantiles import NO_LARGE_GROUPS, LargeGroups

TYPES = {t.name: t for t in CATALOG.types}
PRICES = {"small": 0.05, "medium": 0.10, "large": 0.20}
VARIANTS = (
    Variant("base"),
    Variant("grown", traffic_growth=0.35, cpu_pressure=0.1, memory_pressure=0.05),
    Variant("peak", profile="peak"),
    Variant("low", profile="low-traffic", traffic_growth=0.2),
    Variant("seasonal", profile="seasonal"),
    Variant("tight", latency_target=54.0, availability_target=99.99, max_cpu=60.0, max_mem=70.0),
)


def random_group(rng, name):
    n = int(rng.integers(3, 60))

    def some(values, share):
        return [None if rng.random() < share else float(v) for v in values]

    return telemetry_rows(
        name,
        some(rng.uniform(0, 70, n), 0.05),
        memory=some(rng.uniform(5, 60, n), 0.05),
        requests=[0.0 if rng.random() < 0.1 else float(v) for v in rng.integers(1, 400, n)],
    )


def expected(rows, current, candidate, v):
    a, b = TYPES[current], TYPES[candidate]
    observed = np.array([r[5] for r in rows])
    factor = np.ones(len(rows))
    if v.profile == "peak":
        factor[observed >= np.quantile(observed, 0.9)] = 1.5
    elif v.profile == "low-traffic":
        factor[:] = 0.5
    elif v.profile == "seasonal":
        factor = np.array([1 + 0.3 * math.sin(2 * math.pi * i / 24) for i in range(len(rows))])
    latencies, availabilities, cpus, memories = [], [], [], []
    for row, f in zip(rows, factor):
        load = f * (1 + v.traffic_growth) * row[5] / (row[5] or 1)
        cpu = None if row[2] is None else row[2] * a.vcpu / b.vcpu * load * (1 + v.cpu_pressure)
        memory = None if row[3] is None else row[3] * a.memory_gb / b.memory_gb * load * (1 + v.memory_pressure)
        cpus += [] if cpu is None else [cpu]
        memories += [] if memory is None else [memory]
        p = None if cpu is None or memory is None else max(cpu, memory)
        if p is None:
            penalty = 0.0
        elif p <= 75:
            penalty = p / 15
        elif p < 100:
            penalty = 5 + (p - 75) ** 1.5
        else:
            penalty = 100 + (p - 100) ** 2
        latencies.append(50 + penalty)
        availabilities.append(100.0 if p is None or p <= 95 else min(100.0, max(0.0, 100 - (p - 95) / 2)))
    p95, available = np.percentile(latencies, 95), np.mean(availabilities)
    saving = (PRICES[current] - PRICES[candidate]) * len(rows)
    blocked = [
        saving <= 0,
        p95 > v.latency_target,
        available < v.availability_target,
        bool(cpus) and max(cpus) > v.max_cpu,
        bool(memories) and max(memories) > v.max_mem,
    ]
    violations = np.mean([x < v.availability_target for x in availabilities])
    return p95, available, violations, max(cpus, default=None), max(memories, default=None), saving, S.UNSAFE if any(blocked) else S.SAFE


@pytest.mark.parametrize("seed, large", [(1, NO_LARGE_GROUPS), (2, NO_LARGE_GROUPS), (3, LargeGroups("environment_id", ids=("a", "d")))])
def test_random_fleets(telemetry, registry, pricing, seed, large):
    rng = np.random.default_rng(seed)
    types = {e: ("small", "medium", "large")[int(rng.integers(0, 3))] for e in "abcdefgh"}
    groups = {e: random_group(rng, e) for e in types}
    result = whatif.what_if(
        telemetry(*groups.values()), registry(**types), pricing, CATALOG, "cheaper_and_self", VARIANTS, large=large
    )
    rows = whatif.decide(result).collect()
    assert len(rows) == sum(len([1 for a, _, _ in CATALOG.pairs("cheaper_and_self") if a.name == t]) for t in types.values()) * len(VARIANTS)
    for r in rows:
        want = expected(groups[r.environment_id], r.current_instance_type, r.candidate_instance_type, VARIANTS[r.variant_no])
        got = (r.projected_p95_latency, r.projected_availability, r.slo_violation_rate, r.peak_cpu, r.peak_mem, r.absolute_monthly_saving)
        assert got == pytest.approx(want[:6], rel=1e-9, abs=1e-9) and r.decision == want[6], (r, want)
