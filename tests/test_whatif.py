"""What-if results, decisions and their options."""

import pytest
from conftest import telemetry_rows
from pyspark.sql import functions as F

from fleetfit import schemas as S
from fleetfit.catalog import DEFAULT_CATALOG as CATALOG
from fleetfit.functions import decision as D
from fleetfit.operators import cost, whatif
from fleetfit.operators.projection import Variant
from fleetfit.operators.quantiles import LargeGroups


def run(df, moves, pricing, policy="step_down", variants=(Variant(),), **options):
    flags = {k: options.pop(k) for k in ("require_price", "require_complete") if k in options}
    result = whatif.what_if(df, moves, pricing, CATALOG, policy, variants, completeness=True, **options)
    return whatif.decide(result, texts=True, **flags).orderBy("environment_id", "variant_no").collect()


def request(spark, env, current, candidate):
    return spark.createDataFrame(
        [(env, current, candidate)], "environment_id string, current_instance_type string, candidate_instance_type string"
    )


def test_cpu_blocks(telemetry, registry, pricing):
    (row,) = run(telemetry(telemetry_rows("a", [80.0] * 10)), registry(a="medium"), pricing)
    assert row.peak_cpu == 160.0 and row.decision == S.UNSAFE and D.CPU_LIMIT in row.reason_codes
    assert "Projected peak CPU = 160.0% exceeds safe limit (90%)" in row.reasons


def test_memory_blocks(telemetry, registry, pricing):
    (row,) = run(telemetry(telemetry_rows("a", [10.0] * 10, memory=60.0)), registry(a="medium"), pricing)
    assert row.peak_mem == 120.0 and row.decision == S.UNSAFE
    assert any(r.startswith("Projected peak memory = 120.0%") for r in row.reasons)


def test_growing_has_no_cost_benefit(spark, telemetry, pricing):
    (row,) = run(telemetry(telemetry_rows("a", [10.0] * 10)), request(spark, "a", "small", "medium"), pricing, "any")
    assert row.decision == S.UNSAFE and row.reasons == ["Candidate does not provide cost benefit."]


def test_safe_move(spark, telemetry, pricing):
    df = telemetry(telemetry_rows("a", [5.0] * 10, memory=10.0))
    (row,) = run(df, request(spark, "a", "large", "small"), pricing, "any")
    assert row.decision == S.SAFE and row.reason_codes == [] and len(row.reasons) == 1
    assert row.baseline_monthly_cost == pytest.approx(2.0) and row.cost_reduction_pct == pytest.approx(75.0)


def test_all_gates_report_in_order(telemetry, registry, pricing):
    df = telemetry(telemetry_rows("a", [80.0] * 10, memory=80.0))
    (row,) = run(df, registry(a="medium"), pricing.where("instance_type = 'none'"))
    assert row.reason_codes == [D.LATENCY_SLO, D.AVAILABILITY_SLO, D.CPU_LIMIT, D.MEMORY_LIMIT]
    assert row.reasons[0] == "Projected P95 latency = 3750.00 ms (Target violated)"
    assert row.reasons[1] == "Projected availability = 67.50% (Target violated)"


def test_limits_are_strict_and_targets_inclusive(telemetry, registry, pricing):
    df = telemetry(telemetry_rows("a", [45.0] * 10))
    variants = (Variant("at", latency_target=55.0 + 15.0**1.5), Variant("below", latency_target=55.0, max_cpu=89.5))
    at, below = run(df, registry(a="medium"), pricing, variants=variants)
    assert at.peak_cpu == 90.0 and at.decision == S.SAFE
    assert below.reason_codes == [D.LATENCY_SLO, D.CPU_LIMIT]
    assert below.reasons[1].endswith("exceeds safe limit (89.5%)")


def test_missing_price_passes_unless_a_price_is_required(telemetry, registry, pricing):
    df, only_small = telemetry(telemetry_rows("a", [5.0] * 10)), pricing.where("instance_type = 'small'")
    (row,) = run(df, registry(a="medium"), only_small)
    assert row.decision == S.SAFE and row.absolute_monthly_saving is None and row.cost_reduction_pct == 0.0
    (strict,) = run(df, registry(a="medium"), only_small, require_price=True)
    assert strict.decision == S.UNSAFE and strict.reason_codes == [D.NO_PRICE]


def test_missing_readings_look_healthy_unless_completeness_is_required(telemetry, registry, pricing):
    df = telemetry(telemetry_rows("a", [None] * 10))
    (row,) = run(df, registry(a="medium"), pricing)
    assert row.decision == S.SAFE and row.peak_cpu is None
    (strict,) = run(df, registry(a="medium"), pricing, require_complete=True)
    assert strict.decision == S.UNSAFE and strict.incomplete_rows == 10


def test_no_telemetry_is_insufficient(telemetry, registry, pricing):
    envs = registry(a="medium", b="medium")
    result = whatif.what_if(telemetry(telemetry_rows("a", [5.0] * 10)), envs, pricing, CATALOG, "step_down")
    kept = whatif.keep_all_moves(whatif.fleet_moves(envs, CATALOG, "step_down"), result)
    rows = {r.environment_id: r for r in whatif.decide(kept, texts=True).collect()}
    assert rows["a"].decision == S.SAFE and rows["b"].decision == S.INSUFFICIENT
    assert rows["b"].reasons == ["No telemetry available for simulation."]


def test_low_quality_is_insufficient(telemetry, registry, pricing):
    result = whatif.what_if(telemetry(telemetry_rows("a", [5.0] * 10)), registry(a="medium"), pricing, CATALOG, "step_down")
    (row,) = whatif.decide(result, F.lit("LOW"), texts=True).collect()
    assert row.decision == S.INSUFFICIENT and row.reason_codes == [D.LOW_QUALITY]


def test_current_to_itself_saves_nothing(telemetry, registry, pricing):
    (row,) = run(telemetry(telemetry_rows("a", [5.0] * 10)), registry(a="medium"), pricing, "self")
    assert row.absolute_monthly_saving == 0.0 and row.reason_codes == [D.NO_COST_BENEFIT]


def test_hours_may_be_given(telemetry, registry, pricing):
    (row,) = run(telemetry(telemetry_rows("a", [5.0] * 10)), registry(a="medium"), pricing, hours=730)
    assert row.baseline_monthly_cost == pytest.approx(73.0)


def test_pressures_scale_peaks_linearly(telemetry, registry, pricing):
    df = telemetry(telemetry_rows("a", [10.0, 30.0, 20.0]))
    variants = (Variant("base"), Variant("more", traffic_growth=0.2, cpu_pressure=0.5))
    base, more = run(df, registry(a="large"), pricing, variants=variants)
    assert more.peak_cpu == pytest.approx(base.peak_cpu * 1.2 * 1.5)
    assert more.peak_mem == pytest.approx(base.peak_mem * 1.2)


def test_large_environments_give_the_same_result(telemetry, registry, pricing):
    df = telemetry(*[telemetry_rows(e, [float((i * 7) % 50) for i in range(60)]) for e in ("a", "b")])
    envs, variants = registry(a="medium", b="large"), (Variant("x"), Variant("y", traffic_growth=0.3))
    usual = run(df, envs, pricing, "cheaper", variants)
    split = run(df, envs, pricing, "cheaper", variants, large=LargeGroups("environment_id", ids=("a",)))
    key = lambda r: (r.environment_id, r.candidate_instance_type, r.variant_id)
    for x, y in zip(sorted(usual, key=key), sorted(split, key=key), strict=True):
        assert x.decision == y.decision and x.row_count == y.row_count
        assert x.projected_p95_latency == pytest.approx(y.projected_p95_latency)


def test_cost_defaults_to_a_month(spark, pricing):
    rows = spark.createDataFrame([("large", "small")], "current_instance_type string, candidate_instance_type string")
    (row,) = cost.compare(rows, pricing, CATALOG).collect()
    assert row.baseline_monthly_cost == pytest.approx(146.0) and row.absolute_monthly_saving == pytest.approx(109.5)
