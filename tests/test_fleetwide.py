"""Candidates, sensitivity, portfolio, views and scenarios."""

import json

import pytest
from conftest import telemetry_rows
from pyspark.sql import functions as F

from fleetfit import schemas as S
from fleetfit.catalog import DEFAULT_CATALOG as CATALOG
from fleetfit.catalog import InstanceCatalog, InstanceType
from fleetfit.operators import candidates, portfolio, scenarios, sensitivity, views, whatif
from fleetfit.operators.projection import Variant, project_rows
from fleetfit.operators.whatif import MOVE

SPIKY = [15.0] * 98 + [95.0] * 2


@pytest.fixture(scope="module")
def fleet(telemetry, registry):
    """Calm large, spiky medium, calm small, a large that only fits one step down, one without telemetry."""
    df = telemetry(
        telemetry_rows("a", [5.0] * 20, memory=10.0),
        telemetry_rows("b", SPIKY),
        telemetry_rows("c", [5.0] * 20),
        telemetry_rows("d", [40.0] * 20),
    )
    return df, registry(a="large", b="medium", c="small", d="large", e="medium")


def decided(fleet, pricing, policy, variants=(Variant(),), **options):
    df, envs = fleet
    return whatif.decide(whatif.what_if(df, envs, pricing, CATALOG, policy, variants, **options), texts=True)


def test_best_candidate_has_the_most_headroom(fleet, pricing):
    rows = {r.environment_id: r for r in candidates.best_candidate(decided(fleet, pricing, "cheaper"), CATALOG).collect()}
    assert {e: r.candidate_instance_type for e, r in rows.items()} == {"a": "medium", "d": "medium"}
    assert rows["a"].headroom == 80.0 and rows["d"].headroom == 20.0


def test_ties_go_to_the_first_type_of_the_catalog(telemetry, registry, spark):
    catalog = InstanceCatalog((InstanceType("big", 4, 16, 0.4), InstanceType("second", 2, 8, 0.2), InstanceType("first", 2, 8, 0.1)))
    prices = spark.createDataFrame([("big", 0.4), ("second", 0.2), ("first", 0.1)], "instance_type string, hourly_price double")
    df = telemetry(telemetry_rows("a", [5.0] * 10))
    result = whatif.decide(whatif.what_if(df, registry(a="big"), prices, catalog, "cheaper"))
    assert candidates.best_candidate(result, catalog).first().candidate_instance_type == "second"


def test_environments_without_an_option(fleet, pricing):
    best = candidates.best_candidate(decided(fleet, pricing, "cheaper"), CATALOG)
    rows = {r.environment_id: r.decision for r in candidates.selection(fleet[1], best).collect()}
    assert rows == {"a": S.SAFE, "b": S.NO_OPTION, "c": S.NO_OPTION, "d": S.SAFE, "e": S.NO_OPTION}


def test_naive_rule_and_gate_disagree_on_spikes(fleet, pricing):
    df, envs = fleet
    naive = whatif.naive_step_down(df, envs, CATALOG)
    rows = {r.environment_id: r for r in naive.collect()}
    assert rows["b"].recommended == "small" and rows["a"].recommended == "medium"
    assert rows["c"].recommended is None and rows["d"].recommended is None
    assert rows["e"].recommended is None and rows["e"].mean_cpu == 0.0
    stopped = candidates.prevented_by_gate(naive, decided(fleet, pricing, "step_down")).collect()
    assert [r.environment_id for r in stopped] == ["b"]


def test_growth_sweep_and_flip(fleet, pricing):
    swept = decided(fleet, pricing, "step_down", sensitivity.growth_variants())
    assert swept.count() == 3 * 5
    flips = {r.environment_id: r for r in sensitivity.flip_point(swept).collect()}
    assert set(flips) == {"a", "d"}  # b is unsafe from the start
    assert flips["a"].flip_growth is None and flips["a"].highest_safe_growth == 0.4
    assert flips["d"].flip_growth == 0.2 and flips["d"].binding_constraint == "AVAILABILITY_SLO_FAILURE"
    assert flips["d"].flip_peak_cpu == pytest.approx(96.0) and flips["d"].highest_safe_growth == 0.1


def test_zero_growth_is_the_base_case(fleet, pricing):
    swept = decided(fleet, pricing, "step_down", sensitivity.growth_variants()).where("traffic_growth = 0")
    base = decided(fleet, pricing, "step_down")
    columns = [*MOVE, "decision", "projected_p95_latency", "peak_cpu", "absolute_monthly_saving"]
    assert swept.select(columns).exceptAll(base.select(columns)).count() == 0


def test_variations_may_replace_targets(fleet, pricing):
    items = ({"traffic_growth": 0.1}, {"latency_target": 10.0})
    rows = decided(fleet, pricing, "step_down", sensitivity.variations(items)).where("environment_id = 'a'").collect()
    assert {r.variant_id: r.decision for r in rows} == {"variation_0": S.SAFE, "variation_1": S.UNSAFE}


def test_portfolio(fleet, pricing):
    df, envs = fleet
    detail = portfolio.detail(df, envs, pricing, CATALOG)
    rows = {r.environment_id: r for r in detail.collect()}
    assert rows["a"].selected_candidate == "medium" and rows["a"].risk == "LOW"
    assert rows["d"].risk == "HIGH" and rows["d"].potential_saving == pytest.approx(2.0)
    assert rows["b"].selected_candidate is None and rows["b"].candidate_cost == pytest.approx(10.0)
    assert rows["b"].unsafe_saving == pytest.approx(5.0) and rows["b"].risk == "UNKNOWN"
    assert rows["c"].current_monthly_cost == pytest.approx(1.0) and rows["e"].current_monthly_cost == 0.0
    total = portfolio.summary(detail).first()
    assert (total.total_environments, total.safe_environments, total.blocked_environments) == (5, 2, 3)
    assert total.current_monthly_cost == pytest.approx(4 + 10 + 1 + 4)
    assert total.potential_monthly_savings == pytest.approx(4.0) and total.potential_annual_savings == pytest.approx(48.0)
    assert total.blocked_potential_savings == 0.0
    blocked = {r.current_instance_type: r for r in portfolio.blocked_savings(detail).collect()}
    assert blocked["medium"].blocked_environments == 2 and blocked["medium"].unsafe_savings == pytest.approx(5.0)
    assert views.finops_view(portfolio.summary(detail)).first().portfolio_health == "2 Safe"


def test_ranked_moves(fleet, pricing):
    steps = portfolio.step_down_rows(decided(fleet, pricing, "step_down"))
    ranked = {(r.outcome, r["rank"]): r.environment_id for r in portfolio.ranked(steps, fleet[1]).collect()}
    assert ranked == {("SAFE", 1): "a", ("SAFE", 2): "d", ("BLOCKED", 1): "b"}
    assert [r.environment_id for r in portfolio.top_safe(steps, fleet[1], 1).collect()] == ["a"]
    m = portfolio.metrics(steps, whatif.naive_step_down(*fleet, CATALOG)).first()
    assert (m.evaluated, m.safe, m.blocked, m.naive_recommended, m.naive_blocked) == (3, 2, 1, 2, 1)
    assert m.prevention_rate_pct == 50.0


def test_tradeoff(fleet, pricing):
    result = decided(fleet, pricing, "cheaper_and_self")
    (row,) = views.tradeoff(result).where("environment_id = 'd' and candidate_instance_type = 'medium'").collect()
    assert row.cost_delta == pytest.approx(-2.0) and row.cpu_delta == pytest.approx(40.0)
    assert row.memory_delta == pytest.approx(20.0) and row.resource_headroom == pytest.approx(20.0)


def test_explanations(fleet, pricing):
    rows = {r.environment_id: r for r in views.explain(decided(fleet, pricing, "step_down")).collect()}
    safe, blocked = json.loads(rows["a"].explanation), json.loads(rows["b"].explanation)
    assert safe["decision"] == "SAFE" and safe["passed_checks"] == views.PASSED_CHECKS and safe["cpu_projection"] == 10.0
    assert blocked["decision"] == "BLOCKED" and blocked["projected_cpu"] == 190.0
    assert any("peak CPU" in r for r in blocked["exact_reason"])


def test_stakeholder_views(fleet, pricing, spark):
    moves = decided(fleet, pricing, "step_down")
    owners = {r.environment_id: r.operational_risk for r in views.owner_view(moves).collect()}
    assert owners == {"a": "LOW", "b": "HIGH", "d": "LOW"}
    health = {r.environment_id: r.health for r in views.infrastructure_view(moves).collect()}
    assert health == {"a": "HEALTHY", "b": "N/A", "d": "HEALTHY"}
    verdicts = spark.createDataFrame([("a", "STABLE")], "environment_id string, verdict string")
    judged = {r.environment_id: r.health for r in views.infrastructure_view(moves, verdicts).collect()}
    assert judged == {"a": "STABLE", "b": "N/A", "d": "N/A"}


def test_five_numbers(fleet):
    df, envs = fleet
    rows = project_rows(df, envs, CATALOG, "step_down", keep=("cpu_utilization_pct",))
    got = {(r.environment_id, r.series): (r.low, r.middle, r.high) for r in views.five_numbers(rows).collect()}
    assert got[("b", "Baseline CPU")] == (15.0, 15.0, 95.0) and got[("b", "Projected CPU")] == (30.0, 30.0, 190.0)


def test_trend_of_one_environment(fleet):
    rows = views.trend(fleet[0], "a").collect()
    assert len(rows) == 20 and [r.timestamp for r in rows] == sorted(r.timestamp for r in rows)


def test_scenarios(telemetry, registry):
    df = telemetry(
        telemetry_rows("a", [5.0] * 10),
        telemetry_rows("b", [5.0] * 10, requests=[0.0, 900.0] * 5),
        telemetry_rows("c", [5.0] * 10, requests=[0.0, 140.0] * 5),
    )
    classes = scenarios.classify(df)
    assert {r.environment_id: r.scenario_class for r in classes.collect()} == {"a": "normal", "b": "bursty", "c": None}
    picked = scenarios.pick(registry(c="small", a="medium", b="medium"), classes)
    got = {r.scenario: (r.environment_id, r.matched) for r in picked.collect()}
    assert got == {"normal": ("a", True), "bursty": ("b", True), "peak": ("c", False)}


def test_headroom_needs_a_known_cpu_peak(spark):
    rows = spark.createDataFrame([(None, 10.0), (20.0, None), (20.0, 30.0)], "peak_cpu double, peak_mem double")
    got = [r.headroom for r in candidates.with_headroom(rows.withColumn("decision", F.lit(S.SAFE))).collect()]
    assert got == [None, 80.0, 70.0]
