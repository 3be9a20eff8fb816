"""Boundaries of the row functions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fleetfit import schemas as S
from fleetfit.functions import labels, performance
from fleetfit.functions.common import fixed, nan_to_null, r6


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


@pytest.mark.parametrize(
    "load, penalty",
    [
        (0.0, 0.0),
        (37.5, 2.5),
        (75.0, 5.0),
        (76.0, 6.0),
        (99.0, 5 + 24**1.5),
        (100.0, 100.0),
        (110.0, 200.0),
        (None, 0.0),
    ],
)
def test_latency_penalty(spark, load, penalty):
    (got,) = values(spark, performance.latency_penalty(F.col("x")), [(load,)], "x double")
    assert got == pytest.approx(penalty)


def test_latency_drops_where_saturation_starts(spark):
    below, at = values(spark, performance.projected_latency(F.col("x")), [(99.999999,), (100.0,)], "x double")
    assert below > 179 and at == 150.0


@pytest.mark.parametrize("load, available", [(95.0, 100.0), (97.0, 99.0), (295.0, 0.0), (500.0, 0.0), (None, 100.0)])
def test_availability(spark, load, available):
    assert values(spark, performance.projected_availability(F.col("x")), [(load,)], "x double") == [available]


def test_pressure_is_unknown_with_one_side_missing(spark):
    rows = [(80.0, 60.0), (None, 80.0), (80.0, None)]
    got = values(spark, performance.pressure(F.col("c"), F.col("m")), rows, "c double, m double")
    assert got == [80.0, None, None]


def test_nan_becomes_null(spark):
    assert values(spark, nan_to_null(F.col("x")), [(math.nan,), (1.0,)], "x double") == [None, 1.0]


def test_rounding_folds_negative_zero(spark):
    (got,) = values(spark, r6("x"), [(-1e-9,)], "x double")
    assert math.copysign(1, got) == 1.0


@pytest.mark.parametrize(
    "cpu, latency_ok, available_ok, risk",
    [
        (50.0, True, True, "LOW"),
        (60.0, True, True, "LOW"),
        (61.0, True, True, "MEDIUM"),
        (81.0, True, True, "HIGH"),
        (91.0, True, True, "CRITICAL"),
        (50.0, False, True, "CRITICAL"),
        (50.0, True, False, "CRITICAL"),
        (None, None, None, "UNKNOWN"),
    ],
)
def test_migration_risk(spark, cpu, latency_ok, available_ok, risk):
    col = labels.migration_risk(F.col("c"), F.col("l"), F.col("a"))
    assert values(spark, col, [(cpu, latency_ok, available_ok)], "c double, l boolean, a boolean") == [risk]


@pytest.mark.parametrize("cpu, risk", [(59.9, "LOW"), (60.0, "MEDIUM"), (79.9, "MEDIUM"), (80.0, "HIGH")])
def test_portfolio_risk(spark, cpu, risk):
    col = labels.portfolio_risk(F.col("c"), F.lit("small"))
    assert values(spark, col, [(cpu,)], "c double") == [risk]


@pytest.mark.parametrize(
    "reading, status",
    [
        ((50.0, 50.0, 100.0, 100.0), "STABLE"),
        ((91.0, 50.0, 100.0, 100.0), "ROLLBACK_REQUIRED"),
        ((50.0, 90.1, 100.0, 100.0), "ROLLBACK_REQUIRED"),
        ((50.0, 50.0, 251.0, 100.0), "DEGRADED"),
        ((50.0, 50.0, 250.0, 99.8), "DEGRADED"),
        ((80.0, 50.0, 250.0, 99.9), "STABLE"),
        ((80.1, 50.0, 100.0, 100.0), "DEGRADED"),
    ],
)
def test_health(spark, reading, status):
    col = labels.health(*[F.col(c) for c in ("c", "m", "l", "a")])
    assert values(spark, col, [reading], "c double, m double, l double, a double") == [status]


@pytest.mark.parametrize(
    "predicted, observed, absolute, percent",
    [(50.0, 55.0, 5.0, 5 / 55 * 100), (10.0, 0.0, 10.0, 100.0), (0.0, 0.0, 0.0, 0.0)],
)
def test_accuracy(spark, predicted, observed, absolute, percent):
    p, o = F.col("p"), F.col("o")
    col = F.struct(labels.absolute_error(p, o).alias("a"), labels.percentage_error(p, o).alias("b"))
    (got,) = values(spark, col, [(predicted, observed)], "p double, o double")
    assert (got.a, got.b) == (pytest.approx(absolute), pytest.approx(percent))


def test_operational_risk(spark):
    got = values(spark, labels.operational_risk(F.col("d")), [(S.SAFE,), (S.UNSAFE,)], "d string")
    assert got == ["LOW", "HIGH"]


def test_fixed_digits_round_the_binary_value(spark):
    rng = random.Random(4)
    hard = [97.25, 97.35, 0.35, 2.675, 0.125, 0.375, 99.995, 1.005, 8191.995, 8192.125, 150.0, 12345.675, 9.999, -2.5, -0.001, 3e9]
    hard += [rng.randrange(0, 400000) / 1000 for _ in range(300)] + [rng.uniform(4, 20000) for _ in range(300)]
    rows = spark.createDataFrame([(x,) for x in hard], "x double")
    got = rows.select("x", fixed(F.col("x"), 1).alias("one"), fixed(F.col("x"), 2).alias("two")).collect()
    assert not [r for r in got if (r.one, r.two) != (f"{r.x:.1f}", f"{r.x:.2f}")]
    assert spark.range(1).select(fixed(F.lit(None).cast("double"), 1)).first()[0] is None
