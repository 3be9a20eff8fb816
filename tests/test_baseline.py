import numpy as np
from conftest import telemetry_rows
from pyspark.sql import functions as F

from fleetfit.operators.baseline import baseline


def test_ramp(spark, telemetry):
    cpu = list(np.linspace(10, 90, 100))
    df = telemetry(
        telemetry_rows(
            "a",
            cpu,
            memory=list(np.linspace(20, 80, 100)),
            requests=list(np.linspace(100, 1000, 100)),
            latency=list(np.linspace(50, 150, 100)),
            availability=[100.0] * 95 + [99.0] * 5,
        )
    )
    (row,) = baseline(df).collect()
    assert row.peak_cpu == 90 and row.slo_violations == 5
    assert np.isclose(row.mean_latency, 100) and np.isclose(row.measured_availability, 99.95)
    assert np.isclose(row.p95_cpu, np.percentile(cpu, 95)) and np.isclose(row.median_cpu, np.median(cpu))
    assert np.isclose(row.p99_latency, np.percentile(np.linspace(50, 150, 100), 99))


def test_nulls_are_skipped_and_unknown_environments_have_no_row(spark, telemetry):
    df = telemetry(telemetry_rows("a", [10.0, None, 30.0]))
    (row,) = baseline(df).collect()
    assert row.mean_cpu == 20 and row.median_cpu == 20
    assert baseline(df.where(F.col("environment_id") == "b")).count() == 0


def test_families_limit_the_columns(spark, telemetry):
    df = telemetry(telemetry_rows("a", [10.0]))
    assert baseline(df, ["memory"]).columns == ["environment_id", "mean_memory", "peak_memory", "p95_memory"]


def test_approximate_percentiles_are_close(spark, telemetry):
    df = telemetry(telemetry_rows("a", [float(x) for x in range(1000)]))
    exact, approx = baseline(df).first(), baseline(df, approx=True).first()
    assert abs(exact.p95_cpu - approx.p95_cpu) <= 1.0
