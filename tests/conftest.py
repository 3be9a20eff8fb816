from __future__ import annotations

import os
import sys
from datetime import datetime, timedelta

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fleetfit import session  # noqa: E402
from fleetfit.schemas import TELEMETRY  # noqa: E402

START = datetime(2024, 1, 1)
TESTDATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield session.tune(spark)
    spark.stop()


def telemetry_rows(env, cpu, memory=20.0, latency=50.0, requests=100.0, availability=100.0, start=START):
    """Hourly rows; each metric is a number or a list as long as ``cpu``."""
    cpu = cpu if isinstance(cpu, list) else [cpu] * 20
    wide = [m if isinstance(m, list) else [m] * len(cpu) for m in (memory, latency, requests, availability)]
    memory, latency, requests, availability = wide
    return [
        (start + timedelta(hours=i), env, *map(lambda v: None if v is None else float(v), values))
        for i, values in enumerate(zip(cpu, memory, latency, requests, availability))
    ]


@pytest.fixture(scope="session")
def telemetry(spark):
    def make(*groups):
        return spark.createDataFrame([r for g in groups for r in g], TELEMETRY)

    return make


@pytest.fixture(scope="session")
def registry(spark):
    def make(**types):
        rows = [(e.replace("_", "-"), t, f"svc-{e}", "RUNNING", i) for i, (e, t) in enumerate(types.items())]
        return spark.createDataFrame(
            rows, "environment_id string, current_instance_type string, service_name string, status string, seq long"
        )

    return make


@pytest.fixture(scope="session")
def pricing(spark):
    return spark.createDataFrame(
        [("small", 0.05), ("medium", 0.10), ("large", 0.20)], "instance_type string, hourly_price double"
    )
