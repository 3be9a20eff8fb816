"""Table schemas and the thresholds of the model."""

from __future__ import annotations

from pyspark.sql import types as T

KEYS = ["timestamp", "environment_id"]
METRICS = [
    "cpu_utilization_pct",
    "memory_utilization_pct",
    "latency_ms",
    "request_volume",
    "availability_pct",
]
TELEMETRY_COLUMNS = KEYS + METRICS

TELEMETRY = T.StructType(
    [T.StructField("timestamp", T.TimestampNTZType()), T.StructField("environment_id", T.StringType())]
    + [T.StructField(m, T.DoubleType()) for m in METRICS]
)
ENVIRONMENTS = T.StructType(
    [
        T.StructField("environment_id", T.StringType()),
        T.StructField("service_name", T.StringType()),
        T.StructField("current_instance_type", T.StringType()),
        T.StructField("vcpu", T.IntegerType()),
        T.StructField("memory_gb", T.IntegerType()),
    ]
)
PRICING = T.StructType(
    [
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("instance_type", T.StringType()),
        T.StructField("hourly_price", T.DoubleType()),
    ]
)
AUDIT = T.StructType(
    [
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("environment_id", T.StringType()),
        T.StructField("current_instance", T.StringType()),
        T.StructField("candidate_instance", T.StringType()),
        T.StructField("event", T.StringType()),
        T.StructField("reason", T.StringType()),
    ]
)

# History table name -> its one metric column (fixed values).
HISTORIES = {
    "cpu_history": "cpu_utilization_pct",
    "memory_history": "memory_utilization_pct",
    "latency_history": "latency_ms",
    "request_history": "request_volume",
    "availability_history": "availability_pct",
}


def history_schema(metric: str) -> T.StructType:
    return T.StructType(
        [
            T.StructField("timestamp", T.TimestampNTZType()),
            T.StructField("environment_id", T.StringType()),
            T.StructField(metric, T.DoubleType()),
        ]
    )


# Model limits (fixed values).
UTILIZATION_CEILING = 150.0
AVAILABILITY_CEILING = 100.0
MIN_CLEAN_ROWS = 10
HIGH_QUALITY_ROWS = 500
AVAILABILITY_SLO = 99.9
LATENCY_SLO_MS = 250.0
MAX_SAFE_UTILIZATION = 90.0
BASE_LATENCY_MS = 50.0
COMFORT_PRESSURE = 75.0
AVAILABILITY_PRESSURE = 95.0
SATURATION_PRESSURE = 100.0
HOURS_PER_MONTH = 730
NAIVE_CPU_LIMIT = 30.0

# Decision labels (fixed values).
SAFE = "SAFE TO RIGHTSIZE"
UNSAFE = "DO NOT RIGHTSIZE"
INSUFFICIENT = "INSUFFICIENT DATA"
NO_OPTION = "NO SAFE RIGHTSIZING OPTION"
