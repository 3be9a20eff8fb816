"""The model's input tables as views over the given test tables.

The integer conditions below plant the defects validation has to find. Every row of a table is used;
each of the five histories has gaps, but every reading is in one of them at least.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

INGEST_ORDER = ["l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey"]

# Per history: readings whose order key leaves 2 by this number are absent, unless it does so by all.
HISTORY_GAPS = {
    "cpu_history": 11,
    "memory_history": 13,
    "latency_history": 17,
    "request_history": 19,
    "availability_history": 23,
}


def in_history(gap: int) -> Column:
    key, all_gaps = F.col("l_orderkey"), math.prod(HISTORY_GAPS.values())
    return (key % gap != 2) | (key % all_gaps == 2)


BASE_PRICES = {"small": 0.05, "medium": 0.10, "large": 0.20}


# Declared, so that no job has to read file footers before planning.
SCHEMAS = {
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "lineitem": (
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
        "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "orders": (
        "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
        "o_orderpriority string"
    ),
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def environment_id(key: Column) -> Column:
    digits = key.cast("string")
    return F.concat(F.lit("env-"), F.lpad(digits, F.greatest(F.length(digits), F.lit(6)), F.lit("0")))


def type_by_remainder(key: Column) -> Column:
    return F.when(key % 3 == 0, "small").when(key % 3 == 1, "medium").otherwise("large")


def environments(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        environment_id(key).alias("environment_id"),
        F.col("s_name").alias("service_name"),
        type_by_remainder(key).alias("current_instance_type"),
        F.when(key % 10 == 9, "STOPPED").otherwise("RUNNING").alias("status"),
        key.alias("seq"),
    )


def telemetry_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unvalidated telemetry with the columns of its input order."""
    return telemetry_of(table(spark, sf_dir, "lineitem"))


def telemetry_of(lineitem: DataFrame) -> DataFrame:
    o, s = F.col("l_orderkey"), F.col("l_suppkey")
    null = F.lit(None).cast("double")
    volume = F.when(s % 4 == 0, 2.0).when(s % 4 == 1, 5.0).when(s % 4 == 2, 10.0).otherwise(12.0)
    return lineitem.select(
        F.col("l_shipdate").alias("timestamp"),
        F.when(o % 67 == 1, "env-unknown").otherwise(environment_id(s)).alias("environment_id"),
        F.when(o % 89 == 1, null)
        .when(o % 83 == 1, 200.0)
        .otherwise((s % 7) * 8 + F.col("l_discount") * 100)
        .alias("cpu_utilization_pct"),
        F.when(o % 79 == 1, -1.0).otherwise(10 + (s % 5) * 8 + F.col("l_tax") * 100).alias("memory_utilization_pct"),
        F.when(o % 73 == 1, -1.0).otherwise(50 + F.col("l_tax") * 100).alias("latency_ms"),
        F.when(o % 97 == 1, -5.0)
        .when(o % 61 == 1, 0.0)
        .otherwise(F.col("l_quantity") * volume)
        .alias("request_volume"),
        F.when(o % 71 == 1, 101.0)
        .when((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 49), 100 - F.col("l_discount") * 10)
        .otherwise(100.0)
        .alias("availability_pct"),
        *INGEST_ORDER,
    )


def pricing(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    base = F.when(key % 3 == 0, BASE_PRICES["small"]).when(key % 3 == 1, BASE_PRICES["medium"]).otherwise(BASE_PRICES["large"])
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderdate").alias("timestamp"),
        type_by_remainder(key).alias("instance_type"),
        (base * (0.98 + 0.01 * (key % 5))).alias("hourly_price"),
    )


def _prop(events: DataFrame) -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Post-migration readings, numbered by ``reading_id``."""
    return readings_of(table(spark, sf_dir, "events"))


def readings_of(events: DataFrame) -> DataFrame:
    k = _prop(events)
    return events.select(
        environment_id(F.col("user_id")).alias("environment_id"),
        "ts",
        F.col("event_id").alias("reading_id"),
        k.cast("double").alias("cpu"),
        (20 + k / 2).alias("memory"),
        F.col("value").alias("latency"),
        F.when((F.col("event_type") == "error") & (F.col("value") > 100), 99.0).otherwise(100.0).alias("availability"),
    )


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_of(table(spark, sf_dir, "events"))


def audit_of(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    event = (
        F.when(kind == "click", "PRECHECK_STARTED")
        .when(kind == "signup", "MIGRATION_APPROVED")
        .when(kind == "view", "MIGRATION_EXECUTED")
        .when(kind == "purchase", "POSTCHECK_PASSED")
        .when((kind == "error") & (_prop(events) >= 50), "ORIGINAL_CONFIGURATION_RESTORED")
        .when(kind == "error", "FAILURE_DETECTED")
    )
    return events.select(
        F.col("ts").alias("timestamp"),
        F.col("event_id").alias("seq"),
        environment_id(F.col("user_id")).alias("environment_id"),
        F.lit("medium").alias("current_instance"),
        F.lit("small").alias("candidate_instance"),
        event.alias("event"),
        F.col("props").alias("reason"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One migration request per user of the event table."""
    return requests_of(table(spark, sf_dir, "events").select("user_id").distinct())


def requests_of(events: DataFrame, timed: bool = False) -> DataFrame:
    """Each event's user asks for a migration, at the event's time; the same user asks for the same."""
    user = F.col("user_id")
    return events.select(
        environment_id(user).alias("environment_id"),
        F.when(user % 10 == 7, "large").otherwise(type_by_remainder(user)).alias("expected_current"),
        F.when(user.isNotNull(), "small").alias("candidate_instance_type"),
        *([F.col("ts").alias("requested_at")] if timed else []),
    )
