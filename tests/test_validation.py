"""Ordered validation rules on hand-made frames."""

import math
from datetime import datetime

import pytest
from conftest import telemetry_rows
from pyspark.sql import functions as F

from fleetfit.operators import validation as V
from fleetfit.schemas import TELEMETRY


def frame(spark, rows):
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in TELEMETRY.fields) + ", nth long"
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema)


def report(spark, rows, environments=None):
    return {r.rule: r.removed_rows for r in V.issue_report(frame(spark, rows), ["nth"], environments).collect()}


def test_rules_see_the_survivors_of_earlier_rules(spark, registry):
    rows = telemetry_rows("a", [10.0] * 12)
    t = rows[0][0]
    rows[1] = (rows[1][0], "a", None, -1.0, 50.0, 1.0, 100.0)  # missing before memory
    rows[2] = (rows[2][0], "a", 151.0, -1.0, 50.0, 1.0, 100.0)  # cpu before memory
    rows[3] = (rows[3][0], "a", 150.0, 150.1, 50.0, 1.0, 100.0)  # 150 is still valid
    rows[4] = (rows[4][0], "a", 10.0, 10.0, -1.0, -1.0, 100.0)  # requests before latency
    rows[5] = (rows[5][0], "a", 10.0, 10.0, -1.0, 0.0, 100.0)
    rows[6] = (rows[6][0], "a", 10.0, 10.0, 1.0, 0.0, 100.1)
    rows += [(t, "a", 500.0, 1.0, 1.0, 1.0, 1.0), (t, "stranger", 10.0, 10.0, 1.0, 1.0, 100.0)]
    assert report(spark, rows, registry(a="small")) == {
        "duplicate": 1,
        "missing": 1,
        "cpu": 1,
        "memory": 1,
        "requests": 1,
        "latency": 1,
        "availability": 1,
        "unknown_environment": 1,
    }


def test_report_leaves_out_rules_without_effect_and_words_the_rest(spark):
    rows = telemetry_rows("a", [10.0] * 12) + telemetry_rows("a", [20.0] * 3)
    lines = V.issue_report(frame(spark, rows), ["nth"]).collect()
    assert [(r.rule, r.message) for r in lines] == [("duplicate", "Removed 3 duplicate records.")]


def test_first_row_in_input_order_is_kept(spark):
    rows = telemetry_rows("a", [10.0, 20.0]) + telemetry_rows("a", [99.0, 1.0])
    clean = V.clean(frame(spark, rows), ["nth"])
    assert sorted(r.cpu_utilization_pct for r in clean.collect()) == [10.0, 20.0]
    assert "nth" not in clean.columns


def test_an_invalid_first_row_is_not_replaced_by_its_copy(spark):
    rows = telemetry_rows("a", [None, 20.0]) + telemetry_rows("a", [50.0])
    assert V.clean(frame(spark, rows), ["nth"]).count() == 1


def test_keep_first_needs_an_order(spark):
    with pytest.raises(ValueError):
        V.keep_first(frame(spark, telemetry_rows("a", [1.0])), [])


def test_nan_and_extra_columns_count_as_missing(spark):
    rows = telemetry_rows("a", [10.0, math.nan, 10.0])
    df = frame(spark, rows).withColumn("extra", F.when(F.col("nth") != 2, 1))
    assert V.clean(df, ["nth"]).count() == 1


def test_all_invalid_is_invalid(spark):
    (row,) = V.status(frame(spark, telemetry_rows("a", [-10.0] * 20)), ["nth"]).collect()
    assert (row.status, row.clean_rows, row.issue) == ("INVALID", 0, V.NO_ROWS)


def test_empty_input_is_invalid(spark):
    (row,) = V.status(frame(spark, []), ["nth"]).collect()
    assert (row.status, row.input_rows) == ("INVALID", 0)


@pytest.mark.parametrize(
    "cpu, status, grade",
    [
        ([10.0] * 9, "INVALID", "LOW"),
        ([10.0] * 10, "VALID", "MEDIUM"),
        ([10.0] * 500, "VALID", "MEDIUM"),
        ([10.0] * 501, "VALID", "HIGH"),
        ([10.0] * 501 + [None], "WARNING", "MEDIUM"),
    ],
)
def test_status_and_grade(spark, cpu, status, grade):
    df = frame(spark, telemetry_rows("a", cpu))
    assert V.status(df, ["nth"]).first().status == status
    assert V.quality_grade(df, ["nth"]).first().quality == grade


def test_grade_ignores_the_registry(spark, registry):
    df = frame(spark, telemetry_rows("stranger", [10.0] * 501))
    assert V.quality_grade(df, ["nth"]).first().quality == "HIGH"
    assert V.status(df, ["nth"], registry(a="small")).first().status == "INVALID"


def test_missing_column(spark):
    df = frame(spark, telemetry_rows("a", [10.0])).drop("latency_ms")
    status, issues, rows = V.schema_check(df)
    assert status == "INVALID" and "latency_ms" in issues[0] and rows.count() == 0
    with pytest.raises(V.MissingColumns):
        V.clean(df, ["nth"])


def test_unreadable_timestamps(spark):
    rows = [("2024-01-01 00:00:00", "a"), ("2024-01-01T01:00:00Z", "a"), ("nonsense", "b"), (None, "b")]
    df = spark.createDataFrame(rows, "timestamp string, environment_id string")
    assert V.timestamp_check(df).first().status == "INVALID"
    by = {r.environment_id: (r.bad_timestamps, r.status) for r in V.timestamp_check(df, by="environment_id").collect()}
    assert by == {"a": (0, "VALID"), "b": (1, "INVALID")}
    parsed = [r.timestamp for r in V.parse_timestamps(df).where("environment_id = 'a'").orderBy("timestamp").collect()]
    assert parsed == [datetime(2024, 1, 1), datetime(2024, 1, 1, 1)]


def test_unknown_environments_are_the_complement(spark, registry):
    df = frame(spark, telemetry_rows("a", [10.0] * 3) + telemetry_rows("b", [10.0] * 2))
    envs = registry(a="small")
    assert V.known_environments(df, envs).count() == 3
    assert V.unknown_environments(df, envs).count() == 2


def test_tagged_and_clean_agree(spark, registry):
    rows = telemetry_rows("a", [10.0, None, 500.0, 20.0]) + telemetry_rows("a", [1.0]) + telemetry_rows("x", [1.0])
    df, envs = frame(spark, rows), registry(a="small")
    tagged = V.tagged(df, ["nth"], envs)
    assert tagged.where("failed_rule is null").count() == V.clean(df, ["nth"], envs).count() == 2
    assert tagged.agg(F.sum("copies")).first()[0] == len(rows)
