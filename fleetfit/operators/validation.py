"""Telemetry validation: ordered rules, clean rows, report, status and grade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fleetfit import schemas as S
from fleetfit.functions.common import nan_to_null

# Rules in evaluation order with the text of their report line.
RULES = [
    ("duplicate", "Removed %d duplicate records."),
    ("missing", "Removed %d rows with missing values."),
    ("cpu", "Removed %d rows with invalid CPU utilization."),
    ("memory", "Removed %d rows with invalid memory utilization."),
    ("requests", "Removed %d rows with negative request volume."),
    ("latency", "Removed %d rows with negative latency."),
    ("availability", "Removed %d rows with invalid availability."),
    ("unknown_environment", "Removed %d rows with unknown environment IDs."),
]
NO_ROWS = "No valid data remaining after cleaning."
FEW_ROWS = "Insufficient valid data volume (< 10 rows)."


class MissingColumns(ValueError):
    pass


def missing_columns(telemetry: DataFrame) -> list[str]:
    return [c for c in S.TELEMETRY_COLUMNS if c not in telemetry.columns]


def schema_check(telemetry: DataFrame) -> tuple[str, list[str], DataFrame]:
    """Driver-side check of the schema, no job: (status, issues, rows to go on with)."""
    missing = missing_columns(telemetry)
    if missing:
        return "INVALID", [f"Missing required columns: {missing}"], telemetry.limit(0)
    return "VALID", [], telemetry


def schema_report(telemetry: DataFrame) -> DataFrame:
    """The schema check as a row per required column, with its known values (0 where absent).

    One aggregation over the rows; the line per column is made from its single result row.
    """
    present = set(telemetry.columns)
    counted = telemetry.agg(
        *[
            (F.count(c) if c in present else F.lit(0)).cast("long").alias(c)
            for c in S.TELEMETRY_COLUMNS
        ]
    )
    lines = F.array(
        *[
            F.struct(
                F.lit(i).alias("ordinal"),
                F.lit(c).alias("required_column"),
                F.lit(c in present).alias("present"),
                F.col(c).alias("known_values"),
            )
            for i, c in enumerate(S.TELEMETRY_COLUMNS)
        ]
    )
    return counted.select(F.explode(lines).alias("_line")).select("_line.*")


def require_columns(telemetry: DataFrame) -> DataFrame:
    missing = missing_columns(telemetry)
    if missing:
        raise MissingColumns(f"Missing required columns: {missing}")
    return telemetry


def parse_timestamps(telemetry: DataFrame, column: str = "timestamp") -> DataFrame:
    """Adds ``bad_timestamp`` and replaces a text timestamp by its parsed value.

    Python's ISO form with a trailing Z or an offset is understood as well.
    """
    if dict(telemetry.dtypes)[column] != "string":
        return telemetry.withColumn("bad_timestamp", F.lit(False))
    # Casting a text with a zone to a time without one drops the zone, so those go by the instant.
    zoned = F.col(column).rlike(r"[0-9]\s*(?:Z|UTC|GMT|[+-][0-9]{2}:?[0-9]{2})\s*$") & F.col(column).contains(":")
    instant = F.expr(f"convert_timezone(current_timezone(), 'UTC', cast(try_cast({column} as timestamp) as timestamp_ntz))")
    parsed = F.when(zoned, instant).otherwise(F.expr(f"try_cast({column} as timestamp_ntz)"))
    return telemetry.withColumn("bad_timestamp", parsed.isNull() & F.col(column).isNotNull()).withColumn(
        column, parsed
    )


def timestamp_check(telemetry: DataFrame, by: str | None = None) -> DataFrame:
    """Rows, unreadable timestamps and validity of the whole input (or of each ``by`` group)."""
    parsed = parse_timestamps(telemetry)
    keys = [by] if by else []
    return parsed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if("bad_timestamp").alias("bad_timestamps"),
        F.when(F.coalesce(F.max("bad_timestamp"), F.lit(False)), "INVALID").otherwise("VALID").alias("status"),
    )


def without_nan(telemetry: DataFrame) -> DataFrame:
    floats = [name for name, kind in telemetry.dtypes if kind in ("double", "float")]
    return telemetry.withColumns({c: nan_to_null(F.col(c).cast("double")) for c in floats})


def _order(order: list[str] | None) -> list[Column]:
    if not order:
        raise ValueError("keep-first needs the columns that state the input order")
    return [F.col(c) for c in order]


def keep_first(telemetry: DataFrame, order: list[str]) -> DataFrame:
    """First row per (timestamp, environment).

    Filtering the row number to 1 lets Spark cut each map task's copies to one row before the
    shuffle, so a key repeated millions of times costs one row per map task.
    """
    first = W.partitionBy(*S.KEYS).orderBy(*_order(order))
    return telemetry.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")


def row_rule(columns: list[str], known: Column | None = None) -> Column:
    """Name of the first rule after the duplicate rule that a row breaks, null for a clean row."""
    c = F.col
    top = S.UTILIZATION_CEILING
    missing = F.lit(False)
    for name in columns:
        missing = missing | c(name).isNull()
    rule = (
        F.when(missing, "missing")
        .when((c("cpu_utilization_pct") < 0) | (c("cpu_utilization_pct") > top), "cpu")
        .when((c("memory_utilization_pct") < 0) | (c("memory_utilization_pct") > top), "memory")
        .when(c("request_volume") < 0, "requests")
        .when(c("latency_ms") < 0, "latency")
        .when((c("availability_pct") < 0) | (c("availability_pct") > S.AVAILABILITY_CEILING), "availability")
    )
    return rule if known is None else rule.when(~known, "unknown_environment")


def valid_values(columns: list[str]) -> Column:
    """True for rows that break no rule of ``row_rule``: a plain conjunction, which reaches the scan.

    A comparison with a missing value is not true, so only the other columns need a null check.
    """
    c = F.col
    valid = (
        c("cpu_utilization_pct").between(0, S.UTILIZATION_CEILING)
        & c("memory_utilization_pct").between(0, S.UTILIZATION_CEILING)
        & (c("request_volume") >= 0)
        & (c("latency_ms") >= 0)
        & c("availability_pct").between(0, S.AVAILABILITY_CEILING)
    )
    for name in columns:
        if name not in S.METRICS:
            valid = valid & c(name).isNotNull()
    return valid


def known_environments(telemetry: DataFrame, environments: DataFrame) -> DataFrame:
    return telemetry.join(environments.select("environment_id"), "environment_id", "left_semi")


def unknown_environments(telemetry: DataFrame, environments: DataFrame) -> DataFrame:
    return telemetry.join(environments.select("environment_id"), "environment_id", "left_anti")


def clean(telemetry: DataFrame, order: list[str], environments: DataFrame | None = None) -> DataFrame:
    """Rows that pass every rule, without the order columns."""
    data = [c for c in require_columns(telemetry).columns if c not in order]
    rows = keep_first(without_nan(telemetry), order).where(valid_values(data)).select(*data)
    return rows if environments is None else known_environments(rows, environments)


def tagged(telemetry: DataFrame, order: list[str], environments: DataFrame | None = None) -> DataFrame:
    """One row per (timestamp, environment): the first row, ``copies`` and ``failed_rule``.

    ``min`` of (order, row) is the first row and is partially aggregated, as is the number of copies.
    """
    data = [c for c in require_columns(telemetry).columns if c not in order]
    payload = [c for c in data if c not in S.KEYS]
    firsts = (
        without_nan(telemetry)
        .groupBy(*S.KEYS)
        .agg(
            F.min(F.struct(*_order(order), *[F.col(c).alias(f"_p_{c}") for c in payload])).alias("_first"),
            F.count(F.lit(1)).alias("copies"),
        )
        .select(*S.KEYS, *[F.col(f"_first._p_{c}").alias(c) for c in payload], "copies")
    )
    known = None
    if environments is not None:
        registry = environments.select("environment_id", F.lit(True).alias("_known")).distinct()
        firsts = firsts.join(registry, "environment_id", "left")
        known = F.coalesce(F.col("_known"), F.lit(False))
    out = firsts.withColumn("failed_rule", row_rule(data, known))
    return out.drop("_known")


def _removed() -> list[Column]:
    """Removed rows per rule, as aggregates over ``tagged`` rows."""
    counts = [F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate")]
    return counts + [F.count_if(F.col("failed_rule") == name).alias(name) for name, _ in RULES[1:]]


def issue_report(telemetry: DataFrame, order: list[str], environments: DataFrame | None = None) -> DataFrame:
    """(rule_order, rule, removed_rows, message) for every rule that removed rows."""
    totals = tagged(telemetry, order, environments).agg(*_removed())
    lines = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("rule_order"),
                F.lit(name).alias("rule"),
                F.col(name).cast("long").alias("removed_rows"),
                F.format_string(text, F.col(name)).alias("message"),
            )
            for i, (name, text) in enumerate(RULES)
        ]
    )
    return totals.select(F.explode(lines).alias("line")).select("line.*").where("removed_rows > 0")


def status(
    telemetry: DataFrame, order: list[str], environments: DataFrame | None = None, by: str | None = None
) -> DataFrame:
    """(input_rows, clean_rows, status) of the whole input, or of each ``by`` group.

    Fewer clean rows than the minimum makes an input INVALID and hides its warnings.
    """
    return _verdict(_counted(tagged(telemetry, order, environments), by))


def status_and_parts(
    telemetry: DataFrame, order: list[str], environments: DataFrame | None = None, whole: str = "(all)"
) -> DataFrame:
    """The status of each environment and, under the id ``whole``, of the whole input.

    Rows are counted per environment once; the whole is the sum of its parts.
    """
    parts = _counted(tagged(telemetry, order, environments), "environment_id")
    total = parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input_rows", "clean_rows")])
    total = total.select(F.lit(whole).alias("environment_id"), "input_rows", "clean_rows")
    return _verdict(parts.unionByName(total))


def _counted(rows: DataFrame, by: str | None) -> DataFrame:
    return rows.groupBy(*([by] if by else [])).agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("input_rows"),
        F.count_if(F.col("failed_rule").isNull()).alias("clean_rows"),
    )


def _verdict(counted: DataFrame) -> DataFrame:
    few = F.col("clean_rows") < S.MIN_CLEAN_ROWS
    return counted.withColumn(
        "status",
        F.when(few, "INVALID").when(F.col("clean_rows") < F.col("input_rows"), "WARNING").otherwise("VALID"),
    ).withColumn(
        "issue", F.when(F.col("clean_rows") == 0, NO_ROWS).when(few, FEW_ROWS)
    )


def quality_grade(telemetry: DataFrame, order: list[str], by: str | None = None) -> DataFrame:
    """LOW, MEDIUM or HIGH; does not look at the registry."""
    return graded(status(telemetry, order, by=by))


def graded(judged: DataFrame) -> DataFrame:
    """Rows with a status, with the quality that it means."""
    grade = (
        F.when(F.col("status") == "INVALID", "LOW")
        .when(F.col("status") == "WARNING", "MEDIUM")
        .when(F.col("clean_rows") > S.HIGH_QUALITY_ROWS, "HIGH")
        .otherwise("MEDIUM")
    )
    return judged.withColumn("quality", grade).drop("issue")
