"""Reading the input tables with declared schemas (CSV with a header, parquet or ORC)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from fleetfit import schemas as S
from fleetfit.functions.common import nan_to_null
from fleetfit.operators.validation import parse_timestamps
from fleetfit.sources.commits import CommitTable


def read_table(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv", ordered: bool = False
) -> DataFrame:
    """A table with its declared schema; nothing is inferred, missing numbers become null.

    With ``ordered`` the columns of ``INPUT_ORDER`` are added.
    """
    reader = spark.read.schema(schema)
    if fmt == "csv":
        # Columns are matched by header name, so extra or reordered columns do no harm.
        declared = {f.name: f for f in schema.fields}
        header = spark.read.option("header", True).csv(path).columns
        wide = T.StructType([declared.get(c, T.StructField(c, T.StringType())) for c in header])
        # Files of a folder whose header names other columns are refused instead of read by position.
        rows = spark.read.schema(wide).option("header", True).option("enforceSchema", False).option("nanValue", "NaN").csv(path)
        declared_only = [f.name for f in schema.fields if f.name in header]
    else:
        rows = reader.format(fmt).load(path)
        declared_only = rows.columns
    rows = with_input_order(rows) if ordered else rows
    rows = rows.select(*declared_only, *(INPUT_ORDER if ordered else []))
    floats = [f.name for f in schema.fields if isinstance(f.dataType, T.DoubleType) and f.name in rows.columns]
    return rows.withColumns({c: nan_to_null(F.col(c)) for c in floats}) if floats else rows


INPUT_ORDER = ["_file", "_block", "_row"]


def with_input_order(rows: DataFrame) -> DataFrame:
    """Adds the place of each row in its files, for rules that keep the first of several rows.

    Rows of a file split are numbered as they are read, so (file, start of the split, number) is the
    order of the input however the splits are spread over tasks.
    """
    return rows.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )


def _location(folder: str, name: str, fmt: str) -> str:
    return f"{folder.rstrip('/')}/{name}.csv" if fmt == "csv" else f"{folder.rstrip('/')}/{name}"


def environments(spark: SparkSession, folder: str, fmt: str = "csv") -> DataFrame:
    """The registry with ``seq``, its order in the file, and ``status``, RUNNING as at registration."""
    rows = read_table(spark, _location(folder, "environments", fmt), S.ENVIRONMENTS, fmt, ordered=True)
    seq = F.struct(*INPUT_ORDER)
    return rows.withColumns({"seq": seq, "status": F.lit("RUNNING")}).drop(*INPUT_ORDER)


def history(spark: SparkSession, folder: str, name: str, fmt: str = "csv") -> DataFrame:
    return read_table(spark, _location(folder, name, fmt), S.history_schema(S.HISTORIES[name]), fmt)


def histories(spark: SparkSession, folder: str, fmt: str = "csv") -> dict[str, DataFrame]:
    return {name: history(spark, folder, name, fmt) for name in S.HISTORIES}


def pricing(spark: SparkSession, folder: str, fmt: str = "csv") -> DataFrame:
    return read_table(spark, _location(folder, "pricing_history", fmt), S.PRICING, fmt)


def full_telemetry(
    spark: SparkSession, folder: str, fmt: str = "csv", environment_id: str | None = None, ordered: bool = False
) -> DataFrame:
    """The pre-joined fact; a filter on one environment reaches the scan."""
    schema = T.StructType(S.TELEMETRY.fields + [T.StructField("instance_type", T.StringType())])
    rows = read_table(spark, _location(folder, "full_telemetry", fmt), schema, fmt, ordered)
    return rows if environment_id is None else rows.where(F.col("environment_id") == environment_id)


def audit_log(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The ledger with ``seq``, the order of its entries: committed batches, or a folder of plain files; as CSV with a
    header and ISO times."""
    if fmt != "csv":
        table = CommitTable(spark, path)
        rows = table.read() if fmt == "parquet" and table.commits() else spark.read.format(fmt).load(path)
        return rows if "seq" in rows.columns else with_input_order(rows).withColumn("seq", F.struct(*INPUT_ORDER)).drop(*INPUT_ORDER)
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in S.AUDIT.fields])
    rows = parse_timestamps(read_table(spark, path, text, "csv", ordered=True)).drop("bad_timestamp")
    return rows.withColumn("seq", F.struct(*INPUT_ORDER)).drop(*INPUT_ORDER)


def lookup(wanted: DataFrame, environments: DataFrame, telemetry: DataFrame) -> DataFrame:
    """Registry row and number of readings of each wanted environment, ``found`` false for unknown ids.

    Readings are counted before the join, with a map-side part.
    """
    counts = telemetry.groupBy("environment_id").agg(F.count(F.lit(1)).alias("readings"))
    registry = environments.withColumn("found", F.lit(True))
    return (
        wanted.join(registry, "environment_id", "left")
        .join(counts, "environment_id", "left")
        .withColumn("found", F.coalesce("found", F.lit(False)))
        .withColumn("readings", F.when(F.col("found"), F.coalesce("readings", F.lit(0))))
    )
