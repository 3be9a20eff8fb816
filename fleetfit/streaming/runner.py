"""Starting streams over given tables and collecting their output as tables in shared storage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from fleetfit.session import scratch_path
from fleetfit.sources.adapters import SCHEMAS


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A given table as a file stream."""
    reader = spark.readStream.schema(SCHEMAS[name]).option("pathGlobFilter", f"{name}.parquet")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(sf_dir)


def folder_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def run_append(rows: DataFrame, label: str) -> DataFrame:
    """Run a stream over all available input in append mode; returns the written table."""
    spark = rows.sparkSession
    out, state = scratch_path(spark, label), scratch_path(spark, f"{label}-state")
    started = (
        rows.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", state)
        .option("path", out)
        .trigger(availableNow=True)
        .start()
    )
    started.awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)


def batch_writer(folder: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df):
    """A ``foreachBatch`` function that writes each micro-batch to its own partition.

    A batch that is repeated after a failure overwrites its own partition and nothing else, which
    makes the table exactly-once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        prepare(batch).write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")

    return write


def run_each(
    rows: DataFrame, label: str, write: Callable[[DataFrame, int], None], mode: str = "append", checkpoint: str | None = None
) -> None:
    """Run a stream over all available input, giving each micro-batch and its number to ``write``.

    With ``checkpoint`` a later run goes on where an earlier one ended."""
    started = (
        rows.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint or scratch_path(rows.sparkSession, f"{label}-state"))
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
    )
    started.awaitTermination()


def run_batches(
    rows: DataFrame,
    label: str,
    mode: str = "append",
    prepare: Callable[[DataFrame], DataFrame] = lambda df: df,
    schema: T.StructType | None = None,
) -> DataFrame:
    """Run a stream through ``batch_writer``; returns the table with a ``batch_id`` column."""
    spark = rows.sparkSession
    out = scratch_path(spark, label)
    run_each(rows, label, batch_writer(out, prepare), mode)
    full = T.StructType((schema or rows.schema).fields + [T.StructField("batch_id", T.LongType())])
    return spark.read.schema(full).option("basePath", out).parquet(out)
