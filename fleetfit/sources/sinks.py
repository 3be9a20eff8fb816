"""Writing results, split histories and the audit ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fleetfit import schemas as S
from fleetfit.sources.commits import CommitTable


def split_metrics(telemetry: DataFrame, name: str) -> DataFrame:
    """The rows of one single-metric history."""
    return telemetry.select(*S.KEYS, S.HISTORIES[name])


def write_histories(telemetry: DataFrame, folder: str, fmt: str = "parquet") -> dict[str, str]:
    """One table per metric; returns their paths.

    Each write reads only its own column of a columnar input, so the input is not cached.
    """
    paths = {}
    for name in S.HISTORIES:
        paths[name] = f"{folder.rstrip('/')}/{name}"
        split_metrics(telemetry, name).write.mode("errorifexists").format(fmt).save(paths[name])
    return paths


def long_metrics(telemetry: DataFrame) -> DataFrame:
    """Long form (timestamp, environment, metric, value)."""
    return telemetry.unpivot(S.KEYS, S.METRICS, "metric", "value")


def append_audit(events: DataFrame, path: str, writer: str, batch: object) -> bool:
    """Append events to the ledger, partitioned by day, as one batch of a writer.

    False, and nothing is written, where the ledger has that batch of the writer already, so a job
    that is run again adds nothing. Readers see whole batches only. Rebalancing gathers a day's events
    into few files and still splits a day that is large.
    """
    dated = events.withColumn("event_date", F.to_date("timestamp")).hint("rebalance", "event_date")
    return CommitTable(events.sparkSession, path).append(dated, writer, batch, ["event_date"])


def stamped(events: DataFrame) -> DataFrame:
    """Events with the UTC write time in front, as the ledger keeps it."""
    now = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).cast("timestamp_ntz")
    return events.select(now.alias("timestamp"), *events.columns)


def write_results(results: DataFrame, path: str) -> None:
    """Result table as CSV with a header; nested columns are written as text lists."""
    flat = [
        F.concat_ws("|", c).alias(c) if kind.startswith("array") else F.col(c) for c, kind in results.dtypes
    ]
    results.select(*flat).write.mode("errorifexists").option("header", True).csv(path)
