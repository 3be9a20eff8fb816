"""Validation of a telemetry stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from fleetfit import schemas as S
from fleetfit import session
from fleetfit.operators import validation
from fleetfit.sources import adapters
from fleetfit.sources.commits import CommitTable
from fleetfit.streaming.runner import run_each, table_stream

WRITER = "validate-stream"
FIRST = "_first"


class FirstRows:
    """State of a validation: the first row of every key, as a table that micro-batches are merged into.

    ``order`` states the input order. A micro-batch adds its own first rows as one commit, so one that
    is run again changes nothing; commits are merged as they pile up. The first row of a key is the
    least of all commits, whenever it arrives, so a late row still takes its place.
    """

    def __init__(self, spark: SparkSession, path: str, rows: T.StructType, order: list[str]):
        self.table, self.order = CommitTable(spark, path), order
        # Order columns under names of their own: the least struct is the first row.
        places = [F.col(c).alias(f"_order_{i}") for i, c in enumerate(order)]
        self.first = F.min(F.struct(*places, *S.METRICS)).alias(FIRST)
        known = spark.createDataFrame([], rows).groupBy(*S.KEYS).agg(self.first)
        self.schema = known.schema

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """The first rows of a micro-batch: copies of a key are cut in the map tasks."""
        self.table.append(batch.groupBy(*S.KEYS).agg(self.first).sortWithinPartitions("timestamp"), WRITER, batch_id)
        self.table.merge(self._least, schema=self.schema)

    def _least(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*S.KEYS).agg(F.min(FIRST).alias(FIRST)).sortWithinPartitions("timestamp")

    def settled(self, before: object = None) -> DataFrame:
        """The valid first rows so far; ``before`` a time that the stream has passed, only keys that are complete.

        Rules are applied to first rows only: a key whose first row is invalid has no reading.
        """
        live = self.table.live()
        rows = self.table.read(self.schema, live)
        if before is not None:
            rows = rows.where(F.col("timestamp") < F.lit(before))
        firsts = rows if len(live) < 2 else rows.groupBy(*S.KEYS).agg(F.min(FIRST).alias(FIRST))
        out = firsts.select(*S.KEYS, *[F.col(f"{FIRST}.{m}").alias(m) for m in S.METRICS])
        return out.where(validation.valid_values(S.TELEMETRY_COLUMNS))


def prepared(telemetry: DataFrame, order: list[str], environments: DataFrame | None = None) -> DataFrame:
    """Rows that can be the first of a key, of known environments: those without a time or an environment never are valid."""
    rows = validation.without_nan(telemetry.select(*S.TELEMETRY_COLUMNS, *order))
    rows = rows.where(F.col("timestamp").isNotNull() & F.col("environment_id").isNotNull())
    return rows if environments is None else validation.known_environments(rows, environments)


def validated(
    telemetry: DataFrame, order: list[str], environments: DataFrame | None = None, path: str | None = None
) -> DataFrame:
    """Valid readings of known environments, one per (timestamp, environment): what the batch form gives, complete.

    The stream runs to the end of its input; then a last pass over the state settles every key. With
    ``path`` a later run goes on from the state that an earlier one left there.
    """
    spark, rows = telemetry.sparkSession, prepared(telemetry, order, environments)
    own = path or session.scratch_path(spark, "stream-validate")
    state = FirstRows(spark, own, rows.schema, order)
    run_each(rows, "stream-validate", state.add, checkpoint=f"{own}/progress")
    return state.settled()


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = adapters.telemetry_of(table_stream(spark, sf_dir, "lineitem"))
    return validated(raw, adapters.INGEST_ORDER, adapters.environments(spark, sf_dir))
