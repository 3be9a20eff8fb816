"""Post-migration health of a stream of readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql import types as T

from fleetfit import session
from fleetfit.operators import health
from fleetfit.operators.projection import ENV
from fleetfit.sources import adapters
from fleetfit.sources.commits import CommitTable
from fleetfit.streaming.runner import run_each, table_stream

MIGRATION = [ENV, "migration_seq"]
#: So long after its last reading a full window stays open for late ones.
LATENESS = "1 DAY"
CLOCK = T.StructType([T.StructField("ts", T.TimestampNTZType())])


def after_migrations(batch: DataFrame, executed: DataFrame) -> DataFrame:
    """What a micro-batch can add to the windows after migrations: its first readings after each, a few rows each."""
    return health.window_after(executed, batch, keep=("reading_id",)).drop("checkpoint_no", "checkpoint", "health_status")


def window_verdicts(candidates: DataFrame, checkpoints: int = health.CHECKPOINTS) -> DataFrame:
    """Verdict per migration over its first readings by event time, from the candidates of all micro-batches.

    A late reading takes its place in the window whenever it arrives.
    """
    first = W.partitionBy(*MIGRATION).orderBy("ts", "reading_id")
    rows = candidates.withColumn("_nth", F.row_number().over(first)).where(F.col("_nth") <= checkpoints)
    return health.verdicts(health.classified(rows), MIGRATION)


class OpenWindows:
    """State of the judgement: the first readings after each migration whose window is open, and closed windows.

    Each micro-batch adds its few candidates as one commit; merged commits keep the first readings of
    open windows only. A window is closed when it is full and the newest reading seen is ``lateness``
    past its last one: its verdict is written, and no later reading is compared with its migration.
    Until then a late reading takes its place.
    """

    def __init__(self, spark: SparkSession, path: str, executed: DataFrame, lateness: str = LATENESS):
        self.executed, self.lateness, self.spark = executed, lateness, spark
        self.candidates, self.closed, self.clock = (CommitTable(spark, f"{path}/{part}") for part in ("open", "closed", "clock"))

    def open_migrations(self) -> DataFrame:
        return self.executed.join(self.closed.read(health.CANDIDATES).select(*MIGRATION), MIGRATION, "left_anti")

    def _first(self, rows: DataFrame) -> DataFrame:
        first = W.partitionBy(*MIGRATION).orderBy("ts", "reading_id")
        return rows.withColumn("_nth", F.row_number().over(first)).where(F.col("_nth") <= health.CHECKPOINTS).drop("_nth")

    def add(self, batch: DataFrame, batch_id: int) -> None:
        rows = after_migrations(batch, self.open_migrations()).select(*health.CANDIDATES.names)
        if not self.candidates.append(rows, "health", batch_id):
            return
        self.clock.append(batch.agg(F.max("ts").alias("ts")), "clock", batch_id)
        self.clock.merge(lambda seen: seen.agg(F.max("ts").alias("ts")), schema=CLOCK)
        self.close(batch_id)
        self.candidates.merge(lambda r: self._first(self.still_open(r)), schema=health.CANDIDATES)

    def still_open(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.closed.read(health.CANDIDATES).select(*MIGRATION).distinct(), MIGRATION, "left_anti")

    def open(self) -> DataFrame:
        """The first readings of the open windows."""
        return self._first(self.still_open(self.candidates.read(health.CANDIDATES)))

    def close(self, batch_id: int) -> None:
        """Write the full windows that the stream has left behind."""
        newest = self.clock.read(CLOCK).agg(F.max("ts")).first()[0]
        if newest is None:
            return
        passed = F.lit(newest).cast("timestamp_ntz") - F.expr(f"INTERVAL {self.lateness}")
        rows = self.open()
        full = rows.groupBy(*MIGRATION).agg(F.count(F.lit(1)).alias("_n"), F.max("ts").alias("_last"))
        full = full.where((F.col("_n") == health.CHECKPOINTS) & (F.col("_last") < passed)).select(*MIGRATION)
        self.closed.append(rows.join(full, MIGRATION, "left_semi").select(*health.CANDIDATES.names), "health", batch_id)
        self.closed.merge(lambda r: r, schema=health.CANDIDATES)

    def verdicts(self) -> DataFrame:
        """The verdict of each migration with readings after it, over closed windows and open ones."""
        return window_verdicts(self.open().unionByName(self.closed.read(health.CANDIDATES)))


def judge(
    readings: DataFrame, executed: DataFrame, label: str = "stream-health", path: str | None = None, lateness: str = LATENESS
) -> DataFrame:
    """Run a stream of readings against executed migrations; the verdict of each migration with readings after it.

    With ``path`` a later run goes on from the windows that an earlier one left there."""
    own = path or session.scratch_path(readings.sparkSession, label)
    windows = OpenWindows(readings.sparkSession, own, executed, lateness)
    run_each(readings, label, windows.add, checkpoint=f"{own}/progress")
    return windows.verdicts()


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of every migration."""
    readings = adapters.readings_of(table_stream(spark, sf_dir, "events"))
    return judge(readings, health.migrations(adapters.audit(spark, sf_dir)))


def run_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of each environment's last migration."""
    readings = adapters.readings_of(table_stream(spark, sf_dir, "events"))
    last = health.latest_migrations(adapters.audit(spark, sf_dir))
    return judge(readings, last, "stream-first").drop("migration_seq")
