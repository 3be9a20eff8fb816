"""Session settings the plans rely on, and lineage cuts in shared storage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings, all changeable on a live session.
#  - forceOptimizeSkewedJoin: joining telemetry with the environment registry by shuffle leaves a
#    hot environment in one partition; splitting it is worth the extra (pre-aggregated) exchange.
#  - sortBased.fallbackThreshold: exact percentiles keep a buffer of values per group. The default
#    of 128 groups sorts nearly every task; a few hundred keep the buffers of a task small, as
#    groups beyond ``quantiles.GROUP_LIMIT`` rows never get there.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "512",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings above; cluster sizing is left to the caller's session."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


ROWS_PER_PARTITION = 1_500_000


def partitions_for(spark: SparkSession, rows: int) -> int:
    """Partitions for an exchange of so many rows of telemetry, some 100 MB each, and not fewer than
    the session's number. The session itself is left alone."""
    return max(-(-rows // ROWS_PER_PARTITION), int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables, as named by the cluster.

    Only on a local master, where the session names none, a temporary folder is made and remembered:
    on a cluster other machines would not see it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("name a folder that all machines share in spark.checkpoint.dir")
    made = tempfile.mkdtemp(prefix="fleetfit-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/fleetfit/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the files.

    Used where two branches must see the very same rows and where a recomputation after a lost
    executor must not change them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is run inside removes the files of its own shuffles when it ends.

    Else they lie on the executors' disks until the driver happens to collect its garbage, which may be
    never while a long chain of stored tables is written. The session's own setting stands again after.
    """
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def local_rows(spark: SparkSession, rows: list[tuple], columns: dict[str, pa.DataType]) -> DataFrame:
    """A configuration table. Built from Arrow it is a local relation whose exact size the planner
    knows, so joins with it are broadcast by its size and not by a hint."""
    data = {name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(columns.items())}
    return spark.createDataFrame(pa.table(data))
