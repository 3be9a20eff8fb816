"""Telemetry clustered by environment, with an index of files, so that a look-up opens few of them.

Files are ranges of (environment, time), so an environment lies in one file or in a few neighbouring ones however large it
is. The index has a row per file with its first and last environment; row groups inside a file have statistics and a Bloom
filter of the environment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetfit import schemas as S
from fleetfit.sources.readers import lookup

ENV = "environment_id"
ROWS_PER_FILE = 1_000_000
#: Bytes of a row group: small ones let a look-up skip most of a file.
ROW_GROUP = 8 << 20
INDEX = "file string, first_environment string, last_environment string, readings long"
#: Environments that a look-up lists in its filters; for more, whole tables are joined.
LISTED = 1_000


class ClusteredTelemetry:
    """Telemetry in folder ``path``: ``data`` and ``index``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, telemetry: DataFrame, rows_per_file: int = ROWS_PER_FILE) -> None:
        """Write all rows once; the index is made from the environments of the written files alone."""
        files = max(1, -(-telemetry.count() // rows_per_file))
        placed = telemetry.repartitionByRange(files, ENV, "timestamp").sortWithinPartitions(ENV, "timestamp")
        out = placed.write.mode("errorifexists").option(f"parquet.bloom.filter.enabled#{ENV}", "true")
        out.option("parquet.block.size", ROW_GROUP).parquet(f"{self.path}/data")
        index = self.rows().groupBy(F.col("_metadata.file_path").alias("file")).agg(
            F.min(ENV).alias("first_environment"), F.max(ENV).alias("last_environment"), F.count(F.lit(1)).alias("readings")
        )
        index.write.mode("errorifexists").parquet(f"{self.path}/index")

    def rows(self) -> DataFrame:
        return self.spark.read.schema(S.TELEMETRY).parquet(f"{self.path}/data")

    def index(self) -> DataFrame:
        return self.spark.read.schema(INDEX).parquet(f"{self.path}/index")

    def of(self, environments: list[str]) -> DataFrame:
        """The readings of some environments, from the files that may have any."""
        if len(environments) > LISTED:
            raise ValueError(f"more than {LISTED} environments: join with rows() instead")
        names = F.array(*[F.lit(e) for e in environments]).cast("array<string>")
        holds = F.exists(names, lambda e: e.between(F.col("first_environment"), F.col("last_environment")))
        files = [r["file"] for r in self.index().where(holds).collect()]  # few files for each of at most LISTED environments
        if not files:
            return self.spark.createDataFrame([], S.TELEMETRY)
        return self.spark.read.schema(S.TELEMETRY).parquet(*files).where(F.col(ENV).isin(environments))

    def lookup(self, wanted: DataFrame, registry: DataFrame) -> DataFrame:
        """Registry row and number of readings of each wanted environment, ``found`` false for unknown ids.

        A few wanted ones are listed, so that only their files are opened; for many, whole tables are joined.
        """
        few = [r[ENV] for r in wanted.select(ENV).where(F.col(ENV).isNotNull()).distinct().limit(LISTED + 1).collect()]
        if len(few) > LISTED:
            return lookup(wanted, registry, self.rows().join(wanted.select(ENV), ENV, "left_semi"))
        return lookup(wanted, registry.where(F.col(ENV).isin(few)), self.of(few))
