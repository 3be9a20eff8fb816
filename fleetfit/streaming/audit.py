"""Gate decisions of a stream of migration requests, appended to the ledger exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from fleetfit import session
from fleetfit.operators import gate
from fleetfit.plans.fleet import Fleet
from fleetfit.sources import adapters
from fleetfit.sources.commits import CommitTable
from fleetfit.streaming.runner import run_each, table_stream

#: A request that is made again within the same period is the same request; later it is a new one.
PERIOD = "1 day"
#: Requests may arrive so late; periods that ended earlier are forgotten.
LATENESS = "1 day"
WRITER = "gate-stream"
LEDGER = T.StructType([*gate.LEDGER.fields, T.StructField("requested_on", T.DateType())])


def once_per_period(requests: DataFrame, period: str = PERIOD, lateness: str = LATENESS) -> DataFrame:
    """Requests told apart by environment, types and period of ``requested_at``.

    The period is part of the key, so a key is forgotten when the watermark has passed its period: the
    state holds the requests of the open periods only. Later arrivals of closed periods are dropped,
    and a request without a time belongs to no period.
    """
    timed = requests.withColumn("requested_at", F.col("requested_at").cast("timestamp")).withWatermark("requested_at", lateness)
    keyed = timed.select(*gate.REQUEST, F.window("requested_at", period).alias("period"))
    return keyed.dropDuplicates([*gate.REQUEST, "period"])


def decided(batch: DataFrame, environments: DataFrame, decisions: DataFrame) -> DataFrame:
    """Ledger entries of a micro-batch, from the snapshot of decisions alone."""
    dated = batch.withColumn("requested_on", F.to_date("period.start")).drop("period")
    return gate.audit_rows(gate.precheck_from(dated, environments, decisions), keep=("requested_on",))


def decisions(
    requests: DataFrame,
    environments: DataFrame,
    snapshot: DataFrame,
    ledger: str | None = None,
    period: str = PERIOD,
    lateness: str = LATENESS,
) -> DataFrame:
    """The ledger's entries for all requests of a stream, each decided once per period against ``snapshot``.

    Every micro-batch is one committed batch of the ledger, so one that is run again adds nothing. A
    new snapshot takes effect when the stream is started with it.
    """
    spark = requests.sparkSession
    path = ledger or session.scratch_path(spark, "stream-audit")
    table = CommitTable(spark, path)

    def write(batch: DataFrame, batch_id: int) -> None:
        if not table.append(decided(batch, environments, snapshot).select(*LEDGER.names), WRITER, batch_id):
            batch.write.format("noop").mode("overwrite").save()  # the stream's own state still has to be brought up to date

    run_each(once_per_period(requests, period, lateness), "stream-audit", write)
    return table.read(LEDGER)


def run(spark: SparkSession, sf_dir: str, fleet: Fleet) -> DataFrame:
    requests = adapters.requests_of(table_stream(spark, sf_dir, "events"), timed=True)
    return decisions(requests, fleet.environments, gate.snapshot(fleet))
