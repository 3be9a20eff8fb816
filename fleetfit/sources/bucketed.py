"""The five histories as bucketed tables, which are merged where they lie.

Each history, and the keys that any of them has, is dealt by key into the same number of buckets when it is written. The
merge joins the keys with each history bucket by bucket, so nothing is shuffled however often it is asked for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetfit import schemas as S

SPINE = "keys"


class BucketedHistories:
    """Tables ``<name>_<history>`` of the session's catalog, with their files in ``folder``."""

    def __init__(self, spark: SparkSession, name: str, folder: str, buckets: int):
        self.spark, self.name, self.folder, self.buckets = spark, name, folder.rstrip("/"), buckets

    def _table(self, history: str) -> str:
        return f"{self.name}_{history}"

    def _save(self, rows: DataFrame, history: str) -> None:
        # Brought together by bucket first: one file per bucket and write, not one per task.
        dealt = rows.repartition(self.buckets, *S.KEYS).write.mode("append").format("parquet")
        dealt.bucketBy(self.buckets, *S.KEYS).sortBy(*S.KEYS).option("path", f"{self.folder}/{history}").saveAsTable(self._table(history))

    def append(self, histories: dict[str, DataFrame]) -> None:
        """Add rows to the histories; the first call makes the tables. Only the new rows are shuffled."""
        for name, rows in histories.items():
            self._save(rows.select(*S.KEYS, S.HISTORIES[name]), name)
        new = reduce(DataFrame.union, [h.select(*S.KEYS) for h in histories.values()]).where(_keyed()).distinct()
        if self.spark.catalog.tableExists(self._table(SPINE)):
            new = new.join(self.spark.table(self._table(SPINE)).hint("merge"), S.KEYS, "left_anti")
        self._save(new, SPINE)

    def history(self, name: str) -> DataFrame:
        return self.spark.table(self._table(name))

    def merged(self) -> DataFrame:
        """Full outer merge of the histories on (timestamp, environment), as ``merge.merge_histories`` gives it.

        A key that is repeated in some histories is multiplied as joins do; a null key meets no other row. A left join
        keeps the buckets of its left side, which a full outer join would not. Sorted buckets take few bytes a row on
        disk, so millions of rows look small enough for a broadcast, which the driver could not hold: hence the hints.
        """
        parts = {name: self.history(name) for name in S.HISTORIES}
        joined = self.spark.table(self._table(SPINE))
        for name, rows in parts.items():
            joined = joined.join(rows.where(_keyed()).hint("merge"), S.KEYS, "left")
        metrics = [S.HISTORIES[n] for n in parts]
        single = [
            rows.where(~_keyed()).select(*S.KEYS, *[F.col(m) if m == S.HISTORIES[n] else F.lit(None).cast("double").alias(m) for m in metrics])
            for n, rows in parts.items()
        ]
        return reduce(DataFrame.unionByName, single, joined.select(*S.KEYS, *metrics))


def _keyed():
    return F.col("timestamp").isNotNull() & F.col("environment_id").isNotNull()
