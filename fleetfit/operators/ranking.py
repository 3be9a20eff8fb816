"""Row positions within groups and over whole tables, without one task holding a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fleetfit.session import written


def position_in_group(
    rows: DataFrame,
    keys: list[str],
    bucket: Column,
    order: list[Column | str],
    out: str,
    counted: Column | None = None,
    total: str | None = None,
) -> DataFrame:
    """1-based position of each row within its group; with ``counted``, of counted rows so far.

    ``bucket`` must be ordered like ``order`` (the minute of a timestamp, a prefix of a hash) so that a
    position is the size of the earlier buckets plus the position inside the own bucket. Rows are
    only shuffled by (keys, bucket); what is accumulated per key is one count per bucket. With
    ``total`` the size of the group is attached under that name.
    """
    flag = F.lit(1) if counted is None else F.when(counted, 1).otherwise(0)
    tagged = rows.withColumn("_bucket", bucket).withColumn("_one", flag.cast("long"))
    parts = keys + ["_bucket"]
    sizes = tagged.groupBy(*parts).agg(F.sum("_one").alias("_size"))
    earlier = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    sizes = sizes.withColumn("_before", F.sum("_size").over(earlier) - F.col("_size"))
    if total:
        sizes = sizes.withColumn(total, F.sum("_size").over(W.partitionBy(*keys)))
    within = W.partitionBy(*parts).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    # A null key or bucket is a value like any other: no row may be lost.
    sizes = sizes.drop("_size").withColumnsRenamed({p: f"_s{p}" for p in parts})
    same = [F.col(p).eqNullSafe(F.col(f"_s{p}")) for p in parts]
    return (
        tagged.withColumn("_local", F.sum("_one").over(within))
        .join(sizes, same)
        .withColumn(out, F.col("_before") + F.col("_local"))
        .drop("_bucket", "_one", "_local", "_before", *[f"_s{p}" for p in parts])
    )


def position_in_table(rows: DataFrame, order: list[Column], out: str, restart: str | None = None) -> DataFrame:
    """1-based rank over the whole table in a total order, by range partitions.

    The rows are written first, as choosing the ranges takes a pass of its own over them, and again
    once range-partitioned and sorted, since the offsets and the rows must come from the same
    partitioning. What is accumulated in one task is
    one count per partition (and per value of ``restart``, a column of few values that leads the
    order and at which the rank starts again).
    """
    lead = [F.col(restart)] if restart else []
    partitions = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = (
        written(rows, "unranked")
        .repartitionByRange(partitions, *lead, *order)
        .sortWithinPartitions(*lead, *order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_seq", F.monotonically_increasing_id())
    )
    ranged = written(ranged, "ranked")
    keys = ([restart] if restart else []) + ["_part"]
    sizes = ranged.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"), F.min("_seq").alias("_first"))
    upto = W.partitionBy(*([restart] if restart else [F.lit(0)])).orderBy("_part")
    sizes = sizes.withColumn(
        "_before", F.sum("_size").over(upto.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_size")
    ).drop("_size")
    # At most partitions x values of `restart` rows: bounded by configuration, not by the data.
    return (
        ranged.join(F.broadcast(sizes), keys)
        .withColumn(out, F.col("_before") + F.col("_seq") - F.col("_first") + 1)
        .drop("_part", "_seq", "_first", "_before")
    )
