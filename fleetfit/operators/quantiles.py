"""Exact interpolated percentiles per group, safe for groups of any size.

Spark's ``percentile`` keeps every distinct value of a group in one task. That is the right plan
for the usual group (some hundred to some million readings per environment) and the wrong one for
an environment that holds a third of the table. So the row counts are looked at first (the same
look decides whether rows may be brought together by environment at all, see ``plans.fleet``):

* no group above ``GROUP_LIMIT``: one aggregation with ``percentile``;
* otherwise the large groups go through ``split_percentiles``, which only ever shuffles counts of
  value ranges and narrows the range holding the wanted ranks, while the rest stays on the
  one-aggregation plan. Both give the same numbers.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fleetfit.session import written

GROUP_LIMIT = 250_000
LOG_STEPS = 512
LINEAR_STEPS = 4096


@dataclass(frozen=True)
class LargeGroups:
    """Groups above the limit: named by the caller (``ids``) or found (``table``, a stored column of ids).

    ``every`` says that all rows belong to large groups; ``rows`` is the number of rows looked at;
    ``strangers`` tells that an unknown id has as many rows.
    """

    key: str
    ids: tuple[str, ...] = ()
    table: DataFrame | None = None
    every: bool = False
    rows: int = 0
    strangers: bool = False

    def __bool__(self) -> bool:
        return self.every or bool(self.ids) or self.table is not None

    def inside(self) -> "LargeGroups":
        """For rows that are known to belong to the large groups only."""
        return replace(self, every=True)

    def apart(self, rows: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
        """(rows of usual groups, rows of large groups), None where there are none."""
        if not self:
            return rows, None
        if self.every:
            return None, rows
        if self.table is not None:
            return rows.join(self.table, self.key, "left_anti"), rows.join(self.table, self.key, "left_semi")
        listed = F.coalesce(F.col(self.key).isin(*self.ids), F.lit(False))
        return rows.where(~listed), rows.where(listed)


NO_LARGE_GROUPS = LargeGroups("environment_id")


def find_large_groups(
    rows: DataFrame, key: str = "environment_id", limit: int | None = None, known: DataFrame | None = None
) -> LargeGroups:
    """Look at the row counts of ``rows`` (an upper bound is fine, so pass unvalidated input).

    A table of at most ``limit`` (``GROUP_LIMIT``) rows is settled by its total, which for parquet comes from the
    footers. Beyond that one partially aggregated count per key decides. With ``known`` only its ids
    can make a group large: rows of others are dropped before they are brought together. The ids
    found stay a table, however many they are.
    """
    limit = GROUP_LIMIT if limit is None else limit
    total = rows.count()
    if total <= limit:
        return LargeGroups(key, rows=total)
    big = written(rows.groupBy(key).count().where(F.col("count") > limit).select(key), "large-groups")
    strangers = False
    if known is not None:
        strangers = not big.join(known.select(key), key, "left_anti").isEmpty()
        big = big.join(known.select(key), key, "left_semi")
    table = None if big.isEmpty() else big
    return LargeGroups(key, table=table, rows=total, strangers=strangers)


def grouped(
    rows: DataFrame,
    keys: list[str],
    percentiles: dict[str, tuple[str, float]],
    aggregates: list[Column],
    large: LargeGroups = NO_LARGE_GROUPS,
    approx: bool = False,
) -> DataFrame:
    """``groupBy(keys)`` with plain aggregates and exact percentiles ``{alias: (column, p)}``.

    ``approx=True`` swaps the exact percentiles for Spark's bounded-memory sketch.
    """
    usual, big = (rows, None) if approx else large.apart(rows)
    parts = []
    if usual is not None:
        parts.append(_one_aggregation(usual, keys, percentiles, aggregates, approx))
    if big is not None:
        parts.append(_split_aggregation(big, keys, percentiles, aggregates))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _one_aggregation(rows, keys, percentiles, aggregates, approx) -> DataFrame:
    """One percentile buffer per column, however many percentiles are asked of it."""
    wanted: dict[str, list[tuple[str, float]]] = {}
    for alias, (column, p) in percentiles.items():
        wanted.setdefault(column, []).append((alias, p))
    buffers = []
    for column, items in wanted.items():
        ps = F.array(*[F.lit(p) for _, p in items])
        measure = F.percentile_approx(column, ps, 10000) if approx else F.percentile(F.col(column), ps)
        buffers.append(measure.alias(f"_pct_{column}"))
    out = rows.groupBy(*keys).agg(*aggregates, *buffers)
    for column, items in wanted.items():
        for i, (alias, _) in enumerate(items):
            out = out.withColumn(alias, F.col(f"_pct_{column}")[i].cast("double"))
    return out.drop(*[f"_pct_{c}" for c in wanted])


def _split_aggregation(rows, keys, percentiles, aggregates) -> DataFrame:
    # A group of nulls only has no percentile but keeps its row; a null key is a key.
    base = rows.groupBy(*keys).agg(*aggregates) if aggregates else rows.select(*keys).distinct()
    quantiles = split_percentiles(rows, keys, percentiles).withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return base.join(quantiles, same, "left").drop(*[f"_k_{k}" for k in keys])


def split_percentiles(rows: DataFrame, keys: list[str], percentiles: dict[str, tuple[str, float]]) -> DataFrame:
    """Exact percentiles by narrowing value ranges; one row per key with a column per alias.

    Pass 1 counts the values of each group per logarithmic range (a few thousand ranges at most,
    whatever the group size) and finds the range holding each wanted rank. Pass 2 cuts those ranges
    into equal steps, pass 3 counts the distinct values of the one step that is left. Every count is
    partially aggregated before its shuffle and every window runs over ranges, not over rows. Equal
    values are counted together first, so that the joins never see a value that fills a partition.
    """
    metrics = sorted({column for column, _ in percentiles.values()})
    values = rows.select(
        *keys,
        F.explode(
            F.array(*[F.struct(F.lit(m).alias("_metric"), F.col(m).cast("double").alias("_v")) for m in metrics])
        ).alias("_m"),
    ).select(*keys, "_m._metric", "_m._v")
    # + 0.0 folds negative zero, so that equal values fall together.
    values = values.where(F.col("_v").isNotNull()).withColumn("_v", F.col("_v") + F.lit(0.0))
    values = values.groupBy(*keys, "_metric", "_v").agg(F.count(F.lit(1)).alias("_w"))
    # Monotone in the value, so ranges are ordered like the values they hold.
    values = values.withColumn(
        "_range", F.floor(F.signum("_v") * F.log1p(F.abs("_v")) * F.lit(float(LOG_STEPS))).cast("long")
    )
    group = keys + ["_metric"]

    ranges = values.groupBy(*group, "_range").agg(
        F.sum("_w").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )
    ranges = ranges.withColumn("_upto", F.sum("_n").over(_running(group, "_range"))).withColumn(
        "_total", F.sum("_n").over(W.partitionBy(*group))
    )
    asked = F.array(
        *[
            F.struct(F.lit(alias).alias("_alias"), F.lit(column).alias("_of"), F.lit(float(p)).alias("_p"))
            for alias, (column, p) in percentiles.items()
        ]
    )
    position = F.col("_ask._p") * (F.col("_total") - 1)
    targets = (
        ranges.withColumn("_ask", F.explode(F.filter(asked, lambda a: a["_of"] == F.col("_metric"))))
        .withColumn("_position", position)
        .withColumn(
            "_rank",
            F.explode(
                F.array_distinct(
                    F.array(F.floor("_position").cast("long"), F.ceil("_position").cast("long"))
                )
            ),
        )
        .where((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_n")))
        .select(
            *group,
            "_range",
            "_lo",
            "_hi",
            F.col("_ask._alias").alias("_alias"),
            "_position",
            "_rank",
            (F.col("_rank") - (F.col("_upto") - F.col("_n"))).alias("_local"),
        )
    )
    # Pass 2: equal steps inside the chosen ranges.
    chosen = targets.select(*group, "_range", "_lo", "_hi").distinct()
    width = F.col("_hi") - F.col("_lo")
    inside = values.join(chosen, group + ["_range"]).withColumn(
        "_step",
        F.when(width == 0, F.lit(0)).otherwise(F.floor((F.col("_v") - F.col("_lo")) / width * LINEAR_STEPS)).cast("long"),
    )
    in_range = group + ["_range"]
    steps = inside.groupBy(*in_range, "_step").agg(F.sum("_w").alias("_n"))
    steps = steps.withColumn("_upto", F.sum("_n").over(_running(in_range, "_step")))
    step_targets = (
        targets.join(steps, in_range)
        .where((F.col("_local") < F.col("_upto")) & (F.col("_local") >= F.col("_upto") - F.col("_n")))
        .select(
            *in_range,
            "_step",
            "_alias",
            "_position",
            "_rank",
            (F.col("_local") - (F.col("_upto") - F.col("_n"))).alias("_local"),
        )
    )

    # Pass 3: distinct values inside the chosen steps.
    in_step = in_range + ["_step"]
    few = inside.join(step_targets.select(*in_step).distinct(), in_step, "left_semi")
    counts = few.groupBy(*in_step, "_v").agg(F.sum("_w").alias("_n"))
    counts = counts.withColumn("_upto", F.sum("_n").over(_running(in_step, "_v")))
    found = (
        step_targets.join(counts, in_step)
        .where((F.col("_local") < F.col("_upto")) & (F.col("_local") >= F.col("_upto") - F.col("_n")))
        # Linear interpolation: the weight of a rank falls off with its distance from the position.
        .withColumn("_weight", 1.0 - F.abs(F.col("_position") - F.col("_rank")))
    )
    return found.groupBy(*keys).agg(
        *[
            F.sum(F.when(F.col("_alias") == alias, F.col("_v") * F.col("_weight"))).alias(alias)
            for alias in percentiles
        ]
    )


def _running(keys: list[str], order: str):
    return W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
