"""Windowed baselines of a stream of readings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql import types as T

from fleetfit import schemas as S
from fleetfit import session
from fleetfit.operators.projection import ENV
from fleetfit.sources import adapters
from fleetfit.sources.commits import CommitTable
from fleetfit.streaming.runner import run_append, run_each, table_stream

LATENESS = "1 hour"
SUMMED = ["cpu", "memory", "latency", "availability"]
CLOCK = T.StructType([T.StructField(c, T.LongType()) for c in ("step", "closed", "seen")])


def windowed_baseline(
    readings: DataFrame,
    length: str = "1 day",
    slide: str | None = None,
    lateness: str = LATENESS,
    accuracy: int | None = None,
) -> DataFrame:
    """Baseline per environment and closed window, with the interpolated P95 of the batch form.

    State is one row per window, environment and value of the CPU, with a count and sums; when a
    window closes its values are put together, which is what a percentile needs and no more.

    That grows with the number of different values. With ``accuracy`` the state is one row per window
    and environment, with a quantile sketch of a size that ``accuracy`` bounds: its P95 is a reading
    whose rank among ``n`` is at most ``n / accuracy`` away from the wanted one. All else stays exact.

    With ``slide`` a reading is in the state once for every window that it is in; ``sliding_baseline`` has it once.
    """
    timed = readings.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    span = F.window("ts", length, slide) if slide else F.window("ts", length)
    if accuracy is not None:
        return _shown(_sketched(timed, span, accuracy))
    by_value = timed.groupBy(span, ENV, F.col("cpu").alias("value")).agg(*_sums())
    return _shown(by_value.groupBy("window", ENV).agg(*_metrics()))


def _sums() -> list[Column]:
    """What is kept of the readings of one CPU value."""
    return [
        F.count(F.lit(1)).alias("n"),
        *[F.sum(c).alias(f"sum_{c}") for c in SUMMED],
        *[F.count(c).alias(f"n_{c}") for c in SUMMED],
        F.max("memory").alias("peak"),
        F.count_if(F.col("availability") < S.AVAILABILITY_SLO).alias("violations"),
    ]


def _metrics() -> list[Column]:
    """The baseline from the sums per value."""
    mean = lambda c: F.sum(f"sum_{c}") / F.nullif(F.sum(f"n_{c}"), F.lit(0))
    return [
        F.sum("n").alias("readings"),
        mean("cpu").alias("mean_cpu"),
        F.max("value").alias("peak_cpu"),
        F.percentile("value", F.lit(0.95), F.col("n")).alias("p95_cpu"),
        mean("memory").alias("mean_memory"),
        F.max("peak").alias("peak_memory"),
        mean("latency").alias("mean_latency"),
        mean("availability").alias("measured_availability"),
        F.sum("violations").alias("slo_violations"),
    ]


def _sketched(timed: DataFrame, span: Column, accuracy: int) -> DataFrame:
    return timed.groupBy(span, ENV).agg(
        F.count(F.lit(1)).alias("readings"),
        F.avg("cpu").alias("mean_cpu"),
        F.max("cpu").alias("peak_cpu"),
        F.percentile_approx("cpu", F.lit(0.95), F.lit(accuracy)).alias("p95_cpu"),
        F.avg("memory").alias("mean_memory"),
        F.max("memory").alias("peak_memory"),
        F.avg("latency").alias("mean_latency"),
        F.avg("availability").alias("measured_availability"),
        F.count_if(F.col("availability") < S.AVAILABILITY_SLO).alias("slo_violations"),
    )


def _shown(windows: DataFrame) -> DataFrame:
    return windows.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "*").drop("window")


class SlidingWindows:
    """State of sliding baselines: sums per pane, environment and CPU value, the clock, and the closed windows.

    A pane is the longest stretch of time that every window holds whole or not at all, so a reading is stored and
    shuffled once and not once per window. Windows of an environment that follow each other and hold the same panes are
    worked out and written as one row, with the numbers of the first and the last of them.

    Windows are closed as in ``windowed_baseline``: a micro-batch still counts for all windows that no earlier one has
    closed, and closes those that end by the watermark of the earlier ones; ``finish`` closes by the watermark of the
    last. A micro-batch that is run again changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, readings: T.StructType, length: str, slide: str, lateness: str = LATENESS):
        self.spark = spark
        self.panes, self.closed, self.clock = (CommitTable(spark, f"{path}/{part}") for part in ("panes", "closed", "clock"))
        self.length, self.slide, self.delay = (_micros(spark, span) for span in (length, slide, lateness))
        if not 0 < self.slide <= self.length:
            raise ValueError(f"a slide of {slide} leaves time between windows of {length}")
        self.pane = math.gcd(self.length, self.slide)
        self.sums = self._summed(spark.createDataFrame([], readings)).schema
        self.runs = self._windows(spark.createDataFrame([], self.sums), 0, 0).schema

    def _summed(self, batch: DataFrame) -> DataFrame:
        pane = _down(F.unix_micros(F.col("ts").cast("timestamp")), self.pane).alias("pane")
        return batch.where("ts is not null").groupBy(pane, ENV, F.col("cpu").alias("value")).agg(*_sums())

    def _first(self) -> Column:
        """Number of the first window with the pane; a window's number is its start by the slide."""
        return _down(F.col("pane") * self.pane - self.length, self.slide) + 1

    def _last(self) -> Column:
        return _down(F.col("pane") * self.pane, self.slide)

    def _passed(self, micros: int) -> int:
        """Number of the last window that ends by a time."""
        return (micros - self.length) // self.slide

    def add(self, batch: DataFrame, batch_id: int) -> None:
        closed, seen = self._times(2 * batch_id)
        rows = self._summed(batch).where(self._last() > self._passed(closed))
        self.panes.append(rows, "baseline", batch_id)
        newest = _down(F.max(F.unix_micros(F.col("ts").cast("timestamp"))), 1000) * 1000 - self.delay
        self._close(2 * batch_id, closed, seen, batch.agg(F.greatest(newest, F.lit(seen)).alias("seen")))

    def finish(self) -> None:
        """Close the windows that the last micro-batch has left behind."""
        last = self.clock.read(CLOCK).agg(F.max("step")).first()[0]
        if last is not None and last % 2 == 0:
            closed, seen = self._times(last + 1)
            self._close(last + 1, closed, seen, self.spark.range(1).select(F.lit(seen).alias("seen")))

    def _times(self, step: int) -> tuple[int, int]:
        """The watermark whose windows are closed and the watermark of the readings seen, before a step."""
        rows = self.clock.read(CLOCK).where(F.col("step") < step)
        found = rows.agg(F.max("closed"), F.max("seen")).first()
        return found[0] or 0, found[1] or 0

    def _close(self, step: int, closed: int, seen: int, now: DataFrame) -> None:
        """Write the windows that end after ``closed`` and by ``seen``. Micro-batches are the even steps."""
        low, high = self._passed(closed) + 1, self._passed(seen)
        if low <= high:
            self.closed.append(self._windows(self.panes.read(self.sums), low, high), "baseline", step)
            self.closed.merge(lambda r: r, schema=self.runs)
        self.clock.append(now.select(F.lit(step).cast("long").alias("step"), F.lit(seen).cast("long").alias("closed"), "seen"), "clock", step)
        self.clock.merge(lambda rows: rows.agg(*[F.max(c).alias(c) for c in CLOCK.names]), schema=CLOCK)
        self.panes.merge(lambda r: r.where(self._last() > high), schema=self.sums)

    def _windows(self, sums: DataFrame, low: int, high: int) -> DataFrame:
        """Baselines of the windows ``low`` to ``high``, a row for each run (``first`` to ``last``) of windows of equal content.

        The windows are cut into blocks as long as the windows that hold one pane, so a pane is in two blocks at most.
        """
        many = -(-self.length // self.slide)
        end = F.least(F.col("block") * many + many - 1, F.lit(high))
        # A null environment is a group as any other; a join would leave it out.
        key = F.coalesce(F.concat(F.lit("="), F.col(ENV)), F.lit("")).alias("key")
        rows = sums.withColumns({"first": F.greatest(self._first(), F.lit(low)), "last": F.least(self._last(), F.lit(high))}).where("first <= last")
        blocks = F.sequence(_down(F.col("first"), many), _down(F.col("last"), many))
        rows = rows.select(key, F.explode(blocks).alias("block"), "first", "last", *[c for c in sums.columns if c not in ("pane", ENV)])
        rows = rows.withColumns({"first": F.greatest("first", F.col("block") * many), "last": F.least("last", end)})
        rows = rows.repartition("key", "block")
        starts = F.explode(F.array("first", F.when(F.col("last") < end, F.col("last") + 1))).alias("start")
        cuts = rows.select("key", "block", starts).where("start is not null").distinct()
        following = F.lead("start").over(W.partitionBy("key", "block").orderBy("start"))
        cuts = cuts.withColumn("stop", F.coalesce(following - 1, end))
        # By size a broadcast would be chosen for tables that take few bytes a row.
        held = rows.join(cuts.hint("merge"), ["key", "block"]).where("start between first and last")
        found = held.groupBy("key", "block", "start", "stop").agg(*_metrics())
        env = F.when(F.col("key") != "", F.expr("substring(key, 2)")).alias(ENV)
        return found.select(F.col("start").alias("first"), F.col("stop").alias("last"), env, *found.columns[4:])

    def baselines(self) -> DataFrame:
        """A row per environment and closed window."""
        runs = self.closed.read(self.runs)
        rows = runs.select(F.explode(F.sequence("first", "last")).alias("number"), *runs.columns[2:])
        start = F.col("number") * self.slide
        times = [F.timestamp_micros(start).alias("window_start"), F.timestamp_micros(start + self.length).alias("window_end")]
        return rows.select(*times, *runs.columns[2:])


def _down(number: Column, by: int) -> Column:
    """``number / by`` rounded down."""
    return ((number - F.pmod(number, F.lit(by))) / by).cast("long")


def _micros(spark: SparkSession, span: str) -> int:
    return spark.sql(f"SELECT unix_micros(timestamp_micros(0) + INTERVAL {span})").first()[0]


def sliding_baseline(
    readings: DataFrame, length: str = "1 day", slide: str = "1 hour", lateness: str = LATENESS, path: str | None = None
) -> DataFrame:
    """Run a stream of readings over all available input; what ``windowed_baseline`` gives for the closed windows.

    With ``path`` a later run goes on from the open windows that an earlier one left there."""
    spark = readings.sparkSession
    own = path or session.scratch_path(spark, "stream-sliding")
    windows = SlidingWindows(spark, own, readings.schema, length, slide, lateness)
    run_each(readings, "stream-sliding", windows.add, checkpoint=f"{own}/progress")
    windows.finish()
    return windows.baselines()


def run(spark: SparkSession, sf_dir: str, slide: str | None = None) -> DataFrame:
    readings = adapters.readings_of(table_stream(spark, sf_dir, "events"))
    if slide:
        return sliding_baseline(readings, slide=slide)
    return run_append(windowed_baseline(readings), "stream-baseline")
