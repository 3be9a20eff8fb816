"""Mixing sources to target weights with a low-discrepancy schedule, in DataFrame operations.

Every source's documents are shuffled by a hash of their ids and laid end to end; that stream of words is cut into blocks
of equal size. The mix is a sequence of slots, each of one block. Slot ``i`` belongs to the source in whose cumulative
share the fractional part of ``i`` times the golden ratio falls, so every stretch of the mix has nearly the target shares.
The slots of a source, ranked, take its blocks in turn, beginning anew after the last; the last slot takes what is left of
the target, and slots that the schedule leaves short of a target follow at the end.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from fleetfit.llm.common import WORD, stored, text_of, with_offsets

BLOCK_WORDS = 512
REPEATS = 3
WEIGHTS = (1, 2, 3)
GOLDEN = (math.sqrt(5) - 1) / 2
ROWS_PER_BUCKET = 20_000
SLOTS_PER_PART = 50_000


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``id``, ``source``, ``size`` in words, and the place in the shuffled order (``h``; ``n`` numbers equal rows)."""
    words = F.size(F.regexp_extract_all(text_of(text_col), F.lit(WORD), F.lit(0))).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words.alias("size"))
    rows = rows.withColumn("h", F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")))
    # Rows that agree in id, source and size are interchangeable; each takes its own place.
    return rows.groupBy("id", "source", "size", "h").agg(F.count(F.lit(1)).alias("copies")).withColumn(
        "n", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    ).drop("copies")


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """One row per source: ``source``, ``source_size``, ``weight``, ``target`` (double), ``words`` (the target in words).

    The shares are those of filling vessels of height ``repeats * size / weight``: sources in the order of that height
    are at their limit as long as the level that the rest would reach is above it.
    """
    total = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(ranked) - 1) % len(weights)
    table = total.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (place + 1).cast("int")).cast("long"))
    table = table.withColumn("most", F.col("source_size") * repeats)
    full = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    table = table.withColumn("all_size", F.sum("source_size").over(every)).withColumn("all_weight", F.sum("weight").over(every))
    table = table.withColumn("left_size", F.col("all_size") - F.coalesce(F.sum("most").over(before), F.lit(0)))
    table = table.withColumn("left_weight", F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    table = table.withColumn("limited", F.col("most") * F.col("left_weight") <= F.col("left_size") * F.col("weight"))
    spent = F.coalesce(F.sum(F.when(F.col("limited"), F.col("most"))).over(every), F.lit(0))
    gone = F.coalesce(F.sum(F.when(F.col("limited"), F.col("weight"))).over(every), F.lit(0))
    level = (F.col("all_size") - spent).cast("double") / (F.col("all_weight") - gone)
    table = table.withColumn("target", F.when(F.col("limited"), F.col("most").cast("double")).otherwise(level * F.col("weight")))
    words = F.least(F.floor(F.col("target") + 0.5), F.col("most")).cast("long")
    return table.select("source", "source_size", "weight", "target", words.alias("words"))


def streamed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``start``: the words before the document in its source's shuffled stream.

    A source may hold most rows: its stream is added up over buckets of the hash first, then within each bucket.
    """
    spark = rows.sparkSession
    rows = stored(rows, "sizes")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // ROWS_PER_BUCKET)
    digits = F.conv(F.substring("h", 1, 8), 16, 10).cast("long")
    bucketed = rows.withColumn("bucket", F.floor(digits * buckets / 2**32))
    sums = bucketed.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    sums = stored(with_offsets(sums, ["source"], ["bucket"], "in_bucket", "before").drop("in_bucket"), "bucket-sums")
    joined = bucketed.alias("r").join(
        sums.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.bucket") == F.col("s.bucket"))
    ).select("r.*", "before")
    inside = Window.partitionBy("source", "bucket").orderBy("h", "id", "size", "n").rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn("start", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))).drop("before", "bucket", "h")


def _points(slots: DataFrame) -> DataFrame:
    """Fractional part of ``slot`` times the golden ratio, without losing digits for large numbers."""
    step = 2**24
    high = F.floor(F.col("slot") / step) * math.fmod(step * GOLDEN, 1.0)
    low = (F.col("slot") % step) * GOLDEN
    both = (high - F.floor(high)) + (low - F.floor(low))
    return slots.withColumn("point", both - F.floor(both))


def schedule(goals: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The slots of the mix, from the result of ``targets``: ``slot``, ``source``, ``rank`` within the source (from 0),
    ``block`` and ``take``, the words taken from its beginning.

    Each round takes all blocks of a source once; the last of a source is short if its size is no multiple of a block.
    """
    spark = goals.sparkSession
    upto = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    share = goals.where("words > 0").withColumn("high", F.sum("words").over(upto))
    share = share.withColumn("total", F.sum("words").over(Window.partitionBy())).withColumn("low", F.col("high") - F.col("words"))
    blocks = F.ceil(F.col("source_size") / block_words)
    rounds = F.floor(F.col("words") / F.col("source_size"))
    rest = F.ceil((F.col("words") - rounds * F.col("source_size")) / block_words)
    share = stored(
        share.select(
            "source",
            "words",
            "source_size",
            (F.col("low") / F.col("total")).alias("low"),
            (F.col("high") / F.col("total")).alias("high"),
            blocks.alias("blocks"),
            (rounds * blocks + rest).alias("needed"),
        ),
        "shares",
    )
    slots, sources = share.agg(F.sum("needed"), F.count(F.lit(1))).first()
    slots = slots or 0
    # Points meet their interval by an equality on a grid; an interval lies in the cells that it touches.
    grid = max(1024, 4 * sources)
    cells = share.select("source", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * grid), F.floor(F.col("high") * grid))).alias("cell"))
    points = _points(spark.range(slots).withColumnRenamed("id", "slot")).withColumn("cell", F.floor(F.col("point") * grid))
    drawn = points.join(cells, "cell").where("point >= low and point < high")
    drawn = stored(drawn.select("slot", "source", F.floor(F.col("slot") / SLOTS_PER_PART).alias("part")), "slots")
    counts = drawn.groupBy("source", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = stored(with_offsets(counts, ["source"], ["part"], "n", "before"), "slot-counts")
    first = F.row_number().over(Window.partitionBy("source", "part").orderBy("slot")) - 1
    ranked = (
        drawn.withColumn("place", first)
        .join(counts.select(F.col("source").alias("s"), F.col("part").alias("p"), "before"), F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
        .select("slot", "source", (F.col("before") + F.col("place")).alias("rank"))
    )
    got = counts.groupBy(F.col("source").alias("s")).agg(F.sum("n").alias("got"))
    short = share.join(got, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("got", F.coalesce("got", F.lit(0)))
    added = short.where("got < needed").select("source", F.explode(F.sequence("got", F.col("needed") - 1)).alias("rank"))
    added = added.select((F.lit(slots) + F.col("rank")).alias("slot"), "source", "rank")
    place = share.select(F.col("source").alias("s"), "words", "source_size", "blocks", "needed")
    every = ranked.unionByName(added).join(place, F.col("source").eqNullSafe(F.col("s"))).where("rank < needed")
    every = every.withColumn("block", F.col("rank") % F.col("blocks"))
    gone = F.floor(F.col("rank") / F.col("blocks")) * F.col("source_size") + F.col("block") * block_words
    size = F.least(F.lit(block_words), F.col("source_size") - F.col("block") * block_words)
    return every.select("slot", "source", "rank", "block", F.least(size, F.col("words") - gone).cast("long").alias("take"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per row of ``docs``: id, ``source``, ``size``, ``source_size``, ``target``, ``taken``.

    A null text has no words; a null source is a source of its own, ranked last; a source without words has target 0.
    The order depends on ids only, so reruns agree; of repeated rows each has its own place. Empty in, empty out.
    """
    rows = stored(streamed(sizes(docs, id_col, text_col, source_col)), "streams")
    goals = stored(targets(rows), "targets")
    taken = schedule(goals, block_words).select(F.col("source").alias("s"), F.col("block").alias("b"), "take")
    end = F.col("start") + F.col("size")
    row = ["id", "source", "size", "n", "start"]
    spans = rows.where("size > 0").withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((end - 1) / block_words)))
    )
    met = spans.join(taken, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), "left")
    origin = F.col("block") * block_words
    part = F.greatest(F.lit(0), F.least(end, origin + F.col("take")) - F.greatest(F.col("start"), origin))
    words = met.withColumn("part", F.when(F.col("take").isNull(), 0).otherwise(part)).groupBy(*row).agg(F.sum("part").alias("taken"))
    empty = rows.where("size = 0").select(*row).withColumn("taken", F.lit(0).cast("long"))
    known = goals.select(F.col("source").alias("s"), "source_size", "target")
    return words.unionByName(empty).join(known, F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", F.col("taken").cast("long").alias("taken")
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The mix as whole documents: each row of ``docs`` as often as the words taken from it fill it, rounded.

    Documents without words bring no words and stay as they are. Of rows that share id, source and size, all repeat as
    often as the words taken from them together demand on average, rounded.
    """
    found = mix(docs).groupBy("doc_id", "source", "size").agg((F.sum("taken") / F.count(F.lit(1))).alias("words"))
    times = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("words") / F.col("size") + 0.5)).cast("int")
    times = found.select(
        F.col("doc_id").alias("_mix_id"), F.col("source").alias("_mix_source"), F.col("size").alias("_mix_size"), times.alias("_mix_times")
    )
    sized = docs.withColumn("_own_size", F.size(F.regexp_extract_all(text_of(), F.lit(WORD), F.lit(0))).cast("long"))
    same = sized["doc_id"].eqNullSafe(times["_mix_id"]) & sized["source"].eqNullSafe(times["_mix_source"]) & (sized["_own_size"] == times["_mix_size"])
    rows = sized.join(times, same).where("_mix_times > 0").withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), "_mix_times")))
    return rows.select(*docs.columns)
