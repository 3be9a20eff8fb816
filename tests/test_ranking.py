"""Positions without a task per group."""

from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from fleetfit.operators.ranking import position_in_group, position_in_table


def test_position_in_group_equals_a_plain_row_number(spark):
    rng = np.random.default_rng(1)
    start = datetime(2024, 1, 1)
    rows = [("hot" if i % 3 else f"e{i % 7}", start + timedelta(seconds=int(s)), i) for i, s in enumerate(rng.integers(0, 90000, 3000))]
    df = spark.createDataFrame(rows, "k string, ts timestamp, id long")
    got = position_in_group(df, ["k"], F.date_trunc("hour", "ts"), ["ts", "id"], "nth", total="n")
    by = {}
    for k, ts, i in sorted(rows, key=lambda r: (r[1], r[2])):
        by.setdefault(k, []).append(i)
    want = {i: (n + 1, len(ids)) for ids in by.values() for n, i in enumerate(ids)}
    assert {r.id: (r.nth, r.n) for r in got.collect()} == want


def test_counted_positions(spark):
    rows = [("a", i, i % 2 == 0) for i in range(10)]
    df = spark.createDataFrame(rows, "k string, o long, even boolean")
    got = position_in_group(df, ["k"], F.floor(F.col("o") / 4), ["o"], "seen", counted=F.col("even"))
    assert {r.o: r.seen for r in got.collect()} == {i: i // 2 + 1 for i in range(10)}


def test_position_in_table_with_many_ties(spark):
    rows = [("SAFE" if i % 4 else "BLOCKED", float(i % 3), i) for i in range(500)]
    df = spark.createDataFrame(rows, "outcome string, saving double, seq long")
    got = position_in_table(df, [F.col("saving").desc(), F.col("seq").asc()], "rank", restart="outcome")
    want = {}
    for outcome in ("SAFE", "BLOCKED"):
        ordered = sorted((r for r in rows if r[0] == outcome), key=lambda r: (-r[1], r[2]))
        want |= {r[2]: i + 1 for i, r in enumerate(ordered)}
    assert {r.seq: r["rank"] for r in got.collect()} == want


def test_position_in_whole_table(spark):
    df = spark.range(0, 1000).select((F.lit(1000) - F.col("id")).alias("v"))
    got = position_in_table(df, [F.col("v").asc()], "rank")
    assert got.where("rank <> v").count() == 0 and got.count() == 1000


def test_rows_without_key_or_time_are_kept(spark):
    rows = [("a", None, 1), ("a", datetime(2024, 1, 1), 2), (None, None, 3), ("a", None, 4)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, id long")
    got = position_in_group(df, ["k"], F.date_trunc("hour", "ts"), ["ts", "id"], "nth", total="n")
    assert {r.id: (r.nth, r.n) for r in got.collect()} == {1: (1, 3), 4: (2, 3), 2: (3, 3), 3: (1, 1)}
