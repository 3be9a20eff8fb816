"""Helpers shared by the text operators: table access, scratch tables, words, row numbering."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from fleetfit import session

#: ASCII white space, the word separator of all operators (fixed values).
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Byte table that lower-cases A-Z only.
FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder once and read it from there: cuts the lineage, survives lost executors, and
    leaves no shuffle behind."""
    with session.shuffles_removed(df.sparkSession):
        return session.written(df, f"llm-{label}")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once. A plain reference would be copied into each use by the optimizer."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold(base: str, index: int) -> Column:
    """Whether crc32(id as text) has remainder 0 by ``index``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(base).cast("string"), F.lit("")).cast("binary")) % index == 0


def with_offsets(counted: DataFrame, keys: list[str], order: list[str], size: str, out: str) -> DataFrame:
    """Sum of ``size`` over all earlier rows of the same ``keys``; ``counted`` has one row per key and bucket."""
    earlier = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumn(out, F.coalesce(F.sum(size).over(earlier), F.lit(0)).cast("long"))
