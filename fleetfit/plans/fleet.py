"""The inputs of a fleet analysis and the composed questions to them."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetfit import session
from fleetfit.catalog import DEFAULT_CATALOG, InstanceCatalog
from fleetfit.operators import baseline, portfolio, validation, whatif
from fleetfit.operators.projection import BASE, ENV, Variant
from fleetfit.operators.quantiles import LargeGroups, find_large_groups
from fleetfit.sources import adapters, merge, readers

@dataclass(frozen=True)
class Fleet:
    """Raw telemetry with its input order, the registry, prices and the catalog.

    ``validate=False`` takes the telemetry as it is. The number of rows, and only in a table of more
    rows than a group may have the rows per environment, are looked at before the plan is built.
    """

    spark: SparkSession
    raw: DataFrame
    order: list[str]
    environments: DataFrame
    pricing: DataFrame
    catalog: InstanceCatalog = DEFAULT_CATALOG
    validate: bool = True

    @cached_property
    def large(self) -> LargeGroups:
        """Registered environments of many rows."""
        return find_large_groups(self.raw, known=self.environments)

    @property
    def input(self) -> DataFrame:
        """The raw telemetry with the rows of unregistered ids, as the validation report needs them."""
        return self.raw

    @cached_property
    def known(self) -> DataFrame:
        """The raw telemetry, brought together by environment unless a registered one is large.

        Keep-first, the registry joins, the windows of the profiles and the aggregations all run on
        this one exchange. With a large environment rows stay spread by (timestamp, environment).
        Rows of an unregistered id, if they are many, are dropped before the exchange.
        """
        strangers = self.validate and self.large.strangers
        rows = validation.known_environments(self.raw, self.environments) if strangers else self.raw
        return rows if self.large else rows.repartition(session.partitions_for(self.spark, self.large.rows), ENV)

    @cached_property
    def telemetry(self) -> DataFrame:
        if not self.validate:
            return validation.without_nan(self.known.drop(*self.order))
        return validation.clean(self.known, self.order, self.environments)

    @cached_property
    def table(self) -> DataFrame:
        """The clean telemetry as a table in the shared folder.

        For questions that pass over the telemetry more than twice: the table is read with only the
        columns of each pass, where the plan alone would sort the whole input again for every pass.
        """
        return session.written(self.telemetry, "telemetry")

    @property
    def passes(self) -> DataFrame:
        """The telemetry to aggregate: the table where large environments need several passes."""
        return self.table if self.large else self.telemetry

    def what_if(self, policy: str, variants: tuple[Variant, ...] = BASE, **options) -> DataFrame:
        return whatif.what_if(
            self.passes, self.environments, self.pricing, self.catalog, policy, variants, large=self.large, **options
        )

    def decided(
        self, policy: str, variants: tuple[Variant, ...] = BASE, texts: bool = False, grades: DataFrame | None = None, **options
    ) -> DataFrame:
        """Decided what-if rows; ``grades`` (environment, quality) turns those of LOW quality to INSUFFICIENT DATA."""
        result = self.what_if(policy, variants, **options)
        if grades is None:
            return whatif.decide(result, texts=texts)
        graded = result.join(grades.select(ENV, "quality"), ENV, "left")
        return whatif.decide(graded, F.coalesce("quality", F.lit("HIGH")), texts=texts).drop("quality")

    @property
    def grades(self) -> DataFrame:
        """Quality grade of each environment's raw telemetry."""
        return validation.quality_grade(self.input, self.order, by=ENV).select(ENV, "quality")

    def simulate(
        self, moves: list[tuple[str, str, str]], variants: tuple[Variant, ...] = BASE, **options
    ) -> DataFrame:
        """Decided what-if rows of named (environment, current type, candidate) moves.

        The environments are filtered before anything else, so the filter reaches the scan and only
        their rows are counted. A move
        whose environment has no telemetry is INSUFFICIENT DATA.
        """
        requests = session.local_rows(self.spark, moves, {name: pa.string() for name in whatif.MOVE})
        named = replace(self, raw=self.raw.where(F.col(ENV).isin([m[0] for m in moves])))
        result = whatif.what_if(
            named.passes, requests, self.pricing, self.catalog, variants=variants, large=named.large, **options
        )
        decided = whatif.decide(whatif.keep_all_moves(requests, result), texts=True)
        return whatif.name_unknown_types(decided, self.catalog)

    def named(self, environments: list[str]) -> Fleet:
        """The fleet of a few environments: their filter reaches the scans of telemetry and registry."""
        own = F.col(ENV).isin(environments)
        return replace(self, raw=self.raw.where(own), environments=self.environments.where(own))

    def baseline(self, families: list[str] | None = None) -> DataFrame:
        return baseline.baseline(self.passes, families, self.large)

    def portfolio(self, variant: Variant = BASE[0]) -> DataFrame:
        """The portfolio under the assumptions, targets and limits of ``variant``."""
        return portfolio.detail(self.passes, self.environments, self.pricing, self.catalog, self.large, variant=variant)

    def naive(self) -> DataFrame:
        return whatif.naive_step_down(self.passes, self.environments, self.catalog)


def table_fleet(spark: SparkSession, sf_dir: str) -> Fleet:
    """The fleet over the given test tables."""
    session.tune(spark)
    return Fleet(
        spark,
        adapters.telemetry_raw(spark, sf_dir),
        adapters.INGEST_ORDER,
        adapters.environments(spark, sf_dir),
        adapters.pricing(spark, sf_dir),
    )


def folder_fleet(
    spark: SparkSession,
    folder: str,
    fmt: str = "csv",
    catalog: InstanceCatalog = DEFAULT_CATALOG,
    prejoined: bool = False,
    validate: bool = True,
) -> Fleet:
    """The fleet over a folder with the registry, the price history and the telemetry.

    Telemetry is merged from the five metric histories and written once, or read from
    ``full_telemetry`` where ``prejoined``. Merged histories of unique keys have no duplicates left
    to order.
    """
    session.tune(spark)
    if prejoined:
        raw = readers.full_telemetry(spark, folder, fmt, ordered=True).drop("instance_type")
        order = readers.INPUT_ORDER
    else:
        merged = session.written(merge.merge_histories(readers.histories(spark, folder, fmt)), "merged")
        raw, order = merged.withColumn("_row", F.lit(0)), ["_row"]
    return Fleet(
        spark,
        raw,
        order,
        readers.environments(spark, folder, fmt),
        readers.pricing(spark, folder, fmt),
        catalog,
        validate,
    )
