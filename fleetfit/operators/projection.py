"""Row-level projection: telemetry x moves x variants, all expanded map-side."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fleetfit import schemas as S
from fleetfit.catalog import InstanceCatalog
from fleetfit.functions import performance, projection as P
from fleetfit.operators.quantiles import NO_LARGE_GROUPS, LargeGroups, grouped
from fleetfit.operators.ranking import position_in_group

ENV = "environment_id"


@dataclass(frozen=True)
class Variant:
    """One set of assumptions and targets."""

    variant_id: str = "base"
    traffic_growth: float = 0.0
    cpu_pressure: float = 0.0
    memory_pressure: float = 0.0
    profile: str = "steady"
    latency_target: float = S.LATENCY_SLO_MS
    availability_target: float = S.AVAILABILITY_SLO
    max_cpu: float = S.MAX_SAFE_UTILIZATION
    max_mem: float = S.MAX_SAFE_UTILIZATION

    def __post_init__(self):
        if self.profile not in P.PROFILES:
            raise ValueError(f"unknown profile {self.profile!r}; expected one of {P.PROFILES}")


BASE = (Variant(),)
ROW_FIELDS = ["traffic_growth", "cpu_pressure", "memory_pressure", "profile", "availability_target"]
RESULT_FIELDS = [
    "variant_id",
    "traffic_growth",
    "cpu_pressure",
    "memory_pressure",
    "profile",
    "latency_target",
    "availability_target",
    "max_cpu",
    "max_mem",
]


def _literal(variant: Variant, names: list[str]) -> list[Column]:
    values = asdict(variant)
    return [
        F.lit(values[n] if isinstance(values[n], str) else float(values[n])).alias(n) for n in names
    ]


def with_variant_columns(rows: DataFrame, variants: tuple[Variant, ...]) -> DataFrame:
    """Attaches the fields of each row's variant by its number: a literal lookup, not a join."""
    if len(variants) == 1:
        fields = {n: c for n, c in zip(RESULT_FIELDS, _literal(variants[0], RESULT_FIELDS))}
    else:
        table = F.array(*[F.struct(*_literal(v, RESULT_FIELDS)) for v in variants])
        chosen = table[F.col("variant_no")]
        fields = {n: chosen[n] for n in RESULT_FIELDS}
    return rows.withColumns(fields)


def spike_key() -> Column:
    """Stable pseudo-random order of an environment's rows."""
    stamp = F.coalesce(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(""))
    return F.md5(F.concat(F.coalesce(F.col(ENV), F.lit("")), F.lit("|"), stamp).cast("binary"))


def time_order(telemetry: DataFrame) -> list[str]:
    """Columns that put an environment's rows in order of time, equal times by their measurements."""
    return ["timestamp", *sorted(m for m in S.METRICS if m in telemetry.columns)]


def with_profile_columns(
    telemetry: DataFrame, profiles: set[str], large: LargeGroups = NO_LARGE_GROUPS
) -> DataFrame:
    """Adds what the profiles need to know about a row's environment, as far as it is needed.

    ``is_peak``: at or above the environment's P90 of requests. ``is_spike``: among the first 5
    percent (at least one) of its rows in a hashed order, with all rows of the last key.
    ``position``: 0-based row number in time, null times first.

    Environments of a known bound are handled by windows over one exchange by environment, which
    the following aggregation reuses; large ones by counts per minute and per hash prefix. Both give
    the same, also for repeated keys and null timestamps.
    """
    if not profiles & {"peak", "bursty", "seasonal"}:
        return telemetry
    usual, big = large.apart(telemetry)
    parts = []
    if usual is not None:
        parts.append(_by_windows(usual, profiles))
    if big is not None:
        parts.append(_by_counts(big, profiles, large.inside()))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _spike_quota(rows: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(rows * F.lit(P.BURST_SHARE)))


def _by_windows(telemetry: DataFrame, profiles: set[str]) -> DataFrame:
    environment = W.partitionBy(ENV)
    rows = telemetry
    if "peak" in profiles:
        p90 = F.percentile("request_volume", F.lit(P.PEAK_QUANTILE)).over(environment)
        rows = rows.withColumn("is_peak", F.col("request_volume") >= p90)
    if "bursty" in profiles:
        rows = rows.withColumn("_key", spike_key())
        rows = rows.withColumn("_nth", F.row_number().over(environment.orderBy("_key")))
        quota = _spike_quota(F.count(F.lit(1)).over(environment))
        rows = rows.withColumn("_at", F.col("_nth") == quota)
        last = F.max(F.when(F.col("_at"), F.col("_key"))).over(environment)
        rows = rows.withColumn("is_spike", F.col("_key") <= last).drop("_key", "_nth", "_at")
    if "seasonal" in profiles:
        nth = F.row_number().over(environment.orderBy(*time_order(telemetry)))
        rows = rows.withColumn("position", nth.cast("long") - 1)
    return rows


def _by_counts(telemetry: DataFrame, profiles: set[str], large: LargeGroups) -> DataFrame:
    """The same columns with nothing but counts gathered per environment.

    One row per environment is joined back, by the planner's choice: hot keys are split.
    """
    rows = telemetry
    own = F.col(ENV).eqNullSafe(F.col("_env"))
    if "peak" in profiles:
        p90 = grouped(telemetry, [ENV], {"_p90": ("request_volume", P.PEAK_QUANTILE)}, [], large)
        rows = rows.join(p90.withColumnRenamed(ENV, "_env"), own, "left")
        rows = rows.withColumn("is_peak", F.col("request_volume") >= F.col("_p90")).drop("_p90", "_env")
    if "bursty" in profiles:
        keys = telemetry.select(ENV, spike_key().alias("_key"))
        keys = position_in_group(keys, [ENV], F.substring("_key", 1, 4), ["_key"], "_nth", total="_rows")
        last = keys.where(F.col("_nth") == _spike_quota(F.col("_rows"))).select(F.col(ENV).alias("_env"), F.col("_key").alias("_last"))
        rows = rows.join(last, own, "left").withColumn("is_spike", spike_key() <= F.col("_last")).drop("_last", "_env")
    if "seasonal" in profiles:
        rows = position_in_group(rows, [ENV], F.date_trunc("minute", "timestamp"), time_order(telemetry), "_nth")
        rows = rows.withColumn("position", F.col("_nth") - 1).drop("_nth")
    return rows


def _profile_factor(profile: Column, profiles: set[str]) -> Column:
    factor = F.when(F.lit(False), 1.0)
    if "peak" in profiles:
        factor = factor.when((profile == "peak") & F.col("is_peak"), P.PEAK_FACTOR)
    if "bursty" in profiles:
        factor = factor.when((profile == "bursty") & F.col("is_spike"), P.BURST_FACTOR)
    if "low-traffic" in profiles:
        factor = factor.when(profile == "low-traffic", P.LOW_TRAFFIC_FACTOR)
    if "seasonal" in profiles:
        factor = factor.when(profile == "seasonal", P.seasonal_factor(F.col("position")))
    return factor.otherwise(1.0)


def project_rows(
    telemetry: DataFrame,
    moves: DataFrame,
    catalog: InstanceCatalog,
    policy: str = "any",
    variants: tuple[Variant, ...] = BASE,
    large: LargeGroups = NO_LARGE_GROUPS,
    keep: tuple[str, ...] = (),
    unmoved: bool = False,
) -> DataFrame:
    """One row per reading, move and variant with the projected utilization, latency, availability.

    ``moves`` is keyed by environment and names the current type, and either the candidate (a
    request table, policy ``any``) or nothing more, in which case ``policy`` lists the candidates.
    Only the columns of the model and those in ``keep`` pass, so the expansion stays narrow.
    With ``unmoved``, environments the policy has no move for keep their rows, with a null candidate.
    The registry join is left to the planner: broadcast while the registry is small, shuffled with
    split hot keys beyond that.
    """
    spark = telemetry.sparkSession
    profiles = {v.profile for v in variants}
    on = ["current_instance_type"]
    if "candidate_instance_type" in moves.columns:
        on.append("candidate_instance_type")
    rows = with_profile_columns(telemetry, profiles, large)
    # A move or a registry row that is repeated is one move.
    registered = moves.select(ENV, *on).distinct()
    rows = rows.join(registered, ENV)
    if len(on) > 1:
        rows = catalog.ratios(rows)
    else:
        rows = rows.join(catalog.moves(spark, policy), on, "left" if unmoved else "inner")

    fields = [
        F.struct(F.lit(i).alias("variant_no"), *_literal(v, ROW_FIELDS))
        for i, v in enumerate(variants)
    ]
    # A literal array: the expansion is a map-side generate, not a join.
    rows = rows.withColumn("_variant", F.explode(F.array(*fields)) if len(fields) > 1 else fields[0])
    variant = F.col("_variant")

    requests = F.col("request_volume") * _profile_factor(variant["profile"], profiles) * (1.0 + variant["traffic_growth"])
    extra = [c for c in ("is_peak", "is_spike", "position") if c in rows.columns and c in keep]
    rows = rows.select(
        ENV,
        "current_instance_type",
        "candidate_instance_type",
        variant["variant_no"].alias("variant_no"),
        variant["availability_target"].alias("availability_target"),
        variant["cpu_pressure"].alias("_cpu_pressure"),
        variant["memory_pressure"].alias("_mem_pressure"),
        "cpu_utilization_pct",
        "memory_utilization_pct",
        "cpu_ratio",
        "mem_ratio",
        requests.alias("projected_requests"),
        P.request_ratio(requests, F.col("request_volume")).alias("_ratio"),
        *[c for c in keep if c in telemetry.columns and c not in (ENV, "cpu_utilization_pct", "memory_utilization_pct")],
        *extra,
    )
    rows = rows.select(
        ENV,
        "current_instance_type",
        "candidate_instance_type",
        "variant_no",
        "availability_target",
        "projected_requests",
        P.projected_utilization(
            F.col("cpu_utilization_pct"), F.col("cpu_ratio"), F.col("_ratio"), F.col("_cpu_pressure")
        ).alias("projected_cpu"),
        P.projected_utilization(
            F.col("memory_utilization_pct"), F.col("mem_ratio"), F.col("_ratio"), F.col("_mem_pressure")
        ).alias("projected_memory"),
        *[c for c in keep if c in rows.columns and c != ENV],
    )
    rows = rows.withColumn("pressure", performance.pressure(F.col("projected_cpu"), F.col("projected_memory")))
    return rows.withColumn("projected_latency", performance.projected_latency(F.col("pressure"))).withColumn(
        "projected_availability", performance.projected_availability(F.col("pressure"))
    )
