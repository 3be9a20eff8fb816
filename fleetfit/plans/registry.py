"""Every operator as a query over the given tables: ``name -> (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fleetfit import schemas as S
from fleetfit import session
from fleetfit.functions import labels
from fleetfit.functions.common import r6, text_list
from fleetfit.operators import (
    accuracy,
    audit,
    audit_order,
    baseline,
    candidates,
    cost,
    daily,
    errors,
    gate,
    health,
    portfolio,
    scenarios,
    sensitivity,
    validation,
    views,
    whatif,
)
from fleetfit.operators.projection import ENV, Variant, project_rows, with_profile_columns
from fleetfit.operators.ranking import position_in_group
from fleetfit.plans.fleet import Fleet, table_fleet
from fleetfit.sources import adapters, bucketed, clustered, merge, readers, sinks
from fleetfit.streaming import audit as stream_audit_sink
from fleetfit.streaming import baseline as stream_baselines
from fleetfit.streaming import health as stream_healths
from fleetfit.streaming import validate as stream_validation

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

MOVE = whatif.MOVE
#: Buckets of stored histories: some 100 MB of a year's readings each.
BUCKETS = 8
DAY = "yyyy-MM-dd HH:mm:ss"
INSTANT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
TIGHT = Variant("tight_slo", latency_target=54.0, availability_target=99.99)


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def shown(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows as they are compared: rounded doubles, text for times and lists, wide integers."""
    out = []
    for name, kind in rows.dtypes:
        if columns and name not in columns:
            continue
        col = F.col(name)
        if kind == "double":
            col = r6(col)
        elif kind.startswith("timestamp"):
            col = F.date_format(col, INSTANT)
        elif kind == "date":
            col = F.date_format(col, "yyyy-MM-dd")
        elif kind.startswith("array"):
            col = text_list(col)
        elif kind in ("int", "smallint", "tinyint"):
            col = col.cast("long")
        out.append(col.alias(name))
    return rows.select(*out)


def _histories(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The five histories: raw telemetry after keep-first, each with its own gaps.

    Written once, as five stored tables would be; each history then reads its own column.
    """
    fleet = table_fleet(spark, sf_dir)
    firsts = session.written(validation.keep_first(fleet.input, fleet.order), "firsts")
    return {
        name: firsts.where(adapters.in_history(gap)).select(*S.KEYS, S.HISTORIES[name])
        for name, gap in adapters.HISTORY_GAPS.items()
    }


# --- sources and sinks -------------------------------------------------------------------------


@query
def src_environments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(adapters.environments(spark, sf_dir))


@query
def src_metric_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and range of each history per environment."""
    parts = [
        h.groupBy(ENV).agg(
            F.count(F.lit(1)).alias("readings"),
            F.count(S.HISTORIES[name]).alias("known_readings"),
            F.min(S.HISTORIES[name]).alias("lowest"),
            F.max(S.HISTORIES[name]).alias("highest"),
        ).withColumn("history", F.lit(name))
        for name, h in _histories(spark, sf_dir).items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return shown(out)


@query
def src_telemetry_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The histories come out of keep-first, so their keys are unique by construction.
    return shown(merge.merge_histories(_histories(spark, sf_dir), unique=True))


@query
def src_bucketed_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histories saved in buckets, in two writes, and merged without a shuffle."""
    path, histories = session.scratch_path(spark, "bucketed"), _histories(spark, sf_dir)
    store = bucketed.BucketedHistories(spark, f"fleetfit_{path.rpartition('-')[2]}", path, BUCKETS)
    early = F.col("timestamp") < F.lit("1995-06-17").cast("timestamp_ntz")
    store.append({name: h.where(early) for name, h in histories.items()})
    store.append({name: h.where(~early) for name, h in histories.items()})
    return shown(store.merged())


@query
def src_pricing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(adapters.pricing(spark, sf_dir))


@query
def src_full_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry beside the environment's type, summed up per environment and type."""
    fleet = table_fleet(spark, sf_dir)
    full = fleet.telemetry.join(
        fleet.environments.select(ENV, F.col("current_instance_type").alias("instance_type")), ENV
    )
    return shown(
        full.groupBy(ENV, "instance_type").agg(
            F.count(F.lit(1)).alias("readings"),
            F.min("timestamp").alias("first_reading"),
            F.max("timestamp").alias("last_reading"),
            F.avg("cpu_utilization_pct").alias("mean_cpu"),
            F.sum("request_volume").alias("requests"),
        )
    )


@query
def src_env_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    fleet = table_fleet(spark, sf_dir)
    wanted = adapters.requests(spark, sf_dir).select(ENV)
    found = readers.lookup(wanted, fleet.environments, fleet.telemetry)
    return shown(
        found.select(
            ENV,
            "found",
            F.coalesce("service_name", F.lit("none")).alias("service_name"),
            F.coalesce("current_instance_type", F.lit("none")).alias("current_instance_type"),
            F.coalesce("readings", F.lit(0)).alias("readings"),
        )
    )


@query
def src_clustered_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry written clustered by environment, and what it holds of the stopped environments."""
    fleet = table_fleet(spark, sf_dir)
    store = clustered.ClusteredTelemetry(spark, session.scratch_path(spark, "clustered"))
    store.write(fleet.telemetry, rows_per_file=5_000)
    stopped = fleet.environments.where("status = 'STOPPED'").select(ENV)
    found = store.lookup(stopped.union(stopped.select(F.lit("env-unknown")).distinct()), fleet.environments)
    return shown(found.select(ENV, "found", F.coalesce("readings", F.lit(0)).alias("readings")))


@query
def sink_metric_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five tables written from wide telemetry, read back and summed up."""
    fleet = table_fleet(spark, sf_dir)
    paths = sinks.write_histories(fleet.table, session.scratch_path(spark, "histories"))
    out = None
    for name, path in paths.items():
        metric = S.HISTORIES[name]
        part = spark.read.schema(S.history_schema(metric)).parquet(path)
        part = part.groupBy(ENV).agg(F.count(metric).alias("readings"), F.sum(metric).alias("total"))
        part = part.withColumn("metric", F.lit(metric))
        out = part if out is None else out.unionByName(part)
    return shown(out)


@query
def sink_audit_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger after two appends, one of them repeated, summed up per day and event."""
    path = session.scratch_path(spark, "ledger")
    events = adapters.audit(spark, sf_dir)
    started = F.col("event") == "PRECHECK_STARTED"
    sinks.append_audit(events.where(started), path, "started", 0)
    sinks.append_audit(events.where(~started), path, "others", 0)
    sinks.append_audit(events.where(started), path, "started", 0)
    ledger = readers.audit_log(spark, path)
    return shown(ledger.groupBy("event_date", "event").agg(F.count(F.lit(1)).alias("events")))


@query
def src_audit_by_env(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of every environment with their number in write order."""
    ledger = adapters.audit(spark, sf_dir)
    numbered = position_in_group(ledger, [ENV], F.date_trunc("minute", "timestamp"), ["timestamp", "seq"], "entry")
    return shown(numbered, ENV, "entry", "timestamp", "seq", "event")


@query
def sink_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decided step-down moves written as CSV and read back."""
    fleet = table_fleet(spark, sf_dir)
    decided = fleet.decided("step_down").select(*MOVE, "decision", "reason_codes", "row_count")
    path = session.scratch_path(spark, "results")
    sinks.write_results(decided, path)
    schema = ", ".join(f"{c} string" for c in [*MOVE, "decision", "reason_codes"]) + ", row_count long"
    read = spark.read.schema(schema).option("header", True).csv(path)
    return shown(read.fillna("", ["reason_codes"]))


# --- validation --------------------------------------------------------------------------------


@query
def val_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required columns of the raw telemetry, whole and with a column missing."""
    raw = adapters.telemetry_raw(spark, sf_dir)
    whole = validation.schema_report(raw).withColumn("input", F.lit("telemetry"))
    part = validation.schema_report(raw.drop("availability_pct")).withColumn("input", F.lit("without availability"))
    return shown(whole.unionByName(part))


@query
def val_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text timestamps, some of which do not parse: the verdict on the whole input and on each part."""
    raw = adapters.telemetry_raw(spark, sf_dir)
    text = F.when(F.col("l_orderkey") % 101 == 1, "not a time").otherwise(F.date_format("timestamp", DAY))
    rows = raw.withColumn("timestamp", text)
    whole = validation.timestamp_check(rows).withColumn(ENV, F.lit("(all)"))
    return shown(validation.timestamp_check(rows, by=ENV).unionByName(whole))


@query
def val_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    fleet = table_fleet(spark, sf_dir)
    return shown(validation.keep_first(fleet.input, fleet.order))


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    fleet = table_fleet(spark, sf_dir)
    return validation.tagged(fleet.input, fleet.order, fleet.environments)


def _rule_effect(spark: SparkSession, sf_dir: str, rule: str) -> DataFrame:
    """Per environment: rows that reach the rule, and rows it removes."""
    names = [name for name, _ in validation.RULES]
    earlier = names[1 : names.index(rule)]
    failed = F.coalesce("failed_rule", F.lit("none"))
    return shown(
        _tagged(spark, sf_dir)
        .where(~failed.isin(*earlier) if earlier else F.lit(True))
        .groupBy(ENV)
        .agg(F.count(F.lit(1)).alias("reached_rows"), F.count_if(failed == rule).alias("removed_rows"))
    )


@query
def val_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule_effect(spark, sf_dir, "missing")


@query
def val_cpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule_effect(spark, sf_dir, "cpu")


@query
def val_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule_effect(spark, sf_dir, "memory")


@query
def val_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule_effect(spark, sf_dir, "requests")


@query
def val_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule_effect(spark, sf_dir, "latency")


@query
def val_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule_effect(spark, sf_dir, "availability")


@query
def val_known_env(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule_effect(spark, sf_dir, "unknown_environment")


@query
def val_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(table_fleet(spark, sf_dir).telemetry)


@query
def val_issue_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    fleet = table_fleet(spark, sf_dir)
    return shown(validation.issue_report(fleet.input, fleet.order, fleet.environments))


@query
def val_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of the whole input and of each environment's part of it."""
    fleet = table_fleet(spark, sf_dir)
    judged = validation.status_and_parts(fleet.input, fleet.order, fleet.environments)
    return shown(judged.withColumn("issue", F.coalesce("issue", F.lit(""))))


@query
def val_quality_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    fleet = table_fleet(spark, sf_dir)
    return shown(validation.graded(validation.status_and_parts(fleet.input, fleet.order)))


# --- baselines ---------------------------------------------------------------------------------


@query
def base_cpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(table_fleet(spark, sf_dir).baseline(["cpu"]))


@query
def base_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(table_fleet(spark, sf_dir).baseline(["memory"]))


@query
def base_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(table_fleet(spark, sf_dir).baseline(["traffic"]))


@query
def base_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(table_fleet(spark, sf_dir).baseline(["latency"]))


@query
def base_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(table_fleet(spark, sf_dir).baseline(["reliability"]))


@query
def base_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(table_fleet(spark, sf_dir).baseline())


@query
def base_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baselines from daily counts: days that lack some environments, later days, then the early days once more, complete."""
    readings = table_fleet(spark, sf_dir).table
    counts = daily.DailyCounts(spark, session.scratch_path(spark, "daily-counts"))
    early = F.col("timestamp") < F.lit("1998-01-01").cast("timestamp_ntz")
    counts.update(readings.where(early & (F.crc32(ENV) % 5 != 0)), 0)
    counts.update(readings.where(~early), 1)
    counts.update(readings.where(early), 2)
    return shown(counts.baseline())


# --- projection --------------------------------------------------------------------------------


def _projected(spark: SparkSession, sf_dir: str, policy: str, variant: Variant, *flags: str) -> DataFrame:
    fleet = table_fleet(spark, sf_dir)
    return project_rows(
        fleet.passes,
        fleet.environments,
        fleet.catalog,
        policy,
        (variant,),
        fleet.large,
        keep=("timestamp", *flags),
    )


def _projection(spark: SparkSession, sf_dir: str, policy: str, variant: Variant, *flags: str) -> DataFrame:
    rows = _projected(spark, sf_dir, policy, variant, *flags)
    return shown(
        rows.select(ENV, "candidate_instance_type", "timestamp", "projected_requests", "projected_cpu", "projected_memory", *flags)
    )


@query
def proj_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _projection(spark, sf_dir, "cheaper", Variant())


@query
def proj_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _projection(spark, sf_dir, "step_down", Variant(traffic_growth=0.2))


@query
def proj_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _projection(spark, sf_dir, "step_down", Variant(cpu_pressure=0.1, memory_pressure=0.2))


@query
def proj_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _projection(spark, sf_dir, "step_down", Variant(profile="peak"))


@query
def proj_bursty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _projection(spark, sf_dir, "step_down", Variant(profile="bursty"), "is_spike")


@query
def proj_low_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _projection(spark, sf_dir, "step_down", Variant(profile="low-traffic"))


@query
def proj_seasonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _projection(spark, sf_dir, "step_down", Variant(profile="seasonal"), "position")


@query
def proj_steady(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _projection(spark, sf_dir, "step_down", Variant())


# --- performance and SLO -----------------------------------------------------------------------


@query
def perf_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _projected(spark, sf_dir, "cheaper", Variant())
    return shown(rows, ENV, "candidate_instance_type", "timestamp", "pressure")


@query
def perf_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _projected(spark, sf_dir, "cheaper", Variant())
    return shown(rows, ENV, "candidate_instance_type", "timestamp", "projected_latency")


@query
def perf_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _projected(spark, sf_dir, "cheaper", Variant())
    return shown(rows, ENV, "candidate_instance_type", "timestamp", "projected_availability")


@query
def slo_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = table_fleet(spark, sf_dir).what_if("cheaper", (Variant(), TIGHT))
    return shown(
        result,
        *MOVE,
        "variant_id",
        "row_count",
        "projected_p95_latency",
        "projected_availability",
        "slo_violation_rate",
        "latency_satisfied",
        "availability_satisfied",
    )


@query
def peak_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(table_fleet(spark, sf_dir).what_if("cheaper"), *MOVE, "peak_cpu", "peak_mem")


# --- cost --------------------------------------------------------------------------------------


@query
def cost_avg_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(cost.average_prices(adapters.pricing(spark, sf_dir)))


@query
def cost_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ordered pair of types at the default hours of a month."""
    fleet = table_fleet(spark, sf_dir)
    pairs = fleet.catalog.moves(spark, "any").select("current_instance_type", "candidate_instance_type")
    return shown(cost.compare(pairs, fleet.pricing, fleet.catalog))


# --- what-if and decision ----------------------------------------------------------------------

RESULT = [
    *MOVE,
    "row_count",
    "projected_p95_latency",
    "projected_availability",
    "slo_violation_rate",
    "peak_cpu",
    "peak_mem",
    "baseline_monthly_cost",
    "simulated_monthly_cost",
    "absolute_monthly_saving",
    "cost_reduction_pct",
]


@query
def whatif_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(table_fleet(spark, sf_dir).what_if("cheaper_and_self"), *RESULT)


@query
def whatif_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five traffic profiles as variants of one pass."""
    variants = tuple(Variant(p, profile=p) for p in ("steady", "peak", "bursty", "low-traffic", "seasonal"))
    return shown(table_fleet(spark, sf_dir).what_if("step_down", variants), *RESULT, "variant_id")


@query
def whatif_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The experiment report: scenario environments with averages beside their baseline."""
    fleet = table_fleet(spark, sf_dir)
    # At most three environments are picked; nothing but their telemetry is read again.
    picked = session.written(scenarios.pick(fleet.environments, scenarios.classify(fleet.passes)), "picked")
    few = fleet.named([r[ENV] for r in picked.select(ENV).distinct().collect()])
    result = few.what_if("step_down_or_self", means=True)
    measured = few.baseline(["cpu", "memory", "latency", "reliability"])
    report = scenarios.experiment(picked, whatif.decide(result), measured)
    return shown(
        report,
        "scenario",
        *MOVE,
        "decision",
        "reason_codes",
        "baseline_monthly_cost",
        "simulated_monthly_cost",
        "cost_reduction_pct",
        "mean_cpu",
        "mean_projected_cpu",
        "baseline_peak_cpu",
        "peak_cpu",
        "peak_memory",
        "peak_mem",
        "p95_latency",
        "projected_p95_latency",
        "measured_availability",
        "projected_availability",
    )


@query
def decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = table_fleet(spark, sf_dir).decided("cheaper", (Variant(), TIGHT))
    return shown(decided, *MOVE, "variant_id", "decision", "reason_codes")


@query
def decide_insufficient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions where environments without telemetry and of low data quality are possible.

    The fleet here are the migration requests, a third of which have no telemetry.
    """
    fleet = table_fleet(spark, sf_dir)
    moves = (
        adapters.requests(spark, sf_dir)
        .join(fleet.environments.select(ENV, "current_instance_type"), ENV, "left")
        .withColumn("current_instance_type", F.coalesce("current_instance_type", "expected_current"))
    )
    result = whatif.keep_all_moves(
        moves, whatif.what_if(fleet.passes, moves, fleet.pricing, fleet.catalog, large=fleet.large)
    )
    grades = validation.quality_grade(fleet.input, fleet.order, by=ENV).select(ENV, "quality")
    decided = whatif.decide(result.join(grades, ENV, "left"), F.col("quality"))
    return shown(
        decided.withColumn("row_count", F.coalesce("row_count", F.lit(0))), *MOVE, "row_count", "decision", "reason_codes"
    )


@query
def decide_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = table_fleet(spark, sf_dir).decided("cheaper_and_self", texts=True)
    return shown(decided, *MOVE, "decision", "reasons")


# --- candidates --------------------------------------------------------------------------------


@query
def cand_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    fleet = table_fleet(spark, sf_dir)
    return shown(whatif.fleet_moves(fleet.environments, fleet.catalog, "cheaper"), *MOVE, "candidate_ordinal")


@query
def cand_headroom(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = table_fleet(spark, sf_dir).decided("cheaper")
    safe = candidates.with_headroom(decided).where(F.col("decision") == S.SAFE)
    return shown(safe, *MOVE, "headroom")


@query
def cand_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    fleet = table_fleet(spark, sf_dir)
    best = candidates.best_candidate(fleet.decided("cheaper"), fleet.catalog)
    return shown(best, *MOVE, "headroom", "absolute_monthly_saving")


@query
def cand_best_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best candidate per environment and growth level."""
    fleet = table_fleet(spark, sf_dir)
    grown = tuple(Variant(f"growth_{g}", traffic_growth=g / 100) for g in (0, 20, 40))
    best = candidates.best_candidate(fleet.decided("cheaper", grown), fleet.catalog)
    return shown(best, *MOVE, "variant_id", "headroom", "absolute_monthly_saving")


@query
def cand_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    fleet = table_fleet(spark, sf_dir)
    best = candidates.best_candidate(fleet.decided("cheaper"), fleet.catalog)
    chosen = candidates.selection(fleet.environments, best)
    return shown(
        chosen.select(
            ENV, "current_instance_type", F.coalesce("selected_candidate", F.lit("none")).alias("selected_candidate"), "decision"
        )
    )


@query
def cand_step_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    fleet = table_fleet(spark, sf_dir)
    return shown(whatif.fleet_moves(fleet.environments, fleet.catalog, "step_down"), *MOVE)


@query
def cand_step_down_or_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    fleet = table_fleet(spark, sf_dir)
    return shown(whatif.fleet_moves(fleet.environments, fleet.catalog, "step_down_or_self"), *MOVE)


@query
def legacy_recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    naive = table_fleet(spark, sf_dir).naive()
    return shown(naive.withColumn("recommended", F.coalesce("recommended", F.lit("none"))))


@query
def legacy_vs_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    fleet = table_fleet(spark, sf_dir)
    stopped = candidates.prevented_by_gate(fleet.naive(), fleet.decided("step_down"))
    return shown(stopped, ENV, "current_instance_type", "recommended", "mean_cpu", "decision", "reason_codes")


# --- sensitivity -------------------------------------------------------------------------------

SWEEP = [
    *MOVE,
    "variant_id",
    "traffic_growth",
    "decision",
    "reason_codes",
    "projected_p95_latency",
    "projected_availability",
    "absolute_monthly_saving",
    "peak_cpu",
    "peak_mem",
]


@query
def sens_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = table_fleet(spark, sf_dir).decided("step_down", sensitivity.growth_variants())
    return shown(decided, *SWEEP)


@query
def sens_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = (
        *sensitivity.DEFAULT_VARIATIONS,
        {"variant_id": "tight_slo", "latency_target": 54.0, "availability_target": 99.99},
    )
    decided = table_fleet(spark, sf_dir).decided("step_down", sensitivity.variations(items))
    return shown(decided, *SWEEP, "cpu_pressure", "memory_pressure", "latency_target", "availability_target")


@query
def sens_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = table_fleet(spark, sf_dir).decided("step_down", sensitivity.growth_variants())
    flips = sensitivity.flip_point(decided)
    return shown(
        flips.withColumn("flip_growth", F.coalesce("flip_growth", F.lit(-1.0)))
        .withColumn("binding_constraint", F.coalesce("binding_constraint", F.lit("none")))
        .fillna(0.0, ["flip_peak_cpu", "flip_peak_mem"])
    )


# --- portfolio ---------------------------------------------------------------------------------


@query
def port_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table_fleet(spark, sf_dir).portfolio()
    return shown(rows.withColumn("selected_candidate", F.coalesce("selected_candidate", F.lit("none"))).drop("unsafe_saving"))


@query
def port_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(portfolio.summary(table_fleet(spark, sf_dir).portfolio()))


@query
def port_blocked_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(portfolio.blocked_savings(table_fleet(spark, sf_dir).portfolio()))


def _steps(fleet: Fleet) -> DataFrame:
    return portfolio.step_down_rows(fleet.decided("step_down"))


@query
def port_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    fleet = table_fleet(spark, sf_dir)
    return shown(portfolio.ranked(_steps(fleet), fleet.environments).drop("seq"))


@query
def port_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    fleet = table_fleet(spark, sf_dir)
    return shown(portfolio.top_safe(_steps(fleet), fleet.environments).drop("seq"))


@query
def port_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    fleet = table_fleet(spark, sf_dir)
    return shown(portfolio.metrics(_steps(fleet), fleet.naive()))


@query
def risk_agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = table_fleet(spark, sf_dir).what_if("cheaper_and_self", (Variant(), TIGHT))
    risk = labels.migration_risk(F.col("peak_cpu"), F.col("latency_satisfied"), F.col("availability_satisfied"))
    return shown(result.withColumn("risk", risk), *MOVE, "variant_id", "risk")


@query
def risk_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table_fleet(spark, sf_dir).portfolio()
    return shown(rows.groupBy("current_instance_type", "risk").agg(F.count(F.lit(1)).alias("environments")))


# --- trade-off, explanation, views -------------------------------------------------------------


@query
def tradeoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(views.tradeoff(table_fleet(spark, sf_dir).what_if("cheaper_and_self")))


@query
def explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The explanation documents, read back field by field."""
    told = views.explain(table_fleet(spark, sf_dir).decided("cheaper", texts=True))

    def number(safe: str, blocked: str):
        return F.coalesce(*[F.get_json_object("explanation", f"$.{f}") for f in (safe, blocked)]).cast("double")

    return shown(
        told.select(
            *MOVE,
            "verdict",
            F.get_json_object("explanation", "$.decision").alias("document_decision"),
            F.get_json_object("explanation", "$.candidate").alias("document_candidate"),
            number("cpu_projection", "projected_cpu").alias("cpu"),
            number("memory_projection", "projected_memory").alias("memory"),
            number("latency_projection", "projected_latency").alias("latency"),
            number("availability_projection", "projected_availability").alias("availability"),
            F.coalesce(F.get_json_object("explanation", "$.cost_reduction").cast("double"), F.lit(0.0)).alias("cost_reduction"),
            F.coalesce(F.get_json_object("explanation", "$.evidence"), F.lit("")).alias("evidence"),
            F.coalesce(F.json_array_length(F.get_json_object("explanation", "$.passed_checks")), F.lit(0)).alias("checks"),
            F.coalesce(F.json_array_length(F.get_json_object("explanation", "$.exact_reason")), F.lit(0)).alias("reasons"),
        )
    )


@query
def view_infra(spark: SparkSession, sf_dir: str) -> DataFrame:
    fleet = table_fleet(spark, sf_dir)
    last = health.latest_migrations(adapters.audit(spark, sf_dir))
    judged = health.verdicts(health.window_after_last(last, adapters.readings(spark, sf_dir)), [ENV])
    return shown(views.infrastructure_view(fleet.decided("step_down"), judged))


@query
def view_finops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(views.finops_view(portfolio.summary(table_fleet(spark, sf_dir).portfolio())))


@query
def view_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(views.owner_view(table_fleet(spark, sf_dir).decided("step_down")))


@query
def baseline_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    fleet = table_fleet(spark, sf_dir)
    return shown(views.baseline_delta(fleet.what_if("cheaper"), fleet.baseline(["latency", "reliability"])))


@query
def dist_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    fleet = table_fleet(spark, sf_dir)
    rows = project_rows(
        fleet.passes, fleet.environments, fleet.catalog, "step_down", keep=("cpu_utilization_pct",)
    )
    return shown(views.five_numbers(rows, fleet.large))


@query
def trend_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CPU and request volume of every environment with the position in time."""
    fleet = table_fleet(spark, sf_dir)
    rows = with_profile_columns(fleet.passes, {"seasonal"}, fleet.large)
    return shown(rows, ENV, "position", "timestamp", "cpu_utilization_pct", "request_volume")


@query
def scenario_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = scenarios.classify(table_fleet(spark, sf_dir).telemetry)
    return shown(classes.withColumn("scenario_class", F.coalesce("scenario_class", F.lit("neither"))))


@query
def scenario_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    fleet = table_fleet(spark, sf_dir)
    return shown(scenarios.pick(fleet.environments, scenarios.classify(fleet.telemetry)))


# --- gate, monitoring, audit -------------------------------------------------------------------


def _prechecked(spark: SparkSession, sf_dir: str) -> DataFrame:
    fleet = table_fleet(spark, sf_dir)
    return gate.precheck(
        adapters.requests(spark, sf_dir), fleet.environments, fleet.passes, fleet.pricing, fleet.catalog, fleet.large
    )


@query
def gate_precheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _prechecked(spark, sf_dir)
    return shown(
        rows.select(
            *gate.REQUEST,
            F.coalesce("state_check", F.lit("passed")).alias("state_check"),
            F.coalesce("decision", F.lit("not simulated")).alias("decision"),
            F.coalesce("reason_codes", F.array().cast("array<string>")).alias("reason_codes"),
            "event",
            "approved",
        )
    )


def _reason_kind() -> Column:
    """Texts with formatted decimals are covered by unit tests; beside SQL they are cut to their kind."""
    return F.when(F.col("event") == gate.BLOCKED, "blocked by decision").otherwise(F.col("reason"))


@query
def gate_audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gate.audit_rows(_prechecked(spark, sf_dir))
    return shown(rows.withColumn("reason", _reason_kind()))


@query
def health_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = health.classified(adapters.readings(spark, sf_dir))
    return shown(rows, ENV, "reading_id", "health_status")


@query
def health_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    session.tune(spark)
    executed = health.migrations(adapters.audit(spark, sf_dir))
    return shown(health.window_after(executed, adapters.readings(spark, sf_dir)))


@query
def health_first_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five readings of each environment."""
    rows = health.first_readings(adapters.readings(spark, sf_dir))
    return shown(rows, ENV, "checkpoint_no", "reading_id", "health_status")


@query
def health_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    session.tune(spark)
    executed = health.migrations(adapters.audit(spark, sf_dir))
    window = health.window_after(executed, adapters.readings(spark, sf_dir))
    return shown(health.verdicts(window, [ENV, "migration_seq"]))


@query
def health_rollback_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    session.tune(spark)
    return shown(health.rollback_list(adapters.audit(spark, sf_dir), adapters.readings(spark, sf_dir)))


@query
def accuracy_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reading's CPU taken as the prediction of its memory; covers the zero cases."""
    rows = adapters.readings(spark, sf_dir).select(
        "reading_id", F.col("cpu").alias("predicted"), F.floor(F.col("latency")).cast("double").alias("observed")
    )
    return shown(accuracy.with_errors(rows))


@query
def accuracy_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    fleet = table_fleet(spark, sf_dir)
    last = health.latest_migrations(adapters.audit(spark, sf_dir))
    window = session.written(health.window_after_last(last, adapters.readings(spark, sf_dir)), "checkpoints")
    observed = session.written(health.observed_moves(last, window), "observed")
    # Only the moves that were made are simulated, and only from their environments' telemetry.
    made = observed.select(*MOVE).distinct()
    telemetry = fleet.passes.join(made.select(ENV), ENV, "left_semi")
    predicted = whatif.what_if(telemetry, made, fleet.pricing, fleet.catalog, large=fleet.large)
    return shown(accuracy.compare(predicted, observed))


@query
def audit_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(audit.latest(adapters.audit(spark, sf_dir)))


@query
def audit_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = audit.state(adapters.audit(spark, sf_dir), adapters.environments(spark, sf_dir))
    return shown(left.withColumn("lifecycle_status", F.coalesce("lifecycle_status", F.lit("none"))))


@query
def audit_order_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each environment's events leave it, and which of them its stage did not allow."""
    found = audit_order.order_summary(adapters.audit(spark, sf_dir))
    return shown(found.fillna(0, ["first_entry"]).fillna("none", ["first_event"]))


@query
def audit_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(audit.funnel(adapters.audit(spark, sf_dir)).fillna(0.0))


@query
def error_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failure codes seen in the fleet's decisions, and one unlisted code, explained."""
    fleet = table_fleet(spark, sf_dir)
    codes = fleet.decided("cheaper_and_self").select(F.explode("reason_codes").alias("error_code"))
    unlisted = fleet.environments.where(F.col("status") != "RUNNING").select(F.lit("NOT_RUNNING").alias("error_code"))
    seen = codes.unionByName(unlisted).groupBy("error_code").agg(F.count(F.lit(1)).alias("occurrences"))
    return shown(errors.explained(seen))


@query
def error_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    fleet = table_fleet(spark, sf_dir)
    tagged = validation.tagged(fleet.input, fleet.order, fleet.environments)
    return shown(errors.error_events(tagged, fleet.decided("step_down")))


# --- streaming ---------------------------------------------------------------------------------


@query
def stream_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    session.tune(spark)
    return shown(stream_validation.run(spark, sf_dir), *S.TELEMETRY_COLUMNS)


@query
def stream_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    session.tune(spark)
    return shown(stream_baselines.run(spark, sf_dir))


@query
def stream_baseline_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    session.tune(spark)
    return shown(stream_baselines.run(spark, sf_dir, slide="1 hour"))


@query
def stream_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    session.tune(spark)
    return shown(stream_healths.run(spark, sf_dir))


@query
def stream_health_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    session.tune(spark)
    return shown(stream_healths.run_first(spark, sf_dir))


@query
def stream_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    session.tune(spark)
    rows = stream_audit_sink.run(spark, sf_dir, table_fleet(spark, sf_dir))
    return shown(rows.withColumn("reason", _reason_kind()))

