"""Sweeps over assumptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fleetfit import schemas as S
from fleetfit.operators.projection import Variant
from fleetfit.operators.whatif import MOVE

# Default growth levels and default single-factor variations.
GROWTH_LEVELS = (0.0, 0.1, 0.2, 0.3, 0.4)
DEFAULT_VARIATIONS = (
    {"traffic_growth": 0.1, "cpu_pressure": 0.0, "memory_pressure": 0.0},
    {"traffic_growth": 0.0, "cpu_pressure": 0.1, "memory_pressure": 0.0},
    {"traffic_growth": 0.0, "cpu_pressure": 0.0, "memory_pressure": 0.1},
)


def growth_variants(levels: tuple[float, ...] = GROWTH_LEVELS, **common) -> tuple[Variant, ...]:
    return tuple(Variant(f"growth_{round(g * 100)}", traffic_growth=g, **common) for g in levels)


def variations(items: tuple[dict, ...] = DEFAULT_VARIATIONS, **common) -> tuple[Variant, ...]:
    """Variants from dictionaries of assumptions; a dictionary may also replace a target."""
    return tuple(Variant(item.get("variant_id", f"variation_{i}"), **{**common, **{k: v for k, v in item.items() if k != "variant_id"}})
                 for i, item in enumerate(items))


def flip_point(decided: DataFrame) -> DataFrame:
    """Per move that is safe at its lowest growth: the first growth that is not, and why.

    Moves that stay safe over the whole sweep keep a row with a null growth.
    """
    unsafe = F.col("decision") != S.SAFE
    first_unsafe = F.min_by(
        F.when(unsafe, F.struct("traffic_growth", "reason_codes", "peak_cpu", "peak_mem")),
        F.when(unsafe, F.col("traffic_growth")),
    )
    return (
        decided.groupBy(*MOVE)
        .agg(
            F.min_by("decision", "traffic_growth").alias("decision_at_lowest"),
            first_unsafe.alias("_flip"),
            F.max(F.when(~unsafe, F.col("traffic_growth"))).alias("highest_safe_growth"),
        )
        .where(F.col("decision_at_lowest") == S.SAFE)
        .select(
            *MOVE,
            "highest_safe_growth",
            F.col("_flip.traffic_growth").alias("flip_growth"),
            F.col("_flip.reason_codes")[0].alias("binding_constraint"),
            F.col("_flip.peak_cpu").alias("flip_peak_cpu"),
            F.col("_flip.peak_mem").alias("flip_peak_mem"),
        )
    )
