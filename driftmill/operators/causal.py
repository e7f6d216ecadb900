"""Mechanisms and what they do to features: small tables joined with observed changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Mechanisms in ranking order, the features that each touches, and the direction that it is expected to move some of them.
MECHANISMS = {
    "focus_shift_or_defocus": ("sharpness_laplacian", "edge_density", "gradient_mean"),
    "electronic_noise_increase": ("std_intensity", "coefficient_variation", "speckle_proxy"),
    "sensitivity_or_element_response_change": ("uniformity", "mean_intensity", "std_intensity", "edge_density"),
    "attenuation_like_depth_rolloff": ("attenuation_proxy_db_cm_mhz", "axial_intensity_slope", "depth_uniformity", "near_field_energy_ratio"),
    "pulse_or_bandwidth_change": ("axial_resolution_mm", "wavelength_mm"),
    "acquisition_timing_inconsistency": ("theoretical_max_prf_hz", "prf_depth_margin", "physical_consistency_score"),
}
DIRECTIONS = {
    "focus_shift_or_defocus": {"sharpness_laplacian": "decrease", "edge_density": "decrease", "gradient_mean": "decrease"},
    "electronic_noise_increase": {"std_intensity": "increase", "coefficient_variation": "increase"},
    "sensitivity_or_element_response_change": {"uniformity": "decrease"},
    "attenuation_like_depth_rolloff": {"attenuation_proxy_db_cm_mhz": "increase", "depth_uniformity": "decrease"},
    "pulse_or_bandwidth_change": {"axial_resolution_mm": "change"},
    "acquisition_timing_inconsistency": {"prf_depth_margin": "decrease", "physical_consistency_score": "decrease"},
}
TOLERANCE = 1e-8


def feature_map(spark: SparkSession) -> DataFrame:
    """Mechanism, its place and its features."""
    return spark.createDataFrame([(k, n, list(v)) for n, (k, v) in enumerate(MECHANISMS.items())], "mechanism string, place int, features array<string>")


def directions(spark: SparkSession) -> DataFrame:
    """A row for each mechanism and feature with an expected direction."""
    rows = [(m, n, f, d) for n, m in enumerate(MECHANISMS) for f, d in DIRECTIONS[m].items()]
    return spark.createDataFrame(rows, "mechanism string, place int, feature string, direction string")


def hypothesis(spark: SparkSession, mechanism: str) -> DataFrame:
    if mechanism not in MECHANISMS:
        raise KeyError(mechanism)
    return feature_map(spark).where(F.col("mechanism") == mechanism)


def sign(delta: Column, tolerance: float = TOLERANCE) -> Column:
    return F.when(F.abs(delta) <= tolerance, 0).otherwise(F.signum(delta).cast("int"))


def ranked(deltas: DataFrame, keys: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """deltas (keys, feature, delta) against every mechanism: score, supported, contradicted, unavailable, and rank.

    A feature without a delta, or one that doesn't move, is unavailable. The score is the supported share of the rest, 0
    without any. Equal scores rank in the mechanisms' order. Expressions over a map of each key's few deltas: the table
    of mechanisms is a literal, so nothing is joined.
    """
    named = F.col("feature").isin(sorted({f for own in DIRECTIONS.values() for f in own}))
    held = deltas.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.when(named, F.struct("feature", "delta")))).alias("deltas"))

    def scored(mechanism: str, place: int) -> Column:
        own = {f: sign(F.try_element_at("deltas", F.lit(f)), tolerance) for f in DIRECTIONS[mechanism]}
        moved = {f: s.isNotNull() & (s != 0) for f, s in own.items()}
        right = {f: F.lit(True) if (d := DIRECTIONS[mechanism][f]) == "change" else own[f] == (1 if d == "increase" else -1) for f in own}
        names = lambda which: F.array_compact(F.array(*(F.when(which(f), F.lit(f)) for f in own)))
        supported, contradicted = names(lambda f: moved[f] & right[f]), names(lambda f: moved[f] & ~right[f])
        total = F.size(supported) + F.size(contradicted)
        score = F.when(total > 0, F.size(supported) / total).otherwise(F.lit(0.0))
        return F.struct((-score).alias("minus"), F.lit(place).alias("place"), F.lit(mechanism).alias("mechanism"), supported.alias("supported"), contradicted.alias("contradicted"), names(lambda f: ~moved[f]).alias("unavailable"))

    every = F.array_sort(F.array(*(scored(m, n) for n, m in enumerate(MECHANISMS))))
    return held.select(*keys, F.posexplode(every).alias("at", "s")).select(*keys, "s.mechanism", (0.0 - F.col("s.minus")).alias("score"), "s.supported", "s.contradicted", "s.unavailable", (F.col("at") + 1).alias("rank"))
