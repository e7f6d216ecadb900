"""The signature of an image: a versioned record of 23 numbers in a fixed order."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import edges, image, physics

VERSION = "2.1"

# The features in the order of the contract.
FEATURES = """mean_intensity std_intensity dynamic_range coefficient_variation rms_contrast entropy sharpness_laplacian speckle_proxy edge_density
gradient_mean gradient_std gradient_max uniformity wavelength_mm axial_resolution_mm attenuation_proxy_db_cm_mhz axial_intensity_slope
depth_uniformity near_field_energy_ratio physical_consistency_score theoretical_max_prf_hz prf_depth_margin metadata_complete""".split()
# What stands for a feature that a record lacks; the others are required.
DEFAULTS = {"uniformity": 1.0, "wavelength_mm": 0.154, "axial_resolution_mm": 0.077, "attenuation_proxy_db_cm_mhz": 0.0, "axial_intensity_slope": 0.0, "depth_uniformity": 1.0, "near_field_energy_ratio": 0.5, "physical_consistency_score": 1.0, "theoretical_max_prf_hz": 0.0, "prf_depth_margin": 0.0, "metadata_complete": 0.0}


def contract_hash(features: Iterable[str] = FEATURES) -> Column:
    return F.sha2(F.lit("|".join(features)), 256)


def completed(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, version and the features as doubles; absent or null ones by DEFAULTS, others that are absent are an error."""
    lacking = [f for f in FEATURES if f not in df.columns and f not in DEFAULTS]
    if lacking:
        raise ValueError(f"no columns {', '.join(lacking)}")
    of = lambda f: F.col(f).cast("double") if f in df.columns else F.lit(None).cast("double")
    return df.select(*keys, F.lit(VERSION).alias("version"), *((F.coalesce(of(f), F.lit(DEFAULTS[f])) if f in DEFAULTS else of(f)).alias(f) for f in FEATURES))


def signatures(images: DataFrame, keys: list[str], height: int, width: int, px: str = "px", params: str | None = None, canny: bool = True) -> DataFrame:
    """Every image's signature. Pixels lie in [0, 1]; params is a map of strings. Without canny, edge_density is null."""
    held = F.col(params) if params else F.create_map().cast("map<string,string>")
    own = images.select(*keys, held.alias("__params"), edges.measured(F.col(px), width, canny).alias("__f"))
    f = {k: F.col(f"__f.{k}") for k in edges.FEATURES}
    cv = f["std_intensity"] / (f["mean_intensity"] + image.EPS)
    out = {k: f[k] for k in edges.FEATURES if k in FEATURES}
    out |= {"coefficient_variation": cv, "rms_contrast": cv, "uniformity": 1 / (1 + cv), "speckle_proxy": f["noise"] / (f["mean_intensity"] + image.EPS)}
    out["edge_density"] = F.nanvl(f["edge_density"], F.lit(None).cast("double"))
    out |= physics.acoustics(F.col("__params"), f["slope"], f["near"], f["far"], f["row_mean"], f["row_std"])
    return completed(own.select(*keys, *(out[k].alias(k) for k in FEATURES)), keys)


def vector(features: Iterable[str] = FEATURES) -> Column:
    """The features as one array; unknown names are an error."""
    unknown = [f for f in features if f not in FEATURES]
    if unknown:
        raise ValueError(f"no features {', '.join(unknown)}")
    return F.array(*(F.col(f).cast("double") for f in features))


def record(keys: list[str]) -> Column:
    """The signature as JSON."""
    return F.to_json(F.struct(*keys, "version", *FEATURES))


def compared(a: Column, b: Column, names: Iterable[str] = FEATURES, tolerance: float = 1e-12) -> Column:
    """Struct of what changes from vector a to b: delta (map), changed (names) and l2."""
    names = F.array(*map(F.lit, names))
    gaps = F.zip_with(a, b, lambda x, y: y - x)
    return image.bound(gaps, lambda d: F.struct(F.map_from_arrays(names, d).alias("delta"), F.filter(names, lambda _, i: F.abs(F.get(d, i)) > tolerance).alias("changed"), F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x)).alias("l2")))
