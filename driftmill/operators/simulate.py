"""Controlled degradations of images and series of them by severity, with the lineage of what they make.

Noise is drawn from NumPy's generator seeded a row, so a row comes out the same wherever it is made; what draws nothing is a column
expression.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from . import edges, image
from .physics import clipped

VERSION = "1.0"
# Scenarios with their names and degradations, and default severities.
SCENARIOS = {
    "speckle_progression": ("Speckle progression", "speckle"),
    "noise_progression": ("Gaussian noise progression", "gaussian_noise"),
    "blur_progression": ("Blur progression", "blur"),
    "contrast_progression": ("Contrast reduction progression", "contrast_reduction"),
    "intensity_progression": ("Intensity shift progression", "intensity_shift"),
}
DEGRADATIONS = tuple(d for _, d in SCENARIOS.values())
SEVERITIES = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)
SENSITIVITY_SEVERITIES = (0.1, 0.3, 0.5, 0.7, 0.9)
# A phantom's level, background and its fall-off, ellipses (centre, radii, height) and their fall-off, texture and its scale, speckle, noise.
PHANTOM = {"level": 0.28, "background": 0.20, "fall": 5.0, "edge": 3.0, "texture": 0.025, "scale": 2.0, "speckle": 0.05, "noise": 0.008}
ELLIPSES = ((0.32, 0.35, 0.10, 0.12, 0.22), (0.68, 0.36, 0.09, 0.14, -0.16), (0.50, 0.67, 0.15, 0.08, 0.18))
# A reference image's level, slow and fine texture with the scales that they are drawn between, speckle, noise.
REFERENCE = {"level": 0.48, "slow": 0.18, "slow_scale": (5.0, 9.0), "texture": 0.12, "scale": (1.5, 3.0), "speckle": 0.08, "noise": 0.015}


def reduce_contrast(px: Column, severity: Column) -> Column:
    """Pixels drawn to their mean by three quarters of the severity."""
    return image.bound(F.struct(px.alias("px"), image.mean(px).alias("m"), (1 - 0.75 * severity).alias("f")), lambda e: F.transform(e["px"], lambda x: clipped(e["m"] + e["f"] * (x - e["m"]))))


def shift_intensity(px: Column, severity: Column) -> Column:
    return image.bound(0.2 * severity, lambda s: F.transform(px, lambda x: clipped(x + s)))


def blurred(x: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian of four deviations' reach, the border reflected with its own pixels."""
    reach = int(4 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    for axis in (0, 1):
        n = x.shape[axis]
        places = np.arange(-reach, n + reach) % (2 * n)
        x = np.apply_along_axis(np.convolve, axis, x.take(np.where(places < n, places, 2 * n - 1 - places), axis), kernel, "valid")
    return x


def _drawn(px: Column, kind: Column, severity: Column, seed: Column, width: int) -> Column:
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for values, kinds, severities, seeds in batches:
            out = []
            for x, k, s, seed in zip(values.to_pylist(), kinds.to_pylist(), severities.to_pylist(), seeds.to_pylist()):
                own = np.asarray(x, float).reshape(-1, width)
                rng = np.random.default_rng(seed)
                if k == "speckle":
                    own = own + own * rng.normal(0, 0.05 * s, own.shape)
                elif k == "gaussian_noise":
                    own = own + rng.normal(0, 0.08 * s, own.shape)
                else:
                    own = blurred(own, 0.15 + 2.5 * s)
                out.append(np.clip(own, 0, 1).ravel().tolist())
            yield pa.array(out, pa.list_(pa.float64()))

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    return arrow_udf(run, "array<double>")(px, kind, severity, seed)


def degraded(df: DataFrame, width: int, px: str = "px", kind: str = "degradation", severity: str = "severity", seed: str = "seed") -> DataFrame:
    """df with px degraded as its row says; unknown degradations and severities outside [0, 1] are errors."""
    k, s = F.col(kind), F.col(severity)
    checked = F.when(k.isin(*DEGRADATIONS) & s.between(0, 1), k).otherwise(F.raise_error(F.concat(F.lit("no such degradation or severity: "), F.concat_ws(" ", k, s.cast("string")))))
    plain = F.when(checked == "contrast_reduction", reduce_contrast(F.col(px), s)).when(F.col(kind) == "intensity_shift", shift_intensity(F.col(px), s))
    marked = df.withColumn("__plain", plain)
    noisy = marked.where("__plain IS NULL").withColumn(px, _drawn(F.col(px), k, s, F.col(seed), width))
    return marked.where("__plain IS NOT NULL").withColumn(px, F.col("__plain")).unionByName(noisy).drop("__plain")


def scenario(spark: SparkSession, kinds: Sequence[str] = tuple(SCENARIOS), severities: Sequence[float] = SEVERITIES) -> DataFrame:
    """Scenarios with a row for each severity: scenario, name, degradation, level, severity. Severities ascend within [0, 1]."""
    if set(kinds) - set(SCENARIOS):
        raise ValueError(f"scenarios are {', '.join(SCENARIOS)}")
    if not severities or list(severities) != sorted(set(severities)) or not 0 <= severities[0] <= severities[-1] <= 1:
        raise ValueError("severities ascend within [0, 1]")
    rows = [(k, *SCENARIOS[k], n, float(s)) for k in kinds for n, s in enumerate(severities)]
    return spark.createDataFrame(rows, "scenario string, name string, degradation string, level int, severity double")


def simulation_id(parent: Column, name: Column, severity: Column, seed: Column, version: str = VERSION) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", parent, name, F.format_string("%.8f", severity), F.coalesce(seed.cast("string"), F.lit("None")), F.lit(version)), 256), 1, 16)


def pixel_hash(px: Column, kind: str = "<f4") -> Column:
    """SHA-256 of the pixels as little-endian floats."""

    return F.sha2(edges.each_image(px, 1, "binary", lambda x: x.astype(kind).tobytes()), 256)


def simulated(images: DataFrame, scenarios: DataFrame, width: int, key: str = "id", seed: int = 42, per_image: str | None = None) -> DataFrame:
    """Every image under every row of the scenarios, with its lineage.

    The seed of a row is seed + level, or with per_image (a column of whole numbers) seed + 1000 * level + its value.
    """
    grid = images.join(F.broadcast(scenarios), F.lit(True))  # scenarios are a literal table of a few rows
    own = F.lit(seed) + (1000 * F.col("level") + F.col(per_image) if per_image else F.col("level"))
    out = degraded(grid.withColumn("seed", own.cast("bigint")), width)
    out = out.withColumnRenamed(key, "parent_acquisition_id").withColumn("simulation_version", F.lit(VERSION))
    return out.withColumn("id", simulation_id(F.col("parent_acquisition_id").cast("string"), F.col("name"), F.col("severity"), F.col("seed")))


def records(simulations: DataFrame) -> DataFrame:
    """What a registry keeps of simulations."""
    return simulations.select(F.col("id").alias("simulation_id"), "parent_acquisition_id", F.col("name").alias("scenario_name"), F.col("degradation").alias("degradation_type"), "severity", "seed", "simulation_version", pixel_hash(F.col("px")).alias("output_sha256"))


def of_parent(records: DataFrame, parent) -> DataFrame:
    return records.where(F.col("parent_acquisition_id") == parent)


def reproducible(images: DataFrame, scenarios: DataFrame, width: int, key: str = "id", seed: int = 42) -> DataFrame:
    """Simulations that come out differently a second time; there are none."""
    one, two = (records(simulated(images, scenarios, width, key, seed)) for _ in range(2))
    return one.exceptAll(two).unionByName(two.exceptAll(one))


def severity_response(simulations: DataFrame, images: DataFrame, key: str = "id", least: float = 1e-5) -> DataFrame:
    """By scenario and level: the mean change of a pixel from the image itself, and whether any level of the scenario shows one."""
    base = images.select(F.col(key).alias("parent_acquisition_id"), F.col("px").alias("base"))
    change = image.mean(F.zip_with("px", "base", lambda a, b: F.abs(a - b)))
    out = simulations.join(base, "parent_acquisition_id").groupBy("scenario", "level", "severity").agg(F.avg(change).alias("mean_change"))
    return out.withColumn("responds", F.max("mean_change").over(Window.partitionBy("scenario")) > least)


def _standard(x: np.ndarray) -> np.ndarray:
    return (x - x.mean()) / max(float(x.std()), 1e-12)


def phantom(rng: np.random.Generator, side: int) -> np.ndarray:
    y, x = np.mgrid[0:side, 0:side] / side
    own = PHANTOM["level"] + PHANTOM["background"] * np.exp(-PHANTOM["fall"] * np.hypot(x - 0.5, y - 0.5))
    for across, down, a, b, height in ELLIPSES:
        own = own + height * np.exp(-PHANTOM["edge"] * (((x - across) / a) ** 2 + ((y - down) / b) ** 2))
    texture = blurred(rng.normal(0, 1, own.shape), PHANTOM["scale"])
    own = (own + PHANTOM["texture"] * texture / max(float(texture.std()), 1e-12)) * (1 + rng.normal(0, PHANTOM["speckle"], own.shape))
    return np.clip(np.clip(own, 0, 1) + rng.normal(0, PHANTOM["noise"], own.shape), 0, 1)


def reference(rng: np.random.Generator, side: int) -> np.ndarray:
    slow = blurred(rng.normal(0, 1, (side, side)), rng.uniform(*REFERENCE["slow_scale"]))
    slow = (slow - slow.min()) / (np.ptp(slow) + 1e-12)
    fine = _standard(blurred(rng.normal(0, 1, (side, side)), rng.uniform(*REFERENCE["scale"])))
    own = REFERENCE["level"] + REFERENCE["slow"] * (slow - 0.5) + REFERENCE["texture"] * fine
    return np.clip(own * (1 + rng.normal(0, REFERENCE["speckle"], own.shape)) + rng.normal(0, REFERENCE["noise"], own.shape), 0, 1)


def _made(spark: SparkSession, n: int, seed: int, side: int, draw) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0).to_pylist():
                px = draw(np.random.default_rng(seed + t), side).ravel().tolist()
                yield pa.RecordBatch.from_pydict({"t": pa.array([t], pa.int64()), "px": pa.array([px], pa.list_(pa.float64()))})

    return spark.range(n).mapInArrow(run, "t bigint, px array<double>").withColumns({"height": F.lit(side), "width": F.lit(side), "seed": F.col("t") + seed})


def phantoms(spark: SparkSession, n: int, seed: int = 42, side: int = 128) -> DataFrame:
    """Synthetic images: t, px, height, width, seed, id, source. Each is drawn from its own seed (seed + t), so rows don't depend on each other."""
    return _made(spark, n, seed, side, phantom).withColumns({"id": F.format_string("synthetic_root_%04d", "t"), "source": F.lit("simulated")})


def references(spark: SparkSession, n: int = 40, seed: int = 42, side: int = 128) -> DataFrame:
    """Images of normal operation: t, px, height, width, seed; each from its own seed."""
    return _made(spark, n, seed, side, reference)
