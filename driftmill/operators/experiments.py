"""Controlled experiments: what degradations do to signatures, against noise, and what a fitted model makes of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import causal, decisions, edges, image, signature, simulate, statistics
from .baseline import Baseline

PARENT = "parent_acquisition_id"
CELL = [PARENT, "scenario", "level", "severity"]


def varying(df: DataFrame, features: Sequence[str], least: float = 1e-9) -> list[str]:
    """The features whose deviation is above `least`; constant ones would make any difference look infinite."""
    row = df.agg(*(F.stddev_samp(f).alias(f) for f in features)).first()
    return [f for f in features if row[f] is not None and row[f] > least]


def degraded_signatures(images: DataFrame, scenarios: DataFrame, height: int, width: int, key: str = "id", seed: int = 42, params: str | None = None, per_image: str | None = None) -> DataFrame:
    """The signature of every image under every row of the scenarios."""
    made = simulate.simulated(images, scenarios, width, key, seed, per_image)
    return signature.signatures(made, [*CELL, "name", "seed"], height, width, params=params)


def changes(images: DataFrame, scenarios: DataFrame, height: int, width: int, key: str = "id", seed: int = 42, params: str | None = None) -> DataFrame:
    """By image, scenario and level: delta (map by feature), changed (names) and l2 of the signature."""
    base = signature.signatures(images, [key], height, width, params=params).select(F.col(key).alias(PARENT), signature.vector().alias("a"))
    made = degraded_signatures(images, scenarios, height, width, key, seed, params).select(*CELL, signature.vector().alias("b"))
    return made.join(base, PARENT).select(*CELL, signature.compared(F.col("a"), F.col("b")).alias("c")).select(*CELL, "c.*")


def evidence(changed: DataFrame) -> DataFrame:
    """Of changes: the best mechanism with its agreement, and all evidence fused; the change's size l2 / (1 + l2) stands for statistics, model and physics."""
    deltas = changed.select(*CELL, "l2", F.explode("delta").alias("feature", "delta"))
    top = causal.ranked(deltas, [*CELL, "l2"]).where("rank = 1")
    size = F.col("l2") / (1 + F.col("l2"))
    fused = decisions.fuse_evidence(F.array(size, size, size, F.col("score"), F.lit(None).cast("double")))
    return top.select(*CELL, "l2", "mechanism", F.col("score").alias("agreement"), fused.alias("f")).select(*CELL, "l2", "mechanism", "agreement", "f.fusion", "f.disagreement")


def sensitivity_summary(rows: DataFrame) -> DataFrame:
    """By scenario: cells, extremes of the change and of the fused evidence, mean agreement, and how many cells respond at all."""
    return rows.groupBy("scenario").agg(F.count("*").alias("n"), F.min("l2").alias("delta_min"), F.max("l2").alias("delta_max"), F.min("fusion").alias("fusion_min"), F.max("fusion").alias("fusion_max"), F.avg("agreement").alias("causal_mean"), F.avg((F.col("l2") > 0).cast("double")).alias("response_rate"))


def repeated(images: DataFrame, height: int, width: int, key: str = "id", repeats: int = 20, severity: float = 0.02, seed: int = 42, params: str | None = None) -> DataFrame:
    """By image and feature: mean, std (n - 1) and cv over noisy copies, and l2_noise, the mean distance of a copy's signature from their mean."""
    if repeats < 3 or not 0 <= severity <= 1:
        raise ValueError("three copies at least, and a severity within [0, 1]")
    rows = images.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumns({"degradation": F.lit("gaussian_noise"), "severity": F.lit(float(severity)), "seed": (F.lit(seed) + F.col("copy")).cast("bigint")})
    own = signature.signatures(simulate.degraded(rows, width), [key, "copy"], height, width, params=params)
    long = own.unpivot([key, "copy"], signature.FEATURES, "feature", "v")
    means = long.groupBy(key, "feature").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))
    far = long.join(means, [key, "feature"]).groupBy(key, "copy").agg(F.sqrt(F.sum((F.col("v") - F.col("mean")) ** 2)).alias("d")).groupBy(key).agg(F.avg("d").alias("l2_noise"))
    return means.join(far, key).withColumn("cv", F.col("std") / F.greatest(F.abs("mean"), F.lit(1e-8)))


def noise_floor(repeated: DataFrame, key: str = "id") -> DataFrame:
    """By image: mean and largest cv of the features, and l2_noise."""
    return repeated.groupBy(key).agg(F.avg("cv").alias("mean_cv"), F.max("cv").alias("max_cv"), F.max("l2_noise").alias("l2_noise"))


def robustness(rows: DataFrame, floors: DataFrame, key: str = "id", times: float = 3.0) -> DataFrame:
    """rows (with l2) against so many times their image's noise: noise_floor, margin, robust."""
    if not times > 0:
        raise ValueError("times is positive")
    floor = floors.select(F.col(key).alias(PARENT), (times * F.col("l2_noise")).alias("noise_floor"))
    return rows.join(floor, PARENT).withColumn("margin", F.col("l2") - F.col("noise_floor")).withColumn("robust", F.col("margin") > 0)


def robustness_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("scenario").agg(F.count("*").alias("n"), F.avg(F.col("robust").cast("double")).alias("robust_rate"), F.min("margin").alias("margin_min"), F.max("margin").alias("margin_max"))


def edge_sensitivity(images: DataFrame, scenarios: DataFrame, height: int, width: int, key: str = "id", seed: int = 42) -> DataFrame:
    """By image, scenario, level and edge definition: its value, the image's own, and the change, also relative (null where its own is 0)."""

    def definitions(df: DataFrame, keys: list[str]) -> DataFrame:
        g = image.sobel(F.col("px"), height, width)
        dense = image.bound(g, lambda v: image.bound(F.struct(v.alias("g"), image.quantile(v, 0.9).alias("p")), lambda e: image.share_above(e["g"], e["p"], False)))
        own = df.select(*keys, edges.canny_density(F.col("px"), width).alias("fixed_canny"), edges.canny_density(F.col("px"), width, None).alias("adaptive_canny"), dense.alias("gradient_p90"))
        return own.unpivot(keys, ["fixed_canny", "adaptive_canny", "gradient_p90"], "metric", "value")

    base = definitions(images, [key]).select(F.col(key).alias(PARENT), "metric", F.col("value").alias("reference"))
    rows = definitions(simulate.simulated(images, scenarios, width, key, seed), CELL).join(base, [PARENT, "metric"])
    gap = F.col("value") - F.col("reference")
    return rows.select(*CELL, "metric", "reference", "value", gap.alias("change"), (gap / F.nullif(F.abs("reference"), F.lit(0.0))).alias("relative_change"))


def scored(model: Baseline, signatures: DataFrame, keys: list[str]) -> DataFrame:
    return model.detected(signatures).select(*keys, "d2", "distance", "state", "quality")


def scenario_evaluation(model: Baseline, signatures: DataFrame) -> DataFrame:
    """By scenario and severity: mean and deviation (population) of d2, and detection metrics; any severity above 0 is an anomaly."""
    rows = scored(model, signatures, ["scenario", "severity"])
    keys = ["scenario", "severity"]
    d2 = rows.groupBy(*keys).agg(F.avg("d2").alias("mean_d2"), F.stddev_pop("d2").alias("std_d2"))
    return statistics.detection_metrics(rows, keys, "distance", "state", F.col("severity") > 0).join(d2, keys)


def holdout_evaluation(model: Baseline, signatures: DataFrame) -> DataFrame:
    """Detection metrics of rows that are all normal; one row."""
    return statistics.detection_metrics(scored(model, signatures, []), [], "distance", "state", F.lit(False))


def monotonicity(model: Baseline, signatures: DataFrame) -> DataFrame:
    """By scenario: the rank correlation of severity and distance; null where either is constant."""
    rows = scored(model, signatures, ["scenario", "severity"])
    rank = lambda c: F.rank().over(Window.partitionBy("scenario").orderBy(c)) + (F.count("*").over(Window.partitionBy("scenario", c)) - 1) / 2
    ranked = rows.select("scenario", rank("severity").alias("x"), rank("distance").alias("y"))
    both = (F.stddev_pop("x") > 0) & (F.stddev_pop("y") > 0)
    return ranked.groupBy("scenario").agg(F.count("*").alias("n"), F.when(both, F.covar_pop("x", "y") / (F.stddev_pop("x") * F.stddev_pop("y"))).alias("rho"))


def counterfactual(images: DataFrame, kind: str, severity: float, height: int, width: int, key: str = "id", seed: int = 42, params: str | None = None) -> DataFrame:
    """What one degradation would do to every image's signature."""
    spark: SparkSession = images.sparkSession
    name = next((k for k, (_, d) in simulate.SCENARIOS.items() if d == kind), None)
    if name is None:
        raise ValueError(f"degradations are {', '.join(simulate.DEGRADATIONS)}")
    return changes(images, simulate.scenario(spark, (name,), (severity,)), height, width, key, seed, params).drop("level")


def quality_report(df: DataFrame, group: str, a: str, b: str, features: Sequence[str]) -> dict[str, DataFrame]:
    """Six tables on features of two domains: relevance, variability, flags, Pearson and Spearman pairs, redundant pairs, domain differences."""
    features = list(features)
    return {
        "engineering_relevance": statistics.relevance(df.sparkSession),
        "variability": statistics.variability(df, features),
        "flags": statistics.flags(statistics.described(df, features, [])).select("feature", "flags"),
        "correlations": statistics.pearson_pairs(df, features).withColumnRenamed("r", "pearson").join(statistics.spearman_pairs(df, features).withColumnRenamed("r", "spearman"), ["a", "b"]),
        "redundancy": statistics.correlated(df, features),
        "cross_domain": statistics.two_samples(df, group, a, b, features),
    }


def grouped_correlations(df: DataFrame, group: str, features: Sequence[str]) -> DataFrame:
    """Pearson coefficients of all pairs of features by group, in one pass; null for a constant feature."""
    features = list(features)
    pairs = [(x, y) for k, x in enumerate(features) for y in features[k + 1 :]]
    r = lambda x, y: F.when((F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0), F.covar_pop(x, y) / (F.stddev_pop(x) * F.stddev_pop(y)))
    one = df.groupBy(group).agg(*(r(x, y).alias(f"{x}|{y}") for x, y in pairs))
    rows: Column = F.array(*(F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"`{x}|{y}`").alias("r")) for x, y in pairs))
    return one.select(group, F.inline(rows))
