"""Population baseline: fitted in one aggregation, applied as column expressions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The shares of a chi-squared distribution at the ends of the states, and the features of each health dimension.
ALPHAS = {"early": 0.95, "significant": 0.99, "critical": 0.999}
DIMENSIONS = {
    "contrast": ("std_intensity", "rms_contrast", "dynamic_range"),
    "noise_texture": ("speckle_proxy", "entropy"),
    "sharpness": ("sharpness_laplacian", "gradient_mean", "gradient_std"),
    "structure": ("edge_density", "gradient_mean", "gradient_max"),
    "uniformity": ("coefficient_variation", "uniformity"),
}


def chi2_cdf(x: float, df: int) -> float:
    """The lower incomplete gamma function of df / 2 at x / 2, by its series."""
    if x <= 0:
        return 0.0
    a, x = df / 2, x / 2
    term = total = 1 / a
    k = a
    while term > total * 1e-17:
        k += 1
        term *= x / k
        total += term
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def chi2_quantile(p: float, df: int) -> float:
    low, high = 0.0, 10.0 * df + 100
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_cdf(middle, df) < p else (low, middle)
    return high


class Baseline:
    """Means, standard deviations (n - 1, plus 1e-12), the Ledoit-Wolf precision matrix of z-scores, and chi-squared thresholds.

    What comes to the driver is one row of sums, p * p of them for p features, whatever the table's size. Nulls, NaN and
    infinite values in a feature are an error.
    """

    def __init__(self, df: DataFrame, features: list[str], alphas: dict[str, float] = ALPHAS):
        if len(features) < 2 or len(set(features)) < len(features):
            raise ValueError("a baseline has two features at least, each once")
        if set(alphas) != set(ALPHAS) or not 0 < alphas["early"] < alphas["significant"] < alphas["critical"] < 1:
            raise ValueError("alphas ascend from early over significant to critical, between 0 and 1")
        self.features, self.alphas = list(features), dict(alphas)
        finite = [F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double")) & (F.abs(F.col(f)) < F.lit(math.inf)) for f in features]
        moments = df.agg(F.count("*").alias("n"), *(F.count_if(~c).alias(f"x_{f}") for c, f in zip(finite, features)), *(F.avg(f).alias(f"m_{f}") for f in features), *(F.stddev_samp(f).alias(f"s_{f}") for f in features)).first()
        self.n = moments["n"]
        if self.n < 2:
            raise ValueError("a baseline needs two rows at least")
        odd = [f for f in features if moments[f"x_{f}"]]
        if odd:
            raise ValueError(f"values that aren't finite in {', '.join(odd)}")
        self.mean = np.array([moments[f"m_{f}"] for f in features], float)
        self.std = np.array([moments[f"s_{f}"] for f in features], float) + 1e-12
        z = self.scores()
        p = len(features)
        pairs = [(i, j) for i in range(p) for j in range(i + 1)]
        sums = df.agg(*(F.sum(z[i] * z[j]) for i, j in pairs), *(F.sum(z[i] * z[i] * z[j] * z[j]) for i, j in pairs)).first()
        cross, fourth = np.zeros((p, p)), np.zeros((p, p))
        for k, (i, j) in enumerate(pairs):
            cross[i, j] = cross[j, i] = sums[k]
            fourth[i, j] = fourth[j, i] = sums[len(pairs) + k]
        n = self.n
        s = cross / n
        mu = np.trace(s) / p
        delta_ = (cross**2).sum() / n**2
        beta = (fourth.sum() / n - delta_) / (n * p)
        delta = (delta_ - 2 * mu * np.trace(s) + p * mu**2) / p
        self.shrinkage = float(min(beta, delta) / delta) if delta > 0 else 0.0
        self.covariance = (1 - self.shrinkage) * s + self.shrinkage * mu * np.eye(p)
        self.precision = np.linalg.inv(self.covariance)
        self.thresholds = {k: chi2_quantile(a, p) for k, a in alphas.items()}

    def scores(self) -> list[Column]:
        return [(F.col(f) - float(m)) / float(s) for f, m, s in zip(self.features, self.mean, self.std)]

    def distance(self) -> Column:
        """Squared Mahalanobis distance, at least 0."""
        z = self.scores()
        total = F.lit(0.0)
        for i in range(len(z)):
            for j in range(i + 1):
                total = total + float(self.precision[i, j] * (1 if i == j else 2)) * z[i] * z[j]
        return F.greatest(total, F.lit(0.0))

    def contributions(self) -> list[Column]:
        """Each feature's share of the squared z-scores; 0 for all if these add up to nothing."""
        z = self.scores()
        total = sum((x * x for x in z[1:]), z[0] * z[0])
        return [F.when(total > 1e-15, x * x / total).otherwise(F.lit(0.0)) for x in z]

    def state(self, d2: Column) -> Column:
        return state(d2, *(self.thresholds[k] for k in ALPHAS))

    def quality(self, d2: Column) -> Column:
        return quality(d2, self.thresholds["critical"])

    def dimensions(self, dimensions: dict[str, tuple[str, ...]] = DIMENSIONS) -> dict[str, Column]:
        """Mean size of the z-scores of each dimension's features; features that the model lacks are left out, and so are dimensions without any."""
        z = dict(zip(self.features, self.scores()))
        own = {k: [F.abs(z[f]) for f in names if f in z] for k, names in dimensions.items()}
        return {k: sum(v[1:], v[0]) / len(v) for k, v in own.items() if v}

    def detected(self, df: DataFrame) -> DataFrame:
        """df with d2, distance, state, z (array), contributions (map by feature), quality and anomaly."""
        names = F.array(*map(F.lit, self.features))
        out = df.withColumns({"d2": self.distance(), "z": F.array(*self.scores()), "contributions": F.map_from_arrays(names, F.array(*self.contributions()))})
        return out.withColumns({"distance": F.sqrt("d2"), "state": self.state(F.col("d2")), "quality": self.quality(F.col("d2")), "anomaly": self.state(F.col("d2")) != "NOMINAL"})

    def quality_reference(self, df: DataFrame) -> DataFrame:
        """Mean and standard deviation (n - 1) of the squared distances of df."""
        return df.select(self.distance().alias("d2")).agg(F.avg("d2").alias("mean_d2"), F.stddev_samp("d2").alias("std_d2"))

    def summary(self, spark: SparkSession) -> DataFrame:
        """The model as one row."""
        row = (self.features, int(self.n), self.mean.tolist(), self.std.tolist(), self.precision.tolist(), float(self.shrinkage), self.thresholds)
        return spark.createDataFrame([row], "features array<string>, n bigint, mean array<double>, std array<double>, precision array<array<double>>, shrinkage double, thresholds map<string,double>")


def state(d2: Column, early: float, significant: float, critical: float) -> Column:
    return F.when(d2 <= early, "NOMINAL").when(d2 <= significant, "EARLY_DRIFT").when(d2 <= critical, "SIGNIFICANT_DRIFT").otherwise("HIGH_DEVIATION")


def quality(d2: Column, critical: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * (1 - d2 / critical)))


def explained(contributions: Column, most: int = 5) -> Column:
    """The features of largest contribution, ranked from 1; equal ones by name."""
    if most < 1:
        raise ValueError("an explanation names one feature at least")
    ranked = F.array_sort(F.transform(F.map_entries(contributions), lambda e: F.struct((-e["value"]).alias("minus"), e["key"].alias("feature"))))
    return F.transform(F.slice(ranked, 1, most), lambda x, i: F.struct(x["feature"].alias("feature"), (-x["minus"]).alias("contribution"), (i + 1).alias("rank")))


def explanation_text(state: Column, items: Column) -> Column:
    line = lambda x: F.concat(F.lit("- "), x["feature"], F.lit(": "), F.format_string("%.2f%%", 100 * x["contribution"]))
    head = F.concat(F.lit("State="), state)
    return F.when(F.size(items) > 0, F.concat_ws("\n", head, F.lit("Largest statistical contributions:"), F.array_join(F.transform(items, line), "\n"))).otherwise(F.concat(head, F.lit(" | no contributions")))


def deviations(df: DataFrame, keys: list[str], reference: DataFrame, features: list[str]) -> DataFrame:
    """Every feature of every row against the reference's mean and deviation: keys, feature, value, mean, std, z, rank by size of z."""
    stats = reference.unpivot([], features, "feature", "v").groupBy("feature").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))
    rows = df.unpivot(keys, features, "feature", "value").join(F.broadcast(stats), "feature")  # a row for each feature
    z = (F.col("value") - F.col("mean")) / F.when(F.col("std") > 0, F.col("std"))
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(F.abs("z")), "feature")
    return rows.withColumn("z", z).withColumn("rank", F.row_number().over(w)).select(*keys, "feature", "value", "mean", "std", "z", "rank")
