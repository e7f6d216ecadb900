"""Descriptive statistics, comparisons of samples, and intervals.

Moments are one aggregation each. What depends on order (quantiles, ranks, distances of distributions) goes through
``cumulative``: values are counted, the counts are dealt by range, and every part adds up its own after what the parts
before it hold, so that no task sorts or holds a whole column.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import written

PERCENTILES = (1, 5, 25, 50, 75, 95, 99)
# Candidate features and their groups, and screening thresholds.
CANDIDATES = {"mean_intensity": "intensity", "std_intensity": "intensity", "min_intensity": "intensity", "max_intensity": "intensity", "dynamic_range": "intensity", "percentile_contrast": "intensity", "entropy": "information_texture", "mean_gradient": "structural_variation", "std_gradient": "structural_variation", "edge_density": "structural_variation", "sharpness": "sharpness"}
NEAR_CONSTANT, REDUNDANT, VERY_REDUNDANT, SHIFT_SMD, SHIFT_KS = 0.01, 0.90, 0.95, 0.50, 0.20
EXTREMA = ("min_intensity", "max_intensity", "dynamic_range")


def unpivoted(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    return df.unpivot(keys, features, "feature", "v")


def real(column: str) -> Column:
    return F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))


def cumulative(counted: DataFrame, keys: list[str], value: str, sums: list[str]) -> DataFrame:
    """counted (keys, value, sums; a row for each value) with s_before (in smaller values of its key) and s_total for every sum s."""
    dealt, _ = written(counted.repartitionByRange(*keys, value).withColumn("__part", F.spark_partition_id()), "dealt")
    own = dealt.groupBy(*keys, "__part").agg(*(F.sum(s).alias(s) for s in sums))
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    # a row for each part and key
    parts = own.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__part").alias("__p"), *(F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"__{s}") for s in sums), *(F.sum(s).over(whole).alias(f"{s}_total") for s in sums))
    rows = dealt.join(parts, [F.col("__part") == F.col("__p"), *(F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys)])
    run = Window.partitionBy(*keys, "__part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(*keys, value, *sums, *((F.col(f"__{s}") + F.coalesce(F.sum(s).over(run), F.lit(0))).alias(f"{s}_before") for s in sums), *(f"{s}_total" for s in sums))


def counted(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.where(real(value)).groupBy(*keys, value).agg(F.count("*").alias("c"))


def quantiles(ranked: DataFrame, keys: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Of cumulative counts c: each key's quantiles by name, exact, with linear interpolation between ranks."""
    v, n = F.col(value), F.col("c_total")
    inside = lambda rank: (rank >= F.col("c_before")) & (rank < F.col("c_before") + F.col("c"))
    at = lambda p: (n - 1) * F.lit(p)
    ends = [f(F.when(inside(g(at(p))), v)).alias(f"{k}_{name}") for k, p in points.items() for name, f, g in (("low", F.max, F.floor), ("high", F.max, F.ceil))]
    shares = [F.max(at(p) - F.floor(at(p))).alias(f"{k}_share") for k, p in points.items()]
    out = ranked.groupBy(*keys).agg(F.max("c_total").alias("n"), *ends, *shares) if keys else ranked.agg(F.max("c_total").alias("n"), *ends, *shares)
    return out.select(*keys, *((F.col(f"{k}_low") + (F.col(f"{k}_high") - F.col(f"{k}_low")) * F.col(f"{k}_share")).alias(k) for k in points))


def _spread(counts: DataFrame, keys: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Of counted values: quantiles, and mad, the median distance from the one named median."""
    counts, _ = written(counts, "counts")
    middle = quantiles(cumulative(counts, keys, value, ["c"]), keys, value, points)
    middle, _ = written(middle, "quantiles")
    both = counts.join(F.broadcast(middle.select(*keys, "median")), keys) if keys else counts.crossJoin(F.broadcast(middle.select("median")))  # a row for each key
    gaps = both.select(*keys, F.abs(F.col(value) - F.col("median")).alias("gap"), "c").groupBy(*keys, "gap").agg(F.sum("c").alias("c"))
    mad = quantiles(cumulative(gaps, keys, "gap", ["c"]), keys, "gap", {"mad": 0.5})
    return middle.join(mad, keys) if keys else middle.crossJoin(mad)


def _moments(value: str = "v", n: str = "c") -> list[Column]:
    """Of counted values: n, mean, sum of squares about it, smallest and largest. The mean of squares is taken about a value of the group, so that digits last."""
    return [F.sum(n).alias("n"), (F.sum(F.col(value) * F.col(n)) / F.sum(n)).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.count("*").alias("unique_values")]


def calibration(df: DataFrame, value: str) -> DataFrame:
    """n, mean, sd (n - 1), median, unscaled MAD, minimum, maximum and seven percentiles of the values that are numbers."""
    rows = df.where(real(value)).select(F.col(value).cast("double").alias("v"))
    one = rows.agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    ordered = _spread(counted(rows, [], "v"), [], "v", {"median": 0.5} | {f"p{p}": p / 100 for p in PERCENTILES})
    return one.crossJoin(ordered).select("n", "mean", "std", "median", "mad", "min", "max", *(f"p{p}" for p in PERCENTILES))  # one row each


def variability(df: DataFrame, features: list[str], near_constant: float = NEAR_CONSTANT) -> DataFrame:
    """By feature: n, mean, sd (n - 1; 0 for one value), median, IQR, MAD, coefficient of variation (null for a mean of 0)."""
    out = described(df, features, [])
    cv = F.when(F.abs("mean") > 1e-12, F.col("std") / F.abs("mean"))
    return out.select("feature", "n", "mean", "std", "median", "iqr", "mad", cv.alias("cv"), F.coalesce(cv < near_constant, F.lit(False)).alias("near_constant"))


def described(df: DataFrame, features: list[str], groups: list[str]) -> DataFrame:
    """By groups and feature: n, mean, std (n - 1; 0 for one value), median, q25, q75, iqr, mad, min, max, unique_values, cv_abs."""
    keys = [*groups, "feature"]
    long = unpivoted(df, groups, features).where(real("v"))
    moments = long.groupBy(*keys).agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    counts = counted(long, keys, "v")
    counts, _ = written(counts, "counts")
    ordered = _spread(counts, keys, "v", {"median": 0.5, "q25": 0.25, "q75": 0.75})
    unique = counts.groupBy(*keys).agg(F.count("*").alias("unique_values"))
    out = moments.join(ordered, keys).join(unique, keys)
    return out.select(*keys, "n", "mean", "std", "median", "q25", "q75", (F.col("q75") - F.col("q25")).alias("iqr"), "mad", "min", "max", "unique_values", F.when(F.abs("mean") > 1e-12, F.col("std") / F.abs("mean")).alias("cv_abs"))


def pooled_and_grouped(df: DataFrame, group: str, features: list[str]) -> DataFrame:
    """Population statistics of each feature over all rows (group null) and by group, in one pass."""
    long = unpivoted(df, [group], features)
    sets = long.groupingSets([["feature", group], ["feature"]], "feature", group)
    return sets.agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))


def flags(described: DataFrame) -> DataFrame:
    """Of described features: which to distrust as they are defined. Three distinct values at most, an edge share fixed by construction, extrema."""
    own = F.array_compact(F.array(F.when(F.col("unique_values") <= 3, "near_constant"), F.when((F.col("feature") == "edge_density") & (F.col("std") < 0.005), "definitionally_constrained"), F.when(F.col("feature").isin(*EXTREMA), "extrema_or_saturation_sensitive")))
    return described.withColumn("flags", own)


def effect_size(d: Column) -> Column:
    """Cohen's bands."""
    return F.when(F.abs(d) < 0.2, "negligible").when(F.abs(d) < 0.5, "small").when(F.abs(d) < 0.8, "medium").when(d.isNotNull(), "large")


def relevance(spark: SparkSession) -> DataFrame:
    """Candidate features, their groups and their places."""
    return spark.createDataFrame([(k, g, n) for n, (k, g) in enumerate(CANDIDATES.items())], "feature string, engineering_group string, place int")


def _correlations(df: DataFrame, features: list[str], value) -> DataFrame:
    """Of every pair of columns, all from one row of sums; null for a constant column."""
    pairs = [(a, b) for k, a in enumerate(features) for b in features[k + 1 :]]
    one = df.agg(*(F.when((F.stddev_pop(value(a)) > 0) & (F.stddev_pop(value(b)) > 0), F.covar_pop(value(a), value(b)) / (F.stddev_pop(value(a)) * F.stddev_pop(value(b)))).alias(f"{a}|{b}") for a, b in pairs))
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs))
    return one.select(F.inline(rows))


def pearson_pairs(df: DataFrame, features: list[str]) -> DataFrame:
    return _correlations(df, features, F.col)


def average_rank(df: DataFrame, column: str) -> DataFrame:
    """Distinct values with their tie-averaged rank."""
    ranked = cumulative(df.groupBy(column).agg(F.count("*").alias("c")), [], column, ["c"])
    return ranked.select(column, (F.col("c_before") + (F.col("c") + 1) / 2).alias(f"{column}_rank"))


def spearman_pairs(df: DataFrame, features: list[str]) -> DataFrame:
    ranked = df.select(*features)
    for f in features:
        ranked = ranked.join(average_rank(df.select(f), f), f)
    return _correlations(ranked, features, lambda c: F.col(f"{c}_rank"))


def correlated(df: DataFrame, features: list[str], least: float = REDUNDANT, very: float = VERY_REDUNDANT) -> DataFrame:
    """Pairs of features whose Pearson or Spearman coefficient is at least `least` in size, the strongest first, and whether one is very high."""
    both = pearson_pairs(df, features).withColumnRenamed("r", "pearson").join(spearman_pairs(df, features).withColumnRenamed("r", "spearman"), ["a", "b"])
    size = F.greatest(F.abs("pearson"), F.abs("spearman"))
    return both.withColumn("strength", size).where(F.col("strength") >= least).withColumn("very_high", F.col("strength") >= very).orderBy(F.desc("strength"), "a", "b")


def redundancy(pairs: DataFrame) -> DataFrame:
    """Pairs with a level: HIGH from 0.9 in size, MODERATE from 0.7."""
    return pairs.withColumn("level", F.when(F.abs("r") >= 0.9, "HIGH").when(F.abs("r") >= 0.7, "MODERATE").otherwise("LOW"))


def ks_chance(distance: Column, a: Column, b: Column, terms: int = 100) -> Column:
    """The asymptotic two-sided chance of a Kolmogorov-Smirnov distance between samples of sizes a and b."""
    root = F.sqrt(a * b / (a + b))
    x = (root + 0.12 + 0.11 / root) * distance
    total = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * x * x * k * k))
    return F.when(x <= 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))


def two_samples(df: DataFrame, group: str, a: str, b: str, features: list[str]) -> DataFrame:
    """By feature: means, standardised mean difference (unweighted variances), Cohen's d (weighted) and the KS distance with its chance."""
    long = unpivoted(df.where(F.col(group).isin(a, b)), [group], features).where(real("v"))
    of = lambda x: F.when(F.col(group) == x, F.col("v"))
    own = long.groupBy("feature").agg(*(f(of(x)).alias(f"{n}_{k}") for x, k in ((a, "a"), (b, "b")) for f, n in ((F.count, "n"), (F.avg, "mean"), (F.var_samp, "var"))))
    gap = F.col("mean_a") - F.col("mean_b")
    some = lambda x: F.when(x > 1e-12, x)
    smd = gap / some(F.sqrt((F.col("var_a") + F.col("var_b")) / 2))
    pooled = some(F.sqrt(((F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b")) / (F.col("n_a") + F.col("n_b") - 2)))
    steps = cumulative(long.groupBy("feature", "v").agg(F.count(of(a)).alias("x"), F.count(of(b)).alias("y")), ["feature"], "v", ["x", "y"])
    up_to = lambda s: (F.col(f"{s}_before") + F.col(s)) / F.col(f"{s}_total")
    ks = steps.groupBy("feature").agg(F.max(F.abs(up_to("x") - up_to("y"))).alias("ks"))
    out = own.join(ks, "feature").select("feature", "n_a", "n_b", "mean_a", "mean_b", smd.alias("smd"), (gap / pooled).alias("cohens_d"), "ks")
    return out.select("feature", "mean_a", "mean_b", "smd", "cohens_d", "ks", ks_chance(F.col("ks"), F.col("n_a"), F.col("n_b")).alias("ks_p"), ((F.abs("smd") >= SHIFT_SMD) | (F.col("ks") >= SHIFT_KS)).alias("domain_sensitive"))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def confusion(df: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """Detection metrics; undefined ratios are 0, and specificity is 1 less the false-positive rate."""
    n = df.agg(*(F.count_if(c).alias(k) for k, c in (("tp", predicted & actual), ("fp", predicted & ~actual), ("tn", ~predicted & ~actual), ("fn", ~predicted & actual))))
    return rates(n, [])


def rates(n: DataFrame, keys: list[str]) -> DataFrame:
    tp, fp, tn, fn = map(F.col, ("tp", "fp", "tn", "fn"))
    recall, fpr, precision = ratio(tp, tp + fn), ratio(fp, fp + tn), ratio(tp, tp + fp)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))
    return n.select(*keys, "tp", "fp", "tn", "fn", recall.alias("detection_rate"), recall.alias("sensitivity"), fpr.alias("false_positive_rate"), (1 - fpr).alias("specificity"), precision.alias("precision"), f1.alias("f1"), ratio(tn, tn + fn).alias("negative_predictive_value"), ((recall + 1 - fpr) / 2).alias("balanced_accuracy"))


STATES = ("NOMINAL", "EARLY_DRIFT", "SIGNIFICANT_DRIFT", "HIGH_DEVIATION")


def detection_metrics(df: DataFrame, keys: list[str], distance: str, state: str, expected: Column) -> DataFrame:
    """By keys: confusion metrics with every state but NOMINAL as an anomaly, rates of the states, and mean and deviation (population) of the distances."""
    found = F.col(state) != "NOMINAL"
    counts = [("tp", found & expected), ("fp", found & ~expected), ("tn", ~found & ~expected), ("fn", ~found & expected)]
    every = [F.count("*").alias("n"), *(F.count_if(c).alias(k) for k, c in counts), *(ratio(F.count_if(F.col(state) == s), F.count("*")).alias(f"{s.lower()}_rate") for s in STATES), F.avg(distance).alias("mean_distance"), F.stddev_pop(distance).alias("std_distance")]
    n = df.groupBy(*keys).agg(*every) if keys else df.agg(*every)
    own = ["n", *(f"{s.lower()}_rate" for s in STATES), "mean_distance", "std_distance"]
    return rates(n, [*keys, *own])


def normal_quantile(confidence: float) -> float:
    """z of a two-sided interval."""
    if not 0 < confidence < 1:
        raise ValueError("confidence lies between 0 and 1")
    return NormalDist().inv_cdf((1 + confidence) / 2)


def wilson(successes: Column, trials: Column, z: float) -> tuple[Column, Column]:
    p, zz = successes / trials, z * z
    middle, half = p + zz / (2 * trials), z * F.sqrt(p * (1 - p) / trials + zz / (4 * trials * trials))
    return F.greatest(F.lit(0.0), (middle - half) / (1 + zz / trials)), F.least(F.lit(1.0), (middle + half) / (1 + zz / trials))


def required_sequences(spark: SparkSession, target: float, confidence: float = 0.95, alarms: int = 0, most: int = 100_000) -> DataFrame:
    """The smallest n whose Wilson upper bound with so many alarms is at most target; null if there is none up to most."""
    if not 0 < target < 1 or not 0 <= alarms < most:
        raise ValueError("the target lies between 0 and 1, and alarms below the largest size")
    n = spark.range(max(1, alarms), most + 1)
    _, high = wilson(F.lit(alarms), F.col("id").cast("double"), normal_quantile(confidence))
    return n.where(high <= target).agg(F.min("id").alias("n"))


def bootstrap_mean(df: DataFrame, value: str, order: list[str], resamples: int = 2000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """Percentile interval of the mean: n, mean, low, high.

    In each resample a row counts as often as a Poisson draw of mean 1 says, which is what drawing n of n rows tends to; the draw is
    a function of row and resample, so rows needn't meet and each partition adds up its own. Every resample is one sum.
    """
    if resamples < 100:
        raise ValueError("a bootstrap has 100 resamples at least")
    name = F.concat_ws(":", *(F.col(c).cast("string") for c in order), F.lit(str(seed)))
    rows = df.select(F.col(value).cast("double").alias("v"), F.xxhash64(name).alias("h")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    u = (F.pmod(F.xxhash64("h", "b"), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    steps = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(18)]
    draws = F.lit(0)
    for s in steps:
        draws = draws + (u > s).cast("int")
    sums = rows.withColumn("w", draws).groupBy("b").agg(F.sum(F.col("w") * F.col("v")).alias("s"), F.sum("w").alias("n"))
    tail = (1 - confidence) / 2
    ends = sums.where("n > 0").agg(F.percentile(F.col("s") / F.col("n"), [tail, 1 - tail]).alias("q"))  # a value a resample
    return df.agg(F.count(value).alias("n"), F.avg(value).alias("mean")).crossJoin(ends).select("n", "mean", F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"))


def repeatability(df: DataFrame, features: list[str], session: str | None = None) -> DataFrame:
    """By feature: n, mean, std (n - 1), cv (by the mean's size, 1e-8 at least), and with sessions their mean std and the range of their means.

    The last two are null unless there are two sessions, each of two rows at least.
    """
    long = unpivoted(df.withColumn("__s", F.col(session) if session else F.lit("")), ["__s"], features)
    every = long.groupBy("feature").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))
    own = long.groupBy("feature", "__s").agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.stddev_samp("v").alias("s"))
    own = own.groupBy("feature").agg(F.count("*").alias("sessions"), F.min("n").alias("least"), F.avg("s").alias("within"), (F.max("m") - F.min("m")).alias("between"))
    fits = (F.col("sessions") >= 2) & (F.col("least") >= 2)
    return every.join(own, "feature").select("feature", "n", "mean", "std", (F.col("std") / F.greatest(F.abs("mean"), F.lit(1e-8))).alias("cv"), "sessions", F.when(fits, F.col("within")).alias("within_session_std"), F.when(fits, F.col("between")).alias("between_session_range"))


def robustness_margin(delta: Column, noise: Column, times: float = 3.0) -> Column:
    return delta - times * noise


def principal_components(df: DataFrame, features: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Of standardised features (population deviation): components (place, variance, share, cumulative, dominant) and loadings (component, feature, loading).

    The p * p correlations are one row of sums; their eigenvectors are found on the driver, as p is a schema's width.
    """
    import numpy as np

    spark, p = df.sparkSession, len(features)
    row = df.agg(F.count("*").alias("n"), *(F.stddev_pop(f).alias(f"s{i}") for i, f in enumerate(features)), *(F.covar_pop(F.col(f), F.col(g)).alias(f"c{i}_{j}") for i, f in enumerate(features) for j, g in enumerate(features[: i + 1]))).first()
    n = row["n"]
    r = np.array([[row[f"c{max(i, j)}_{min(i, j)}"] / (row[f"s{i}"] * row[f"s{j}"]) for j in range(p)] for i in range(p)])
    values, vectors = np.linalg.eigh(r * n / (n - 1))
    order = np.argsort(values)[::-1]
    values, vectors = np.clip(values[order], 0, None), vectors[:, order]
    vectors *= np.sign(vectors[np.abs(vectors).argmax(0), np.arange(p)])
    share = values / values.sum()
    loadings = vectors * np.sqrt(values)
    top = [features[i] for i in np.abs(loadings).argmax(0)]
    components = spark.createDataFrame([(k + 1, float(values[k]), float(share[k]), float(share[: k + 1].sum()), top[k]) for k in range(p)], "component int, variance double, share double, cumulative double, dominant string")
    long = spark.createDataFrame([(k + 1, f, float(loadings[i, k])) for k in range(p) for i, f in enumerate(features)], "component int, feature string, loading double")
    return components, long


def components_needed(components: DataFrame, share: float) -> DataFrame:
    return components.where(F.col("cumulative") >= share - 1e-12).agg(F.min("component").alias("components"))
