"""Synthetic drift scenarios, the robust sequential monitor, and its evaluation and calibration.

Noise is a function of the trial's name and the row's place (two MD5 words through Box and Muller), so that any executor, and
any other engine, makes the same rows again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import series
from .statistics import wilson

KINDS = ("nominal", "gradual_drift", "abrupt_shift", "noisy_nominal")
CHANGED = ("gradual_drift", "abrupt_shift")
TRIAL = ["kind", "seed", "noise", "magnitude"]


def uniform(name: Column) -> Column:
    """In (0, 1), from the first 32 bits of the name's MD5."""
    return (F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def normal(name: Column) -> Column:
    return F.sqrt(-2 * F.log(uniform(F.concat(name, F.lit(":a"))))) * F.cos(2 * F.pi() * uniform(F.concat(name, F.lit(":b"))))


def trials(spark: SparkSession, kinds: Sequence[str] = KINDS, seeds: Sequence[int] = (11, 23, 37, 41, 53), noises: Sequence[float] = (0.2, 0.35, 0.6), magnitudes: Sequence[float] = (1.0, 2.5, 4.0)) -> DataFrame:
    """A row for each trial of the grid; only kinds with a change are crossed with all magnitudes."""
    for name, own in (("kinds", kinds), ("seeds", seeds), ("noise levels", noises), ("magnitudes", magnitudes)):
        if not own or len(set(own)) != len(own):
            raise ValueError(f"{name} must be there and differ")
    if set(kinds) - set(KINDS):
        raise ValueError(f"kinds are {', '.join(KINDS)}")
    if min(noises) <= 0 or min(magnitudes) <= 0:
        raise ValueError("noise levels and magnitudes must be positive")
    rows = [(k, int(s), float(n), float(m)) for k in kinds for s in seeds for n in noises for m in (magnitudes if k in CHANGED else magnitudes[:1])]
    return spark.createDataFrame(rows, "kind string, seed bigint, noise double, magnitude double")


def observed(trials: DataFrame, reference: int = 120, observations: int = 120, change: int | None = None, season: float = 0.0) -> DataFrame:
    """Every trial's rows: part (reference or observation), t, v and change (the first changed place; null without one)."""
    if reference < 5 or observations < 1:
        raise ValueError("a reference has five rows at least, observations one")
    change = max(1, observations // 2) if change is None else change
    if not 0 <= change < observations:
        raise ValueError("the change lies within the observations")
    changed = F.col("kind").isin(*CHANGED)
    rows = trials.withColumn("change", F.when(changed, F.lit(change))).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(reference + observations - 1))))
    is_reference = F.col("k") < reference
    t = F.when(is_reference, F.col("k")).otherwise(F.col("k") - reference)
    name = F.concat_ws(":", "kind", "seed", F.format_string("%.4f", "noise"), F.format_string("%.4f", "magnitude"), "k")
    noise = F.col("noise") * F.when(~is_reference & (F.col("kind") == "noisy_nominal"), 2.5).otherwise(1.0)
    ramp = F.greatest(t - change, F.lit(0)) / float(max(1, observations - change))
    drift = F.when(is_reference | (t < change), 0.0).when(F.col("kind") == "gradual_drift", F.col("magnitude") * ramp).when(F.col("kind") == "abrupt_shift", F.col("magnitude")).otherwise(0.0)
    waves = F.when(is_reference, 0.0).otherwise(season * F.sin(2 * F.pi() * t / max(8.0, observations / 4)))
    return rows.select(*TRIAL, F.when(is_reference, "reference").otherwise("observation").alias("part"), t.cast("int").alias("t"), (noise * normal(name) + drift + waves).alias("v"), F.col("change"))


def robust_scale(reference: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Centre (median) and scale (1.4826 MAD, or the standard deviation where that is 0) of each key; other rows are an error."""
    middle = reference.groupBy(*keys).agg(F.median(value).alias("centre"))
    out = reference.join(middle, keys).groupBy(*keys, "centre").agg(F.count("*").alias("n"), (1.4826 * F.median(F.abs(F.col(value) - F.col("centre")))).alias("mad"), F.stddev_samp(value).alias("sd"))
    tiny = F.lit(2.220446049250313e-16)
    scale = F.when(F.col("mad") > tiny, F.col("mad")).when(F.col("sd") > tiny, F.col("sd")).otherwise(F.raise_error(F.lit("a constant reference has no scale")).cast("double"))
    few = F.when(F.col("n") >= 5, scale).otherwise(F.raise_error(F.lit("a reference has five rows at least")).cast("double"))
    return out.select(*keys, "centre", few.alias("scale"))


def monitored(rows: DataFrame, keys: list[str], value: str = "v", alpha: float = 0.2, allowance: float = 0.5) -> DataFrame:
    """Observations of each key by its own reference rows: z, ewma, cusum_up and cusum_down at every place."""
    own = robust_scale(rows.where("part = 'reference'"), keys, value)
    seen = rows.where("part = 'observation'").join(own, keys)
    return series.signals(seen, keys, ["t"], (F.col(value) - F.col("centre")) / F.col("scale"), alpha, allowance).drop("centre", "scale")


def alarm(ewma_threshold: Column | float = 3.0, cusum_threshold: Column | float = 5.0) -> Column:
    """The EWMA is held against the threshold itself, not against its asymptotic limit."""
    return (F.abs("ewma") >= ewma_threshold) | (F.greatest("cusum_up", "cusum_down") >= cusum_threshold)


def detection(seen: DataFrame, keys: list[str], alarm: Column) -> DataFrame:
    """By trial: alarms, false alarms (all without a change, else those before it) and their share, detection, delay, first alarm."""
    change = F.max("change")
    hit = F.min(F.when(alarm & (F.col("t") >= F.col("change")), F.col("t")))
    false = F.count_if(alarm & (F.col("change").isNull() | (F.col("t") < F.col("change"))))
    out = seen.groupBy(*keys).agg(F.count("*").alias("n"), change.alias("change"), F.count_if(alarm).alias("alarms"), false.alias("false_alarms"), hit.alias("hit"), F.min(F.when(alarm, F.col("t"))).alias("first_alarm"))
    share = F.col("false_alarms") / F.greatest(F.coalesce("change", "n"), F.lit(1))
    return out.select(*keys, "n", "change", "alarms", "false_alarms", share.alias("false_alarm_fraction"), F.col("hit").isNotNull().alias("detected"), (F.col("hit") - F.col("change")).alias("delay"), "first_alarm")


def aggregated(metrics: DataFrame, by: list[str]) -> DataFrame:
    """Trials, detection rate, mean share of false alarms, and mean and median delay of what was detected."""
    return metrics.groupBy(*by).agg(F.count("*").alias("trials"), F.avg(F.col("detected").cast("double")).alias("detection_rate"), F.avg("false_alarm_fraction").alias("mean_false_alarm_fraction"), F.avg("delay").alias("mean_delay"), F.median("delay").alias("median_delay"), F.count("delay").alias("detected_trials"))


def candidate_scores(seen: DataFrame, keys: list[str], candidates: Sequence[tuple[float, float]], target: float, z: float = 1.959963984540054) -> DataFrame:
    """For each pair of thresholds: nominal sequences with an alarm, their share with its Wilson interval, and whether the upper end meets the target.

    A sequence has an alarm at a pair if its largest EWMA or CUSUM reaches it, so each is reduced to two numbers first.
    """
    if not candidates or len(set(candidates)) != len(candidates):
        raise ValueError("candidates must be there and differ")
    peaks = seen.groupBy(*keys).agg(F.max(F.abs("ewma")).alias("e"), F.max(F.greatest("cusum_up", "cusum_down")).alias("c"))
    pairs = F.explode(F.array(*(F.struct(F.lit(float(e)).alias("ewma_threshold"), F.lit(float(c)).alias("cusum_threshold")) for e, c in candidates)))
    out = peaks.select("e", "c", pairs.alias("p")).groupBy("p.ewma_threshold", "p.cusum_threshold")
    out = out.agg(F.count("*").alias("sequences"), F.count_if((F.col("e") >= F.col("p.ewma_threshold")) | (F.col("c") >= F.col("p.cusum_threshold"))).alias("alarmed"))
    low, high = wilson(F.col("alarmed"), F.col("sequences"), z)
    return out.select("ewma_threshold", "cusum_threshold", "sequences", "alarmed", (F.col("alarmed") / F.col("sequences")).alias("rate"), low.alias("lower"), high.alias("upper"), (high <= target).alias("eligible"))


def calibrated(scores: DataFrame) -> DataFrame:
    """The eligible pair of smallest sum, then EWMA, then CUSUM threshold; one row, or none if no pair meets the target."""
    place = F.struct((F.col("ewma_threshold") + F.col("cusum_threshold")).alias("sum"), "ewma_threshold", "cusum_threshold")
    return scores.where("eligible").agg(F.min(place).alias("p")).where("p IS NOT NULL").select("p.ewma_threshold", "p.cusum_threshold")


def overlapping(calibration: DataFrame, evaluation: DataFrame, key: str = "seed") -> DataFrame:
    """Seeds that calibration and evaluation share; there must be none."""
    return calibration.select(key).distinct().join(evaluation.select(key).distinct(), key)


def evaluated(metrics: DataFrame, z: float = 1.959963984540054) -> DataFrame:
    """Share of nominal trials with an alarm and of changed ones detected, with Wilson intervals (null without such trials)."""
    nominal = F.col("change").isNull()
    out = metrics.agg(F.count_if(nominal).alias("nominal"), F.count_if(nominal & (F.col("alarms") > 0)).alias("alarmed"), F.count_if(~nominal).alias("changed"), F.count_if(~nominal & F.col("detected")).alias("found"), F.avg("false_alarm_fraction").alias("mean_false_alarm_fraction"), F.avg("delay").alias("mean_delay"))
    both = {}
    for name, hits, n in (("false_alarm", "alarmed", "nominal"), ("detection", "found", "changed")):
        some = F.when(F.col(n) > 0, F.col(n))
        low, high = wilson(F.col(hits), some, z)
        both |= {f"{name}_rate": F.col(hits) / some, f"{name}_lower": F.when(some.isNotNull(), low), f"{name}_upper": F.when(some.isNotNull(), high)}
    return out.select("nominal", "changed", *(c.alias(k) for k, c in both.items()), "mean_false_alarm_fraction", "mean_delay")
