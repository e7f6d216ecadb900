"""Ordered operators over series: control charts, trends, forecasts. Series are independent and are kept apart by key.

Everything is a window over one series' order: CUSUM by its closed form (a running sum less its running extreme), runs of
alarms by the last row without one, and exponential means by as many rows as still weigh at all. A series streams
through one task in its order; no row carries what came before it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Weight at which older rows of an exponential mean are left out; far below what a double holds beside 1.
NEGLIGIBLE = 1e-18
MODELS = ("persistence", "moving_average", "exponential_smoothing", "linear_trend")


def ordered(key: str | list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*order)


def numbered(df: DataFrame, key: str | list[str], order: list[str]) -> DataFrame:
    """df with t, the place in its series from 0."""
    return df.withColumn("t", F.row_number().over(ordered(key, order)) - 1)


def _reach(keep: float) -> int:
    return math.ceil(math.log(NEGLIGIBLE) / math.log(keep)) if keep > 0 else 0


def ewma(value: Column, w: WindowSpec, alpha: float) -> Column:
    """alpha of the value and the rest of what was before, from 0."""
    return F.aggregate(F.collect_list(value).over(w.rowsBetween(-_reach(1 - alpha), 0)), F.lit(0.0), lambda a, x: (1 - alpha) * a + alpha * x)


def signals(df: DataFrame, key: str | list[str], order: list[str], z: Column, alpha: float, allowance: float) -> DataFrame:
    """df with z, ewma, and both CUSUMs as sizes: cusum_up, cusum_down.

    max(0, before + z - allowance) is the running sum of z - allowance less its running minimum, 0 included.
    """
    w = ordered(key, order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("z", z).withColumns({"ewma": ewma(F.col("z"), w, alpha), "__up": F.sum(F.col("z") - allowance).over(so_far), "__down": F.sum(-F.col("z") - allowance).over(so_far)})
    clipped = lambda c: F.col(c) - F.least(F.lit(0.0), F.min(c).over(so_far))
    return out.withColumns({"cusum_up": clipped("__up"), "cusum_down": clipped("__down")}).drop("__up", "__down")


def chart(df: DataFrame, key: str, order: list[str], z: Column, lam: float = 0.2, limit: float = 3.0, k: float = 0.5, h: float = 5.0, run: int = 3) -> DataFrame:
    """EWMA and two-sided CUSUM of z-scores with alarms, the length of the present run of alarms, and a status.

    cusum_neg is 0 or less. An alarm is a z-score at limit, an EWMA at its own limit, or a CUSUM at h.
    """
    bound = limit * (lam / (2 - lam)) ** 0.5
    out = signals(numbered(df, key, order), key, order, z, lam, k)
    alarm = (F.abs("z") >= limit) | (F.abs("ewma") >= bound) | (F.col("cusum_up") >= h) | (F.col("cusum_down") >= h)
    so_far = ordered(key, ["t"]).rowsBetween(Window.unboundedPreceding, 0)
    quiet = F.max(F.when(~F.col("alarm"), F.col("t"))).over(so_far)
    out = out.withColumn("alarm", alarm).withColumn("run", F.col("t") - F.coalesce(quiet, F.lit(-1)))
    status = F.when(F.col("run") >= run, "PERSISTENT_DRIFT").when(F.col("run") > 0, "DRIFT_SIGNAL").otherwise("STABLE")
    return out.select(key, "t", "ewma", F.col("cusum_up").alias("cusum_pos"), (0.0 - F.col("cusum_down")).alias("cusum_neg"), "z", "run", status.alias("status"))


def trend(df: DataFrame, key: str, t: Column, value: str, threshold: float = 0.01) -> DataFrame:
    """Least squares on the index: slope, intercept, R squared (1 for a constant series), direction, strength and the next value."""
    out = df.withColumn("__t", t).groupBy(key).agg(F.count("*").alias("n"), F.regr_slope(value, "__t").alias("slope"), F.regr_intercept(value, "__t").alias("intercept"), F.regr_r2(value, "__t").alias("r2"))
    r2 = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("r2")))
    direction = F.when(F.col("slope") > threshold, "INCREASING").when(F.col("slope") < -threshold, "DECREASING").otherwise("STABLE")
    return out.select(key, "n", "slope", "intercept", r2.alias("r2"), direction.alias("direction"), (F.abs("slope") * F.sqrt(r2)).alias("strength"), (F.col("slope") * F.col("n") + F.col("intercept")).alias("next"))


def running_trend(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """The least-squares slope, intercept and R squared of every beginning of a series."""
    rows = numbered(df, key, order)
    seen = ordered(key, ["t"]).rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(key, "t", *(f(F.col(value), F.col("t")).over(seen).alias(n) for f, n in ((F.regr_slope, "slope"), (F.regr_intercept, "intercept"), (F.regr_r2, "r2"))))


def forecasts(df: DataFrame, key: str, order: list[str], value: str, initial: int, width: int = 5, alpha: float = 0.3, horizon: int = 1, step: int = 1) -> DataFrame:
    """Forecasts of every model at rolling origins: key, t (what is forecast), actual, a column a model, and scale.

    An origin is a number of values seen: initial, initial + step, and so on; only the horizon-th value after it is forecast.
    scale is the mean step between the first `initial` values.
    """
    w = ordered(key, order)
    rows = numbered(df, key, order)
    v, t = F.col(value), F.col("t")
    before = w.rowsBetween(Window.unboundedPreceding, -horizon)
    linear = F.regr_slope(v, t).over(before) * t + F.regr_intercept(v, t).over(before)
    recent = F.collect_list(v).over(w.rowsBetween(-horizon - _reach(1 - alpha), -horizon))
    level = F.aggregate(F.slice(recent, 2, _reach(1 - alpha) + 1), F.get(recent, F.lit(0)), lambda a, x: alpha * x + (1 - alpha) * a)
    steps = F.abs(v - F.lag(v).over(w))
    whole = Window.partitionBy(key)
    out = rows.withColumn("__step", F.when(t.between(1, initial - 1), steps)).select(
        key, "t", v.alias("actual"), F.lag(v, horizon).over(w).alias("persistence"), F.avg(v).over(w.rowsBetween(-horizon - width + 1, -horizon)).alias("moving_average"),
        level.alias("exponential_smoothing"), linear.alias("linear_trend"), F.avg("__step").over(whole).alias("scale"),
    )
    origin = t - horizon + 1
    return out.where((origin >= initial) & ((origin - initial) % step == 0))


def forecast_errors(made: DataFrame, key: str, models: tuple[str, ...] = MODELS, eps: float = 1e-12) -> DataFrame:
    """By series and model: n, MAE, RMSE, MASE and MAE relative to persistence (null where the divisor is eps or less)."""
    long = made.unpivot([key, "t", "actual", "scale"], list(models), "model", "forecast")
    e = F.col("forecast") - F.col("actual")
    out = long.groupBy(key, "model").agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.max("scale").alias("scale"))
    base = F.max(F.when(F.col("model") == "persistence", F.col("mae"))).over(Window.partitionBy(key))
    return out.withColumns({"mase": F.when(F.col("scale") > eps, F.col("mae") / F.col("scale")), "relative_mae": F.when(base > eps, F.col("mae") / base), "base_mae": base}).drop("scale")


def benchmark(errors: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """By model, over series: wins, ties and losses against persistence, means of the series' errors, and undefined ratios."""
    gap, near = F.col("mae") - F.col("base_mae"), F.lit(tolerance) * F.greatest(F.lit(1.0), F.col("mae"), F.col("base_mae"))
    counts = {"wins": gap < -near, "ties": F.abs(gap) <= near, "losses": gap > near}
    means = {f"mean_{c}": F.avg(c) for c in ("mae", "rmse", "mase", "relative_mae")}
    return errors.groupBy("model").agg(F.count("*").alias("series"), *(F.count_if(c).alias(k) for k, c in counts.items()), *(c.alias(k) for k, c in means.items()), F.count_if(F.col("relative_mae").isNull()).alias("undefined_relative"), F.count_if(F.col("mase").isNull()).alias("undefined_mase"))


def conformal_radius(residuals: DataFrame, key: str, residual: Column, alpha: float = 0.1) -> DataFrame:
    """The k-th smallest absolute residual, k = min(n, ceil((n + 1)(1 - alpha)))."""
    w = Window.partitionBy(key)
    ranked = residuals.select(key, F.abs(residual).alias("radius"), F.count("*").over(w).alias("n"), F.row_number().over(w.orderBy(F.abs(residual))).alias("rank"))
    return ranked.where(F.col("rank") == F.least(F.col("n"), F.ceil((F.col("n") + 1) * F.lit(1 - alpha)))).select(key, "n", "rank", "radius")


def intervals(prediction: Column, radius: Column) -> tuple[Column, Column]:
    return prediction - radius, prediction + radius


def interval_quality(df: DataFrame, keys: list[str], actual: Column, lower: Column, upper: Column, nominal: float) -> DataFrame:
    """Coverage (both ends belong to an interval) and its gap to the nominal one, widths, and misses below and above."""
    inside = (actual >= lower) & (actual <= upper)
    rate = lambda c: F.avg(c.cast("double"))
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), rate(inside).alias("coverage"), F.avg(upper - lower).alias("mean_width"), F.median(upper - lower).alias("median_width"), rate(actual < lower).alias("lower_miss_rate"), rate(actual > upper).alias("upper_miss_rate"))
    return out.withColumn("coverage_gap", F.col("coverage") - nominal)
