"""Queries over series: events by user, in order of time."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftmill.operators import drift, history, series

from .common import events, rounded
from .oracles import CHART, FORECASTS, SERIES

KEY, ORDER = "user_id", ["ts", "event_id"]
SEEDS, CALIBRATION_SEEDS = (11, 23, 37, 41, 53), tuple(range(101, 161))
CANDIDATES = ((0.6, 4.0), (0.8, 5.0), (1.0, 6.0), (1.5, 8.0), (3.0, 5.0), (3.0, 12.0), (1.2, 20.0))


def _chart(spark, sf_dir):
    rows = events(spark, sf_dir)
    model = rows.agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    z = rows.crossJoin(F.broadcast(model)).withColumn("z", (F.col("value") - F.col("m")) / F.col("s"))  # one row
    return series.chart(z, KEY, ORDER, F.col("z"))


def control_chart(spark, sf_dir):
    return rounded(_chart(spark, sf_dir))


def state_counts(spark, sf_dir):
    return history.counts(_chart(spark, sf_dir), "status")


def drift_alarms(spark, sf_dir):
    return rounded(history.alarms(_chart(spark, sf_dir), KEY, "t", F.col("status") != "STABLE", F.col("status") == "PERSISTENT_DRIFT"))


def latest_states(spark, sf_dir):
    return rounded(history.latest(_chart(spark, sf_dir).select(KEY, "t", "z", "ewma", "status"), KEY, ["t"]))


def history_series(spark, sf_dir):
    """Every user's statuses and places as text, so that engines print them alike."""
    out = history.ordered_series(_chart(spark, sf_dir), KEY, ["t"], ["t", "status"])
    return out.select(KEY, F.array_join(F.transform("t", lambda x: x.cast("string")), ",").alias("ts"), F.array_join("status", ",").alias("statuses"))


def history_summary(spark, sf_dir):
    rows = _chart(spark, sf_dir).withColumns({"state": F.when(F.col("status") == "STABLE", "NOMINAL").otherwise(F.col("status")), "quality": F.col("t").cast("double") % 10})
    return history.summary(rows, KEY, ["t"], "state", "quality")


def history_stages(spark, sf_dir):
    rows = history.stages(series.numbered(events(spark, sf_dir), KEY, ORDER), F.col("t"), 20, 10)
    return rows.groupBy("stage").agg(F.count("*").alias("n"))


def history_sources(spark, sf_dir):
    return history.sources(events(spark, sf_dir), "event_type")


def trend_ols(spark, sf_dir):
    rows = series.numbered(events(spark, sf_dir), KEY, ORDER)
    return rounded(series.trend(rows, KEY, F.col("t"), "value"))


def running_trend(spark, sf_dir):
    return rounded(series.running_trend(events(spark, sf_dir), KEY, ORDER, "value").where("t > 0"), 9)


def _forecasts(spark, sf_dir):
    return series.forecasts(events(spark, sf_dir), KEY, ORDER, "value", 10)


def rolling_forecasts(spark, sf_dir):
    return rounded(_forecasts(spark, sf_dir).drop("scale"), 9)


def far_forecasts(spark, sf_dir):
    """Three steps ahead, from every second origin."""
    return rounded(series.forecasts(events(spark, sf_dir), KEY, ORDER, "value", 10, horizon=3, step=2), 9)


def forecast_benchmark(spark, sf_dir):
    return rounded(series.forecast_errors(_forecasts(spark, sf_dir), KEY).drop("base_mae"))


def model_benchmark(spark, sf_dir):
    return rounded(series.benchmark(series.forecast_errors(_forecasts(spark, sf_dir), KEY)))


def conformal_radius(spark, sf_dir):
    return rounded(series.conformal_radius(_forecasts(spark, sf_dir), KEY, F.col("actual") - F.col("moving_average")))


def interval_quality(spark, sf_dir):
    """Intervals calibrated on the forecasts of even places, judged on those of odd ones."""
    made = _forecasts(spark, sf_dir).select(KEY, "t", "actual", "moving_average")
    radius = series.conformal_radius(made.where("t % 2 = 0"), KEY, F.col("actual") - F.col("moving_average"))
    rows = made.where("t % 2 = 1").join(radius.select(KEY, "radius"), KEY)
    low, high = series.intervals(F.col("moving_average"), F.col("radius"))
    return rounded(series.interval_quality(rows, [KEY], F.col("actual"), low, high, 0.9))


def sequential_monitor(spark, sf_dir):
    """Every user's second half against the median and MAD of the first."""
    rows = series.numbered(events(spark, sf_dir), KEY, ORDER)
    sizes = rows.groupBy(KEY).agg(F.floor(F.count("*") / 2).alias("half"), F.count("*").alias("n"))
    rows = rows.join(sizes, KEY).where("half >= 5")
    first = F.col("t") < F.col("half")
    parts = rows.select(KEY, F.when(first, "reference").otherwise("observation").alias("part"), F.when(first, F.col("t")).otherwise(F.col("t") - F.col("half")).alias("t"), F.col("value").alias("v"))
    seen = drift.monitored(parts, [KEY])
    return rounded(seen.select(KEY, "t", "z", "ewma", "cusum_up", "cusum_down", drift.alarm().alias("alarm")))


def _seen(spark, kinds, seeds, noises=(0.2, 0.35, 0.6), magnitudes=(1.0, 2.5, 4.0)):
    return drift.monitored(drift.observed(drift.trials(spark, kinds, seeds, noises, magnitudes)), drift.TRIAL)


def drift_trials(spark, sf_dir):
    return rounded(drift.detection(_seen(spark, drift.KINDS, SEEDS), drift.TRIAL, drift.alarm()))


def drift_grid(spark, sf_dir):
    return rounded(drift.aggregated(drift.detection(_seen(spark, drift.KINDS, SEEDS), drift.TRIAL, drift.alarm()), ["kind"]))


def drift_sensitivity(spark, sf_dir):
    return rounded(drift.aggregated(drift.detection(_seen(spark, drift.KINDS, SEEDS), drift.TRIAL, drift.alarm()), ["kind", "noise", "magnitude"]))


def threshold_scores(spark, sf_dir):
    seen = _seen(spark, ("nominal",), CALIBRATION_SEEDS, (0.35,))
    return rounded(drift.candidate_scores(seen, drift.TRIAL, CANDIDATES, 0.1))


def threshold_evaluation(spark, sf_dir):
    """The chosen thresholds on trials of other seeds."""
    best = drift.calibrated(drift.candidate_scores(_seen(spark, ("nominal",), CALIBRATION_SEEDS, (0.35,)), drift.TRIAL, CANDIDATES, 0.1))
    seen = _seen(spark, drift.KINDS, SEEDS).crossJoin(F.broadcast(best))  # one row
    metrics = drift.detection(seen, drift.TRIAL, drift.alarm(F.col("ewma_threshold"), F.col("cusum_threshold")))
    return rounded(drift.evaluated(metrics).crossJoin(best))


QUERIES = (control_chart, state_counts, drift_alarms, latest_states, history_series, history_summary, history_stages, history_sources, trend_ols, running_trend, rolling_forecasts, far_forecasts, forecast_benchmark, model_benchmark, conformal_radius, interval_quality, sequential_monitor, drift_trials, drift_grid, drift_sensitivity, threshold_scores, threshold_evaluation)

_ERRORS = f"""{FORECASTS}, long AS (SELECT user_id, t, actual, scale, model, forecast FROM made UNPIVOT (forecast FOR model IN (persistence, moving_average, exponential_smoothing, linear_trend))),
      e AS (SELECT user_id, model, count(*) AS n, avg(abs(forecast - actual)) AS mae, sqrt(avg((forecast - actual) ^ 2)) AS rmse, max(scale) AS scale FROM long GROUP BY 1, 2),
      b AS (SELECT e.*, p.mae AS base, CASE WHEN e.scale > 1e-12 THEN e.mae / e.scale END AS mase, CASE WHEN p.mae > 1e-12 THEN e.mae / p.mae END AS rel FROM e JOIN e p ON p.user_id = e.user_id AND p.model = 'persistence')"""
_RADIUS = """r AS (SELECT user_id, radius FROM (SELECT user_id, abs(actual - moving_average) AS radius, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY abs(actual - moving_average)) AS rank FROM made WHERE t % 2 = 0) WHERE rank = least(n, CAST(ceil((n + 1) * 0.9::DOUBLE) AS BIGINT)))"""
_UNIFORM = "((CAST('0x' || substr(md5({}), 1, 8) AS UBIGINT)) + 0.5::DOUBLE) / 4294967296.0::DOUBLE"
def _trials(kinds: tuple[str, ...], seeds: tuple[int, ...], noises: tuple[float, ...], name: str) -> str:
    values = lambda xs: ", ".join(f"({x!r})" for x in xs)
    u = lambda x: _UNIFORM.format(f"n || ':{x}'")
    return f"""{name}_g AS (SELECT kind, CAST(seed AS BIGINT) AS seed, CAST(noise AS DOUBLE) AS noise, CAST(magnitude AS DOUBLE) AS magnitude FROM (VALUES {values(kinds)}) k(kind) CROSS JOIN (VALUES {values(seeds)}) s(seed) CROSS JOIN (VALUES {values(noises)}) o(noise) CROSS JOIN (VALUES (1.0), (2.5), (4.0)) m(magnitude) WHERE kind IN ('gradual_drift', 'abrupt_shift') OR magnitude = 1.0),
  {name}_k AS (SELECT *, concat_ws(':', kind, seed, printf('%.4f', noise), printf('%.4f', magnitude), k) AS n FROM {name}_g CROSS JOIN range(240) r(k)),
  {name}_v AS (SELECT kind, seed, noise, magnitude, k, CASE WHEN k < 120 THEN k ELSE k - 120 END AS t, noise * CASE WHEN k >= 120 AND kind = 'noisy_nominal' THEN 2.5 ELSE 1 END * sqrt(-2 * ln({u('a')})) * cos(2 * pi() * {u('b')})
    + CASE WHEN k < 180 THEN 0 WHEN kind = 'gradual_drift' THEN magnitude * (k - 180) / 60 WHEN kind = 'abrupt_shift' THEN magnitude ELSE 0 END AS v FROM {name}_k),
  {name}_c AS (SELECT kind, seed, noise, magnitude, median(v) AS c FROM {name}_v WHERE k < 120 GROUP BY ALL),
  {name}_s AS (SELECT kind, seed, noise, magnitude, any_value(c) AS c, 1.4826 * median(abs(v - c)) AS s FROM {name}_v JOIN {name}_c USING (kind, seed, noise, magnitude) WHERE k < 120 GROUP BY ALL),
  {name}_z AS (SELECT kind, seed, noise, magnitude, t, (v - c) / s AS z FROM {name}_v JOIN {name}_s USING (kind, seed, noise, magnitude) WHERE k >= 120),
  {name} AS (SELECT kind, seed, noise, magnitude, t, 0.2 * z AS e, greatest(0, z - 0.5) AS p, greatest(0, -z - 0.5) AS q FROM {name}_z WHERE t = 0
    UNION ALL SELECT kind, seed, noise, magnitude, z.t, 0.2 * z.z + 0.8 * x.e, greatest(0, x.p + z.z - 0.5), greatest(0, x.q - z.z - 0.5) FROM {name} x JOIN {name}_z z USING (kind, seed, noise, magnitude) WHERE z.t = x.t + 1)"""


def _metrics(name: str, alarm: str) -> str:
    return f"""d AS (SELECT kind, seed, noise, magnitude, t, CASE WHEN kind IN ('gradual_drift', 'abrupt_shift') THEN 60 END AS change, {alarm} AS alarm FROM {name}),
  m AS (SELECT kind, seed, noise, magnitude, count(*) AS n, max(change) AS change, count(*) FILTER (alarm) AS alarms, count(*) FILTER (alarm AND (change IS NULL OR t < change)) AS false_alarms, min(t) FILTER (alarm AND t >= change) AS hit, min(t) FILTER (alarm) AS first_alarm FROM d GROUP BY ALL),
  met AS (SELECT kind, seed, noise, magnitude, n, CAST(change AS BIGINT) AS change, alarms, false_alarms, false_alarms / coalesce(change, n) AS share, hit IS NOT NULL AS detected, hit - change AS delay, first_alarm FROM m)"""


_FIXED = "abs(e) >= 3 OR greatest(p, q) >= 5"
_GRID = f"WITH RECURSIVE {_trials(drift.KINDS, SEEDS, (0.2, 0.35, 0.6), 'x')}, {_metrics('x', _FIXED)}"
_AGGREGATES = "count(*) AS trials, round(avg(CASE WHEN detected THEN 1.0 ELSE 0 END), 6) AS detection_rate, round(avg(share), 6) AS mean_false_alarm_fraction, round(avg(delay), 6) AS mean_delay, round(median(delay), 6) AS median_delay, count(delay) AS detected_trials"
_Z = 1.959963984540054


def _wilson(hits: str, n: str) -> tuple[str, str]:
    p = f"({hits} / {n})"
    half = f"{_Z}::DOUBLE * sqrt({p} * (1 - {p}) / {n} + {_Z * _Z!r}::DOUBLE / (4.0 * {n} * {n}))"
    middle = f"({p} + {_Z * _Z!r}::DOUBLE / (2.0 * {n}))"
    return tuple(f"{f}({end}.0, ({middle} {sign} {half}) / (1 + {_Z * _Z!r}::DOUBLE / {n}))" for f, sign, end in (("greatest", "-", 0), ("least", "+", 1)))


_LOW, _HIGH = _wilson("alarmed", "sequences")
_PAIRS = ", ".join(f"({e}::DOUBLE, {c}::DOUBLE)" for e, c in CANDIDATES)
_SCORES = f"""{_trials(('nominal',), CALIBRATION_SEEDS, (0.35,), 'y')},
  peaks AS (SELECT kind, seed, noise, magnitude, max(abs(e)) AS e, max(greatest(p, q)) AS c FROM y GROUP BY ALL),
  s AS (SELECT ewma_threshold, cusum_threshold, count(*) AS sequences, count(*) FILTER (e >= ewma_threshold OR c >= cusum_threshold) AS alarmed FROM peaks CROSS JOIN (VALUES {_PAIRS}) v(ewma_threshold, cusum_threshold) GROUP BY 1, 2),
  scores AS (SELECT *, {_LOW} AS lower, {_HIGH} AS upper FROM s)"""
_NL, _NH = _wilson("alarmed", "nominal")
_DL, _DH = _wilson("found", "changed")

ORACLES = {
    "control_chart": f"{CHART} SELECT * FROM chart",
    "state_counts": f"{CHART} SELECT status, count(*) AS n FROM chart GROUP BY status",
    "drift_alarms": f"{CHART} SELECT user_id, count(*) AS n, count(*) FILTER (status <> 'STABLE') AS alarms, min(t) FILTER (status <> 'STABLE') AS first_alarm, bool_or(status = 'PERSISTENT_DRIFT') AS persistent FROM chart GROUP BY user_id",
    "latest_states": f"{CHART} SELECT user_id, max(t) AS t, arg_max(z, t) AS z, arg_max(ewma, t) AS ewma, arg_max(status, t) AS status FROM chart GROUP BY user_id",
    "history_series": f"{CHART} SELECT user_id, string_agg(CAST(t AS VARCHAR), ',' ORDER BY t) AS ts, string_agg(status, ',' ORDER BY t) AS statuses FROM chart GROUP BY user_id",
    "history_summary": f"{CHART} SELECT user_id, concat_ws(' | ', 'states=' || count(*), 'latest=' || arg_max(CASE status WHEN 'STABLE' THEN 'NOMINAL' ELSE status END, t), 'mean_quality=' || printf('%.2f', avg(t % 10)), 'not_nominal=' || count(*) FILTER (status <> 'STABLE')) AS summary FROM chart GROUP BY user_id",
    "history_stages": f"WITH {SERIES} SELECT CASE WHEN t < 20 THEN 'baseline' WHEN t < 30 THEN 'calibration' ELSE 'test' END AS stage, count(*) AS n FROM s GROUP BY 1",
    "history_sources": "SELECT DISTINCT event_type FROM events",
    "trend_ols": f"""WITH {SERIES}, r AS (SELECT user_id, count(*) AS n, regr_slope(value, t) AS slope, regr_intercept(value, t) AS intercept, least(1, greatest(0, regr_r2(value, t))) AS r2 FROM s GROUP BY user_id)
      SELECT user_id, n, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r2, 6) AS r2, CASE WHEN slope > 0.01 THEN 'INCREASING' WHEN slope < -0.01 THEN 'DECREASING' ELSE 'STABLE' END AS direction, round(abs(slope) * sqrt(r2), 6) AS strength, round(slope * n + intercept, 6) AS next FROM r""",
    "running_trend": f"""WITH {SERIES}, r AS (SELECT user_id, t, regr_slope(value, t) OVER w AS slope, regr_intercept(value, t) OVER w AS intercept, regr_r2(value, t) OVER w AS r2 FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING))
      SELECT user_id, t, round(slope, 9) + 0 AS slope, round(intercept, 9) AS intercept, round(r2, 9) AS r2 FROM r WHERE t > 0""",
    "rolling_forecasts": f"{FORECASTS} SELECT user_id, t, round(actual, 9) AS actual, round(persistence, 9) AS persistence, round(moving_average, 9) AS moving_average, round(exponential_smoothing, 9) AS exponential_smoothing, round(linear_trend, 9) AS linear_trend FROM made",
    "far_forecasts": f"""WITH RECURSIVE {SERIES}, l AS (SELECT user_id, t, value AS level FROM s WHERE t = 0 UNION ALL SELECT s.user_id, s.t, 0.3 * s.value + 0.7 * l.level FROM l JOIN s ON s.user_id = l.user_id AND s.t = l.t + 1),
      d AS (SELECT user_id, avg(abs(value - b)) AS scale FROM (SELECT user_id, t, value, lag(value) OVER (PARTITION BY user_id ORDER BY t) AS b FROM s) WHERE t BETWEEN 1 AND 9 GROUP BY user_id),
      f AS (SELECT user_id, t, value AS actual, lag(value, 3) OVER (PARTITION BY user_id ORDER BY t) AS persistence, avg(value) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN 7 PRECEDING AND 3 PRECEDING) AS moving_average,
        regr_slope(value, t) OVER b * t + regr_intercept(value, t) OVER b AS linear_trend FROM s WINDOW b AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 3 PRECEDING))
      SELECT f.user_id, f.t, round(actual, 9) AS actual, round(persistence, 9) AS persistence, round(moving_average, 9) AS moving_average, round(l.level, 9) AS exponential_smoothing, round(linear_trend, 9) AS linear_trend, round(scale, 9) AS scale
      FROM f JOIN l ON l.user_id = f.user_id AND l.t = f.t - 3 JOIN d ON d.user_id = f.user_id WHERE f.t >= 12 AND (f.t - 12) % 2 = 0""",
    "forecast_benchmark": f"{_ERRORS} SELECT user_id, model, n, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(mase, 6) AS mase, round(rel, 6) AS relative_mae FROM b",
    "model_benchmark": f"""{_ERRORS}, c AS (SELECT *, mae - base AS gap, 1e-12 * greatest(1, mae, base) AS tol FROM b)
      SELECT model, count(*) AS series, count(*) FILTER (gap < -tol) AS wins, count(*) FILTER (abs(gap) <= tol) AS ties, count(*) FILTER (gap > tol) AS losses, round(avg(mae), 6) AS mean_mae, round(avg(rmse), 6) AS mean_rmse, round(avg(mase), 6) AS mean_mase, round(avg(rel), 6) AS mean_relative_mae, count(*) FILTER (rel IS NULL) AS undefined_relative, count(*) FILTER (mase IS NULL) AS undefined_mase FROM c GROUP BY model""",
    "conformal_radius": f"""{FORECASTS}, r AS (SELECT user_id, abs(actual - moving_average) AS radius, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY abs(actual - moving_average)) AS rank FROM made)
      SELECT user_id, n, rank, round(radius, 6) AS radius FROM r WHERE rank = least(n, CAST(ceil((n + 1) * 0.9::DOUBLE) AS BIGINT))""",
    "interval_quality": f"""{FORECASTS}, {_RADIUS}, i AS (SELECT user_id, actual, moving_average - radius AS lo, moving_average + radius AS hi FROM made JOIN r USING (user_id) WHERE t % 2 = 1), c AS (SELECT user_id, count(*) AS n, avg(CASE WHEN actual BETWEEN lo AND hi THEN 1.0 ELSE 0 END) AS coverage, avg(hi - lo) AS mw, median(hi - lo) AS dw, avg(CASE WHEN actual < lo THEN 1.0 ELSE 0 END) AS l, avg(CASE WHEN actual > hi THEN 1.0 ELSE 0 END) AS u FROM i GROUP BY user_id)
      SELECT user_id, n, round(coverage, 6) AS coverage, round(mw, 6) AS mean_width, round(dw, 6) AS median_width, round(l, 6) AS lower_miss_rate, round(u, 6) AS upper_miss_rate, round(coverage - 0.9::DOUBLE, 6) AS coverage_gap FROM c""",
    "sequential_monitor": f"""WITH RECURSIVE {SERIES}, h AS (SELECT user_id, count(*) // 2 AS half FROM s GROUP BY user_id HAVING count(*) // 2 >= 5), f AS (SELECT user_id, median(value) AS c FROM s JOIN h USING (user_id) WHERE t < half GROUP BY user_id),
      k AS (SELECT user_id, any_value(c) AS c, 1.4826 * median(abs(value - c)) AS s FROM s JOIN h USING (user_id) JOIN f USING (user_id) WHERE t < half GROUP BY user_id), z AS (SELECT user_id, t - half AS t, (value - c) / k.s AS z FROM s JOIN h USING (user_id) JOIN k USING (user_id) WHERE t >= half),
      x AS (SELECT user_id, t, z, 0.2 * z AS e, greatest(0, z - 0.5) AS p, greatest(0, -z - 0.5) AS q FROM z WHERE t = 0 UNION ALL SELECT user_id, z.t, z.z, 0.2 * z.z + 0.8 * x.e, greatest(0, x.p + z.z - 0.5), greatest(0, x.q - z.z - 0.5) FROM x JOIN z USING (user_id) WHERE z.t = x.t + 1)
      SELECT user_id, t, round(z, 6) AS z, round(e, 6) AS ewma, round(p, 6) AS cusum_up, round(q, 6) AS cusum_down, {_FIXED} AS alarm FROM x""",
    "drift_trials": f"{_GRID} SELECT kind, seed, round(noise, 6) AS noise, round(magnitude, 6) AS magnitude, n, change, alarms, false_alarms, round(share, 6) AS false_alarm_fraction, detected, delay, first_alarm FROM met",
    "drift_grid": f"{_GRID} SELECT kind, {_AGGREGATES} FROM met GROUP BY kind",
    "drift_sensitivity": f"{_GRID} SELECT kind, round(noise, 6) AS noise, round(magnitude, 6) AS magnitude, {_AGGREGATES} FROM met GROUP BY kind, noise, magnitude",
    "threshold_scores": f"WITH RECURSIVE {_SCORES} SELECT ewma_threshold, cusum_threshold, sequences, alarmed, round(alarmed / sequences, 6) AS rate, round(lower, 6) AS lower, round(upper, 6) AS upper, upper <= 0.1 AS eligible FROM scores",
    "threshold_evaluation": f"""WITH RECURSIVE {_SCORES}, best AS (SELECT ewma_threshold, cusum_threshold FROM scores WHERE upper <= 0.1 ORDER BY ewma_threshold + cusum_threshold, ewma_threshold, cusum_threshold LIMIT 1), {_trials(drift.KINDS, SEEDS, (0.2, 0.35, 0.6), 'x')}, w AS (SELECT * FROM x CROSS JOIN best),
      {_metrics('w', 'abs(e) >= ewma_threshold OR greatest(p, q) >= cusum_threshold')}, c AS (SELECT count(*) FILTER (change IS NULL) AS nominal, count(*) FILTER (change IS NULL AND alarms > 0) AS alarmed, count(*) FILTER (change IS NOT NULL) AS changed, count(*) FILTER (change IS NOT NULL AND detected) AS found, avg(share) AS s, avg(delay) AS d FROM met)
      SELECT nominal, changed, round(alarmed / nominal, 6) AS false_alarm_rate, round({_NL}, 6) AS false_alarm_lower, round({_NH}, 6) AS false_alarm_upper, round(found / changed, 6) AS detection_rate, round({_DL}, 6) AS detection_lower, round({_DH}, 6) AS detection_upper, round(s, 6) AS mean_false_alarm_fraction, round(d, 6) AS mean_delay, ewma_threshold, cusum_threshold FROM c, best""",
}
