"""The whole analysis of acquisitions, from pixels to a decision, as one plan over all rows; and queries of controlled experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftmill.operators import baseline, causal, decisions, experiments, history, models, series, signature, simulate
from driftmill.operators.baseline import Baseline
from driftmill.operators.tables import written

from .common import FEATURES, images, rounded, table

SIDE = 8


def analyzed(acquisitions: DataFrame, model: Baseline, ai: models.AnomalyModel, calibration: tuple[float, float], height: int, width: int, top: int = 5) -> DataFrame:
    """Every acquisition (id, source, t, px, params) with its signature's detection, model assessment, evidence, health, drift so far, trend and decision.

    calibration is mean and deviation of the squared distances of held-out rows; drift and trend run over each source in
    the order of t, so one pass gives what replaying the history for each row would.
    """
    keys = ["id", "source", "t"]
    rows = signature.signatures(acquisitions, keys, height, width, params="params")
    rows = ai.assessed(model.detected(rows))
    # signatures and scores are made once: drift, causes and the rest all read them
    rows, _ = written(rows, "scored")
    gaps = rows.unpivot([*keys], model.features, "feature", "v")
    means = F.create_map(*(x for f, m in zip(model.features, model.mean) for x in (F.lit(f), F.lit(float(m)))))
    cause = causal.ranked(gaps.select(*keys, "feature", (F.col("v") - F.element_at(means, F.col("feature"))).alias("delta")), keys).where("rank = 1")
    mean, std = calibration
    chart = series.chart(rows.select("source", F.col("t").alias("at"), "d2"), "source", ["at"], (F.col("d2") - mean) / std).select("source", F.col("t").alias("nth"), "status", "run")
    numbered = rows.withColumn("nth", F.row_number().over(Window.partitionBy("source").orderBy("t")) - 1)
    so_far = Window.partitionBy("source").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    out = numbered.join(chart, ["source", "nth"]).join(cause.select(*keys, F.col("mechanism"), F.col("score").alias("causal")), keys)
    out = out.withColumn("lasting", F.bool_or(F.col("status") == "PERSISTENT_DRIFT").over(so_far))
    out = out.withColumn("slope", F.when(F.col("nth") > 0, F.regr_slope("d2", "nth").over(so_far)))
    critical = model.thresholds["critical"]
    odd = 1 - F.col("physical_consistency_score")
    fused = decisions.fuse_intelligence(F.col("d2"), critical, F.col("quality"), F.col("assessment.score"), F.col("assessment.confidence"), odd)
    evidence = decisions.fuse_evidence(F.array(decisions.clipped(F.col("d2") / critical), F.col("assessment.score"), odd, F.col("causal"), F.lit(None).cast("double")))
    n = len(model.features)
    health = decisions.assessment(F.col("quality"), F.col("distance"), F.lit(model.n), F.lit(n), decisions.provenance_score(F.col("source")), n)
    out = out.withColumns({"fusion": fused, "evidence": evidence, "health": health, "explanation": baseline.explained(F.col("contributions"), top)})
    decision = decisions.decision(F.col("state"), F.col("fusion.state"), F.col("fusion.confidence"), F.col("health.state"), F.col("health.confidence"), F.col("status"), F.col("lasting"))
    return out.select(*keys, "d2", "distance", "state", "quality", "assessment", "fusion", "evidence", "mechanism", "causal", "health", "explanation", F.col("status").alias("drift"), "lasting", "slope", decision.alias("decision"))


def _acquisitions(spark, sf_dir) -> DataFrame:
    n = F.col("vec_id")
    params = F.create_map(F.lit("frequency_mhz"), (3 + n % 5).cast("string"), F.lit("depth"), (40 + n % 50).cast("string"))
    return images(spark, sf_dir).select(n.cast("string").alias("id"), F.when(n % 2 == 0, "public").otherwise("simulated").alias("source"), n.alias("t"), "px", params.alias("params"))


def _fitted(rows: DataFrame) -> tuple[Baseline, DataFrame]:
    own, _ = written(signature.signatures(rows, ["id", "source", "t"], SIDE, SIDE, params="params"), "signatures")
    return Baseline(own, experiments.varying(own, signature.FEATURES)), own


def twin_states(spark, sf_dir):
    """The first half of the images is the baseline, all are analysed."""
    rows = _acquisitions(spark, sf_dir)
    half = rows.count() // 2
    model, own = _fitted(rows.where(F.col("t") < half))
    ai = models.AnomalyModel(own, model.features, trees=50, seeds=models.SEEDS[:3])
    reference = model.quality_reference(own).first()
    out = analyzed(rows, model, ai, (reference["mean_d2"], reference["std_d2"]), SIDE, SIDE)
    return rounded(out.select("id", "source", "t", "d2", "state", "quality", F.col("fusion.fused").alias("fused"), F.col("evidence.fusion").alias("evidence"), "mechanism", F.col("health.index").alias("health"), F.element_at("explanation", 1)["feature"].alias("dominant"), "drift", "lasting", "slope", F.col("decision.state").alias("decision"), F.col("decision.confidence").alias("confidence")))


def twin_latest(spark, sf_dir):
    return history.latest(twin_states(spark, sf_dir), "source", ["t"])


def _few(spark, sf_dir, names=("contrast_progression", "noise_progression"), severities=simulate.SENSITIVITY_SEVERITIES):
    return _acquisitions(spark, sf_dir), simulate.scenario(spark, names, severities)


def sensitivity_matrix(spark, sf_dir):
    rows, scenarios = _few(spark, sf_dir)
    return rounded(experiments.sensitivity_summary(experiments.evidence(experiments.changes(rows, scenarios, SIDE, SIDE, params="params"))))


def robustness_matrix(spark, sf_dir):
    rows, scenarios = _few(spark, sf_dir)
    floors = experiments.noise_floor(experiments.repeated(rows, SIDE, SIDE, repeats=5, params="params"))
    return rounded(experiments.robustness_summary(experiments.robustness(experiments.changes(rows, scenarios, SIDE, SIDE, params="params"), floors)))


def edge_sensitivity(spark, sf_dir):
    rows, scenarios = _few(spark, sf_dir)
    own = experiments.edge_sensitivity(rows, scenarios, SIDE, SIDE)
    return rounded(own.groupBy("scenario", "severity", "metric").agg(F.count("*").alias("n"), F.avg("change").alias("mean_change"), F.avg("relative_change").alias("mean_relative_change")))


def scenario_evaluation(spark, sf_dir):
    rows = _acquisitions(spark, sf_dir)
    model, _ = _fitted(rows)
    made = experiments.degraded_signatures(rows, simulate.scenario(spark, ("contrast_progression", "intensity_progression"), (0.0, 0.5, 1.0)), SIDE, SIDE, params="params", per_image="t")
    return rounded(experiments.scenario_evaluation(model, made).select("scenario", "severity", "n", "tp", "fp", "tn", "fn", "detection_rate", "false_positive_rate", "mean_d2", "std_d2"))


def severity_ranks(spark, sf_dir):
    rows = _acquisitions(spark, sf_dir)
    model, _ = _fitted(rows)
    made = experiments.degraded_signatures(rows, simulate.scenario(spark, ("contrast_progression", "blur_progression")), SIDE, SIDE, params="params")
    return rounded(experiments.monotonicity(model, made))


def grouped_correlations(spark, sf_dir):
    return rounded(experiments.grouped_correlations(table(spark, sf_dir, "lineitem"), "l_returnflag", FEATURES))


QUERIES = (twin_states, twin_latest, sensitivity_matrix, robustness_matrix, edge_sensitivity, scenario_evaluation, severity_ranks, grouped_correlations)

ORACLES = {
    "grouped_correlations": " UNION ALL ".join(f"SELECT l_returnflag, '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem GROUP BY l_returnflag" for k, a in enumerate(FEATURES) for b in FEATURES[k + 1 :]),
}
