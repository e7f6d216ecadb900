"""Experiments and the whole analysis, on a few small images."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftmill.operators import baseline, experiments, models, signature, simulate
from driftmill.plans import analysis
from tests.test_core import plain_chart

SIDE = 12


@pytest.fixture(scope="module")
def pictures(spark):
    rng = np.random.default_rng(12)
    y, x = np.mgrid[0:SIDE, 0:SIDE] / SIDE
    rows = []
    for k in range(24):
        own = 0.4 + 0.2 * x + 0.1 * np.sin(6 * y + rng.uniform(0, 0.5)) + rng.normal(0, 0.03, (SIDE, SIDE)) + (0.25 * (x > 0.5) if k >= 20 else 0)
        rows.append((str(k), "public" if k % 2 else "simulated", k, np.clip(own, 0, 1).ravel().tolist(), {"frequency": "5", "depth": "40"}))
    df = spark.createDataFrame(rows, "id string, source string, t int, px array<double>, params map<string,string>")
    df.cache().count()
    return df


def test_changes_and_evidence(spark, pictures):
    scenarios = simulate.scenario(spark, ("contrast_progression", "noise_progression"), (0.0, 0.5, 1.0))
    changed = experiments.changes(pictures, scenarios, SIDE, SIDE, params="params")
    rows = changed.collect()
    assert len(rows) == 24 * 2 * 3
    for r in rows:
        assert r.l2 == pytest.approx(math.sqrt(sum(v * v for v in r.delta.values()))) and set(r.changed) == {k for k, v in r.delta.items() if abs(v) > 1e-12}
        if r.severity == 0:
            assert r.l2 < 1e-9
    found = experiments.evidence(changed).collect()
    assert len(found) == len(rows)
    for r in found:
        size = r.l2 / (1 + r.l2)
        assert r.fusion == pytest.approx((3 * size + r.agreement) / 4)
    summary = {r.scenario: r for r in experiments.sensitivity_summary(experiments.evidence(changed)).collect()}
    assert all(s.n == 72 and s.delta_max > 0 for s in summary.values())
    noisy = experiments.noise_floor(experiments.repeated(pictures, SIDE, SIDE, repeats=4, params="params"))
    assert noisy.count() == 24 and noisy.where("l2_noise > 0 AND max_cv >= mean_cv").count() == 24
    margins = experiments.robustness(experiments.evidence(changed), noisy)
    assert all(r.margin == pytest.approx(r.l2 - r.noise_floor) and r.robust == (r.margin > 0) for r in margins.collect())
    assert {r.scenario for r in experiments.robustness_summary(margins).collect()} == set(summary)
    with pytest.raises(ValueError):
        experiments.robustness(margins, noisy, times=0)
    with pytest.raises(ValueError):
        experiments.repeated(pictures, SIDE, SIDE, repeats=2)


def test_edges_and_counterfactuals(spark, pictures):
    few = pictures.limit(4)
    own = experiments.edge_sensitivity(few, simulate.scenario(spark, ("contrast_progression",), (0.0, 1.0)), SIDE, SIDE).collect()
    assert len(own) == 4 * 2 * 3 and all(r.change == 0 for r in own if r.severity == 0)
    assert all(r.relative_change is None if r.reference == 0 else r.relative_change == pytest.approx(r.change / abs(r.reference)) for r in own)
    assert experiments.counterfactual(few, "blur", 0.5, SIDE, SIDE).where("l2 > 0").count() == 4
    with pytest.raises(ValueError):
        experiments.counterfactual(few, "none", 0.5, SIDE, SIDE)


def test_models_of_scenarios(spark, pictures):
    own = signature.signatures(pictures, ["id"], SIDE, SIDE, params="params")
    features = experiments.varying(own, signature.FEATURES)
    assert "wavelength_mm" not in features and "mean_intensity" in features
    model = baseline.Baseline(own, features)
    made = experiments.degraded_signatures(pictures, simulate.scenario(spark, ("contrast_progression",)), SIDE, SIDE, params="params")
    rows = {r.severity: r for r in experiments.scenario_evaluation(model, made).collect()}
    assert rows[0.0].tp == rows[0.0].fn == 0 and rows[1.0].fp == rows[1.0].tn == 0 and rows[1.0].mean_d2 > rows[0.0].mean_d2
    assert experiments.monotonicity(model, made).first().rho > 0.8
    assert experiments.holdout_evaluation(model, own).first().n == 24
    assert set(experiments.quality_report(spark.createDataFrame([(k % 2, float(k), float(k * k)) for k in range(20)], "g int, a double, b double"), "g", 0, 1, ["a", "b"])) == {"engineering_relevance", "variability", "flags", "correlations", "redundancy", "cross_domain"}


def test_whole_analysis(spark, pictures):
    own = signature.signatures(pictures.where("t < 20"), ["id"], SIDE, SIDE, params="params")
    model = baseline.Baseline(own, experiments.varying(own, signature.FEATURES))
    ai = models.AnomalyModel(own, model.features, trees=50, seeds=(1, 2, 3))
    mean, std = model.quality_reference(own).first()
    rows = analysis.analyzed(pictures, model, ai, (mean, std), SIDE, SIDE, top=3).orderBy("source", "t").collect()
    assert len(rows) == 24
    for source in ("public", "simulated"):
        mine = [r for r in rows if r.source == source]
        runs = [c[3] for c in plain_chart([(r.d2 - mean) / std for r in mine])]
        assert [r.drift for r in mine] == ["PERSISTENT_DRIFT" if n >= 3 else "DRIFT_SIGNAL" if n else "STABLE" for n in runs]
        assert [r.lasting for r in mine] == [any(n >= 3 for n in runs[: k + 1]) for k in range(len(mine))]
        slopes = [np.polyfit(range(k + 1), [r.d2 for r in mine[: k + 1]], 1)[0] if k else None for k in range(len(mine))]
        assert all((a is None and b is None) or a == pytest.approx(b, rel=1e-6, abs=1e-6) for a, b in zip([r.slope for r in mine], slopes))
    for r in rows:
        stat = min(1, r.d2 / model.thresholds["critical"])
        agreement = 1 - abs(stat - r.assessment.score)
        raw = 0.35 * stat + 0.35 * r.assessment.score + 0.15 * min(1, max(0, 1 - r.quality / 100))
        assert r.fusion.fused == pytest.approx(min(1, raw * (0.75 + 0.25 * agreement)))
        assert len(r.explanation) == 3 and r.explanation[0].contribution >= r.explanation[1].contribution
        high = r.state == "HIGH_DEVIATION" or r.health.state == "HIGH_DEVIATION"
        early = r.state in ("EARLY_DRIFT", "SIGNIFICANT_DRIFT") or r.health.state == "EARLY_DRIFT" or r.lasting or r.fusion.state == "HIGH_EVIDENCE"
        watch = "WATCH" in (r.fusion.state, r.health.state) or r.drift == "DRIFT_SIGNAL"
        assert r.decision.state == ("HIGH_DEVIATION" if high else "EARLY_DRIFT" if early else "WATCH" if watch else "NOMINAL")
    assert all(r.decision.state == "HIGH_DEVIATION" for r in rows if r.t >= 20)
