"""Fusion of evidence, health and states: column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Features that a health assessment expects, and rows that a full baseline has.
EXPECTED_FEATURES, FULL_BASELINE = 23, 30
# How far a kind of source is trusted, of 100.
PROVENANCE = {"experimental": 100.0, "public": 80.0, "simulated": 60.0}
UNKNOWN_PROVENANCE = 50.0
EVIDENCE = ("statistical", "ai", "physics", "causal", "counterfactual")


def clipped(x: Column, most: float = 1.0) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(most), x))


def fuse_intelligence(d2: Column, critical: float | Column, quality: Column, ai: Column, ai_confidence: Column, physical: Column) -> Column:
    """Struct of agreement, fused, confidence and state."""
    statistical = clipped(d2 / critical)
    agreement = 1 - F.abs(statistical - ai)
    raw = 0.35 * statistical + 0.35 * ai + 0.15 * clipped(1 - quality / 100) + 0.15 * physical
    fused = clipped(raw * (0.75 + 0.25 * agreement))
    confidence = clipped(0.6 * ai_confidence + 0.4 * agreement)
    return F.struct(agreement.alias("agreement"), fused.alias("fused"), confidence.alias("confidence"), F.when(fused >= 0.75, "HIGH_EVIDENCE").when(fused >= 0.40, "WATCH").otherwise("NOMINAL").alias("state"))


def fuse_evidence(evidence: Column, weights: list[float] | None = None) -> Column:
    """Of an array with nulls for what is missing: struct of fusion (weighted mean), disagreement (twice the sd, 1 at most) and confidence.

    Scores outside [0, 1] are an error. weights has one number a source, not negative; those of missing sources don't count.
    """
    if weights is not None and (any(not math.isfinite(w) or w < 0 for w in weights) or sum(weights) <= 0):
        raise ValueError("weights are finite and not negative, and one is positive")
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    checked = F.when(F.forall(F.array_compact(evidence), lambda x: x.between(0, 1)), F.array_compact(evidence)).otherwise(F.raise_error(F.lit("scores lie in [0, 1]")))
    mean = add(checked) / F.size(checked)
    sd = F.sqrt(F.aggregate(checked, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.size(checked))
    fusion = mean
    if weights is not None:
        held = F.array(*(F.lit(float(w)) for w in weights))
        fusion = add(F.array_compact(F.zip_with(evidence, held, lambda x, w: x * w))) / add(F.array_compact(F.zip_with(evidence, held, lambda x, w: F.when(x.isNotNull(), w))))
    apart = F.least(F.lit(1.0), 2 * sd)
    return F.struct(fusion.alias("fusion"), apart.alias("disagreement"), clipped(fusion * (1 - apart)).alias("confidence"))


def anomaly_component(distance: Column, reference: float = 3.0) -> Column:
    return clipped(100 * F.exp(-distance / reference), 100.0)


def source_category(source: Column) -> Column:
    """The kind of a source: a scanner's own images are experimental."""
    return F.when(source == "scan_a", "experimental").otherwise(source)


def provenance_score(source: Column) -> Column:
    kind, score = source_category(source), F.lit(UNKNOWN_PROVENANCE)
    for name, value in PROVENANCE.items():
        score = F.when(kind == name, value).otherwise(score)
    return score


def evidence_confidence(observations: Column, features: Column, provenance: Column, expected: int = EXPECTED_FEATURES) -> Column:
    """Of 100: 0.4 for a full baseline, 0.3 for all features, 0.3 for the source."""
    part = lambda x, most: clipped(100.0 * F.least(x, F.lit(most)) / most, 100.0)
    return clipped(0.4 * part(observations, FULL_BASELINE) + 0.3 * part(features, expected) + 0.3 * clipped(provenance, 100.0), 100.0)


def health(quality: Column, distance: Column) -> Column:
    """Struct of index and state: 0.6 of the quality, 0.4 of 100 exp(-distance / 3)."""
    index = 0.6 * quality + 0.4 * anomaly_component(distance)
    return F.struct(index.alias("index"), F.when(index >= 85, "NOMINAL").when(index >= 70, "WATCH").when(index >= 50, "EARLY_DRIFT").otherwise("HIGH_DEVIATION").alias("state"))


def assessment(quality: Column, distance: Column, observations: Column, features: Column, provenance: Column, expected: int = EXPECTED_FEATURES) -> Column:
    """The whole health record: index and state, components, confidence (all of 100, to three digits, halves to even) and what dominates."""
    anomaly = anomaly_component(distance)
    own = health(quality, distance)
    names = {"quality": quality <= anomaly, "statistical_deviation": anomaly < quality, "limited_baseline": observations < 10, "source_maturity": provenance < 80}
    dominant = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in names.items())))
    to_three = lambda x: F.bround(x, 3)
    return F.struct(to_three(own["index"]).alias("index"), own["state"].alias("state"), to_three(evidence_confidence(observations, features, provenance, expected)).alias("confidence"), to_three(quality).alias("quality"), to_three(anomaly).alias("anomaly"), F.when(F.size(dominant) > 0, dominant).otherwise(F.array(F.lit("balanced_evidence"))).alias("dominant"))


def twin_state(statistical: Column, fusion: Column, health_state: Column, drift: Column, persistent: Column) -> Column:
    """The worst that any evidence asks for; drift and persistent may be null."""
    high = (statistical == "HIGH_DEVIATION") | (health_state == "HIGH_DEVIATION")
    early = statistical.isin("EARLY_DRIFT", "SIGNIFICANT_DRIFT") | (health_state == "EARLY_DRIFT") | F.coalesce(persistent, F.lit(False)) | (fusion == "HIGH_EVIDENCE")
    watch = (fusion == "WATCH") | (health_state == "WATCH") | F.coalesce(drift == "DRIFT_SIGNAL", F.lit(False))
    return F.when(high, "HIGH_DEVIATION").when(early, "EARLY_DRIFT").when(watch, "WATCH").otherwise("NOMINAL")


def decision(statistical: Column, fusion: Column, fusion_confidence: Column, health_state: Column, health_confidence: Column, drift: Column, persistent: Column) -> Column:
    """Struct of state, confidence (mean of what there is: fusion, health, drift), evidence (array) and rationale (text)."""
    lasting = F.coalesce(persistent, F.lit(False))
    of_drift = F.when(drift.isNull(), F.lit(None).cast("double")).when(lasting, 1.0).when(drift == "DRIFT_SIGNAL", 0.75).otherwise(0.5)
    terms = F.array_compact(F.array(fusion_confidence, health_confidence / 100, of_drift))
    confidence = clipped(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / F.size(terms))
    named = lambda kind, x, values: F.when(x.isin(*values), F.concat(F.lit(f"{kind}:"), x))
    evidence = F.array_compact(F.array(F.concat(F.lit("statistical:"), statistical), named("fusion", fusion, ("HIGH_EVIDENCE", "WATCH")), named("health", health_state, ("HIGH_DEVIATION", "EARLY_DRIFT", "WATCH")), F.concat(F.lit("drift:"), drift)))
    reasons = F.array_compact(
        F.array(
            F.when(fusion == "HIGH_EVIDENCE", "fused evidence is high").when(fusion == "WATCH", "fused evidence asks for a watch"),
            F.when(health_state == "HIGH_DEVIATION", "health is in the high-deviation range").when(health_state == "EARLY_DRIFT", "health shows an early drift").when(health_state == "WATCH", "health asks for a watch"),
            F.when(drift.isNotNull() & lasting, "drift persists").when(drift == "DRIFT_SIGNAL", "there is a drift signal"),
        )
    )
    text = F.when(F.size(reasons) > 0, F.concat_ws("; ", reasons)).otherwise("all evidence is nominal")
    return F.struct(twin_state(statistical, fusion, health_state, drift, persistent).alias("state"), confidence.alias("confidence"), evidence.alias("evidence"), text.alias("rationale"))


def checked_state(df, score_columns: dict[str, float]):
    """df with rows whose scores lie outside [0, most] or are null turned into an error."""
    bad = [F.when(F.col(c).isNull() | F.isnan(F.col(c)) | (F.col(c) < 0) | (F.col(c) > most), F.lit(c)) for c, most in score_columns.items()]
    first = next(iter(score_columns))
    return df.withColumn(first, F.when(F.coalesce(*bad).isNull(), F.col(first)).otherwise(F.raise_error(F.concat(F.lit("out of range: "), F.coalesce(*bad))).cast("double")))
