"""Baselines, detections, decisions and learned models, over line items as rows of features."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from driftmill.operators import baseline, decisions, models, series, signature, statistics

from .common import FEATURES, events, rounded, table
from .oracles import CHART

KEYS = ["l_orderkey", "l_linenumber", "l_partkey"]
#: Dimensions of the four features, as line items have no image's.
DIMENSIONS = {"volume": ("l_quantity", "l_extendedprice"), "terms": ("l_discount", "l_tax", "unknown"), "none": ("unknown",)}


def _rows(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(*KEYS, *FEATURES)


def baseline_scores(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    model = baseline.Baseline(rows, FEATURES)
    d2 = model.distance()
    dims = model.dimensions(DIMENSIONS)
    out = rows.select(*KEYS, d2.alias("d2"), F.sqrt(d2).alias("distance"), *(c.alias(f"share_{f}") for c, f in zip(model.contributions(), FEATURES)), *(c.alias(k) for k, c in dims.items()))
    return rounded(out.withColumns({"state": model.state(F.col("d2")), "quality": model.quality(F.col("d2"))}), 5)


def quality_reference(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return rounded(baseline.Baseline(rows, FEATURES).quality_reference(rows), 5)


def baseline_summary(spark, sf_dir):
    """The model as text columns that engines print alike: rows, mean, deviation and shrinkage."""
    own = baseline.Baseline(_rows(spark, sf_dir), FEATURES).summary(spark)
    return rounded(own.select("n", F.explode(F.arrays_zip("features", "mean", "std")).alias("x"), "shrinkage").select("n", F.col("x.features").alias("feature"), F.col("x.mean").alias("mean"), F.col("x.std").alias("std"), "shrinkage"))


def detection_rates(spark, sf_dir):
    """Detections by line status, with returns as the truth."""
    rows = table(spark, sf_dir, "lineitem").select(*KEYS, *FEATURES, "l_returnflag", "l_linestatus")
    model = baseline.Baseline(rows, FEATURES)
    return rounded(statistics.detection_metrics(model.detected(rows), ["l_linestatus"], "distance", "state", F.col("l_returnflag") == "R"), 5)


def explanations(spark, sf_dir):
    """The two features that contribute most to every line item, ranked."""
    rows = _rows(spark, sf_dir)
    model = baseline.Baseline(rows, FEATURES)
    items = baseline.explained(F.col("contributions"), 2)
    out = model.detected(rows).select(*KEYS, F.explode(items).alias("x"))
    return rounded(out.select(*KEYS, "x.feature", "x.contribution", "x.rank"), 5)


def deviation_table(spark, sf_dir):
    """The first orders' features against all, ranked by size."""
    rows = _rows(spark, sf_dir)
    return rounded(baseline.deviations(rows.where("l_orderkey <= 100"), KEYS, rows, FEATURES), 5)


def fused_state(spark, sf_dir):
    """All evidence on every line item, and what is decided from it; drift comes from the chart of quantities by supplier."""
    d = F.col("l_discount")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *FEATURES)
    chart = rows.withColumn("z", (F.col("l_quantity") - 25.5) / 8.0)
    drift = series.chart(chart.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "z"), "l_suppkey", ["l_orderkey", "l_linenumber", "l_partkey"], F.col("z"))
    seen = series.numbered(rows, "l_suppkey", ["l_orderkey", "l_linenumber", "l_partkey"]).join(drift.select("l_suppkey", "t", F.col("status").alias("drift")), ["l_suppkey", "t"])
    so_far = series.ordered("l_suppkey", ["t"]).rowsBetween(Window.unboundedPreceding, 0)
    seen = seen.withColumn("lasting", F.bool_or(F.col("drift") == "PERSISTENT_DRIFT").over(so_far))
    fused = decisions.fuse_intelligence(F.col("l_quantity"), 40.0, 1000 * F.col("l_tax"), 10 * d, 1 - d, 5 * d)
    health = decisions.assessment(100 - F.col("l_quantity"), 30 * F.col("l_tax"), F.col("l_linenumber") * 5, F.col("l_linenumber") * 4, decisions.provenance_score(F.when(F.col("l_linenumber") % 3 == 0, "public").when(F.col("l_linenumber") % 3 == 1, "simulated")))
    evidence = decisions.fuse_evidence(F.array(10 * d, 10 * F.col("l_tax"), F.when(d > 0.02, d)), [1.0, 2.0, 1.0])
    seen = seen.select("l_orderkey", "l_linenumber", "l_partkey", "drift", "lasting", fused.alias("f"), health.alias("h"), evidence.alias("e"))
    statistical = baseline.state(40 * F.col("e.fusion"), 9.0, 13.0, 28.0)
    seen = seen.withColumn("x", decisions.decision(statistical, F.col("f.state"), F.col("f.confidence"), F.col("h.state"), F.col("h.confidence"), F.col("drift"), F.col("lasting")))
    out = seen.select("l_orderkey", "l_linenumber", "l_partkey", "drift", "lasting", "f.fused", F.col("f.state").alias("fusion"), F.col("e.fusion").alias("evidence"), "e.disagreement", F.col("h.index").alias("health"), F.col("h.confidence").alias("health_confidence"), F.concat_ws(",", "h.dominant").alias("dominant"), F.col("x.state").alias("state"), F.col("x.confidence").alias("confidence"), F.concat_ws(",", "x.evidence").alias("named"), F.col("x.rationale").alias("rationale"))
    return rounded(out, 10)


def contract_hash(spark, sf_dir):
    return spark.range(1).select(signature.contract_hash(FEATURES).alias("sha256"))


def anomaly_assessments(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    own = models.AnomalyModel(rows, FEATURES, trees=50, seeds=models.SEEDS[:3]).assessed(rows)
    return rounded(own.select(*KEYS, "assessment.*"))


def class_predictions(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(*KEYS, *FEATURES, "l_returnflag")
    return rounded(models.ClassModel(rows, FEATURES, "l_returnflag", trees=20).predicted(rows).select(*KEYS, "predicted", F.array_max(F.map_values("chances")).alias("chance")))


def ensemble_predictions(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    model = models.EnsembleModel(rows, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", trees=10, seeds=models.SEEDS[:3])
    return rounded(model.predicted(rows).select(*KEYS, "prediction", "lower", "upper", "confidence"))


QUERIES = (baseline_scores, quality_reference, baseline_summary, detection_rates, explanations, deviation_table, fused_state, contract_hash, anomaly_assessments, class_predictions, ensemble_predictions)

_P = range(4)


def _minor(i: int, j: int) -> str:
    """A signed three-by-three minor of the covariance, whose entries are c00 to c33."""
    r, k = [x for x in _P if x != i], [x for x in _P if x != j]
    c = lambda a, b: f"c{max(a, b)}{min(a, b)}"
    terms = " + ".join(f"{c(r[0], k[a])} * ({c(r[1], k[b])} * {c(r[2], k[d])} - {c(r[1], k[d])} * {c(r[2], k[b])})" for a, b, d in ((0, 1, 2), (1, 2, 0), (2, 0, 1)))
    return f"{'-' if (i + j) % 2 else ''}({terms})"


_PAIRS = [(i, j) for i in _P for j in range(i + 1)]
_F = FEATURES
_FIT = f"""m AS (SELECT count(*) AS n, {", ".join(f"avg({f}) AS m{i}, stddev_samp({f}) + 1e-12 AS s{i}" for i, f in enumerate(_F))} FROM lineitem),
  z AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, l_linestatus, {", ".join(_F)}, {", ".join(f"({f} - m{i}) / s{i} AS z{i}" for i, f in enumerate(_F))} FROM lineitem, m),
  s AS (SELECT count(*) AS n, {", ".join(f"avg(z{i} * z{j}) AS s{i}{j}, avg(z{i} * z{i} * z{j} * z{j}) AS q{i}{j}" for i, j in _PAIRS)} FROM z),
  t AS (SELECT *, ({" + ".join(f"s{i}{i}" for i in _P)}) / 4 AS mu, {" + ".join(f"{1 if i == j else 2} * s{i}{j} * s{i}{j}" for i, j in _PAIRS)} AS dd, {" + ".join(f"{1 if i == j else 2} * q{i}{j}" for i, j in _PAIRS)} AS qq FROM s),
  u AS (SELECT *, (qq - dd) / (n * 4) AS beta, (dd - 2 * mu * 4 * mu + 4 * mu * mu) / 4 AS delta FROM t), w AS (SELECT *, least(beta, delta) / delta AS k FROM u),
  c AS (SELECT k, {", ".join(f"(1 - k) * s{i}{j} + {f'k * mu' if i == j else '0'} AS c{i}{j}" for i, j in _PAIRS)} FROM w),
  a AS (SELECT {", ".join(f"{_minor(i, j)} AS a{i}{j}" for i, j in _PAIRS)}, c00, c10, c20, c30 FROM c), p AS (SELECT *, c00 * a00 + c10 * a10 + c20 * a20 + c30 * a30 AS det FROM a),
  d AS (SELECT z.*, greatest(0, ({" + ".join(f"{1 if i == j else 2} * a{i}{j} * z{i} * z{j}" for i, j in _PAIRS)}) / det) AS d2, {" + ".join(f"z{i} * z{i}" for i in _P)} AS zz FROM z, p)"""
_STATE = "CASE WHEN d2 <= 9.487729036781154 THEN 'NOMINAL' WHEN d2 <= 13.276704135987622 THEN 'EARLY_DRIFT' WHEN d2 <= 18.46682695290317 THEN 'SIGNIFICANT_DRIFT' ELSE 'HIGH_DEVIATION' END"
_SHARES = {f: f"CASE WHEN zz > 1e-15 THEN z{i} * z{i} / zz ELSE 0 END" for i, f in enumerate(_F)}
_RATE = lambda a, b: f"coalesce({a} / nullif({b}, 0), 0)"

_FUSED = f"""WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS t, (l_quantity - 25.5::DOUBLE) / 8 AS z FROM lineitem),
  c AS (SELECT l_suppkey, t, z, 0.2 * z AS e, greatest(0, z - 0.5) AS p, least(0, z + 0.5) AS n, CASE WHEN abs(z) >= 3 OR abs(0.2 * z) >= 3 * sqrt(0.2 / 1.8) OR greatest(0, z - 0.5) >= 5 OR abs(least(0, z + 0.5)) >= 5 THEN 1 ELSE 0 END AS run FROM s WHERE t = 0
    UNION ALL SELECT l_suppkey, t, z, e, p, n, CASE WHEN abs(z) >= 3 OR abs(e) >= 3 * sqrt(0.2 / 1.8) OR p >= 5 OR abs(n) >= 5 THEN run + 1 ELSE 0 END
    FROM (SELECT s.l_suppkey, s.t, s.z, 0.2 * s.z + 0.8 * c.e AS e, greatest(0, c.p + s.z - 0.5) AS p, least(0, c.n + s.z + 0.5) AS n, c.run FROM c JOIN s ON s.l_suppkey = c.l_suppkey AND s.t = c.t + 1)),
  r AS (SELECT l_suppkey, t, CASE WHEN run >= 3 THEN 'PERSISTENT_DRIFT' WHEN run > 0 THEN 'DRIFT_SIGNAL' ELSE 'STABLE' END AS drift, bool_or(run >= 3) OVER (PARTITION BY l_suppkey ORDER BY t ROWS UNBOUNDED PRECEDING) AS lasting FROM c),
  a AS (SELECT s.l_orderkey, s.l_linenumber, s.l_partkey, drift, lasting, l_quantity AS q, l_discount AS d, l_tax AS x, least(1, greatest(0, l_quantity / 40)) AS st, [10 * l_discount, 10 * l_tax, CASE WHEN l_discount > 0.02 THEN l_discount END] AS ev,
    CASE l_linenumber % 3 WHEN 0 THEN 80.0::DOUBLE WHEN 1 THEN 60.0 ELSE 50.0 END AS prov FROM s JOIN r ON r.l_suppkey = s.l_suppkey AND r.t = s.t),
  b AS (SELECT *, list_filter(ev, lambda v: v IS NOT NULL) AS e, 1 - abs(st - 10 * d) AS agreement, 0.35 * st + 0.35 * (10 * d) + 0.15 * least(1, greatest(0, 1 - 1000 * x / 100)) + 0.15 * (5 * d) AS raw, least(100, 100 * exp(-(30 * x) / 3)) AS an, 100 - q AS qu FROM a),
  g AS (SELECT *, least(1, greatest(0, raw * (0.75 + 0.25 * agreement))) AS fused, least(1, greatest(0, 0.6 * (1 - d) + 0.4 * agreement)) AS fc, 0.6 * qu + 0.4 * an AS h, 0.4 * 100 * least(l_linenumber * 5, 30) / 30 + 0.3 * 100 * least(l_linenumber * 4, 23) / 23 + 0.3 * prov AS hc,
    list_stddev_pop(e) AS sd, (ev[1] + 2 * ev[2] + coalesce(ev[3], 0)) / (3 + CASE WHEN ev[3] IS NULL THEN 0 ELSE 1 END) AS m FROM b),
  k AS (SELECT *, CASE WHEN fused >= 0.75 THEN 'HIGH_EVIDENCE' WHEN fused >= 0.4 THEN 'WATCH' ELSE 'NOMINAL' END AS fs, CASE WHEN h >= 85 THEN 'NOMINAL' WHEN h >= 70 THEN 'WATCH' WHEN h >= 50 THEN 'EARLY_DRIFT' ELSE 'HIGH_DEVIATION' END AS hs,
    CASE WHEN 40 * m <= 9 THEN 'NOMINAL' WHEN 40 * m <= 13 THEN 'EARLY_DRIFT' WHEN 40 * m <= 28 THEN 'SIGNIFICANT_DRIFT' ELSE 'HIGH_DEVIATION' END AS ss FROM g)"""

ORACLES = {
    "baseline_scores": f"""WITH {_FIT} SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, round(d2, 5) AS d2, round(sqrt(d2), 5) AS distance, {", ".join(f"round({s}, 5) AS share_{f}" for f, s in _SHARES.items())}, round((abs(z0) + abs(z1)) / 2, 5) AS volume, round((abs(z2) + abs(z3)) / 2, 5) AS terms,
      {_STATE} AS state, round(greatest(0, least(100, 100 * (1 - d2 / 18.46682695290317))), 5) AS quality FROM d""",
    "quality_reference": f"WITH {_FIT} SELECT round(avg(d2), 5) AS mean_d2, round(stddev_samp(d2), 5) AS std_d2 FROM d",
    "baseline_summary": f"WITH {_FIT} " + " UNION ALL ".join(f"SELECT m.n, '{f}' AS feature, round(m{i}, 6) AS mean, round(m.s{i}, 6) AS std, round(k, 6) AS shrinkage FROM m, w" for i, f in enumerate(_F)),
    "detection_rates": f"""WITH {_FIT}, x AS (SELECT l_linestatus, {_STATE} AS state, sqrt(d2) AS dist, l_returnflag = 'R' AS truth FROM d), y AS (SELECT l_linestatus, count(*) AS n, count(*) FILTER (state <> 'NOMINAL' AND truth) AS tp, count(*) FILTER (state <> 'NOMINAL' AND NOT truth) AS fp, count(*) FILTER (state = 'NOMINAL' AND NOT truth) AS tn, count(*) FILTER (state = 'NOMINAL' AND truth) AS fn,
      {", ".join(f"count(*) FILTER (state = '{s}') / count(*) AS {s.lower()}_rate" for s in ("NOMINAL", "EARLY_DRIFT", "SIGNIFICANT_DRIFT", "HIGH_DEVIATION"))}, avg(dist) AS md, stddev_pop(dist) AS sd FROM x GROUP BY l_linestatus),
      r AS (SELECT *, {_RATE("tp", "tp + fn")} AS tpr, {_RATE("fp", "fp + tn")} AS fpr, {_RATE("tp", "tp + fp")} AS ppv FROM y)
      SELECT l_linestatus, n, {", ".join(f"round({s}_rate, 5) AS {s}_rate" for s in ("nominal", "early_drift", "significant_drift", "high_deviation"))}, round(md, 5) AS mean_distance, round(sd, 5) AS std_distance, tp, fp, tn, fn, round(tpr, 5) AS detection_rate, round(tpr, 5) AS sensitivity, round(fpr, 5) AS false_positive_rate, round(1 - fpr, 5) AS specificity, round(ppv, 5) AS precision,
        round({_RATE("2 * ppv * tpr", "ppv + tpr")}, 5) AS f1, round({_RATE("tn", "tn + fn")}, 5) AS negative_predictive_value, round((tpr + 1 - fpr) / 2, 5) AS balanced_accuracy FROM r""",
    "explanations": f"""WITH {_FIT}, o AS (SELECT *, row_number() OVER () AS nth FROM d), l AS ({" UNION ALL ".join(f"SELECT nth, l_orderkey, l_linenumber, l_partkey, '{f}' AS feature, {s} AS v FROM o" for f, s in _SHARES.items())}), r AS (SELECT *, row_number() OVER (PARTITION BY nth ORDER BY v DESC, feature) AS rank FROM l)
      SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, feature, round(v, 5) AS contribution, rank FROM r WHERE rank <= 2""",
    "deviation_table": f"""WITH {_FIT}, l AS ({" UNION ALL ".join(f"SELECT l_orderkey, l_linenumber, l_partkey, '{f}' AS feature, {f} AS value, m{i} AS mean, m.s{i} - 1e-12 AS std, ({f} - m{i}) / (m.s{i} - 1e-12) AS z FROM lineitem, m WHERE l_orderkey <= 100" for i, f in enumerate(_F))})
      SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, feature, round(value, 5) AS value, round(mean, 5) AS mean, round(std, 5) AS std, round(z, 5) AS z, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey ORDER BY abs(z) DESC, feature) AS rank FROM l""",
    "fused_state": f"""{_FUSED} SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, drift, lasting, round(fused, 10) AS fused, fs AS fusion, round(m, 10) AS evidence, round(least(1, 2 * sd), 10) AS disagreement, round(h, 3) AS health, round(least(100, hc), 3) AS health_confidence,
      concat_ws(',', CASE WHEN qu <= an THEN 'quality' END, CASE WHEN an < qu THEN 'statistical_deviation' END, CASE WHEN l_linenumber * 5 < 10 THEN 'limited_baseline' END, CASE WHEN prov < 80 THEN 'source_maturity' END) AS dominant,
      CASE WHEN ss = 'HIGH_DEVIATION' OR hs = 'HIGH_DEVIATION' THEN 'HIGH_DEVIATION' WHEN ss IN ('EARLY_DRIFT', 'SIGNIFICANT_DRIFT') OR hs = 'EARLY_DRIFT' OR lasting OR fs = 'HIGH_EVIDENCE' THEN 'EARLY_DRIFT' WHEN fs = 'WATCH' OR hs = 'WATCH' OR drift = 'DRIFT_SIGNAL' THEN 'WATCH' ELSE 'NOMINAL' END AS state,
      round((fc + round(least(100, hc), 3) / 100 + CASE WHEN lasting THEN 1 WHEN drift = 'DRIFT_SIGNAL' THEN 0.75 ELSE 0.5 END) / 3, 10) AS confidence,
      concat_ws(',', 'statistical:' || ss, CASE WHEN fs <> 'NOMINAL' THEN 'fusion:' || fs END, CASE WHEN hs <> 'NOMINAL' THEN 'health:' || hs END, 'drift:' || drift) AS named,
      CASE WHEN fs = 'NOMINAL' AND hs = 'NOMINAL' AND NOT lasting AND drift <> 'DRIFT_SIGNAL' THEN 'all evidence is nominal' ELSE concat_ws('; ', CASE fs WHEN 'HIGH_EVIDENCE' THEN 'fused evidence is high' WHEN 'WATCH' THEN 'fused evidence asks for a watch' END,
        CASE hs WHEN 'HIGH_DEVIATION' THEN 'health is in the high-deviation range' WHEN 'EARLY_DRIFT' THEN 'health shows an early drift' WHEN 'WATCH' THEN 'health asks for a watch' END, CASE WHEN lasting THEN 'drift persists' WHEN drift = 'DRIFT_SIGNAL' THEN 'there is a drift signal' END) END AS rationale FROM k""",
    "contract_hash": "SELECT sha256('l_quantity|l_extendedprice|l_discount|l_tax') AS sha256",
}
