"""Image queries: every embedding, rescaled to [0, 1], is an image of 8 by 8 pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftmill.operators import causal, edges, image, physics, signature, simulate

from .common import images, rounded, table
from .oracles import IMAGES, _G, _L, _X, _Y, _stencil

SIDE = 8


#: Acquisition parameters that stand in for a metadata file, by the image's number.
def _params():
    n = F.col("vec_id")
    return {
        "frequency_mhz": F.when(n % 5 != 0, (2 + n % 25).cast("string")),
        "depth": F.when(n % 3 == 0, "").otherwise((n % 340).cast("string")),
        "pulse_duration_us": F.when(n % 4 == 0, "x").otherwise((n % 7 / 10).cast("string")),
        "prf_hz": F.when(n % 2 == 0, (1000 * (n % 9)).cast("string")),
    }


def _own(spark, sf_dir):
    return images(spark, sf_dir)


def intensity_stats(spark, sf_dir):
    return rounded(_own(spark, sf_dir).select("vec_id", image.intensity(F.col("px")).alias("i")).select("vec_id", "i.*"))


def image_entropy(spark, sf_dir):
    return rounded(_own(spark, sf_dir).select("vec_id", image.entropy(F.col("px")).alias("entropy")))


def image_gradient(spark, sf_dir):
    g = F.col("g")
    out = _own(spark, sf_dir).select("vec_id", image.sobel(F.col("px"), SIDE, SIDE).alias("g"))
    dense = image.bound(F.struct(g.alias("g"), image.quantile(g, 0.9).alias("p90")), lambda e: F.struct(image.share_above(e["g"], e["p90"], False).alias("dense"), image.share_above(e["g"], e["p90"], True).alias("dense_strict")))
    out = out.select("vec_id", image.mean(g).alias("gradient_mean"), F.sqrt(image.variance(g)).alias("gradient_std"), F.array_max("g").alias("gradient_max"), dense.alias("d"), image.share_above(g, F.lit(0.05), True).alias("dense_fixed"))
    return rounded(out.select("vec_id", "gradient_mean", "gradient_std", "gradient_max", "d.dense", "d.dense_strict", "dense_fixed"))


def image_sharpness(spark, sf_dir):
    own = image.measured(_own(spark, sf_dir), "px", SIDE, SIDE)
    return rounded(own.select("vec_id", F.col("sharpness_laplacian").alias("sharpness"), F.col("speckle_proxy").alias("speckle"), image.interior_sharpness(F.col("px"), SIDE, SIDE).alias("interior_sharpness")))


def central_features(spark, sf_dir):
    """Features of the variant that differentiates by central differences, on grey levels up to 255."""
    px, g = F.col("px"), F.col("g")
    out = _own(spark, sf_dir).select("vec_id", F.transform("px", lambda x: x * 255).alias("px")).withColumn("g", image.central_magnitude(px, SIDE, SIDE))
    dense = image.bound(F.struct(g.alias("g"), image.quantile(g, 0.9).alias("p")), lambda e: image.share_above(e["g"], e["p"], True))
    spread = image.bound(F.array_sort(px), lambda r: image.ranked_quantile(r, 0.95) - image.ranked_quantile(r, 0.05))
    return rounded(out.select("vec_id", image.mean(px).alias("mean_intensity"), F.sqrt(image.variance(px)).alias("std_intensity"), spread.alias("percentile_contrast"), image.mean(g).alias("mean_gradient"), F.sqrt(image.variance(g)).alias("std_gradient"), dense.alias("edge_density"), image.central_sharpness(px, SIDE, SIDE).alias("sharpness")), 5)


def _with_params(spark, sf_dir):
    return _own(spark, sf_dir).withColumn("params", F.create_map(*(x for k, c in _params().items() for x in (F.lit(k), c))))


ACOUSTIC = ["wavelength_mm", "axial_resolution_mm", "theoretical_max_prf_hz", "prf_depth_margin", "physical_consistency_score", "metadata_complete", "axial_intensity_slope", "attenuation_proxy_db_cm_mhz", "near_field_energy_ratio", "depth_uniformity"]


def acoustic_profile(spark, sf_dir):
    own = _with_params(spark, sf_dir).select("vec_id", physics.record(F.col("px"), F.col("params"), SIDE, SIDE).alias("p"))
    return rounded(own.select("vec_id", *(f"p.{c}" for c in ACOUSTIC)), 5)


def physics_counterfactual(spark, sf_dir):
    """What half the pulse duration and twice the frequency do; rows without the parameter are left out."""
    rows = _with_params(spark, sf_dir).where(physics.number(F.col("params"), "frequency_mhz").isNotNull())
    own = physics.counterfactual(F.col("params"), "frequency_mhz", 2.0)
    return rounded(rows.select("vec_id", *(c.alias(k) for k, c in own.items())))


def signatures(spark, sf_dir):
    return rounded(signature.signatures(_with_params(spark, sf_dir), ["vec_id"], SIDE, SIDE, params="params"), 6)


def edge_definitions(spark, sf_dir):
    px = F.col("px")
    g = image.sobel(px, SIDE, SIDE)
    dense = image.bound(g, lambda v: image.bound(F.struct(v.alias("g"), image.quantile(v, 0.9).alias("p")), lambda e: image.share_above(e["g"], e["p"], False)))
    return rounded(_own(spark, sf_dir).select("vec_id", edges.canny_density(px, SIDE).alias("fixed_canny"), edges.canny_density(px, SIDE, None).alias("adaptive_canny"), dense.alias("gradient_p90")))


def perceptual_hashes(spark, sf_dir):
    return _own(spark, sf_dir).select("vec_id", edges.perceptual_hash(F.col("px"), SIDE).alias("hash"))


def contrast_and_shift(spark, sf_dir):
    """The degradations that draw nothing, at all severities: means, deviations and extremes of what comes out."""
    own = simulate.scenario(spark, ("contrast_progression", "intensity_progression"))
    made = simulate.simulated(_own(spark, sf_dir).withColumnRenamed("vec_id", "id"), own, SIDE)
    return rounded(made.select(F.col("parent_acquisition_id").alias("vec_id"), "scenario", "level", "id", image.mean(F.col("px")).alias("mean"), F.sqrt(image.variance(F.col("px"))).alias("std"), F.array_max("px").alias("max")))


def degradation_metrics(spark, sf_dir):
    """By scenario and severity: the mean change of pixels, over all images and degradations."""
    own = _own(spark, sf_dir).withColumnRenamed("vec_id", "id")
    made = simulate.simulated(own, simulate.scenario(spark), SIDE)
    return rounded(simulate.severity_response(made, own))


def causal_ranking(spark, sf_dir):
    """Mechanisms by how well they explain what a loss of contrast does to each image's signature."""
    base = _with_params(spark, sf_dir)
    worse = base.withColumn("px", simulate.reduce_contrast(F.col("px"), F.lit(0.6)))
    one, two = (signature.signatures(df, ["vec_id"], SIDE, SIDE, params="params", canny=False).select("vec_id", signature.vector().alias("v")) for df in (base, worse))
    # without Canny edges there is no edge_density: it counts as unavailable
    gaps = one.join(two.withColumnRenamed("v", "w"), "vec_id").select("vec_id", F.posexplode(F.zip_with("w", "v", lambda x, y: x - y)).alias("k", "delta"))
    gaps = gaps.select("vec_id", F.get(F.array(*map(F.lit, signature.FEATURES)), F.col("k")).alias("feature"), F.round("delta", 9).alias("delta"))
    ranked = causal.ranked(gaps, ["vec_id"])
    return rounded(ranked.select("vec_id", "mechanism", "score", F.size("supported").alias("supported"), F.size("contradicted").alias("contradicted"), F.size("unavailable").alias("unavailable"), "rank"))


def event_mechanisms(spark, sf_dir):
    """Mechanisms against changes made of events: an event type stands for a feature, its mean against the user's mean for the change."""
    names = sorted({f for own in causal.DIRECTIONS.values() for f in own})
    events = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % len(names)).alias("k"), "value")
    own = events.groupBy("user_id", "k").agg(F.avg("value").alias("m")).join(events.groupBy("user_id").agg(F.avg("value").alias("u")), "user_id")
    gaps = own.select("user_id", F.get(F.array(*map(F.lit, names)), F.col("k").cast("int")).alias("feature"), F.round(F.col("m") - F.col("u"), 1).alias("delta"))
    out = causal.ranked(gaps, ["user_id"])
    return rounded(out.select("user_id", "mechanism", "score", F.concat_ws(",", "supported").alias("supported"), F.concat_ws(",", "contradicted").alias("contradicted"), F.concat_ws(",", "unavailable").alias("unavailable"), "rank"))


QUERIES = (intensity_stats, image_entropy, image_gradient, image_sharpness, central_features, acoustic_profile, physics_counterfactual, signatures, edge_definitions, perceptual_hashes, contrast_and_shift, degradation_metrics, causal_ranking, event_mechanisms)

_P = (1, 5, 25, 50, 75, 95, 99)
_NUMBERS = """p AS (SELECT vec_id, CASE WHEN vec_id % 5 <> 0 THEN CAST(2 + vec_id % 25 AS DOUBLE) END AS f0, CASE WHEN vec_id % 3 <> 0 THEN CAST(vec_id % 340 AS DOUBLE) END AS d,
  CASE WHEN vec_id % 4 <> 0 THEN vec_id % 7 / 10 END AS tau, CASE WHEN vec_id % 2 = 0 THEN CAST(1000 * (vec_id % 9) AS DOUBLE) END AS prf FROM embeddings),
  q AS (SELECT *, coalesce(f0, 5.0) AS f, 1540.0::DOUBLE AS c FROM p),
  w AS (SELECT *, c / (f * 1e6) * 1e3 AS wl, CASE WHEN d <> 0 THEN c / (2 * d * 1e-3) END AS most FROM q),
  m AS (SELECT *, CASE WHEN most > 0 AND prf <> 0 THEN most / prf END AS margin FROM w),
  a AS (SELECT *, CASE WHEN tau > 0 THEN c * tau * 1e-3 / 2 ELSE wl / 2 END AS axial,
    least(1, greatest(0, 1 - (CASE WHEN f < 1 OR f > 20 THEN 0.30::DOUBLE ELSE 0 END) - (CASE WHEN d < 1 OR d > 300 THEN 0.15::DOUBLE ELSE 0 END) - (CASE WHEN tau < 0.01 OR tau > 20 THEN 0.10::DOUBLE ELSE 0 END) - (CASE WHEN prf <= 0 THEN 0.15::DOUBLE ELSE 0 END) - (CASE WHEN margin < 1 THEN 0.20::DOUBLE ELSE 0 END))) AS score FROM m)"""
_SLOPES = """gr AS (SELECT p.vec_id, p.k, p.v * 255 AS v, (d.v - u.v) * 255 / (d.i - u.i) AS gy, (r.v - l.v) * 255 / (r.j - l.j) AS gx FROM px p
  JOIN px u ON u.vec_id = p.vec_id AND u.j = p.j AND u.i = greatest(p.i - 1, 0) JOIN px d ON d.vec_id = p.vec_id AND d.j = p.j AND d.i = least(p.i + 1, 7)
  JOIN px l ON l.vec_id = p.vec_id AND l.i = p.i AND l.j = greatest(p.j - 1, 0) JOIN px r ON r.vec_id = p.vec_id AND r.i = p.i AND r.j = least(p.j + 1, 7)),
  g2 AS (SELECT p.vec_id, p.k, p.v, sqrt(p.gx * p.gx + p.gy * p.gy) AS g, (d.gy - u.gy) / (d.k // 8 - u.k // 8) + (r.gx - l.gx) / (r.k % 8 - l.k % 8) AS lap FROM gr p
  JOIN gr u ON u.vec_id = p.vec_id AND u.k = greatest(p.k // 8 - 1, 0) * 8 + p.k % 8 JOIN gr d ON d.vec_id = p.vec_id AND d.k = least(p.k // 8 + 1, 7) * 8 + p.k % 8
  JOIN gr l ON l.vec_id = p.vec_id AND l.k = p.k // 8 * 8 + greatest(p.k % 8 - 1, 0) JOIN gr r ON r.vec_id = p.vec_id AND r.k = p.k // 8 * 8 + least(p.k % 8 + 1, 7))"""
_NAMES = sorted({f for own in causal.DIRECTIONS.values() for f in own})


def _mechanisms_sql() -> str:
    rows = ", ".join(f"({n}, '{m}', '{f}', {({'increase': 1, 'decrease': -1}).get(d, 0)}, {k})" for n, m in enumerate(causal.MECHANISMS) for k, (f, d) in enumerate(causal.DIRECTIONS[m].items()))
    names = "[" + ", ".join(f"'{f}'" for f in _NAMES) + "]"
    return f"""WITH e AS (SELECT user_id, event_id % {len(_NAMES)} AS k, value FROM events), u AS (SELECT user_id, avg(value) AS u FROM e GROUP BY 1),
      d AS (SELECT e.user_id, {names}[CAST(k AS INTEGER) + 1] AS feature, round(avg(value) - any_value(u), 1) AS delta FROM e JOIN u USING (user_id) GROUP BY e.user_id, k),
      m(place, mechanism, feature, want, nth) AS (VALUES {rows}), x AS (SELECT u.user_id, m.*, CASE WHEN abs(delta) <= 1e-8 THEN 0 ELSE sign(delta) END AS s FROM u CROSS JOIN m LEFT JOIN d ON d.user_id = u.user_id AND d.feature = m.feature),
      c AS (SELECT user_id, place, mechanism, coalesce(string_agg(feature, ',' ORDER BY nth) FILTER (coalesce(s, 0) <> 0 AND (want = 0 OR want = s)), '') AS supported, coalesce(string_agg(feature, ',' ORDER BY nth) FILTER (coalesce(s, 0) <> 0 AND want <> 0 AND want <> s), '') AS contradicted,
        coalesce(string_agg(feature, ',' ORDER BY nth) FILTER (coalesce(s, 0) = 0), '') AS unavailable, count(*) FILTER (coalesce(s, 0) <> 0 AND (want = 0 OR want = s)) AS hit, count(*) FILTER (coalesce(s, 0) <> 0) AS moved FROM x GROUP BY 1, 2, 3)
      SELECT user_id, mechanism, round(CASE WHEN moved > 0 THEN hit / moved ELSE 0 END, 6) AS score, supported, contradicted, unavailable, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN moved > 0 THEN hit / moved ELSE 0 END DESC, place) AS rank FROM c"""


ORACLES = {
    "intensity_stats": f"""WITH {IMAGES}, a AS (SELECT vec_id, min(v) AS lo, max(v) AS hi, avg(v) AS mean, stddev_pop(v) AS std, {", ".join(f"quantile_cont(v, {p / 100}) AS p{p}" for p in _P)} FROM px GROUP BY vec_id)
      SELECT vec_id, round(lo, 6) AS min_intensity, round(hi, 6) AS max_intensity, round(mean, 6) AS mean_intensity, round(std, 6) AS std_intensity, round(p50, 6) AS median_intensity, round(hi - lo, 6) AS dynamic_range, {", ".join(f"round(p{p}, 6) AS p{p}" for p in _P)},
        round(std / (mean + 1e-8), 6) AS coefficient_variation, round(std, 6) AS contrast_std, round(std / (mean + 1e-8), 6) AS rms_contrast, round(1 / (1 + std / (mean + 1e-8)), 6) AS uniformity FROM a""",
    "image_entropy": f"""WITH {IMAGES}, h AS (SELECT vec_id, least(floor(v * 256), 255) AS b, count(*) / 64 AS p FROM px GROUP BY 1, 2)
      SELECT vec_id, round(-sum(p * log2(p)), 6) AS entropy FROM h GROUP BY vec_id""",
    "image_gradient": f"""WITH {IMAGES}, {_stencil("gx", _X)}, {_stencil("gy", _Y)}, g AS (SELECT vec_id, sqrt(gx.v * gx.v + gy.v * gy.v) AS g FROM gx JOIN gy USING (vec_id, k)),
      q AS (SELECT vec_id, quantile_cont(g, 0.9) AS p90 FROM g GROUP BY vec_id)
      SELECT vec_id, round(avg(g), 6) AS gradient_mean, round(stddev_pop(g), 6) AS gradient_std, round(max(g), 6) AS gradient_max, round(avg(CASE WHEN g >= p90 THEN 1.0 ELSE 0 END), 6) AS dense, round(avg(CASE WHEN g > p90 THEN 1.0 ELSE 0 END), 6) AS dense_strict, round(avg(CASE WHEN g > 0.05 THEN 1.0 ELSE 0 END), 6) AS dense_fixed FROM g JOIN q USING (vec_id) GROUP BY vec_id""",
    "image_sharpness": f"""WITH {IMAGES}, {_stencil("l", _L)}, {_stencil("s", _G)}
      SELECT vec_id, round(var_pop(l.v), 6) AS sharpness, round(stddev_pop(px.v - s.v) / (avg(px.v) + 1e-8), 6) AS speckle, round(var_pop(l.v) FILTER (i BETWEEN 1 AND 6 AND j BETWEEN 1 AND 6), 6) AS interior_sharpness FROM px JOIN l USING (vec_id, k) JOIN s USING (vec_id, k) GROUP BY vec_id""",
    "central_features": f"""WITH {IMAGES}, {_SLOPES}, q AS (SELECT vec_id, quantile_cont(g, 0.9) AS p90 FROM g2 GROUP BY vec_id)
      SELECT vec_id, round(avg(v), 5) AS mean_intensity, round(stddev_pop(v), 5) AS std_intensity, round(quantile_cont(v, 0.95) - quantile_cont(v, 0.05), 5) AS percentile_contrast, round(avg(g), 5) AS mean_gradient, round(stddev_pop(g), 5) AS std_gradient, round(avg(CASE WHEN g > p90 THEN 1.0 ELSE 0 END), 5) AS edge_density, round(var_pop(lap), 5) AS sharpness FROM g2 JOIN q USING (vec_id) GROUP BY vec_id""",
    "acoustic_profile": f"""WITH {IMAGES}, {_NUMBERS}, r AS (SELECT vec_id, i, median(v) AS med FROM px GROUP BY 1, 2),
      s AS (SELECT r.vec_id, regr_slope(ln(greatest(med, 1e-4)), CASE WHEN d IS NULL THEN i / 7 ELSE d * i / 7 END) AS slope, avg(med) FILTER (i < 2) AS near, avg(med) FILTER (i > 5) AS far, stddev_pop(med) / (avg(med) + 1e-4) AS cv FROM r JOIN p USING (vec_id) GROUP BY r.vec_id)
      SELECT vec_id, round(wl, 5) AS wavelength_mm, round(axial, 5) AS axial_resolution_mm, round(most, 5) AS theoretical_max_prf_hz, round(margin, 5) AS prf_depth_margin, round(score, 5) AS physical_consistency_score, d IS NOT NULL AND f0 IS NOT NULL AS metadata_complete, round(CASE WHEN d = 0 THEN NULL ELSE slope END, 5) AS axial_intensity_slope,
        round(CASE WHEN d = 0 THEN NULL ELSE abs(slope) END * CASE WHEN coalesce(d, 0) <> 0 THEN 10 / ln(10.0::DOUBLE) ELSE 1 END / f, 5) AS attenuation_proxy_db_cm_mhz, round(least(1, greatest(0, near / (near + far + 1e-4))), 5) AS near_field_energy_ratio, round(1 / (1 + cv), 5) AS depth_uniformity FROM a JOIN s USING (vec_id)""",
    "physics_counterfactual": f"""WITH {_NUMBERS}, b AS (SELECT *, c / (2 * f * 1e6) * 1e3 AS wl2, score - (CASE WHEN f >= 1 AND f <= 20 AND 2 * f > 20 THEN 0.30::DOUBLE ELSE 0 END) AS s2 FROM a WHERE f0 IS NOT NULL)
      SELECT vec_id, round(f, 6) AS baseline_value, round(2 * f, 6) AS counterfactual_value, round(wl2 / wl, 6) AS wavelength_ratio, round(CASE WHEN tau > 0 THEN 1 ELSE wl2 / wl END, 6) AS axial_resolution_ratio, round(CASE WHEN margin <> 0 THEN 1.0::DOUBLE END, 6) AS prf_margin_ratio, round(greatest(0, s2) - score, 6) AS physical_consistency_delta FROM b""",
    "contrast_and_shift": f"""WITH {IMAGES}, m AS (SELECT vec_id, avg(v) AS m FROM px GROUP BY vec_id), s(level, severity) AS (VALUES (0, 0.0::DOUBLE), (1, 0.2), (2, 0.4), (3, 0.6), (4, 0.8), (5, 1.0)), k(scenario, name) AS (VALUES ('contrast_progression', 'Contrast reduction progression'), ('intensity_progression', 'Intensity shift progression')),
      x AS (SELECT px.vec_id, scenario, name, level, severity, least(1, greatest(0, CASE WHEN scenario = 'contrast_progression' THEN m + (1 - 0.75 * severity) * (v - m) ELSE v + 0.2 * severity END)) AS y FROM px JOIN m USING (vec_id) CROSS JOIN s CROSS JOIN k)
      SELECT vec_id, scenario, CAST(level AS BIGINT) AS level, substr(sha256(concat_ws('|', vec_id, name, printf('%.8f', severity), 42 + level, '1.0')), 1, 16) AS id, round(avg(y), 6) AS mean, round(stddev_pop(y), 6) AS std, round(max(y), 6) AS max FROM x GROUP BY vec_id, scenario, name, level, severity""",
    "event_mechanisms": _mechanisms_sql(),
}
