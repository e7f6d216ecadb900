"""Operators that SQL doesn't express, against plain Python or NumPy; contracts of sources and sinks; the stream against the table."""

import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftmill import functions
from driftmill.operators import baseline, causal, decisions, drift, edges, history, image, lineage, models, physics, series, signature, simulate, statistics, tables
from driftmill.sources import images, metadata, sinks
from driftmill.streaming import monitor


@pytest.fixture(scope="module")
def pictures():
    rng = np.random.default_rng(5)
    x, y = np.meshgrid(np.linspace(0, 1, 20), np.linspace(0, 1, 20))
    return [np.clip(a, 0, 1) for a in (x, (x > 0.5) * 0.9, np.hypot(x - 0.5, y - 0.5), rng.random((20, 20)), np.zeros((20, 20)), ((x - 0.4) ** 2 + (y - 0.6) ** 2 < 0.08) * 0.8 + 0.1 * rng.random((20, 20)))]


@pytest.fixture(scope="module")
def shown(spark, pictures):
    return spark.createDataFrame([(k, p.ravel().tolist()) for k, p in enumerate(pictures)], "id int, px array<double>")


def plain_canny(image8, low, high):
    """By loops over pixels, written from the definition."""
    h, w = image8.shape
    at = lambda i, j: int(image8[min(max(i, 0), h - 1), min(max(j, 0), w - 1)])
    dx, dy = np.zeros((h, w), int), np.zeros((h, w), int)
    for i in range(h):
        for j in range(w):
            dx[i, j] = sum(c * (at(i + d, j + 1) - at(i + d, j - 1)) for d, c in ((-1, 1), (0, 2), (1, 1)))
            dy[i, j] = sum(c * (at(i + 1, j + d) - at(i - 1, j + d)) for d, c in ((-1, 1), (0, 2), (1, 1)))
    m = abs(dx) + abs(dy)
    size = lambda i, j: m[i, j] if 0 <= i < h and 0 <= j < w else 0
    thin = set()
    for i in range(h):
        for j in range(w):
            if m[i, j] <= low:
                continue
            angle = math.degrees(math.atan2(abs(dy[i, j]), abs(dx[i, j])))
            if angle < 22.5:
                ok = m[i, j] > size(i, j - 1) and m[i, j] >= size(i, j + 1)
            elif angle > 67.5:
                ok = m[i, j] > size(i - 1, j) and m[i, j] >= size(i + 1, j)
            else:
                s = -1 if (dx[i, j] < 0) != (dy[i, j] < 0) else 1
                ok = m[i, j] > size(i - 1, j - s) and m[i, j] > size(i + 1, j + s)
            if ok:
                thin.add((i, j))
    wait = [p for p in thin if m[p] > high]
    out = set(wait)
    while wait:
        i, j = wait.pop()
        for p in [(i + a, j + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
            if p in thin and p not in out:
                out.add(p)
                wait.append(p)
    return len(out) / (h * w)


def test_canny_against_loops(spark, shown, pictures):
    ours = {r.id: r for r in shown.select("id", edges.canny_density(F.col("px"), 20).alias("fixed"), edges.canny_density(F.col("px"), 20, None).alias("own")).collect()}
    for k, p in enumerate(pictures):
        own = (p * 255).astype(np.uint8)
        assert ours[k].fixed == pytest.approx(plain_canny(own, 50, 150))
        assert ours[k].own == pytest.approx(plain_canny(own, *edges.adaptive_thresholds(own)))
    assert ours[1].fixed > 0 and ours[4].fixed == 0


def test_perceptual_hash(spark, shown, pictures):
    hashes = {r.id: r.h for r in shown.select("id", edges.perceptual_hash(F.col("px"), 20).alias("h")).collect()}
    d = edges.spectrum(32)
    assert np.allclose(d @ d.T, np.eye(32))
    softer = spark.createDataFrame([(0, (pictures[5] * 0.9 + 0.02).ravel().tolist())], "id int, px array<double>")
    near = softer.select(edges.perceptual_hash(F.col("px"), 20).alias("h")).first().h
    bits = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    assert bits(hashes[5], near) <= 4 < bits(hashes[5], hashes[3])
    assert spark.range(1).select(edges.hamming(F.lit(5), F.lit(6))).first()[0] == 2


def test_features_against_numpy(spark, shown, pictures):
    rows = {r.id: r for r in image.measured(shown, "px", 20, 20).collect()}
    for k, p in enumerate(pictures):
        r, q = rows[k], np.pad(p, 1, mode="reflect")
        lap = q[:-2, 1:-1] + q[2:, 1:-1] + q[1:-1, :-2] + q[1:-1, 2:] - 4 * p
        counts = np.histogram(p, 256, (0, 1))[0] / p.size
        assert r.sharpness_laplacian == pytest.approx(lap.var(), abs=1e-9)
        assert r.entropy == pytest.approx(-sum(c * math.log2(c) for c in counts if c), abs=1e-9)
        assert (r.p25, r.p99) == pytest.approx((np.percentile(p, 25), np.percentile(p, 99)))
        five = np.pad(p, 2, mode="reflect")
        g = np.array([1, 4, 6, 4, 1]) / 16
        smooth = sum(g[a] * g[b] * five[a : a + 20, b : b + 20] for a in range(5) for b in range(5))
        assert r.speckle_proxy == pytest.approx((p - smooth).std() / (p.mean() + 1e-8), abs=1e-9)
    dx = np.gradient(pictures[3], axis=1)
    dy = np.gradient(pictures[3], axis=0)
    got = shown.where("id = 3").select(image.mean(image.central_magnitude(F.col("px"), 20, 20)).alias("g"), image.central_sharpness(F.col("px"), 20, 20).alias("s")).first()
    assert got.g == pytest.approx(np.hypot(dx, dy).mean()) and got.s == pytest.approx((np.gradient(dy, axis=0) + np.gradient(dx, axis=1)).var())


def test_scaled_pixels(spark):
    df = spark.createDataFrame([([0, 255, 51],)], "px array<int>")
    assert df.select(image.scaled(F.col("px"), "uint8")).first()[0] == pytest.approx([0, 1, 0.2])
    with pytest.raises(Exception, match="outside of their range"):
        spark.createDataFrame([([0.5, 1.5],)], "px array<double>").select(image.scaled(F.col("px"), "float")).collect()


def test_physics_and_signature(spark, shown, pictures):
    params = F.create_map(*(F.lit(x) for x in ("frequency", "7.5", "depth_mm", "60", "pd", "0.4", "prf", "5000", "sound_speed_m_s", "nan")))
    rows = {r.id: r for r in signature.signatures(shown.withColumn("params", params), ["id"], 20, 20, params="params").collect()}
    for k, p in enumerate(pictures):
        r, med = rows[k], np.median(p, axis=1)
        slope = np.polyfit(np.linspace(0, 60, 20), np.log(np.clip(med, 1e-4, None)), 1)[0]
        assert r.axial_intensity_slope == pytest.approx(slope, abs=1e-9)
        assert r.attenuation_proxy_db_cm_mhz == pytest.approx(abs(slope) * 10 / math.log(10) / 7.5, abs=1e-9)
        assert r.near_field_energy_ratio == pytest.approx(med[:5].mean() / (med[:5].mean() + med[-5:].mean() + 1e-4))
        assert (r.wavelength_mm, r.axial_resolution_mm) == pytest.approx((1540 / 7.5e6 * 1e3, 1540 * 0.4e-3 / 2))
        assert r.prf_depth_margin == pytest.approx(1540 / 0.12 / 5000) and r.metadata_complete == 1
    assert list(rows[0].asDict())[2:] == signature.FEATURES and len(signature.FEATURES) == 23
    # the expressions give what the matrices give
    by_expression = {r.id: r for r in image.measured(shown, "px", 20, 20).collect()}
    shared = [f for f in signature.FEATURES if f in by_expression[0]]
    assert len(shared) == 12
    for k in rows:
        assert [rows[k][f] for f in shared] == pytest.approx([by_expression[k][f] for f in shared], abs=1e-9)
    own = shown.withColumn("params", params).select("id", physics.record(F.col("px"), F.col("params"), 20, 20).alias("p"))
    assert {r.id: r.p.depth_uniformity for r in own.collect()} == pytest.approx({k: r.depth_uniformity for k, r in rows.items()})
    assert len(spark.createDataFrame([rows[0]]).select(signature.vector()).first()[0]) == 23
    with pytest.raises(ValueError):
        signature.vector(["nothing"])
    with pytest.raises(ValueError):
        signature.completed(shown, ["id"])
    change = spark.range(1).select(signature.compared(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(4.0), F.lit(2.0)), ["a", "b"]).alias("c")).first().c
    assert change.delta == {"a": 3.0, "b": 0.0} and change.changed == ["a"] and change.l2 == 3.0
    with pytest.raises(ValueError):
        physics.perturbed(params, "depth_mm", 0)


def test_thresholds_and_checks(spark):
    assert [round(baseline.chi2_quantile(p, 13), 6) for p in (0.95, 0.99, 0.999)] == [22.362032, 27.68825, 34.528179]
    assert [round(baseline.chi2_quantile(p, 23), 6) for p in (0.95, 0.99, 0.999)] == [35.172462, 41.638398, 49.728232]
    df = spark.createDataFrame([(1.0, 2.0), (2.0, None), (3.0, 1.0)], "a double, b double")
    with pytest.raises(ValueError, match="finite in b"):
        baseline.Baseline(df, ["a", "b"])
    with pytest.raises(ValueError):
        baseline.Baseline(df, ["a"])


def test_explanations(spark):
    df = spark.createDataFrame([({"a": 0.2, "b": 0.5, "c": 0.3},), ({},)], "m map<string,double>")
    top = df.select(baseline.explained(F.col("m"), 2).alias("x")).collect()
    assert [tuple(i) for i in top[0].x] == [("b", 0.5, 1), ("c", 0.3, 2)]
    text = df.select(baseline.explanation_text(F.lit("WATCH"), baseline.explained(F.col("m"), 2)).alias("t")).collect()
    assert text[0].t.endswith("- b: 50.00%\n- c: 30.00%") and text[1].t == "State=WATCH | no contributions"


def test_decisions(spark):
    one = spark.range(1)
    got = one.select(decisions.fuse_evidence(F.array(F.lit(0.2), F.lit(0.8), F.lit(None).cast("double")), [1.0, 3.0, 5.0]).alias("f")).first().f
    assert (got.fusion, got.disagreement) == pytest.approx((0.65, 0.6))
    with pytest.raises(Exception, match=r"lie in \[0, 1\]"):
        one.select(decisions.fuse_evidence(F.array(F.lit(1.2)))).collect()
    a = one.select(decisions.assessment(F.lit(90.0), F.lit(0.0), F.lit(30), F.lit(23), F.lit(100.0)).alias("a")).first().a
    assert (a["index"], a.state, a.confidence, a.dominant) == (94.0, "NOMINAL", 100.0, ["quality"])
    d = one.select(decisions.decision(F.lit("NOMINAL"), F.lit("WATCH"), F.lit(0.5), F.lit("NOMINAL"), F.lit(80.0), F.lit(None).cast("string"), F.lit(None).cast("boolean")).alias("d")).first().d
    assert (d.state, d.confidence, d.evidence) == ("WATCH", 0.65, ["statistical:NOMINAL", "fusion:WATCH"])
    assert [r[0] for r in spark.createDataFrame([("scan_a",), ("public",), ("simulated",), (None,)], "s string").select(decisions.provenance_score(F.col("s"))).collect()] == [100, 80, 60, 50]
    with pytest.raises(Exception, match="out of range: q"):
        decisions.checked_state(spark.createDataFrame([(1.0, 120.0)], "s double, q double"), {"s": 1.0, "q": 100.0}).collect()


def test_causal_ranking(spark):
    rows = [(1, "sharpness_laplacian", -1.0), (1, "edge_density", -0.5), (1, "gradient_mean", 0.2), (1, "axial_resolution_mm", 0.0), (2, "axial_resolution_mm", 0.3), (3, "other", 1.0)]
    got = {(r.k, r.mechanism): r for r in causal.ranked(spark.createDataFrame(rows, "k int, feature string, delta double"), ["k"]).collect()}
    r = got[1, "focus_shift_or_defocus"]
    assert (r.score, r["rank"], r.supported, r.contradicted) == (pytest.approx(2 / 3), 1, ["sharpness_laplacian", "edge_density"], ["gradient_mean"])
    assert got[2, "pulse_or_bandwidth_change"]["rank"] == 1 and got[1, "pulse_or_bandwidth_change"].unavailable == ["axial_resolution_mm"]
    assert [got[3, m]["rank"] for m in causal.MECHANISMS] == [1, 2, 3, 4, 5, 6]
    with pytest.raises(KeyError):
        causal.hypothesis(spark, "none")


def plain_chart(values, lam=0.2, limit=3.0, k=0.5, h=5.0):
    e = up = down = run = 0.0
    out = []
    for z in values:
        e = lam * z + (1 - lam) * e
        up, down = max(0, up + z - k), min(0, down + z + k)
        run = run + 1 if abs(z) >= limit or abs(e) >= limit * math.sqrt(lam / (2 - lam)) or up >= h or -down >= h else 0
        out.append((e, up, down, run))
    return out


def test_long_chart_against_a_loop(spark):
    z = np.random.default_rng(2).normal(0.05, 1, 5000)
    df = spark.createDataFrame([("s", k, float(v)) for k, v in enumerate(z)], "k string, n int, v double")
    ours = [(r.ewma, r.cusum_pos, r.cusum_neg, r.run) for r in series.chart(df, "k", ["n"], F.col("v")).orderBy("t").collect()]
    assert np.allclose(ours, plain_chart(z), atol=1e-9)


def test_stream_gives_what_the_table_gives(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(f"s{k % 3}", k, float(v)) for k, v in enumerate(rng.normal(0.3, 1, 300))]
    for part in range(3):
        spark.createDataFrame(rows[part * 100 : part * 100 + 100], "k string, n int, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, n int, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = monitor.monitored(stream, "k", "n", "v", 0.0, 1.0)
    monitor.appended(seen, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    got = sorted((r.k, r.t, round(r.ewma, 9), round(r.cusum_pos, 9), round(r.cusum_neg, 9), r.run, r.status) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    table = series.chart(spark.createDataFrame(rows, "k string, n int, v double"), "k", ["n"], F.col("v"))
    assert got == sorted((r.k, r.t, round(r.ewma, 9), round(r.cusum_pos, 9), round(r.cusum_neg, 9), r.run, r.status) for r in table.collect())


def test_history(spark):
    rows = spark.createDataFrame([("a", 0, "NOMINAL", 90.0), ("a", 1, "WATCH", 70.0), ("b", 0, "NOMINAL", 80.0)], "source string, t int, state string, q double")
    assert {r.source: r.state for r in history.latest(rows, "source", ["t"]).collect()} == {"a": "WATCH", "b": "NOMINAL"}
    assert {r.source: r.q for r in history.ordered_series(rows, "source", ["t"], ["t", "q"]).collect()} == {"a": [90.0, 70.0], "b": [80.0]}
    assert history.appended(rows, rows.where("t = 1"), ["source", "state"]).count() == 4
    with pytest.raises(Exception, match="a state lacks state"):
        history.appended(rows, spark.createDataFrame([("a", None)], "source string, state string"), ["source", "state"]).collect()


def test_drift_checks(spark):
    flat = spark.createDataFrame([("a", "reference", k, 1.0) for k in range(6)] + [("a", "observation", 0, 1.0)], "k string, part string, t int, v double")
    with pytest.raises(Exception, match="constant reference"):
        drift.monitored(flat, ["k"]).collect()
    with pytest.raises(ValueError):
        drift.trials(spark, kinds=("unknown",))
    a, b = (drift.trials(spark, seeds=s) for s in ((1, 2), (2, 3)))
    assert [r.seed for r in drift.overlapping(a, b).collect()] == [2]


def test_sample_size_and_bootstrap(spark):
    assert statistics.required_sequences(spark, 0.05).first().n == 73
    rng = np.random.default_rng(1)
    v = rng.normal(3, 2, 400)
    r = statistics.bootstrap_mean(spark.createDataFrame([(k, float(x)) for k, x in enumerate(v)], "k int, v double"), "v", ["k"], 2000).first()
    half = 1.96 * v.std() / 20
    assert r.mean == pytest.approx(v.mean()) and r.low == pytest.approx(v.mean() - half, abs=0.05) and r.high == pytest.approx(v.mean() + half, abs=0.05)


def test_principal_components(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 3)) @ np.array([[1, 0.8, 0], [0, 1, 0.1], [0, 0, 2]])
    components, loadings = statistics.principal_components(spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double"), ["a", "b", "c"])
    z = (x - x.mean(0)) / x.std(0)
    values = np.linalg.svd(z, compute_uv=False) ** 2 / 199
    rows = components.orderBy("component").collect()
    assert [r.variance for r in rows] == pytest.approx(values) and rows[-1].cumulative == pytest.approx(1)
    assert statistics.components_needed(components, 0.9).first()[0] == int(np.searchsorted(np.cumsum(values / values.sum()), 0.9) + 1)
    assert loadings.count() == 9


def test_isolation_forest_finds_what_is_far(spark):
    rng = np.random.default_rng(9)
    rows = [(k, *map(float, r)) for k, r in enumerate(rng.normal(size=(600, 3)))] + [(600, 9.0, 9.0, -9.0)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double")
    model = models.AnomalyModel(df, ["a", "b", "c"], trees=50, seeds=(1, 2, 3))
    seen = {r.id: r.assessment for r in model.assessed(df).collect()}
    assert seen[600].state == "ANOMALY" and seen[600].score == 1.0 and np.mean([a.state == "ANOMALY" for k, a in seen.items() if k < 600]) < 0.3
    top = model.influences(df.where("id = 600"), ["id"]).collect()
    assert sum(r.influence for r in top) == pytest.approx(1, abs=1e-9) or all(r.influence == 0 for r in top)
    record = models.inference_records(model.assessed(df.where("id = 600")), "id", F.lit("simulated"), ["a", "b", "c"]).first()
    import hashlib

    assert record.input_hash == hashlib.sha256(np.array([9.0, 9.0, -9.0], "<f8").tobytes()).hexdigest()
    assert model.card(spark).first().contract_hash == hashlib.sha256(b"a|b|c").hexdigest()


def test_random_forests(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 2))
    df = spark.createDataFrame([(float(a), float(b), "high" if a > 0 else "low", float(2 * a)) for a, b in x], "a double, b double, y string, t double")
    model = models.ClassModel(df, ["a", "b"], "y", trees=20)
    out = model.predicted(df).collect()
    assert np.mean([r.predicted == r.y for r in out]) > 0.95 and sum(out[0].chances.values()) == pytest.approx(1)
    weights = {r.feature: r.importance for r in model.importances(spark).collect()}
    assert weights["a"] > weights["b"]
    guess = models.EnsembleModel(df, ["a", "b"], "t", trees=10, seeds=(1, 2, 3)).predicted(df).collect()
    assert np.corrcoef([r.prediction for r in guess], [r.t for r in guess])[0, 1] > 0.9 and all(r.lower <= r.prediction <= r.upper for r in guess)


def test_simulations(spark, shown, pictures):
    scenarios = simulate.scenario(spark, severities=(0.0, 0.5, 1.0))
    made = simulate.simulated(shown.where("id IN (3, 5)"), scenarios, 20)
    rows = {(r.parent_acquisition_id, r.scenario, r.level): np.array(r.px).reshape(20, 20) for r in made.collect()}
    assert len(rows) == 2 * 5 * 3
    rng = np.random.default_rng(44)
    assert np.allclose(rows[5, "noise_progression", 2], np.clip(pictures[5] + rng.normal(0, 0.08, (20, 20)), 0, 1))
    assert np.allclose(rows[5, "intensity_progression", 1], np.clip(pictures[5] + 0.1, 0, 1))
    m = pictures[5].mean()
    assert np.allclose(rows[5, "contrast_progression", 2], np.clip(m + 0.25 * (pictures[5] - m), 0, 1))
    assert rows[3, "blur_progression", 2].std() < rows[3, "blur_progression", 0].std() < pictures[3].std()
    assert simulate.reproducible(shown.where("id = 3"), scenarios, 20).count() == 0
    assert all(r.responds for r in simulate.severity_response(made, shown).collect())
    record = simulate.records(made.where("scenario = 'speckle_progression' AND level = 1 AND parent_acquisition_id = 3")).first()
    import hashlib

    assert record.simulation_id == hashlib.sha256(b"3|Speckle progression|0.50000000|43|1.0").hexdigest()[:16]
    assert record.output_sha256 == hashlib.sha256(rows[3, "speckle_progression", 1].astype("<f4").tobytes()).hexdigest()
    with pytest.raises(ValueError):
        simulate.scenario(spark, severities=(0.5, 0.2))
    with pytest.raises(Exception, match="no such degradation"):
        simulate.degraded(shown.selectExpr("*", "'none' AS degradation", "0.5 AS severity", "1L AS seed"), 20).collect()
    few = simulate.phantoms(spark, 3, side=16).collect()
    assert [r.id for r in few] == ["synthetic_root_0000", "synthetic_root_0001", "synthetic_root_0002"] and 0 <= min(few[0].px) <= max(few[0].px) <= 1
    assert simulate.phantoms(spark, 3, side=16).collect()[2].px == few[2].px and simulate.references(spark, 2, side=32).count() == 2


def png(pixels, depth=8, filters=None):
    h, w = pixels.shape[:2]
    color = 0 if pixels.ndim == 2 else {3: 2, 4: 6}[pixels.shape[2]]
    raw = pixels.astype(">u2" if depth == 16 else np.uint8).reshape(h, -1).view(np.uint8)
    step = raw.shape[1] // w
    lines, before = [], np.zeros(raw.shape[1], int)
    for k, line in enumerate(raw.astype(int)):
        kind = (filters or [0])[k % len(filters or [0])]
        left = np.concatenate([np.zeros(step, int), line[:-step]])
        corner = np.concatenate([np.zeros(step, int), before[:-step]])
        if kind == 4:
            p = left + before - corner
            guess = np.array([min((abs(q - a), 0, a), (abs(q - b), 1, b), (abs(q - c), 2, c))[2] for q, a, b, c in zip(p, left, before, corner)])
        else:
            guess = {0: 0, 1: left, 2: before, 3: (left + before) // 2}[kind]
        lines.append(bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes())
        before = line
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, color, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")


def test_image_files(spark, tmp_path):
    rng = np.random.default_rng(6)
    grey, color, deep = rng.integers(0, 256, (9, 7)), rng.integers(0, 256, (6, 5, 3)), rng.integers(0, 65536, (4, 4))
    assert (images.decoded(png(grey, filters=[0, 1, 2, 3, 4])) == grey).all() and (images.decoded(png(color, filters=[4, 3])) == color).all() and (images.decoded(png(deep, 16, [1, 2])) == deep).all()
    root = tmp_path / "set"
    (root / "b").mkdir(parents=True)
    (root / "Masks").mkdir()
    (root / "a.png").write_bytes(png(grey))
    (root / "b" / "c.PGM").write_bytes(b"P5\n# made\n7 9\n255\n" + grey.astype(np.uint8).tobytes())
    np.save(root / "b" / "d.npy", rng.normal(size=(8, 8)))
    (root / "e.png").write_bytes(b"broken")
    (root / "b" / "notes.txt").write_text("no image")
    (root / "Masks" / "a.png").write_bytes(png(grey))
    all_files = images.discovered(spark, str(root))
    assert sorted(r.path for r in all_files.collect()) == ["Masks/a.png", "a.png", "b/c.PGM", "b/d.npy", "e.png"]
    read, failed = images.read_and_failed(all_files, None)
    rows = {r.path: r for r in read.collect()}
    assert np.allclose(np.array(rows["a.png"].px).reshape(9, 7), grey / 255) and rows["a.png"].px == rows["b/c.PGM"].px
    assert (min(rows["b/d.npy"].px), max(rows["b/d.npy"].px)) == (0, 1) and [r.path for r in failed.collect()] == ["e.png"]
    meta = tmp_path / "meta.csv"
    meta.write_text("﻿acquisition_id,file_path,session_id,frequency\nx1,./b/c.PGM,s1,5\nexperimental_0001, ,s2,\n")
    table = metadata.read_metadata(spark, str(meta))
    rows = {r.provenance.relative_path: r for r in images.experimental(spark, str(root), table, 16).collect()}
    assert rows["b/c.PGM"].id == "x1" and rows["b/c.PGM"].params == {"frequency": "5.0"} and rows["b/c.PGM"].t == 2
    assert rows["a.png"].id == "experimental_0001" and rows["a.png"].session_id == "s2" and rows["b/d.npy"].id == "experimental_0003" and len(rows["a.png"].px) == 256
    shown = images.public(spark, str(root), side=16)
    assert {r.id for r in shown.collect()} == {"public_00000", "public_00001", "public_00002"} and images.public(spark, str(root), most=1).count() == 1
    assert images.discovered(spark, str(tmp_path / "none")).count() == 0
    good, bad = images.valid_acquisitions(shown)
    assert (good.count(), bad.count()) == (3, 0)
    wrong = shown.withColumn("source", F.lit("simulated"))
    assert {r.reason for r in images.valid_acquisitions(wrong)[1].collect()} == {"source and provenance differ"}
    assert images.chosen(shown.limit(0), shown, shown.limit(1), 1, 2).count() == 3
    with pytest.raises(ValueError):
        images.chosen(None, None, shown, source="public")
    assert np.allclose(edges.resized(np.arange(16.0).reshape(4, 4), 2, 2), [[2.5, 4.5], [10.5, 12.5]])


def test_metadata_contract(spark, tmp_path):
    def read(text):
        path = tmp_path / f"{abs(hash(text))}.csv"
        path.write_text(text)
        return metadata.read_metadata(spark, str(path)).collect()

    assert metadata.read_metadata(spark, None).count() == metadata.read_metadata(spark, str(tmp_path / "none.csv")).count() == 0
    row = read('acquisition_id,notes,frame_count,timestamp\n a ," two, parts ",7,2024-01-02T03:04:05\n')[0]
    assert (row.acquisition_id, row.notes, row.frame_count, row.timestamp.second, row.gain) == ("a", "two, parts", 7, 5, None)
    for text, message in (("acquisition_id,extra\na,b\n", "unknown columns: extra"), ("gain\n1\n", "no column acquisition_id"), ("acquisition_id\na\na\n", "a is repeated"), ("acquisition_id,gain\na,loud\n", "gain: loud"), ("acquisition_id,gain\n ,1\n", "without acquisition_id")):
        with pytest.raises(Exception, match=message):
            read(text)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "é, \"x\"", [1, 2]), (2, None, None)], "a int, b string, c array<int>")
    sinks.write_csv(df, str(tmp_path / "csv"), one_file=True)
    assert [tuple(r) for r in spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).orderBy("a").collect()] == [("1", "é, \"x\"", "[1,2]"), ("2", None, None)]
    sinks.write_results(df, df.limit(0), str(tmp_path / "results"))
    assert spark.read.json(str(tmp_path / "results/counts")).first().asDict() == {"errors": 0, "rows": 2}
    sinks.write_report({"one": df, "two": df.limit(1)}, str(tmp_path / "report"))
    assert spark.read.option("header", True).csv(str(tmp_path / "report/two")).count() == 1
    counts = spark.createDataFrame([("s", 3, 1)], "source string, files int, duplicates int")
    sinks.write_text(sinks.audit_markdown(counts, "Audit"), str(tmp_path / "text"))
    assert [r.value for r in spark.read.text(str(tmp_path / "text")).collect()] == ["# Audit", "", "- s: 3 files, 1 duplicates"]
    assert sinks.run_summary(spark, "p", "public", 3, 2, 1).first().n_acquisitions == 6
    assert sinks.value_or(df, df, "zz").first()[0] == "—" and sinks.value_or(df.where("a = 2"), df, "b").first()[0] == "é, \"x\""
    assert metadata.read_csv(spark, str(tmp_path / "none")).columns == metadata.read_json(spark, str(tmp_path / "none")).columns == []


def test_audits(spark):
    rows = spark.createDataFrame([("a", "experimental", None, None), ("b", "simulated", "a", "1.0"), ("c", "simulated", "c", "1.0")], "id string, source string, parent_acquisition_id string, simulation_version string")
    broken = spark.createDataFrame([], "id string, reason string")
    got = {r.check: (r.passed, r.detail) for r in lineage.audited(spark, rows, broken).collect()}
    assert got["simulation_lineage"] == (False, "c is its own root") and got["unique_acquisition_ids"][0]
    ring = spark.createDataFrame([("a", "simulated", "b", "1"), ("b", "simulated", "a", "1")], rows.schema)
    assert not {r.check: r.passed for r in lineage.audited(spark, ring, broken).collect()}["simulation_lineage"]
    roots = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "id int, root int")
    assert [r.root for r in lineage.leaked(roots, roots.where("id = 1"), roots.where("id > 1")).collect()] == [1]
    with pytest.raises(ValueError):
        lineage.split(roots, ["id"], 1, 1, 2)
    assert [r.t for r in tables.indexed(spark.range(1000).repartition(7), ["id"]).orderBy("id").collect()] == list(range(1000))


def test_sql_functions(spark):
    assert "hamming" in functions.register(spark)
    r = spark.sql("SELECT drift_state(10D, 9D, 13D, 18D) AS s, health_state(health_index(90D, 0D)) AS h, hamming(5, 6) AS d, provenance_score('public') AS p, wilson_high(0D, 73D, 1.959963984540054D) AS w").first()
    assert (r.s, r.h, r.d, r.p) == ("EARLY_DRIFT", "NOMINAL", 2, 80.0) and r.w <= 0.05
