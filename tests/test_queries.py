"""Every registered reference query against its SQL at the smallest size, and operators against numpy."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from driftmill.operators import baseline, lineage, series, statistics
from driftmill.plans import quality, registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-6)
    return a == b


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, sql, name):
    df = registry.queries()[name](spark, SF)
    names = sorted(df.columns)
    ours = sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)
    rel = sql.sql(registry.oracle_sql()[name])
    at = [list(rel.columns).index(c) for c in names]
    theirs = sorted((tuple(r[k] for k in at) for r in rel.fetchall()), key=repr)
    assert len(ours) == len(theirs)
    assert all(close(a, b) for x, y in zip(ours, theirs) for a, b in zip(x, y))


def test_baseline_against_numpy(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.2], [0, 0, 1]])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    model = baseline.Baseline(df, ["a", "b", "c"])
    z = (x - x.mean(0)) / (x.std(0, ddof=1) + 1e-12)
    n, p = z.shape
    s = z.T @ z / n
    mu = np.trace(s) / p
    d_ = ((z.T @ z) ** 2).sum() / n**2
    b = ((z**2).T @ (z**2)).sum()
    beta, delta = (b / n - d_) / (n * p), (d_ - 2 * mu * np.trace(s) + p * mu**2) / p
    shrink = min(beta, delta) / delta
    assert math.isclose(model.shrinkage, shrink, rel_tol=1e-9)
    inverse = np.linalg.inv((1 - shrink) * s + shrink * mu * np.eye(p))
    expected = np.einsum("ij,jk,ik->i", z, inverse, z)
    ours = [r[0] for r in df.select(model.distance()).collect()]
    assert np.allclose(sorted(ours), sorted(expected))


def test_chart_statuses(spark):
    def statuses(values):
        df = spark.createDataFrame([("s", k, float(v)) for k, v in enumerate(values)], "k string, t int, v double")
        return [r.status for r in series.chart(df, "k", ["t"], (F.col("v") - 10.0) / 2.0).orderBy("t").collect()]

    assert statuses([9.8, 10.2, 10.1, 9.9, 10.0, 10.3, 9.7, 10.1]) == ["STABLE"] * 8
    assert statuses([10.0, 10.2, 10.1, 14, 15, 16, 17, 18])[-1] == "PERSISTENT_DRIFT"


def test_lineage_orphan_takes_the_missing_parent(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 99)], "id int, parent int")
    assert {r.id: r.root for r in lineage.roots(spark, df).collect()} == {1: 1, 2: 1, 3: 1, 4: 99}


def test_lineage_of_long_chains_and_cycles(spark):
    # 1,500 rows in one chain: 1,125,750 steps in all, and deeper than 100
    rows = [(k, max(k - 1, 0)) for k in range(1500)]
    assert {tuple(r) for r in lineage.roots(spark, spark.createDataFrame(rows, "id int, parent int")).collect()} == {(k, 0) for k in range(1500)}
    ring = [(9, 7), (7, 8), (8, 9), (10, 9), (11, 10), (1, None), (2, 1), (3, 99), (4, 4), (None, None), (None, 1)]
    got = sorted(map(tuple, lineage.roots(spark, spark.createDataFrame(ring, "id int, parent int"), "smallest").collect()), key=repr)
    assert got == sorted([(9, 7), (7, 7), (8, 7), (10, 7), (11, 7), (1, 1), (2, 1), (3, 99), (4, 4), (None, None)], key=repr)
    with pytest.raises(lineage.LineageCycle, match="through 7"):
        lineage.roots(spark, spark.createDataFrame(ring, "id int, parent int"))


def test_lineage_of_repeated_ids(spark):
    # as the SQL has it: a row for each path
    rows = [(1, 1), (2, 1), (2, 1), (3, 2), (4, 3), (4, 5), (5, None)]
    got = lambda own: sorted(tuple(r) for r in lineage.roots(spark, spark.createDataFrame(own, "id int, parent int"), "smallest").collect())
    assert got(rows) == [(1, 1), (2, 1), (2, 1), (3, 1), (3, 1), (4, 1), (4, 1), (4, 5), (5, 5)]
    # 6 and 7 are a cycle that 6 can leave
    assert got([*rows, (6, 7), (7, 6), (6, 5)]) == [(1, 1), (2, 1), (3, 1), (4, 1), (4, 5), (5, 5), (6, 5), (6, 6), (7, 5), (7, 6)]


def test_confusion_of_nothing(spark):
    r = statistics.confusion(spark.createDataFrame([], "x int"), F.col("x") > 0, F.col("x") > 0).first()
    assert (r.tp, r.detection_rate, r.specificity) == (0, 0.0, 1.0)


def test_near_hashes_find_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 30)]
    values = base + [b ^ sum(1 << int(k) for k in rng.choice(62, 2 + n % 4, replace=False)) for n, b in enumerate(base)] + base[:10]
    df = spark.createDataFrame(list(enumerate(values)), "id int, h long")
    members, pairs = lineage.near_hashes(df, "id", "h")
    bits = lambda x: bin(x & (2**64 - 1)).count("1")
    assert {r.id: r["class"] for r in members.collect()} == {i: values.index(v) for i, v in enumerate(values)}
    found = [(r.a, r.b, r.distance) for r in pairs.collect()]
    assert len(found) == len(set(found)) and set(found) == {(i, j, bits(values[i] ^ values[j])) for i in range(60) for j in range(i + 1, 60) if bits(values[i] ^ values[j]) <= 4}
    links = {r.id: r.links for r in lineage.near_links(df, "id", "h").collect()}
    assert links[0] == links[60] == sum(0 in p[:2] for p in found)


def test_near_hash_links_are_there(spark):
    assert registry.queries()["near_hash_links"](spark, SF).where("links > 0").count() > 0
    assert f"<= {quality.NEAR_BITS}" in registry.oracle_sql()["near_hash_links"]
