"""Learned models: isolation forests over standardised features, and random forests of Spark ML.

Isolation trees need 256 rows each, so they are grown on the driver from a sample of SAMPLE rows at most (those of smallest
hash); all rows are scored on the executors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .signature import contract_hash

VERSION = "1.0"
#: Rows that forests and their reference scores are fitted on at most, and rows of a tree.
SAMPLE, TREE_ROWS = 4096, 256
SEEDS = (11, 23, 37, 41, 53, 67, 79)


def path_length(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grown(x: np.ndarray, rng: np.random.Generator, most: int) -> tuple[np.ndarray, ...]:
    """One tree over all rows of x as arrays: feature (-1 for a leaf), threshold, left child, and depth with what is left below."""
    feature, threshold, left, depth = [], [], [], []
    wait = [(np.arange(len(x)), 0)]
    while wait:
        rows, at = wait.pop(0)
        low, high = x[rows].min(0), x[rows].max(0)
        open_ = np.flatnonzero(high > low)
        depth.append(at + float(path_length(len(rows))))
        if at >= most or len(rows) < 2 or not len(open_):
            feature.append(-1)
            threshold.append(0.0)
            left.append(0)
            continue
        f = int(rng.choice(open_))
        cut = rng.uniform(low[f], high[f])
        feature.append(f)
        threshold.append(cut)
        left.append(len(feature) + len(wait))
        below = x[rows, f] <= cut
        wait += [(rows[below], at + 1), (rows[~below], at + 1)]
    return np.array(feature), np.array(threshold), np.array(left), np.array(depth)


@dataclass
class Forest:
    trees: list[tuple[np.ndarray, ...]]
    rows: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2 to the power of minus the mean depth by the expected one; near 1 for what is isolated soon."""
        total = np.zeros(len(x))
        for feature, threshold, left, depth in self.trees:
            at = np.zeros(len(x), int)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[np.arange(len(x)), np.maximum(f, 0)] > threshold[at]
                at = np.where(inner, left[at] + right, at)
            total += depth[at]
        return 2.0 ** -(total / len(self.trees) / max(float(path_length(self.rows)), 1e-9))


class AnomalyModel:
    """Forests of several seeds over standardised features, and their scores of the reference rows.

    contamination None votes at a score of 0.5; a share votes at the score that so many reference rows exceed.
    """

    def __init__(self, df: DataFrame, features: list[str], trees: int = 200, seeds: tuple[int, ...] = SEEDS, contamination: float | None = None, sample: int = SAMPLE):
        if trees < 50 or len(seeds) < 3 or len(set(seeds)) < len(seeds):
            raise ValueError("a model has 50 trees and three different seeds at least")
        self.features, self.contamination = list(features), contamination
        moments = df.agg(F.count("*").alias("n"), *(F.avg(f).alias(f"m_{f}") for f in features), *(F.stddev_pop(f).alias(f"s_{f}") for f in features)).first()
        self.n = moments["n"]
        if not self.n:
            raise ValueError("a model needs rows")
        self.mean = np.array([moments[f"m_{f}"] for f in features], float)
        self.std = np.array([moments[f"s_{f}"] or 1.0 for f in features], float)
        h = F.xxhash64(*features)
        rows = df.select(*(F.col(f).cast("double") for f in features), h.alias("h")).orderBy("h", *features).limit(sample).collect()
        x = (np.array([[r[f] for f in features] for r in rows], float) - self.mean) / self.std
        if not np.isfinite(x).all():
            raise ValueError("values that aren't finite")
        size = min(TREE_ROWS, len(x))
        most = max(1, math.ceil(math.log2(max(size, 2))))
        self.forests = []
        for seed in seeds:
            rng = np.random.default_rng(seed)
            self.forests.append(Forest([grown(x[rng.choice(len(x), size, replace=False)], rng, most) for _ in range(trees)], size))
        raw = np.stack([f.scores(x) for f in self.forests])
        self.reference = np.sort(raw.mean(0))
        self.limits = np.full(len(seeds), 0.5) if contamination is None else np.quantile(raw, 1 - contamination, axis=1)
        self.settings = {"trees": str(trees), "models": str(len(seeds)), "sample": str(len(x)), "contamination": str(contamination)}

    def judged(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """Score (share of reference rows that score no more), share of forests that vote anomaly, confidence, agreement."""
        raw = np.stack([f.scores((x - self.mean) / self.std) for f in self.forests])
        score = np.searchsorted(self.reference, raw.mean(0) + 1e-12, "right") / len(self.reference)
        votes = (raw > self.limits[:, None]).mean(0)
        agreement = np.maximum(votes, 1 - votes)
        spread = raw.std(0) / (np.abs(raw).mean(0) + 1e-9)
        return score, votes, np.clip(0.5 * agreement + 0.5 * (1 - spread), 0, 1), agreement

    def assessed(self, df: DataFrame) -> DataFrame:
        """df with assessment: score, vote_rate, confidence, agreement, state."""
        sent = df.sparkSession.sparkContext.broadcast(self)  # bounded by trees, seeds and SAMPLE

        def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            for own in batches:
                x = np.stack([c.to_numpy(zero_copy_only=False) for c in own], 1).astype(float)
                yield pa.StructArray.from_arrays([pa.array(v, pa.float64()) for v in sent.value.judged(x)], ["score", "vote_rate", "confidence", "agreement"])

        run.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
        out = df.withColumn("__a", arrow_udf(run, "struct<score:double,vote_rate:double,confidence:double,agreement:double>")(*(F.col(f).cast("double") for f in self.features)))
        a = F.col("__a")
        state = F.when((a["vote_rate"] >= 0.67) | (a["score"] >= 0.80), "ANOMALY").when((a["vote_rate"] >= 0.34) | (a["score"] >= 0.50), "WATCH").otherwise("NOMINAL")
        return out.withColumn("assessment", F.struct(*(a[c].alias(c) for c in ("score", "vote_rate", "confidence", "agreement")), state.alias("state"))).drop("__a")

    def influences(self, df: DataFrame, keys: list[str]) -> DataFrame:
        """By row and feature: how much the score falls where the feature has its mean, as a share of all falls; ranked."""
        sent = df.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            for own in batches:
                m = sent.value
                x = np.stack([c.to_numpy(zero_copy_only=False) for c in own], 1).astype(float)
                base = m.judged(x)[0]
                falls = np.zeros_like(x)
                for k in range(x.shape[1]):
                    other = x.copy()
                    other[:, k] = m.mean[k]
                    falls[:, k] = np.maximum(0, base - m.judged(other)[0])
                total = falls.sum(1, keepdims=True)
                yield pa.array((falls / np.where(total > 0, total, 1)).tolist(), pa.list_(pa.float64()))

        run.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
        shares = arrow_udf(run, "array<double>")(*(F.col(f).cast("double") for f in self.features))
        items = F.array_sort(F.transform(F.col("__s"), lambda v, i: F.struct((-v).alias("minus"), i.alias("place"), F.get(F.array(*map(F.lit, self.features)), i).alias("feature"))))
        ranked = df.select(*keys, shares.alias("__s")).select(*keys, F.posexplode(items).alias("at", "x"))
        return ranked.select(*keys, F.col("x.feature").alias("feature"), (0.0 - F.col("x.minus")).alias("influence"), (F.col("at") + 1).alias("rank"))

    def card(self, spark: SparkSession, source: str = "reference") -> DataFrame:
        return model_card(spark, "unsupervised_anomaly", self.n, source, self.features, self.settings)


def model_card(spark: SparkSession, task: str, rows: int, source: str, features: list[str], settings: dict[str, str]) -> DataFrame:
    """What is kept of a fitted model; one row."""
    row = spark.createDataFrame([(task, VERSION, int(rows), source, list(features), dict(settings))], "task string, model_version string, rows bigint, source string, features array<string>, settings map<string,string>")
    return row.withColumns({"contract_hash": contract_hash(features), "created_at": F.current_timestamp()})


def input_hash(vector: Column) -> Column:
    """SHA-256 of an array's numbers as little-endian doubles."""
    from .simulate import pixel_hash

    return pixel_hash(vector, "<f8")


def inference_records(assessed: DataFrame, key: str, source: Column, features: list[str], task: str = "unsupervised_anomaly") -> DataFrame:
    """An audit record for every assessment."""
    output = F.create_map(F.lit("anomaly_score"), F.col("assessment.score"), F.lit("anomaly_vote_rate"), F.col("assessment.vote_rate"), F.lit("ensemble_agreement"), F.col("assessment.agreement"))
    return assessed.select(F.col(key).cast("string").alias("acquisition_id"), F.lit(VERSION).alias("model_version"), F.lit(task).alias("task"), input_hash(F.array(*(F.col(f).cast("double") for f in features))).alias("input_hash"), source.alias("source"), output.alias("output"), F.col("assessment.confidence").alias("confidence"), F.current_timestamp().alias("created_at"))


def _assembled(df: DataFrame, features: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="error").transform(df)


class ClassModel:
    """A random forest over classes that weigh alike: a class of n_c among n rows of k classes weighs n / (k * n_c)."""

    def __init__(self, df: DataFrame, features: list[str], label: str, trees: int = 200, seed: int = 42):
        from pyspark.ml.classification import RandomForestClassifier
        from pyspark.ml.feature import StringIndexer

        self.features = list(features)
        counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}  # a row a class
        if len(counts) < 2:
            raise ValueError("there are two classes at least")
        n, k = sum(counts.values()), len(counts)
        weight = F.coalesce(*(F.when(F.col(label) == c, n / (k * m)) for c, m in counts.items()))
        self.index = StringIndexer(inputCol=label, outputCol="__y", stringOrderType="alphabetAsc").fit(df)
        rows = _assembled(self.index.transform(df).withColumn("__w", weight), self.features)
        self.model = RandomForestClassifier(featuresCol="__x", labelCol="__y", weightCol="__w", numTrees=trees, seed=seed, probabilityCol="__p", predictionCol="__c").fit(rows)

    def predicted(self, df: DataFrame) -> DataFrame:
        """df with predicted (the likeliest class) and chances (map by class)."""
        from pyspark.ml.functions import vector_to_array

        names = F.array(*map(F.lit, self.index.labels))
        out = self.model.transform(_assembled(df, self.features))
        chances = F.map_from_arrays(names, vector_to_array("__p"))
        return out.withColumns({"predicted": F.get(names, F.col("__c").cast("int")), "chances": chances}).select(*df.columns, "predicted", "chances")

    def importances(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(f, float(v)) for f, v in zip(self.features, self.model.featureImportances.toArray())], "feature string, importance double")


class EnsembleModel:
    """Random forests of several seeds that predict a number; their spread is the uncertainty."""

    def __init__(self, df: DataFrame, features: list[str], target: str, trees: int = 200, seeds: tuple[int, ...] = SEEDS):
        from pyspark.ml.regression import RandomForestRegressor

        self.features = list(features)
        rows = _assembled(df.withColumn("__y", F.col(target).cast("double")), self.features)
        self.models = [RandomForestRegressor(featuresCol="__x", labelCol="__y", numTrees=trees, seed=s, predictionCol=f"__m{k}").fit(rows) for k, s in enumerate(seeds)]

    def predicted(self, df: DataFrame) -> DataFrame:
        """df with prediction (mean), lower and upper (fifth and 95th percentiles of the members) and confidence, 1 / (1 + deviation)."""
        from . import image

        out = _assembled(df, self.features)
        for m in self.models:
            out = m.transform(out)
        own = F.array(*(F.col(f"__m{k}") for k in range(len(self.models))))
        return out.select(*df.columns, image.mean(own).alias("prediction"), image.quantile(own, 0.05).alias("lower"), image.quantile(own, 0.95).alias("upper"), (1 / (1 + F.sqrt(image.variance(own)))).alias("confidence"))
