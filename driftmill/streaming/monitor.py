"""The control chart as a stream: state for each series is five numbers, kept by Spark between micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def monitored(stream: DataFrame, key: str, order: str, value: str, mean: float, std: float, lam: float = 0.2, limit: float = 3.0, k: float = 0.5, h: float = 5.0, run: int = 3) -> DataFrame:
    """Every value of a stream with key, order, t (its place in the series), z, ewma, cusum_pos, cusum_neg, run and status.

    Rows of a micro-batch are taken in order; rows that come in a later batch come later. Gives what the chart over a whole
    table gives, if batches arrive in order.
    """
    if not std > 0:
        raise ValueError("the deviation is positive")
    bound = limit * (lam / (2 - lam)) ** 0.5
    kinds = dict(stream.dtypes)
    rows = stream.select(key, order, F.col(value).cast("double").alias("v"))

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        t, e, up, down, runs = state.get if state.exists else (0, 0.0, 0.0, 0.0, 0)
        own = pd.concat(list(batches)).sort_values(order, kind="stable")
        out = []
        for at, v in zip(own[order], own["v"]):
            z = (v - mean) / std
            e = lam * z + (1 - lam) * e
            up, down = max(0.0, up + z - k), min(0.0, down + z + k)
            runs = runs + 1 if abs(z) >= limit or abs(e) >= bound or up >= h or -down >= h else 0
            out.append((name[0], at, t, z, e, up, down, runs, "PERSISTENT_DRIFT" if runs >= run else "DRIFT_SIGNAL" if runs else "STABLE"))
            t += 1
        state.update((t, e, up, down, runs))
        yield pd.DataFrame(out, columns=[key, order, "t", "z", "ewma", "cusum_pos", "cusum_neg", "run", "status"])

    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, t bigint, z double, ewma double, cusum_pos double, cusum_neg double, run bigint, status string"
    return rows.groupBy(key).applyInPandasWithState(step, schema, "t bigint, e double, up double, down double, runs bigint", "append", GroupStateTimeout.NoTimeout)


def windowed(stream: DataFrame, key: str, time: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """By series and window: rows, mean, smallest and largest value. Windows close when the watermark passes them."""
    rows = stream.withWatermark(time, late).groupBy(key, F.window(time, width).alias("w"))
    return rows.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean", "min", "max")


def appended(stream: DataFrame, path: str, checkpoint: str):
    """Write a stream to a Parquet history as far as its source goes, and end."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
