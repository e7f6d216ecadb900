"""Questions to a history of states: rows of one source in their order. Each is one aggregation, so no history is collected but where the answer is a series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def appended(history: DataFrame, states: DataFrame, required: list[str]) -> DataFrame:
    """history and further states; states that lack what is required are an error when they are read."""
    lacking = F.coalesce(*(F.when(F.col(c).isNull(), F.lit(c)) for c in required))
    checked = states.withColumn(required[0], F.when(lacking.isNull(), F.col(required[0])).otherwise(F.raise_error(F.concat(F.lit("a state lacks "), lacking))))
    return history.unionByName(checked, allowMissingColumns=True)


def latest(history: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of every source."""
    own = [c for c in history.columns if c != key]
    return history.groupBy(key).agg(F.max_by(F.struct(*own), F.struct(*order)).alias("s")).select(key, "s.*")


def ordered_series(history: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Of every source, an array a column in the rows' order; a source's history must fit a row, as what is asked for is one."""
    rows = history.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *(c for c in columns if c not in order)))).alias("s"))
    return rows.select(key, *(F.col(f"s.{c}").alias(c) for c in columns))


def counts(history: DataFrame, column: str) -> DataFrame:
    return history.groupBy(column).agg(F.count("*").alias("n"))


def sources(history: DataFrame, key: str) -> DataFrame:
    return history.select(key).distinct()


def alarms(history: DataFrame, key: str, t: str, alarm: Column, persistent: Column) -> DataFrame:
    """Of every source: rows, alarms, the first alarm's place (null for none) and whether any drift persisted."""
    return history.groupBy(key).agg(F.count("*").alias("n"), F.count_if(alarm).alias("alarms"), F.min(F.when(alarm, F.col(t))).alias("first_alarm"), F.coalesce(F.bool_or(persistent), F.lit(False)).alias("persistent"))


def summary(history: DataFrame, key: str, order: list[str], state: str, quality: str) -> DataFrame:
    """A line of text on every source: rows, last state, mean quality, and how many rows aren't nominal."""
    out = history.groupBy(key).agg(F.count("*").alias("n"), F.max_by(state, F.struct(*order)).alias("last"), F.avg(quality).alias("mean"), F.count_if(F.col(state) != "NOMINAL").alias("other"))
    text = F.concat_ws(" | ", F.concat(F.lit("states="), F.col("n")), F.concat(F.lit("latest="), F.col("last")), F.concat(F.lit("mean_quality="), F.format_string("%.2f", "mean")), F.concat(F.lit("not_nominal="), F.col("other")))
    return out.select(key, text.alias("summary"))


def stages(history: DataFrame, t: Column, baseline: int, calibration: int) -> DataFrame:
    """history with stage: baseline, calibration or test by the place of a row."""
    return history.withColumn("stage", F.when(t < baseline, "baseline").when(t < baseline + calibration, "calibration").otherwise("test"))
