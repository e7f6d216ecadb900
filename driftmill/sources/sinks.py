"""Sinks: tables as CSV, JSON lines and text in folders, and the records that sum a run up.

A table is written by all executors, a file a partition; one file is asked for by name, for tables that people read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """With a header; nested values as JSON."""
    flat = df.select(*(F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes))
    (flat.coalesce(1) if one_file else flat).write.option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str, one_file: bool = False) -> None:
    """A record a line, nulls kept."""
    (df.coalesce(1) if one_file else df).write.option("ignoreNullFields", False).json(path)


def write_text(lines: DataFrame, path: str) -> None:
    """The table's only column, a line a row."""
    lines.coalesce(1).write.text(path)


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as CSV in a folder of its name."""
    for name, df in tables.items():
        write_csv(df, f"{path}/{name}", one_file=True)


def write_results(rows: DataFrame, errors: DataFrame, path: str) -> None:
    """Features as CSV and JSON, errors as JSON, and how many there are of each."""
    write_csv(rows, f"{path}/features")
    write_json(rows, f"{path}/features_json")
    write_json(errors, f"{path}/errors")
    counts = rows.agg(F.count("*").alias("rows")).crossJoin(errors.agg(F.count("*").alias("errors")))  # one row each
    write_json(counts, f"{path}/counts", one_file=True)


def run_summary(spark: SparkSession, project: str, source: str, baseline: int, calibration: int, test: int, latest: DataFrame | None = None) -> DataFrame:
    """The record of a run: sizes, and the last state, quality and drift of the last row of latest, if there is one."""
    row = spark.createDataFrame([(project, baseline + calibration + test, source, baseline, calibration, test)], "project string, n_acquisitions bigint, source string, baseline_size bigint, calibration_size bigint, test_size bigint")
    own = ["state", "quality", "drift_status"]
    last = latest.select(*(F.col(c).alias(f"latest_{c}") for c in own)).limit(1) if latest is not None else spark.createDataFrame([], ", ".join(f"latest_{c} string" for c in own))
    return row.join(last, F.lit(True), "left")


def audit_markdown(counts: DataFrame, title: str) -> DataFrame:
    """A report's lines: a title, then what each source holds; counts has source, files, duplicates."""
    line: Column = F.format_string("- %s: %d files, %d duplicates", "source", "files", "duplicates")
    rows = counts.select(F.lit(1).alias("k"), F.col("source").alias("s"), line.alias("value"))
    head = counts.sparkSession.createDataFrame([(0, "", f"# {title}"), (0, "\x01", "")], "k int, s string, value string")
    return head.unionByName(rows).orderBy("k", "s").select("value")


def value_or(latest: DataFrame, summary: DataFrame, key: str, fallback: str = "—") -> DataFrame:
    """A key's value in the latest row, else in the summary, else the fallback; one row."""
    of = lambda df: df.select(F.col(key).cast("string").alias("v")).limit(1) if key in df.columns else df.sparkSession.createDataFrame([], "v string")
    both = of(latest).withColumn("k", F.lit(0)).unionByName(of(summary).withColumn("k", F.lit(1))).where("v IS NOT NULL")
    return both.agg(F.coalesce(F.min_by("v", "k"), F.lit(fallback)).alias(key))
