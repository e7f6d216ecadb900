"""Acquisition metadata and feature tables as CSV or JSON files, read by fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of a metadata file by type; acquisition_id is required.
TEXT = "acquisition_id session_id campaign_phase device_id probe_id preset mode focus tgc roi target_id operator_id notes file_path file_format dimensions quality_flag".split()
NUMBERS = "frequency gain depth dynamic_range pulse_duration_us prf_hz sound_speed_m_s output_power velocity_scale".split()
WHOLE = "bit_depth frame_count".split()
SCHEMA = ", ".join([*(f"{c} string" for c in TEXT), "timestamp timestamp", *(f"{c} double" for c in NUMBERS), *(f"{c} int" for c in WHOLE)])
COLUMNS = [*TEXT, "timestamp", *NUMBERS, *WHOLE]


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _strings(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    # a byte-order mark belongs to no name
    return df.toDF(*(c.lstrip("﻿").strip().strip('"') for c in df.columns))


def read_metadata(spark: SparkSession, path: str | None) -> DataFrame:
    """A metadata file with all known columns; without a file an empty table.

    Unknown columns, a missing or repeated acquisition_id, and values that aren't of their column's type are errors. Values are
    trimmed and blank ones null; rows without an id are an error as well.
    """
    if path is None or not _there(spark, path):
        return spark.createDataFrame([], SCHEMA)
    raw = _strings(spark, path)
    unknown = sorted(set(raw.columns) - set(COLUMNS))
    if "acquisition_id" not in raw.columns or unknown:
        raise ValueError(f"unknown columns: {', '.join(unknown)}" if unknown else "no column acquisition_id")
    kinds = {"timestamp": "timestamp"} | dict.fromkeys(NUMBERS, "double") | dict.fromkeys(WHOLE, "int")
    blank = raw.select(*(F.nullif(F.trim(c), F.lit("")).alias(c) for c in raw.columns))
    # casts fail loudly whatever the session's setting
    failed = lambda c: F.col(c).isNotNull() & F.col(c).try_cast(kinds[c]).isNull()
    cast = lambda c: F.when(failed(c), F.raise_error(F.concat(F.lit(f"{c}: "), F.col(c))).cast(kinds[c])).otherwise(F.col(c).try_cast(kinds[c])).alias(c)
    df = blank.select(*((cast(c) if c in kinds else F.col(c)) if c in raw.columns else F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in COLUMNS))
    twice = df.groupBy("acquisition_id").agg(F.count("*").alias("n")).where("n > 1 OR acquisition_id IS NULL").limit(1).collect()
    if twice:
        raise ValueError("a row without acquisition_id" if twice[0][0] is None else f"acquisition_id {twice[0][0]} is repeated")
    return df


def inspected_metadata(df: DataFrame, fields: list[str], key: str = "acquisition_id") -> tuple[DataFrame, DataFrame]:
    """Rows and missing values a field (a blank one is missing), and repeated keys with how often they occur."""
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    one = df.agg(F.count("*").alias("rows"), *(F.count_if(blank(c)).alias(c) for c in fields))
    repeated = df.where(~blank(key)).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    return one.unpivot(["rows"], fields, "field", "missing"), repeated


def read_feature_table(spark: SparkSession, path: str, features: list[str], group: str = "dataset") -> DataFrame:
    """A CSV of features by dataset: names trimmed, what isn't a number NaN; missing columns are an error."""
    raw = _strings(spark, path)
    lacking = [c for c in (group, *features) if c not in raw.columns]
    if lacking:
        raise ValueError(f"no columns {', '.join(lacking)}")
    return raw.select(F.trim(group).alias(group), *(F.coalesce(F.trim(c).try_cast("double"), F.lit(float("nan"))).alias(c) for c in features))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """An artifact, or an empty table without columns where there is none."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path) if _there(spark, path) else spark.range(0).select()


def read_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """An artifact as one row a record (a whole file is one, or an array of them; with lines every line), or an empty table without columns."""
    return spark.read.option("multiLine", not lines).json(path) if _there(spark, path) else spark.range(0).select()
