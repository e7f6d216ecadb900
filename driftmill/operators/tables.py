"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, or that of the context; without either a temporary one, in local mode alone."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir")
    if not root:
        held = context._jsc.sc().getCheckpointDir()
        if held.isEmpty():
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="driftmill-"))
            held = context._jsc.sc().getCheckpointDir()
        root = held.get()
    return root.rstrip("/")


def fresh(spark: SparkSession, label: str) -> tuple[str, Callable[[], bool]]:
    """A path in the shared folder, and what deletes it; it goes at the latest when the application ends."""
    path = f"{shared_root(spark)}/driftmill-{uuid.uuid4().hex}-{label}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.deleteOnExit(at)
    return path, lambda: fs.delete(at, True)


def written(df: DataFrame, label: str = "table") -> tuple[DataFrame, Callable[[], bool]]:
    """df as a Parquet table in the shared folder, which outlives any executor, and what deletes it."""
    path, drop = fresh(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), drop


def indexed(df: DataFrame, order: list[str], name: str = "t") -> DataFrame:
    """df with the place of each row in the order from 0, ties at random but each place once.

    Rows are dealt by range, numbered in their part, and moved by what earlier parts hold, so that no task sees all.
    """
    dealt, _ = written(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "dealt")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # a row a part
    parts = dealt.groupBy("__part").agg(F.count("*").alias("n")).select(F.col("__part").alias("__p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__first"))
    own = dealt.join(F.broadcast(parts), F.col("__part") == F.col("__p"))
    return own.withColumn(name, F.col("__first") + F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1).drop("__part", "__p", "__first")
