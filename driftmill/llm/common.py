"""What the corpus operators share: tables in the shared folder, words as numpy codes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes in one Arrow batch at most, so that a batch of very long texts still fits a Python worker.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20

#: Rows of a table for each file that an intermediate table made from it is written in, beside two files a core.
FILE_ROWS = 20_000

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches that this session hands to Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a temporary one only in local mode, where nothing else is set."""
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


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def fresh(spark: SparkSession, label: str) -> str:
    """A path in the shared folder, which outlives any executor. It goes when the application ends, or earlier by ``discard``."""
    path = f"{shared_root(spark)}/driftmill-{uuid.uuid4().hex}-{label}"
    at, fs = _path(spark, path)
    fs.deleteOnExit(at)
    return path


def files(spark: SparkSession, rows: int) -> int:
    """In how many files tables of about so many rows are written: each file takes two processes on an executor, and a task."""
    return max(2 * spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS))


def written(df: DataFrame, label: str, most: int | None = None) -> tuple[DataFrame, str]:
    """df as a Parquet table at a fresh path, in most files at most, if given; and this path."""
    path = fresh(df.sparkSession, label)
    (df.coalesce(most) if most else df).write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        at, fs = _path(spark, path)
        fs.delete(at, True)


def codes(values: pa.Array, table: bytes | None = None) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Words of UTF-8 rows, split at the six ASCII white-space characters after an optional byte translation.

    Gives each word's number among the distinct words, these words, and the words in each row.
    """
    words: list[bytes] = []
    counts = np.zeros(len(values), np.int64)
    for i, text in enumerate(values.to_pylist()):
        if text:
            own = (text.translate(table) if table else text).split()
            counts[i] = len(own)
            words += own
    coded = pa.array(words, pa.binary()).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist(), counts


def hashes(words: list[bytes], seed: int = 0) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values, so that sums of word hashes spread over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolled(h: np.ndarray, width: int, base: int) -> np.ndarray:
    """Rabin-Karp hashes modulo 2**64 of every run of width words, by their first word."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out *= np.uint64(base)
        out += h[k : k + n]
    return mixed(out)


def ragged(lengths: np.ndarray, values: pa.Array) -> pa.ListArray:
    """One list for each length, cut from values."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), values)
