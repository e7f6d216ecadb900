"""Image files as rows: a recursive scan, decoding to pixels in [0, 1], and the acquisitions that files and metadata make together.

Files are decoded by the executors that read them. PNG (8 and 16 bits, without interlace), PGM and PPM, and NumPy arrays are read
here; for others (JPEG, TIFF, BMP) Pillow is used where it is installed. A file that can't be decoded is a row with an error.
"""

from __future__ import annotations

import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftmill.operators.edges import resized
from driftmill.operators.tables import indexed

# Endings of image files, the side that images are brought to, and parts of paths that mark annotations.
ENDINGS = ("png", "jpg", "jpeg", "bmp", "tif", "tiff", "pgm", "ppm", "npy")
SIDE = 128
EXCLUDED = ("mask", "annotation", "segmentation", "ground_truth", "groundtruth")

PROVENANCE = T.StructType().add("source", "string").add("dataset", "string").add("relative_path", "string").add("is_experimental", "boolean").add("is_public_reference", "boolean").add("is_simulation", "boolean").add("is_real_scan_a", "boolean")


def _png(data: bytes) -> np.ndarray:
    place, held, palette = 8, [], None
    while place < len(data):
        size, kind = struct.unpack(">I4s", data[place : place + 8])
        body = data[place + 8 : place + 8 + size]
        place += 12 + size
        if kind == b"IHDR":
            width, height, depth, color, _, _, interlace = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            held.append(body)
    if depth not in (8, 16) or interlace:
        raise ValueError("a PNG of this depth or with interlace isn't read")
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    step = channels * depth // 8
    raw = np.frombuffer(zlib.decompress(b"".join(held)), np.uint8).reshape(height, width * step + 1)
    out = np.zeros((height, width * step), np.uint8)
    before = np.zeros(width * step, np.int64)
    for k, line in enumerate(raw):
        kind, own = line[0], line[1:].astype(np.int64)
        if kind == 1:
            own = own.reshape(-1, step).cumsum(0).ravel() % 256
        elif kind == 2:
            own = (own + before) % 256
        elif kind in (3, 4):
            for i in range(len(own)):
                a = own[i - step] if i >= step else 0
                if kind == 3:
                    own[i] = (own[i] + (a + before[i]) // 2) % 256
                else:
                    c = before[i - step] if i >= step else 0
                    guess = a + before[i] - c
                    nearest = min((abs(guess - a), 0, a), (abs(guess - before[i]), 1, before[i]), (abs(guess - c), 2, c))[2]
                    own[i] = (own[i] + nearest) % 256
        out[k] = before = own
    if depth == 16:
        out = out.reshape(height, -1, 2).astype(np.uint16)
        out = out[..., 0] * 256 + out[..., 1]
    out = out.reshape(height, width, channels)
    if palette is not None and color == 3:
        return palette[out[..., 0]]
    return out[..., :3] if channels == 4 else out[..., 0] if channels < 3 else out


def _netpbm(data: bytes) -> np.ndarray:
    head = re.match(rb"(P[2356])\s+(?:#[^\n]*\s+)*(\d+)\s+(?:#[^\n]*\s+)*(\d+)\s+(?:#[^\n]*\s+)*(\d+)\s", data)
    if not head:
        raise ValueError("not a PGM or PPM file")
    width, height, most = (int(x) for x in head.groups()[1:])
    channels = 3 if head[1] in (b"P3", b"P6") else 1
    kind = np.dtype(">u2") if most > 255 else np.dtype(np.uint8)
    rest = data[head.end() :]
    own = np.array(rest.split(), np.int64) if head[1] in (b"P2", b"P3") else np.frombuffer(rest, kind, width * height * channels)
    own = own.reshape((height, width, channels) if channels > 1 else (height, width))
    return own.astype(np.uint8 if most == 255 else np.uint16) if most in (255, 65535) else own / most


def decoded(data: bytes) -> np.ndarray:
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return _png(data)
    if data[:6] == b"\x93NUMPY":
        return np.load(io.BytesIO(data), allow_pickle=False)
    if data[:2] in (b"P2", b"P3", b"P5", b"P6"):
        return _netpbm(data)
    from PIL import Image

    return np.asarray(Image.open(io.BytesIO(data)))


def normalized(image: np.ndarray, side: int | None = SIDE) -> np.ndarray:
    """Grey levels in [0, 1]: integers by their width, floats outside [0, 1] by their own extremes (a constant image is zeros), then resized."""
    kind = image.dtype
    own = image.astype(float)
    if own.ndim == 3:
        own = own[..., 0] if own.shape[2] == 1 else own[..., :3] @ np.array([0.299, 0.587, 0.114])
    if own.ndim != 2 or not own.size or not np.isfinite(own).all():
        raise ValueError("an image has two dimensions and finite pixels")
    if kind == np.uint8:
        own = own / 255
    elif kind == np.uint16:
        own = own / 65535
    elif own.min() < 0 or own.max() > 1:
        own = (own - own.min()) / (own.max() - own.min()) if own.max() > own.min() else np.zeros_like(own)
    return np.clip(own if side is None else resized(own, side, side), 0, 1)


def excluded(path: Column) -> Column:
    """Whether any part of a path says that it holds masks or annotations."""
    return F.exists(F.split(F.lower(path), "/"), lambda part: F.array_max(F.array(*(F.contains(part, F.lit(t)) for t in EXCLUDED))))


def discovered(spark: SparkSession, root: str, endings: tuple[str, ...] = ENDINGS, without_masks: bool = False) -> DataFrame:
    """Image files under root: path (relative), length, content. A root that isn't there has none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "path string, length bigint, content binary")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    top = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")
    full = F.regexp_replace("path", r"^([a-z][a-z0-9+.-]*:)/+", r"$1/")
    prefix = re.sub(r"^([a-z][a-z0-9+.-]*:)/+", r"\1/", top) + "/"
    files = files.select(F.substring(full, len(prefix) + 1, 1 << 20).alias("path"), "length", "content")
    files = files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*endings))
    return files.where(~excluded(F.col("path"))) if without_masks else files


def decoded_files(files: DataFrame, side: int | None = SIDE) -> DataFrame:
    """files with height, width, px and error (null where decoding went well) in the place of content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for data in b.column("content").to_pylist():
                try:
                    own = normalized(decoded(data), side)
                    rows.append({"height": own.shape[0], "width": own.shape[1], "px": own.ravel().tolist(), "error": None})
                except Exception as e:  # whatever a broken file does
                    rows.append({"height": None, "width": None, "px": None, "error": f"{type(e).__name__}: {e}"[:200]})
            more = pa.Table.from_pylist(rows, pa.schema([("height", pa.int32()), ("width", pa.int32()), ("px", pa.list_(pa.float64())), ("error", pa.string())]))
            kept = [c for c in b.schema.names if c != "content"]
            for part in pa.table([*(b.column(c) for c in kept), *more.columns], names=[*kept, *more.schema.names]).to_batches():
                yield part

    schema = T.StructType([f for f in files.schema.fields if f.name != "content"]).add("height", "integer").add("width", "integer").add("px", T.ArrayType(T.DoubleType())).add("error", "string")
    return files.mapInArrow(run, schema)


def read_and_failed(files: DataFrame, side: int | None = SIDE) -> tuple[DataFrame, DataFrame]:
    """What was decoded, and path and error of what wasn't."""
    both = decoded_files(files, side)
    return both.where("error IS NULL").drop("error"), both.where("error IS NOT NULL").select("path", "error")


def placed(files: DataFrame) -> DataFrame:
    """files with t, their place in the order of paths from 0."""
    return files.join(indexed(files.select("path"), ["path"]), "path")


def provenance(source: str, dataset: str, path: Column) -> Column:
    """The record of where a row comes from; source is experimental, public or simulated."""
    flags = [source == kind for kind in ("experimental", "public", "simulated")]
    if sum(flags) != 1:
        raise ValueError("a source is experimental, public or simulated")
    return F.struct(F.lit(source).alias("source"), F.lit(dataset).alias("dataset"), path.alias("relative_path"), *(F.lit(f).alias(n) for f, n in zip(flags, ("is_experimental", "is_public_reference", "is_simulation"))), F.lit(False).alias("is_real_scan_a"))


def experimental(spark: SparkSession, root: str, metadata: DataFrame | None = None, side: int | None = SIDE) -> DataFrame:
    """Images under root with what is known of them: id, source, t, height, width, px, params, provenance, session_id, timestamp.

    Metadata meet a file by its path, or else by the id that files without metadata get: experimental_ and four digits of t.
    All other metadata go into params; absent ones stay absent. Files that can't be decoded are left out.
    """
    files, _ = read_and_failed(placed(discovered(spark, root)), side)
    fallback = F.format_string("experimental_%04d", "t")
    if metadata is None:
        from .metadata import SCHEMA

        metadata = spark.createDataFrame([], SCHEMA)
    others = [c for c in metadata.columns if c not in ("acquisition_id", "session_id", "timestamp", "file_path")]
    params = F.map_filter(F.create_map(*(x for c in others for x in (F.lit(c), F.col(c).cast("string")))), lambda _, v: v.isNotNull())
    path = F.regexp_replace(F.regexp_replace("file_path", r"\\", "/"), r"^[./]+", "")
    known = metadata.select("acquisition_id", "session_id", "timestamp", path.alias("file"), params.alias("params"))
    by_path = known.where("file IS NOT NULL").select(F.col("file").alias("path"), F.struct("acquisition_id", "session_id", "timestamp", "params").alias("by_path"))
    by_id = known.select(F.col("acquisition_id").alias("fallback"), F.struct("acquisition_id", "session_id", "timestamp", "params").alias("by_id"))
    rows = files.withColumn("fallback", fallback).join(by_path, "path", "left").join(by_id, "fallback", "left").withColumn("m", F.coalesce("by_path", "by_id"))
    return rows.select(F.coalesce("m.acquisition_id", "fallback").alias("id"), F.lit("experimental").alias("source"), "t", "height", "width", "px", F.coalesce("m.params", F.create_map().cast("map<string,string>")).alias("params"), provenance("experimental", "experimental_ultrasound", F.col("path")).alias("provenance"), F.col("m.session_id").alias("session_id"), F.col("m.timestamp").alias("timestamp"))


def public(spark: SparkSession, root: str, dataset: str = "public_ultrasound", side: int | None = SIDE, most: int | None = None) -> DataFrame:
    """Images of a public set, without masks and annotations: ids public_ and five digits of t. most takes the first files by path, before they are read."""
    files = placed(discovered(spark, root, without_masks=True))
    read, _ = read_and_failed(files if most is None else files.where(F.col("t") < most), side)
    return read.select(F.format_string("public_%05d", "t").alias("id"), F.lit("public").alias("source"), "t", "height", "width", "px", F.create_map().cast("map<string,string>").alias("params"), provenance("public", dataset, F.col("path")).alias("provenance"), F.lit(None).cast("string").alias("session_id"), F.lit(None).cast("timestamp").alias("timestamp"))


def chosen(experimental: DataFrame | None, public: DataFrame | None, simulated: DataFrame, least_experimental: int = 30, least_public: int = 30, source: str = "auto") -> DataFrame:
    """The acquisitions of a named source, or of the first of experimental, public and simulated ones that has rows enough."""
    named = {"experimental": experimental, "public": public, "simulated": simulated}
    if source != "auto":
        if named.get(source) is None:
            raise ValueError(f"no acquisitions of source {source}")
        return named[source]
    for df, least in ((experimental, least_experimental), (public, least_public)):
        if df is not None and df.limit(least).count() >= least:
            return df
    return simulated


def valid_acquisitions(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that keep the contract, and id and reason of those that don't.

    An id and pixels in [0, 1]; one provenance flag, that of the source; simulated rows have scenario, severity in [0, 1],
    parent, seed and version, others none of them.
    """
    lineage = [c for c in ("simulation_scenario", "simulation_severity", "parent_acquisition_id", "simulation_seed", "simulation_version") if c in df.columns]
    simulated = F.col("source") == "simulated"
    flags = F.col("provenance.is_experimental").cast("int") + F.col("provenance.is_public_reference").cast("int") + F.col("provenance.is_simulation").cast("int")
    some = F.coalesce(*(F.col(c).cast("string") for c in lineage)).isNotNull() if lineage else F.lit(False)
    every = F.lit(True)
    for c in lineage:
        every = every & F.col(c).isNotNull()
    checks = [
        (F.col("id").isNull() | (F.trim("id") == ""), "no id"),
        (F.col("px").isNull() | (F.size("px") == 0) | F.exists("px", lambda x: x.isNull() | F.isnan(x) | (x < 0) | (x > 1)), "pixels outside of [0, 1]"),
        (F.coalesce(flags != 1, F.lit(True)), "not one provenance flag"),
        (F.coalesce(F.col("provenance.source") != F.col("source"), F.lit(True)), "source and provenance differ"),
    ]
    if lineage:
        checks += [(simulated & ~every, "a simulation lacks its lineage"), (~simulated & some, "lineage without a simulation")]
        if "simulation_severity" in lineage:
            checks.append((simulated & ~F.col("simulation_severity").between(0, 1), "severity outside of [0, 1]"))
    reason = F.coalesce(*(F.when(c, F.lit(r)) for c, r in checks))
    marked = df.withColumn("reason", reason)
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL").select("id", "reason")
