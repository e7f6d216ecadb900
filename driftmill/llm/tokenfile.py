"""Token-id files: canonical, length-limited Huffman codes in independent blocks.

A dataset is two Parquet tables. ``codebook`` has the code length of every id that occurs; the codes follow from the
lengths by the canonical rule. ``blocks`` has one row for each block of consecutive documents: part and seq (their order),
start (ids before it), doc_ids, n_tokens, n_ids, marks (the bit offset of every STRIDE-th id) and payload (the codes, most
significant bit first). A block is decoded by itself, from all its marks side by side, with one table look-up an id.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BATCH_BYTES, discard, prepare, ragged, written
from .tokens import encoder, forget

#: Ids in a block at most, but for a longer document; ids between two marks; bits of the longest code.
BLOCK, STRIDE, LONGEST = 1 << 19, 64, 20


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Optimal code lengths of at most longest bits by package-merge; 0 where counts is 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << longest:
        raise ValueError("too many ids for this length of code")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    # each level: weights ascending, and which of them are leaves
    levels = []
    packages = np.zeros(0)
    for _ in range(longest):
        every = np.concatenate([leaves, packages])
        at = np.argsort(every, kind="stable")
        levels.append(at < len(leaves))
        every = every[at]
        packages = every[: len(every) // 2 * 2].reshape(-1, 2).sum(1)
    take = 2 * len(used) - 2
    for is_leaf in reversed(levels):
        own = int(is_leaf[:take].sum())
        lengths[order[:own]] += 1  # the own smallest leaves
        take = 2 * (take - own)
    return lengths


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each id's code, by length, then id; and the ids in that order."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    codes = np.zeros(len(lengths), np.uint64)
    if len(order):
        own = lengths[order].astype(np.uint64)
        width = own.max()
        # in units of the longest code, each code begins where the one before ends
        size = np.uint64(1) << (width - own)
        codes[order] = (np.cumsum(size) - size) >> (width - own)
    return codes, order


class Codec:
    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        self.codes, order = canonical(lengths)
        self.width = int(lengths.max()) if len(order) else 1
        # by the next width bits: the id, and below it in five bits its length
        table = np.repeat(order.astype(np.int64) << 5 | lengths[order], 1 << (self.width - lengths[order])) if len(order) else np.zeros(0, np.int64)
        self.table = np.concatenate([table, np.full((1 << self.width) - len(table), 1, np.int64)]).astype(np.int32 if len(lengths) < 1 << 26 else np.int64)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The payload, and the bit offsets of every STRIDE-th id."""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        at = ends - n
        bits = int(ends[-1]) if len(ids) else 0
        # a code touches at most two 32-bit words; those that begin in one word are summed, as their bits are disjoint
        shifted = self.codes[ids] << (64 - (at & 31) - n).astype(np.uint64)
        words = np.zeros(bits // 32 + 2, np.uint64)
        if len(ids):
            word = at >> 5
            cut = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            both, word = np.add.reduceat(shifted, cut), word[cut]
            words[word] += both >> np.uint64(32)
            words[word + 1] += both & np.uint64(0xFFFFFFFF)
        return words.astype(">u4").tobytes()[: (bits + 7) // 8], at[::STRIDE]

    def decode(self, payload: bytes, marks: np.ndarray, n: int) -> np.ndarray:
        # zeros behind the payload, for what the last mark reads beyond it
        b = np.frombuffer(payload + bytes(STRIDE * LONGEST // 8 + 8), np.uint8).astype(np.uint32)
        # the 32 bits that begin at each byte, so that one look-up has width bits (LONGEST at most) after any bit offset
        windows = (b[:-3] << np.uint32(24)) | (b[1:-2] << np.uint32(16)) | (b[2:-1] << np.uint32(8)) | b[3:]
        out = np.empty((STRIDE, len(marks)), np.uint32)
        at = marks.astype(np.uint32 if len(b) < 1 << 28 else np.int64)
        for k in range(STRIDE):
            seen = windows[at >> 3]
            seen <<= (at & 7).astype(np.uint32)
            seen >>= np.uint32(32 - self.width)
            entry = self.table[seen]
            out[k] = entry >> 5
            at += (entry & 31).astype(at.dtype)
        return out.T.reshape(-1)[:n]


def _gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined to BATCH_BYTES at most, or single ones above it: the more text at once, the fewer look-ups of its words."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if held and size + b.nbytes > BATCH_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(b)
        size += b.nbytes
    if held:
        yield pa.concat_batches(held)


def _tokenized(batches: Iterable[pa.RecordBatch], schema: pa.Schema, path: str, end: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, seq, before = TaskContext.get().partitionId(), 0, 0
    names: list[pa.Array] = []
    sizes: list[np.ndarray] = []
    held: list[np.ndarray] = []
    size = 0
    own = encoder(path)

    def block() -> pa.RecordBatch:
        counts, doc_ids = np.concatenate(sizes), pa.concat_arrays(names)
        n = np.array([len(counts)])
        ids = np.concatenate(held)
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), ragged(n, doc_ids), ragged(n, pa.array(counts)), pa.array([len(ids)]), pa.array([before]), pa.array([ids.astype("<u4").tobytes()], pa.binary())], schema=schema)

    for b in _gathered(batches):
        ids, counts = own.ids(b.column(1), end)
        cuts = np.concatenate([[0], np.cumsum(counts)])
        begin = 0
        for i, n in enumerate(counts):
            if size and size + n > BLOCK:
                names.append(b.column(0).slice(begin, i - begin))
                sizes.append(counts[begin:i])
                held.append(ids[cuts[begin] : cuts[i]])
                yield block()
                names, sizes, held, size, begin, seq, before = [], [], [], 0, i, seq + 1, before + size
            size += int(n)
        names.append(b.column(0).slice(begin))
        sizes.append(counts[begin:])
        held.append(ids[cuts[begin] :])
    if size:
        yield block()


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each id occurs in a partition."""
    forget()
    seen = np.zeros(0, np.int64)
    for b in batches:
        for x in b.column(0):
            own = np.bincount(np.frombuffer(x.as_buffer(), "<u4"))
            if len(own) > len(seen):
                own[: len(seen)] += seen
                seen = own
            else:
                seen[: len(own)] += own
    used = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(seen[used], pa.int64())], names=["id", "n"])


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenize every text whole (null as empty), append the id end, and write the dataset in folder, by ascending id.

    Rows that share an id come by text, null ids first. Executors read tokenizer, a file that each of them has.
    """
    spark = docs.sparkSession
    prepare(spark)
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = source.schema["doc_id"].dataType
    head = T.StructType().add("part", T.IntegerType()).add("seq", T.IntegerType())
    listed = T.StructType().add("doc_ids", T.ArrayType(own)).add("n_tokens", T.ArrayType(T.LongType())).add("n_ids", T.LongType())
    # inside: ids before the block in its part
    schema = T.StructType([*head, *listed]).add("inside", T.LongType()).add("ids", T.BinaryType())

    def tokenize(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        return _tokenized(batches, to_arrow_schema(schema), tokenizer, end)

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = source.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    raw, raw_at = written(ordered.mapInArrow(tokenize, schema), "ids")

    # as many rows as the vocabulary has ids
    totals = raw.select("ids").mapInArrow(_counted, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r.id for r in totals), default=0) + 1, np.int64)
    for r in totals:
        counts[r.id] = r.n
    lengths = code_lengths(counts)
    # from Arrow, as rows would start Python workers of another kind on the executors
    used = np.flatnonzero(lengths)
    spark.createDataFrame(pa.table({"id": pa.array(used, pa.int32()), "bits": pa.array(lengths[used], pa.int32())})).coalesce(1).write.parquet(f"{folder}/codebook")

    # ids before each part: a row for each partition
    before, so_far = {}, 0
    for r in raw.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():
        before[r.part], so_far = so_far, so_far + r.n
    sent = spark.sparkContext.broadcast((lengths, before))  # one number for each id of the vocabulary, and for each part
    result = T.StructType([*head, *listed]).add("start", T.LongType()).add("marks", T.ArrayType(T.LongType())).add("payload", T.BinaryType())

    def encode(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        forget()
        lengths, before = sent.value
        codec, arrow = Codec(lengths), to_arrow_schema(result)
        for b in batches:
            for i in range(len(b)):
                start = before[b.column("part")[i].as_py()] + b.column("inside")[i].as_py()
                payload, marks = codec.encode(np.frombuffer(b.column("ids")[i].as_buffer(), "<u4"))
                row = b.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*(row.column(c) for c in arrow.names[:5]), pa.array([start], pa.int64()), ragged(np.array([len(marks)]), pa.array(marks, pa.int64())), pa.array([payload], pa.binary())], schema=arrow)

    raw.mapInArrow(encode, result).write.option("compression", "none").parquet(f"{folder}/blocks")
    discard(spark, raw_at)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The dataset's documents: doc_id, start (ids of all documents before it), ids (binary, little-endian 32-bit)."""
    prepare(spark)
    book = spark.read.schema("id int, bits int").parquet(f"{folder}/codebook").collect()
    lengths = np.zeros(max((r.id for r in book), default=0) + 1, np.int64)
    for r in book:
        lengths[r.id] = r.bits
    sent = spark.sparkContext.broadcast(lengths)
    blocks = spark.read.parquet(f"{folder}/blocks")
    schema = T.StructType().add("doc_id", blocks.schema["doc_ids"].dataType.elementType).add("start", T.LongType()).add("ids", T.BinaryType())

    def decode(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        forget()
        codec, arrow = Codec(sent.value), to_arrow_schema(schema)
        for b in batches:
            for i in range(len(b)):
                counts = b.column("n_tokens")[i].values.to_numpy()
                ids = codec.decode(b.column("payload")[i].as_py(), b.column("marks")[i].values.to_numpy(), b.column("n_ids")[i].as_py()).astype("<u4")
                raw, ends = ids.tobytes(), np.cumsum(counts)
                yield pa.RecordBatch.from_arrays([b.column("doc_ids")[i].values, pa.array(ends - counts + b.column("start")[i].as_py()), pa.array([raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), counts.tolist())], pa.binary())], schema=arrow)

    return blocks.select("doc_ids", "n_tokens", "n_ids", "start", "marks", "payload").mapInArrow(decode, schema)
