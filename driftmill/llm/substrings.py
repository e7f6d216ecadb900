"""Substring dedup: Rabin-Karp hashes of every window of width words, counted in Spark.

Documents are put in order of id and cut into batches, a row each. A batch sends each of its distinct window hashes once,
to the bucket that a second hash names. A bucket, which sees every batch's hashes in the order of the batches, answers with a bit
for each: whether an earlier batch has the window. Inside a batch, all but the first of equal windows are repeats
already. So a passage that stands in a third of all documents sends one hash for each batch, and what is shuffled for a
window is its 8-byte hash and one bit.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import codes, discard, hashes, prepare, ragged, rolled, written

#: Bytes of text in a batch at most, but for a longer document, which is a batch of its own.
BATCH = 4 << 20
#: Window hashes in a bucket, about.
BUCKET = 1_000_000


def _batches(source: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, number, size = TaskContext.get().partitionId(), 0, 0
    held: list[pa.RecordBatch] = []

    def row(number: int) -> pa.RecordBatch:
        ids = pa.concat_arrays([b.column(0) for b in held])
        texts = pa.concat_arrays([b.column(1) for b in held])
        n = np.array([len(ids)])
        return pa.RecordBatch.from_arrays([pa.array([(part << 33) + number]), ragged(n, ids), ragged(n, texts)], schema=schema)

    for batch in source:
        lengths = np.diff(np.frombuffer(batch.column(1).buffers()[1], np.int32, len(batch) + 1, batch.column(1).offset * 4))
        begin = 0
        for i, n in enumerate(lengths):
            if size and size + n > BATCH:
                if i > begin:
                    held.append(batch.slice(begin, i - begin))
                yield row(number)
                number, size, begin, held = number + 1, 0, i, []
            size += int(n)
        if len(batch) > begin:
            held.append(batch.slice(begin))
    if held:
        yield row(number)


class Windows:
    """The windows of a batch's documents: for each its number among the distinct ones, which come by bucket, then hash."""

    def __init__(self, texts: pa.Array, width: int, buckets: int):
        word, distinct, self.words = codes(texts)
        starts = np.cumsum(self.words) - self.words
        # the first word of every window that ends in its document
        self.at = np.concatenate([np.arange(s, s + n - width + 1) for s, n in zip(starts, self.words) if n >= width] or [np.zeros(0, np.int64)])
        h = hashes(distinct)
        key = rolled(h[word], width, 0x9E3779B97F4A7C15)[self.at] if len(self.at) else np.zeros(0, np.uint64)
        del word
        self.keys, self.first, self.number = np.unique(key, return_index=True, return_inverse=True)
        # which bucket: from bits of a second scramble, so that they add to the 64 that are compared
        bucket = (((self.keys * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        self.keys, self.first = self.keys[order], self.first[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.number = place[self.number]
        self.ends = np.cumsum(np.bincount(bucket, minlength=buckets))

    def later(self, earlier: np.ndarray) -> np.ndarray:
        """Of each window: whether it stands earlier too, in this batch or, by earlier, in another."""
        out = np.ones(len(self.number), bool)
        out[self.first] = False
        return out | earlier[self.number]


def repeated_spans(docs: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Maximal runs of words covered by windows that also start earlier, for every row of docs.

    Words are runs without ASCII white space. Earlier is a smaller id, or an earlier place in the same text; rows that
    share an id come by text, null ids before all. Returns doc_id, text (null as empty, as binary), n_words and spans
    (array of start and end word, end exclusive). Texts of fewer than width words have none. Windows count as equal by
    a 64-bit hash of their words' 64-bit hashes.
    """
    if width < 1:
        raise ValueError("width must be positive")
    spark = docs.sparkSession
    prepare(spark)
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    own = source.schema["doc_id"].dataType
    schema = T.StructType().add("batch", T.LongType()).add("doc_ids", T.ArrayType(own)).add("texts", T.ArrayType(T.BinaryType()))

    def gather(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        return _batches(batches, to_arrow_schema(schema))

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = source.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    table, table_at = written(ordered.mapInArrow(gather, schema), "ordered")
    size = table.select(F.sum(F.aggregate("texts", F.lit(0).cast("long"), lambda a, t: a + F.octet_length(t)))).first()[0] or 0
    buckets = max(1, round(size / 6 / BUCKET))  # about six bytes a word

    def send(batches):
        for b in batches:
            for i in range(len(b)):
                w = Windows(b.column(1)[i].values, width, buckets)
                cuts = np.concatenate([[0], w.ends])
                some = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(np.full(len(some), b.column(0)[i].as_py())), pa.array([w.keys[cuts[k] : cuts[k + 1]].astype("<u8").tobytes() for k in some], pa.binary())], names=["bucket", "batch", "keys"])

    def answer(group: pa.Table) -> pa.Table:
        group = group.sort_by("batch")
        keys = [np.frombuffer(k.as_buffer(), "<u8") for c in group.column("keys").chunks for k in c]
        every = np.concatenate(keys)
        earlier = np.ones(len(every), bool)
        earlier[np.unique(every, return_index=True)[1]] = False
        cuts = np.cumsum([0, *map(len, keys)])
        bits = [np.packbits(earlier[s:e], bitorder="little").tobytes() for s, e in zip(cuts, cuts[1:])]
        return pa.table({"batch": group.column("batch"), "answer": pa.StructArray.from_arrays([group.column("bucket").combine_chunks(), pa.array(bits, pa.binary())], ["bucket", "bits"])})

    sent = table.select("batch", "texts").mapInArrow(send, "bucket int, batch bigint, keys binary")
    bits = sent.groupBy("bucket").applyInArrow(answer, "batch bigint, answer struct<bucket:int,bits:binary>")
    bits, _ = written(bits.groupBy("batch").agg(F.collect_list("answer").alias("answers")), "repeats")

    result = T.StructType().add("doc_id", own).add("text", T.BinaryType()).add("n_words", T.LongType()).add("spans", T.ArrayType(T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType())))

    def mark(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(result)
        for b in batches:
            for i in range(len(b)):
                ids, texts = b.column("doc_ids")[i].values, b.column("texts")[i].values
                w = Windows(texts, width, buckets)
                earlier = np.zeros(len(w.keys), bool)
                cuts = np.concatenate([[0], w.ends])
                for x in b.column("answers")[i].as_py() or ():
                    s, e = cuts[x["bucket"]], cuts[x["bucket"] + 1]
                    earlier[s:e] = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=e - s, bitorder="little")
                total = int(w.words.sum())
                step = np.zeros(total + 1, np.int32)
                at = w.at[w.later(earlier)]
                np.add.at(step, at, 1)
                np.add.at(step, at + width, -1)
                covered = np.cumsum(step[:-1]) > 0
                # runs, cut where a document ends
                doc = np.repeat(np.arange(len(w.words)), w.words)
                same = (covered[1:] == covered[:-1]) & (doc[1:] == doc[:-1])
                cut = np.concatenate([[0], np.flatnonzero(~same) + 1, [total]]) if total else np.zeros(1, np.int64)
                start, end = cut[:-1], cut[1:]
                keep = covered[start] if total else np.zeros(0, bool)
                start, end = start[keep], end[keep]
                base = np.cumsum(w.words) - w.words
                spans = pa.StructArray.from_arrays([pa.array(x - base[doc[start]], pa.int32()) for x in (start, end)], ["start", "end"])
                per = np.bincount(doc[start], minlength=len(w.words)) if len(start) else np.zeros(len(w.words), np.int64)
                yield pa.RecordBatch.from_arrays([ids, texts, pa.array(w.words), ragged(per, spans)], schema=arrow)

    joined = table.join(bits.hint("shuffle_hash"), "batch", "left").select("doc_ids", "texts", "answers")
    return joined.mapInArrow(mark, result)


def kept_words(spans: DataFrame) -> DataFrame:
    """What repeated_spans() leaves of each text: doc_id, n_words, n_removed, kept (its words, joined by one space)."""
    kind = spans.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            kept, removed = [], []
            for text, own in zip(b.column("text").to_pylist(), b.column("spans").to_pylist()):
                words = text.split()
                for s in reversed(own):
                    del words[s["start"] : s["end"]]
                removed.append(sum(s["end"] - s["start"] for s in own))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return spans.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_removed bigint, kept string")
