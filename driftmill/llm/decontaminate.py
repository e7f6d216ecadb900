"""Benchmark decontamination by a distributed positional inverted index.

The corpus is cut into segments of whole documents. Each segment is one row of the index table: its terms, their
counts, and for each term the ascending list of its positions. A phrase is found in a segment by shifting the lists of
its terms by their places in the phrase and intersecting them, from the term that is rarest in the whole corpus; all
phrases go through these steps together, as columns of candidates that get fewer with each term. As a segment is one row, a search moves no postings, and a lost executor costs the segments it was working on.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import codes, prepare, ragged, written

#: Words in a segment at most, but for a longer document, which is a segment of its own.
SEGMENT_WORDS = 1_000_000
#: Words of test items that are looked for in one pass; more items take more passes.
BLOCK_WORDS = 2_000_000

#: Windows and candidate positions that are held at once in a segment.
WINDOWS, CANDIDATES = 50_000, 2_000_000

#: A-Z become a-z; digits, a-z and all bytes of non-ASCII characters stay; all else parts words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


def _segments(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    ids: list[pa.Array] = []
    texts: list[pa.Array] = []
    size = number = 0

    def segment() -> pa.RecordBatch:
        from pyspark import TaskContext

        own = pa.concat_arrays(ids)
        word, terms, counts = codes(pa.concat_arrays(texts), WORD_BYTES)
        # one unused position after each document keeps phrases from crossing into the next
        at = np.arange(len(word), dtype=np.int64) + np.repeat(np.arange(len(counts)), counts)
        order = np.argsort(word, kind="stable")
        return pa.RecordBatch.from_arrays(
            [
                pa.array([(TaskContext.get().partitionId() << 33) + number]),
                ragged(np.array([len(own)]), own),
                ragged(np.array([len(counts)]), pa.array(counts, pa.int32())),
                ragged(np.array([len(terms)]), pa.array(terms, pa.binary())),
                ragged(np.array([len(terms)]), pa.array(np.bincount(word, minlength=len(terms)), pa.int32())),
                pa.array([at[order].astype("<i4").tobytes()], pa.binary()),
            ],
            schema=schema,
        )

    for batch in batches:
        lengths = np.diff(np.frombuffer(batch.column(1).buffers()[1], np.int32, len(batch) + 1, batch.column(1).offset * 4))
        begin = 0
        for i, n in enumerate(lengths):
            # a word and its gap take two bytes at least, so bytes bound words; six is about the usual
            if size and size + n > 6 * SEGMENT_WORDS:
                if i > begin:
                    ids.append(batch.column(0).slice(begin, i - begin))
                    texts.append(batch.column(1).slice(begin, i - begin))
                yield segment()
                ids, texts, size, begin, number = [], [], 0, i, number + 1
            size += int(n)
        if len(batch) > begin:
            ids.append(batch.column(0).slice(begin))
            texts.append(batch.column(1).slice(begin))
    if ids:
        yield segment()


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings of every word of every document: one row for each segment.

    Columns: segment (its number), doc_ids and doc_words (its documents, in order), terms and counts, positions (little-endian 32-bit, the
    lists of all terms end to end). A null text is a document without words; repeated ids stay separate documents.
    """
    prepare(docs.sparkSession)
    own = docs.schema[id_col].dataType
    schema = T.StructType().add("segment", T.LongType()).add("doc_ids", T.ArrayType(own)).add("doc_words", T.ArrayType(T.IntegerType())).add("terms", T.ArrayType(T.BinaryType())).add("counts", T.ArrayType(T.IntegerType())).add("positions", T.BinaryType())

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        return _segments(batches, to_arrow_schema(schema))

    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    return docs.select(F.col(id_col), text.alias("text")).mapInArrow(run, schema)


class Postings:
    """A segment's lists of positions, for the terms that a search asks for."""

    def __init__(self, terms: list[bytes], counts: np.ndarray, positions: np.ndarray, wanted: dict[bytes, int]):
        self.ends = np.cumsum(counts)
        self.counts, self.positions = counts, positions
        self.at: np.ndarray | None = None
        self.slot = np.full(len(wanted), -1, np.int32)
        for k, term in enumerate(terms):
            if (i := wanted.get(term)) is not None:
                self.slot[i] = k

    def of(self, term: int) -> np.ndarray:
        k = self.slot[term]
        return self.positions[self.ends[k] - self.counts[k] : self.ends[k]]

    def phrases(self, windows: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of windows (of equal length) whose terms stand one after the other, and where; order ranks each row's terms."""
        if self.at is None:  # the lists' other side: which term stands at a position
            self.at = np.full(int(self.positions.max(initial=-1)) + 1, -1, np.int32)
            self.at[self.positions] = np.repeat(np.arange(len(self.counts), dtype=np.int32), self.counts)
        rows, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for begin in range(0, len(windows), WINDOWS):
            own = self.slot[windows[begin : begin + WINDOWS]]
            alive = np.flatnonzero((own >= 0).all(1))
            own, rank = own[alive], order[begin + alive]
            rarest = own[np.arange(len(own)), rank[:, 0]]
            n = self.counts[rarest]
            part = np.cumsum(n) // CANDIDATES
            for k in np.unique(part):
                of = np.flatnonzero(part == k)
                # the shifted lists of each window's rarest term, end to end
                row = np.repeat(of, n[of])
                first = self.ends[rarest[row]] - n[row]
                place = self.positions[first + np.arange(len(row)) - np.repeat(np.cumsum(n[of]) - n[of], n[of])].astype(np.int64) - rank[row, 0]
                for j in range(1, own.shape[1]):
                    step = rank[row, j]
                    at = place + step
                    inside = (at >= 0) & (at < len(self.at))
                    inside &= self.at[np.where(inside, at, 0)] == own[row, step]
                    row, place = row[inside], place[inside]
                rows.append(begin + alive[row])
                places.append(place)
        return np.concatenate(rows), np.concatenate(places)

    def near(self, terms: np.ndarray, order: np.ndarray, slop: int) -> np.ndarray:
        """First and last positions (two columns) where the terms stand in this order with at most slop words between them."""
        first = last = self.of(terms[order[0]])
        alive = np.ones(len(first), bool)
        for j in range(order[0] + 1, len(terms)):
            own = self.of(terms[j])
            k = np.searchsorted(own, last, "right")
            alive &= k < len(own)
            last = own[np.minimum(k, len(own) - 1)]
        for j in range(order[0] - 1, -1, -1):
            own = self.of(terms[j])
            k = np.searchsorted(own, first) - 1
            alive &= k >= 0
            first = own[np.maximum(k, 0)]
        alive &= last - first + 1 <= len(terms) + slop
        return np.stack([first[alive], last[alive]], 1)


def _union(spans: np.ndarray) -> np.ndarray:
    """Half-open intervals, merged where they meet."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    return np.stack([spans[new, 0], reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(spans) - 1]])]], 1)


def search(index: DataFrame, items: DataFrame, width: int = 10, slop: int = 0, item_col: str = "item_id", text_col: str = "text", counts: bool = True) -> DataFrame:
    """Occurrences of the items' windows (width consecutive words; a shorter item is one window) in every document.

    Returns doc_id, n_words, spans (array of start and end word, end exclusive, merged and ascending) and items (ids of
    the items with occurring windows, as sorted distinct strings) for every document of the index. slop above 0 also
    takes windows whose words stand in order with up to slop other words between them. Items without words match
    nothing; items that share an id are one item; a null id counts as the string "null".

    Items are looked for in blocks of at most BLOCK_WORDS words, so what is sent to the executors is bounded; with more
    than one block the documents' spans are merged by segment and place afterwards.
    """
    own = index.schema["doc_ids"].dataType.elementType
    schema = T.StructType().add("segment", T.LongType()).add("place", T.IntegerType()).add("doc_id", own).add("n_words", T.LongType()).add("spans", T.ArrayType(T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType()))).add("items", T.ArrayType(T.StringType()))
    found: list[DataFrame] = []
    vocab: dict[bytes, int] = {}
    block: list[tuple[str, np.ndarray]] = []
    size = 0
    for row in items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")), text_col).toLocalIterator():
        own_words = words(row[1])
        if size and size + len(own_words) > BLOCK_WORDS:
            found.append(_searched(index, vocab, block, width, slop, schema, counts))
            vocab, block, size = {}, [], 0
        if own_words:
            block.append((row[0], np.array([vocab.setdefault(w, len(vocab)) for w in own_words], np.int32)))
        size += len(own_words)
    found.append(_searched(index, vocab, block, width, slop, schema, counts))
    if len(found) == 1:
        return found[0].drop("segment", "place")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    every = every.groupBy("segment", "place").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    # a fold over ascending intervals: grow the last one or begin another
    merged = """aggregate(spans, cast(array() as array<struct<start:int,end:int>>), (a, s) ->
        if(size(a) > 0 and s.start <= a[size(a) - 1].end,
           concat(slice(a, 1, size(a) - 1), array(named_struct('start', a[size(a) - 1].start, 'end', greatest(a[size(a) - 1].end, s.end)))),
           concat(a, array(s))))"""
    return every.select("doc_id", "n_words", F.expr(merged).alias("spans"), "items")


def _searched(index: DataFrame, vocab: dict[bytes, int], block: list[tuple[str, np.ndarray]], width: int, slop: int, schema: T.StructType, counts: bool) -> DataFrame:
    spark = index.sparkSession
    seen = np.zeros(len(vocab), np.int64)
    if counts and vocab:
        # BLOCK_WORDS rows at most; from Arrow, as rows would start Python workers of another kind on the executors
        wanted = F.broadcast(spark.createDataFrame(pa.table({"term": pa.array(list(vocab), pa.binary())})))
        each = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.counts").cast("long").alias("n"))
        for row in each.join(wanted, "term").groupBy("term").agg(F.sum("n").alias("n")).collect():
            seen[vocab[bytes(row.term)]] = row.n
    # windows by length, the items that they are of, and their terms' places from the rarest on
    names = sorted({name for name, _ in block})
    number = {name: k for k, name in enumerate(names)}
    asked = []
    for n in sorted({min(len(own), width) for _, own in block}):
        cut = [(number[name], np.lib.stride_tricks.sliding_window_view(own, n)) for name, own in block if min(len(own), width) == n]
        of, windows = np.repeat([k for k, _ in cut], [len(w) for _, w in cut]), np.concatenate([w for _, w in cut])
        if counts:  # a window with a word that the corpus lacks can't occur
            there = seen[windows].all(1)
            of, windows = of[there], windows[there]
        asked.append((of.astype(np.int32), windows, np.argsort(seen[windows], axis=1, kind="stable").astype(np.int16)))
    sent = spark.sparkContext.broadcast((vocab, names, asked))

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        vocab, names, asked = sent.value
        for batch in batches:
            for i in range(len(batch)):
                key, ids, n_words, terms, n, positions = (c.slice(i, 1) for c in batch.columns)
                n_words = n_words.flatten().to_numpy()
                posted = Postings(terms.flatten().to_pylist(), n.flatten().to_numpy(), np.frombuffer(positions[0].as_buffer(), "<i4"), vocab)
                begins = np.cumsum(n_words + 1) - n_words - 1
                hit: list[np.ndarray] = []
                items_of: list[np.ndarray] = []
                for of, windows, order in asked:
                    if slop:
                        at, rows = [np.zeros((0, 2), np.int64)], [np.zeros(0, np.int64)]
                        for k in np.flatnonzero((posted.slot[windows] >= 0).all(1)):
                            near = posted.near(windows[k], order[k], slop)
                            at.append(near[np.searchsorted(begins, near[:, 0], "right") == np.searchsorted(begins, near[:, 1], "right")])
                            rows.append(np.full(len(at[-1]), k))
                        at, rows = np.concatenate(at), np.concatenate(rows)
                    else:
                        rows, at = posted.phrases(windows, order)
                        at = np.stack([at, at + windows.shape[1] - 1], 1)
                    hit.append(at)
                    items_of.append(np.stack([np.searchsorted(begins, at[:, 0], "right") - 1, of[rows]], 1))
                within: dict[int, list] = {}
                if items_of:
                    for d, k in np.unique(np.concatenate(items_of), axis=0).tolist():
                        within.setdefault(d, []).append(names[k])
                spans = np.zeros((0, 2), np.int64)
                if sum(map(len, hit)):
                    spans = np.concatenate(hit).astype(np.int64)
                    spans[:, 1] += 1
                    spans = _union(spans)
                doc = np.searchsorted(begins, spans[:, 0], "right") - 1
                per = np.bincount(doc, minlength=len(n_words)) if len(doc) else np.zeros(len(n_words), np.int64)
                spans -= begins[doc][:, None]
                pairs = pa.StructArray.from_arrays([pa.array(spans[:, k], pa.int32()) for k in (0, 1)], ["start", "end"])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n_words), key[0].as_py()), pa.int64()), pa.array(np.arange(len(n_words)), pa.int32()), ids.flatten(), pa.array(n_words, pa.int64()), ragged(per, pairs), pa.array([sorted(within.get(d, ())) for d in range(len(n_words))], pa.list_(pa.string()))], schema=arrow)

    return index.select("segment", "doc_ids", "doc_words", "terms", "counts", "positions").mapInArrow(run, schema)


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 10, slop: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of docs, stored, and what search() finds of the items in it: one row for each row of docs.

    Empty tables give no rows, or no hits; other columns of either table are ignored.
    """
    index, _ = written(build_index(docs, id_col, text_col), "postings")
    return search(index, items, width, slop)


def without_contaminated(docs: DataFrame, items: DataFrame, width: int = 10, slop: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, in which no item's window occurs. Of rows that share an id, one hit takes all; rows with a null id stay."""
    hit = decontaminate(docs, items, width, slop, id_col, text_col).where(F.size("spans") > 0).select(F.col("doc_id").alias("__hit")).distinct()
    return docs.join(hit, docs[id_col] == F.col("__hit"), "left_anti")
