"""Packing: vector bins filled by the dot-product heuristic.

A bin has room for tokens, segments (pieces) and loss-bearing tokens. Whole windows' worth of a long document is
cut off first; the remainders wait in a pool. The next piece of a bin is the one in the pool whose needs,
as shares of a bin, have the largest dot product with the room that is left, weighted by how scarce each is in the pool; what
fits nowhere whole is cut to fill the room. How much of a piece bears loss is known token by token, so that a cut example
counts in each bin with what it brings there. Each Spark partition packs its own documents, so nothing is shuffled and at
most one bin a partition is left part empty for want of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare
from .tokens import encoder

#: Remainders that wait to be placed, at least; so many more as a bin's tokens need.
POOL = 512


class Packer:
    """Places items one by one; done() gives (item, start, length, bin, offset) of the bins that are full.

    tokens, segments, loss: a bin's limits. loss None: as many as tokens, so that this limit never binds.
    """

    def __init__(self, tokens: int, segments: int, loss: int | None = None):
        loss = tokens if loss is None else loss
        if min(tokens, segments, loss) < 1:
            raise ValueError("limits must be positive")
        self.limits = np.array([tokens, segments, loss], np.float64)
        self.tokens, self.segments, self.loss = tokens, segments, loss
        self.items: list[tuple] = []  # item, start, length, loss, loss-bearing tokens before each token of the item
        self.held = 0  # tokens of these
        self.needs = np.zeros((2 * POOL, 3))
        self.bin = 0
        self.full: list[tuple] = []

    def _take(self, k: int) -> tuple:
        item = self.items[k]
        self.held -= item[2]
        last = self.items.pop()
        if k < len(self.items):
            self.items[k] = last
            self.needs[k] = self.needs[len(self.items)]
        return item

    def _put(self, item: tuple) -> None:
        if len(self.items) == len(self.needs):
            self.needs = np.concatenate([self.needs, np.zeros_like(self.needs)])
        self.held += item[2]
        self.needs[len(self.items)] = np.array([item[2], 1, item[3]]) / self.limits
        self.items.append(item)

    @staticmethod
    def _lost(so_far: np.ndarray | None, start: int, length: int) -> int:
        return length if so_far is None else int(so_far[start + length] - so_far[start])

    def _cut(self, item: tuple, length: int) -> tuple[tuple, tuple]:
        """The first length tokens, and the rest."""
        name, start, n, loss, so_far = item
        first = self._lost(so_far, start, length)
        return (name, start, length, first, so_far), (name, start + length, n - length, loss - first, so_far)

    def _most(self, item: tuple, tokens: int, loss: int) -> int:
        """The longest beginning of an item of so many tokens and loss-bearing ones at most."""
        _, start, n, _, so_far = item
        if so_far is None:
            return min(n, tokens, loss)
        return min(n, tokens, int(np.searchsorted(so_far, so_far[start] + loss, "right")) - 1 - start)

    def add(self, item, length: int, bears: np.ndarray | None = None) -> None:
        """bears: which of the item's tokens bear loss; None: all."""
        so_far = None if bears is None else np.concatenate([[0], np.cumsum(bears)])
        rest = (item, 0, length, self._lost(so_far, 0, length), so_far)
        while rest[2]:
            # a beginning that no bin has room for more than once is a piece of its own
            piece, rest = self._cut(rest, self._most(rest, self.tokens, self.loss))
            if piece[2] == self.tokens:
                self.full.append((*piece[:3], self.bin, 0))
                self.bin += 1
            else:
                self._put(piece)
                while len(self.items) >= POOL and self.held >= self.tokens:
                    self._fill()

    def _fill(self) -> None:
        room = np.ones(3)
        at = 0
        weight = self.needs[: len(self.items)].sum(0)
        while self.items and at < self.tokens and room[1] > 1e-9:
            own = self.needs[: len(self.items)]
            fits = (own <= room + 1e-9).all(1)
            score = own @ (room * weight)
            if fits.any():
                piece = self._take(int(np.argmax(np.where(fits, score, -1))))
            else:
                left = round(room[2] * self.loss)
                k = int(np.argmax(score))
                length = self._most(self.items[k], self.tokens - at, left)
                if length < 1:  # no room for loss: the longest beginning without it, if any item has one
                    most = [self._most(i, self.tokens - at, left) for i in self.items]
                    k = int(np.argmax(most))
                    length = most[k]
                    if length < 1:
                        break
                piece, rest = self._cut(self._take(k), length)
                if rest[2]:
                    self._put(rest)
            self.full.append((*piece[:3], self.bin, at))
            at += piece[2]
            room = room - np.array([piece[2], 1, piece[3]]) / self.limits
        self.bin += 1

    def finish(self) -> None:
        while self.items:
            self._fill()

    def done(self) -> list[tuple]:
        out, self.full = self.full, []
        return out


def pack(docs: DataFrame, tokenizer: str, segments: int, end: int = 1, tokens: int = 2048, loss: int | None = None, id_col: str = "doc_id", text_col: str = "text", prompt_col: str | None = None) -> DataFrame:
    """Every piece of every document: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset, loss.

    A document is its text's ids (null as empty), then end. All its tokens bear loss, but for those of the text in
    prompt_col, if given, which comes first and bears none. Sequences hold tokens ids, segments pieces and loss
    loss-bearing ids at most; loss None sets no such limit. Short texts need many segments: a sequence of tokens / segments
    ids a piece is the shortest that can be full. sequence_id is unique, not gapless. Rows that share an id are packed
    one by one; a text longer than a sequence is cut into several, however long it is; an empty table gives no rows.
    Other columns are ignored.
    """
    prepare(docs.sparkSession)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    source = docs.select(F.col(id_col).alias("doc_id"), text(text_col).alias("text"), (text(prompt_col) if prompt_col else F.lit("")).alias("prompt"))
    schema = T.StructType().add("doc_id", source.schema["doc_id"].dataType).add("start", T.LongType()).add("length", T.LongType()).add("ids", T.BinaryType()).add("doc_tokens", T.LongType()).add("sequence_id", T.LongType()).add("offset", T.LongType()).add("loss", T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        first = TaskContext.get().partitionId() << 33
        own, packer = encoder(tokenizer), Packer(tokens, segments, loss)
        waiting: dict[int, list] = {}  # number: id, ids, tokens not yet given out, tokens of the prompt
        number = 0

        def given() -> pa.RecordBatch:
            pieces = packer.done()
            rows = []
            for item, start, length, bin_, offset in pieces:
                held = waiting[item]
                rows.append((held[0], start, length, held[1][4 * start : 4 * (start + length)], len(held[1]) // 4, first + bin_, offset, start + length - max(start, min(held[3], start + length))))
                held[2] -= length
                if not held[2]:
                    del waiting[item]
            columns = list(zip(*rows)) or [[]] * len(arrow)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for b in batches:
            ids, counts = own.ids(b.column(1), end)
            cuts = np.cumsum(counts)
            before, lengths = own.ids(b.column(2))
            prompts = [x if len(x) else None for x in np.split(before, np.cumsum(lengths)[:-1])]
            for name, cut, n, prompt in zip(b.column(0).to_pylist(), cuts.tolist(), counts.tolist(), prompts):
                text_ids = ids[cut - n : cut]
                whole = text_ids if prompt is None else np.concatenate([prompt, text_ids])
                waiting[number] = [name, whole.astype("<u4").tobytes(), len(whole), len(whole) - n]
                packer.add(number, len(whole), None if prompt is None else np.arange(len(whole)) >= len(prompt))
                number += 1
            yield given()
        packer.finish()
        yield given()

    return source.mapInArrow(run, schema)
