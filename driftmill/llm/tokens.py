"""Token ids by the tokenizers library, which sees each distinct chunk of text once.

A byte-level BPE splits a text before it merges. Some places where it always splits can be told from a few bytes, and there the
texts of a whole Arrow batch are cut: around a single space or line feed within a text (a space stays with what follows), and between letters,
digits and other characters where both sides are ASCII or Latin-1. Elsewhere a chunk goes on, and is split by the model's own
expression. The library's ids of the chunks, end to end, are its ids of the whole.
"""

from __future__ import annotations

import ctypes
import functools
import json
from array import array
from codecs import charmap_decode
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct chunks, and half as many parts of chunks, whose ids a Python worker remembers at most. Later ones are encoded once a batch.
REMEMBERED = 800_000

#: Bytes of the longest chunk that is remembered.
LONGEST = 256

# Fixed value: how a byte-level BPE of this family splits a text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# what a byte belongs to
UNKNOWN, LETTER, DIGIT, OTHER, WHITE = range(5)


def _kinds() -> np.ndarray:
    out = np.full(256, UNKNOWN, np.uint8)
    for b in range(128):
        c = chr(b)
        if c.isspace():
            out[b] = WHITE
        elif c.isalpha():
            out[b] = LETTER
        elif c.isdigit():
            out[b] = DIGIT
        elif c.isprintable():
            out[b] = OTHER
    return out


_KINDS = _kinds()
# white space of two and three bytes, and whether a byte can begin it or a Latin-1 letter
_WHITE2 = [0x85, 0xA0]
_WHITE3 = [int.from_bytes(chr(c).encode(), "big") for c in (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_LEADS = np.isin(np.arange(256), [0xC2, 0xC3, 0xE1, 0xE2, 0xE3])


def _alphabet() -> str:
    """The character that stands for each byte in the vocabulary: itself where printable, else one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return "".join(chr(b if b in plain else next(others)) for b in range(256))


def cuts(b: np.ndarray, offsets: np.ndarray, whole: np.ndarray | None = None) -> np.ndarray:
    """Where chunks begin in the UTF-8 texts that lie end to end in b, with the end of the last one; offsets are those of the texts.

    whole: which texts must not be cut.
    """
    kind = _KINDS[b]
    at = np.flatnonzero(_LEADS[b])
    lead, second = b[at], b[at + 1]
    letters = at[(lead == 0xC3) & (second != 0x97) & (second != 0xB7)]  # but for the signs of multiplication and division
    kind[letters] = kind[letters + 1] = LETTER
    white = at[(lead == 0xC2) & np.isin(second, _WHITE2)]
    kind[white] = kind[white + 1] = WHITE
    white = at[lead >= 0xE1]
    white = white[np.isin(b[white].astype(np.int32) << 16 | b[white + 1].astype(np.int32) << 8 | b[white + 2], _WHITE3)]
    kind[white] = kind[white + 1] = kind[white + 2] = WHITE

    mark = np.zeros(len(b) + 1, bool)
    known = (kind >= LETTER) & (kind <= OTHER)
    mark[1:-1] = (kind[1:] != kind[:-1]) & known[1:] & known[:-1]
    # an apostrophe and letters can be one part, as in it's
    quote = np.flatnonzero(b[:-1] == 39) + 1
    mark[quote[kind[quote] == LETTER]] = False
    # a single space or line feed; what lies in the next text is no harm, as each text's ends are cuts
    inner = np.flatnonzero((b[1:-1] == 32) | (b[1:-1] == 10)) + 1
    inner = inner[(kind[inner - 1] != WHITE) & (kind[inner + 1] != WHITE)]
    mark[inner] = True
    mark[inner[b[inner] == 10] + 1] = True
    for k in np.flatnonzero(whole) if whole is not None else ():
        mark[offsets[k] : offsets[k + 1]] = False
    mark[offsets] = True
    return np.flatnonzero(mark)


class _Known(dict):
    """The ids of chunks, as bytes of 32-bit numbers."""

    def __init__(self, tokenizer):
        import regex

        self.split, self.merge, self.letters = regex.compile(SPLIT).findall, tokenizer.model.tokenize, _alphabet()
        self.parts: dict[str, bytes] = {}

    def __missing__(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if text[1:].isalpha() and (text[0] == " " or text[0].isalpha()):  # one part
            ids = self.merged(chunk)
        else:
            own = []
            for part in self.split(text):
                ids = self.parts.get(part)
                if ids is None:
                    ids = self.merged(part.encode())
                    if len(self.parts) < REMEMBERED // 2 and len(part) <= LONGEST:
                        self.parts[part] = ids
                own.append(ids)
            ids = b"".join(own)
        if len(self) < REMEMBERED and len(chunk) <= LONGEST:
            self[chunk] = ids
        return ids

    def merged(self, part: bytes) -> bytes:
        return array("I", [t.id for t in self.merge(charmap_decode(part, "strict", self.letters)[0])]).tobytes()


class Encoder:
    """ids() of whole texts, as tokenizers' encode(text, add_special_tokens=False) gives them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        before = json.loads(self.tokenizer.to_str())
        if before["normalizer"] or before["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError("only plain byte-level tokenizers can be applied by chunk")
        # the strings of special tokens are found before anything is split, so texts with one go to the library whole
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = _Known(self.tokenizer)

    def one(self, text: str) -> bytes:
        return self.ids([text])[0].tobytes()

    def ids(self, texts: pa.Array | Sequence[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, end to end, and how many each has; end, if given, after each."""
        rows = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).cast(pa.binary())
        if rows.null_count:
            rows = rows.fill_null(b"")
        offsets = np.frombuffer(rows.buffers()[1], np.int32, len(rows) + 1, 4 * rows.offset) if len(rows) else np.zeros(1, np.int32)
        size = int(offsets[-1] - offsets[0])
        if not size:
            ids, counts = np.zeros(0, "<u4"), np.zeros(len(rows), np.int64)
            return (ids, counts) if end is None else with_end(ids, counts, end)
        b = np.frombuffer(rows.buffers()[2], np.uint8, size, int(offsets[0]))
        offsets = offsets - offsets[0]
        whole = np.zeros(len(rows), bool)
        for x in self.special:
            whole |= pc.match_substring(rows, x).to_numpy(zero_copy_only=False)

        begin = cuts(b, offsets, whole if whole.any() else None).astype(np.int32)
        chunks = pa.Array.from_buffers(pa.binary(), len(begin) - 1, [None, pa.py_buffer(begin), pa.py_buffer(b)]).dictionary_encode()
        find = self.known.__getitem__
        if whole.any():
            special = {t: np.array(self.tokenizer.encode(t.decode(), add_special_tokens=False).ids, "<u4").tobytes() for t in rows.filter(pa.array(whole)).to_pylist()}
            find = lambda chunk: special[chunk] if chunk in special else self.known[chunk]
        own = pa.array(list(map(find, chunks.dictionary.to_numpy(zero_copy_only=False))), pa.large_binary()).take(chunks.indices)
        _, places, ids = own.buffers()
        places = np.frombuffer(places, np.int64, len(own) + 1) // 4
        ids = np.frombuffer(ids, "<u4", int(places[-1]))
        counts = np.diff(places[np.searchsorted(begin, offsets)])
        return (ids, counts) if end is None else with_end(ids, counts, end)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each Python worker, kept between its tasks."""
    return Encoder(path)


def forget() -> None:
    """Give back what this Python worker remembers of tokenizing.

    Spark hands a worker from stage to stage, so that its memory stays with functions that have no use for it: they call this first.
    """
    if encoder.cache_info().currsize:
        encoder.cache_clear()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's alone
        if trim:
            trim(0)


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """end after each text's ids."""
    return np.insert(ids, np.cumsum(counts), np.uint32(end)).astype(np.uint32), counts + 1
