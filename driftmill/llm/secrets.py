"""Secret scans over a trigram inverted index.

From each rule's expression follows a Boolean query over trigrams that every match must contain. The index of a segment
of documents holds, for the trigrams that some rule asks for, the ascending list of rows with it; a rule's query
intersects and unites such lists, and its expression is run on the candidates alone. A rule without mandatory trigrams
scans all rows. Segments are built and searched inside one task, so nothing is shuffled.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import LOWER, prepare


@dataclass(frozen=True)
class Rule:
    """A kind of secret. group and least: the characters that this group of a match has at least."""

    kind: str
    pattern: str
    ignore_case: bool = False
    group: int = 0
    least: int = 1

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))


# The kinds, in the order in which spans of equal start are listed.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", least=18),
    Rule("hex", r"[0-9a-f]+", least=16),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----", least=64),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", least=20),
    Rule("google", r"AIza[A-Za-z0-9_-]+", least=39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=40),
    Rule("stripe", r"sk_live_[A-Za-z0-9]+", least=24),
)
BASE = ("assign", "access", "hex")

#: Strings in an exact set at most; larger sets are cut down to what their trigrams say.
EXACT = 64

#: A query is None (says nothing), a trigram, ("and", queries) or ("or", queries).
Query = None | bytes | tuple


def _and(*parts: Query) -> Query:
    flat = itertools.chain.from_iterable(p[1] if isinstance(p, tuple) and p[0] == "and" else [p] for p in parts if p is not None)
    own = list(dict.fromkeys(flat))
    return None if not own else own[0] if len(own) == 1 else ("and", tuple(own))


def _or(*parts: Query) -> Query:
    own = list(dict.fromkeys(parts))
    return None if None in own or not own else own[0] if len(own) == 1 else ("or", tuple(own))


def _within(strings: set[bytes]) -> Query:
    """What a text must contain if it contains one of the strings."""
    return _or(*(_and(*(s[i : i + 3] for i in range(len(s) - 2))) for s in sorted(strings)))


@dataclass
class _Part:
    """What is known of the texts that a part of an expression matches: all of them (exact), or how they begin and end, and a query."""

    exact: set[bytes] | None
    first: set[bytes]
    last: set[bytes]
    query: Query = None


_ANY = {b""}


def _shortened(strings: set[bytes], end: int) -> set[bytes]:
    cut = {s[:2] if end == 0 else s[-2:] if len(s) > 2 else s for s in strings}
    return cut if len(cut) <= EXACT else _ANY


def _loose(p: _Part) -> _Part:
    """The same without an exact set."""
    if p.exact is None:
        return p
    return _Part(None, _shortened(p.exact, 0), _shortened(p.exact, 1), _and(p.query, _within(p.exact)))


def _joined(a: _Part, b: _Part) -> _Part:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= EXACT:
        own = {x + y for x in a.exact for y in b.exact}
        return _Part(own, own, own)
    # trigrams across the seam, from what a ends with and b begins with
    ends, begins = a.exact if a.exact is not None else a.last, b.exact if b.exact is not None else b.first
    seam = _within({x + y for x in ends for y in begins}) if len(ends) * len(begins) <= EXACT * 4 else None
    first = {x + y for x in a.exact for y in begins} if a.exact is not None and len(a.exact) * len(begins) <= EXACT else a.exact or a.first
    last = {x + y for x in ends for y in b.exact} if b.exact is not None and len(ends) * len(b.exact) <= EXACT else b.exact or b.last
    x, y = _loose(a), _loose(b)
    return _Part(None, _shortened(first, 0), _shortened(last, 1), _and(x.query, y.query, seam))


def _either(parts: list[_Part]) -> _Part:
    if all(p.exact is not None for p in parts) and len(own := set().union(*(p.exact for p in parts))) <= EXACT:
        return _Part(own, own, own)
    parts = [_loose(p) for p in parts]
    return _Part(None, _shortened(set().union(*(p.first for p in parts)), 0), _shortened(set().union(*(p.last for p in parts)), 1), _or(*(p.query for p in parts)))


def _of(tokens, most: int = 16) -> _Part:
    whole = _Part({b""}, _ANY, _ANY)
    for op, arg in tokens:
        part = _Part(None, _ANY, _ANY)
        if op is C.LITERAL:
            s = chr(arg).encode().translate(LOWER)
            part = _Part({s}, {s}, {s})
        elif op is C.IN and arg[0][0] is not C.NEGATE and all(k in (C.LITERAL, C.RANGE) for k, _ in arg):
            points = set(itertools.chain.from_iterable([v] if k is C.LITERAL else range(v[0], min(v[1], v[0] + most + 1) + 1) for k, v in arg))
            if len(points) <= most:
                own = {chr(c).encode().translate(LOWER) for c in points}
                part = _Part(own, own, own)
        elif op is C.SUBPATTERN:
            part = _of(arg[3], most)
        elif op is C.BRANCH:
            part = _either([_of(x, most) for x in arg[1]])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, inner = arg
            one = _of(inner, most)
            if high == 1:
                part = _either([one, _Part({b""}, _ANY, _ANY)])
            elif low:
                part = _Part({b""}, _ANY, _ANY)
                for _ in range(min(low, 3)):
                    part = _joined(part, one)
                part = _loose(part) if low != high or low > 3 else part
                if low != high or low > 3:
                    part = _Part(None, part.first, _shortened(_loose(one).last, 1), part.query)
        elif op is C.AT or op in (C.ASSERT, C.ASSERT_NOT):
            part = _Part({b""}, _ANY, _ANY)
        whole = _joined(whole, part)
    return whole


def trigram_query(pattern: str) -> Query:
    """What the lower-cased UTF-8 bytes of a text must contain if the expression, in either case, matches in it."""
    return _loose(_of(_parser.parse(pattern))).query


def trigrams(query: Query) -> set[bytes]:
    if query is None:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(trigrams, query[1]))


class TrigramIndex:
    """Rows of a segment by trigram, for the trigrams in wanted."""

    def __init__(self, texts: list[bytes], wanted: set[bytes]):
        self.rows = len(texts)
        names = sorted(wanted)
        kind = np.zeros(1 << 24, np.uint8 if len(names) < 256 else np.uint16)
        for k, t in enumerate(names, 1):
            kind[t[0] << 16 | t[1] << 8 | t[2]] = k
        seen = []
        for i, text in enumerate(texts):
            if len(text) > 2 and names:
                b = np.frombuffer(text.translate(LOWER), np.uint8).astype(np.int32)
                found = np.flatnonzero(np.bincount(kind[b[:-2] << 16 | b[1:-1] << 8 | b[2:]], minlength=len(names) + 1)[1:])
                seen.append(found * self.rows + i)
        keys = np.sort(np.concatenate(seen)) if seen else np.zeros(0, np.int64)
        cuts = np.searchsorted(keys, np.arange(len(names) + 1) * self.rows)
        self.lists = {t: keys[cuts[k] : cuts[k + 1]] - k * self.rows for k, t in enumerate(names)}

    def rows_for(self, query: Query) -> np.ndarray:
        if query is None:
            return np.arange(self.rows)
        if isinstance(query, bytes):
            return self.lists[query]
        own = [self.rows_for(q) for q in query[1]]
        if query[0] == "or":
            return np.unique(np.concatenate(own))
        own.sort(key=len)
        out = own[0]
        for more in own[1:]:
            out = np.intersect1d(out, more, assume_unique=True)
        return out


class Scanner:
    """The rules with their queries. find() gives each text's spans: (start, end, number of the rule), by start, then rule."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = [(r, r.compiled(), trigram_query(r.pattern)) for r in rules]
        self.wanted = set().union(*(trigrams(q) for _, _, q in self.rules)) if rules else set()

    def find(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        index = TrigramIndex(texts, self.wanted)
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        decoded: dict[int, str] = {}
        for k, (rule, pattern, query) in enumerate(self.rules):
            for i in index.rows_for(query).tolist():
                if query is None and not _long_run(texts[i], pattern, rule):
                    continue
                if i not in decoded:
                    decoded[i] = texts[i].decode("utf-8", "replace")
                out[i] += [(*m.span(), k) for m in pattern.finditer(decoded[i]) if len(m[rule.group]) >= rule.least]
        for own in out:
            own.sort(key=lambda s: (s[0], s[2]))
        return out


_RUNS: dict[str, bytes] = {}


def _long_run(text: bytes, pattern: re.Pattern, rule: Rule) -> bool:
    """For an expression that is one repeated class of ASCII characters: whether a run is long enough; else true."""
    if rule.pattern not in _RUNS:
        parsed = list(_parser.parse(rule.pattern))
        plain = len(parsed) == 1 and parsed[0][0] is C.MAX_REPEAT and parsed[0][1][0] == 1 and parsed[0][1][1] is C.MAXREPEAT and len(parsed[0][1][2]) == 1 and parsed[0][1][2][0][0] is C.IN and all(k in (C.LITERAL, C.RANGE) for k, _ in parsed[0][1][2][0][1]) and not rule.ignore_case
        _RUNS[rule.pattern] = bytes(1 if c < 128 and re.fullmatch(rule.pattern, chr(c)) else 0 for c in range(256)) if plain else b""
    table = _RUNS[rule.pattern]
    return not table or b"\1" * rule.least in text.translate(table)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """docs with one more column, secrets: array of struct kind, start, end (code points, end exclusive), by start, then rule.

    Matches of one kind don't overlap; of different kinds they may. Null and empty texts have an empty array; very long
    texts are read whole; repeated rows have the same spans each; an empty table gives no rows. A column
    of docs that is itself named secrets is replaced.
    """
    prepare(docs.sparkSession)
    out = docs.drop("secrets")
    names = [r.kind for r in rules]
    keys = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def scan(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = Scanner(rules)
        for t in texts:
            found = scanner.find([x or b"" for x in t.to_pylist()])
            yield pa.array([[{"kind": names[k], "start": s, "end": e} for s, e, k in own] for own in found], pa.list_(keys))

    udf = arrow_udf(scan, "array<struct<kind:string,start:int,end:int>>")
    return out.withColumn("secrets", udf(F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs, with its columns, with every secret in the text replaced by mark; overlapping spans are one.

    Texts without secrets, null ones too, stay as they are. No column is lost, whatever its name.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{text_col}`").alias("text"))
    found = find_secrets(rows, rules, "text")

    # the end so far and the text so far; spans come by start
    step = """aggregate(secrets, named_struct('at', 0, 'out', ''), (a, s) -> if(s.end <= a.at, a,
        named_struct('at', s.end, 'out', if(s.start < a.at, a.out, concat(a.out, substring(text, a.at + 1, s.start - a.at), '{m}')))),
        a -> concat(a.out, substring(text, a.at + 1)))""".format(m=mark)
    clean = F.when(F.size("secrets") > 0, F.expr(step)).otherwise(F.col("text"))
    return found.select(*(clean.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns))
