"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every text. Texts are good or bad in one of a few ways (KINDS), and
expectation-maximisation over the counts of vote patterns estimates how accurate each labeller is on texts of each kind: a
labeller of symbols need not see repetition. Nothing but smoothing bounds an accuracy. The probabilities of good
that follow for each pattern train a logistic scorer on hashed words, which then scores every text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import LOWER, codes, discard, mixed, prepare, written

#: Hash buckets of words; texts that the scorer is trained on at most, the ones of smallest hash, and their distinct buckets in all (a text has
#: BUCKETS + 3 at most; where texts are long, fewer are taken, each whole).
BUCKETS, TRAIN_ROWS, TRAIN_FEATURES = 1 << 16, 8000, 8_000_000


#: Words of a stretch whose distinct words are counted, so that long texts are judged like short ones.
STRETCH = 200

#: Ways of being bad, by the labellers that see them for certain; the others' accuracies on them start at a guess.
KINDS = {"noise": ("symbols", "word_length"), "tables": ("symbols", "bare"), "repetition": ("variety", "lines"), "shouting": ("shouting", "sentences")}


#: The labellers, in the order of their votes.
LABELLERS = ("symbols", "bare", "length", "word_length", "variety", "lines", "sentences", "shouting", "digits")


SYMBOLS, BARE = b"#*$%&|<>", b"#*$%&|<>~=_+-"
UPPER, DIGITS, ENDS, TAIL_BYTES = bytes(range(65, 91)), b"0123456789", b".!?", bytes(range(128, 192))


def votes(values: pa.Array) -> np.ndarray:
    """Votes on UTF-8 texts, a row a text and a column a labeller: 1 good, 0 bad, -1 nothing. Lengths are code points."""
    word, distinct, n = codes(values)
    rows = len(n)
    texts = values.to_pylist()
    length = lambda b: len(b.translate(None, TAIL_BYTES))
    without = lambda b, some: len(b) - len(b.translate(None, some))
    chars, symbols, ends, upper, digits, again = (np.zeros(rows) for _ in range(6))
    for i, t in enumerate(texts):
        if t:
            lines = [x for x in t.split(b"\n") if x.strip(b" ")]
            chars[i], symbols[i], ends[i], upper[i], digits[i] = length(t), without(t, SYMBOLS), without(t, ENDS), without(t, UPPER), without(t, DIGITS)
            again[i] = 1 - len(set(lines)) / max(len(lines), 1)
        else:
            again[i] = 1.0
    doc = np.repeat(np.arange(rows), n)
    sizes = np.array([length(w) for w in distinct] or [0])
    empty = np.array([not w.translate(None, BARE) for w in distinct] or [False])
    some = np.maximum(n, 1)
    mean = np.bincount(doc, sizes[word], minlength=rows) / some
    bare = np.bincount(doc, empty[word], minlength=rows) / some
    # distinct words of each stretch
    stretches = -(-n // STRETCH)
    place = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
    stretch = np.repeat(np.cumsum(stretches) - stretches, n) + place // STRETCH
    first = np.unique(stretch * max(len(distinct), 1) + word) // max(len(distinct), 1)
    variety = np.bincount(np.repeat(np.arange(rows), stretches)[first], minlength=rows) / some
    symbols, ends, upper, digits = symbols / some, ends / some, upper / np.maximum(chars, 1), digits / np.maximum(chars, 1)

    def vote(bad: np.ndarray, good: np.ndarray | bool) -> np.ndarray:
        return np.where(bad, 0, np.where(good, 1, -1))

    own = {
        "symbols": vote(symbols > 0.1, symbols < 0.01),
        "bare": vote(bare > 0.1, bare < 0.02),
        "length": vote(n < 20, n >= 50),
        "word_length": vote((mean < 3.5) | (mean > 7.0), (mean >= 4.3) & (mean <= 6.0)),
        "variety": vote(variety < 0.4, variety > 0.55),
        "lines": vote(again > 0.4, again < 0.05),
        "sentences": vote((ends > 0.4) | (ends < 0.004) & (n >= 50), (ends >= 0.02) & (ends <= 0.25)),
        "shouting": vote(upper > 0.2, upper < 0.05),
        "digits": vote(digits > 0.25, False),
    }
    return np.stack([own[k] for k in LABELLERS], 1)


class VoteModel:
    """Shares of good texts and of the kinds of bad ones, and each labeller's accuracy on either, by expectation-maximisation.

    patterns: distinct vote vectors; counts: the texts with each; names: the labellers. Votes are independent given the
    kind. right[0] is the chance that a vote on a good text says good, right[k] that one on a text of the k-th kind says
    bad, each smoothed by one vote for and one against. Of several starts the one of greatest likelihood counts.
    """

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, names: list[str], kinds: dict[str, tuple[str, ...]] = KINDS, rounds: int = 500):
        found = []
        for sure in (0.7, 0.9):
            for other in (0.1, 0.3, 0.5):
                for share in (0.02, 0.1):
                    right = np.stack([np.full(len(names), 0.95), *([sure if n in own else other for n in names] for own in kinds.values())])
                    prior = np.array([1 - share * len(kinds), *(share for _ in kinds)])
                    found.append(self._fitted(patterns, counts, prior, right, rounds))
        self.likelihood, self.prior, self.right = max(found, key=lambda x: x[0])

    @staticmethod
    def _logs(patterns: np.ndarray, prior: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Log chance of each class and pattern."""
        good, bad = patterns == 1, patterns == 0
        says_good = np.concatenate([right[:1], 1 - right[1:]])
        return np.log(prior) + good @ np.log(says_good).T + bad @ np.log(1 - says_good).T

    def _fitted(self, patterns, counts, prior, right, rounds) -> tuple[float, np.ndarray, np.ndarray]:
        good, bad = patterns == 1, patterns == 0
        before = -np.inf
        for _ in range(rounds):
            logs = self._logs(patterns, prior, right)
            top = logs.max(1, keepdims=True, initial=-np.inf)
            total = top[:, 0] + np.log(np.exp(logs - top).sum(1))
            likelihood = float(counts @ total)
            w = np.exp(logs - total[:, None]) * counts[:, None]
            prior = (w.sum(0) + 1) / (w.sum() + len(prior))
            hit = np.concatenate([(w[:, :1].T @ good), w[:, 1:].T @ bad])
            cast = w.T @ (good | bad)
            right = (hit + 1) / (cast + 2)
            if likelihood - before < 1e-7 * max(counts.sum(), 1):
                break
            before = likelihood
        return likelihood, prior, right

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """The chance of good."""
        logs = self._logs(patterns, self.prior, self.right)
        w = np.exp(logs - logs.max(1, keepdims=True, initial=-np.inf))
        return w[:, 0] / w.sum(1)


def _bins(name: str, x: np.ndarray, most: int) -> np.ndarray:
    table = np.array([zlib.crc32(f"\1{name}{k}".encode()) % BUCKETS for k in range(most + 1)], np.int64)
    return table[np.clip(x, 0, most).astype(np.int64)]


def features(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every text: its distinct hash buckets and their weights, end to end, and how many.

    A word counts by itself and by its shape (its ASCII symbols and digits, and its length), to unit length over the text.
    Beside these stand, with weight 1, the twentieth of distinct words and of distinct three-word windows, and the mean
    length of words by thirds.
    """
    word, distinct, n = codes(values, LOWER)
    shapes = bytes(b if b < 128 and not 97 <= b <= 122 else 97 for b in range(256))
    own = np.fromiter((zlib.crc32(w) % BUCKETS for w in distinct), np.int64, len(distinct))
    shape = np.fromiter((zlib.crc32(b"\0" + w.translate(shapes)) % BUCKETS for w in distinct), np.int64, len(distinct))
    size = np.fromiter(map(len, distinct), np.int64, len(distinct))
    rows = len(n)
    doc = np.repeat(np.arange(rows), n)
    keys, counts = np.unique(np.concatenate([doc * BUCKETS + own[word], doc * BUCKETS + shape[word]]), return_counts=True)
    row, weight = keys // BUCKETS, np.sqrt(counts)
    norm = np.sqrt(np.bincount(row, weight**2, minlength=rows))

    def variety(run: np.ndarray, of: np.ndarray) -> np.ndarray:
        one = np.unique(of.astype(np.uint64) << np.uint64(40) ^ mixed(run) >> np.uint64(24))
        return np.bincount((one >> np.uint64(40)).astype(np.int64), minlength=rows) / np.maximum(np.bincount(of, minlength=rows), 1)

    h = mixed(own.astype(np.uint64) << np.uint64(20) ^ size.astype(np.uint64))[word] if len(word) else np.zeros(0, np.uint64)
    inside = doc[2:] == doc[:-2]
    three = (h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(5) + h[2:] * np.uint64(7))[inside]
    mean = np.bincount(doc, size[word], minlength=rows) / np.maximum(n, 1) if len(word) else np.zeros(rows)
    extra = np.stack([_bins("words", variety(h, doc) * 20, 20), _bins("windows", variety(three, doc[2:][inside]) * 20, 20), _bins("length", mean * 3, 40)], 1)
    # the extra ones after each text's own
    per = np.bincount(row, minlength=rows)
    ends = np.cumsum(per)
    at = np.insert(keys % BUCKETS, np.repeat(ends, 3), extra.ravel())
    x = np.insert(weight / norm[row], np.repeat(ends, 3), 1.0)
    return at, x, per + 3


def train(buckets: list[np.ndarray], weights: list[np.ndarray], target: np.ndarray, rounds: int = 150) -> np.ndarray:
    """Logistic weights (the last is the bias) for soft targets, by full gradient steps with AdaGrad."""
    w, seen = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-8)
    n = len(buckets)
    if not n:
        return w
    row = np.repeat(np.arange(n), [len(b) for b in buckets])
    at, x = np.concatenate(buckets).astype(np.int64), np.concatenate(weights)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(np.bincount(row, w[at] * x, minlength=n) + w[-1])))
        gap = (p - target) / n
        step = np.append(np.bincount(at, gap[row] * x, minlength=BUCKETS), gap.sum()) + 1e-6 * w
        seen += step**2
        w -= 0.5 * step / np.sqrt(seen)
    return w


def classify(docs: DataFrame, threshold: float = 0.5, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of docs: doc_id, posterior (of its votes), score (of the trained scorer) and kept (score >= threshold).

    The vote model sees the patterns of all rows; the scorer is trained on train_rows rows at most (and TRAIN_FEATURES
    buckets of them), those of the smallest hash of their text, so that repeated rows don't depend on where they are. It sees
    all buckets of a text that it is trained on. Null texts are empty: no words, judged by
    their votes and the bias. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = list(LABELLERS)
    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = votes(b.column("text"))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(own[:, k], pa.int32()) for k in range(len(names)))], names=[*b.schema.names, *names])

    # the texts are kept with their votes, so that no text is judged twice
    read = source.select("doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("h"))
    kind = read.schema["doc_id"].dataType.simpleString()
    held, _ = written(read.mapInArrow(voted, f"doc_id {kind}, text binary, h bigint, " + ", ".join(f"{k} int" for k in names)), "votes")
    patterns = held.groupBy(*names).agg(F.count("*").alias("n")).collect()  # 3 ** 9 rows at most
    table = np.array([[r[k] for k in names] for r in patterns], np.int64).reshape(-1, len(names))
    model = VoteModel(table, np.array([r.n for r in patterns], np.float64), names)
    chance = {tuple(t): float(p) for t, p in zip(table.tolist(), model.posterior(table) if len(table) else [])}

    # texts of the smallest hashes, with their features; hashes are even, so a share of their range has about that share of texts
    n, edge = sum(r.n for r in patterns), None
    share = 4 * train_rows / max(n, 1)
    while n:
        top = (1 << 63) - 1 if share >= 1 else -(1 << 63) + int(share * 2**64)
        edge, there = held.where(F.col("h") <= F.lit(top)).select("h").distinct().orderBy("h").limit(train_rows).agg(F.max("h"), F.count("*")).first()
        if there >= train_rows or share >= 1:
            break
        share *= 8  # many repeated texts

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x, n = features(b.column("bytes"))
            cuts = np.cumsum(n)[:-1]
            at, x = ([v.astype(kind).tobytes() for v in np.split(every, cuts)] for every, kind in ((at, "<i4"), (x, "<f4")))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("h", *names)), pa.array(n, pa.int64()), pa.array(at, pa.binary()), pa.array(x, pa.binary())], names=["h", *names, "n", "at", "x"])

    few = (held.where(F.col("h") <= F.lit(edge)) if edge is not None else held.limit(0)).dropDuplicates(["text"])
    shown = few.select("h", *names, F.col("text").alias("bytes"))
    shown, shown_at = written(shown.mapInArrow(sparse, "h bigint, " + ", ".join(f"{k} int" for k in names) + ", n bigint, at binary, x binary"), "shown")
    total, last = 0, None
    for h, n in sorted((r["h"], r["n"]) for r in shown.select("h", "n").collect()):  # two numbers a training text
        total += n
        if total > TRAIN_FEATURES and last is not None:
            break
        last = h
    rows = sorted(shown.where(F.col("h") <= F.lit(last)).collect(), key=lambda r: (r["h"], r["at"])) if last is not None else []
    discard(spark, shown_at)
    w = train([np.frombuffer(r["at"], "<i4") for r in rows], [np.frombuffer(r["x"], "<f4") for r in rows], np.array([chance.get(tuple(r[k] for k in names), 0.5) for r in rows]))
    sent = spark.sparkContext.broadcast((w, chance))  # BUCKETS numbers, and one for each pattern

    def score(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        w, chance = sent.value
        for text, *own in batches:
            at, x, n = features(text)
            row = np.repeat(np.arange(len(n)), n)
            s = 1 / (1 + np.exp(-(np.bincount(row, w[at] * x, minlength=len(n)) + w[-1])))
            p = [chance.get(t, model_prior) for t in zip(*(v.to_pylist() for v in own))]
            yield pa.StructArray.from_arrays([pa.array(p, pa.float64()), pa.array(s, pa.float64())], ["posterior", "score"])

    model_prior = float(model.prior[0])
    score.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    udf = arrow_udf(score, "struct<posterior:double,score:double>")
    scored = held.select("doc_id", udf("text", *names).alias("s"))
    return scored.select("doc_id", "s.posterior", "s.score", (F.col("s.score") >= threshold).alias("kept"))
