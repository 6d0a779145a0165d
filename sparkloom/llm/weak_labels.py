"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or abstain on every document.  Expectation
maximisation over the counts of the vote patterns (at most 3 to the number of labellers, the
only thing the driver sees) estimates each labeller's rates of votes on good and on bad
documents, and so the posterior of each pattern.  A logistic scorer over hashed words and word
shapes is trained on the posteriors of at most ``SAMPLE_ROWS`` documents with ``SAMPLE_ENTRIES``
entries together, taken by a hash of id and text, and then scores every document.

Defined results: null text is an empty text.  Ties of the votes get the prior's side.  With no
rows there is no model and no result.  Repeated rows count and are scored each; in the sample they
are one.  Extra columns
are ignored.  If all documents have one pattern the posterior is the prior and all are kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.quality_rules import COMMON_WORDS, PUNCTUATION, SYMBOLS, repeat_words
from sparkloom.llm.shared import short_batches, text_bytes, written

#: Bounds of the training sample: documents, and entries of their vectors (12 bytes each).
SAMPLE_ROWS, SAMPLE_ENTRIES = 8000, 6_000_000
#: Size of the hashed weight vector, passes, step, penalty.
BUCKETS, EPOCHS, STEP, PENALTY = 1 << 16, 60, 1.0, 1e-5
KEEP_FROM = 0.5
LABELLERS = ("length", "symbols", "repeats", "lines", "common_words", "sentences", "shapes", "capitals", "shouts", "diversity", "most_frequent", "wordless")
_COMMON = {w.encode() for words in COMMON_WORDS.values() for w in words}


def _vote(value: float, bad: bool, good: bool) -> int:
    return 0 if bad else 2 if good else 1


def votes(text: bytes, words: list[bytes]) -> str:
    """One digit for each labeller: 0 bad, 1 abstains, 2 good."""
    n = len(words)
    ids = {}
    numbers = np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.int64)
    symbols = (len(text) - len(text.translate(None, SYMBOLS))) / max(n, 1)
    again = repeat_words(numbers, max(1, len(ids))) / max(n, 1)
    lines = [x for x in text.split(b"\n") if x.strip()]
    twice = 1 - len(set(lines)) / len(lines) if lines else 0.0
    usual = sum(w.lower().strip(PUNCTUATION) in _COMMON for w in words) / max(n, 1)
    ends = sum(w.endswith((b".", b"!", b"?")) for w in words) / max(n, 1)
    plain = sum(w.strip(PUNCTUATION).isalpha() or not w.isascii() for w in words) / max(n, 1)
    upper = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    lower = len(text) - len(text.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    capitals = upper / max(upper + lower, 1)
    shouts = sum(w.endswith(b"!") for w in words) / max(n, 1)
    diversity = len(ids) / max(n, 1)
    most = np.bincount(numbers).max() / n if n else 1.0
    wordless = sum(not w.isalnum() and w.isascii() and not w.strip(SYMBOLS + PUNCTUATION) for w in words) / max(n, 1)
    found = (
        _vote(n, n < 5, n >= 80),
        _vote(symbols, symbols > 0.10, symbols < 0.02),
        _vote(again, again > 0.30, n >= 50 and again < 0.05),
        _vote(twice, twice > 0.30, len(lines) >= 3 and twice == 0),
        _vote(usual, usual < 0.05, usual > 0.15),
        _vote(ends, ends < 0.005 or ends > 0.60, 0.02 <= ends <= 0.25),
        _vote(plain, plain < 0.60, plain > 0.90),
        _vote(capitals, capitals > 0.30, upper + lower > 0 and capitals < 0.10),
        _vote(shouts, shouts > 0.15, n > 0 and shouts < 0.02),
        _vote(diversity, n >= 30 and diversity < 0.20, diversity > 0.40),
        _vote(most, n >= 30 and most > 0.20, n >= 30 and most < 0.12),
        _vote(wordless, wordless > 0.15, n > 0 and wordless < 0.02),
    )
    return "".join(map(str, found))


@dataclass(frozen=True)
class VoteModel:
    """Rates of the votes 0 and 2 of each labeller that votes on bad and on good documents, and the share of good ones.

    Abstentions tell nothing: their rate is 1 in both classes.
    """

    rates: np.ndarray  # labeller, class, vote
    prior: float

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of good for rows of votes."""
        logs = np.log(self.rates)
        bad, good = (logs[np.arange(patterns.shape[1]), k, patterns].sum(axis=1) for k in (0, 1))
        gap = np.clip(bad + np.log(1 - self.prior) - good - np.log(self.prior), -500, 500)
        return 1 / (1 + np.exp(gap))

    def accuracy(self) -> np.ndarray:
        """Of the votes of each labeller that are not abstentions, the share that fits the class."""
        good = self.prior * self.rates[:, 1] / (self.prior * self.rates[:, 1, [0, 2]].sum(axis=1) + (1 - self.prior) * self.rates[:, 0, [0, 2]].sum(axis=1))[:, None]
        bad = (1 - self.prior) * self.rates[:, 0] / (self.prior * self.rates[:, 1, [0, 2]].sum(axis=1) + (1 - self.prior) * self.rates[:, 0, [0, 2]].sum(axis=1))[:, None]
        return good[:, 2] + bad[:, 0]


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> VoteModel:
    """Expectation maximisation with add-one smoothing of all rates.

    The start weighs each vote by how rare it is among the labeller's votes: most labellers
    find most documents good, so a few bad votes say more than many good ones.
    """
    shares = np.array([[1 + counts @ (patterns[:, k] == v) for v in (0, 2)] for k in range(patterns.shape[1])])
    rare = -np.log(shares / shares.sum(axis=1, keepdims=True))
    balance = ((patterns == 2) * rare[:, 1] - (patterns == 0) * rare[:, 0]).sum(axis=1)
    good = 1 / (1 + np.exp(-np.clip(balance, -4, 4)))
    for _ in range(rounds):
        rates = np.ones((patterns.shape[1], 2, 3))
        for vote in range(3):
            for k, weight in enumerate((1 - good, good)):
                rates[:, k, vote] += ((patterns == vote) * (weight * counts)[:, None]).sum(axis=0)
        rates /= rates[:, :, [0, 2]].sum(axis=2, keepdims=True)
        rates[:, :, 1] = 1
        prior = float((good @ counts + 1) / (counts.sum() + 2))
        model = VoteModel(rates, prior)
        new = model.posterior(patterns)
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return model


_SHAPE = bytes(ord("a") if 97 <= b <= 122 or b >= 128 else ord("A") if 65 <= b <= 90 else ord("0") if 48 <= b <= 57 else b for b in range(256))


class Features:
    """Hashed words and word shapes; one cache for the texts of a batch."""

    def __init__(self) -> None:
        self.known: dict[bytes, tuple[int, int]] = {}

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Buckets and weights (square roots of counts, unit length), then the bucket of the variety of words."""
        known, pairs = self.known, []
        for w in words:
            if (found := known.get(w)) is None:
                shape = w.translate(_SHAPE)
                short = bytes(c for i, c in enumerate(shape) if i < 1 or c != shape[i - 1])
                found = known[w] = (zlib.crc32(w.lower()) % BUCKETS, zlib.crc32(b"\0" + short) % BUCKETS)
            pairs.append(found)
        if not pairs:
            return np.zeros(0, dtype=np.int64), np.zeros(0)
        at, n = np.unique(np.array(pairs, dtype=np.int64), return_counts=True)
        weight = np.sqrt(n)
        # How varied the words are, as one more bucket for its tenth, scaled by the text's length class.
        tenth = b"\1%d-%d" % (10 * len(set(words)) // len(words), min(len(words).bit_length(), 8))
        return np.append(at, zlib.crc32(tenth) % BUCKETS), np.append(weight / np.sqrt(weight @ weight), 0.5)


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by full passes of adaptive gradient steps."""
    at = np.concatenate([r[0] for r in rows])
    value = np.concatenate([r[1] for r in rows])
    of = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    w, bias = np.zeros(BUCKETS), float(np.log(max(labels.mean(), 1e-6) / max(1 - labels.mean(), 1e-6)))
    seen, seen_bias = np.full(BUCKETS, 1e-8), 1e-8
    for _ in range(EPOCHS):
        z = np.bincount(of, w[at] * value, minlength=len(rows)) + bias
        error = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - labels
        slope = np.bincount(at, error[of] * value, minlength=BUCKETS) / len(rows) + PENALTY * w
        seen += slope * slope
        w -= STEP * slope / np.sqrt(seen)
        seen_bias += error.mean() ** 2
        bias -= 0.1 * STEP * error.mean() / np.sqrt(seen_bias)
    return w, bias


@dataclass(frozen=True)
class Classifier:
    votes: VoteModel
    weights: np.ndarray
    bias: float


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Classifier | None:
    """The vote model of all documents and the scorer of the sample; None for an empty table."""
    short_batches(docs.sparkSession)
    rows = docs.select(F.xxhash64(id_col, text_col).alias("h"), F.col(text_col).alias("text"))

    def vote(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            yield pa.RecordBatch.from_pydict({"votes": pa.array([votes(t, t.split()) for t in text_bytes(rb, "text")], pa.string())})

    found = rows.mapInArrow(vote, "votes string").groupBy("votes").count().orderBy("votes").collect()
    if not found:
        return None
    patterns = np.array([[int(c) for c in r.votes] for r in found])
    counts = np.array([r["count"] for r in found], dtype=np.float64)
    model = fit_votes(patterns, counts)

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # of this task's part of the sample; repeated rows are one
        for rb in batches:
            cache, texts, keys = Features(), text_bytes(rb, "text"), rb.column("h").to_pylist()
            own = [i for i, h in enumerate(keys) if not (h in seen or seen.add(h))]
            split = [texts[i].split() for i in own]
            vectors = [cache.of(w) for w in split]
            yield pa.RecordBatch.from_pydict(
                {
                    "h": pa.array([keys[i] for i in own], pa.int64()),
                    "votes": pa.array([votes(texts[i], w) for i, w in zip(own, split, strict=True)], pa.string()),
                    "at": pa.array([v[0].astype(np.int32) for v in vectors], pa.list_(pa.int32())),
                    "value": pa.array([v[1].astype(np.float32) for v in vectors], pa.list_(pa.float32())),
                }
            )

    # About twice the bound by a hash, so that few texts are read twice; a wider part where that has
    # no row, as in a table of one text.  Then both bounds, in the order of the hash.
    share = max(1, int(counts.sum() // (2 * sample_rows)))
    while True:
        part = written(rows.filter(F.pmod("h", F.lit(share)) == 0).mapInArrow(features, "h long, votes string, at array<int>, value array<float>"), "sample").dropDuplicates(["h"])
        sizes = part.select("h", F.size("at").alias("n")).orderBy("h").limit(sample_rows).toArrow()
        if len(sizes) or share == 1:
            break
        share = max(1, share // 8)
    fits = np.cumsum(sizes["n"].to_numpy()) <= SAMPLE_ENTRIES
    taken = max(1, int(fits.sum()))
    sample = part.orderBy("h").limit(taken).toArrow()
    labels = model.posterior(np.array([[int(c) for c in v] for v in sample["votes"].to_pylist()]))
    vectors = [(np.array(a, dtype=np.int64), np.array(v)) for a, v in zip(sample["at"].to_pylist(), sample["value"].to_pylist(), strict=True)]
    return Classifier(model, *fit_scorer(vectors, labels))


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_from: float = KEEP_FROM, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``id_col``, votes, posterior (of the votes alone), score (of the scorer), kept."""
    model = train(docs, id_col, text_col, sample_rows)
    kind = docs.schema[id_col].dataType.simpleString()

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            cache, own, scores = Features(), [], []
            for t in text_bytes(rb, "text"):
                words = t.split()
                own.append(votes(t, words))
                at, value = cache.of(words)
                z = float(model.weights[at] @ value) + model.bias
                scores.append(round(1 / (1 + np.exp(-max(-500.0, min(500.0, z)))), 9))
            posterior = model.votes.posterior(np.array([[int(c) for c in v] for v in own])) if own else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [rb.column(id_col), pa.array(own, pa.string()), pa.array(np.round(posterior, 9)), pa.array(scores, pa.float64()), pa.array([s >= keep_from for s in scores], pa.bool_())],
                names=[id_col, "votes", "posterior", "score", "kept"],
            )

    return docs.select(id_col, F.col(text_col).alias("text")).mapInArrow(score, f"{id_col} {kind}, votes string, posterior double, score double, kept boolean")
