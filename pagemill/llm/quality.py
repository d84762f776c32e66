"""Quality classifier from weak labels.

Overlapping heuristic labellers vote high, low or abstain on every document. Their vote patterns
are counted over all rows, and expectation-maximisation on the counts (one row per pattern, at most
3 ** labellers) estimates how each labeller votes on good and on bad documents, and so the
posterior of each pattern. The posteriors are the soft labels of a hashed linear scorer, which is
trained on `sample` documents, those of smallest hash of their id, and then scores every document.

The scorer sees words by hash, their shapes and endings, and repetition. It is linear in the counts
of words, so a document's score is a sum of one number per word.
"""

from __future__ import annotations

import math
import re
import zlib
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import Memo, map_batches

BUCKETS = 1 << 16
OUT = "doc_id long, score double, keep boolean"

#: Letters with a mark or two behind them.
CLEAN = re.compile(r"[^\W\d_]+[.,;:!?'’]{0,2}")

SPACE, LOWER, UPPER, DIGIT, POINT, SYMBOL = range(6)


def letter_classes() -> np.ndarray:
    """The class of each code point of the basic plane; those above count as lower-case letters."""
    out = np.full(0x10001, SYMBOL, np.uint8)
    for code in range(0x10000):
        x = chr(code)
        if x.isspace():
            out[code] = SPACE
        elif x.isupper():
            out[code] = UPPER
        elif x.isalpha():
            out[code] = LOWER
        elif x.isdigit():
            out[code] = DIGIT
        elif x in ".,;:!?'\"()-’“”«»¿¡…–":
            out[code] = POINT
    out[0x10000] = LOWER
    return out


class Reader:
    """What the labellers look at."""

    def __init__(self) -> None:
        self.classes = letter_classes()

    def facts(self, text: str | None) -> dict[str, float]:
        text = text or ""
        codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        counts = np.bincount(self.classes[np.minimum(codes, 0x10000)], minlength=6)
        words = text.split()
        n = max(1, len(words))
        seen = max(1, int(counts[LOWER] + counts[UPPER] + counts[DIGIT] + counts[POINT] + counts[SYMBOL]))
        letters = max(1, int(counts[LOWER] + counts[UPPER]))
        packed = len(zlib.compress(text.encode("utf-8", "replace"), 1)) / max(1, len(codes))
        return {
            "words": len(words),
            "symbols": counts[SYMBOL] / seen,
            "points": counts[POINT] / seen,
            "upper": counts[UPPER] / letters,
            "clean": sum(map(bool, map(CLEAN.fullmatch, words))) / n,
            "again": sum(map(eq, words, words[1:])) / n,
            "distinct": len(set(words)) / n,
            "shouts": text.count("!!") / n,
            "bars": text.count("|") / n,
            "packed": packed,
        }


# Each labeller: what is low, and what is high; anything between is an abstention.
LABELLERS = (
    (lambda f: f["symbols"] > 0.06, lambda f: f["symbols"] < 0.015),
    (lambda f: f["clean"] < 0.75, lambda f: f["clean"] > 0.92),
    (lambda f: f["upper"] > 0.4, lambda f: f["upper"] < 0.2),
    (lambda f: f["shouts"] > 0.2, lambda f: f["shouts"] < 0.05),
    (lambda f: f["again"] > 0.25, lambda f: f["again"] < 0.05),
    (lambda f: f["bars"] > 0.1, lambda f: f["bars"] < 0.02),
    (lambda f: f["words"] >= 40 and f["distinct"] < 0.15, lambda f: f["words"] >= 40 and f["distinct"] > 0.35),
    (lambda f: f["words"] >= 40 and f["packed"] < 0.2, lambda f: f["words"] >= 40 and f["packed"] > 0.3),
    (lambda f: f["words"] >= 10 and f["points"] > 0.15, lambda f: 0.008 < f["points"] < 0.08),
)


def votes(facts: dict[str, float]) -> str:
    return "".join("L" if low(facts) else "H" if high(facts) else "-" for low, high in LABELLERS)


def estimate(patterns: dict[str, int], rounds: int = 200) -> dict[str, float]:
    """Posterior of being good for each vote pattern, by expectation-maximisation.

    Each labeller has two accuracies: how often its votes are right on good and on bad documents.
    They are smoothed by one vote; abstentions say nothing. The start, any low vote against all
    high ones, fixes which class is the good one. Without patterns there is nothing to estimate.
    """
    names = sorted(patterns)
    if not names:
        return {}
    counts = np.array([patterns[x] for x in names], float)
    high = np.array([[v == "H" for v in x] for x in names], float)
    low = np.array([[v == "L" for v in x] for x in names], float)
    good = np.where(low.any(1), 0.1, 0.95)
    for _ in range(rounds):
        prior = (counts @ good + 1) / (counts.sum() + 2)
        odds = np.full(len(names), math.log(prior / (1 - prior)))
        for weight, sign in ((counts * good, 1), (counts * (1 - good), -1)):
            says_high = (weight @ high + 1) / (weight @ (high + low) + 2)
            odds += sign * (high @ np.log(says_high) + low @ np.log(1 - says_high))
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        done = np.abs(new - good).max() < 1e-9
        good = new
        if done:
            break
    return dict(zip(names, good.tolist(), strict=True))


ENDING = re.compile(r"[\W_]+$")


def bucket(name: str) -> int:
    return xxhash.xxh32_intdigest(name.encode("utf-8", "replace")) % BUCKETS


def word_buckets(word: str) -> list[int]:
    """The hashed features of one word: itself, its shape, and the marks it ends with."""
    ending = ENDING.search(word)
    tail = ending[0][:4] if ending else ""
    body = word[: len(word) - len(ending[0])] if ending else word
    shape = "none" if not body else "upper" if body.isupper() and len(body) > 1 else "title" if body[0].isupper() else "lower" if body.isalpha() else "mixed"
    return [bucket(f"word {body.lower()}"), bucket(f"shape {shape} {min(len(body), 20)}"), bucket(f"tail {tail}")]


def text_buckets(words: list[str]) -> list[int]:
    """The features of a text as a whole: its size and its repetition, in steps."""
    n = max(1, len(words))
    again, distinct = sum(map(eq, words, words[1:])) / n, len(set(words)) / n
    size = len(words).bit_length()
    return [bucket(f"size {size}"), bucket(f"again {int(again * 10)}"), bucket(f"distinct {size} {int(distinct * 10)}")]


class Scorer:
    """Hashed weights and a bias. Word weights count by their share of the text."""

    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias = weights.astype(np.float64), bias
        self.ready()

    def ready(self) -> None:
        self.of_word = Memo(lambda word: float(self.weights[word_buckets(word)].sum()), 200_000)

    def __getstate__(self) -> tuple:
        return self.weights, self.bias

    def __setstate__(self, state: tuple) -> None:
        self.weights, self.bias = state
        self.ready()

    def score(self, text: str | None) -> float:
        words = (text or "").split()
        odds = self.bias + float(self.weights[text_buckets(words)].sum())
        if words:
            odds += math.fsum(map(self.of_word.__getitem__, words)) / len(words)
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, odds))))


def fit(rows: list[tuple[list[int], list[float]]], targets: np.ndarray, rounds: int = 150, ridge: float = 1e-4) -> Scorer:
    """Logistic regression on soft labels, by gradient steps scaled per feature (Adagrad)."""
    weights, bias = np.zeros(BUCKETS), 0.0
    if not rows:
        return Scorer(weights, 20.0)
    owner = np.repeat(np.arange(len(rows)), [len(x) for x, _ in rows])
    place = np.array([i for x, _ in rows for i in x], np.int64)
    value = np.array([v for _, x in rows for v in x], float)
    power, bias_power = np.full(BUCKETS, 1e-8), 1e-8
    for _ in range(rounds):
        odds = bias + np.bincount(owner, weights[place] * value, len(rows))
        error = (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - targets) / len(rows)
        slope = np.bincount(place, error[owner] * value, BUCKETS) + ridge * weights / len(rows)
        power += slope**2
        weights -= 0.5 * slope / np.sqrt(power)
        bias_power += error.sum() ** 2
        bias -= 0.5 * error.sum() / math.sqrt(bias_power)
    return Scorer(weights, bias)


def vote_patterns(docs: DataFrame) -> dict[str, int]:
    """How often each vote pattern occurs, over all rows."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        reader = Reader()
        return pa.RecordBatch.from_arrays([pa.array([votes(reader.facts(x.as_py())) for x in batch.column(0)], pa.string())], ["pattern"])

    found = map_batches(docs.select("text"), count, "pattern string").groupBy("pattern").count()
    return {r["pattern"]: r["count"] for r in found.collect()}


def train(docs: DataFrame, sample: int = 4_000) -> Scorer:
    """Estimate the labellers on all rows, then fit the scorer to the posteriors of the sample.

    An empty table gives a scorer that keeps everything.
    """
    posterior = estimate(vote_patterns(docs))
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("body"))
    chosen = rows.filter("id IS NOT NULL").select("id").orderBy(F.xxhash64("id"), "id").limit(sample).distinct()

    def features(batch: pa.RecordBatch) -> pa.RecordBatch:
        reader, patterns, places, values = Reader(), [], [], []
        for x in batch.column(0):
            text = x.as_py()
            words, found = (text or "").split(), {}
            for word in words:
                for i in word_buckets(word):
                    found[i] = found.get(i, 0.0) + 1 / len(words)
            for i in text_buckets(words):
                found[i] = found.get(i, 0.0) + 1
            patterns.append(votes(reader.facts(text)))
            places.append(list(found))
            values.append(list(found.values()))
        arrays = [pa.array(patterns, pa.string()), pa.array(places, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))]
        return pa.RecordBatch.from_arrays(arrays, ["pattern", "places", "marks"])

    # At most `sample` ids.
    texts = rows.join(F.broadcast(chosen), "id").select("body")
    got = map_batches(texts, features, "pattern string, places array<int>, marks array<float>").collect()
    return fit([(r.places, r.marks) for r in got], np.array([posterior[r.pattern] for r in got]))


def score_documents(docs: DataFrame, scorer: Scorer, threshold: float = 0.5) -> DataFrame:
    """(doc_id, score, keep) of every whole text, one row per input row; no shuffle.

    A null text is scored as an empty one; repeated rows each give a row; a null id stays null.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = np.array([shared.value.score(x.as_py()) for x in batch.column(1)])
        arrays = [batch.column(0), pa.array(scores, pa.float64()), pa.array(scores >= threshold)]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "score", "keep"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")), work, OUT)
