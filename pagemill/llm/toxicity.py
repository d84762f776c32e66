"""Toxicity: a linear classifier trained with counterfactual regularisation.

Features are the presence of words and of their first four and five letters. The labelled sample
is counted by Spark; of the features that toxic texts hold more often than others, the `most` that
tell most by a G-test are kept, whatever the size of the sample, together with the identity terms.
Logistic regression on them gets, besides the ridge, a penalty on the squared change of the
log-odds when the identity terms of a labelled sentence are swapped for others of their group, so
that naming a group does not move the score by itself.

The sample is bounded by `sample` labelled documents, those of smallest hash of their id, the kept
features by `most`, and the swapped sentences by `swaps`, those of smallest hash over all sentences
of the sample. Everything else covers all rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import Memo, map_batches, words_of
from pagemill.session import cut

OUT = "doc_id long, held_out boolean, score double, predicted int"
THRESHOLD = 0.3

# Groups of identity terms that may stand for each other in a sentence.
IDENTITY = (
    "women men girls boys trans nonbinary".split(),
    "woman man girl boy".split(),
    "female male".split(),
    "muslims christians jews hindus buddhists sikhs atheists catholics".split(),
    "muslim christian jewish hindu buddhist sikh atheist catholic".split(),
    "gay lesbian bisexual straight queer".split(),
    "black white asian latino african european arab".split(),
    "immigrants refugees locals foreigners".split(),
    "immigrant refugee local foreigner".split(),
    "old young elderly disabled blind deaf".split(),
)

SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def features_of(word: str) -> list[str]:
    return [word, *(f"{word[:n]}\x00" for n in (4, 5) if len(word) > n)]


def presence(text: str | None) -> set[str]:
    return {x for word in set(words_of(text)) for x in features_of(word)}


class Model:
    """Weights by feature, and a bias. The score of a text sums each of its words once."""

    def __init__(self, weights: dict[str, float], bias: float) -> None:
        self.weights, self.bias = weights, bias
        self.ready()

    def ready(self) -> None:
        # A word's own weight and those of its beginnings.
        self.of_word = Memo(lambda word: [(x, self.weights[x]) for x in features_of(word) if x in self.weights], 150_000)

    def __getstate__(self) -> tuple:
        return self.weights, self.bias

    def __setstate__(self, state: tuple) -> None:
        self.weights, self.bias = state
        self.ready()

    def score(self, text: str | None) -> float:
        found: dict[str, float] = {}
        for hits in map(self.of_word.__getitem__, set(words_of(text))):
            if hits:
                found.update(hits)
        odds = self.bias + math.fsum(found.values())
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, odds))))


def swapped(words: list[str], groups: Iterable[list[str]]) -> list[list[str]]:
    """Copies of a sentence in which each group's terms are moved to the next term of the group."""
    out = []
    for group in groups:
        to = {a: group[(i + 1) % len(group)] for i, a in enumerate(group)}
        if any(word in to for word in words):
            out.append([to.get(word, word) for word in words])
    return out


def fit_weights(
    rows: np.ndarray, labels: np.ndarray, changes: np.ndarray, ridge: float = 1.0, fairness: float = 50.0
) -> tuple[np.ndarray, float]:
    """Newton steps for logistic loss + ridge |w|^2 / 2 + fairness * sum (change . w)^2 / 2."""
    n, k = rows.shape
    x = np.hstack([rows, np.ones((n, 1))]).astype(np.float64)
    penalty = np.diag([ridge] * k + [1e-6])
    penalty[:k, :k] += fairness * changes.T @ changes
    w = np.zeros(k + 1)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - labels) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:k], float(w[k])


def train(
    docs: DataFrame, labels: DataFrame, sample: int = 12_000, most: int = 200, swaps: int = 2_000,
    groups: tuple[list[str], ...] = IDENTITY,
) -> Model:
    """Fit on (doc_id, toxic 0/1) rows. Without labels of both kinds the model is a constant.

    An id with several labels is toxic if one of them says so; one with several texts is learned by
    the last of them in byte order. A feature that one document alone holds is not kept.
    """
    chosen = (
        labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    # At most `sample` pairs of numbers, so the broadcast is bounded.
    texts = cut(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"), F.max("text").alias("text"))
    )
    n, n_toxic = texts.agg(F.count("*"), F.sum(F.expr("int(toxic = 1)"))).first()
    if not n or not n_toxic or n_toxic == n:
        return Model({}, 20.0 if n_toxic else -20.0)

    def emit(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [sorted(presence(x.as_py())) for x in batch.column(1)]
        names = [x for row in found for x in row]
        toxic = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(row) for row in found])
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(toxic, pa.int32())], ["feature", "toxic"])

    counts = (
        map_batches(texts.select("toxic", "text"), emit, "feature string, toxic int")
        .groupBy("feature")
        .agg(F.count("*").alias("found"), F.sum("toxic").alias("found_toxic"))
        .filter("found >= 2")
    )
    telling = counts.filter(F.col("found_toxic") * n > F.col("found") * n_toxic).withColumn("g", _g_column(n, n_toxic))
    kept = [r.feature for r in telling.orderBy(F.desc("g"), "feature").limit(most).collect()]
    kept += [x for x in dict.fromkeys(t for group in groups for t in group) if x not in set(kept)]
    place = {x: i for i, x in enumerate(kept)}

    def vectors(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, pairs = [], []
        for x in batch.column(1):
            text = x.as_py()
            own.append(sorted(place[f] for f in presence(text) if f in place))
            found = []
            for sentence in SENTENCE.split(text or ""):
                words = words_of(sentence)
                for other in swapped(words, groups):
                    a, b = ({place[f] for w in ws for f in features_of(w) if f in place} for ws in (words, other))
                    found.append([*(i + 1 for i in sorted(b - a)), *(-i - 1 for i in sorted(a - b))])
            pairs.append(found)
        arrays = [batch.column(0), pa.array(own, pa.list_(pa.int32())), pa.array(pairs, pa.list_(pa.list_(pa.int32())))]
        return pa.RecordBatch.from_arrays(arrays, ["toxic", "own", "pairs"])

    found = cut(map_batches(texts.select("toxic", "text"), vectors, "toxic int, own array<int>, pairs array<array<int>>"))
    rows = found.select("toxic", "own").collect()
    x, y = np.zeros((len(rows), len(kept)), np.float32), np.array([r.toxic for r in rows], np.float64)
    for i, row in enumerate(rows):
        x[i, row.own] = 1
    # By position as well, so that a swap that many sentences share is chosen as often as it occurs.
    pairs = found.select(F.xxhash64("own").alias("of"), F.posexplode("pairs").alias("at", "pair")).filter(F.size("pair") > 0)
    chosen = pairs.orderBy(F.xxhash64("of", "at", "pair"), "of", "at", "pair").limit(swaps)
    moves = [row.pair for row in chosen.select("pair").collect()]
    changes = np.zeros((len(moves), len(kept)))
    for i, move in enumerate(moves):
        for k in move:
            changes[i, abs(k) - 1] += 1 if k > 0 else -1
    weights, bias = fit_weights(x, y, changes)
    return Model({name: float(w) for name, w in zip(kept, weights, strict=True) if abs(w) > 1e-9}, bias)


def _g_column(n: int, n_toxic: int) -> Column:
    """G statistic of presence against label, as a column: only kept features reach the driver."""
    found, toxic = F.col("found"), F.col("found_toxic")
    cells = [
        (toxic, found * F.lit(n_toxic / n)),
        (found - toxic, found * F.lit((n - n_toxic) / n)),
        (F.lit(n_toxic) - toxic, (F.lit(n) - found) * F.lit(n_toxic / n)),
        (F.lit(n - n_toxic) - found + toxic, (F.lit(n) - found) * F.lit((n - n_toxic) / n)),
    ]
    parts = [F.when((a > 0) & (e > 0), a * F.log(a / e)).otherwise(0.0) for a, e in cells]
    return 2 * (parts[0] + parts[1] + parts[2] + parts[3])


def score_documents(docs: DataFrame, model: Model, held_out: Column, threshold: float = THRESHOLD) -> DataFrame:
    """Score each whole text: one row per input row.

    A null or empty text has no features and gets the score of the bias; repeated rows each give
    a row; a null id stays null and is not held out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = np.array([shared.value.score(x.as_py()) for x in batch.column(2)])
        arrays = [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array(scores >= threshold).cast(pa.int32())]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    return map_batches(rows, work, OUT)


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, whose text scores below the threshold."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([shared.value.score(x.as_py()) < threshold for x in batch.column(at)]))

    return map_batches(docs, work, docs.schema)
