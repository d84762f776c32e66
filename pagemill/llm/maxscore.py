"""Exact top-k by inner product with MaxScore over sharded postings.

A dimension is a term, and its postings are the vectors' values in it. Candidates are dealt into
shards; each shard meets every query, which come to it as a stream, so a task holds one shard and
one batch of queries. A shard keeps the postings in blocks with the least and largest value of
each dimension. For a query these give score bounds: dimensions are taken in the order of the
width of their bounds, and the essential ones are the shortest prefix behind which the others
cannot lift a vector over the query's k-th best score so far. Essential postings are traversed for
the whole block; the others are probed only for vectors that are still competitive. Each shard
returns its k best of each query, and the shards are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import limit_batches
from pagemill.session import cut

SHARD, BLOCK = 1 << 15, 1 << 12


def quantised(vectors: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """(vec_id, vector, copies): components as floor(scale * x), equal rows folded into one.

    Vectors that are null, empty, or hold a null or non-finite component take no part, nor do
    rows without an id.
    """
    x, infinite = F.col(embedding), F.lit(float("inf"))
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < infinite))
    return (
        vectors.filter(F.col(vec_id).isNotNull() & x.isNotNull() & (F.size(x) > 0) & whole)
        .select(
            F.col(vec_id).cast("long").alias("vec_id"),
            F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("vector"),
        )
        .groupBy("vec_id", "vector")
        .agg(F.count("*").alias("copies"))
    )


class Shard:
    """Postings by dimension over the vectors of one shard."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, vectors: list[np.ndarray]) -> None:
        size = max(map(len, vectors))
        full = np.zeros((len(ids), size), np.int64)  # a shorter vector has zeros behind its end
        for i, vector in enumerate(vectors):
            full[i, : len(vector)] = vector
        order = np.argsort(ids, kind="stable")  # of equal scores the smaller id comes first
        self.ids, self.copies, full = ids[order], copies[order], full[order]
        self.largest = int(np.abs(full).max(initial=0))
        self.postings = full.T.copy()
        self.exact = self.postings.astype(np.float64)
        starts = np.arange(0, len(ids), BLOCK)
        self.low = np.minimum.reduceat(self.postings, starts, axis=1)
        self.high = np.maximum.reduceat(self.postings, starts, axis=1)

    def best(self, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(vec_id, score) of the k best rows other than the query's own."""
        size = min(len(query), len(self.postings))
        bound = int(np.abs(query).max(initial=0)) * self.largest * max(1, size)
        if bound >= 1 << 63:
            raise OverflowError("a score may not fit 64 bits")
        # Below 2**53 doubles are exact.
        postings, q = (self.exact, query[:size].astype(np.float64)) if bound < 1 << 53 else (self.postings, query[:size])
        found: list[tuple[int, int, int]] = []  # -score, vec_id, copies
        least = None
        a, b = query[:size, None] * self.low[:size], query[:size, None] * self.high[:size]
        tops, floors = np.maximum(a, b), np.minimum(a, b)
        for block in range(self.low.shape[1]):
            at = slice(block * BLOCK, (block + 1) * BLOCK)
            top, floor = tops[:, block], floors[:, block]
            order = np.argsort(floor - top, kind="stable")
            # rest[i]: the most that the dimensions from the i-th on can add.
            rest = np.append(np.cumsum(top[order][::-1])[::-1], 0)
            if least is not None and rest[0] < least:
                continue
            if least is None:
                essential = size
            else:
                behind = np.append(0, np.cumsum(floor[order])) + rest
                essential = int(np.argmax(behind < least)) if (behind < least).any() else size
            scores = np.zeros(len(self.ids[at]), postings.dtype)
            for d in order[:essential]:
                scores += q[d] * postings[d, at]
            live = np.arange(len(scores)) if least is None else np.flatnonzero(scores + rest[essential] >= least)
            scores = scores[live]
            for i, d in enumerate(order[essential:], essential + 1):
                scores += q[d] * postings[d, at][live]
                if i % 8 == 0:
                    keep = scores + rest[i] >= least
                    live, scores = live[keep], scores[keep]
            if len(live) == 0:
                continue
            live = live + block * BLOCK
            copies = self.copies[live]
            own = np.flatnonzero(self.ids[live] == query_id)
            for i in own:
                row = np.zeros(max(len(query), len(self.postings)), np.int64)
                row[: len(query)] = query
                if (row[: len(self.postings)] == self.postings[:, live[i]]).all() and not row[len(self.postings) :].any():
                    copies = copies.copy()
                    copies[i] -= 1
                    break
            some = copies > 0
            live, scores, copies = live[some], scores[some], copies[some]
            if len(live) > k:
                kth = np.partition(scores, len(scores) - k)[len(scores) - k]
                some = scores >= kth
                live, scores, copies = live[some], scores[some], copies[some]
            found += zip((-scores).astype(np.int64).tolist(), self.ids[live].tolist(), copies.tolist(), strict=True)
            found.sort()
            found = found[:k]
            seen = 0
            for score, _, copies_of in found:
                seen += copies_of
                if seen >= k:
                    least = -score
                    break
        out: list[tuple[int, int]] = []
        for score, vec_id, copies_of in found:
            out += [(vec_id, -score)] * min(copies_of, k - len(out))
        return out


def top_k(vectors: DataFrame, is_query: str, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of each query row.

    `vectors` as `quantised` gives them. Ties go to the smaller vec_id. Each of several equal
    query rows has its own k rows, in which the others appear; rows that share an id but not a
    vector are rows of their own. Fewer candidates than k give fewer ranks, none give no rows. A
    score that may not fit 64 bits raises an error.
    """
    rows = cut(vectors.select("vec_id", "vector", "copies"))
    key = F.xxhash64("vec_id", "vector")
    shards = max(1, -(-rows.count() // SHARD))
    candidates = rows.select(F.pmod(key, F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "vec_id", "vector", "copies")
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    queries = rows.filter(is_query).select(every.alias("shard"), F.lit(1).alias("kind"), "vec_id", "vector", "copies")
    dealt = candidates.unionByName(queries).repartition(shards, "shard").sortWithinPartitions("shard", "kind", "vec_id")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, shard = None, None
        waiting: list[tuple[int, int, np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            out: list[tuple] = []
            columns = [batch.column(i) for i in (0, 1, 2, 4)]
            lists = batch.column(3)
            for at, kind, vec_id, copies, vector in zip(*(x.to_pylist() for x in columns), lists, strict=True):
                vector = vector.values.to_numpy(zero_copy_only=False)
                if kind == 0:
                    if at != current:
                        current, shard, waiting = at, None, []
                    waiting.append((vec_id, copies, vector))
                    continue
                if at != current:
                    continue  # a shard without candidates
                if shard is None:
                    ids, counts, bodies = zip(*waiting, strict=True)
                    shard, waiting = Shard(np.array(ids, np.int64), np.array(counts, np.int64), list(bodies)), []
                out += [(vec_id, copies, vector, *x) for x in shard.best(vec_id, vector, k)]
            if out:
                ids, counts, bodies, found, scores = zip(*out, strict=True)
                arrays = [pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array([b.tobytes() for b in bodies], pa.binary()), pa.array(found, pa.int64()), pa.array(scores, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["query_id", "copies", "query", "vec_id", "score"])

    limit_batches(rows.sparkSession)
    found = dealt.mapInArrow(search, "query_id long, copies long, query binary, vec_id long, score long")
    # Equal query rows are one group here; each shard sends k rows of it at most.
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .select("query_id", "rank", "vec_id", "score")
    )
