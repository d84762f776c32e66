from __future__ import annotations

import math
import random

import numpy as np
import pytest

from pagemill.llm import maxscore
from pagemill.llm.maxscore import Shard, quantised, top_k


def brute(rows: list[tuple], k: int, is_query) -> list[tuple]:
    whole = [
        (i, [math.floor(256 * float(x)) for x in v])
        for i, v in rows
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for n, (i, v) in enumerate(whole):
        if is_query(i):
            others = [(-sum(a * b for a, b in zip(v, w)), j) for m, (j, w) in enumerate(whole) if m != n]
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(sorted(others)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("shard,block", [(1 << 15, 1 << 12), (64, 16)])
def test_against_all_pairs(spark, monkeypatch, shard, block):
    monkeypatch.setattr(maxscore, "SHARD", shard)
    monkeypatch.setattr(maxscore, "BLOCK", block)
    pick = random.Random(2)
    rows = [(i, [float(np.float32(pick.gauss(0, 0.1))) for _ in range(8)]) for i in range(300)]
    rows += [(7, rows[7][1]), (10, rows[10][1]), (10, rows[10][1]), (10, rows[11][1]), (900, rows[20][1]), (900, rows[20][1])]
    rows += [(50, None), (60, []), (70, [0.1, None]), (80, [float("nan")] * 8), (90, [float("inf")] * 8), (None, rows[0][1]), (100, [0.5, 0.5])]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    got = sorted(tuple(r) for r in top_k(quantised(table, "vec_id", "embedding", 256), "vec_id % 10 = 0", 5).collect())
    assert got == brute(rows, 5, lambda i: i % 10 == 0)


def test_few_and_none(spark):
    table = spark.createDataFrame([(0, [1.0]), (3, [2.0])], "vec_id long, embedding array<float>")
    vectors = quantised(table, "vec_id", "embedding", 256)
    assert [tuple(r) for r in top_k(vectors, "vec_id = 0", 5).collect()] == [(0, 1, 3, 256 * 512)]
    assert top_k(vectors.limit(0), "vec_id = 0", 5).count() == 0
    assert top_k(vectors, "vec_id = 9", 5).count() == 0


def test_large_components_stay_exact_and_overflow_is_an_error():
    ids, ones = np.arange(3), np.ones(3, np.int64)
    big = [np.array([1 << 29, x]) for x in (0, 1, 2)]
    assert Shard(ids, ones, big).best(0, np.array([1 << 29, 1]), 2)[0] == (2, (1 << 58) + 2)
    with pytest.raises(OverflowError):
        Shard(ids, ones, big).best(0, np.array([1 << 35, 1]), 2)
