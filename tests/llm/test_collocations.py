from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagemill.llm.collocations import collocations, count_phrases, score


def brute(rows: list[tuple], least: int, longest: int, top: int, inside: int = 50) -> list[tuple]:
    f: Counter = Counter()
    total: Counter = Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda x: x[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    f[lang, tuple(words[i : i + n])] += 1
    found = []
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        longer = [b for (x, q), b in f.items() if x == lang and len(q) > len(p) and b >= least and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * b >= inside * a for b in longer):
            continue
        best = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        l, r = f[lang, p[: best[1]]], f[lang, p[best[1] :]]
        found.append((lang, -best[0], -a, " ".join(p).encode(), l, r))
    out, rank = [], Counter()
    for lang, s, a, p, l, r in sorted(found):
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], p.decode(), -a, l, r, total[lang], -s))
    return out


def corpus(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["É", "é", " ", "New", "YORK", "city", "x|y"]
    rows = []
    for i in range(n):
        text = "".join(
            rng.choices(words, [9, 7, 5, *[1] * (len(words) - 3)])[0] + rng.choice([" ", " ", " ", "\t ", ", ", "\n", ".", "! ?"])
            for _ in range(rng.randrange(60))
        )
        text += " New York City" * rng.randrange(3) + rng.choice(["", " ha ha ha ha ha", "\x0bha ha"])
        rows.append((rng.choice(["en", "en", "de", None, "und", ""]), text))
    return rows + [("en", None), ("en", ""), ("fr", None), ("it", "one word"), ("en", " . ,\n"), ("en", "long tail " * 3000)]


@pytest.mark.parametrize(("shards", "cells", "longest"), [(4, 1 << 16, 3), (3, 64, 3), (1, 1 << 10, 4), (2, 256, 2)])
def test_against_brute_force(spark, shards, cells, longest):
    rows = corpus(shards, 150)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    docs = docs.withColumns({"phrase": F.lit(1), "n": F.lit(2), "shard": F.lit("x")})
    got = [tuple(r) for r in collocations(docs, 5, longest, 12, shards=shards, cells=cells, bits=cells).collect()]
    assert sorted(got) == sorted(brute(rows, 5, longest, 12))


def test_phrases_begin_their_cycle_while_words_are_counted(spark):
    """With all documents alike, a later length begins one scan after the one before it."""
    docs = spark.createDataFrame([("en", "a b c d")] * 80, "lang string, text string").repartition(1)
    counts = count_phrases(docs, least=10, longest=3, shards=4, cells=1 << 12)
    assert counts.scans == 6  # not 12: lengths are counted side by side
    assert {r.phrase: r.n for r in counts.frequent.collect()}["b c d"] == 80


def test_empty(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert collocations(docs).collect() == []
    assert collocations(spark.createDataFrame([("en", None)], docs.schema)).collect() == []


def test_exact_scores(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(200):
        a = rng.randrange(1, 10**13)
        rows.append((a, a + rng.randrange(10**12), a + rng.randrange(10**13)))
    rows += [(10**13, 10**13, 10**13), (10, 10**13, 10**13)]
    got = spark.createDataFrame(rows, "a long, l long, r long").select("a", "l", "r", score(F.col("a"), F.col("l"), F.col("r")).alias("s"))
    assert all(r.s == 10**6 * r.a * r.a // (r.l * r.r) for r in got.collect())
