from __future__ import annotations

import random
import re

import pytest

from pagemill.llm.licenses import TEMPLATES, bands_needed, oracle, scan
from tests.oracle import compare, connect


def split(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def shingles(words):
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)]


def brute(rows, templates):
    best = {}
    for doc_id, text in rows:
        found = shingles(split(text))
        for name, notice in templates.items():
            own = set(shingles(split(notice)))
            stride = 1
            while stride < len(own):
                stride *= 2
            for start in range(0, len(found), stride):
                share = len(own & set(found[start : start + 2 * stride])) / len(own)
                if share >= 0.8:
                    best[doc_id, name] = max(share, best.get((doc_id, name), 0))
    return sorted(((i is None, i or 0, name, round(x, 9)) for (i, name), x in best.items()))


def test_against_all_windows(spark):
    pick = random.Random(4)
    names = sorted(TEMPLATES)
    rows = []
    for i in range(150):
        words = [f"w{pick.randrange(50)}" for _ in range(pick.randrange(120))]
        notice = TEMPLATES[pick.choice(names)].split()
        if i % 3 == 0 and len(notice) > 12:
            notice[pick.randrange(2)] = "other"  # near copies
        if i % 4:
            at = pick.randrange(len(words) + 1)
            words[at:at] = notice
        rows.append((i, " ".join(words).upper() if i % 7 == 0 else " ".join(words)))
    rows += [(200, None), (201, ""), (None, TEMPLATES["MIT"]), (202, "a b"), (203, TEMPLATES["GPL-3.0"]), (203, "x " + TEMPLATES["GPL-3.0"])]
    rows += [(204, "word " * 20000 + TEMPLATES["MIT-grant"] + " word" * 300)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, license string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.license, round(r.containment, 9)) for r in scan(docs).collect())
    assert got == brute(rows, TEMPLATES)
    assert scan(docs.limit(0)).count() == 0
    assert scan(docs, {}).count() == 0
    with pytest.raises(ValueError):
        scan(docs, {"short": "too short"})


def test_bands_keep_the_promise():
    for least, stride in ((1, 1), (3, 4), (9, 16)):
        bands = bands_needed(least, stride, 0.8, 1e-6)
        shared = -(-least * 8 // 10)
        assert (1 - shared / (2 * stride + least - shared)) ** bands <= 1e-6


def test_only_dataframe_functions(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = scan(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query_against_sql(spark):
    from pagemill.llm.queries import QUERIES

    sf_dir = "/root/testdata/sf0.01"
    assert compare(QUERIES["op2_licenses"](spark, sf_dir), oracle(TEMPLATES), connect(sf_dir)) is None
