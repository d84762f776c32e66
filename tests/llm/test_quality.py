from __future__ import annotations

import random

import numpy as np
import pytest

from pagemill.llm.quality import LABELLERS, Reader, estimate, score_documents, train, vote_patterns, votes


def prose(pick):
    words = ["".join(pick.choice("abdeilmnorst") for _ in range(pick.randrange(2, 9))) for _ in range(pick.randrange(40, 160))]
    return " ".join(w.title() + "." if i % 9 == 8 else w for i, w in enumerate(words)) + "."


def junk(pick, kind):
    words = prose(pick).split()
    return [
        " ".join(w + pick.choice(["###", "%%%", "$$$"]) for w in words),
        " ".join(w.upper() + "!!" for w in words),
        " ".join(x for w in words[:12] for x in [w] * 12),
        " | ".join(words),
    ][kind]


@pytest.fixture(scope="module")
def rows():
    pick = random.Random(6)
    return [(i, junk(pick, i % 4) if i % 7 == 0 else prose(pick), i % 7 != 0) for i in range(420)]


def test_finds_junk_without_labels(spark, rows):
    docs = spark.createDataFrame([(i, t, "z") for i, t, _ in rows], "doc_id long, text string, score string")
    scorer = train(docs, sample=200)
    out = {r.doc_id: r for r in score_documents(docs, scorer).collect()}
    wrong = [i for i, _, good in rows if out[i].keep != good]
    assert len(wrong) <= 8 and all(0 <= r.score <= 1 for r in out.values())


def test_accuracies_against_known_votes():
    # Votes drawn with known accuracies: the posterior must follow the truth it cannot see.
    draw = np.random.default_rng(3)
    truth = draw.random(4000) < 0.8
    patterns, rows = {}, []
    for good in truth:
        cast = ""
        for right in (0.95, 0.9, 0.85, 0.7):
            vote = good if draw.random() < right else not good
            cast += "-" if draw.random() < 0.2 else "H" if vote else "L"
        patterns[cast] = patterns.get(cast, 0) + 1
        rows.append(cast)
    posterior = estimate(patterns)
    assert np.mean([(posterior[x] > 0.5) == good for x, good in zip(rows, truth, strict=True)]) > 0.93
    assert estimate({}) == {}


def test_counts_of_patterns(spark, rows):
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    reader, want = Reader(), {}
    for _, text, _ in rows:
        cast = votes(reader.facts(text))
        want[cast] = want.get(cast, 0) + 1
    assert vote_patterns(docs) == want
    assert all(len(x) == len(LABELLERS) for x in want)


def test_defined_results(spark, rows):
    odd = spark.createDataFrame(
        [(1, None, "a"), (None, "x", "b"), (2, "", "c"), (2, "", "c"), (3, "word " * 60000, "d")], "doc_id long, text string, keep string"
    )
    scorer = train(odd)
    out = score_documents(odd, scorer).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id in (1, 2)}) == 1
    empty = train(odd.limit(0))
    assert all(r.keep for r in score_documents(odd, empty).collect())
    assert score_documents(odd.limit(0), scorer).count() == 0
