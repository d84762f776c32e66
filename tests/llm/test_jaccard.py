from __future__ import annotations

import random

import pytest

from pagemill.llm import jaccard
from pagemill.llm.common import words_of
from pagemill.llm.jaccard import components, join, keep_one
from pagemill.session import cut


def grams(text):
    words = words_of(text)
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    sets = [grams(t) for _, t in rows]
    near = [[j for j in range(len(rows)) if j != i and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9] for i in range(len(rows))]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, others in enumerate(near):
            low = min([label[i], *(label[j] for j in others)])
            for j in [i, *others]:
                if label[j] != low:
                    label[j], changed = low, True
    ids = {}
    for (doc_id, _), x in zip(rows, label, strict=True):
        ids.setdefault(x, []).append(doc_id)
    name = {x: min((i for i in found if i is not None), default=None) for x, found in ids.items()}
    return [(i, name[x], len(others)) for (i, _), x, others in zip(rows, label, near, strict=True)]


@pytest.fixture(scope="module")
def rows():
    pick = random.Random(11)
    word = lambda: f"v{pick.randrange(400)}"
    line = " ".join(word() for _ in range(30))
    out, base = [], [[word() for _ in range(pick.randrange(20, 120))] for _ in range(25)]
    for i in range(260):
        words = list(pick.choice(base))
        for _ in range(pick.randrange(4)):
            at = pick.randrange(len(words))
            words[at : at + pick.randrange(2)] = [word()]
        out.append((i, " ".join(words) + (f"\n{line}" if i % 3 else "")))
    cluster = [word() for _ in range(150)]
    for i in range(300, 380):  # one large group of near copies
        words = list(cluster)
        words[pick.randrange(150)] = word()
        words.append(word())
        out.append((i, " ".join(words)))
    out += [(400 + i, out[5][1]) for i in range(40)]  # copies
    out += [(500, None), (501, ""), (502, "..."), (503, "One two"), (504, "one, TWO!"), (505, "one"), (506, "pad " * 20000), (507, "pad " * 15000)]
    out += [(508, out[9][1]), (508, out[9][1]), (None, out[10][1]), (None, "nobody knows this one text at all")]
    return out


@pytest.mark.parametrize("bucket,block", [(4096, 128), (12, 10)])
def test_against_all_pairs(spark, rows, monkeypatch, bucket, block):
    monkeypatch.setattr(jaccard, "BUCKET", bucket)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, copies int, key string")
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r) for r in join(docs).collect()), key=key) == sorted(brute(rows), key=key)


def test_sets_that_share_a_key(spark, rows):
    """With keys of 3 bits nearly all sets share theirs; only the other half tells them apart."""
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r) for r in join(docs, key_bits=3).collect()), key=key) == sorted(brute(rows), key=key)
    wanted = {i for i, name, _ in brute(rows) if i == name and i is not None}
    assert {r.doc_id for r in keep_one(docs, key_bits=3).collect() if r.doc_id is not None} == wanted


def test_rows_of_a_hot_component_are_split(spark, monkeypatch):
    """The join of a star's arms with its centre reads a written table on the centre's side."""
    written = []
    monkeypatch.setattr(jaccard, "cut", lambda df: written.append(df.columns) or cut(df))
    edges = spark.createDataFrame([(i, 0) for i in range(1, 60)], "a long, b long")
    assert {r.component for r in components(edges).collect()} == {0}
    assert ["a", "m"] in written


def test_one_of_each_class_stays(spark, rows):
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, fate_own int, sieve_places string")
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    wanted = [i for i, name, _ in brute(rows) if i == name and i is not None]
    got = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert got == sorted(set(wanted))
    assert sum(r.doc_id is None for r in kept.collect()) == 1
    assert keep_one(docs.limit(0)).count() == 0 and join(docs.limit(0)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i + 1, i) for i in range(40)]
    star = [(100 + i, 100) for i in range(1, 50)]
    edges = spark.createDataFrame(chain + star + [(205, 201), (205, 203)], "a long, b long")
    got = {r.key: r.component for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 150), 100), **dict.fromkeys((201, 203, 205), 201)}
    assert components(edges.limit(0)).count() == 0
