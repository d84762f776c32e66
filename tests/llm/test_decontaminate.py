from __future__ import annotations

import itertools
import math
import random

import pytest

from pagemill.llm import decontaminate
from pagemill.llm.common import words_of
from pagemill.llm.decontaminate import Index, drop_leaks, find_leaks, question_and_answer, shingles
from tests.oracle import compare, connect


def brute(docs, items, overlap, stride):
    out = []
    for doc_id, text in docs:
        words, best = words_of(text), {}
        for item_id, q, a in items:
            qw, aw = words_of(q), words_of(a)
            if item_id is None or not qw + aw:
                continue
            for start in range(0, len(words), stride):
                own = words[start : start + stride + overlap]
                held = {tuple(own[i : i + n]) for n in range(1, 6) for i in range(len(own) - n + 1)}
                share = lambda x: len(set(x) & held) / len(set(x)) if x else 1.0  # noqa: B023, E731
                marks = share(shingles(qw + aw)), share(shingles(qw)), share([(w,) for w in aw])
                if marks[0] >= 0.8 and marks[1] >= 0.5 and marks[2] >= 0.5:
                    best[item_id] = max(marks, best.get(item_id, marks))
        out += [(doc_id is None, doc_id or 0, i, *m) for i, m in best.items()]
    return sorted(out)


@pytest.fixture(scope="module")
def data():
    pick = random.Random(8)
    word = lambda: f"t{int(pick.paretovariate(0.6)) % 300}"
    items = [(i, " ".join(word() for _ in range(pick.randrange(8, 40))), " ".join(word() for _ in range(pick.randrange(1, 8)))) for i in range(40)]
    items += [(40, "only question here to see now", ""), (41, None, None), (None, "t1 t2 t3 t4 t5", "t6"), (42, "x y", "z"), (43, items[3][1], items[3][2]), (44, "", "answer alone of six words total")]
    docs = []
    for i in range(160):
        words = [word() for _ in range(pick.randrange(0, 400))]
        if i % 2:
            _, q, a = pick.choice(items[:40])
            copy = f"{q} {a}".split()
            for _ in range(pick.randrange(4)):
                copy[pick.randrange(len(copy))] = "changed"
            at = pick.randrange(len(words) + 1)
            words[at:at] = copy
        docs.append((i, " ".join(words)))
    docs += [(200, None), (201, ""), (None, f"{items[5][1]} {items[5][2]}"), (202, "x Y, z"), (203, "pad " * 30000 + f"{items[7][1]}! {items[7][2]}")]
    docs += [(204, "only question here to see now"), (204, "only question here to see now"), (205, "answer alone of six words total")]
    return docs, items


def frames(spark, data):
    docs, items = data
    return (
        spark.createDataFrame([(i, t, 0.5) for i, t in docs], "doc_id long, text string, overlap double"),
        spark.createDataFrame([(*x, "c") for x in items], "item_id long, question string, answer string, doc_id string"),
    )


@pytest.mark.parametrize("batch", [400_000, 500])
def test_against_every_window(spark, data, monkeypatch, batch):
    monkeypatch.setattr(decontaminate, "BATCH_WORDS", batch)
    docs, items = frames(spark, data)
    index = Index([x for x in data[1] if x[0] is not None])
    got = sorted((r.doc_id is None, r.doc_id or 0, *tuple(r)[1:]) for r in find_leaks(docs, items).collect())
    assert got == brute(*data, index.overlap, index.stride)
    leaking = {x[:2] for x in got}
    kept = drop_leaks(docs, items)
    assert kept.columns == docs.columns
    assert kept.count() == sum((i is None, i or 0) not in leaking for i, _ in data[0])


def test_several_indexes_find_the_same(spark, data, monkeypatch):
    docs, items = frames(spark, data)
    rows = sorted(find_leaks(docs, items).collect(), key=repr)
    monkeypatch.setattr(decontaminate, "INDEX_CHARS", 1000)
    assert len(decontaminate.build_indexes(items)) > 3
    assert sorted(find_leaks(docs, items).collect(), key=repr) == rows


def test_repetitive_items(spark):
    items = [
        (1, "0 1 " * 8, "what comes next"), (2, "la " * 12 + "what is the name", "of this song"),
        (3, "yes no " * 20 + "please pick", "the right one"), (4, "a b " * 100 + " ".join(f"w{i}" for i in range(40)), ""),
        (5, "na " * 9, "na"), (6, "an item of the usual kind without", "a repeated word"),
    ]
    docs = [(i, f"some words before {q} {a} and some after") for i, q, a in items]
    docs += [(10 + i, " ".join([*q.split()[1:], *a.split()[:-1]])) for i, q, a in items]
    docs += [(20 + i, " ".join(["other", *q.split()[4:], *a.split()])) for i, q, a in items]
    docs += [(30, "la la yes no a b 0 1 na"), (31, "a b " * 90 + " ".join(f"w{i}" for i in range(34)))]
    frame_of_docs, frame_of_items = frames(spark, (docs, items))
    index = Index(items)
    got = sorted((False, *tuple(r)) for r in find_leaks(frame_of_docs, frame_of_items).collect())
    assert got == brute(docs, items, index.overlap, index.stride)
    assert {(i, i) for i, _, _ in items} <= {x[1:3] for x in got}
    assert drop_leaks(frame_of_docs, frame_of_items).count() == len(docs) - len({x[1] for x in got})


def test_least_score_is_below_every_passage():
    """Against every set of lost shingles, for items of few different words."""
    pick = random.Random(4)
    for _ in range(150):
        words = [f"t{pick.randrange(pick.choice((2, 4, 9)))}" for _ in range(pick.randrange(1, 17))]
        weights = {t: pick.random() + 1e-3 for t in words}
        found = sorted(set(shingles(words)))
        may = len(found) - math.ceil(0.8 * len(found) - 1e-9)
        scores = [
            sum(weights[t] for t in {t for x in found if x not in lost for t in x})
            for lost in itertools.combinations(found, may)
        ]
        assert 0 < Index._least(words, weights) <= min(scores) + 1e-9


def test_empty_tables(spark, data):
    docs, items = frames(spark, data)
    assert find_leaks(docs.limit(0), items).count() == 0
    assert find_leaks(docs, items.limit(0)).count() == 0
    assert drop_leaks(docs, items.limit(0)).count() == docs.count()


def test_last_sentence_is_the_answer(spark):
    rows = spark.createDataFrame([(1, "A b. C d? E f."), (2, "One."), (3, None), (4, "X.\nY z. ")], "item_id int, text string")
    assert [tuple(r) for r in question_and_answer(rows).orderBy("item_id").collect()] == [
        (1, "A b. C d?", "E f."), (2, "One.", ""), (3, None, None), (4, "X.", "Y z."),
    ]


def test_query_against_sql(spark):
    from pagemill.llm.queries import ORACLES, QUERIES

    sf_dir = "/root/testdata/sf0.01"
    df = QUERIES["op4_decontaminate"](spark, sf_dir)
    assert df.count() > 0
    assert compare(df, ORACLES["op4_decontaminate"], connect(sf_dir)) is None
