from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm.toxicity import IDENTITY, Model, drop_toxic, fit_weights, score_documents, swapped, train


@pytest.fixture(scope="module")
def tables(spark):
    pick, rows, labels = random.Random(1), [], []
    plain = [f"w{i}" for i in range(200)]
    for i in range(700):
        words = [pick.choice(plain) for _ in range(30)]
        toxic = i % 5 == 0
        if toxic:
            words.insert(pick.randrange(30), pick.choice(["grubhead", "grubface"]))
        # One group is named in most toxic texts and a few others.
        if pick.random() < (0.7 if toxic else 0.05):
            words.insert(0, "buddhists")
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_finds_toxic_words_and_leaves_group_mentions_alone(tables):
    docs, labels = tables
    model = train(docs, labels)
    assert model.score("w1 w2 grubhead w3") > 0.5
    assert model.score("w1 w2 Grubface!") > 0.5
    assert model.score("the buddhists w1 w2") < 0.3
    assert model.score("w1 w2") < 0.3
    plain = model.score("w5 muslims w9")
    assert abs(plain - model.score("w5 buddhists w9")) < 0.02


def test_the_penalty_shrinks_the_change():
    pick = np.random.default_rng(0)
    x = pick.integers(0, 2, (400, 3)).astype(float)
    y = (x[:, 0] + 0.4 * pick.random(400) > 0.7).astype(float)
    x[:, 2] = np.where(y > 0, pick.random(400) < 0.7, pick.random(400) < 0.1)
    change = np.array([[0.0, 1.0, -1.0]])
    free, _ = fit_weights(x, y, change, fairness=0)
    tied, _ = fit_weights(x, y, change, fairness=1e4)
    assert abs(tied[2] - tied[1]) < 0.05 < abs(free[2] - free[1])


def test_swaps_move_within_the_group():
    assert swapped(["old", "women"], IDENTITY)[0] == ["old", "men"]
    assert swapped(["none"], IDENTITY) == []


def test_defined_results(spark, tables):
    docs, labels = tables
    model = train(docs, labels)
    odd = spark.createDataFrame(
        [(1, None, "a"), (None, "w1", None), (2, "", "b"), (2, "", "b"), (3, "grubhead " * 40000, "c")],
        "doc_id long, text string, held_out string",
    )
    out = score_documents(odd, model, F.col("doc_id") == 1).collect()
    assert len(out) == 5 and {r.predicted for r in out if r.doc_id == 3} == {1}
    assert [r.held_out for r in out] == [True, False, False, False, False]
    assert len({r.score for r in out if r.doc_id in (1, 2)}) == 1
    kept = drop_toxic(odd, model)
    assert kept.columns == odd.columns and kept.count() == 4
    assert score_documents(odd.limit(0), model, F.lit(True)).count() == 0


def test_no_labels_give_a_constant(spark, tables):
    docs, labels = tables
    assert train(docs, labels.limit(0)).score("grubhead") < 0.01
    assert train(docs, labels.withColumn("toxic", F.lit(1))).score("x") > 0.99
    strange = labels.withColumn("toxic", F.lit(None).cast("int"))
    assert isinstance(train(docs, strange), Model)
