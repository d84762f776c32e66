"""run() against the stages done one document at a time in plain Python."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from pagemill.llm import jaccard, toxicity
from pagemill.llm.decontaminate import Index
from tests.llm.test_decontaminate import brute as brute_leaks
from tests.llm.test_jaccard import brute as brute_classes
from tests.llm.test_line_dedup import brute as brute_lines


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    pick = random.Random(21)
    word = lambda: f"p{pick.randrange(500)}"
    items = [(i, " ".join(word() for _ in range(20)) + ". " + " ".join(word() for _ in range(8)) + ".") for i in range(12)]
    docs, labels = [], []
    for i in range(500):
        words = [word() for _ in range(pick.randrange(30, 120))]
        toxic = i % 6 == 0
        if toxic:
            words.insert(5, "grubhead")
        if i % 11 == 1:
            words = docs[pick.randrange(len(docs))][1].split("\n")[-1].split()
            words[pick.randrange(len(words))] = word()
            toxic = "grubhead" in words
        if i % 17 == 3:
            words += pick.choice(items)[1].split()
        text = " ".join(words)
        docs.append((i, f"menu of the site\n{text}" if i % 2 else text, "en", f"s{i % 3}", len(text), "extra"))
        labels.append((i, 1, int(toxic)))
    docs += [(600, None, None, None, None, None), (601, "", "en", "s1", 0, None), (None, "no id here but a text of its own", "en", None, 1, "x")]
    docs.append(docs[8])
    sf_dir = str(tmp_path_factory.mktemp("sf"))
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{sf_dir}/{name}.parquet")
    write(docs, "doc_id long, text string, lang string, source string, n_chars long, score string", "documents")
    write(labels, "doc_id long, quality int, toxic int", "labels")
    write(items, "item_id long, text string", "benchmark")
    return sf_dir, docs, items


def test_against_plain_python(spark, corpus):
    sf_dir, docs, items = corpus
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect())

    labels = corpus_pipeline.table(spark, sf_dir, "labels").filter(corpus_pipeline.fold("doc_id", 4) != 2)
    model = toxicity.train(corpus_pipeline.table(spark, sf_dir, "documents"), labels)
    rows = [(i, s, t) for i, t, _, s, _, _ in docs if model.score(t) < toxicity.THRESHOLD]
    assert 300 < len(rows) < 480
    rows = [(i, t) for i, _, t in brute_lines(rows, 0.1, 5)]
    kept, used = [], set()
    for (i, t), (_, name, _) in zip(rows, brute_classes(rows), strict=True):
        if i is None or (i == name and i not in used):
            used.add(i)
            kept.append((i, t))
    assert len(kept) < len(rows)
    whole = [(i, *((t[: t.index(". ") + 1], t[t.index(". ") + 2 :]))) for i, t in items]
    index = Index(whole)
    leaking = {x[:2] for x in brute_leaks(kept, whole, index.overlap, index.stride)}
    assert leaking
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, t in kept:
        if (i is None, i or 0) not in leaking:
            ids = library.encode(t or "", add_special_tokens=False).ids
            packed = b"".join(x.to_bytes(4, "little") for x in ids)
            want.append((i is None, i or 0, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)


def test_stages_keep_the_columns(spark, corpus):
    sf_dir, docs, _ = corpus
    table = corpus_pipeline.table(spark, sf_dir, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, table, sf_dir).columns == table.columns, name
        assert stage(spark, table.limit(0), sf_dir).count() == 0, name
    assert jaccard.keep_one(table).count() < table.count()
