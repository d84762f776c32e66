from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from pagemill.llm.merkle import build, check_table, fold_path


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row: tuple) -> str:
    doc_id, text, lang, source, n_chars = row
    values = [None if x is None else str(x) for x in (doc_id, source, lang, n_chars, text)]
    return digest("".join("-" if x is None else f"{len(x.encode())}:{x}" for x in values))


def climb(nodes: list[str], at: int) -> tuple[list[tuple[str, str]], str]:
    path = []
    while len(nodes) > 1:
        first = at - at % 8
        path.append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + 8])))
        nodes = [digest("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
        at //= 8
    return path, nodes[0]


def brute(rows: list[tuple]) -> list[tuple]:
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        mine = [r for r in rows if r[2] == lang]
        trees[lang] = sorted(mine, key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    subroots = [climb(list(map(leaf_of, trees[lang])), 0)[1] for lang in langs]
    root = climb(subroots, 0)[1]
    out = []
    for i, lang in enumerate(langs):
        leaves = list(map(leaf_of, trees[lang]))
        for at, row in enumerate(trees[lang]):
            path = climb(leaves, at)[0] + climb(subroots, i)[0]
            node = leaves[at]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                text = None if row[1] is None else re.sub("[A-Z]", lambda x: x[0].lower(), row[1])
                node = leaf_of((row[0], text, *row[2:]))
            for left, right in path:
                node = digest(left + node + right)
            proof = digest("".join(a + b for a, b in path))
            out.append((row[0], leaves[at], subroots[i], root, proof, node, node == root))
    return out


def rows_of(sizes: dict) -> list[tuple]:
    rng = random.Random(4)
    rows = []
    for lang, n in sizes.items():
        for i in range(n):
            text = rng.choice([None, "", "Ein Text É", "all lower", f"Text {i}\n"])
            rows.append((rng.randrange(-50, 3000), text, lang, rng.choice([None, "a:b", ""]), rng.choice([None, len(text or "")])))
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SIZES = [
    {"en": 700, "de": 65, "fr": 64, "it": 9, "es": 8, "pt": 1, None: 3},
    {"en": 1},
    {f"l{i:03}é": 1 + i % 10 for i in range(70)} | {"": 2, None: 1},
    {None: 513},
]


@pytest.mark.parametrize("sizes", SIZES)
def test_against_brute_force(spark, sizes):
    rows = rows_of(sizes)
    rows += [rows[0]] * 3 + [(None, "A", *rows[0][2:]), (None, None, None, None, None), (5, "Long " * 200_000, *rows[0][2:])]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", pos int, node string").repartition(3)
    got = [tuple(r) for r in check_table(docs).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_few_levels_are_stored_and_proofs_lead_to_the_root(spark):
    rows = [(i, f"t{i}", "en", "s", 2) for i in range(5000)]
    manifest = build(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert [x.count() for x in manifest.levels] == [5000, 79, 2, 1]  # not 625, 10
    proofs = manifest.proofs()
    from pyspark.sql import functions as F

    assert proofs.filter(fold_path(F.col("leaf"), F.col("path")) != manifest.root).count() == 0
    assert proofs.filter(F.size("path") != 5).count() == 0


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert check_table(docs).collect() == [] and build(docs).root is None
