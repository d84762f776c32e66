"""The automaton against the tokenizers library and against the merge loop spelled out."""

from __future__ import annotations

import hashlib
import random
import struct

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pagemill.llm.bpe import Automaton, compile_merges, encode_documents


@pytest.fixture(scope="module")
def machine() -> Automaton:
    return compile_merges(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library() -> Tokenizer:
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


TEXTS = [
    "", " ", "  a  b ", "a\n\nb \n c", "don't we'll I'M x's", "!!!???  ***", "a" * 700, " " * 300 + "x",
    "<|endoftext|>a<|endoftext|> b", "é ü ß ñ 日本語 ٣٤ 🙂👍🏽", "\x00\x07�​", "12345 6,7.8\t9\r\n",
    " nb　sp  ", "aaaaaaaaab" * 9, "=-=-=-=-" * 40, "\u0085x \u001cy",
]


@pytest.mark.parametrize("text", TEXTS)
def test_same_ids_as_the_library(machine, library, text):
    ids = machine.encode(text).tolist()
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert machine.decode(machine.encode(text)) == library.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_any_text(machine, library, text):
    assert machine.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_letters_mixed_at_random(machine, library):
    pick = random.Random(5)
    for _ in range(400):
        text = "".join(pick.choice("aabeinorst  .,\n'") for _ in range(pick.randrange(60)))
        assert machine.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def merged(word: bytes, merges: list[tuple[int, int, int]]) -> list[int]:
    """Brute force: the lowest rank first, from the left."""
    ids = list(word)
    for a, b, ab in merges:
        i = 0
        while i < len(ids) - 1:
            if (ids[i], ids[i + 1]) == (a, b):
                ids[i : i + 2] = [ab]
            i += 1
    return ids


@pytest.mark.parametrize("seed", range(40))
def test_gadgets_against_the_merge_loop(seed):
    pick = random.Random(seed)
    labels, merges, seen = [bytes([i]) for i in range(3)], [], set()
    while len(merges) < 14:
        a, b = pick.randrange(len(labels)), pick.randrange(len(labels))
        if labels[a] + labels[b] in seen:
            continue
        seen.add(labels[a] + labels[b])
        merges.append((a, b, len(labels)))
        labels.append(labels[a] + labels[b])
    machine = Automaton(labels, merges, {}, ".")
    for _ in range(150):
        word = bytes(pick.randrange(3) for _ in range(pick.randrange(1, 14)))
        assert machine.encode_word(word) == merged(word, merges)


def test_rows(spark, machine, library):
    rows = [(1, "Hello world"), (2, None), (2, ""), (None, "x y"), (5, "long word " * 5000)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, n_tokens string")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encode_documents(docs, machine).collect()}
    want = set()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        packed = hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        want.add((i, len(ids), packed, hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == want
    assert encode_documents(docs.limit(0), machine).count() == 0
