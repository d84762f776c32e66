from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from pagemill.llm.repetition import WINDOW_PERCENT, judge, measure, measures_of

LENGTHS = (4, 5, 7, 10)


def brute(text: str | None, lengths: tuple[int, ...]) -> dict[str, int]:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    size = lambda xs: sum(map(len, xs))

    def inside(n: int, first_too: bool) -> list[str]:
        runs = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        taken = set()
        for i, run in enumerate(runs):
            if runs.count(run) > 1 if first_too else run in runs[:i]:
                taken |= set(range(i, i + n))
        return [words[i] for i in taken]

    lines = text.split("\n")
    later = [x for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:i]]
    return {
        "n_words": len(words),
        "word_chars": size(words),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(later),
        "n_repeat_words": len(inside(3, True)),
        "dup_line_chars": sum(size(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in later),
        **{f"dup_chars_{n}": size(inside(n, False)) for n in lengths},
    }


def samples() -> list[str | None]:
    rng = random.Random(5)
    out = [None, "", " \n\t\x0b ", "one", "a a a a a a", "x y  z x y", "# $ | <b>\n\nsame\nsame\r\nsame\n same\nsame"]
    for few in (2, 3, 8, 200):
        for n in (1, 2, 3, 4, 11, 60, 150):
            words = [f"w{rng.randrange(few)}é" for _ in range(n)]
            out.append("".join(w + rng.choice(" \n\t") for w in words))
    out.append("the same seven words in a row " * 20)
    return out


@pytest.mark.parametrize("base", [0x9E3779B97F4A7C15, 1])
def test_against_brute_force(base):
    # With base 1 a window's hash forgets the order of its words, so many windows share one.
    texts = samples()
    got = measures_of(pa.array(texts, pa.string()), LENGTHS, np.uint64(base))
    for i, text in enumerate(texts):
        assert {name: int(values[i]) for name, values in got.items()} == brute(text, LENGTHS)


def test_rows_and_odd_input(spark):
    texts = samples()
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, "a b c", 2), (3, "one", 3), (3, "one", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    got = [r.asDict() for r in measure(docs, LENGTHS).collect()]
    key = lambda r: str(sorted(r.items(), key=str))
    assert sorted(got, key=key) == sorted(({"doc_id": i, **brute(t, LENGTHS)} for i, t, _ in rows), key=key)
    assert judge(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        measure(docs, (3, 5))


def test_verdict(spark):
    rng = random.Random(8)
    prose = " ".join(f"{rng.randrange(10**6):x}" for _ in range(600))
    quoted = prose + " " + prose[:200]
    half = prose[:1500] + "\n" + " ".join(f"{x}\n" + prose[1500:2000] for x in range(4))
    lines = "\n".join([f"line {i} of its own {rng.random()}" for i in range(60)] + ["word word2"] * 70)
    long = " ".join(f"{rng.randrange(10**9):x}" for _ in range(300_000))
    texts = [prose, quoted, half, lines, "too short", long, "spam ham " * 400]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in judge(docs).collect()}
    assert [rows[i].kept for i in range(7)] == [True, True, False, False, False, True, False]
    assert [rows[i].base_failed for i in range(7)] == [False, False, True, True, True, False, True]
    spread = " ".join(prose.split()[:100]) + " " + prose + " " + " ".join(prose.split()[300:330])
    row = judge(spark.createDataFrame([(1, spread)], "doc_id long, text string")).first()
    assert not row.base_failed and not row.kept and row.dup_chars_10 * 100 > WINDOW_PERCENT[10] * row.word_chars
