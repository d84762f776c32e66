"""Quality rules by repetition coverage: how much of a text lies inside repeated word runs and lines.

A text's words become numbers, and a rolling hash gives every window of n words one 64-bit value:
with S the running sums of word value times base^position, a window is (S[i + n] - S[i]) / base^i.
Windows of equal hash are put side by side by a sort and compared word by word, so the hash only
proposes; where two different windows share a hash, the windows are named by their words instead.
A window of n words can only repeat where both its parts of n - 1 words do, so each length looks at
what the one before it left.

All of this is numpy over the texts of one Arrow batch. Rows are independent: nothing is shuffled,
a lost executor costs its running batches, and memory follows the batch, or its longest text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import map_batches

# What parts words, and what counts as a symbol.
SPACES, IN_WORD, SYMBOLS = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]", r"[#*$%&|<>]"
LEAST_WORDS, BASE_WINDOW, BASE_PERCENT = 50, 3, 50
#: Percent of a text's word characters that may lie in lines, and in n words, seen before.
LINE_PERCENT = 20
WINDOW_PERCENT = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars")
BASE = np.uint64(0x9E3779B97F4A7C15)


class Windows:
    """The words of a batch as numbers, text after text, with rolling hashes of their windows."""

    def __init__(self, words: np.ndarray, owner: np.ndarray, base: np.uint64 = BASE) -> None:
        self.words, self.owner = words, owner
        size = len(words)
        power, back = (np.cumprod(np.full(size + 1, b, np.uint64)) for b in (base, _inverse(base)))
        # A scrambled value per word, so that small numbers do not line up.
        value = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        value ^= value >> np.uint64(31)
        self.sums = np.zeros(size + 1, np.uint64)
        np.cumsum(value * power[:size], out=self.sums[1:])
        self.back = back

    def starts(self, n: int) -> np.ndarray:
        """Positions whose n words belong to one text."""
        at = np.arange(max(0, len(self.words) - n + 1))
        return at[self.owner[at] == self.owner[at + n - 1]]

    def repeated(self, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the windows at these ascending positions: those found twice or more in their text,
        and those among them that are not the first."""
        hashes = (self.sums[at + n] - self.sums[at]) * self.back[at]
        hashes ^= self.owner[at].astype(np.uint64) * np.uint64(0x94D049BB133111EB)
        order = np.argsort(hashes, kind="stable")
        same = hashes[order][1:] == hashes[order][:-1]
        a, b = at[order][1:][same], at[order][:-1][same]
        equal = self.owner[a] == self.owner[b]
        for j in range(n):
            equal &= self.words[a + j] == self.words[b + j]
        if not equal.all():
            rows = np.column_stack([self.owner[at], *(self.words[at + j] for j in range(n))])
            names = np.unique(rows, axis=0, return_inverse=True)[1].ravel()
            order = np.argsort(names, kind="stable")
            same = names[order][1:] == names[order][:-1]
        later = np.concatenate([[False], same]) if len(at) else np.zeros(0, bool)
        several = later.copy()
        several[:-1] |= later[1:]
        return np.sort(at[order[several]]), np.sort(at[order[later]])

    def covered(self, at: np.ndarray, n: int) -> np.ndarray:
        """Which words lie in a window of n words at one of these positions."""
        edges = np.zeros(len(self.words) + 1, np.int32)
        edges[at] += 1
        np.subtract.at(edges, at + n, 1)
        return np.cumsum(edges)[:-1] > 0


def measures_of(texts: pa.Array, lengths: tuple[int, ...], base: np.uint64 = BASE) -> dict[str, np.ndarray]:
    """MEASURES and `dup_chars_n` for each n of `lengths`, one value per text."""
    texts = pc.fill_null(texts, "")
    size = len(texts)
    parts = pc.split_pattern_regex(texts, SPACES)
    words, owner = pc.list_flatten(parts), pc.list_parent_indices(parts).to_numpy()
    real = pc.not_equal(words, "")
    words, owner = words.filter(real).dictionary_encode(), owner[real.to_numpy(zero_copy_only=False)]
    numbers = words.indices.to_numpy().astype(np.int64)
    chars = pc.utf8_length(words.dictionary).to_numpy()[numbers].astype(np.int64)

    def per_text(rows: np.ndarray, amounts: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(rows, amounts, size).astype(np.int64)

    out = {
        "n_words": per_text(owner),
        "word_chars": per_text(owner, chars),
        "n_symbols": pc.count_substring_regex(texts, SYMBOLS).to_numpy().astype(np.int64),
    }
    windows = Windows(numbers, owner, base)
    several, _ = windows.repeated(windows.starts(BASE_WINDOW), BASE_WINDOW)
    out["n_repeat_words"] = per_text(owner[windows.covered(several, BASE_WINDOW)])
    wanted, later = set(lengths), {}
    for n in range(BASE_WINDOW + 1, max(lengths, default=0) + 1):
        # Both windows of n - 1 words are repeated, so both lie in the text; whether the n do is asked.
        at = several[np.isin(several + 1, several, assume_unique=True)]
        at = at[self_contained(owner, at, n)]
        several, later[n] = windows.repeated(at, n)
    for n in sorted(wanted):
        inside = windows.covered(later[n], n)
        out[f"dup_chars_{n}"] = per_text(owner[inside], chars[inside])
    out["n_dup_lines"], out["dup_line_chars"] = _lines(texts, per_text)
    return out


def self_contained(owner: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    end = at + n - 1
    inside = end < len(owner)
    inside[inside] = owner[end[inside]] == owner[at[inside]]
    return inside


def _lines(texts: pa.Array, per_text) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
    """Lines with a word that equal an earlier line of their text: how many, and their word characters."""
    parts = pc.split_pattern(texts, "\n")
    lines, owner = pc.list_flatten(parts), pc.list_parent_indices(parts).to_numpy()
    worded = pc.match_substring_regex(lines, IN_WORD)
    lines, owner = lines.filter(worded), owner[worded.to_numpy(zero_copy_only=False)]
    coded = lines.dictionary_encode()
    keys = owner.astype(np.int64) * max(1, len(coded.dictionary)) + coded.indices.to_numpy()
    later = np.ones(len(keys), bool)
    later[np.unique(keys, return_index=True)[1]] = False
    bare = pc.replace_substring_regex(lines.filter(pa.array(later)), SPACES, "")
    return per_text(owner[later]), per_text(owner[later], pc.utf8_length(bare).to_numpy().astype(np.int64))


def _inverse(odd: np.uint64) -> np.uint64:
    return np.uint64(pow(int(odd), -1, 1 << 64))


def measure(
    docs: DataFrame, lengths: tuple[int, ...] = tuple(WINDOW_PERCENT), id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, MEASURES, dup_chars_n ..), one row per input row; all whole numbers.

    Words are runs of anything but space and \\x09 to \\x0D. `n_repeat_words` counts the words in
    windows of three that are found twice or more, the first included; `dup_chars_n` the characters
    of the words in windows of n that are found earlier in the text, and `dup_line_chars` those in
    lines equal to an earlier one. A null or empty text, or one of spaces, has zeros. Repeated rows
    each give a row, and a null id stays null. Every length must be above three.
    """
    if any(n <= BASE_WINDOW for n in lengths):
        raise ValueError(f"lengths must be above {BASE_WINDOW}")
    names = (*MEASURES, *(f"dup_chars_{n}" for n in lengths))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = measures_of(batch.column(1), lengths)
        arrays = [batch.column(0), *(pa.array(found[x], pa.int64()) for x in names)]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", *names])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_batches(rows, work, ", ".join(["doc_id long", *(f"{x} long" for x in names)]))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > BASE_PERCENT * F.col("n_words"))


def repetitive(line_percent: int = LINE_PERCENT, window_percent: dict[int, int] = WINDOW_PERCENT) -> Column:
    """More of the word characters lie in earlier lines, or in earlier windows of some length, than may."""
    out = 100 * F.col("dup_line_chars") > line_percent * F.col("word_chars")
    for n, percent in window_percent.items():
        out |= 100 * F.col(f"dup_chars_{n}") > percent * F.col("word_chars")
    return out


def judge(docs: DataFrame) -> DataFrame:
    """The measures with `base_failed` and `kept`; shares are compared in whole numbers."""
    measured = measure(docs).withColumn("base_failed", base_failed())
    return measured.withColumn("kept", ~F.col("base_failed") & ~repetitive())


def oracle() -> str:
    """DuckDB SQL for `judge` over documents."""
    lengths = [BASE_WINDOW, *WINDOW_PERCENT]
    seen = [
        f"CASE WHEN run_{n} IS NOT NULL THEN row_number() OVER w{n} END AS nth_{n}, "
        f"CASE WHEN run_{n} IS NOT NULL THEN count(*) OVER (PARTITION BY row_id, run_{n}) END AS of_{n}"
        for n in lengths
    ]
    # Null where the text ends before the window does.
    runs = ["word" + "".join(f" || ' ' || lead(word, {j}) OVER text" for j in range(1, n)) + f" AS run_{n}" for n in lengths]
    frames = [f"w{n} AS (PARTITION BY row_id, run_{n} ORDER BY pos)" for n in lengths]
    cover = [
        f"max(CASE WHEN {'of' if n == BASE_WINDOW else 'nth'}_{n} > 1 THEN 1 ELSE 0 END) OVER "
        f"(PARTITION BY row_id ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS in_{n}"
        for n in lengths
    ]
    sums = ", ".join(f"sum(in_{n} * length(word)) AS dup_chars_{n}" for n in WINDOW_PERCENT)
    outs = ", ".join(f"coalesce(dup_chars_{n}, 0)::BIGINT AS dup_chars_{n}" for n in WINDOW_PERCENT)
    over = " OR ".join(f"100 * dup_chars_{n} > {percent} * word_chars" for n, percent in WINDOW_PERCENT.items())
    return f"""
    WITH page AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents),
    cut AS (SELECT row_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM page),
    spread AS (SELECT row_id, unnest(words) AS word, unnest(range(len(words))) AS pos FROM cut),
    runs AS (SELECT row_id, pos, word, {", ".join(runs)} FROM spread WINDOW text AS (PARTITION BY row_id ORDER BY pos)),
    seen AS (SELECT row_id, pos, word, {", ".join(seen)} FROM runs WINDOW {", ".join(frames)}),
    cover AS (SELECT row_id, word, {", ".join(cover)} FROM seen),
    counted AS (
        SELECT row_id, count(*) AS n_words, sum(length(word)) AS word_chars,
            sum(in_{BASE_WINDOW}) AS n_repeat_words, {sums}
        FROM cover GROUP BY row_id
    ),
    line AS (SELECT row_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM page),
    later AS (
        SELECT row_id, line, row_number() OVER (PARTITION BY row_id, line ORDER BY pos) AS nth
        FROM line WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
    ),
    lines AS (
        SELECT row_id, count(*) AS n_dup_lines, sum(length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g'))) AS dup_line_chars
        FROM later WHERE nth > 1 GROUP BY row_id
    ),
    measured AS (
        SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
            (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
            coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
            coalesce(dup_line_chars, 0)::BIGINT AS dup_line_chars, {outs}
        FROM page LEFT JOIN counted USING (row_id) LEFT JOIN lines USING (row_id)
    )
    SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {BASE_PERCENT} * n_words AS base_failed,
        NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {BASE_PERCENT} * n_words
            OR 100 * dup_line_chars > {LINE_PERCENT} * word_chars OR {over}) AS kept
    FROM measured
    """
