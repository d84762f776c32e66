"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over labelled text. A text is parsed greedily
against it: each phrase is the longest match that the training text holds, and the next phrase
starts behind it. Phrases, times the logarithm of the training length, over the text's length
estimate the cross entropy of the text under the language; the lowest wins.

The automata are laid out as one table, (state, letter) to (next state, whether a phrase broke),
in which a missing transition already points to where the next phrase goes on. So a batch of
texts is parsed against all languages at once, one table look-up for each letter and language.
Every letter of the training text is told apart. A language has columns for its `COLUMNS` most
frequent letters; transitions by its other letters, as scripts of thousands of signs have them, are
looked up in a sorted list.

Training text is bounded: `docs_each` documents per language, those of smallest hash of their id,
`doc_chars` characters from each, and `lang_chars` of a language, however many languages there
are. A worker's tables take up to 15 MB a language.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import map_batches

OUT = "doc_id long, held_out boolean, lang_pred string, score double"
UNKNOWN = "und"
#: Letters of a language that have a column of the table; column 0 is for what is not a letter.
COLUMNS = 62
#: Texts are parsed in pieces of so many letters; a phrase ends with its piece.
PIECE = 1024


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the minimal automaton of all substrings, built symbol by symbol."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for symbol in symbols:
        here = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and symbol not in step[at]:
            step[at][symbol] = here
            at = link[at]
        if at >= 0:
            there = step[at][symbol]
            if length[there] == length[at] + 1:
                link[here] = there
            else:
                twin = len(step)
                step.append(dict(step[there]))
                length.append(length[at] + 1)
                link.append(link[there])
                while at >= 0 and step[at].get(symbol) == there:
                    step[at][symbol] = twin
                    at = link[at]
                link[there] = link[here] = twin
        last = here
    return step


class _Table:
    """One language's automaton: rows of its frequent letters, and a sorted list for the others.

    A cell is the row of the next state, doubled, and 1 if a phrase broke before the letter.
    """

    def __init__(self, step: list[dict[int, int]], symbols: np.ndarray, known: int, base: int) -> None:
        found = np.bincount(symbols, minlength=known + 1)
        found[0] = 0
        order = np.lexsort((np.arange(known + 1), -found))
        frequent = order[: min(COLUMNS, int((found > 0).sum()))]
        other = len(frequent) + 1
        self.base, self.width, self.known = base, other + 1, known
        # The last column is for all letters without one.
        self.column = np.full(known + 1, other, np.uint8)
        self.column[0], self.column[frequent] = 0, np.arange(1, other)
        self.is_rare = (found > 0) & (self.column == other)
        # One more state, the last: behind a letter that the training text lacks.
        first = np.full(self.width, self._row(len(step)) << 1 | 1, np.int64)
        for symbol, there in step[0].items():
            if not self.is_rare[symbol]:
                first[self.column[symbol]] = self._row(there) << 1 | 1
        table = np.tile(first, (len(step) + 1, 1))
        table[0] -= 1
        rare: list[tuple[int, int]] = []
        for state, row in enumerate(step):
            for symbol, there in row.items():
                if self.is_rare[symbol]:
                    rare.append((state * (known + 1) + symbol, self._row(there)))
                else:
                    table[state, self.column[symbol]] = self._row(there) << 1
        self.rows: np.ndarray | None = table.ravel()
        rare.sort()
        self.keys = np.array([x for x, _ in rare], np.int64)
        self.there = np.array([x for _, x in rare], np.int64)

    def _row(self, state: int) -> int:
        return self.base + state * self.width

    def rare_steps(self, at: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Cells for letters of this language that have no column; the root has a step for each."""
        keys = (at.astype(np.int64) - self.base) // self.width * (self.known + 1) + symbols
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[place] == keys
        from_root = np.searchsorted(self.keys, symbols)
        return np.where(known, self.there[place] << 1, self.there[from_root] << 1 | 1)


class Model:
    """Training text by language; the tables are built where they are used."""

    def __init__(self, texts: dict[str, str]) -> None:
        self.texts = dict(sorted(texts.items()))
        self.table: np.ndarray | None = None

    def __getstate__(self) -> dict[str, str]:
        return self.texts

    def __setstate__(self, texts: dict[str, str]) -> None:
        self.texts, self.table = texts, None

    def build(self) -> None:
        letters = sorted({x for text in self.texts.values() for x in text.lower() if x.isalpha()})
        #: 0 is no letter, the last a letter that no language has.
        self.known = len(letters) + 1
        self.class_of = np.zeros(0x110000, np.int32)
        for code in range(0x110000):
            if chr(code).isalpha():
                self.class_of[code] = self.known
        for i, x in enumerate(letters, 1):
            self.class_of[ord(x)] = i
        self.names, self.bits, self.parts, tables, base = [], [], [], [], 0
        for name, text in self.texts.items():
            symbols = self.symbols(text)
            part = _Table(suffix_automaton(symbols.tolist()), symbols, self.known, base)
            self.names.append(name)
            self.bits.append(math.log2(max(2, len(symbols))))
            self.parts.append(part)
            tables.append(part.rows)
            base += len(part.rows)
            part.rows = None
        wide = np.int32 if 2 * base < 1 << 31 else np.int64
        self.table = np.concatenate(tables).astype(wide) if tables else np.zeros(0, wide)

    def symbols(self, text: str | None) -> np.ndarray:
        """Numbers of the letters, lower case; a run of anything else is one 0."""
        codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
        classes = self.class_of[codes]
        gap = classes == 0
        gap[1:] &= classes[:-1] == 0
        gap[:1] = False
        return classes[~gap]

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrase counts, one row per language and one column per text."""
        sizes = np.array([len(x) for x in texts], np.int64)
        pieces = -(-sizes // PIECE)
        owner = np.repeat(np.arange(len(texts)), pieces)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = np.repeat(np.cumsum(sizes) - sizes, pieces) + within * PIECE
        length = np.minimum(PIECE, sizes[owner] - within * PIECE)
        order = np.argsort(-length, kind="stable")
        owner, start, length = owner[order], start[order], length[order]
        everything = np.concatenate([*texts, np.zeros(0, np.int32)])
        columns = np.stack([part.column[everything] for part in self.parts])
        rare = {i: part.is_rare[everything] for i, part in enumerate(self.parts) if part.is_rare.any()}
        roots = np.array([part.base for part in self.parts], self.table.dtype)
        at = np.repeat(roots[:, None], len(owner), 1)
        counts = np.ones((len(self.names), len(owner)), np.int32)
        live = np.searchsorted(-length, -np.arange(PIECE), "left")  # pieces longer than t
        for t in range(int(length[0]) if len(length) else 0):
            k = live[t]
            here = start[:k] + t
            value = self.table.take(at[:, :k] + columns[:, here])
            for i, flags in rare.items():
                places = np.flatnonzero(flags[here])
                if len(places):
                    value[i, places] = self.parts[i].rare_steps(at[i, places], everything[here[places]])
            counts[:, :k] += value & 1
            at[:, :k] = value >> 1
        total = np.zeros((len(self.names), len(texts)), np.int64)
        for i in range(len(self.names)):
            total[i] = np.bincount(owner, counts[i], len(texts)).astype(np.int64)
        return total

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text. Ties go to the first language in name order.

        The score sets the runner-up's entropy against the sum of both: 0.5 for a tie, and 1 for
        an only language.
        """
        if self.table is None:
            self.build()
        if not self.names:
            return [(UNKNOWN, 0.0)] * len(texts)
        symbols = [self.symbols(x) for x in texts]
        entropy = self.phrases(symbols) * np.array(self.bits)[:, None]
        best = entropy.argmin(0)
        top = np.take_along_axis(entropy, best[None], 0)[0]
        np.put_along_axis(entropy, best[None], np.inf, 0)
        second = entropy.min(0)
        score = np.where(np.isinf(second), 1.0, second / np.where(np.isinf(second), 1.0, np.maximum(top + second, 1e-9)))
        return [
            (self.names[i], float(s)) if x.any() else (UNKNOWN, 0.0)
            for i, s, x in zip(best, score, symbols, strict=True)
        ]


def train(
    docs: DataFrame, usable: Column, docs_each: int = 64, doc_chars: int = 2_000, lang_chars: int = 40_000
) -> Model:
    """Learn from the documents for which `usable` holds and whose text and lang are not null.

    Languages whose text holds no letter are not learned. The rank is limited before the shuffle
    (a group limit), so a language that most rows have sends `docs_each` rows from each task.
    """
    rows = docs.filter(usable & F.col("text").isNotNull() & F.col("lang").isNotNull()).select(
        F.col("doc_id").alias("id"), F.col("lang").alias("name"), F.col("text").alias("body")
    )
    order = Window.partitionBy("name").orderBy(F.xxhash64("id"), "id")
    # The text is cut only here, where the bounded sample is taken.
    chosen = (
        rows.select("id", "name", F.substring("body", 1, doc_chars).alias("body"))
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= docs_each)
        .orderBy("name", "place")
        .collect()
    )
    parts: dict[str, list[str]] = {}
    for row in chosen:
        parts.setdefault(row["name"], []).append(row["body"])
    texts = {name: "\n".join(found) for name, found in parts.items()}
    texts = {name: text for name, text in texts.items() if any(map(str.isalpha, text))}
    return Model({name: text[:lang_chars] for name, text in texts.items()})


def identify(docs: DataFrame, model: Model, held_out: Column) -> DataFrame:
    """Predict the language of each whole text, one row per input row; no shuffle.

    A text that is null or has no letter gets `und` and 0, as has every text if nothing was
    learned. Repeated rows each give a row; a null id stays null and is not held out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    languages = max(1, len(model.texts))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: list[tuple[str, float]] = []
        texts, size = [], 0
        for x in batch.column(2):
            texts.append(x.as_py())
            size += len(texts[-1] or "")
            if size * languages > 16_000_000:  # bounds the arrays of letters, not what is parsed
                found += shared.value.predict(texts)
                texts, size = [], 0
        found += shared.value.predict(texts) if texts else []
        arrays = [batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    return map_batches(rows, work, OUT)
