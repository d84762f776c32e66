"""Benchmark decontamination: a BM25 index of test items, searched with every training passage.

Items (question and answer) form an inverted index. A posting's impact is the term's BM25 weight in
the item over the least score that a passage holding `SIMILARITY` of the item's five-word shingles
can have: the item's whole score without its heaviest terms, as many as lost shingles can uncover
(_least).
So one threshold, 1, fits all items and loses none that the check below would accept.

Passages are overlapping windows of each document's words, long enough that an item lies whole in
one of them. They are searched with block-max WAND. The index keeps the largest impact of each term
in each block of items. For all windows of a batch at once the live blocks are found, those whose
largest impacts add up to the threshold; blocks that are not live are skipped unread. In a live
block the terms' cursors move by the WAND rule: the pivot is the first item at which the bounds of
the lists up to it reach the threshold, and only a pivot on which the lists agree is scored.

What is above the threshold is checked exactly: shingles of the item, shingles of the question, and
words of the answer in the window.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import map_batches, words_of

WORDS, SIMILARITY, PART = 5, 0.8, 0.5
K1, B = 1.2, 0.75
#: Items in a block, and characters of items in one index (a broadcast of a few times that size).
BLOCK, INDEX_CHARS = 8, 4 << 20
#: Words whose windows are searched at once.
BATCH_WORDS = 400_000

# The last sentence of an item and what stands before it.
LAST = r"(?s)^(.*[.!?])\s+(.*\S)\s*$"

OUT = "doc_id long, item_id long, overlap double, question_overlap double, answer_overlap double"


def shingles(words: list[str]) -> list[tuple[str, ...]]:
    """Five words in a row; a shorter text is one shingle."""
    if len(words) < WORDS:
        return [tuple(words)] if words else []
    return list(zip(*(words[i:] for i in range(WORDS)), strict=False))


class Index:
    """Postings of a bounded number of items, with block maxima, and what the check needs."""

    def __init__(self, items: list[tuple[int, str, str]]) -> None:
        parsed = [(i, words_of(q), words_of(a)) for i, q, a in sorted(items, key=lambda x: (x[0], x[1] or "", x[2] or ""))]
        self.items = [x for x in parsed if x[1] or x[2]]
        self.whole = [frozenset(shingles(q + a)) for _, q, a in self.items]
        self.question = [frozenset(shingles(q)) for _, q, _ in self.items]
        self.answer = [frozenset(a) for _, _, a in self.items]
        lengths = [len(q) + len(a) for _, q, a in self.items]
        # Sizes of shingles that are a whole short item or question.
        self.short = sorted({len(x) for found in (*self.whole, *self.question) for x in found} - {WORDS})
        self.longest = max(lengths, default=0)
        self.overlap = max(WORDS, self.longest * 5 // 4)
        self.stride = 2 * self.overlap
        n, mean = len(self.items), sum(lengths) / max(1, len(lengths))
        found = Counter(t for _, q, a in self.items for t in set(q + a))
        self.vocabulary = {t: i for i, t in enumerate(sorted(found))}
        rows: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for i, (_, q, a) in enumerate(self.items):
            weights = {}
            for term, tf in Counter(q + a).items():
                idf = math.log(1 + (n - found[term] + 0.5) / (found[term] + 0.5))
                weights[term] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[i] / mean))
            least = self._least(q + a, weights)
            for term, weight in weights.items():
                rows[self.vocabulary[term]].append((i, weight / least))
        self.postings = [rows[t] for t in range(len(self.vocabulary))]
        maxima = [sorted(self._maxima(x).items()) for x in self.postings]
        self.blocks = -(-n // BLOCK)
        self.first = np.cumsum([0, *map(len, maxima)])
        self.block = np.array([b for x in maxima for b, _ in x], np.int64)
        self.most = np.array([m for x in maxima for _, m in x], np.float64)

    @staticmethod
    def _least(words: list[str], weights: dict[str, float]) -> float:
        """The least score of a passage that still holds enough of the item's shingles; above 0.

        A term is lacking only if all shingles with it are lost. So the lost shingles bound the number
        of lacking terms by their occurrences, and the shingles that all lacking terms are in, added
        up, by the terms of the fullest ones. The second bound leaves some weight in any text, as
        not all shingles are lost; the first is the closer one where shingles hardly repeat.
        """
        times = Counter(shingles(words))
        may = len(times) - math.ceil(SIMILARITY * len(times) - 1e-9)
        if not may:
            return math.fsum(weights.values())
        within = Counter(t for x in times for t in set(x))
        lost = sum(sorted(times.values())[-may:])
        light = sorted((t for t in weights if within[t] <= may), key=weights.get, reverse=True)[lost:]
        by_number = math.fsum(w for t, w in weights.items() if within[t] > may) + math.fsum(map(weights.get, light))
        room, kept = sum(sorted(len(set(x)) for x in times)[-may:]), []
        for term in sorted(weights, key=lambda t: weights[t] / within[t], reverse=True):
            gone = min(room, within[term]) if within[term] <= may else 0
            room -= gone
            kept.append(weights[term] * (within[term] - gone) / within[term])
        return max(by_number, math.fsum(kept))

    @staticmethod
    def _maxima(postings: list[tuple[int, float]]) -> dict[int, float]:
        out: dict[int, float] = {}
        for item, impact in postings:
            out[item // BLOCK] = max(impact, out.get(item // BLOCK, 0.0))
        return out

    def search(self, docs: list[list[str]]) -> list[list[tuple[int, int]]]:
        """For each document the (window start, item) pairs that reach the threshold."""
        out: list[list[tuple[int, int]]] = [[] for _ in docs]
        sizes = np.array([len(x) for x in docs], np.int64)
        total = int(sizes.sum())
        if not total or not self.items:
            return out
        get = self.vocabulary.get
        terms = np.array([get(word, -1) for words in docs for word in words], np.int64)
        at = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        counts = -(-sizes // self.stride)
        base = np.cumsum(counts) - counts
        known = terms >= 0
        terms, at, base_of = terms[known], at[known], np.repeat(base, sizes)[known]
        window = base_of + at // self.stride
        also = (at % self.stride < self.overlap) & (at >= self.stride)
        size = len(self.vocabulary)
        pairs = np.unique(np.concatenate([window * size + terms, (window[also] - 1) * size + terms[also]]))
        window, terms = pairs // size, pairs % size
        # Live blocks: add up the block maxima of each window's terms.
        times = self.first[terms + 1] - self.first[terms]
        place = np.repeat(self.first[terms] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
        bounds = np.bincount(np.repeat(window, times) * self.blocks + self.block[place], self.most[place], int(counts.sum()) * self.blocks)
        live = np.flatnonzero(bounds >= 1 - 1e-9)
        if not len(live):
            return out
        begin = np.searchsorted(window, np.arange(int(counts.sum()) + 1))
        owner = np.repeat(np.arange(len(docs)), counts)
        for key in live.tolist():
            w, block = divmod(key, self.blocks)
            doc = int(owner[w])
            for item in self._wand(terms[begin[w] : begin[w + 1]].tolist(), block):
                out[doc].append(((w - int(base[doc])) * self.stride, item))
        return out

    def _wand(self, terms: list[int], block: int) -> list[int]:
        """Items of a block that reach the threshold, by moving the terms' cursors."""
        low, high = block * BLOCK, (block + 1) * BLOCK
        lists = []
        for term in terms:
            own = [x for x in self.postings[term] if low <= x[0] < high]
            if own:
                lists.append([own, 0, max(x for _, x in own)])
        found = []
        while True:
            lists = sorted((x for x in lists if x[1] < len(x[0])), key=lambda x: x[0][x[1]][0])
            bound, pivot = 0.0, None
            for own, at, most in lists:
                bound += most
                if bound >= 1 - 1e-9:
                    pivot = own[at][0]
                    break
            if pivot is None:
                return found
            if lists[0][0][lists[0][1]][0] == pivot:
                score = 0.0
                for x in lists:
                    item, impact = x[0][x[1]]
                    if item == pivot:
                        score += impact
                        x[1] += 1
                if score >= 1 - 1e-9:
                    found.append(pivot)
            else:
                for x in lists:
                    while x[1] < len(x[0]) and x[0][x[1]][0] < pivot:
                        x[1] += 1

    def check(self, words: list[str], found: list[tuple[int, int]]) -> list[tuple[int, float, float, float]]:
        """(item id, overlaps) of the retrieved items that a window really holds; the best window."""
        best: dict[int, tuple[float, float, float]] = {}
        windows: dict[int, tuple[set, set]] = {}
        for start, item in found:
            if start not in windows:
                own = words[start : start + self.stride + self.overlap]
                held = set(shingles(own))
                for n in self.short:
                    held.update(zip(*(own[i:] for i in range(n)), strict=False))
                windows[start] = held, set(own)
            held, present = windows[start]
            whole, question, answer = self.whole[item], self.question[item], self.answer[item]
            marks = (
                len(whole & held) / len(whole),
                len(question & held) / len(question) if question else 1.0,
                len(answer & present) / len(answer) if answer else 1.0,
            )
            if marks[0] >= SIMILARITY and marks[1] >= PART and marks[2] >= PART:
                key = self.items[item][0]
                best[key] = max(marks, best.get(key, marks))
        return [(key, *marks) for key, marks in sorted(best.items())]


def build_indexes(items: DataFrame) -> list[Index]:
    """Indexes over (item_id, question, answer) rows: one per INDEX_CHARS characters of items.

    Each is an index of its own with its own statistics. These move scores and thresholds together,
    and the check decides, so the result does not depend on how items are dealt.
    """
    rows = items.filter("item_id IS NOT NULL").select("item_id", "question", "answer").distinct()
    size = F.coalesce(F.length("question"), F.lit(0)) + F.coalesce(F.length("answer"), F.lit(0)) + 16
    chars = rows.agg(F.sum(size)).first()[0] or 0
    shards = max(1, math.ceil(1.5 * chars / INDEX_CHARS)) if chars > INDEX_CHARS else 1
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("item_id", "question", "answer"), F.lit(shards)))
    indexes = [
        Index([(r.item_id, r.question, r.answer) for r in dealt.filter(F.col("shard") == i).collect()]) for i in range(shards)
    ]
    overlap = max(index.overlap for index in indexes)  # the same windows for all
    for index in indexes:
        index.overlap, index.stride = overlap, 2 * overlap
    return indexes


def find_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, overlaps) for every document that holds a test item; one row per input row and item.

    Null texts, null items and items without words hold nothing. Items that share an id are one
    item's versions, of which the best counts. Documents are not shuffled.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))

    def search(index: Index) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            out: list[tuple] = []
            for ids, docs_words in _chunks(batch):
                for doc_id, words, found in zip(ids, docs_words, shared.value.search(docs_words), strict=True):
                    if found:
                        out += [(doc_id, *x) for x in shared.value.check(words, found)]
            if not out:
                return None
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            arrays = [pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in OUT.split(", ")])

        return map_batches(rows, work, OUT)

    return reduce(DataFrame.unionByName, map(search, build_indexes(items)))


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows, with all their columns, that hold no test item."""
    at = docs.columns.index("text")
    for index in build_indexes(items):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def work(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:  # noqa: ANN001
            keep: list[bool] = []
            for _, docs_words in _chunks(batch, at):
                for words, found in zip(docs_words, shared.value.search(docs_words), strict=True):
                    keep.append(not (found and shared.value.check(words, found)))
            return batch.filter(pa.array(keep, pa.bool_()))

        docs = map_batches(docs, work, docs.schema)
    return docs


def _chunks(batch: pa.RecordBatch, at: int = 1):  # noqa: ANN202
    """Ids and words of a batch's rows, in runs of bounded size or single documents."""
    ids, docs, size = [], [], 0
    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(at), strict=True):
        ids.append(doc_id)
        docs.append(words_of(text.as_py()))
        size += len(docs[-1])
        if size >= BATCH_WORDS:
            yield ids, docs
            ids, docs, size = [], [], 0
    if ids:
        yield ids, docs


def question_and_answer(items: DataFrame) -> DataFrame:
    """(item_id, question, answer) from (item_id, text): the answer is the last sentence, if any stands before it."""
    body = F.col("text")
    answer = F.regexp_extract(body, LAST, 2)
    question = F.when(answer == "", body).otherwise(F.regexp_extract(body, LAST, 1))
    return items.select(F.col("item_id").cast("long").alias("item_id"), question.alias("question"), answer.alias("answer"))


def oracle() -> str:
    """The rows of the registered query in DuckDB: overlaps of every window, without an index."""
    split = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+')"
    last = LAST.replace("'", "''")
    wanted = " UNION ".join(
        f"""
        SELECT DISTINCT item_id, '{kind}' AS kind, least(len({w}), {most}) AS n,
            array_to_string(list_slice({w}, i, i + least(len({w}), {most}) - 1), ' ') AS shingle
        FROM (SELECT *, unnest(range(1, len({w}) - least(len({w}), {most}) + 2)) AS i FROM item WHERE len({w}) > 0)"""
        for kind, w, most in (("whole", "q || a", WORDS), ("question", "q", WORDS), ("answer", "a", 1))
    )
    return f"""
    WITH part AS (
        SELECT item_id, text, regexp_extract(text, '{last}', 2) AS answer, regexp_extract(text, '{last}', 1) AS before
        FROM benchmark WHERE item_id IS NOT NULL
    ),
    item AS (
        SELECT item_id, {split.format("coalesce(CASE WHEN answer = '' THEN text ELSE before END, '')")} AS q,
            {split.format("coalesce(answer, '')")} AS a
        FROM part
    ),
    size AS (SELECT greatest({WORDS}, max(len(q || a)) * 5 // 4) AS l FROM item),
    wanted AS ({wanted}),
    body AS (SELECT row_number() OVER () AS row_id, doc_id, {split.format("coalesce(text, '')")} AS w FROM documents),
    place AS (
        SELECT row_id, doc_id, n, i - 1 AS pos, array_to_string(list_slice(w, i, i + n - 1), ' ') AS shingle
        FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM body, (SELECT DISTINCT n FROM wanted))
    ),
    hit AS (
        SELECT row_id, doc_id, item_id, kind, shingle, k
        FROM (SELECT *, unnest([pos // (2 * l), pos // (2 * l) - 1]) AS k FROM place JOIN wanted USING (n, shingle), size), size
        WHERE k >= 0 AND pos + n <= k * 2 * size.l + 3 * size.l
    ),
    total AS (SELECT item_id, kind, count(*) AS n FROM wanted GROUP BY ALL),
    share AS (
        SELECT row_id, doc_id, k, item_id, kind, count(DISTINCT shingle) / any_value(total.n) AS x
        FROM hit JOIN total USING (item_id, kind) GROUP BY row_id, doc_id, k, item_id, kind
    ),
    marks AS (
        SELECT row_id, doc_id, item_id, k, max(x) FILTER (kind = 'whole') AS overlap,
            CASE WHEN item_id IN (SELECT item_id FROM total WHERE kind = 'question')
                THEN coalesce(max(x) FILTER (kind = 'question'), 0) ELSE 1.0 END AS question_overlap,
            CASE WHEN item_id IN (SELECT item_id FROM total WHERE kind = 'answer')
                THEN coalesce(max(x) FILTER (kind = 'answer'), 0) ELSE 1.0 END AS answer_overlap
        FROM share GROUP BY row_id, doc_id, item_id, k
    )
    SELECT doc_id, item_id, overlap, question_overlap, answer_overlap FROM (
        SELECT *, row_number() OVER (
            PARTITION BY row_id, item_id ORDER BY overlap DESC, question_overlap DESC, answer_overlap DESC) AS place
        FROM marks WHERE overlap >= {SIMILARITY} AND question_overlap >= {PART} AND answer_overlap >= {PART}
    ) WHERE place = 1
    """
