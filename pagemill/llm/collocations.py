"""Phrase collocations by dynamic itemset counting.

The documents are dealt into `shards`, which are scanned one after another, round and round. All
phrase lengths are counted at once: words from the first scan on, and a longer phrase from the scan
after that in which both its subphrases (without its last, without its first word) reached the
threshold by the counts so far. A phrase is counted for one full cycle from then on, that is once
in each shard, so its count is exact wherever its cycle began; phrases that end a cycle below the
threshold are forgotten. A phrase that occurs often enough has subphrases that do, so none is missed.

What a scan has to know is which subphrases reached the threshold, and when. This is one array of
`cells` bytes, broadcast to every scan: a phrase's hash names a cell, and the cell holds the number
of the scan that filled it. So a task decides by itself what to count, without a join of the words
with a vocabulary. Phrases that share a cell may be activated early or in vain, which costs counting
and changes no count: the cycle of a phrase is read from the same cells in every scan. The array
does not grow with the corpus; with many more frequent phrases than cells it screens less.

Scans name a phrase by a 64-bit hash, which keeps what is shuffled narrow. Phrases that share one
are counted together, so a count is never too low. One more scan then counts the phrases that are
left by their words, exactly; it knows them by a bitmap of fixed size (`BITS`, two bits a phrase).

A scan counts inside each Arrow batch, then per task, and then by phrase, so a phrase that a third
of the corpus holds is one row per task. Everything between scans is a written table. The driver
gets bitmaps of what is new, of fixed size, and no phrase.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import map_batches
from pagemill.session import cut, look_up

# What ends a piece, and what parts words.
BREAKS, SPACES = r"[.,;:!?\x0A-\x0D]+", r"[\x20\x09]+"
LEAST, LONGEST, TOP, INSIDE_PERCENT, UNKNOWN = 10, 3, 2_000, 50, "und"
SHARDS, CELLS, BITS = 2, 1 << 24, 1 << 26
UNFILLED = 255

HASHED = "h long, size int, since int, n long"
NAMED = "lang string, size int, phrase string, n long"


def _mixed(value: np.ndarray) -> np.ndarray:
    value = (value ^ (value >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return value ^ (value >> np.uint64(29))


class Phrases:
    """The words of a batch in a row, with breaks between pieces, and what is counted of them."""

    def __init__(self, langs: pa.Array, texts: pa.Array) -> None:
        spaced = pc.replace_substring_regex(pc.ascii_lower(texts), BREAKS, " \n ")
        # Every text begins with a break, so no phrase spans two texts.
        parts = pc.split_pattern_regex(pc.binary_join_element_wise("\n", spaced, " "), SPACES)
        words, owner = pc.list_flatten(parts), pc.list_parent_indices(parts)
        real = pc.not_equal(words, "")
        words, owner = words.filter(real).dictionary_encode(), owner.filter(real).to_numpy()
        self.vocabulary, self.word = words.dictionary, words.indices.to_numpy().astype(np.int64)
        self.langs = langs.dictionary_encode()
        self.lang = self.langs.indices.to_numpy().astype(np.int64)[owner]
        hashes, of_lang = (
            pd.util.hash_array(x.to_numpy(zero_copy_only=False), categorize=False) for x in (self.vocabulary, self.langs.dictionary)
        )
        self.word_hash = hashes[self.word]
        self.hash = _mixed(self.word_hash ^ _mixed(of_lang[self.lang]))
        self.whole = ~pc.equal(self.vocabulary, "\n").to_numpy(zero_copy_only=False)[self.word]
        self.size = 1

    def lengthen(self) -> None:
        """From phrases of some words at each position to those of one word more."""
        self.hash = _mixed(self.hash[:-1] * np.uint64(0x9E3779B97F4A7C15) + self.word_hash[self.size :])
        self.whole = self.whole[:-1] & self.whole[1:]
        self.size += 1

    def count_hashes(self, at: np.ndarray, since: np.ndarray) -> list[pa.Array]:
        """Rows of HASHED for the phrases at these positions."""
        names, hashes = pd.factorize(self.hash[at])
        begun = np.zeros(len(hashes), np.int32)
        begun[names] = since
        n = np.bincount(names, minlength=len(hashes)).astype(np.int64)
        return [pa.array(hashes.view(np.int64)), pa.array(np.full(len(n), self.size, np.int32)), pa.array(begun), pa.array(n)]

    def count_words(self, at: np.ndarray) -> list[pa.Array]:
        """Rows of NAMED for the phrases at these positions, told apart by their words."""
        names = self.lang[at] * len(self.vocabulary) + self.word[at]
        for j in range(1, self.size):
            names = pd.factorize(names)[0] * len(self.vocabulary) + self.word[at + j]
        names, several = pd.factorize(names)
        first = np.zeros(len(several), np.int64)
        first[names[::-1]] = np.arange(len(at))[::-1]
        place = at[first]
        texts = [self.vocabulary.take(pa.array(self.word[place + j])) for j in range(self.size)]
        return [
            self.langs.dictionary.take(pa.array(self.lang[place])),
            pa.array(np.full(len(place), self.size, np.int32)),
            pc.binary_join_element_wise(*texts, " ") if self.size > 1 else texts[0],
            pa.array(np.bincount(names, minlength=len(several)).astype(np.int64)),
        ]

    def totals(self) -> list[pa.Array]:
        """A row of NAMED per language with its number of words, as a phrase of no words."""
        n = np.bincount(self.lang[self.whole], minlength=len(self.langs.dictionary)).astype(np.int64)
        return [self.langs.dictionary, pa.array(np.zeros(len(n), np.int32)), pa.array([""] * len(n), pa.string()), pa.array(n)]


def _batch(rows: list[list[pa.Array]], schema: str) -> pa.RecordBatch | None:
    names = [x.split()[0] for x in schema.split(", ")]
    batches = [pa.RecordBatch.from_arrays(x, names) for x in rows if len(x[0])]
    return pa.concat_batches(batches) if batches else None


def scan(langs: pa.Array, texts: pa.Array, filled: np.ndarray, step: int, shards: int, longest: int) -> pa.RecordBatch | None:
    """The counts of one batch in one scan: of the phrases whose cycle this scan belongs to."""
    phrases = Phrases(langs, texts)
    rows = []
    if step < shards:
        at = np.flatnonzero(phrases.whole)
        rows.append(phrases.count_hashes(at, np.zeros(len(at), np.int32)))
    while phrases.size < longest and len(phrases.hash) > 1:
        reached = filled[phrases.hash & np.uint64(len(filled) - 1)]
        phrases.lengthen()
        last = np.maximum(reached[:-1], reached[1:]).astype(np.int32)
        at = np.flatnonzero(phrases.whole & (last != UNFILLED) & (last + 1 > step - shards))
        rows.append(phrases.count_hashes(at, last[at] + 1))
    return _batch(rows, HASHED)


def recount(langs: pa.Array, texts: pa.Array, bitmap: np.ndarray, longest: int) -> pa.RecordBatch | None:
    """The counts of one batch by words: of all phrases the bitmap knows, and of all words together."""
    phrases = Phrases(langs, texts)
    rows, bits = [phrases.totals()], np.uint64(8 * len(bitmap) - 1)
    while True:
        known = phrases.whole.copy()
        for place in (phrases.hash & bits, (phrases.hash >> np.uint64(32)) & bits):
            known &= (bitmap[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
        rows.append(phrases.count_words(np.flatnonzero(known)))
        if phrases.size == longest or len(phrases.hash) < 2:
            return _batch(rows, NAMED)
        phrases.lengthen()


def _bitmap(places: DataFrame, size: int) -> np.ndarray:
    """Bytes in which bit i says whether i, from 0 to `size`, is among `places`; put together in tasks."""
    at = F.col("place") + 1
    rows = places.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")
    )
    out = np.zeros(max(1, size // 8), np.uint8)
    for row in rows.collect():
        bits = np.frombuffer(row["bits"], np.uint8)
        begin = (row["part"] - 1) * len(bits)
        out[begin : begin + len(bits)] = bits[: len(out) - begin]
    return out


@dataclass(frozen=True)
class Counts:
    """(lang, size, phrase, n) of all phrases found `least` times or more, and words per language."""

    frequent: DataFrame
    words: DataFrame
    scans: int


def count_phrases(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, shards: int = SHARDS, cells: int = CELLS,
    bits: int = BITS, lang: str = "lang", text: str = "text",
) -> Counts:
    """Count contiguous phrases of up to `longest` words, per language, by interleaved scans.

    A null language is `und`. Null texts hold no words. A cycle is `shards` scans, and there are at
    most `longest` cycles, and the recount. `cells` and `bits` are powers of two, at least 64.
    """
    if longest * shards >= UNFILLED:
        raise ValueError("too many scans for a byte")
    dealt = cut(
        docs.select(
            F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"),
            F.col(text).cast("string").alias("text"),
            F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int").alias("shard"),
        ).filter("text IS NOT NULL"),
        by="shard",
    )
    filled = np.full(cells, UNFILLED, np.uint8)
    totals, step, last = None, 0, shards - 1
    while step <= last:
        counted = _scan_shard(dealt.filter(F.col("shard") == step % shards), filled, step, shards, longest)
        counted = counted.withColumn("reached", F.lit(False))
        if totals is not None:
            counted = totals.withColumn("reached", F.col("n") >= least).drop("fresh").unionByName(counted)
        agreed = counted.groupBy("h", "size", "since").agg(F.sum("n").alias("n"), F.max("reached").alias("reached"))
        enough = F.col("n") >= least
        in_cycle = F.col("since") + shards - 1 > step
        totals = cut(agreed.filter(enough | in_cycle).withColumn("fresh", enough & ~F.col("reached")).drop("reached"))
        fresh = totals.filter(F.col("fresh") & (F.col("size") < longest))
        new = _bitmap(fresh.select(F.col("h").bitwiseAND(cells - 1).alias("place")), cells)
        new = np.unpackbits(new, bitorder="little")[:cells].astype(bool) & (filled == UNFILLED)
        if new.any():
            filled[new] = step
            last = max(last, step + shards)
        step += 1
    places = F.explode(F.array(F.col("h").bitwiseAND(bits - 1), F.shiftrightunsigned("h", 32).bitwiseAND(bits - 1)))
    bitmap = _bitmap(totals.select(places.alias("place")), bits)
    named = cut(_recount(dealt, bitmap, longest).groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n")).filter(
        (F.col("n") >= least) | (F.col("size") == 0)
    ))
    return Counts(named.filter("size > 0"), named.filter("size = 0").select("lang", "n"), step)


def _scan_shard(shard: DataFrame, filled: np.ndarray, step: int, shards: int, longest: int) -> DataFrame:
    shared = shard.sparkSession.sparkContext.broadcast(filled)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        return scan(batch.column(0), batch.column(1), shared.value, step, shards, longest)

    return map_batches(shard.select("lang", "text"), work, HASHED)


def _recount(dealt: DataFrame, bitmap: np.ndarray, longest: int) -> DataFrame:
    shared = dealt.sparkSession.sparkContext.broadcast(bitmap)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        return recount(batch.column(0), batch.column(1), shared.value, longest)

    return map_batches(dealt.select("lang", "text"), work, NAMED)


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exact: products in 38 decimal digits, whole division."""
    whole = lambda x: x.cast("decimal(19,0)")
    top = (whole(a) * whole(a)).cast("decimal(32,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", top.cast("decimal(38,0)"), (whole(left) * whole(right)).cast("decimal(38,0)"))


def scored(counts: Counts) -> DataFrame:
    """(lang, size, phrase, a, l, r, score) of all frequent phrases of two words or more.

    A phrase is cut after each of its words but the last; the cut of lowest score counts, the
    first of such cuts on ties. Both parts of a frequent phrase are frequent, so they are found.
    """
    frequent = counts.frequent
    at = F.explode(F.sequence(F.lit(1), F.col("size") - 1))
    cuts = frequent.filter("size > 1").select("lang", "size", "phrase", F.col("n").alias("a"), at.alias("k"))
    cuts = cuts.withColumn("left", F.expr("substring_index(phrase, ' ', k)"))
    cuts = cuts.withColumn("right", F.expr("substring(phrase, char_length(left) + 2)"))
    for side in ("left", "right"):
        part = frequent.select("lang", F.col("phrase").alias(side), F.col("n").alias(side[0]))
        cuts = look_up(cuts, part, ["lang", side])
    row = F.struct(score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r")
    best = cuts.groupBy("lang", "size", "phrase", "a").agg(F.min(row).alias("best"))
    return best.select("lang", "size", "phrase", "a", "best.l", "best.r", "best.score")


def inside_longer(counts: Counts, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, longer_n): the count of the most frequent longer phrase that holds the phrase."""
    words = F.split("phrase", " ")
    spans = F.array(
        *[
            F.struct(F.lit(first).alias("first"), F.lit(n).alias("n"))
            for n in range(2, longest)
            for first in range(1, longest - n + 2)
        ]
    )
    longer = counts.frequent.filter("size > 2").select("lang", "size", "n", words.alias("words"), F.explode(spans).alias("span"))
    fits = (F.col("span.n") < F.col("size")) & (F.col("span.first") + F.col("span.n") <= F.col("size") + 1)
    part = F.array_join(F.slice("words", F.col("span.first"), F.col("span.n")), " ")
    return longer.filter(fits).select("lang", part.alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer_n"))


def collocations(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, inside_percent: int = INSIDE_PERCENT,
    shards: int = SHARDS, cells: int = CELLS, bits: int = BITS,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` phrases of each language.

    Ordered by score, then a, both falling, then phrase in byte order. A phrase inside a longer one
    that is found at least `inside_percent` % as often is left out. Repeated rows count as often as
    they occur; empty texts and tables give no row. Ranks are limited in each task before the
    shuffle, so a language that most rows have sends `top` rows from each.
    """
    counts = count_phrases(docs, least, longest, shards, cells, bits)
    rows = scored(counts)
    if longest > 2:
        rows = rows.join(cut(inside_longer(counts, longest)), ["lang", "phrase"], "left")
        held = F.coalesce(100 * F.col("longer_n") >= inside_percent * F.col("a"), F.lit(False))
        rows = rows.filter(~held)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return look_up(best, counts.words, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )


def oracle() -> str:
    """DuckDB SQL for `collocations` over documents."""
    return f"""
    WITH page AS (
        SELECT row_number() OVER () AS row_id, coalesce(lang, '{UNKNOWN}') AS lang,
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
        FROM documents WHERE text IS NOT NULL
    ),
    piece AS (SELECT row_id, lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM page),
    numbered AS (SELECT row_number() OVER () AS piece_id, lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words FROM piece),
    word AS (SELECT piece_id, lang, unnest(words) AS w, unnest(range(len(words))) AS pos FROM numbered),
    run AS (
        SELECT lang, w, lead(w, 1) OVER piece AS w2, lead(w, 2) OVER piece AS w3
        FROM word WINDOW piece AS (PARTITION BY piece_id ORDER BY pos)
    ),
    f1 AS (SELECT lang, w AS phrase, count(*) AS n FROM run GROUP BY ALL),
    f2 AS (SELECT lang, w || ' ' || w2 AS phrase, w, w2, count(*) AS n FROM run WHERE w2 IS NOT NULL GROUP BY ALL),
    f3 AS (SELECT lang, w || ' ' || w2 || ' ' || w3 AS phrase, w, w2, w3, count(*) AS n FROM run WHERE w3 IS NOT NULL GROUP BY ALL),
    c2 AS (SELECT * FROM f2 WHERE n >= {LEAST}),
    c3 AS (SELECT * FROM f3 WHERE n >= {LEAST}),
    cuts AS (
        SELECT c2.lang, c2.phrase, c2.n AS a, 1 AS k, a.n AS l, b.n AS r
        FROM c2 JOIN f1 a ON a.lang = c2.lang AND a.phrase = c2.w JOIN f1 b ON b.lang = c2.lang AND b.phrase = c2.w2
        UNION ALL
        SELECT c3.lang, c3.phrase, c3.n, 1, a.n, b.n
        FROM c3 JOIN f1 a ON a.lang = c3.lang AND a.phrase = c3.w JOIN f2 b ON b.lang = c3.lang AND b.phrase = c3.w2 || ' ' || c3.w3
        UNION ALL
        SELECT c3.lang, c3.phrase, c3.n, 2, a.n, b.n
        FROM c3 JOIN f2 a ON a.lang = c3.lang AND a.phrase = c3.w || ' ' || c3.w2 JOIN f1 b ON b.lang = c3.lang AND b.phrase = c3.w3
    ),
    valued AS (SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
    best AS (
        SELECT * FROM valued QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
    ),
    longer AS (
        SELECT lang, phrase, max(n) AS n FROM (
            SELECT lang, w || ' ' || w2 AS phrase, n FROM c3 UNION ALL SELECT lang, w2 || ' ' || w3, n FROM c3
        ) GROUP BY ALL
    ),
    kept AS (
        SELECT best.* FROM best LEFT JOIN longer USING (lang, phrase)
        WHERE NOT coalesce(100 * longer.n >= {INSIDE_PERCENT} * a, false)
    ),
    words AS (SELECT lang, sum(n)::BIGINT AS n FROM f1 GROUP BY lang)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM kept JOIN words USING (lang)
    QUALIFY rank <= {TOP}
    """
