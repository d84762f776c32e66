"""N-gram Jaccard join by chosen paths.

Texts are sets of five-word shingles; texts with equal sets are one class, and what follows joins
class representatives, so copies cost one row however many they are.

1. Each set is embedded as `COORDINATES` min-hash values: two sets agree in a coordinate with a
   probability equal to their similarity.
2. Chosen paths: in each of `RUNS` runs every set follows, from the root, the branches
   (coordinate, value) for `CHOSEN` sampled coordinates. A bucket holds the sets that share a path.
   Buckets above `BUCKET` sets are split again on other coordinates, up to `DEPTH` times; smaller
   ones, and those a split leaves (nearly) whole, are brute-forced on the embedding. Similar sets
   follow a common branch with probability 1 - (1 - s f)^CHOSEN where f is the same for the level
   below, at least 0.93 a run at s = 0.8 however deep, so the runs together miss fewer than one
   pair in 10^7. A candidate may agree in as few as `FEWEST` of its coordinates, 4.8 standard
   deviations below what is expected at s = 0.8.
3. Buckets report a spanning forest of their candidate pairs, not the pairs, and the forests are
   joined into candidate components by alternating stars.
4. Inside each component all pairs are compared exactly, on the texts, in blocks: a component of
   any size is dealt out as pairs of blocks of `BLOCK` sets. These give each set its links and the
   exact components. Links are counted where they are found, so no group is written out as pairs.

Equal sets are recognised by 128 bits of the whole set: a number of 64 bits names the set, and where
sets that differ in the other 64 share it, all but the least of them take another name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.common import Memo, free_names, limit_batches, map_batches, words_of
from pagemill.session import cut, look_up

WORDS, SIMILARITY = 5, 0.8
COORDINATES, FEWEST = 64, 36
RUNS, CHOSEN, DEPTH = 6, 2, 5
BUCKET, BLOCK = 4096, 128
#: Bits of the filter that says which texts to move, and of one run of them.
SIEVE_BITS, SIEVE_RUN = 1 << 26, 32_768
#: A child bucket with so much of its parent is a cluster and is not split again.
WHOLE = 0.8


class Hasher:
    """Shingle hashes and min-hash values; the hash functions follow from a fixed seed.

    Keys of fewer than 64 bits serve tests of sets that share one.
    """

    def __init__(self, key_bits: int = 64) -> None:
        self.spare = 64 - key_bits
        draw = np.random.default_rng(20240229)
        self.odd = draw.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) | np.uint64(1)
        self.mix = draw.integers(1, 1 << 63, COORDINATES, dtype=np.uint64)
        self.word = Memo(lambda w: xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace")), 150_000)

    def shingles(self, text: str | None) -> np.ndarray:
        """Distinct hashes of five words in a row, sorted; a shorter text is one shingle."""
        words = words_of(text)
        if not words:
            return np.zeros(0, np.uint64)
        codes = np.array(list(map(self.word.__getitem__, words)), np.uint64)
        width = min(WORDS, len(codes))
        out = np.full(len(codes) - width + 1, 0x9E3779B97F4A7C15 + width, np.uint64)
        for i in range(width):
            out = _mixed(out ^ codes[i : i + len(out)])
        return np.unique(out)

    def key(self, found: np.ndarray) -> tuple[int, int]:
        """128 bits of the set, as two numbers; the second one alone tells two texts of an id apart."""
        first, second = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), np.int64).tolist()
        return first >> self.spare, second

    def values(self, found: np.ndarray) -> np.ndarray:
        """The least value of each hash function over the set, as its upper 32 bits."""
        least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(found), 2048):
            part = found[at : at + 2048]
            for i in range(COORDINATES):
                least[i] = min(least[i], ((part ^ self.mix[i]) * self.odd[i]).min())
        return (_mixed(least) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def sketch(docs: DataFrame, key_bits: int = 64) -> DataFrame:
    """(doc_id, raw, check, sig) of every row; a text without words has nulls but for its id."""
    hasher = _Lazy(key_bits)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, sigs = [], []
        for text in batch.column(1):
            found = hasher.get().shingles(text.as_py())
            keys.append(hasher.get().key(found) if len(found) else (None, None))
            sigs.append(hasher.get().values(found) if len(found) else None)
        halves = [pa.array([x[i] for x in keys], pa.int64()) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([batch.column(0), *halves, pa.array(sigs, pa.list_(pa.int32()))], ["doc_id", "raw", "check", "sig"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return map_batches(rows, work, "doc_id long, raw long, check long, sig array<int>")


def named(sketches: DataFrame) -> DataFrame:
    """Add `key`, one per set: `raw`, or another number for sets that share that with another one.

    Among 10^10 sets a few pairs share it, so the table of these is small.
    """
    least = F.min("check").alias("least")
    shared = sketches.groupBy("raw").agg(least, F.max("check").alias("most")).filter("least < most")
    shared = cut(shared.select("raw", "least"))
    if shared.isEmpty():
        return sketches.withColumn("key", F.col("raw"))
    other = F.xxhash64("raw", "check")
    return look_up(sketches, shared, "raw").select(
        *sketches.columns, F.when(F.col("check") > F.col("least"), other).otherwise(F.col("raw")).alias("key")
    )


class _Lazy:
    """A hasher that each worker builds for itself."""

    def __init__(self, key_bits: int = 64) -> None:
        self.key_bits = key_bits
        self.hasher: Hasher | None = None

    def get(self) -> Hasher:
        if self.hasher is None:
            self.hasher = Hasher(self.key_bits)
        return self.hasher

    def __reduce__(self) -> tuple:
        return _Lazy, (self.key_bits,)


def _buckets(reps: DataFrame) -> DataFrame:
    """(path, size, key): the buckets to brute-force."""
    step = lambda run, at: F.struct(F.lit(run).alias("run"), F.lit(at).alias("at"))
    roots = F.array(*[step(run, run * CHOSEN + i) for run in range(RUNS) for i in range(CHOSEN)])
    paths = reps.select("key", "sig", F.explode(roots).alias("step")).select(
        F.xxhash64("step.run", "step.at", F.element_at("sig", F.col("step.at") + 1)).alias("path"),
        F.lit(None).cast("long").alias("parent_size"),
        "key",
    )
    first, rest = RUNS * CHOSEN, COORDINATES - RUNS * CHOSEN
    share = rest // (DEPTH - 1)
    leaves = []
    for level in range(1, DEPTH + 1):
        sizes = paths.groupBy("path").agg(F.count("*").alias("size")).filter("size > 1")
        held = cut(paths.join(sizes, "path"))
        small = (F.col("size") <= BUCKET) | (F.col("size") >= WHOLE * F.col("parent_size"))
        stays = F.coalesce(small, F.lit(False)) if level < DEPTH else F.lit(True)
        leaves.append(held.filter(stays).select("path", "size", "key"))
        split = held.filter(~stays)
        if level == DEPTH or split.isEmpty():
            break
        # The coordinates of a level are its own, so a path never meets one twice.
        base = first + (level - 1) * share
        at = F.explode(F.array(*[F.pmod(F.xxhash64("path", F.lit(i)), F.lit(share)).cast("int") + F.lit(base + 1) for i in range(CHOSEN)]))
        paths = (
            split.join(reps.select("key", "sig"), "key")
            .select("path", "size", "key", "sig", at.alias("at"))
            .select(
                F.xxhash64("path", "at", F.element_at("sig", F.col("at"))).alias("path"),
                F.col("size").alias("parent_size"),
                "key",
            )
        )
    out = leaves[0]
    for more in leaves[1:]:
        out = out.unionByName(more)
    return out


def _dealt(rows: DataFrame, group: str, size: str, key: str, most: int) -> DataFrame:
    """Deal groups out as pairs of blocks of about `most` rows: adds `low`, `high` and `block`."""
    blocks = F.ceil(F.col(size) / F.lit(most)).cast("int")
    block = F.pmod(F.xxhash64(F.lit(1), key), blocks).cast("int")
    every = F.explode(F.sequence(F.lit(0), blocks - 1))
    return (
        rows.withColumn("block", block)
        .withColumn("other", every)
        .withColumn("low", F.least("block", "other"))
        .withColumn("high", F.greatest("block", "other"))
        .drop("other")
        .repartition(group, "low", "high")
        .sortWithinPartitions(group, "low", "high", key)
    )


def _units(batches: Iterator[pa.RecordBatch], of: int) -> Iterator[list[pa.RecordBatch]]:
    """Runs of equal values in the first `of` columns, which are sorted, across batches."""
    waiting: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(of)])
        starts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:], strict=False):
            here = tuple(marks[:, a].tolist())
            if waiting and here != last:
                yield waiting
                waiting = []
            waiting.append(batch.slice(a, b - a))
            last = here
    if waiting:
        yield waiting


def _roots(size: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of `size` members the first member of its component under the given pairs."""
    parent = list(range(size))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return np.array([find(x) for x in range(size)])


def _agreeing(sigs: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows, first below second, that agree in FEWEST coordinates; across blocks if there are two."""
    mixed, left, right = blocks.min() != blocks.max(), [], []
    for at in range(0, len(sigs), 512):
        part = sigs[at : at + 512]
        same = np.zeros((len(part), len(sigs)), np.uint8)
        for i in range(sigs.shape[1]):
            same += part[:, i, None] == sigs[None, :, i]
        a, b = np.nonzero(same >= FEWEST)
        a += at
        keep = (a < b) & ((blocks[a] != blocks[b]) if mixed else True)
        left.append(a[keep])
        right.append(b[keep])
    return np.concatenate(left), np.concatenate(right)


def candidates(reps: DataFrame) -> DataFrame:
    """(a, b) with a > b: a spanning forest of the candidate pairs of every bucket."""
    rows = _buckets(reps).join(reps.select("key", "sig"), "key")
    limit_batches(reps.sparkSession)
    dealt = _dealt(rows, "path", "size", "key", BUCKET).select("path", "low", "high", "block", "key", "sig")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        twos: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if seen:
                a, b = zip(*seen, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                seen.clear()

        def pairs_of_two() -> None:
            whole = pa.Table.from_batches(twos)
            keys = whole["key"].to_numpy()
            sigs = whole["sig"].combine_chunks().flatten().to_numpy().reshape(len(keys), -1)
            same = (sigs[::2] == sigs[1::2]).sum(1) >= FEWEST
            seen.update(zip(keys[1::2][same].tolist(), keys[::2][same].tolist(), strict=True))
            twos.clear()

        for unit in _units(batches, 3):
            size = sum(x.num_rows for x in unit)
            if size == 2:
                twos += unit
                if len(twos) >= 5_000:
                    pairs_of_two()
            elif size > 2:
                whole = pa.Table.from_batches(unit)
                keys = whole["key"].to_numpy()
                sigs = whole["sig"].combine_chunks().flatten().to_numpy().reshape(size, -1)
                roots = _roots(size, *_agreeing(sigs, whole["block"].to_numpy()))
                some = roots != np.arange(size)
                seen.update(zip(keys[some].tolist(), keys[roots[some]].tolist(), strict=True))
            if len(seen) >= 100_000:
                yield from flush()
        if twos:
            pairs_of_two()
        yield from flush()

    return dealt.mapInArrow(work, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(key, component) of every key in (a, b) edges with a > b, by alternating stars.

    The component is its least key. A key with very many neighbours is only aggregated and joined
    by key, never gathered; what it is joined with is a written table, so that AQE can split its
    rows. Edges are rewritten until a round changes none; each round is a table.
    """
    edges, before = cut(edges), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Large star: neighbours above a key move to the least key around it.
        large = both.filter("b > a").join(cut(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()
        # Small star: a key and its neighbours below move to the least of these.
        large = cut(large)
        low = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        moved = large.join(low, "a")
        small = moved.filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        edges = cut(small.distinct())
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("key"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("key"), F.col("b").alias("component")).distinct()
    )


def _exact(similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Compare all pairs of a unit: links of each member, and the first member of its component."""
    hasher = _Lazy()

    def linked(sets: list[np.ndarray], blocks: np.ndarray) -> np.ndarray:
        sizes = np.array([len(x) for x in sets])
        every, times = np.unique(np.concatenate(sets), return_counts=True)
        every = every[times > 1]
        owner = np.repeat(np.arange(len(sets)), sizes)
        codes = np.concatenate(sets)
        place = np.searchsorted(every, codes)
        kept = place < len(every)
        kept[kept] = every[place[kept]] == codes[kept]
        owner, place = owner[kept], place[kept]
        shared = np.zeros((len(sets), len(sets)), np.float32)
        for at in range(0, len(every), 8192):
            some = (place >= at) & (place < at + 8192)
            found = np.zeros((len(sets), min(8192, len(every) - at)), np.float32)
            found[owner[some], place[some] - at] = 1
            shared += found @ found.T  # counts, exact in a float
        near = shared >= similarity * (sizes[:, None] + sizes[None, :] - shared) - 1e-6
        np.fill_diagonal(near, False)
        if blocks.min() != blocks.max():
            near &= blocks[:, None] != blocks[None, :]
        return near

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int, int]] = []
        for unit in _units(batches, 3):
            members: dict[int, tuple[np.ndarray, int, int]] = {}
            low, high = unit[0].column(1)[0].as_py(), unit[0].column(2)[0].as_py()
            for batch in unit:
                columns = [batch.column(i).to_pylist() for i in (3, 4, 5, 6)]
                for block, key, copies, check, text in zip(*columns, batch.column(7), strict=True):
                    if key not in members:
                        found = hasher.get().shingles(text.as_py())
                        if len(found) and hasher.get().key(found)[1] == check:  # not another text of that id
                            members[key] = found, copies, block
            keys, blocks = list(members), np.array([x[2] for x in members.values()])
            if len(keys) < 2 or (low != high and blocks.min() == blocks.max()):
                continue
            near = linked([x[0] for x in members.values()], blocks)
            copies = np.array([x[1] for x in members.values()], np.int64)
            links = near.astype(np.int64) @ copies
            roots = _roots(len(keys), *np.nonzero(np.triu(near)))
            out += [(keys[i], int(links[i]), keys[roots[i]], int(low != high)) for i in np.flatnonzero(links).tolist()]
            if len(out) >= 50_000:
                yield _links_batch(out)
                out = []
        if out:
            yield _links_batch(out)

    return work


def _links_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["key", "links", "root", "across"])


def classes(docs: DataFrame, sketches: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(key, raw, check, component, links, copies): one row per distinct shingle set of the documents.

    `sketches` are `named`. `links` counts the documents of other sets that are similar enough,
    copies included.
    """
    known = sketches.filter("key IS NOT NULL")
    reps = cut(
        known.groupBy("key").agg(
            F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.first("sig").alias("sig"),
            F.first("raw").alias("raw"), F.first("check").alias("check"),
        )
    )
    groups = components(candidates(reps))
    sizes = groups.groupBy("component").agg(F.count("*").alias("size"))
    sized = look_up(groups, sizes, "component")
    members = cut(sized.join(reps.select("key", "first_id", "copies", "check"), "key"))
    # Only texts that may be wanted are moved.
    sieve = _sieve(members.select(F.col("first_id").alias("doc_id")))
    texts = _sifted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")), sieve, True)
    # A null id cannot be looked up; sets known only by rows without ids are compared by none.
    rows = members.filter("first_id IS NOT NULL").join(texts.withColumnRenamed("doc_id", "first_id"), "first_id")
    dealt = _dealt(rows, "component", "size", "key", BLOCK).select("component", "low", "high", "block", "key", "copies", "check", "text")
    found = cut(dealt.mapInArrow(_exact(similarity), "key long, links long, root long, across long"))
    # Sets of a component of several blocks may be tied by chains through several units.
    wide = members.filter(F.col("size") > BLOCK).select("key")
    tied = components(
        found.join(wide, "key", "left_semi")
        .filter("key <> root")
        .select(F.greatest("key", "root").alias("a"), F.least("key", "root").alias("b"))
        .distinct()
    )
    links = found.groupBy("key").agg(F.sum("links").alias("links"), F.min("root").alias("root"))
    return (
        reps.select("key", "raw", "check", "copies")
        .join(links, "key", "left")
        .join(tied, "key", "left")
        .select(
            "key",
            "raw",
            "check",
            F.coalesce("component", "root", "key").alias("component"),
            F.coalesce("links", F.lit(0)).alias("links"),
            "copies",
        )
    )


def _positions(doc_id: Column) -> Column:
    return F.array(*[F.pmod(F.xxhash64(doc_id, F.lit(i)), F.lit(SIEVE_BITS)) for i in range(3)])


def _sieve(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of the ids, of fixed size: with very many ids it lets more through."""
    place = F.explode(_positions(F.col("doc_id")))
    runs = (
        ids.select(place.alias("place"))
        .groupBy(F.floor(F.col("place") / SIEVE_RUN).alias("run"))
        .agg(F.bitmap_construct_agg(F.col("place") % SIEVE_RUN).alias("bits"))
    )
    out = np.zeros((SIEVE_BITS // SIEVE_RUN, SIEVE_RUN // 8), np.uint8)
    for row in runs.toLocalIterator():  # at most SIEVE_BITS / 8 bytes in all
        out[row["run"]] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return out.ravel()


def _sifted(
    docs: DataFrame, sieve: np.ndarray, inside: bool, finish: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None,
    schema: T.StructType | None = None,
) -> DataFrame:
    """The rows whose id is in the filter, or those whose id is not, and then `finish` of these.

    Decides before any shuffle.
    """
    shared, columns = docs.sparkSession.sparkContext.broadcast(sieve), len(docs.columns)
    (places_name,) = free_names(docs, "sieve_places")
    marked = docs.withColumn(places_name, _positions(F.col("doc_id").cast("long")))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        places = batch.column(columns).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, 3)
        held = ((shared.value[places >> 3] >> (places & 7).astype(np.uint8)) & 1).all(1)
        kept = batch.select(list(range(columns))).filter(pa.array(held == inside))
        return finish(kept) if finish else kept

    return map_batches(marked, work, schema or docs.schema)


def join(docs: DataFrame, similarity: float = SIMILARITY, key_bits: int = 64) -> DataFrame:
    """(doc_id, class_id, n_links), one row per input row.

    The class is the connected component of similar texts, named by its least doc_id; n_links is
    the number of other rows whose text is similar enough, copies included. A text that is null or
    has no word is alone in a class. Rows without an id are counted as copies of an equal text,
    else they are alone; a class of such rows only has a null id.
    """
    sketches = named(cut(sketch(docs, key_bits)))
    found = cut(classes(docs, sketches, similarity).drop("raw", "check"))
    rows = sketches.select("doc_id", "key").join(found, "key", "left")
    names = rows.filter("key IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("class_id"))
    return rows.join(cut(names), "component", "left").select(
        "doc_id",
        F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(F.col("key").isNull(), F.lit(0)).otherwise(F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"),
    )


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, key_bits: int = 64) -> DataFrame:
    """The rows, with all their columns, that are first in their class: the least doc_id stays.

    Texts without words stay. Of rows that share the least id and an equal text, one stays.
    """
    columns, hasher, at = docs.columns, _Lazy(key_bits), docs.columns.index("text")
    sketches = named(cut(sketch(docs, key_bits)))
    found = cut(classes(docs, sketches, similarity))
    rows = sketches.filter("key IS NOT NULL").select("doc_id", "key").join(found.select("key", "component"), "key")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("stays")
    several = cut(
        rows.groupBy("component").agg(F.count("*").alias("n"), least).filter("n > 1").select("component", "stays")
    )
    # For each set of a class of several rows: the row that stays, and whether the set is its own.
    names = free_names(docs, "fate_raw", "fate_check", "own_raw", "own_check", "fate_id", "fate_first")
    raw, check, own_raw, own_check, stays_id, is_first = names
    fate = cut(
        found.join(several, "component").select(
            "key", F.col("raw").alias(raw), F.col("check").alias(check),
            F.col("stays.doc_id").alias(stays_id), (F.col("key") == F.col("stays.key")).alias(is_first),
        )
    )
    sieve = _sieve(rows.join(fate, "key", "left_semi").select("doc_id"))
    fate = fate.drop("key")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = []
        for text in batch.column(at):
            shingles = hasher.get().shingles(text.as_py())
            keys.append(hasher.get().key(shingles) if len(shingles) else (None, None))
        halves = [pa.array([x[i] for x in keys], pa.int64()) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([*batch.columns, *halves], [*columns, own_raw, own_check])

    # Rows that are certainly alone are not moved.
    fields = T.StructType([*docs.schema.fields, *[T.StructField(x, T.LongType()) for x in (own_raw, own_check)]])
    same = (F.col(own_raw) == F.col(raw)) & (F.col(own_check) == F.col(check))
    marked = _sifted(docs, sieve, True, work, fields).join(fate, same, "left")
    alone = marked.filter(F.col(raw).isNull())
    stays = F.col(is_first) & F.col("doc_id").cast("long").eqNullSafe(F.col(stays_id))
    first = marked.filter(F.col(raw).isNotNull() & stays).dropDuplicates([own_raw, own_check])
    return _sifted(docs, sieve, False).unionByName(alone.select(columns)).unionByName(first.select(columns))
