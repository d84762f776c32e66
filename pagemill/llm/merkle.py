"""Merkle manifest of a table, with few of its levels kept and proofs worked out anew.

Rows are leaves of one tree per language, in order of their id; every eight nodes make one of the
next level, and the trees' roots are the leaves of a last tree. Of each tree only every `STRIDE`th
level is written: a stored node stands for an aligned subtree of 8^STRIDE stored nodes below it.
A proof needs the siblings on the way up. Those on stored levels are read; those between are made
again inside their subtree, one group of at most 8^STRIDE rows, and are gone when its proofs are out.

Proofs come from the top down: the path above a stored node is worked out once per node, and joined
to the subtree below it, whose rows add their own part. So a join moves one row per subtree, by a
key that is unique on both sides, however many rows a language has. Ranks come from a sort by range
(`number_rows`), never from a window over a language.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.urls import bind
from pagemill.llm.common import fold
from pagemill.operators.ordering import number_rows
from pagemill.session import cut, look_up

ARITY, STRIDE = 8, 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SPAN = ARITY**STRIDE
PATH = "array<struct<left:string,right:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf_of(*values: Column) -> Column:
    """The digest of the values, each with its length in bytes before it; `-` stands for null."""
    texts = [x.cast("string") for x in values]
    framed = [F.concat(F.octet_length(x).cast("string"), F.lit(":"), x) for x in texts]
    return digest(F.concat(*[F.coalesce(x, F.lit("-")) for x in framed]))


def tree_key(lang: Column) -> Column:
    """Never null, and ordered as the languages are with null first."""
    return F.coalesce(F.concat(F.lit("="), lang.cast("string")), F.lit(""))


def _joined(nodes: Column) -> Column:
    return F.array_join(nodes, "")


def _level_above(nodes: Column) -> Column:
    """The nodes over every eight of `nodes`, which begin at a multiple of eight."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / ARITY).cast("int"))
    return F.transform(runs, lambda i: digest(_joined(F.slice(nodes, i * ARITY + 1, F.lit(ARITY)))))


def _above(total: Column, levels: int) -> Column:
    """How many nodes a level has over one of `total`."""
    return F.ceil(total / ARITY**levels).cast("long")


def _siblings(nodes: Column, at: Column) -> Column:
    """The run's other nodes, those before the one at `at` and those behind it, each in one text."""
    first = at - at % ARITY
    before = F.slice(nodes, first + 1, at - first)
    behind = F.slice(nodes, at + 2, first + ARITY - 1 - at)
    return F.struct(_joined(before).alias("left"), _joined(behind).alias("right"))


def _with_levels(nodes: Column, total: Column, use, levels: int = STRIDE):  # noqa: ANN001, ANN202
    """use([nodes, the level above, ..]) with each level bound once; a lone node stays as it is."""

    def next_level(found: list[Column]) -> Column:
        if len(found) == levels:
            return use(found)
        grown = F.when(_above(total, len(found) - 1) > 1, _level_above(found[-1])).otherwise(found[-1])
        return bind(grown, lambda level: next_level([*found, level]))

    return bind(nodes, lambda level: next_level([level]))


def _subtrees(nodes: DataFrame, payload: tuple[str, ...] = ()) -> DataFrame:
    """(key, sub, total, members): the rows of each aligned subtree in order, at most SPAN of them."""
    members = F.sort_array(F.collect_list(F.struct("pos", "node", *payload)))
    sub = F.expr(f"pos div {SPAN}").alias("sub")
    return nodes.groupBy("key", sub).agg(F.first("total").alias("total"), members.alias("members"))


def store_levels(nodes: DataFrame) -> list[DataFrame]:
    """(key, pos, node, total) of the level given and of every STRIDE-th above it, up to the roots.

    `pos` counts from 0 within `key`, and `total` is the number of the key's nodes on the level.
    """
    levels = [nodes]
    while (levels[-1].agg(F.max("total")).first()[0] or 0) > 1:
        below = F.col("members.node")
        top = _with_levels(
            below, F.col("total"), lambda found: F.element_at(
                F.when(_above(F.col("total"), STRIDE - 1) > 1, _level_above(found[-1])).otherwise(found[-1]), 1
            ),
        )
        rows = _subtrees(levels[-1]).select("key", F.col("sub").alias("pos"), top.alias("node"), _above(F.col("total"), STRIDE).alias("total"))
        levels.append(cut(rows))
    return levels


def extract_paths(
    levels: list[DataFrame], above: DataFrame, payload: tuple[str, ...] = (), carried: tuple[str, ...] = ()
) -> DataFrame:
    """(key, pos, node, payload, carried, path): the siblings of each node of the lowest level.

    `path` has an entry per level on the way up, then what `above` (key, path, carried) has for the
    key. Levels that were not stored are made again inside each subtree.
    """
    known = above.select("key", F.lit(0).cast("long").alias("sub"), "path", *carried)
    for i, level in reversed(list(enumerate(levels[:-1] if len(levels) > 1 else levels))):
        own = payload if i == 0 else ()
        found = _paths_below(_subtrees(level, own), known, own, carried)
        if i == 0:
            return found
        known = cut(found.select("key", F.col("pos").alias("sub"), "path", *carried))
    raise ValueError("no levels")


def _paths_below(subtrees: DataFrame, known: DataFrame, payload: tuple[str, ...], carried: tuple[str, ...]) -> DataFrame:
    rows = subtrees.join(known, ["key", "sub"])
    total, members, higher = F.col("total"), F.col("members"), F.col("path")

    def path(found: list[Column], i: Column) -> Column:
        steps = [
            F.when(_above(total, n) > 1, _siblings(nodes, F.floor(i / ARITY**n).cast("int")))
            for n, nodes in enumerate(found)
        ]
        return F.concat(F.filter(F.array(*steps), lambda x: x.isNotNull()).cast(PATH), higher)

    def with_paths(found: list[Column]) -> Column:
        return F.transform(members, lambda x, i: F.struct(x.alias("row"), path(found, i).alias("path")))

    each = _with_levels(F.col("members.node"), total, with_paths)
    spread = rows.select("key", *carried, F.explode(each).alias("at"))
    return spread.select("key", *[F.col(f"at.row.{x}").alias(x) for x in ("pos", "node", *payload)], *carried, "at.path")


def fold_path(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda node, step: digest(F.concat(step["left"], node, step["right"])))


def siblings_text(path: Column) -> Column:
    return _joined(F.transform(path, lambda step: F.concat(step["left"], step["right"])))


@dataclass(frozen=True)
class Manifest:
    """The stored levels of each language's tree and of the tree over their roots."""

    levels: list[DataFrame]  #: (key, pos, node, total); the lowest has doc_id and `payload` besides
    top: list[DataFrame]  #: the same with one key; the lowest has the language's key as `tree`
    payload: tuple[str, ...]
    root: str | None  #: null for an empty table

    def proofs(self) -> DataFrame:
        """(key, pos, doc_id, payload, leaf, subroot, path) of every row; see `fold_path`."""
        spark = self.top[0].sparkSession
        nothing = spark.range(1).select(F.lit("").alias("key"), F.array().cast(PATH).alias("path"))
        trees = extract_paths(self.top, nothing, ("tree",))
        above = cut(trees.select(F.col("tree").alias("key"), F.col("node").alias("subroot"), "path"))
        found = extract_paths(self.levels, above, ("doc_id", *self.payload), ("subroot",))
        return found.withColumnRenamed("node", "leaf")


def build(
    rows: DataFrame, id_col: str = "doc_id", lang: str = "lang", fields: tuple[str, ...] = FIELDS, **payload: Column
) -> Manifest:
    """Leaves, ranks and stored levels of a table; `payload` columns stay with the leaves.

    Within a language rows ascend by id, null first; rows of one id ascend by their leaf, so
    repeated rows are leaves of their own. A null language is a tree before all others.
    """
    leaf = leaf_of(*[F.col(x) for x in fields])
    own = [x.alias(name) for name, x in payload.items()]
    leaves = cut(rows.select(tree_key(F.col(lang)).alias("key"), F.col(id_col).alias("doc_id"), leaf.alias("node"), *own))
    ranked = number_rows(leaves, ("key", "doc_id", "node"), out="place")
    sizes = ranked.groupBy("key").agg(F.min("place").alias("first"), F.count("*").alias("total"))
    placed = look_up(ranked, sizes, "key").withColumn("pos", F.col("place") - F.col("first"))
    levels = store_levels(cut(placed.select("key", "pos", "node", "total", "doc_id", *payload)))
    trees = cut(levels[-1].select(F.col("key").alias("tree"), "node"))
    numbered = number_rows(trees, ("tree",), out="place")
    total = F.lit(trees.count()).cast("long")
    top = store_levels(
        cut(numbered.select(F.lit("").alias("key"), (F.col("place") - 1).alias("pos"), "node", total.alias("total"), "tree"))
    )
    last = top[-1].first()
    return Manifest(levels, top, tuple(payload), last["node"] if last else None)


def check_table(docs: DataFrame) -> DataFrame:
    """Proofs of all documents, and whether they hold after some texts were tampered with.

    Where 3 divides the crc32 of the id, the tampered text has its A-Z in lower case; without such
    letters, or without a text or an id, nothing changes and the proof holds. One row per row;
    an empty table gives none.
    """
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lower = F.translate("text", letters, letters.lower())
    altered = leaf_of(*[lower if x == "text" else F.col(x) for x in FIELDS])
    manifest = build(docs, tampered=F.when(fold("doc_id", 3) == 0, altered))
    root = F.lit(manifest.root).cast("string")
    return manifest.proofs().select(
        "doc_id", "leaf", "subroot", root.alias("root"),
        digest(siblings_text(F.col("path"))).alias("proof_sha256"),
        fold_path(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle() -> str:
    """DuckDB SQL for `check_table` over documents."""
    framed = lambda x: f"coalesce(strlen({x}::VARCHAR)::VARCHAR || ':' || {x}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(framed(text if x == "text" else x) for x in FIELDS) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def tree(name: str, leaves: str) -> str:
        return f"""
    {name} AS (
        SELECT key, 0 AS level, pos, node, total FROM {leaves}
        UNION ALL
        SELECT key, level + 1, pos // {ARITY}, sha256(string_agg(node, '' ORDER BY pos)), (total + {ARITY - 1}) // {ARITY}
        FROM {name} WHERE total > 1 GROUP BY key, level, pos // {ARITY}, total
    ),
    {name}_siblings AS (
        SELECT key, level, pos,
            coalesce(string_agg(node, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
            coalesce(string_agg(node, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS behind
        FROM {name} WHERE total > 1 WINDOW run AS (PARTITION BY key, level, pos // {ARITY} ORDER BY pos)
    )"""

    def walk(name: str, start: str, siblings: str) -> str:
        return f"""
    {name} AS (
        SELECT row_id, key, 0 AS level, pos, node, proof FROM {start}
        UNION ALL
        SELECT row_id, w.key, w.level + 1, w.pos // {ARITY}, sha256(before || w.node || behind), proof || before || behind
        FROM {name} w JOIN {siblings} s ON s.key = w.key AND s.level = w.level AND s.pos = w.pos
    )"""

    return f"""
    WITH RECURSIVE crc AS (
        SELECT list(list_reduce(list_concat([i::BIGINT], range(8)),
            lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t
        FROM range(256) r(i)
    ),
    page AS (
        SELECT row_number() OVER () AS row_id, *, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS key,
            {leaf("text")} AS leaf, {leaf(lower)} AS altered,
            xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1]))) AS crc
        FROM documents, crc
    ),
    placed AS (
        SELECT row_id, doc_id, key, leaf, CASE WHEN crc % 3 = 0 THEN altered ELSE leaf END AS given,
            row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
            count(*) OVER (PARTITION BY key) AS total
        FROM page
    ),
    leaves AS (SELECT key, pos, leaf AS node, total FROM placed),
    {tree("tree", "leaves")},
    roots AS (SELECT key AS tree, node, row_number() OVER (ORDER BY key) - 1 AS pos FROM tree WHERE total = 1),
    root_leaves AS (SELECT '' AS key, pos, node, count(*) OVER () AS total FROM roots),
    {tree("top", "root_leaves")},
    start AS (SELECT row_id, key, pos, given AS node, '' AS proof FROM placed),
    {walk("way", "start", "tree_siblings")},
    arrived AS (SELECT row_id, key, node, proof FROM way QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY level DESC) = 1),
    root_start AS (SELECT row_id, '' AS key, pos, arrived.node, proof FROM arrived JOIN roots ON roots.tree = arrived.key),
    {walk("root_way", "root_start", "top_siblings")},
    home AS (SELECT row_id, node, proof FROM root_way QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY level DESC) = 1)
    SELECT doc_id, leaf, roots.node AS subroot, root.node AS root, sha256(home.proof) AS proof_sha256,
        home.node AS folded_root, home.node = root.node AS verified
    FROM placed JOIN home USING (row_id) JOIN roots ON roots.tree = placed.key, (SELECT node FROM top WHERE total = 1) root
    """
