"""Late reading: choose rows of a table of files by narrow columns first, read the wide ones later.

A row's place is its file and its number in it, which file tables give as hidden columns. Pages
are chosen by their places on columns that cost little to scan; a second read takes the chosen
rows only, where they are scanned. The wide column is in no shuffle: it is the places that travel,
as 64-bit hashes, to the scans by broadcast. A broadcast holds at most ROWS_AT_ONCE of them (16 MB);
more rows are read in several rounds, each over its own files.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.session import cut

ROWS_AT_ONCE = 2_000_000
PLACE = "_place"
#: Rows of a file whose places are counted together; a round takes whole blocks.
BLOCK = 1_000_000


def with_places(table: DataFrame) -> DataFrame:
    """Add PLACE, a struct of path and row. A table that does not come from files is written first.

    A row read through a projection or filter keeps its place. Behind a join or a generator several
    rows may share one, and are then read together.
    """
    place = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row"))
    try:
        return table.withColumn(PLACE, place)
    except AnalysisException:
        return cut(table).withColumn(PLACE, place)


def _key(by: tuple[str, ...] = ()) -> Column:
    return F.xxhash64(f"{PLACE}.path", f"{PLACE}.row", *by)


def _block() -> Column:
    return F.floor(F.col(f"{PLACE}.row") / BLOCK)


def rounds(places: DataFrame, most: int = ROWS_AT_ONCE) -> list[list[tuple[str, int]]]:
    """Blocks of files, put together so that a round has at most `most` chosen rows, or one block.

    The driver sees one row per block of a file that has a chosen row.
    """
    counted = places.groupBy(F.col(f"{PLACE}.path").alias("path"), _block().alias("block")).agg(F.count("*").alias("n"))
    out: list[list[tuple[str, int]]] = []
    left = 0
    for row in counted.orderBy("path", "block").collect():
        if not out or row["n"] > left:
            out.append([])
            left = most
        out[-1].append((row["path"], row["block"]))
        left -= row["n"]
    return out


def read_at(
    table: DataFrame, places: DataFrame, work: Callable[[DataFrame], DataFrame],
    by: tuple[str, ...] = (), most: int = ROWS_AT_ONCE,
) -> DataFrame:
    """`work` of the rows of `table` that lie at `places`; `table` is from `with_places`.

    `places` should be a written table, since each round reads it. Rows that share a place are told
    apart by the columns `by`, which both have. What agrees in a 64-bit hash of these is read
    together, so `work` may see a row that was not chosen, but none that was is missing.
    """
    found = rounds(places, most)
    if not found:
        return work(table.limit(0))
    parts = []
    for blocks in found:
        paths = sorted({path for path, _ in blocks})
        near = table.filter(F.col(f"{PLACE}.path").isin(paths))
        keys = places.filter(F.col(f"{PLACE}.path").isin(paths))
        if len(found) > 1:
            # A file larger than a round is in several of them.
            low, high = blocks[0], blocks[-1]
            at = F.struct(F.col(f"{PLACE}.path"), _block())
            keys = keys.filter(at.between(_bound(low), _bound(high)))
        keys = keys.select(_key(by).alias("_key")).distinct()
        # At most `most` numbers, or a block of them.
        part = work(near.join(F.broadcast(keys), _key(by) == F.col("_key"), "left_semi"))
        parts.append(part if len(found) == 1 else cut(part))
    return reduce(DataFrame.unionByName, parts)


def _bound(at: tuple[str, int]) -> Column:
    return F.struct(F.lit(at[0]), F.lit(at[1]).cast("long"))
