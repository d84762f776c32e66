"""The item table: versions in, the current row per URL out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.operators.ordering import number_rows
from pagemill.schemas import ITEM_FIELDS, item_defect
from pagemill.session import cut

ITEM_COLUMNS = ("id", "title", "price", "availability", "rating", "url", "description")
# Offsets up to here are served by a top-k; deeper pages count positions instead.
TOP_K_OFFSET = 100_000


def current_items(
    versions: DataFrame, fields: tuple[str, ...] = ITEM_FIELDS, keep_order: bool = False
) -> DataFrame:
    """The latest fields per exact URL with the URL's first id.

    `versions` has url, id, the fields, fetched_at and seq. A hot URL shrinks to one row per
    map task before the shuffle.
    """
    fields = (*fields, "fetched_at", "seq") if keep_order else fields
    return (
        versions.groupBy("url")
        .agg(
            F.min("id").alias("id"),
            F.max_by(F.struct(*fields), F.struct("fetched_at", "seq")).alias("row"),
        )
        .select("id", "url", *[F.col(f"row.{name}").alias(name) for name in fields])
    )


def new_versions(
    records: DataFrame, current: DataFrame, fields: tuple[str, ...] = ITEM_FIELDS,
    top: int | None = None,
) -> DataFrame:
    """The rows to append for a batch of records: one per URL, with its old or a new id.

    New ids continue after the highest one, `top`, in the order of first arrival (`seq`). `current`
    may hold the URLs of the records only if `top` is given.
    """
    latest = records.groupBy("url").agg(
        F.min("seq").alias("_first"),
        F.max_by(F.struct(*fields, "fetched_at", "seq"), F.struct("fetched_at", "seq")).alias(
            "row"
        ),
    )
    matched = cut(latest.join(current.select("url", "id"), "url", "left"))
    if top is None:
        top = current.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long")).first()[0]
    added = number_rows(matched.filter(F.col("id").isNull()), "_first", out="_n")
    added = added.withColumn("id", F.lit(top) + F.col("_n")).drop("_n")
    known = matched.filter(F.col("id").isNotNull())
    return known.unionByName(added).select(
        "id",
        "url",
        *[F.col(f"row.{name}").alias(name) for name in (*fields, "fetched_at", "seq")],
    )


def storable(records: DataFrame) -> DataFrame:
    return records.filter(item_defect().isNull())


def count_items(items: DataFrame) -> DataFrame:
    return items.agg(F.count("*").alias("items"))


def items_page(items: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Rows by id, newest first. A deep offset does not gather the rows before it in one task."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be between 1 and 500")
    if offset < 0:
        raise ValueError("offset must not be negative")
    if offset <= TOP_K_OFFSET:
        return items.orderBy(F.desc("id")).offset(offset).limit(limit)
    placed = number_rows(items.withColumn("_back", -F.col("id")), "_back", out="_place")
    wanted = placed.filter(F.col("_place").between(offset + 1, offset + limit))
    return wanted.drop("_back", "_place").orderBy(F.desc("id"))


def items_listing(items: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """One row: `total`, the number of all items, and `items`, the page as a list, newest first."""
    rows = F.sort_array(F.collect_list(F.struct("id", *[x for x in items.columns if x != "id"])), asc=False)
    page = items_page(items, limit, offset).agg(rows.alias("items"))
    # Two tables of one row.
    return items.agg(F.count("*").alias("total")).crossJoin(page)
