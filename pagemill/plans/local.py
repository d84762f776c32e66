"""The plain batch run: every URL is marked when it passes the gate, and reported in a line."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.values import status_line
from pagemill.operators.dedup import first_seen, with_key
from pagemill.operators.extract import extract_records
from pagemill.operators.frontier import frontier, listing_links, walk_listings
from pagemill.operators.items import storable
from pagemill.plans.catalog import as_requests
from pagemill.schemas import item_defect
from pagemill.session import cut
from pagemill.sources.stores import ItemStore
from pagemill.sources.tables import with_body

FIELDS = ("title", "price", "availability", "rating", "description")


def run_batch(urls: DataFrame, pages: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """(url, arrived_at, seq, status, fields, line) for urls (url, arrived_at, seq)."""
    keyed = with_key(urls)
    passed = first_seen(keyed, seen).withColumn("_passed", F.lit(True))
    # The triple is unique, so the rows of a hot key are spread.
    gated = cut(keyed.join(passed, ["url_key", "arrived_at", "seq"], "left"))
    # Parsed where the pages are scanned; only the narrow records are joined.
    parsed = extract_records(with_body(pages.select("url", "html"))).withColumn(
        "_fetched", F.lit(True)
    )
    done = gated.join(parsed, "url", "left")
    status = (
        F.when(F.col("_passed").isNull(), F.lit("skipped_duplicate"))
        .when(F.col("_fetched").isNull(), F.lit("fetch_failed"))
        .when(F.col("title").isNull(), F.lit("parse_failed"))
        .otherwise(F.lit("ok"))
    )
    ok = F.col("status") == "ok"
    return done.withColumn("status", status).select(
        "url",
        "arrived_at",
        "seq",
        "status",
        *[F.when(ok, F.col(name)).alias(name) for name in FIELDS],
        status_line("status", "title", "price").alias("line"),
    )


@dataclass(frozen=True)
class LocalRun:
    """A plain run over a site's listings: its lines, and how often each status occurred."""

    lines: DataFrame
    tally: DataFrame


def run_site(
    seeds: DataFrame, listings: DataFrame, pages: DataFrame, items: ItemStore, batch_id: int,
    max_pages: int = 5, seen: DataFrame | None = None,
) -> LocalRun:
    """Walk the listings from seeds (url, arrived_at, seq), run every link, and store the items.

    Rows that the item table refuses count as `store_failed`. The store is safe to write again.
    """
    visits = cut(walk_listings(seeds, listing_links(with_body(listings)), max_pages))
    requests = as_requests(cut(frontier(visits)), seeds).select("url", "arrived_at", "seq")
    lines = cut(run_batch(requests, pages, seen))
    refused = (F.col("status") == "ok") & item_defect().isNotNull()
    lines = lines.withColumn("status", F.when(refused, F.lit("store_failed")).otherwise(F.col("status")))
    done = storable(lines.filter("status = 'ok'"))
    items.upsert(done.select("url", *FIELDS, F.col("arrived_at").alias("fetched_at"), "seq"), batch_id)
    return LocalRun(lines, tally(lines))


def tally(lines: DataFrame) -> DataFrame:
    return lines.groupBy("status").agg(F.count("*").alias("n"))
