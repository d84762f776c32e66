"""A catalogue crawl: listing walk, frontier, run, summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.config import Settings
from pagemill.operators.frontier import (
    dispatch_summary,
    frontier,
    listing_links,
    walk_listings,
)
from pagemill.operators.ordering import number_rows
from pagemill.operators.report import completion_event
from pagemill.plans.scrape import Run, scrape
from pagemill.session import cut
from pagemill.sources.tables import with_body

@dataclass(frozen=True)
class CatalogRun:
    visits: DataFrame
    urls: DataFrame
    summary: DataFrame
    run: Run

    def event(self, use_ai: bool = False) -> DataFrame:
        """The completion row over all walks of this run."""
        scanned, sent = self.summary.agg(
            F.coalesce(F.sum("pages_scanned"), F.lit(0)),
            F.coalesce(F.sum("books_dispatched"), F.lit(0)),
        ).first()
        return completion_event(self.run.outcome, scanned, sent, use_ai)


def crawl_catalog(
    seeds: DataFrame,
    listings: DataFrame,
    pages: DataFrame,
    settings: Settings | None = None,
    use_ai: bool = False,
    callback: bool = False,
    **inputs: DataFrame,
) -> CatalogRun:
    """Walk from seeds (url, arrived_at, seq) over listing pages and run every link found.

    `inputs` are the optional tables of `scrape`: seen, stored_hashes, robots, replies.
    """
    settings = settings or Settings()
    visits = cut(
        walk_listings(seeds, listing_links(with_body(listings).select("url", "html")),
                      settings.max_pages)
    )
    urls = cut(frontier(visits, settings.chunk_size))
    requests = as_requests(urls, seeds, use_ai)
    summary = dispatch_summary(urls, visits, settings.chunk_size, callback)
    return CatalogRun(visits, urls, summary, scrape(requests, pages, settings, **inputs))


def as_requests(urls: DataFrame, seeds: DataFrame, use_ai: bool = False) -> DataFrame:
    """The frontier as requests, numbered walk by walk in link order."""
    walks = seeds.select(F.col("seq").alias("walk"), "arrived_at")
    numbered = number_rows(urls.join(walks, "walk"), ("walk", "ordinal"), out="seq")
    return numbered.select(
        "url",
        F.lit(False).alias("force"),
        F.lit(use_ai).alias("use_ai"),
        "arrived_at",
        "seq",
    )
