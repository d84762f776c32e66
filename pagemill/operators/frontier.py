"""Listing pages: product links, next links, and the bounded walk over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.urls import resolve_url
from pagemill.operators.html import page_nodes
from pagemill.operators.select import element, first, within
from pagemill.session import cut

# Where listing pages keep their links, and the first listing page of a site.
PRODUCT_LINKS = within(element("article", "product_pod"), element("h3"), element("a"))
NEXT_LINKS = within(element("li", "next"), element("a"))
FIRST_PAGE = "catalogue/page-1.html"


def seed_urls(sites: DataFrame, base_url: str = "base_url") -> DataFrame:
    """Where the walk of a site starts when no start page is given."""
    return sites.withColumn("url", resolve_url(base_url, F.lit(FIRST_PAGE)))


def listing_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """Per page `links` (resolved, in document order, repeats kept) and `next_url` or null.

    A product link without href is the listing page itself, and so is such a next link.
    """
    nodes = page_nodes(pages, html)
    kept = [name for name in nodes.columns if name not in ("els", "texts", "ld")]
    hrefs = nodes.select(
        *kept,
        F.transform(PRODUCT_LINKS(F.col("els")), lambda a: a["attrs"]["href"]).alias("hrefs"),
        first(NEXT_LINKS(F.col("els"))).alias("next"),
    )
    return hrefs.select(
        *kept,
        F.transform("hrefs", lambda h: resolve_url(F.col("url"), h)).alias("links"),
        F.when(F.col("next").isNotNull(), resolve_url("url", F.col("next.attrs")["href"])).alias(
            "next_url"
        ),
    )


def walk_listings(seeds: DataFrame, listings: DataFrame, max_pages: int = 5) -> DataFrame:
    """(walk, page_depth, url, links_before, links): the pages a walk from each seed reaches.

    `seeds` is (url, seq) and `seq` names the walk, so walks may share a start. `listings` is the
    output of `listing_links`, one row per URL. A missing page, or one without a next link, ends
    a walk; a cycle ends at `max_pages`. `links_before` counts the links of a walk's earlier pages.

    Pages are read and parsed once. Walks grow by doubling: in round k every page that a walk has
    reached leaps 2^k pages on, and two leaps make one of the next round, so `max_pages` are reached
    in log2(max_pages) rounds, each one written table. The last round is the one that finds nothing.
    """
    pages = cut(listings.select("url", "links", "next_url"))
    leaps = pages.filter(F.col("next_url").isNotNull()).select(
        "url", F.col("next_url").alias("to"), F.size("links").cast("long").alias("n_links")
    )
    visits = seeds.select(
        F.col("seq").alias("walk"), F.lit(0).alias("page_depth"), "url",
        F.lit(0).cast("long").alias("links_before"),
    )
    span = 1
    while span < max_pages:
        new = visits.join(leaps, "url").filter(F.col("page_depth") + span < max_pages).select(
            "walk",
            (F.col("page_depth") + span).alias("page_depth"),
            F.col("to").alias("url"),
            (F.col("links_before") + F.col("n_links")).alias("links_before"),
        )
        # A page that is not there has no leap, and leaves with the last join.
        both = visits.unionByName(new).withColumn("is_visit", F.lit(True))
        if 2 * span < max_pages:
            then = leaps.select(F.col("url").alias("to"), F.col("to").alias("end"), F.col("n_links").alias("more"))
            longer = leaps.join(then, "to").select(
                "url", F.col("end").alias("to"), (F.col("n_links") + F.col("more")).alias("n_links")
            )
            both = both.unionByName(longer.withColumn("is_visit", F.lit(False)), allowMissingColumns=True)
        else:
            both = both.withColumns({"to": F.lit(None).cast("string"), "n_links": F.lit(None).cast("long")})
        names = [name for name in both.columns if name != "is_visit"]
        both = cut(both.select(*names, "is_visit"), by="is_visit")
        visits = both.filter("is_visit").select("walk", "page_depth", "url", "links_before")
        leaps = both.filter("not is_visit").select("url", "to", "n_links")
        if visits.filter(F.col("page_depth") >= span).isEmpty():
            break
        span *= 2
    return visits.join(pages.select("url", "links"), "url").select(
        "walk", "page_depth", "url", "links_before", "links"
    )


def frontier(visits: DataFrame, chunk_size: int = 10) -> DataFrame:
    """(walk, page_depth, pos, ordinal, chunk_id, url): every link of a walk in order.

    Links are numbered within their page, on from the links of the walk's earlier pages.
    """
    links = visits.select(
        "walk", "page_depth", "links_before", F.posexplode("links").alias("pos", "url")
    )
    ordinal = F.col("links_before") + F.col("pos") + 1
    return links.withColumn("ordinal", ordinal).select(
        "walk", "page_depth", "pos", "ordinal", chunk_id(chunk_size), "url"
    )


def chunk_id(chunk_size: int, ordinal: str = "ordinal") -> Column:
    size = max(1, chunk_size or 1)
    return F.floor((F.col(ordinal) - 1) / size).alias("chunk_id")


def dispatch_summary(
    urls: DataFrame, visits: DataFrame, chunk_size: int = 10, callback: bool = False
) -> DataFrame:
    """One row per walk: how it was cut into chunks, or sent URL by URL."""
    scanned = visits.groupBy("walk").agg(F.count("*").alias("pages_scanned"))
    sent = urls.groupBy("walk").agg(F.count("*").alias("books_dispatched"))
    n = F.coalesce("books_dispatched", F.lit(0))
    chunked = (n > 0) & F.lit(bool(chunk_size and chunk_size > 1))
    size = max(1, chunk_size or 1)
    return scanned.join(sent, "walk", "left").select(
        "walk",
        F.when(chunked, F.lit("chunked")).otherwise(F.lit("per_url")).alias("mode"),
        "pages_scanned",
        n.alias("books_dispatched"),
        F.when(chunked, F.ceil(n / size)).alias("chunks"),
        F.when(chunked, F.lit(chunk_size)).alias("chunk_size"),
        F.when(chunked, F.lit(callback)).alias("webhook_attached"),
    )
