"""Line dedup by site-relative frequency.

Per host, each distinct line gets the share of the host's pages that contain it; lines above
`ratio` on at least `least_pages` pages are boilerplate and are dropped from every page of the
host. Lines are compared without the spaces around them, by a 64-bit hash; blank lines are
neither counted nor dropped. Pages without a host (null) are a host of their own, and a page with
a null text counts as a page without lines.

Each page sends every distinct line once, as (host, hash), into a partial count, so a line that
all pages of a hot host share is one row per map task. What comes back to the pages is one array
per host: at most (mean distinct lines per page / ratio) hashes. The join that brings it is left to
the planner: the arrays lie in a written table, so they are broadcast if they are small, and
otherwise AQE splits the rows of a hot host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.session import cut

RATIO, LEAST_PAGES = 0.1, 5


def line_key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def is_blank(line: Column) -> Column:
    return F.trim(line) == ""


def site_lines(pages: DataFrame, host: str, text: str) -> DataFrame:
    """(host, line hash) and the number of the host's pages that contain the line."""
    lines = F.filter(F.split(text, "\n"), lambda x: ~is_blank(x))
    return (
        pages.select(F.col(host).alias("host"), F.explode(F.array_distinct(F.transform(lines, line_key))).alias("line"))
        .groupBy("host", "line")
        .agg(F.count("*").alias("pages"))
    )


def boilerplate(pages: DataFrame, host: str, text: str, ratio: float, least_pages: int) -> DataFrame:
    """host, its page total, and the hashes of its boilerplate lines."""
    totals = pages.groupBy(F.col(host).alias("total_host")).agg(F.count("*").alias("total"))
    common = site_lines(pages, host, text).filter(F.col("pages") >= least_pages)
    return (
        common.join(totals, F.col("host").eqNullSafe(F.col("total_host")))
        .filter(F.col("pages") > ratio * F.col("total"))
        .groupBy("host")
        .agg(F.sort_array(F.collect_list("line")).alias("drop_lines"))
    )


def drop_lines(
    pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES
) -> DataFrame:
    """The pages, with all their columns, without their hosts' boilerplate lines.

    Rows are never dropped: a page of which every line is boilerplate keeps an empty text, and a
    null text stays null. Order and spaces of the lines that stay are kept.
    """
    names = pages.columns
    found = cut(boilerplate(pages, host, text, ratio, least_pages))
    own, drop = F.col(f"page.`{text}`"), F.col("found.drop_lines")
    kept = F.array_join(F.filter(F.split(own, "\n"), lambda x: is_blank(x) | ~F.array_contains(drop, line_key(x))), "\n")
    clean = F.when(drop.isNull() | own.isNull(), own).otherwise(kept)
    return (
        pages.alias("page")
        .join(found.alias("found"), F.col(f"page.`{host}`").eqNullSafe(F.col("found.host")), "left")
        .select(*[clean.alias(x) if x == text else F.col(f"page.`{x}`") for x in names])
    )
