"""From pages to item records: each field is an ordered chain of sources, the first one wins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import values as V
from pagemill.functions.jsonld import (
    is_text,
    json_blocks,
    json_first,
    json_price,
    json_rating,
    json_text,
    json_text_or_blank,
)
from pagemill.functions.urls import bind, strip
from pagemill.operators.html import page_nodes
from pagemill.operators.select import (
    Finder,
    after,
    class_text,
    element,
    first,
    first_text,
    meta_content,
    page_text,
    text_in,
    within,
)


@dataclass(frozen=True)
class Page:
    """The columns a source may read: elements, texts, joined text, structured data."""

    els: Column
    texts: Column
    body: Column
    blocks: Column


Source = Callable[[Page], Column]


def jsonld(*keys: str, read: Callable[[Column], Column] = json_text) -> Source:
    return lambda page: bind(json_first(page.blocks, *keys), read)


def meta(*names: str) -> Source:
    return lambda page: meta_content(page.els, *names)


def css(*finders: Finder) -> Source:
    return lambda page: first_text(page.els, page.texts, *finders)


def classes(*finders: Finder) -> Source:
    return lambda page: class_text(page.els, *finders)


def body(read: Callable[[Column], Column]) -> Source:
    return lambda page: read(page.body)


def title_tag(page: Page) -> Column:
    node = first(F.filter(page.els, lambda n: n["tag"] == "title"))
    return bind(
        bind(node, lambda tag: text_in(page.texts, tag)), lambda text: V.title_head(text)
    )


def through(read: Callable[[Column], Column], source: Source) -> Source:
    return lambda page: bind(source(page), read)


# The sources of each field in order of preference.
PRODUCT_MAIN = element(cls="product_main")
DESCRIPTION = element(ident="product_description")

TITLE: tuple[Source, ...] = (
    jsonld("name", "headline"),
    meta("og:title", "title"),
    css(
        within(element("div", "product_main"), element("h1")),
        within(PRODUCT_MAIN, element("h1")),
        within(element("article"), element("h1")),
        within(element("h1")),
    ),
    title_tag,
)
PRICE: tuple[Source, ...] = (
    jsonld("offers.price", "price", read=json_price),
    through(V.to_price, meta("product:price:amount", "og:price:amount")),
    through(
        V.to_price,
        css(
            within(element("p", "price_color")),
            within(element(cls="price_color")),
            within(element(cls="price")),
            within(element(cls_part="price")),
        ),
    ),
    through(V.to_price, body(V.price_text)),
)
AVAILABILITY: tuple[Source, ...] = (
    jsonld("offers.availability", "availability", read=json_text_or_blank),
    css(
        within(element("p", "availability")),
        within(element("p", "instock")),
        within(element(cls="availability")),
        within(element(cls_part="availab")),
        within(element(cls_part="stock")),
    ),
    body(V.availability_text),
)
RATING: tuple[Source, ...] = (
    jsonld("aggregateRating.ratingValue", "ratingValue", read=json_rating),
    through(
        V.to_rating,
        classes(within(element("p", "star-rating")), within(element(cls_part="star-rating"))),
    ),
    through(V.to_rating, meta("rating")),
    through(V.to_rating, body(V.rating_text)),
)
DESCRIPTION_TEXT: tuple[Source, ...] = (
    jsonld("description", read=json_text_or_blank),
    meta("og:description", "description"),
    css(
        after(DESCRIPTION, element("p")),
        after(DESCRIPTION, element("p"), adjacent=True),
        within(element("div", "product_main"), element("p")),
    ),
)


def extract_records(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per page: the columns of `pages` without the HTML, plus the five item fields.

    A page without a title, or that cannot be read, has null fields (`title is null`).
    """
    return record_fields(page_nodes(pages, html))


def record_fields(nodes: DataFrame) -> DataFrame:
    """The five item fields from the output of `page_nodes`."""
    kept = [name for name in nodes.columns if name not in ("els", "texts", "ld")]
    # The joined text and the JSON objects serve several fields, so they are columns of their own.
    shared = nodes.select(
        *kept,
        "els",
        "texts",
        page_text(F.col("texts")).alias("body"),
        json_blocks("ld").alias("blocks"),
    )
    raw = shared.select(*kept, *_field_columns(nodes.sparkSession.sparkContext))
    found = F.col("title").isNotNull()
    return raw.select(
        *kept,
        "title",
        *[
            F.when(found, F.col(name)).alias(name)
            for name in ("price", "availability", "rating", "description")
        ],
    )


@lru_cache(maxsize=1)
def _field_columns(context: SparkContext) -> tuple[Column, ...]:
    """The field expressions over `els`, `texts`, `body` and `blocks`.

    They are the same for every table, and building them takes thousands of calls into the JVM,
    so they are kept as long as the context is the same.
    """
    page = Page(F.col("els"), F.col("texts"), F.col("body"), F.col("blocks"))
    # A structured title of another type than string spoils the record.
    spoiled = bind(
        json_first(page.blocks, "name", "headline"), lambda v: v.isNotNull() & ~is_text(v)
    )
    titled = F.when(spoiled, F.lit(None)).otherwise(_chain(TITLE, page))
    rating = V.default_to(_chain(RATING, page), float(V.NO_RATING))
    return (
        titled.alias("title"),
        V.default_to(_chain(PRICE, page), V.NO_PRICE).alias("price"),
        bind(_chain(AVAILABILITY, page), V.availability_tail).alias("availability"),
        V.clamp_rating(rating).alias("rating"),
        V.default_to(strip(_chain(DESCRIPTION_TEXT, page)), V.NO_DESCRIPTION).alias("description"),
    )


def items_of(records: DataFrame) -> DataFrame:
    return records.filter(F.col("title").isNotNull())


def unparsed(records: DataFrame) -> DataFrame:
    return records.filter(F.col("title").isNull())


def _chain(sources: tuple[Source, ...], page: Page) -> Column:
    return F.coalesce(*[source(page) for source in sources])
