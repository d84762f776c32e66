"""Readings of single field values: prices, ratings, stock texts, titles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.urls import col, strip

# Words, patterns and defaults that decide the extracted results.
RATING_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5}
NUMBER = r"\d+(?:\.\d+)?"
PRICE_IN_TEXT = r"(?U)[£$€₺]\s?[0-9]+(?:[.,][0-9]+)?"
STOCK_IN_TEXT = (
    r"(?iuU)(In stock(?:\s*\([0-9]+\s*available\))?|Out of stock|Stokta(?:\s*yok)?)"
)
RATING_IN_TEXT = r"(?iuU)([0-9](?:\.[0-9])?)\s*(?:/|out of)\s*5"
TITLE_SEPARATOR = r"(?U)\s*[|\-–]\s*"
NO_PRICE = 0.0
NO_RATING = 0
NO_AVAILABILITY = "unknown"
NO_DESCRIPTION = ""
WALL_MARKERS = ("datadome", "cf-browser-verification")


def first_that(test: Callable[[Column], Column], value: Column) -> Column:
    """`value` where the test holds, else null; `value` is worked out once."""
    return F.get(F.filter(F.array(value), test), F.lit(0))


def non_empty(text: Column | str) -> Column:
    return F.nullif(col(text), F.lit(""))


def first_non_empty(*texts: Column | str) -> Column:
    return F.coalesce(*[non_empty(text) for text in texts])


def default_to(value: Column | str, default: object) -> Column:
    return F.coalesce(col(value), F.lit(default))


def to_price(text: Column | str) -> Column:
    """The first unsigned number in the text, with a comma read as the decimal point."""
    dotted = F.replace(col(text), F.lit(","), F.lit("."))
    return non_empty(F.regexp_extract(dotted, NUMBER, 0)).try_cast("double")


def to_rating(text: Column | str) -> Column:
    """A number word anywhere in the text, else its first number rounded half to even."""
    text = col(text)
    lowered = F.lower(text)
    words = F.lit(None).cast("double")
    for word, stars in reversed(RATING_WORDS.items()):
        words = F.when(F.contains(lowered, F.lit(word)), F.lit(float(stars))).otherwise(words)
    number = non_empty(F.regexp_extract(text, NUMBER, 0)).try_cast("double")
    return F.rint(F.coalesce(words, number))


def clamp_rating(rating: Column | str) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(5.0), col(rating).cast("double"))).cast("int")


def price_text(text: Column | str) -> Column:
    return F.regexp_substr(col(text), F.lit(PRICE_IN_TEXT))


def availability_text(text: Column | str) -> Column:
    return F.regexp_substr(col(text), F.lit(STOCK_IN_TEXT))


def rating_text(text: Column | str) -> Column:
    return non_empty(F.regexp_extract(col(text), RATING_IN_TEXT, 1))


def availability_tail(text: Column | str) -> Column:
    """What follows the last slash; `unknown` for no text at all."""
    text = col(text)
    tail = strip(F.substring_index(text, "/", -1))
    return F.when(text.isNull() | (text == ""), F.lit(NO_AVAILABILITY)).otherwise(tail)


def title_head(text: Column | str) -> Column:
    """The part of a page title before its first separator."""
    return non_empty(F.split(col(text), TITLE_SEPARATOR, 2)[0])


def is_block_page(html: Column | str) -> Column:
    """Whether the body is a bot wall rather than a page."""
    lowered = F.lower(F.coalesce(col(html), F.lit("")))
    hits = [F.contains(lowered, F.lit(marker)) for marker in WALL_MARKERS]
    return hits[0] | hits[1]


def number_text(number: Column | str) -> Column:
    """A double in plain notation with at least one decimal, as in `12.0`."""
    plain = col(number).cast("string").try_cast("decimal(38,18)").cast("string")
    trimmed = F.regexp_replace(plain, "0+$", "")
    shown = F.when(F.endswith(trimmed, F.lit(".")), F.concat(trimmed, F.lit("0")))
    return F.coalesce(shown.otherwise(trimmed), col(number).cast("string"))


def status_line(status: Column | str, title: Column | str, price: Column | str) -> Column:
    """One console line per processed URL."""
    status = col(status)
    done = F.concat(
        F.lit("ok: "), F.left(col(title), F.lit(40)), F.lit(" (£"), number_text(price), F.lit(")")
    )
    return (
        F.when(status.isin("ok", "updated"), done)
        .when(status == "skipped_duplicate", F.lit("skip(dup)"))
        .otherwise(status)
    )
