"""Extraction by an outside language model: request rows out, reply rows in.

The model call itself is not part of this package.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.operators.html import page_nodes
from pagemill.operators.select import page_text

# How much page text a request carries, and what stands in for missing fields.
MAX_TEXT = 6_000
NO_TITLE = "Bilinmeyen Başlık"

FIELDS = {
    "title": "name of the product",
    "price": "amount as a number",
    "availability": "stock message",
    "rating": "whole number from 0 to 5",
    "description": "what it is",
}
INSTRUCTION = (
    "Below the line is the text of one product page. Write its facts as a single JSON object and "
    "nothing else. Keys: "
    + "; ".join(f"{name} ({meaning})" for name, meaning in FIELDS.items())
    + ". A fact that is missing is null.\n---\n"
)
_FLOAT = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)\s*$"
_INT = r"^\s*[+-]?\d+\s*$"


def prompt_text(text: Column | str, max_text: int = MAX_TEXT) -> Column:
    """The instruction followed by the first characters of the visible page text."""
    text = F.col(text) if isinstance(text, str) else text
    return F.concat(F.lit(INSTRUCTION), F.left(text, F.lit(max_text)))


def prompt_requests(pages: DataFrame, html: str = "html", max_text: int = MAX_TEXT) -> DataFrame:
    """(url, .., prompt): the columns of `pages` with the HTML replaced by a prompt."""
    nodes = page_nodes(pages, html)
    kept = [name for name in nodes.columns if name not in ("els", "texts", "ld")]
    return nodes.select(*kept, prompt_text(page_text(F.col("texts")), max_text).alias("prompt"))


def decode_replies(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Replace the reply text by the five item fields, null where the reply is unusable.

    A missing, null or otherwise empty value takes its default; a value of the wrong kind makes
    the whole reply unusable.
    """
    kept = [name for name in replies.columns if name != reply]
    parsed = F.try_parse_json(reply)
    is_object = F.coalesce(
        F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")), F.lit(False)
    )
    read = replies.select(*kept, F.when(is_object, parsed).alias("_reply"))
    fields = read.select(
        *kept,
        F.col("_reply").isNotNull().alias("_is_object"),
        _text("title", NO_TITLE).alias("title"),
        _price().alias("price"),
        _text("availability", "unknown").alias("availability"),
        _rating().alias("rating"),
        _text("description", "").alias("description"),
    )
    names = ("title", "price", "availability", "rating", "description")
    usable = F.col("_is_object")
    for name in names:
        usable = usable & F.col(name).isNotNull()
    return fields.select(*kept, *[F.when(usable, F.col(name)).alias(name) for name in names])


def extract_from_replies(pages: DataFrame, replies: DataFrame) -> DataFrame:
    """One row per page with the item fields of its reply; no reply gives null fields."""
    return pages.join(decode_replies(replies.select("url", "reply")), "url", "left")


def _value(name: str) -> Column:
    return F.try_variant_get("_reply", f"$.{name}", "variant")


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _empty(value: Column) -> Column:
    """Null, false, zero, '' and empty containers count as not given."""
    text = F.to_json(value)
    zero = F.rlike(text, F.lit(r"^-?0(\.0*)?([eE][+-]?\d+)?$"))
    return value.isNull() | F.is_variant_null(value) | zero | text.isin("false", '""', "[]", "{}")


def _text(name: str, default: str) -> Column:
    value = _value(name)
    given = F.when(_kind(value) == "STRING", F.try_variant_get(value, "$", "string"))
    return F.when(_empty(value), F.lit(default)).otherwise(given)


def _price() -> Column:
    value = _value("price")
    kind, text = _kind(value), F.try_variant_get(value, "$", "string")
    given = F.when(kind == "STRING", F.when(F.rlike(text, F.lit(_FLOAT)), _number(text)))
    given = given.when(_is_number(kind), F.try_variant_get(value, "$", "double"))
    return F.when(_empty(value), F.lit(0.0)).otherwise(given)


def _rating() -> Column:
    value = _value("rating")
    kind, text = _kind(value), F.try_variant_get(value, "$", "string")
    given = F.when(kind == "STRING", F.when(F.rlike(text, F.lit(_INT)), _number(text)))
    given = given.when(_is_number(kind), F.try_variant_get(value, "$", "double"))
    # Towards zero, then into the scale; both are exact on doubles.
    whole = F.when(given < 0, F.ceil(F.greatest(given, F.lit(-1.0)))).otherwise(
        F.floor(F.least(given, F.lit(5.0)))
    )
    clamped = F.greatest(F.lit(0), F.least(F.lit(5), whole)).cast("int")
    return F.when(_empty(value), F.lit(0)).when(given.isNotNull(), clamped)


def _is_number(kind: Column) -> Column:
    return ~F.rlike(kind, F.lit("^(STRING|OBJECT|ARRAY|VOID)"))


def _number(text: Column) -> Column:
    return F.trim(text).try_cast("double")
