"""Structured data of a page as VARIANT columns."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.urls import col
from pagemill.functions.values import first_that, to_price, to_rating

# How what stands between the strings of a JSON container is spelled as text, and
# how escapes inside its strings are.
SPELLING = ((",", ", "), (":", ": "), ("true", "True"), ("false", "False"), ("null", "None"))
ESCAPES = (("\\b", "\\x08"), ("\\f", "\\x0c"), ("\\u00", "\\x"), ("\\/", "/"))


def json_blocks(ld: Column | str) -> Column:
    """The JSON objects of a page's structured-data scripts, as array<variant>.

    Lists are opened one level and an object with a list under `@graph` stands for its members.
    What does not parse, or is no object, is dropped.
    """
    parsed = F.filter(F.transform(col(ld), F.try_parse_json), lambda v: v.isNotNull())
    single = F.flatten(F.transform(parsed, _as_list))
    members = F.flatten(
        F.transform(
            F.filter(single, _is_object),
            lambda v: F.coalesce(
                F.try_variant_get(v, "$['@graph']", "array<variant>"), F.array(v)
            ),
        )
    )
    return F.filter(members, _is_object)


def json_first(blocks: Column | str, *keys: str) -> Column:
    """The first usable value: block by block, and within a block key by key.

    A dotted key steps into objects; a list met before a step gives its first element.
    JSON null and the empty string do not count.
    """

    def in_block(block: Column) -> Column:
        paths = [path for key in keys for path in _paths(key)]
        return F.coalesce(
            *[first_that(_usable, F.try_variant_get(block, p, "variant")) for p in paths]
        )

    found = F.filter(F.transform(col(blocks), in_block), lambda v: v.isNotNull())
    return F.get(found, F.lit(0))


def json_price(value: Column) -> Column:
    return F.coalesce(_number(value), to_price(json_text(value)))


def json_rating(value: Column) -> Column:
    return F.coalesce(F.rint(_number(value)), to_rating(json_text(value)))


def json_text(value: Column) -> Column:
    """A string value as it stands; other values spelled out, containers as `['a', {'b': 1}]`."""
    kind, text = F.schema_of_variant(value), F.to_json(value)
    return (
        F.when(is_text(value), F.try_variant_get(value, "$", "string"))
        .when(kind == "BOOLEAN", F.initcap(text))
        .when(F.rlike(kind, F.lit("^(OBJECT|ARRAY)")), _spelled(text))
        .otherwise(text)
    )


def _spelled(text: Column) -> Column:
    """A JSON container as text: cut at its quotes, every second part is a string.

    Escaped backslashes and quotes stand aside as two control characters, which JSON text cannot
    hold, while it is cut. A string with an apostrophe and no quote keeps double quotes.
    """
    slash, mark = F.lit("\x01"), F.lit("\x02")
    aside = F.replace(F.replace(text, F.lit("\\\\"), slash), F.lit('\\"'), mark)

    def part(piece: Column, at: Column) -> Column:
        between, inside = piece, piece
        for old, new in SPELLING:
            between = F.replace(between, F.lit(old), F.lit(new))
        for old, new in ESCAPES:
            inside = F.replace(inside, F.lit(old), F.lit(new))
        double = F.contains(inside, F.lit("'")) & ~F.contains(inside, mark)
        single = F.concat(F.lit("'"), F.replace(inside, F.lit("'"), F.lit("\\'")), F.lit("'"))
        string = F.when(double, F.concat(F.lit('"'), inside, F.lit('"'))).otherwise(single)
        return F.when(at % 2 == 0, between).otherwise(string)

    whole = F.array_join(F.transform(F.split(aside, '"'), part), "")
    return F.replace(F.replace(whole, mark, F.lit('"')), slash, F.lit("\\\\"))


def json_text_or_blank(value: Column) -> Column:
    """As `json_text`, with '' for zero, false and empty containers."""
    text = json_text(value)
    blank = ~is_text(value) & text.isin("0", "0.0", "False", "[]", "{}")
    return F.when(blank, F.lit("")).otherwise(text)


def is_text(value: Column) -> Column:
    return F.schema_of_variant(value) == "STRING"


def _as_list(value: Column) -> Column:
    return F.coalesce(value.try_cast("array<variant>"), F.array(value))


def _is_object(value: Column) -> Column:
    return F.startswith(F.schema_of_variant(value), F.lit("OBJECT"))


def _number(value: Column) -> Column:
    """The double behind a JSON number or boolean; null for the other kinds."""
    kind = F.schema_of_variant(value)
    container_or_text = F.rlike(kind, F.lit("^(STRING|OBJECT|ARRAY|VOID)"))
    return F.when(~container_or_text, F.try_variant_get(value, "$", "double"))


def _usable(value: Column) -> Column:
    blank = F.coalesce(F.try_variant_get(value, "$", "string") == "", F.lit(False))
    return value.isNotNull() & ~F.is_variant_null(value) & ~blank


def _paths(key: str) -> list[str]:
    steps = key.split(".")
    choices = [("", "[0]")] * (len(steps) - 1)
    return [
        "$" + "".join(f".{step}{index}" for step, index in zip(steps, (*indexes, "")))
        for indexes in product(*choices)
    ]
