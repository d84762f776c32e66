"""Readings of single values."""

from __future__ import annotations

import pytest

from pagemill.functions import values as V


def one(spark, function, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(function("x")).first()[0]


@pytest.mark.parametrize(
    ("text", "price"),
    [
        ("£48.20", 48.2), ("48,20 EUR", 48.2), ("1,234.50", 1.234), ("-5", 5.0), ("free", None),
        ("", None), (None, None), ("a1b2", 1.0), ("7.", 7.0), (".5", 5.0),
    ],
)
def test_price(spark, text, price):
    assert one(spark, V.to_price, text) == price


@pytest.mark.parametrize(
    ("text", "stars"),
    [
        ("star-rating Three", 3.0), ("Stone", 1.0), ("two or one", 1.0), ("4", 4.0), ("4.5", 4.0),
        ("3.5", 4.0), ("none", 1.0), ("x", None), (None, None), ("12 of 20", 12.0),
    ],
)
def test_rating(spark, text, stars):
    assert one(spark, V.to_rating, text) == stars


@pytest.mark.parametrize(("stars", "clamped"), [(9.0, 5), (-3.0, 0), (2.0, 2), (1e300, 5)])
def test_clamp(spark, stars, clamped):
    assert one(spark, V.clamp_rating, stars, "double") == clamped


@pytest.mark.parametrize(
    ("text", "tail"),
    [
        ("http://schema.org/InStock", "InStock"), (" In stock ", "In stock"), ("a/", ""),
        ("", "unknown"), (None, "unknown"), ("x/ y z", "y z"),
    ],
)
def test_availability(spark, text, tail):
    assert one(spark, V.availability_tail, text) == tail


@pytest.mark.parametrize(
    ("text", "head"),
    [("A Book | Shop", "A Book"), ("Well-known", "Well"), ("X – Y", "X"), ("| Y", None), ("Z", "Z")],
)
def test_title_head(spark, text, head):
    assert one(spark, V.title_head, text) == head


@pytest.mark.parametrize(
    ("text", "price", "stock", "stars"),
    [
        ("now € 9,50 or £8", "€ 9,50", None, None),
        ("IN STOCK (5 available) 4.5 OUT OF 5", None, "IN STOCK (5 available)", "4.5"),
        ("Stokta yok, 3/5", None, "Stokta yok", "3"),
        ("in stock ( 5 available ) $12.", "$12", "in stock", None),
        ("₺ 7 stoktA", "₺ 7", "stoktA", None),
        ("nothing", None, None, None),
    ],
)
def test_texts(spark, text, price, stock, stars):
    df = spark.createDataFrame([(text,)], "x string")
    row = df.select(V.price_text("x"), V.availability_text("x"), V.rating_text("x")).first()
    assert tuple(row) == (price, stock, stars)


@pytest.mark.parametrize(
    "number", [48.2, 7.0, 0.0, 12345678.9, 1e15, 0.001, 1e7, 99999999.99, 0.1 + 0.2]
)
def test_number_text(spark, number):
    assert one(spark, V.number_text, number, "double") == repr(number)


def test_status_lines(spark):
    df = spark.createDataFrame(
        [("ok", "t" * 50, 2.0), ("updated", "u", 3.5), ("skipped_duplicate", None, None),
         ("fetch_failed", None, None), ("parse_failed", None, None)],
        "s string, t string, p double",
    )
    lines = [row[0] for row in df.select(V.status_line("s", "t", "p")).collect()]
    assert lines == [f"ok: {'t' * 40} (£2.0)", "ok: u (£3.5)", "skip(dup)", "fetch_failed", "parse_failed"]


def test_first_non_empty(spark):
    df = spark.createDataFrame([("", None, "c")], "a string, b string, c string")
    assert df.select(V.first_non_empty("a", "b", "c")).first()[0] == "c"
