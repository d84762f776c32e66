"""Item extraction from hand-written pages."""

from __future__ import annotations

from json import dumps

import pytest

from pagemill.operators.extract import extract_records

# One page with two products and decoys around them; the first product counts.
CSS = """<!doctype html><title>Hafen</title>
<main><h1 class="crumb">Aisle 9</h1>
<article><div class="wide product_main">
  <ul><li><p class="old">70</p><li><p class="sum price_color">EUR 48,20</p></ul>
  <section><p class="few availability">17 kettles left</p><h1>Tin kettle</h1>
  <p class="stars star-rating Three"></p></section></div>
<div class="product_main"><h1>Copper kettle</h1><p class="price_color">12</p></div>
<dl id="product_description"><dt>Notes</dt></dl><aside>boils</aside><p>  Sings when hot. </p><p>Two</p>
</article></main>"""
JSONLD = """<h1>Not this</h1><p class="price">1</p>
<script>let x = {"name": "nor this"}</script>
<script type="application/ld+json">
[{"@type": "WebSite", "url": "/"}, {"description": " Knitted, blue. ", "name": "Wool cap",
  "offers": [{"availability": "https://schema.org/PreOrder", "price": "18.90"}, {"price": 2}],
  "aggregateRating": {"reviewCount": 12, "ratingValue": "4"}}]
</script>"""
META = """<meta name="og:title" content="lost"><meta content="Oak stool" property="og:title">
<p class="price">77</p><meta name="description" content="Three legs">
<meta name="og:price:amount" content="6.45 EUR">"""
TEXT = """<title>none</title><section><h1>Brass bell</h1><table><tr><td>£ 3.75<td>
In stock (8 available)</table><q>Rated 2 out of 5 by guests</q></section>"""


def ld(json: str, rest: str = "") -> str:
    return f'<script type="application/ld+json">{json}</script>{rest}'


CONTAINER = ['say "a, b" now', "it's", True, {"k:": None, "x": "\\ \b null"}, [1, 2.5]]

CASES = {
    "css": (
        CSS,
        ("Tin kettle", 48.2, "17 kettles left", 3, "Sings when hot."),
    ),
    "jsonld": (JSONLD, ("Wool cap", 18.9, "PreOrder", 4, "Knitted, blue.")),
    "meta": (META, ("Oak stool", 6.45, "unknown", 0, "Three legs")),
    "text": (TEXT, ("Brass bell", 3.75, "In stock (8 available)", 2, "")),
    "none": ("<html><body>nothing</body></html>", (None,) * 5),
    "empty": ("", (None,) * 5),
    "null": (None, (None,) * 5),
    "clamp_high": (ld('{"name": "x", "ratingValue": 9}'), ("x", 0.0, "unknown", 5, "")),
    "clamp_low": (ld('{"name": "x", "ratingValue": -3}'), ("x", 0.0, "unknown", 0, "")),
    "ld_list": (
        ld('[{"@type": "Thing"}, {"headline": "h", "price": 3}]'),
        ("h", 3.0, "unknown", 0, ""),
    ),
    "ld_graph": (
        ld('{"name": "outer", "@graph": [7, {"name": "inner", "offers": [{"price": "1,5"}]}]}'),
        ("inner", 1.5, "unknown", 0, ""),
    ),
    "ld_container": (
        ld(dumps({"name": "n", "description": CONTAINER})),
        ("n", 0.0, "unknown", 0, str(CONTAINER)),
    ),
    "ld_long_list": (
        ld(dumps({"name": "n", "availability": ["a, b"] * 20_000})),
        ("n", 0.0, str(["a, b"] * 20_000), 0, ""),
    ),
    "ld_invalid": (ld("{oops", ld('{"name": "second"}')), ("second", 0.0, "unknown", 0, "")),
    "ld_repeated_key": (ld('{"name": "a", "name": "b"}'), ("b", 0.0, "unknown", 0, "")),
    "ld_odd_numbers": (
        ld('{"name": "n", "x": NaN, "y": 1e999, "price": 2.50, "ratingValue": Infinity}'),
        ("n", 2.5, "unknown", 0, ""),
    ),
    "ld_price_in_object": (
        ld('{"name": "n", "price": {"amount": "7,5"}, "rating": 3}'),
        ("n", 7.5, "unknown", 0, ""),
    ),
    "ld_nested_list": (
        ld('{"name": "n", "offers": [{"price": [8, 9]}, {"price": 1}], "aggregateRating": []}'),
        ("n", 8.0, "unknown", 0, ""),
    ),
    "ld_container_texts": (
        ld('{"name": "n", "availability": ["http://schema.org/InStock"], "description": {"a": [1, true, "x, y: null"]}}'),
        ("n", 0.0, "InStock']", 0, "{'a': [1, True, 'x, y: null']}"),
    ),
    "ld_boolean_text": (
        ld('{"name": "n", "availability": true, "description": 0}', '<div id="product_description"></div><p>x</p>'),
        ("n", 0.0, "True", 0, ""),
    ),
    "ld_wrong_type": (
        '<script type="application/json">{"name": "no"}</script><h1>H</h1>',
        ("H", 0.0, "unknown", 0, ""),
    ),
    "ld_escapes": (
        ld('{"name": "a \\u00e9 &amp; b", "description": " x\\ny "}'),
        ("a é &amp; b", 0.0, "unknown", 0, "x\ny"),
    ),
    "rating_meta": (
        '<h1>d</h1><meta property="rating" content="4 stars">',
        ("d", 0.0, "unknown", 4, ""),
    ),
    "rating_class_without_word": (
        '<h1>d</h1><p class="star-rating">x</p><meta name="rating" content="two">',
        ("d", 0.0, "unknown", 2, ""),
    ),
    "second_level_descendant": (
        '<div class="product_main"><div><span><h1>deep</h1></span></div><p> </p><p>no</p></div>',
        ("deep", 0.0, "unknown", 0, ""),
    ),
    "self_closing": (
        '<div class="product_main"/><h1>out</h1><div class="product_main"><br/><h1>in</h1></div>',
        ("in", 0.0, "unknown", 0, ""),
    ),
    "template_text_hidden": (
        "<h1>v</h1><template><p>£5 in stock 3/5</p></template>",
        ("v", 0.0, "unknown", 0, ""),
    ),
    "cdata_and_case": (
        '<H1 CLASS="X">Up<![CDATA[ data ]]></H1><P CLASS="Price_color">6</P><P class="price">5</P>',
        ("Updata", 5.0, "unknown", 0, ""),
    ),
    "ld_blank_and_null": (
        ld('{"name": "", "headline": null}', "<h1>H</h1>"),
        ("H", 0.0, "unknown", 0, ""),
    ),
    "ld_number_title": (ld('{"name": 7}', "<h1>H</h1>"), (None,) * 5),
    "ld_object_major": (
        ld('[{"price": 1}, {"offers": {"price": 2}, "name": "n"}]'),
        ("n", 1.0, "unknown", 0, ""),
    ),
    "ld_price_zero": (
        ld('{"name": "n", "price": 0}', '<p class="price">5</p>'),
        ("n", 0.0, "unknown", 0, ""),
    ),
    "ld_price_unreadable": (
        ld('{"name": "n", "price": "free"}', '<p class="price">5</p>'),
        ("n", 5.0, "unknown", 0, ""),
    ),
    "ld_price_true": (ld('{"name": "n", "price": true}'), ("n", 1.0, "unknown", 0, "")),
    "ld_stock_false": (
        ld('{"name": "n", "availability": false}', '<p class="availability">yes</p>'),
        ("n", 0.0, "unknown", 0, ""),
    ),
    "ld_rating_half_even": (ld('{"name": "n", "ratingValue": 4.5}'), ("n", 0.0, "unknown", 4, "")),
    "ld_rating_text": (ld('{"name": "n", "ratingValue": "Stone"}'), ("n", 0.0, "unknown", 1, "")),
    "meta_blank_property": (
        '<meta property="og:title" content=" "><meta name="og:title" content="no">'
        '<meta name="title" content="yes">',
        ("yes", 0.0, "unknown", 0, ""),
    ),
    "thousands": (
        '<h1>t</h1><p class="price_color">1,234.50</p>',
        ("t", 1.234, "unknown", 0, ""),
    ),
    "joined_without_space": ("<h1>Foo <b>Bar</b></h1>", ("FooBar", 0.0, "unknown", 0, "")),
    "title_tag": (
        "<title> A well-known thing | Shop </title>",
        ("A well", 0.0, "unknown", 0, ""),
    ),
    "title_tag_blank_head": ("<title>| Shop</title>", (None,) * 5),
    "first_selector_empty": (
        '<div class="product_main"><h1> </h1></div><article><h1>in article</h1></article>',
        ("in article", 0.0, "unknown", 0, ""),
    ),
    "unclosed": (
        '<div class="product_main"><h1>open<p class="price_color">£3<p class=instock>a/b/ c',
        ("open£3a/b/ c", 3.0, "c", 0, "£3a/b/ c"),
    ),
    "stray_end_tags": (
        '</div></p><div class="product_main"></b><h1>x</h1></div></div>',
        ("x", 0.0, "unknown", 0, ""),
    ),
    "script_is_no_text": (
        '<h1>s</h1><script>var p = "£9 In stock 3/5";</script><style>.a{b:"£8"}</style>',
        ("s", 0.0, "unknown", 0, ""),
    ),
    "sibling_not_child": (
        '<h1>d</h1><div id="product_description"><p>child</p></div><i></i><p>later</p><p>last</p>',
        ("d", 0.0, "unknown", 0, "later"),
    ),
    "star_part": (
        '<h1>d</h1><div class="my-star-ratings Two">x</div>',
        ("d", 0.0, "unknown", 2, ""),
    ),
    "price_part": (
        '<h1>d</h1><b class="old-price">€ 9,5</b><i class="out-stock">Sold Out</i>',
        ("d", 9.5, "Sold Out", 0, ""),
    ),
    "stock_words": (
        "<h1>d</h1><u>OUT OF STOCK</u> 3.5 / 5",
        ("d", 0.0, "OUT OF STOCK", 4, ""),
    ),
    "entities": (
        "<h1>a &amp; b &lt;c&gt; &#8364; &#x41; &#150; &nosuch; &amp</h1>",
        ("a & b <c> € A – &nosuch &", 0.0, "unknown", 0, ""),
    ),
    "duplicate_attribute": (
        '<h1>d</h1><p class="price" class="price_color">4</p>',
        ("d", 4.0, "unknown", 0, ""),
    ),
    "comment_splits_text": ("<h1>a <!-- x --> b</h1>", ("ab", 0.0, "unknown", 0, "")),
}


@pytest.fixture(scope="module")
def extracted(spark):
    rows = [(name, html) for name, (html, _) in CASES.items()]
    pages = spark.createDataFrame(rows, "url string, html string").repartition(3)
    fields = ("title", "price", "availability", "rating", "description")
    return {
        row["url"]: tuple(row[field] for field in fields)
        for row in extract_records(pages).collect()
    }


@pytest.mark.parametrize("case", CASES)
def test_case(extracted, case):
    assert extracted[case] == CASES[case][1]
