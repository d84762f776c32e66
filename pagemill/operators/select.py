"""Choosing elements of a page and reading their text, as column expressions.

A test is a function from an element column to a boolean column. A chain of tests reads like a
CSS selector with spaces: the last test is the wanted element, the ones before it are ancestors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.urls import bind, strip
from pagemill.functions.values import first_that

Test = Callable[[Column], Column]
Finder = Callable[[Column], Column]

HITS = 256


def element(
    tag: str | None = None,
    cls: str | None = None,
    ident: str | None = None,
    cls_part: str | None = None,
) -> Test:
    """A test on tag name, one class name, id, and a part of the class attribute."""

    def test(node: Column) -> Column:
        checks = []
        if tag is not None:
            checks.append(node["tag"] == tag)
        if cls is not None:
            checks.append(F.contains(node["cls"], F.lit(f" {cls} ")))
        if cls_part is not None:
            checks.append(F.contains(node["cls"], F.lit(cls_part)))
        if ident is not None:
            checks.append(F.coalesce(node["attrs"]["id"] == ident, F.lit(False)))
        whole = checks[0]
        for check in checks[1:]:
            whole = whole & check
        return whole

    return test


def within(*chain: Test) -> Finder:
    """All elements that match the last test and have the others as ancestors, outermost first.

    One pass in document order. For each ancestor step it carries how far the matches met so far
    reach: an element lies in one of them if it stands before that end.
    """
    *outer, wanted = chain
    if not outer:
        return lambda els: F.filter(els, wanted)
    ends = [f"end{step}" for step in range(len(outer))]

    def find(els: Column) -> Column:
        none = F.slice(els, 1, 0)
        start = F.struct(
            *[F.lit(0).alias(name) for name in ends],
            none.alias("hits"),
            F.slice(F.array(none), 1, 0).alias("full"),
        )

        def step(kept: Column, node: Column) -> Column:
            moved = []
            for at, (name, test) in enumerate(zip(ends, outer)):
                inside = test(node) & (node["i"] < kept[ends[at - 1]]) if at else test(node)
                end = F.when(inside, F.greatest(kept[name], node["e"])).otherwise(kept[name])
                moved.append(end.alias(name))
            hit = (node["i"] < kept[ends[-1]]) & wanted(node)
            # Full runs of hits are set aside, since a list is copied whenever it grows.
            is_full = F.size(kept["hits"]) >= HITS
            open_run = F.when(is_full, F.slice(kept["hits"], 1, 0)).otherwise(kept["hits"])
            hits = F.when(hit, F.concat(open_run, F.array(node))).otherwise(open_run)
            full = F.when(is_full, F.concat(kept["full"], F.array(kept["hits"])))
            return F.struct(*moved, hits.alias("hits"), full.otherwise(kept["full"]).alias("full"))

        return F.aggregate(
            els, start, step, lambda kept: F.flatten(F.concat(kept["full"], F.array(kept["hits"])))
        )

    return find


def after(anchor: Test, wanted: Test, adjacent: bool = False) -> Finder:
    """Elements that follow an `anchor` among the children of one parent."""

    def follows(a: Column, n: Column) -> Column:
        gap = (n["k"] == a["k"] + 1) if adjacent else (n["k"] > a["k"])
        return (a["p"] == n["p"]) & gap

    def find(els: Column) -> Column:
        return bind(
            F.filter(els, anchor),
            lambda anchors: F.filter(
                els, lambda n: wanted(n) & F.exists(anchors, lambda a: follows(a, n))
            ),
        )

    return find


def first(found: Column) -> Column:
    return F.get(found, F.lit(0))


def text_in(texts: Column, node: Column, sep: str = "") -> Column:
    """The texts inside an element, each already stripped, joined by `sep`."""
    inside = F.filter(texts, lambda t: (t["i"] > node["i"]) & (t["i"] < node["e"]))
    return F.array_join(F.transform(inside, lambda t: t["s"]), sep)


def page_text(texts: Column) -> Column:
    return F.array_join(F.transform(texts, lambda t: t["s"]), " ")


def first_text(els: Column, texts: Column, *finders: Finder) -> Column:
    """Per finder the text of its first element; the first that is not empty."""
    return F.coalesce(
        *[
            _not_blank(bind(first(find(els)), lambda node: text_in(texts, node)))
            for find in finders
        ],
        F.lit(None),
    )


def meta_content(els: Column, *names: str) -> Column:
    """Per name the `property` tag, else the `name` tag; a blank content moves to the next name."""

    def tagged(attr: str, name: str) -> Column:
        return first(F.filter(els, lambda n: (n["tag"] == "meta") & (n["attrs"][attr] == name)))

    def content(name: str) -> Column:
        tag = F.coalesce(tagged("property", name), tagged("name", name))
        return _not_blank(strip(tag["attrs"]["content"]))

    return F.coalesce(*[content(name) for name in names], F.lit(None))


def class_text(els: Column, *finders: Finder) -> Column:
    """The class names of the first element any finder has."""
    return F.trim(F.coalesce(*[first(find(els)) for find in finders], F.lit(None))["cls"])


def _not_blank(text: Column) -> Column:
    return first_that(lambda value: value != "", text)
