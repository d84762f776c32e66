"""The page reader on generated trees and on broken markup, and its Arrow output."""

from __future__ import annotations

from html import escape

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.operators import html as H
from pagemill.operators.html import page_nodes

TEXT = st.text("ab <>&\"'é£\n", min_size=1, max_size=8)
TREE = st.recursive(
    TEXT,
    lambda inner: st.tuples(
        st.sampled_from(["p", "div", "b", "br", "h1", "li"]),
        st.dictionaries(st.sampled_from(["class", "id", "href"]), TEXT, max_size=2),
        st.lists(inner, max_size=4),
    ),
    max_leaves=12,
)


def render(node):
    if isinstance(node, str):
        return escape(node)
    tag, attrs, children = node
    head = "".join(f' {name}="{escape(value)}"' for name, value in attrs.items())
    if tag in H.VOID:
        return f"<{tag}{head}>"
    return f"<{tag}{head}>" + "".join(map(render, children)) + f"</{tag}>"


def flat(nodes):
    """(tag, attrs, depth) of elements and (text, depth) of texts, in document order."""
    out = []

    def walk(children, depth):
        run = ""
        for child in [*children, None]:
            if isinstance(child, str):
                run += child
                continue
            if run.strip():
                out.append((run.strip(), depth))
            run = ""
            if child is not None:
                tag, attrs, inner = child
                out.append((tag, attrs, depth))
                if tag not in H.VOID:
                    walk(inner, depth + 1)

    walk(nodes, 0)
    return out


@settings(max_examples=300, database=None, derandomize=True, deadline=None)
@given(st.lists(TREE, max_size=4))
def test_generated_trees(nodes):
    els, texts, ld = H._PageReader().read("".join(map(render, nodes)))
    spans = [(e[0], e[1]) for e in els]

    def depth(number):
        return sum(start < number < end for start, end in spans)

    seen = [(e[0], (e[4], e[6], depth(e[0]))) for e in els]
    seen += [(number, (text, depth(number))) for number, text in texts]
    assert [item for _, item in sorted(seen, key=lambda pair: pair[0])] == flat(nodes)
    assert ld == []
    by_number = {e[0]: e for e in els}
    for e in els:
        inside = [s for s in els if s[0] < e[0] < s[1]]
        assert e[2] == (max(inside, key=lambda s: s[0])[0] if inside else -1)
        assert e[3] == 1 + sum(s[2] == e[2] and s[0] < e[0] for s in els)
    assert len(by_number) == len(els)


@settings(max_examples=300, database=None, derandomize=True, deadline=None)
@given(st.text("<>/!-ab \"'=&;#x1?[]pdiv", max_size=60))
def test_any_text_is_read_or_refused(markup):
    tree = H._PageReader().read(markup)
    if tree is not None:
        for number, end, parent, *_ in tree[0]:
            assert parent < number < end


def test_broken_markup():
    # An open <p> holds the next one; both end with their parent.
    els, _, _ = H._PageReader().read("<div><p>a<p>b</div>c")
    assert [(e[4], e[2], e[1]) for e in els] == [("div", -1, 5), ("p", 0, 5), ("p", 1, 5)]
    els, texts, _ = H._PageReader().read("<div><b>x</div>y</b><i>z")
    assert [(e[4], e[0], e[1]) for e in els] == [("div", 0, 3), ("b", 1, 3), ("i", 4, 6)]
    assert texts == [(2, "x"), (3, "y"), (5, "z")]


def test_nodes_keep_the_other_columns_in_their_types(spark, monkeypatch):
    monkeypatch.setattr(H, "OUT_CHARS", 50)
    pages = spark.sql(
        "SELECT id, timestamp_seconds(id) AS at, array(id) AS list, "
        "CASE WHEN id % 5 = 0 THEN NULL ELSE concat('<p id=x', id, '>t', id, '</p>') END AS html "
        "FROM range(40)"
    )
    rows = page_nodes(pages).orderBy("id").collect()
    assert len(rows) == 40
    for row in rows:
        assert row["list"] == [row["id"]]
        if row["id"] % 5 == 0:
            assert row["els"] is None and row["texts"] is None and row["ld"] is None
        else:
            assert row["els"][0]["attrs"] == {"id": f"x{row['id']}"}
            assert row["texts"][0]["s"] == f"t{row['id']}"


def test_no_pages(spark):
    assert page_nodes(spark.createDataFrame([], "url string, html string")).collect() == []


def test_bytes_that_are_no_text(spark):
    pages = spark.sql("SELECT 'u' AS url, cast(X'3C703E61FFFE623C2F703E' AS string) AS html")
    assert page_nodes(pages).first()["texts"][0]["s"] == "a\ufffd\ufffdb"


def test_few_pages_are_held_at_a_time():
    """What a worker holds as Python objects does not grow with the batch it is handed."""
    bodies = pa.array([None, *[b"x" * 100_000] * 7, b""], pa.binary())
    runs = list(H._byte_slices(bodies))
    assert [n for run in runs for n in range(*run)] == list(range(9))
    assert max(sum(len(body or b"") for body in bodies.slice(a, b - a).to_pylist()) for a, b in runs) <= 300_000
