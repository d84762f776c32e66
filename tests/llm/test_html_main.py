from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from pagemill.llm import html_main
from pagemill.llm.html_main import blocks_of, extract, host_of, kinds


def text_of(source):
    return "\n\n".join(b.text for b, k in zip(blocks_of(source), kinds(blocks_of(source)), strict=True) if k == "article")


@pytest.mark.parametrize(
    "source,want",
    [
        ("<article><h1>A &amp; B</h1><p>one\n  two<br>three</p></article>", "A & B\n\none two three"),
        ("<nav><a>x</a></nav><article><p><b>a<br><p>b &eacute;<p>c</article><footer>f</footer>", "a\n\nb é\n\nc"),
        ("<article><p>a</p><div class='ad'>buy</div><aside>s</aside><p>b</p><form>f<input></form></article>", "a\n\nb"),
        ("<article><script>var t='</p><p>';</script><style>p{}</style><p>x<!-- <p>no --> y</article>", "x y"),
        ("<main><header><h2>T</h2></header><p>x</p><section id=comments><p>no</p></section></main>", "T\n\nx"),
        ("<article><p>1 &lt; 2 and 3 > 2 <i>it</i>s</p><p hidden>h</p><p style='display: none'>h</p></article>", "1 < 2 and 3 > 2 its"),
        ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table><p></p></article>tail", "a\n\nb\n\nc\n\nd"),
        ('<article><a title="x > y">z</a> <img alt="no"> w <wbr>v', "z w v"),
        ("<article>un < closed <b", "un < closed"),
        ("", ""), (None, ""), ("<", ""), ("<!-- open", ""),
    ],
)
def test_blocks(source, want):
    assert text_of(source) == want


LONG = "the text of the page " * 9


@pytest.mark.parametrize(
    "source,want",
    [
        (f'<body class="right-sidebar" style="visibility:hidden"><article><p>{LONG}</p></article></body>', LONG),
        (f"<form action=x><nav>n</nav><article><p>{LONG}</p><form>f</form></article><footer>f</footer></form>", LONG),
        (f'<div class="page sidebar"><main><div class="widget"><article>{LONG}</article></div></main><nav>n</nav></div>', LONG),
        (f'<article><section id="discussion">{LONG}</section><h2 id="modal-logic">Modal logic</h2><h3 class="search">S</h3></article>', f"{LONG}|Modal logic|S"),
        (f'<article data-title="The hidden cost" title=\'a class="ad" b\'>{LONG}</article>', LONG),
        (f'<article class="post has-sidebar ad-hoc">{LONG}<p class="share-price menu-engineering">m</p></article>', f"{LONG}|m"),
        (f'<main id="menu" class="menu">{LONG}<p class="notice">n</p></main>', f"{LONG}|n"),
        (f'<article class="widget">{LONG}</article><article class="promo">p</article>', LONG),
        (f'<article>a<section id="comments"><article>{LONG}</article></section></article>', "a"),
        (f'<main>a<section id="comments">{LONG}</section></main>', "a"),
        (f'<aside><article>teaser</article></aside><article>{LONG}</article>', LONG),
        (f'<article><div class="cookieBanner">c</div><div CLASS=social_links>s</div><div class="x ad">b</div>{LONG}</article>', LONG),
    ],
)
def test_marks_are_whole_names_and_not_of_wrappers(source, want):
    assert text_of(source) == "\n\n".join(x.strip() for x in want.split("|"))


def test_pages_without_an_article():
    hasher = html_main._hasher()
    for source, want in [
        (f'<form id="aspnetForm"><div class="sidebar">s</div><div>{LONG}</div></form>', LONG.strip()),
        (f"<nav>{LONG}</nav>", ""),
        (f'<div class="content sidebar">{LONG}</div><footer>f</footer>', LONG.strip()),
    ]:
        assert html_main.main_text(source, set(), hasher) == want


@pytest.mark.parametrize(
    "source,want",
    [
        # A subject that has the name of furniture stays, one made of links goes.
        (f'<article><p>{LONG}</p><ul class="menu"><li>Soup 5</li><li>Fish 9</li></ul></article>', f"{LONG}|Soup 5|Fish 9"),
        (f'<article><p>{LONG}</p><ul class="menu"><li><a href=/a>Home</a></li><li><a href=/b>About</a> us</li></ul></article>', LONG),
        (f'<article><p>{LONG}</p><div class="search"><p>Search is the topic.</p></div></article>', f"{LONG}|Search is the topic."),
        (f'<article><p>{LONG}</p><div class="sidebar"><ul class="menu"><li>m</li></ul></div></article>', LONG),
        (f'<ul class="menu"><li>Soup</li></ul><article><p>{LONG}</p></article>', LONG),
        # What readers wrote goes, also where it is longer than the article.
        (f'<article><p>Short.</p><article class="comment"><p>{LONG}</p></article><div class="user-comment">{LONG}</div></article>', "Short."),
        (f'<article><p>a</b></i></section>b</p></div><div><p>{LONG}</div></article>', f"a|b|{LONG}"),
    ],
)
def test_doubtful_names_and_readers(source, want):
    assert html_main.main_text(source, set(), html_main._hasher()) == "\n\n".join(x.strip() for x in want.split("|"))


def test_doubtful_elements_go_by_repetition(spark):
    pick = random.Random(4)
    words = lambda n: " ".join(f"k{pick.randrange(3000)}" for _ in range(n))
    notice, quoted = words(20), words(20)
    rows, want = [], {}
    for i in range(12):
        own, body = words(15), words(60)
        rows.append((i, f"http://a.example/{i}", f'<article><p>{body}</p><p>{quoted}</p><div class="widget">{notice}</div><div class="menu">{own}</div></article>'))
        want[i] = "\n\n".join([body, quoted, own])
    rows.append((50, "http://b.example/", f'<article><p>{body}</p><div class="widget">{notice}</div></article>'))
    want[50] = f"{body}\n\n{notice}"
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == want


@pytest.mark.parametrize(
    "source",
    [
        "<div>" * 40_000 + "</a>x" * 160_000,
        "<div class=ad>x" * 60_000,
        "<section>" * 60_000 + "</article>" * 50_000,
        "<b class=ad>" * 40_000 + "<p>x" * 100_000,
    ],
)
def test_parser_is_linear(source):
    start = time.perf_counter()
    blocks_of(source)
    assert time.perf_counter() - start < 8  # under 2 s on a free core; quadratic takes minutes


def brute(rows):
    """Repetition found by comparing every stretch of DEPTH tokens of every two pages of a host."""
    def stream(source):
        return [(i, w) for i, (b, k) in enumerate(zip(blocks_of(source), kinds(blocks_of(source)), strict=True)) if k != "article" for w in b.text.split(" ")]

    def host(url):
        return (url or "").split("//")[-1].split("/")[0] if url else ""

    def grams(source):
        words = [w for _, w in stream(source)]
        return {tuple(words[i : i + html_main.DEPTH]) for i in range(len(words) - html_main.DEPTH + 1)}

    out = []
    for page_id, url, source in rows:
        others = [grams(s) for _, u, s in rows if host(u) == host(url) and (u, s) != (url, source)]
        tokens, blocks = stream(source), blocks_of(source)
        words, inside = [w for _, w in tokens], set()
        for i in range(len(words) - html_main.DEPTH + 1):
            if any(tuple(words[i : i + html_main.DEPTH]) in x for x in others):
                inside.update(range(i, i + html_main.DEPTH))
        kept = []
        for n, (block, kind) in enumerate(zip(blocks, kinds(blocks), strict=True)):
            own = [i for i, (b, _) in enumerate(tokens) if b == n]
            if kind == "article" or (kind == "open" and len([i for i in own if i in inside]) < html_main.COVERED * len(own)):
                kept.append(block.text)
        text = "\n\n".join(kept)
        out.append((page_id is None, page_id or 0, url or "", text, len(text)))
    return sorted(out)


def test_repetition_against_all_pairs(spark):
    pick = random.Random(9)
    words = lambda n: " ".join(f"k{pick.randrange(3000)}" for _ in range(n))
    legal, teaser = words(25), words(12)
    rows = []
    for i in range(40):
        url = f"http://h{i % 3}.example/{i}"
        body = f"<div>{words(30)}</div><div>{legal if i % 4 else words(25)}</div><p>{words(6)}</p><div><p>{teaser}</p>{words(40)}</div>"
        rows.append((i, url, f"<nav>{words(9)}</nav>{body}" if i % 5 else f"<article><p>{legal}</p>{words(20)}</article><div>{legal}</div>"))
    rows += [(90, None, None), (91, None, ""), (None, "http://h0.example/0", f"<p>{words(9)}</p>"), (92, "http://h1.example/z", f"<p>{words(30000)}</p>")]
    rows += [(93, rows[2][1], rows[2][2]), (2, rows[2][1], rows[2][2])]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = sorted((r.page_id is None, r.page_id or 0, r.url or "", r.text, r.n_chars) for r in extract(pages).collect())
    assert got == brute(rows)
    assert any(legal in r[3] for r in got) and any(legal not in r[3] for r in got)
    assert extract(pages.limit(0)).count() == 0


def test_copied_articles_stay(spark):
    pick = random.Random(3)
    words = lambda n: " ".join(f"k{pick.randrange(3000)}" for _ in range(n))
    legal, copied, section = words(20), words(60), words(20)
    rows = [(i, f"http://a.example/{i}", f"<div>{copied if i in (3, 9) else words(40)}</div><p>{legal}</p>") for i in range(150)]
    # The share counts: on 6 of 150 pages, one of them twice under its address.
    rows = [(i, u, s + (f"<div>{section}</div>" if 20 <= i < 26 else "")) for i, u, s in rows] + [(200, *rows[9][1:])] * 9
    rows += [(300 + i, f"http://b.example/{i}", f"<p>{words(20)}</p><div>{legal}</div>") for i in range(3)]
    rows += [(400, "http://c.example/", f"<p>{copied}</p>")]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [copied in got[i] for i in (3, 9, 200, 400)] == [True] * 4
    assert all(section in got[i] for i in range(20, 26))
    assert not any(legal in x for x in got.values())
    assert all(got[i] for i in got)


def test_host(spark):
    urls = ["HTTP://u:p@A.example:80/x", "https://b.example?q", "no", None]
    rows = spark.createDataFrame([(x,) for x in urls], "url string").select(host_of(F.col("url")).alias("h")).collect()
    assert [r.h for r in rows] == ["a.example", "b.example", "", None]
