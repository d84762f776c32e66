"""Walks and whole runs, against a plain re-telling of the rules."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pagemill.config import Settings
from pagemill.operators import assisted, frontier, robots
from pagemill.operators.dedup import with_key
from pagemill.plans.catalog import crawl_catalog
from pagemill.plans.local import run_batch, tally
from pagemill.plans.scrape import run_requests, scrape
from pagemill.schemas import REQUESTS, ROBOTS_FILES
from pagemill.session import cut
from pagemill.sources.stores import CrawlStore

T0 = datetime(2024, 1, 1)
SITE = "https://shop.example"
PAGES = "url string, html string"


def product(n):
    return f'<div class="product_main"><h1>Item {n}</h1><p class="price_color">£{n}.00</p></div>'


def listing(hrefs, following=None):
    pods = "".join(
        f'<article class="product_pod"><h3><a{"" if h is None else f" href={chr(34)}{h}{chr(34)}"}>x</a></h3></article>'
        for h in hrefs
    )
    tail = "" if following is None else f'<ul><li class="next"><a href="{following}">n</a></li></ul>'
    return f"<html><body>{pods}{tail}</body></html>"


def seed(spark, *urls):
    return spark.createDataFrame(
        [(u, T0, n) for n, u in enumerate(urls)], "url string, arrived_at timestamp, seq long"
    )


def requests(spark, rows):
    """rows: (url, force) in arrival order"""
    data = [(u, f, False, T0 + timedelta(seconds=n // 2), n) for n, (u, f) in enumerate(rows)]
    return spark.createDataFrame(data, REQUESTS).repartition(3)


def statuses(run):
    return [r["status"] for r in run.outcome.orderBy("seq").collect()]


def test_listing_links(spark):
    base = f"{SITE}/catalogue/page-1.html"
    html = listing(["b/1.html", "../2.html", "b/1.html", None, ""], "page-2.html")
    other = '<article><h3><a href="no"></a></h3></article><article class="product_pod"><a href="no"></a></article><ul class="next"><a href="no"></a></ul>'
    df = spark.createDataFrame([(base, html), (f"{SITE}/x", other)], PAGES)
    got = {r["url"]: r for r in frontier.listing_links(df).collect()}
    assert got[base]["links"] == [
        f"{SITE}/catalogue/b/1.html", f"{SITE}/2.html", f"{SITE}/catalogue/b/1.html", base, base
    ]
    assert got[base]["next_url"] == f"{SITE}/catalogue/page-2.html"
    assert got[f"{SITE}/x"]["links"] == [] and got[f"{SITE}/x"]["next_url"] is None


def chain(spark, following):
    """Listing pages a, b, c.. with one link each and the given next links."""
    rows = [(f"{SITE}/{u}", listing([f"{u}1"], nxt)) for u, nxt in following.items()]
    return spark.createDataFrame(rows, PAGES)


@pytest.mark.parametrize(
    ("following", "cap", "path"),
    [
        ({"a": "b", "b": "c", "c": None}, 5, "abc"),
        ({"a": "b", "b": "c", "c": None}, 2, "ab"),
        ({"a": "b", "b": "c", "c": "a"}, 5, "abcab"),
        ({"a": "b", "b": "gone"}, 5, "ab"),
        ({"a": "a"}, 3, "aaa"),
    ],
)
def test_walk(spark, following, cap, path):
    read = frontier.listing_links(chain(spark, following))
    visits = frontier.walk_listings(seed(spark, f"{SITE}/a", f"{SITE}/none"), read, cap)
    rows = visits.orderBy("page_depth").collect()
    assert "".join(r["url"][-1] for r in rows) == path
    urls = frontier.frontier(visits, 2).orderBy("ordinal").collect()
    assert [r["ordinal"] for r in urls] == list(range(1, len(path) + 1))
    assert [r["chunk_id"] for r in urls] == [n // 2 for n in range(len(path))]


@pytest.mark.parametrize(("pages", "cap", "tables"), [(13, 1_000, 6), (1_000, 1_000, 12), (7, 1, 1)])
def test_a_long_walk_takes_few_tables(spark, monkeypatch, pages, cap, tables):
    written = []

    def counted(df, **how):
        written.append(1)
        return cut(df, **how)

    monkeypatch.setattr(frontier, "cut", counted)
    rows = [(f"p{n}", [f"i{n}"] * (n % 3), f"p{n + 1}" if n + 1 < pages else None) for n in range(pages)]
    read = spark.createDataFrame(rows, "url string, links array<string>, next_url string")
    visits = frontier.walk_listings(seed(spark, "p0", "p3"), read, cap)
    got = [tuple(r) for r in visits.select("walk", "page_depth", "url", "links_before").collect()]
    want = [
        (walk, d, f"p{start + d}", sum(n % 3 for n in range(start, start + d)))
        for walk, start in ((0, 0), (1, 3)) for d in range(min(cap, pages - start))
    ]
    assert sorted(got) == sorted(want) and len(written) <= tables
    # What is left is the one join that fetches the links.
    plan = visits._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1


@pytest.mark.parametrize(("chunk", "mode", "chunks"), [(2, "chunked", 3), (1, "per_url", None)])
def test_catalog(spark, chunk, mode, chunks):
    first = f"{SITE}/catalogue/page-1.html"
    listings = spark.createDataFrame([(first, listing([f"book-{n}.html" for n in range(1, 6)]))], PAGES)
    pages = spark.createDataFrame(
        [(f"{SITE}/catalogue/book-{n}.html", product(n)) for n in range(1, 6)], PAGES
    )
    crawl = crawl_catalog(seed(spark, first), listings, pages, Settings(max_pages=1, chunk_size=chunk))
    summary = crawl.summary.first()
    assert (summary["mode"], summary["books_dispatched"], summary["chunks"]) == (mode, 5, chunks)
    assert crawl.run.items().count() == 5
    assert '"successful_inserts":5' in crawl.event().first()[0]


def test_walks_may_share_a_start(spark):
    read = frontier.listing_links(chain(spark, {"a": "b", "b": None}))
    visits = frontier.walk_listings(seed(spark, f"{SITE}/a", f"{SITE}/a", f"{SITE}/b"), read, 5)
    urls = frontier.frontier(visits, 10)
    got = sorted((r["walk"], r["ordinal"], r["url"][-2:]) for r in urls.collect())
    assert got == [(0, 1, "a1"), (0, 2, "b1"), (1, 1, "a1"), (1, 2, "b1"), (2, 1, "b1")]
    summary = frontier.dispatch_summary(urls, visits, 10).collect()
    assert {r["walk"]: r["pages_scanned"] for r in summary} == {0: 2, 1: 2, 2: 1}


def test_seed(spark):
    df = spark.createDataFrame([(SITE + "/",)], "base_url string")
    assert frontier.seed_urls(df).first()["url"] == f"{SITE}/catalogue/page-1.html"


def by_hand(rows, bodies, seen, keys):
    """Statuses of a run without change tests; a failed fetch leaves no mark."""
    marked, out = set(seen), []
    for url, force in rows:
        key, body = keys[url], bodies.get(url)
        if not force and key in marked:
            out.append("skipped_duplicate")
        elif not body:
            out.append("fetch_failed")
        elif "h1" not in body:
            out.append("parse_failed")
            if not force:
                marked.add(key)
        else:
            out.append("ok")
            marked.add(key)
    return out


def test_run_follows_the_arrival_order(spark):
    rng = random.Random(5)
    names = [f"{SITE}/p{n}" for n in range(8)] + [f"{SITE}/P{n}" for n in range(4)]
    hot = names[0]
    rows = [(hot if rng.random() < 0.3 else rng.choice(names), rng.random() < 0.2) for _ in range(150)]
    bodies = {u: rng.choice([product(n), "<p>no</p>", "", product(n)]) for n, u in enumerate(names)}
    bodies.pop(names[3])
    keys = {u: u.lower() for u in names}
    pages = spark.createDataFrame(list(bodies.items()), PAGES)
    seen = with_key(spark.createDataFrame([(names[5],)], "url string")).select(
        "url_key", F.lit(T0).alias("seen_at")
    )
    run = scrape(requests(spark, rows), pages, seen=seen)
    expected = by_hand(rows, bodies, {keys[names[5]]}, keys)
    assert statuses(run) == expected
    failed = {u for (u, _), s in zip(rows, expected) if s == "fetch_failed"}
    letters = run.dead_letters("run").collect()
    assert {r["url"] for r in letters} == failed and len(letters) == len(failed)
    counts = {r["name"]: r["amount"] for r in run.counter_increments().collect()}
    assert counts == {"pages_processed": expected.count("ok"), "failed_fetch": len(failed)}


def test_incremental_run(spark):
    rows = [("a", False), ("a", False), ("b", False), ("x", False), ("c", False), ("c", True), ("d", False)]
    pages = spark.createDataFrame(
        [("a", product(1)), ("b", product(2)), ("c", "<p>no title</p>"), ("d", product(4))], PAGES
    )
    stored = with_key(spark.createDataFrame([("b",), ("d",)], "url string")).select(
        "url_key",
        F.when(F.col("url") == "b", F.sha1(F.lit(product(2)))).otherwise("old").alias("content_sha1"),
        F.lit(T0 - timedelta(days=1)).alias("set_at"),
    )
    run = scrape(requests(spark, rows), pages, Settings(incremental=True), stored_hashes=stored)
    assert statuses(run) == [
        "updated", "skipped_unchanged", "skipped_unchanged", "fetch_failed", "parse_failed",
        "parse_failed", "updated",
    ]
    # The hash of a page that did not parse is kept too; failed parses leave no mark here.
    assert run.content_state().count() == 3
    assert run.marks().count() == 3


def test_expired_hash_is_processed_again(spark):
    pages = spark.createDataFrame([("a", product(1))], PAGES)
    stored = with_key(spark.createDataFrame([("a",)], "url string")).select(
        "url_key", F.sha1(F.lit(product(1))).alias("content_sha1"),
        F.lit(T0 - timedelta(days=8)).alias("set_at"),
    )
    settings = Settings(incremental=True)
    assert statuses(scrape(requests(spark, [("a", False)]), pages, settings, stored_hashes=stored)) == ["updated"]


def test_robots_deny_a_fetch(spark):
    files = spark.createDataFrame([("shop.example", 200, "User-agent: *\nDisallow: /p1")], ROBOTS_FILES)
    urls = [f"{SITE}/p1", f"{SITE}/p2"]
    pages = spark.createDataFrame([(u, product(1)) for u in urls], PAGES)
    asked = requests(spark, [(u, False) for u in urls])
    rules = robots.default_rules(files)
    assert statuses(scrape(asked, pages, robots=rules)) == ["fetch_failed", "ok"]
    off = Settings(respect_robots=False)
    assert statuses(scrape(asked, pages, off, robots=rules)) == ["ok", "ok"]


def test_too_long_a_title_goes_to_the_dead_letters(spark):
    pages = spark.createDataFrame([("a", f"<h1>{'t' * 600}</h1>")], PAGES)
    run = scrape(requests(spark, [("a", False)]), pages)
    assert statuses(run) == ["store_failed"]
    assert run.items().isEmpty() and run.results().isEmpty()
    assert run.dead_letters("r").first()["error"] == "title is longer than 512"


def test_model_replies(spark):
    rows = [("a", True), ("b", True), ("c", True), ("d", False)]
    data = [(u, False, ai, T0, n) for n, (u, ai) in enumerate(rows)]
    asked = spark.createDataFrame(data, REQUESTS)
    pages = spark.createDataFrame([(u, product(n)) for n, u in enumerate("abd")], PAGES)
    replies = spark.createDataFrame(
        [("a", '{"title": "From reply", "price": "2.5"}'), ("b", "oops"), ("d", '{"title": "no"}')],
        "url string, reply string",
    )
    run = scrape(asked, pages, replies=replies)
    assert statuses(run) == ["ok", "parse_failed", "fetch_failed", "ok"]
    titles = [r["title"] for r in run.outcome.orderBy("seq").collect()]
    assert titles == ["From reply", None, None, "Item 2"]
    assert "Browser fetch failed: c" in run.dead_letters("r").first()["error"]


REPLIES = {
    '{"title": "t", "price": 1, "availability": "in", "rating": 4.9, "description": "d"}': ("t", 1.0, "in", 4, "d"),
    "{}": ("Bilinmeyen Başlık", 0.0, "unknown", 0, ""),
    '{"title": "", "price": null, "rating": "9", "availability": []}': ("Bilinmeyen Başlık", 0.0, "unknown", 5, ""),
    '{"title": "t", "price": " 1e1 ", "rating": -2}': ("t", 10.0, "unknown", 0, ""),
    '{"title": "t", "price": true, "rating": true}': ("t", 1.0, "unknown", 1, ""),
    '{"title": 7}': None,
    '{"title": "t", "price": "abc"}': None,
    '{"title": "t", "price": [1]}': None,
    '{"title": "t", "rating": "4.5"}': None,
    '{"title": "t", "description": {"a": 1}}': None,
    "[]": None,
    "no json": None,
    None: None,
}


def test_replies(spark):
    df = spark.createDataFrame([(n, r) for n, r in enumerate(REPLIES)], "n int, reply string")
    rows = sorted(assisted.decode_replies(df).collect())
    for row, (reply, fields) in zip(rows, REPLIES.items()):
        assert tuple(row)[1:] == (fields or (None,) * 5), reply


def test_prompts_carry_a_bounded_text(spark):
    pages = spark.createDataFrame([("u", f"<p>{'ab ' * 5000}</p><script>x</script>")], PAGES)
    prompt = assisted.prompt_requests(pages).first()["prompt"]
    assert prompt.startswith(assisted.INSTRUCTION)
    assert len(prompt) == len(assisted.INSTRUCTION) + 6000


def test_local_batch(spark):
    rows = [("a", False), ("A ", False), ("b", False), ("c", False), ("d", False), ("b", False)]
    pages = spark.createDataFrame([("a", product(1)), ("b", ""), ("c", "<p>x</p>"), ("d", product(2))], PAGES)
    seen = with_key(spark.createDataFrame([("d",)], "url string"))
    lines = run_batch(requests(spark, rows).drop("force", "use_ai"), pages, seen).orderBy("seq")
    assert [r["line"] for r in lines.collect()] == [
        "ok: Item 1 (£1.0)", "skip(dup)", "fetch_failed", "parse_failed", "skip(dup)", "skip(dup)"
    ]
    assert {r["status"]: r["n"] for r in tally(lines).collect()}["skipped_duplicate"] == 3


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    store = CrawlStore(spark, str(tmp_path))
    pages = spark.createDataFrame([("a", product(1)), ("b", product(2))], PAGES)

    def tables():
        return [
            sorted(map(tuple, t.collect()))
            for t in (store.items.current().drop("id"), store.seen.read(), store.results.read(),
                      store.counters.read(), store.dead_letters.read())
        ]

    first = requests(spark, [("a", False), ("x", False)])
    run_requests(store, first, pages, 0)
    run_requests(store, requests(spark, [("a", False), ("b", False)]), pages, 1)
    once = tables()
    run_requests(store, requests(spark, [("a", False), ("b", False)]), pages, 1)
    assert tables() == once
    assert store.results.read().filter("status = 'skipped_duplicate'").count() == 1
    assert store.dead_letters.read().count() == 1
    assert store.items.current().count() == 2
    for _ in range(2):
        store.compact(1)
        assert tables()[:3] == once[:3] and store.current_content_state().isEmpty()
    run_requests(store, requests(spark, [("a", False), ("x", False)]), pages, 2)
    assert store.results.read().filter("status = 'skipped_duplicate'").count() == 2
    assert store.items.current().count() == 2
