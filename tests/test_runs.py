"""What must not depend on the size of batches, on one machine's disk, or on chance numbers."""

from __future__ import annotations

import os
import random
import re
import threading
from dataclasses import astuple
from datetime import datetime, timedelta
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pagemill import queries
from pagemill.config import Settings
from pagemill.operators.extract import extract_records
from pagemill.operators.ordering import number_rows
from pagemill.plans import scrape as scrape_plan
from pagemill.plans.catalog import as_requests
from pagemill.plans.scrape import scrape
from pagemill.session import cut, run_folder, shared_folder, side_by_side, tables_of_run
from pagemill.sources import places
from pagemill.sources.places import PLACE, with_places
from pagemill.sources.stores import CrawlStore, latest_hashes
from pagemill.sources.tables import stream_table
from pagemill.streaming import routing
from pagemill.streaming.attempts import Attempt, Crawl, Crawls, crawls_stream, settle

T0 = datetime(2024, 1, 1)
LANDED = "url string, html string, force boolean, use_ai boolean, arrived_at timestamp, seq long"
NO_EXPIRY = Settings(dedup_ttl_sec=None)


def finish(writer, folder):
    query = writer.option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.exception() is None


def land(spark, rows, schema, folder, each=1):
    """A file for every `each` rows, in order."""
    for at in range(0, len(rows), each):
        spark.createDataFrame(rows[at : at + each], schema).coalesce(1).write.mode("append").parquet(folder)


def test_no_folder_on_a_cluster_is_an_error():
    context = SimpleNamespace(master="spark://somewhere:7077", getCheckpointDir=lambda: None)
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: default), sparkContext=context)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(session)


def test_tables_of_a_run_go_with_it(spark):
    with tables_of_run(spark) as outer:
        assert cut(spark.range(3)).count() == 3
        with tables_of_run(spark) as inner:
            cut(spark.range(3))
            assert inner.startswith(outer) and os.listdir(inner)
        assert not os.path.exists(inner) and os.listdir(outer)
    assert not os.path.exists(outer)


def test_steps_side_by_side(spark):
    both = threading.Barrier(2, timeout=60)
    spark.sparkContext.setLocalProperty("pagemill.test", "here")
    found = []

    def step(n):
        both.wait()
        found.append((n, run_folder(spark), spark.sparkContext.getLocalProperty("pagemill.test"), cut(spark.range(n)).count()))

    def fails():
        raise ValueError("one failed")

    try:
        with tables_of_run(spark) as folder:
            with pytest.raises(ValueError, match="one failed"):
                side_by_side(spark, lambda: step(2), fails, lambda: step(3))
            assert sorted(found) == [(2, folder, "here", 2), (3, folder, "here", 3)]
    finally:
        spark.sparkContext.setLocalProperty("pagemill.test", None)


@pytest.mark.parametrize("files", [1, 64])
@pytest.mark.parametrize("incremental", [True, False])
def test_routed_rows_do_not_depend_on_the_trigger(spark, tmp_path, files, incremental):
    bodies = ["<h1>a</h1>", "<h1>b</h1>", "<h1>b</h1>", "", "<p>none</p>"]
    rows = [("u", b, False, False, T0 + timedelta(minutes=i), i) for i, b in enumerate(bodies)]
    land(spark, rows, LANDED, f"{tmp_path}/in", each=2)
    store = CrawlStore(spark, f"{tmp_path}/store")
    settings = Settings(incremental=incremental, dedup_ttl_sec=None)
    stream = stream_table(spark, f"{tmp_path}/in", LANDED, files_per_trigger=files)
    finish(routing.routed_stream(stream, store, settings), tmp_path / "offsets")
    got = sorted(r.status for r in store.results.read().collect())
    assert got == (
        ["parse_failed", "skipped_unchanged", "updated", "updated"] if incremental
        else ["ok", *["skipped_duplicate"] * 4]
    )
    assert store.dead_letters.read().count() == (1 if incremental else 0)


def minute(n):
    return T0 + timedelta(minutes=n)


@pytest.mark.parametrize("files", [1, 1000])
def test_attempts_are_settled_across_batches(spark, tmp_path, files):
    rows = [
        ("a", 1, 503, None, None, minute(0), 0), ("b", 1, None, "timeout", None, minute(0), 1),
        ("c", 2, 200, None, "<h1>c</h1>", minute(2), 2), ("a", 2, 200, None, "<h1>a</h1>", minute(3), 3),
        ("b", 2, 503, None, None, minute(4), 4), ("d", 1, 404, None, None, minute(5), 5), ("c", 1, 429, None, None, minute(1), 6),
        ("b", 3, 500, None, None, minute(7), 7), ("a", 3, 200, None, "<h1>late</h1>", minute(8), 8), ("e", 1, 503, None, None, minute(9), 9),
    ]
    land(spark, rows, routing.ATTEMPTS, f"{tmp_path}/log", each=4)
    store = CrawlStore(spark, f"{tmp_path}/store")

    def go_on():
        stream = stream_table(spark, f"{tmp_path}/log", routing.ATTEMPTS, files_per_trigger=files)
        finish(routing.attempts_stream(stream, store, NO_EXPIRY, gap_sec=3_600, late_sec=7_200), tmp_path / "offsets")

    go_on()
    assert sorted(r.url for r in store.dead_letters.read().collect()) == ["b", "d"]
    # The clock moves on: what is open is closed, and the rest of a decided crawl is none.
    land(spark, [("z", 0, None, None, None, T0 + timedelta(days=2), 10)], routing.ATTEMPTS, f"{tmp_path}/log")
    go_on()
    assert sorted(r.url for r in store.dead_letters.read().collect()) == ["b", "d", "e"]
    assert sorted((r.url, r.title) for r in store.items.current().collect()) == [("a", "a"), ("c", "c")]


def test_crawls_of_many_urls_lie_in_few_rows_of_state(spark, tmp_path):
    """URLs of a group wait, end and time out each for itself, and share their calls and state rows."""
    rows = [(f"u{n}", 1, 503 if n % 3 else 200, None, f"b{n}", minute(n), n) for n in range(60)]
    rows += [(f"u{n}", 2, 404 if n % 3 == 1 else None, None, None, minute(60 + n), 60 + n) for n in range(60) if n % 3]
    rows.append(("z", 0, None, None, None, T0 + timedelta(days=2), 200))
    land(spark, rows, routing.ATTEMPTS, f"{tmp_path}/log", each=50)
    stream = stream_table(spark, f"{tmp_path}/log", routing.ATTEMPTS, files_per_trigger=1)
    crawls = crawls_stream(stream, 3, 3_600, 7_200, groups=2)
    writer = crawls.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp")
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    # Two groups with waiting attempts, spans, timers' values, and a timer with its index.
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 2 * 5
    got = sorted((r.seq, r.attempts, r.html) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(n, 2 if n % 3 else 1, None if n % 3 else f"b{n}") for n in range(60)]


def test_a_url_is_crawled_again(spark, tmp_path):
    rows = [
        ("u", 1, 200, None, "<h1>old</h1>", T0, 0),
        ("u", 1, 503, None, None, T0 + timedelta(days=60), 1), ("u", 2, 200, None, "<h1>new</h1>", T0 + timedelta(days=60, minutes=1), 2),
        ("u", 1, 404, None, None, T0 + timedelta(days=61), 3),
    ]
    land(spark, rows, routing.ATTEMPTS, f"{tmp_path}/log", each=2)
    store = CrawlStore(spark, f"{tmp_path}/store")
    stream = stream_table(spark, f"{tmp_path}/log", routing.ATTEMPTS, files_per_trigger=1)
    finish(routing.attempts_stream(stream, store, Settings(incremental=True)), tmp_path / "offsets")
    assert sorted(r.status for r in store.results.read().collect()) == ["updated", "updated"]
    assert [r.title for r in store.items.current().collect()] == ["new"]
    assert store.dead_letters.read().count() == 1


def test_a_group_asks_the_store_once_a_call():
    asked, timers = [], set()

    class Value:
        kept = None

        def get(self):
            asked.append("get")
            return self.kept

        def update(self, value):
            asked.append("update")
            self.kept = tuple(map(list, value))

        def clear(self):
            asked.append("clear")
            self.kept = None

    handle = SimpleNamespace(getValueState=lambda *_: Value(), registerTimer=timers.add, deleteTimer=timers.discard, listTimers=lambda: iter(timers))
    group = Crawls(3, 10_000_000)
    group.init(handle)

    def call(*rows):
        asked.clear()
        new = pd.DataFrame([(*row, f"b{row[2]}") for row in rows], columns=["url", "at", "seq", "number", "decides", "body"])
        return [(r.url, r.seq, r.attempts, r.html) for r in next(group.handleInputRows((1,), iter([new]), None)).itertuples()]

    def timeout(at):
        asked.clear()
        found = next(group.handleExpiredTimer((1,), SimpleNamespace(getCurrentWatermarkInMs=lambda: at), SimpleNamespace(getExpiryTimeInMs=lambda: min(timers))))
        return sorted((r.url, r.seq, r.attempts, r.html) for r in found.itertuples())

    assert call(("a", 1_000_000, 1, 1, False), ("b", 3_000_000, 2, 1, True)) == [("b", 2, 1, "b2")]
    assert asked == ["get", "update"] and timers == {11_001}
    assert call(("a", 2_000_000, 3, 2, True), ("c", 5_000_000, 4, 1, False)) == [("a", 1, 2, "b3")]
    assert asked == ["get", "update"] and timers == {12_001}
    # The spans of a and b go at their times, and c is closed at its own.
    assert timeout(14_000) == [] and asked == ["get", "update"] and timers == {15_001}
    assert timeout(15_001) == [("c", 4, 1, None)] and asked == ["get", "clear"] and not timers


def test_crawls_are_routed_in_few_steps(spark, tmp_path, monkeypatch):
    """A crawl's page is found by its key, and a micro-batch without crawls is not routed; its tables are there."""
    rows = [(f"u{n}", 1, 404 if n % 2 else 200, None, f"<h1>t{n}</h1>", minute(n), n) for n in range(8)]
    rows += [("z", 0, None, None, None, T0 + timedelta(days=d), 100) for d in (2, 9)]
    land(spark, rows, routing.ATTEMPTS, f"{tmp_path}/log", each=4)
    searched, routed = [], []
    search, run = scrape_plan.with_latest_mark, routing.run_requests
    monkeypatch.setattr(scrape_plan, "with_latest_mark", lambda *a, **b: searched.append(a) or search(*a, **b))
    monkeypatch.setattr(routing, "run_requests", lambda *a, **b: routed.append(a[3]) or run(*a, **b))
    store = CrawlStore(spark, f"{tmp_path}/store")
    stream = stream_table(spark, f"{tmp_path}/log", routing.ATTEMPTS, files_per_trigger=1)
    finish(routing.attempts_stream(stream, store, NO_EXPIRY), tmp_path / "offsets")
    assert sorted(r.url for r in store.dead_letters.read().collect()) == ["u1", "u3", "u5", "u7"]
    assert sorted((r.url, r.title) for r in store.items.current().collect()) == [(f"u{n}", f"t{n}") for n in (0, 2, 4, 6)]
    assert searched == [] and routed == [0, 1]
    for part in ("results", "seen", "dead_letters", "counters", "items"):
        assert "batch_id=2" in os.listdir(f"{tmp_path}/store/{part}/batches")


def test_a_batch_without_requests_replaces_what_it_left(spark, tmp_path):
    store = CrawlStore(spark, f"{tmp_path}")
    store.results.write(spark.createDataFrame([("u", "ok", "t", 1.0)], "url string, status string, title string, price double"), 3)
    store.write_nothing(3, incremental=True)
    assert store.results.read().count() == 0 and store.items.current().count() == 0
    assert store.current_content_state().isEmpty() and not os.path.exists(f"{tmp_path}/items/complete")


def test_a_fetch_log_is_worked_out_once(spark, tmp_path, monkeypatch):
    rows = [("u", 1, 200, None, "<h1>t</h1>", minute(n), n) for n in range(9)]
    log, read = spark.createDataFrame(rows, routing.ATTEMPTS), []
    landed = queries.land
    monkeypatch.setattr(queries, "land", lambda rows, *a: read.extend(rows.inputFiles()) or landed(rows, *a))
    queries.land_log(log.withColumn("seq", F.col("seq") + 1), f"{tmp_path}/log")
    assert read
    found = spark.read.schema(routing.ATTEMPTS).parquet(f"{tmp_path}/log").orderBy("attempted_at").collect()
    assert [r.seq for r in found] == [*range(1, 10), None] and found[-1].attempt == 0


def test_crawls_of_shuffled_attempts():
    """However the attempts are dealt into batches, each crawl comes out once."""
    rng = random.Random(3)
    for _ in range(400):
        want, rows, at = [], [], 0
        for seq in range(0, 40, 10):
            n, kind = rng.choice([1, 2, 3]), rng.choice(["page", "gone", "open"])
            n = 3 if kind == "open" else n
            first = at
            for number in range(1, n + 1):
                last = number == n and kind != "open"
                rows.append(Attempt(at, seq + number, number, last, "x" if last and kind == "page" else None))
                at += rng.randrange(1, 50)
            want.append(Crawl(first, seq + 1, n, "x" if kind == "page" else None))
            rows += [Attempt(at, seq + 9, n + 1, True, "late")] if n < 3 and rng.random() < 0.3 else []
            at += rng.randrange(150, 300)
        rng.shuffle(rows)
        got, waiting, spans = [], [], []
        while rows:
            k = rng.randrange(1, 4)
            batch, rows = rows[:k] + rng.sample(rows[:k], 1), rows[k:]
            done, waiting, spans = settle(waiting + batch, spans, 3, 100)
            got += done
        done, waiting, _ = settle(waiting, spans, 3, 100, closed_before=1 << 40)
        assert sorted(map(astuple, got + done), key=str) == sorted(map(astuple, want), key=str) and not waiting


def test_each_request_sees_its_version(spark):
    pages = [("u", f"<h1>v{m}</h1>", T0 + timedelta(minutes=m), m) for m in (0, 10, 20)]
    asked = [("u", True, False, T0 + timedelta(minutes=m), m) for m in (0, 1, 10, 15, 25)]
    run = scrape(
        spark.createDataFrame(asked + [("x", True, False, T0, 99)], "url string, force boolean, use_ai boolean, arrived_at timestamp, seq long"),
        spark.createDataFrame(pages + pages, "url string, html string, fetched_at timestamp, seq long"),
    )
    got = {r.seq: r.title for r in run.outcome.collect()}
    assert got == {0: "v0", 1: "v10", 10: "v10", 15: "v20", 25: "v20", 99: None}
    assert run.outcome.count() == 6


def test_versions_next_to_requests(spark):
    """Against a plain search; requests and versions often share a moment, and some lack a number."""
    rng = random.Random(5)
    pick = lambda: (rng.choice("uvw"), T0 + timedelta(minutes=rng.randrange(6)), rng.randrange(4))
    pages = sorted({pick() for _ in range(20)})
    asked = sorted({pick() for _ in range(40)}) + [("none", T0, 1)]
    asked += asked[:5]
    have = spark.createDataFrame([(*page, f"<h1>{n}</h1>") for n, page in enumerate(pages)], "url string, fetched_at timestamp, seq long, html string")
    placed = with_places(have.unionByName(have).withColumnRenamed("seq", "version_seq"))
    table = spark.createDataFrame(asked, "url string, arrived_at timestamp, seq long")

    def seen(url, *at):
        mine = [page[1:] for page in pages if page[0] == url]
        return min([x for x in mine if x >= at], default=max(mine, default=(None, None)))

    with_own, wanted = scrape_plan._with_version(table, placed)
    got = sorted((tuple(r) for r in with_own.collect()), key=str)
    assert got == sorted(((*one, *seen(*one)) for one in asked), key=str)
    assert {seen(*one) for one in asked} & {one[1:] for one in asked} and {seen(*one) for one in asked} - {one[1:] for one in asked}
    places_of = {(r.url, r.fetched_at, r.version_seq) for r in wanted.collect()}
    assert places_of == {(one[0], *seen(*one)) for one in asked if one[0] != "none"} and wanted.count() == 2 * len(places_of)


def test_marks_of_earlier_runs_expire(spark):
    asked = spark.createDataFrame(
        [("u", False, False, T0 + timedelta(days=d), d) for d in (0, 1, 2, 3)] + [("u", True, False, T0 + timedelta(days=4), 4), ("u", False, False, T0 + timedelta(days=5), 5)],
        "url string, force boolean, use_ai boolean, arrived_at timestamp, seq long",
    )
    pages = spark.createDataFrame([("u", "<h1>t</h1>")], "url string, html string")
    first = scrape(asked, pages, Settings(dedup_ttl_sec=90_000)).outcome
    assert [r.status for r in first.orderBy("seq").collect()] == ["ok", "skipped_duplicate", "ok", "skipped_duplicate", "ok", "skipped_duplicate"]
    seen = first.limit(1).select("url_key", F.lit(T0 - timedelta(days=30)).alias("seen_at"))
    again = scrape(asked.limit(1), pages, Settings(dedup_ttl_sec=86_400), seen=seen).outcome
    assert [r.status for r in again.collect()] == ["ok"]


def formatted(spark, df):
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def test_no_shuffle_carries_html(spark, tmp_path):
    pages = spark.range(50).select(F.col("id").cast("string").alias("url"), F.lit("<h1>t</h1>").alias("html"))
    pages.write.parquet(f"{tmp_path}/pages")
    placed = with_places(spark.read.parquet(f"{tmp_path}/pages"))
    wanted = cut(placed.select("url", PLACE))
    heads = scrape_plan._heads(placed, wanted, ["url"])
    fields = scrape_plan._fields(placed, wanted.withColumn("use_ai", F.lit(False)), ["url"], None)
    for plan in (formatted(spark, heads), formatted(spark, fields)):
        parts = [x for x in re.split(r"\n\n+", plan) if re.match(r"\(\d+\) Exchange", x)]
        assert parts and not any("html#" in x for x in parts)
    # Choosing the pages does not read them.
    assert "html:string" not in formatted(spark, placed.select("url", PLACE))


@pytest.mark.parametrize("settings", [NO_EXPIRY, Settings(), Settings(incremental=True)])
def test_only_pages_that_are_needed_are_parsed(spark, tmp_path, monkeypatch, settings):
    pages = spark.range(2_000).select(F.format_string("u%d", "id").alias("url"), F.format_string("<h1>t%d</h1>", "id").alias("html"))
    pages.repartition(4).write.parquet(f"{tmp_path}/pages")
    parsed = []

    def counted(rows):
        parsed.append(rows.count())
        return extract_records(rows)

    monkeypatch.setattr(scrape_plan, "extract_records", counted)
    asked = [(f"u{n}", n % 500 == 0, False, T0, n) for n in range(0, 2_000, 100)]
    asked += [(f"u{n}", False, False, minute(1), 5_000 + n) for n in range(0, 2_000, 200)]
    requests = spark.createDataFrame(asked, "url string, force boolean, use_ai boolean, arrived_at timestamp, seq long")
    run = scrape(requests, spark.read.parquet(f"{tmp_path}/pages"), settings)
    # A forced request leaves no hash, so two pages are seen as new twice; each is parsed once.
    assert run.items().count() == (22 if settings.incremental else 20) and sum(parsed) == 20
    # A second run finds all marks, or all hashes, and reads no page that is not forced.
    parsed.clear()
    again = [(f"u{n}", n == 100, False, minute(2), n) for n in range(0, 2_000, 100)]
    run = scrape(
        spark.createDataFrame(again, requests.schema), spark.read.parquet(f"{tmp_path}/pages"), settings,
        seen=run.marks(), stored_hashes=run.outcome.filter("content_sha1 is not null").select("url_key", "content_sha1", F.col("arrived_at").alias("set_at")).distinct(),
    )
    assert run.items().count() == 1 and sum(parsed) == 1


@pytest.mark.parametrize("most", [1, 7, 1_000])
def test_rows_are_read_in_rounds(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(places, "BLOCK", 5)
    spark.range(40).select("id", F.format_string("wide %d", "id").alias("wide")).repartition(3).write.parquet(f"{tmp_path}/t")
    table = with_places(spark.read.parquet(f"{tmp_path}/t"))
    chosen = cut(table.filter("id % 3 = 0").select(PLACE))
    got = places.read_at(table, chosen, lambda rows: rows.select("id", "wide"), most=most)
    assert sorted(r.id for r in got.collect()) == list(range(0, 40, 3))
    assert places.read_at(table, chosen.limit(0), lambda rows: rows.select("id")).count() == 0


def test_numbers_of_far_apart_walks_do_not_meet(spark):
    walks = [1 << 40, 2 << 40, (1 << 62) + 5]
    seeds = spark.createDataFrame([(f"s{w}", T0, w) for w in walks], "url string, arrived_at timestamp, seq long")
    urls = spark.createDataFrame([(w, n, f"{w}/{n}") for w in walks for n in (1, 2, 3)], "walk long, ordinal long, url string")
    got = as_requests(urls, seeds).orderBy("seq").collect()
    assert [r.seq for r in got] == list(range(1, 10))
    assert [r.url for r in got] == [f"{w}/{n}" for w in walks for n in (1, 2, 3)]
    spread = spark.range(1000).select((F.col("id") * (1 << 50)).alias("o"))
    assert [r.ordinal for r in number_rows(spread, "o").orderBy("o").collect()] == list(range(1, 1001))


def test_hashes_of_one_time_are_ordered_by_batch(spark):
    rows = spark.createDataFrame([("k", "old", T0, 1), ("k", "new", T0, 2)], "url_key string, content_sha1 string, set_at timestamp, batch_id long")
    assert latest_hashes(rows).first().content_sha1 == "new"
    assert latest_hashes(rows.orderBy(F.desc("batch_id"))).first().content_sha1 == "new"
