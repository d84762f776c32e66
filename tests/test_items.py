"""The item table, its store, paging, and the numbers about runs."""

from __future__ import annotations

import json
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pagemill.operators import items, report
from pagemill.schemas import DEAD_LETTER
from pagemill.schemas import item_defect
from pagemill.sources import stores
from pagemill.sources.stores import CrawlStore, ItemStore

T0 = datetime(2024, 1, 1)
RECORD = (
    "url string, title string, price double, availability string, rating int, "
    "description string, fetched_at timestamp, seq long"
)


def records(spark, *rows):
    """rows: (url, title, minute, seq)"""
    data = [(u, t, 1.0, "yes", 3, "", T0 + timedelta(minutes=m), n) for u, t, m, n in rows]
    return spark.createDataFrame(data, RECORD)


def table(df):
    return {r["url"]: (r["id"], r["title"]) for r in df.collect()}


def test_upserts_keep_ids_and_the_latest_version(spark, tmp_path):
    store = ItemStore(spark, str(tmp_path))
    store.upsert(records(spark, ("b", "b1", 1, 5), ("a", "a1", 2, 6), ("b", "b2", 3, 7)), 0)
    assert table(store.current()) == {"b": (1, "b2"), "a": (2, "a1")}
    second = records(spark, ("c", "c1", 9, 10), ("a", "a2", 4, 11), ("b", "late", 2, 12), ("B", "B1", 1, 9))
    store.upsert(second, 1)
    expected = {"b": (1, "b2"), "a": (2, "a2"), "B": (3, "B1"), "c": (4, "c1")}
    assert table(store.current()) == expected
    store.upsert(second, 1)
    assert table(store.current()) == expected
    store.compact(0)
    assert table(store.current()) == expected
    store.compact(1)
    assert table(store.current()) == expected
    store.upsert(records(spark, ("a", "older", 0, 20), ("d", "d1", 0, 21)), 2)
    assert table(store.current()) == expected | {"d": (5, "d1")}
    assert items.count_items(store.current()).first()[0] == 5


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def seen_store(spark, tmp_path, n=600):
    store = CrawlStore(spark, str(tmp_path)).seen
    marks = spark.range(n).select(F.sha1(F.col("id").cast("string")).alias("url_key"), F.lit(T0).alias("seen_at"))
    store.write(marks, 0)
    store.compact(0)
    return store, marks.select("url_key")


def test_few_keys_open_only_their_buckets(spark, tmp_path):
    store, keys = seen_store(spark, tmp_path)
    # Off, the plan shows the buckets; on, they are passed over all the same.
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", False)
    try:
        found = store.matching(keys.limit(2).unionByName(keys.limit(2)))
        assert found.count() == 2
        assert re.search(r"SelectedBucketsCount: [12] out of 64", plan_of(found))
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")


def test_many_keys_meet_the_snapshot_where_it_lies(spark, tmp_path, monkeypatch):
    store, keys = seen_store(spark, tmp_path)
    monkeypatch.setattr(stores, "FEW_KEYS", 3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = store.matching(keys.limit(500).unionByName(spark.createDataFrame([("new",)], "url_key string")))
        assert found.count() == 500
        plan = plan_of(found)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # The snapshot's side of the join has no exchange; the batches behind it are a scan of their own.
    join = plan[plan.index("SortMergeJoin"):]
    left = join[: join.index("Exchange")]
    assert "Bucketed: true" in left or "SelectedBucketsCount: 64 out of 64" in left


def test_batches_fold_themselves(spark, tmp_path):
    store = ItemStore(spark, str(tmp_path))
    want = {}
    for batch in range(10):
        rows = [("hot", f"h{batch}", batch, 3 * batch), (f"u{batch % 4}", f"v{batch}", batch, 3 * batch + 1), (f"n{batch}", "n", batch, 3 * batch + 2)]
        for _ in range(2 if batch in (8, 9) else 1):
            store.upsert(records(spark, *rows), batch)
        for url, title, *_ in rows:
            want[url] = (want.get(url, (len(want) + 1, ""))[0], title)
    assert table(store.current()) == want
    last = store.versions._last_snapshot(None)
    assert (last["upto"], last["buckets"], last["top"]) == (7, 64, max(n for n, _ in (want[u] for u in want if u not in ("n8", "n9"))))
    # Each batch reads, besides the snapshot, what came after it.
    assert store.versions._layers(9)[1].select("batch_id").distinct().count() == 1


def test_a_snapshot_that_was_cut_short_is_not_read(spark, tmp_path):
    store, keys = seen_store(spark, tmp_path, 20)
    store.write(spark.createDataFrame([("late", T0)], "url_key string, seen_at timestamp"), 1)
    name = store._snapshot_table(1, 8)
    spark.createDataFrame([("half", T0)], "url_key string, seen_at timestamp").write.insertInto(name, overwrite=True)
    assert store.read().count() == 21
    store.compact(1)
    assert store.read().count() == 21 and store.matching(keys).count() == 20


def test_a_tie_in_time_is_decided_by_seq(spark, tmp_path):
    store = ItemStore(spark, str(tmp_path))
    store.upsert(records(spark, ("a", "first", 1, 1), ("a", "second", 1, 2)), 0)
    assert table(store.current()) == {"a": (1, "second")}


def test_pages(spark, monkeypatch):
    df = spark.range(1, 31).select("id", F.col("id").cast("string").alias("title"))
    assert [r["id"] for r in items.items_page(df, 5, 10).collect()] == [20, 19, 18, 17, 16]
    monkeypatch.setattr(items, "TOP_K_OFFSET", 3)
    assert [r["id"] for r in items.items_page(df, 5, 10).collect()] == [20, 19, 18, 17, 16]
    assert items.items_page(df, 5, 100).collect() == []
    for limit, offset in ((0, 0), (501, 0), (10, -1)):
        with pytest.raises(ValueError):
            items.items_page(df, limit, offset)


def test_a_page_comes_with_the_total(spark):
    df = spark.range(1, 31).select("id", F.col("id").cast("string").alias("title"))
    row = items.items_listing(df, 3, 2).first()
    assert row["total"] == 30 and [tuple(r) for r in row["items"]] == [(28, "28"), (27, "27"), (26, "26")]
    row = items.items_listing(df, 3, 99).first()
    assert (row["total"], row["items"]) == (30, [])


def test_row_checks(spark):
    rows = records(spark, ("u", "t" * 513, 0, 1), ("u", "t" * 512, 0, 2), ("u" * 1025, "t", 0, 3), ("u", None, 0, 4))
    assert [r["seq"] for r in items.storable(rows).collect()] == [2]
    judged = rows.select("seq", item_defect().alias("error")).filter("error is not null")
    bad = {r["seq"]: r["error"] for r in judged.collect()}
    assert bad == {
        1: "title is longer than 512", 3: "url is longer than 1024", 4: "title is missing"
    }


def test_store_starts_empty(spark, tmp_path):
    store = CrawlStore(spark, str(tmp_path / "new"))
    for part in (store.results, store.seen, store.dead_letters, store.counters):
        assert part.read().isEmpty()
    assert store.items.current().isEmpty()
    assert store.current_content_state().isEmpty()


def results(spark, *statuses):
    return spark.createDataFrame([(s,) for s in statuses], "status string")


def test_metrics(spark, tmp_path):
    done = results(spark, "ok", "updated", "fetch_failed", "parse_failed", "ok")
    log = report.counter_increments(done).unionByName(report.counter_increments(done))
    letters = results(spark, "x", "y")
    snap = report.metrics_snapshot(log, letters, results(spark, *["i"] * 7))
    lines = [r["line"] for r in report.metrics_text(snap).orderBy("line_no").collect()]
    assert len(lines) == 12
    assert [line.split()[-1] for line in lines if not line.startswith("#")] == ["6", "2", "2", "7"]
    assert lines[0].startswith("# HELP pagemill_pages_processed_total ")
    assert lines[1] == "# TYPE pagemill_pages_processed_total counter"
    report.write_metrics_text(snap, str(tmp_path / "metrics"))
    written = next((tmp_path / "metrics").glob("part-*")).read_text(encoding="utf-8")
    assert written == "\n".join(lines) + "\n"
    assert {r["status"]: r["n"] for r in report.status_counts(done).collect()}["ok"] == 2
    assert [r["value"] for r in report.counters(log.limit(0)).collect()] == [0, 0]


def test_completion_event(spark):
    df = report.completion_event(results(spark, "ok", "updated", "parse_failed"), 2, 3, True)
    assert json.loads(df.first()[0]) == {
        "event": "scraping_completed",
        "meta": {"pages_scanned": 2, "books_dispatched": 3, "ai_used": True},
        "total_processed": 3,
        "successful_inserts": 2,
    }


def test_dead_letters_read_oldest_first(spark):
    rows = [("t", f"id{n}", [f"u{n}"], "e", f"u{n}", T0 + timedelta(seconds=-n)) for n in range(5)]
    payloads = report.dead_letter_payload(spark.createDataFrame(rows, DEAD_LETTER))
    broken = spark.createDataFrame(
        [("{oops", "u", T0 - timedelta(days=1)), ("7", "u", T0 - timedelta(days=1))],
        "payload string, url string, failed_at timestamp",
    )
    got = report.read_dead_letters(payloads.unionByName(broken), 4).collect()
    assert [(r["task_id"], r["args"]) for r in got] == [("id4", ["u4"]), ("id3", ["u3"])]
    for limit in (0, 1001):
        with pytest.raises(ValueError):
            report.read_dead_letters(payloads, limit)
