"""Streams give the same rows as the batch operators, also when they stop and go on."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pagemill.config import Settings
from pagemill.operators import change, dedup
from pagemill.schemas import CONTENT_STATE
from pagemill.sources.stores import BatchTable, CrawlStore, ItemStore
from pagemill.sources.tables import stream_table
from pagemill.streaming import first_seen, routing, stateful
from tests.test_dedup import random_rows, seqs, ttl_by_hand
from tests.test_items import RECORD, records, table
from tests.test_plans import product

T0 = datetime(2024, 1, 1)
OBSERVED = "url_key string, fetched_at timestamp, content_sha1 string, seq long"


@pytest.fixture
def landed(spark, tmp_path):
    """Observations in four files, in time order from file to file, mixed inside a file."""
    rows = sorted(random_rows(n=240), key=lambda r: r[1])
    data = [(k, T0 + timedelta(seconds=s), v, n) for n, (k, s, v) in enumerate(rows)]
    folder = str(tmp_path / "landed")
    for part in range(4):
        chunk = data[part * 60 : (part + 1) * 60][::-1]
        spark.createDataFrame(chunk, OBSERVED).coalesce(1).write.mode("append").parquet(folder)
    return rows, folder


def run(writer, checkpoint):
    query = writer.option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def source(spark, folder, schema):
    return stream_table(spark, folder, schema, files_per_trigger=1)


def test_first_seen(spark, tmp_path, landed):
    rows, folder = landed
    seen = BatchTable(spark, str(tmp_path / "seen"), "url_key string, seen_at timestamp")
    passed = BatchTable(spark, str(tmp_path / "passed"), "url_key string, fetched_at timestamp, seq long")
    writer = first_seen.first_seen_stream(
        source(spark, folder, OBSERVED), seen, passed, ts="fetched_at"
    )
    run(writer, tmp_path / "cp")
    batch = dedup.first_seen(spark.read.parquet(folder), ts="fetched_at")
    keys = {r["url_key"] for r in batch.collect()}
    assert {r["url_key"] for r in passed.read().collect()} == keys
    assert passed.read().count() == seen.read().count() == len(keys)


def test_expiring_marks_in_a_table(spark, tmp_path, landed):
    rows, folder = landed
    seen = BatchTable(spark, str(tmp_path / "seen"), "url_key string, seen_at timestamp")
    passed = BatchTable(spark, str(tmp_path / "passed"), "url_key string, fetched_at timestamp, seq long")
    stream = source(spark, folder, OBSERVED)
    run(
        first_seen.first_seen_stream(stream, seen, passed, ts="fetched_at", ttl_sec=3_600),
        tmp_path / "cp",
    )
    assert seqs(passed.read()) == ttl_by_hand(rows, 3_600)


def test_changes_in_a_table(spark, tmp_path, landed):
    rows, folder = landed
    state = BatchTable(spark, str(tmp_path / "state"), CONTENT_STATE)
    flagged = BatchTable(spark, str(tmp_path / "flagged"), OBSERVED + ", changed boolean")
    stream = source(spark, folder, OBSERVED)
    run(first_seen.changed_stream(stream, state, flagged, ttl_sec=7_200), tmp_path / "cp")
    batch = change.content_changed_ttl(spark.read.parquet(folder), 7_200)
    assert flagged.read().count() == len(rows)
    assert seqs(flagged.read().filter("changed")) == seqs(batch.filter("changed"))


@pytest.mark.parametrize("ttl", [3_600, 86_400])
def test_expiring_marks(spark, tmp_path, landed, ttl):
    rows, folder = landed
    stateful.use_rocksdb(spark)
    accepted = stateful.ttl_first_seen_stream(source(spark, folder, OBSERVED), ttl, ts="fetched_at")
    out = str(tmp_path / "out")
    run(accepted.writeStream.format("parquet").option("path", out), tmp_path / "cp")
    assert seqs(spark.read.parquet(out)) == ttl_by_hand(rows, ttl)


@pytest.mark.parametrize("ttl", [None, 7_200])
def test_changes(spark, tmp_path, landed, ttl):
    rows, folder = landed
    flagged = stateful.content_changed_stream(source(spark, folder, OBSERVED), ttl)
    out = str(tmp_path / "out")
    run(flagged.writeStream.format("parquet").option("path", out), tmp_path / "cp")
    batch = change.content_changed_ttl(spark.read.parquet(folder), ttl)
    got = spark.read.parquet(out)
    assert got.count() == len(rows)
    assert seqs(got.filter("changed")) == seqs(batch.filter("changed"))


def test_many_keys_are_few_rows_of_state(spark, tmp_path):
    """Calls into the worker and the store go by group, and give what the batch operators give."""
    rows = [(None if n % 90 == 7 else f"k{n % 90}", T0 + timedelta(minutes=n // 90 * 50), "ab"[n % 4 // 2], n) for n in range(360)]
    for start in (0, 180):
        spark.createDataFrame(rows[start : start + 180], OBSERVED).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    batch = spark.read.parquet(f"{tmp_path}/in")
    for name, found, want in (
        ("changed", stateful.content_changed_stream(source(spark, f"{tmp_path}/in", OBSERVED), 7_200, groups=3), change.content_changed_ttl(batch, 7_200).filter("changed")),
        ("marks", stateful.ttl_first_seen_stream(source(spark, f"{tmp_path}/in", OBSERVED), 3_600, ts="fetched_at", groups=3), None),
    ):
        writer = found.writeStream.format("parquet").option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/cp-{name}")
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 3
        got = spark.read.parquet(f"{tmp_path}/{name}")
        if want is None:
            assert got.groupBy("url_key").count().filter("count = 2").count() == 90
        else:
            assert got.count() == 360 and seqs(got.filter("changed and url_key is not null")) == seqs(want.filter("url_key is not null"))
            assert {r.url_key for r in got.collect()} == {r[0] for r in rows}


class Value:
    """A value state of one key."""

    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value


def test_changes_against_a_fold_with_nulls_and_late_rows():
    pick = random.Random(1)
    for n in range(3_000):
        ttl, base, kept, kept_at = pick.choice([None, 3, 8]), 0, None, 0
        processor = stateful.ContentHash(ttl)
        processor.stored = Value()
        for _ in range(3):
            size = pick.randrange(1, 9)
            at = sorted(base + pick.randrange(12) for _ in range(size))
            base += pick.randrange(12)
            hashes = [pick.choice(["a", "a", "b", None] if n % 2 else ["a", "b"]) for _ in range(size)]
            rows = pd.DataFrame({"at": at, "seq": range(size), "content_sha1": pd.Series(hashes, dtype=object)})
            got = next(processor.handleInputRows(("k",), iter([rows]), None))["changed"]
            want = []
            for t, x in zip(at, hashes, strict=True):
                want.append(kept is None or kept != x or (ttl is not None and t > kept_at + ttl))
                if want[-1]:
                    kept, kept_at = x, t
            assert list(got) == want


def test_upserts_of_two_files(spark, tmp_path):
    folder = str(tmp_path / "in")
    records(spark, ("a", "a1", 1, 1), ("b", "b1", 1, 2)).coalesce(1).write.parquet(folder)
    store = ItemStore(spark, str(tmp_path / "items"))
    stream = source(spark, folder, RECORD)
    run(routing.upsert_stream(stream, store), tmp_path / "cp")
    records(spark, ("a", "a2", 2, 3), ("c", "c1", 2, 4)).coalesce(1).write.mode("append").parquet(folder)
    run(routing.upsert_stream(stream, store), tmp_path / "cp")
    assert table(store.current()) == {"a": (1, "a2"), "b": (2, "b1"), "c": (3, "c1")}


LANDED = "url string, html string, force boolean, use_ai boolean, arrived_at timestamp, seq long"


def write_landed(spark, folder, rows, start):
    data = [
        (u, h, False, False, T0 + timedelta(minutes=start + n), start + n)
        for n, (u, h) in enumerate(rows)
    ]
    spark.createDataFrame(data, LANDED).coalesce(1).write.mode("append").parquet(folder)


def test_routing(spark, tmp_path):
    folder = str(tmp_path / "in")
    store = CrawlStore(spark, str(tmp_path / "store"))
    write_landed(spark, folder, [("a", product(1)), ("a", product(1)), ("x", None), ("y", "<p>")], 0)
    run(routing.routed_stream(source(spark, folder, LANDED), store), tmp_path / "cp")
    write_landed(spark, folder, [("a", product(1)), ("x", product(2)), ("y", product(3))], 10)
    run(routing.routed_stream(source(spark, folder, LANDED), store), tmp_path / "cp")
    got = sorted((r["url"], r["status"]) for r in store.results.read().collect())
    assert got == [
        ("a", "ok"), ("a", "skipped_duplicate"), ("a", "skipped_duplicate"), ("x", "ok"),
        ("y", "parse_failed"), ("y", "skipped_duplicate"),
    ]
    assert [r["url"] for r in store.dead_letters.read().collect()] == ["x"]
    assert {r["title"] for r in store.items.current().collect()} == {"Item 1", "Item 2"}
    counts = store.counters.read().groupBy("name").agg(F.sum("amount").alias("n")).collect()
    assert {r["name"]: r["n"] for r in counts} == {"pages_processed": 2, "failed_fetch": 1}


def test_routing_with_change_tests(spark, tmp_path):
    folder = str(tmp_path / "in")
    store = CrawlStore(spark, str(tmp_path / "store"))
    settings = Settings(incremental=True)
    write_landed(spark, folder, [("a", product(1)), ("b", product(2))], 0)
    run(routing.routed_stream(source(spark, folder, LANDED), store, settings), tmp_path / "cp")
    write_landed(spark, folder, [("a", product(9)), ("b", product(2))], 10)
    run(routing.routed_stream(source(spark, folder, LANDED), store, settings), tmp_path / "cp")
    got = sorted((r["url"], r["status"]) for r in store.results.read().collect())
    assert got == [("a", "updated"), ("a", "updated"), ("b", "skipped_unchanged"), ("b", "updated")]
    assert {r["title"] for r in store.items.current().collect()} == {"Item 9", "Item 2"}


def test_attempts(spark, tmp_path):
    folder = str(tmp_path / "in")
    schema = "url string, attempt int, status int, error string, body string, attempted_at timestamp, seq long"
    rows = [
        ("a", 1, 503, None, None, T0, 1), ("a", 2, 200, None, product(1), T0, 2),
        ("b", 1, 500, None, None, T0, 3), ("b", 2, None, "reset", None, T0, 4),
        ("b", 3, 503, None, None, T0, 5), ("c", 1, 404, None, "x", T0, 6),
    ]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(folder)
    store = CrawlStore(spark, str(tmp_path / "store"))
    run(routing.attempts_stream(source(spark, folder, schema), store), tmp_path / "cp")
    assert {r["url"] for r in store.dead_letters.read().collect()} == {"b", "c"}
    assert [r["title"] for r in store.items.current().collect()] == ["Item 1"]
