"""Gates, change detection, ordering helpers and the Bloom screen against plain Python."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pagemill.operators import bloom, change, dedup, ordering
from pagemill.session import cut

T0 = datetime(2024, 1, 1)


def observations(spark, rows):
    """rows: (key, second, value) in arrival order; seq is the position."""
    data = [(k, T0 + timedelta(seconds=s), v, n) for n, (k, s, v) in enumerate(rows)]
    schema = "url_key string, fetched_at timestamp, content_sha1 string, seq long"
    return spark.createDataFrame(data, schema).repartition(5)


def random_rows(n=600, keys=7, span=3 * 86_400, seed=1):
    rng = random.Random(seed)
    # A third of all rows has one key; times are not in arrival order and repeat.
    pick = lambda: "hot" if rng.random() < 0.34 else f"k{rng.randrange(keys)}"
    return [(pick(), rng.randrange(span // 60) * 60, rng.choice("ab")) for _ in range(n)]


def ordered(rows):
    by_key = {}
    for n, (k, s, v) in enumerate(rows):
        by_key.setdefault(k, []).append((s, n, v))
    return {k: sorted(v) for k, v in by_key.items()}


def ttl_by_hand(rows, ttl):
    taken = set()
    for key, events in ordered(rows).items():
        mark = None
        for s, n, _ in events:
            if mark is None or s > mark + ttl:
                taken.add(n)
                mark = s
    return taken


def changed_by_hand(rows, ttl=None, state=None):
    taken = set()
    for key, events in ordered(rows).items():
        stored = (state or {}).get(key)
        for s, n, v in events:
            expired = stored and ttl is not None and s > stored[1] + ttl
            if stored is None or expired or stored[0] != v:
                taken.add(n)
                stored = (v, s)
    return taken


def seqs(df):
    return {row["seq"] for row in df.collect()}


def test_key_ignores_case_and_any_outer_space(spark):
    urls = ["http://x/A", " HTTP://X/a ", "\thttp://x/a\n", " http://x/a ", "http://x/b"]
    df = dedup.with_key(spark.createDataFrame([(u,) for u in urls], "url string"))
    keys = [row["url_key"] for row in df.collect()]
    assert len(set(keys[:4])) == 1 and keys[4] != keys[0]


def test_mark_first_flags_one_row_per_key(spark):
    rows = random_rows()
    df = dedup.mark_first(observations(spark, rows), ts="fetched_at")
    assert df.count() == len(rows)
    assert seqs(df.filter("is_first")) == {events[0][1] for events in ordered(rows).values()}


def test_first_seen_leaves_out_seen_keys(spark):
    rows = random_rows()
    seen = spark.createDataFrame([("hot", T0), ("k1", T0)], "url_key string, seen_at timestamp")
    passed = dedup.first_seen(observations(spark, rows), seen, ts="fetched_at")
    expected = {e[0][1] for k, e in ordered(rows).items() if k not in ("hot", "k1")}
    assert seqs(passed) == expected
    marks = passed.select("url_key", F.col("fetched_at").alias("seen_at"))
    after = dedup.mark_seen(seen, marks)
    assert after.count() == len(ordered(rows))
    assert dedup.unseen(passed, after).count() == 0


@pytest.mark.parametrize("hot_rows", [10, 1_000])
@pytest.mark.parametrize("ttl", [0, 3_600, 86_400])
def test_ttl_gate_matches_a_fold(spark, ttl, hot_rows):
    rows = random_rows()
    ttl_rows = dedup.ttl_first_seen(
        observations(spark, rows), ttl, ts="fetched_at", hot_rows=hot_rows
    )
    assert seqs(ttl_rows) == ttl_by_hand(rows, ttl)


def test_ttl_edges(spark):
    rows = [("k", 0, "a"), ("k", 100, "a"), ("k", 101, "a"), ("k", 101, "a")]
    df = observations(spark, rows)
    assert seqs(dedup.ttl_first_seen(df, 100, ts="fetched_at")) == {0, 2}
    assert seqs(dedup.ttl_first_seen(df, None, ts="fetched_at")) == {0}
    marked = spark.createDataFrame(
        [("k", T0 - timedelta(seconds=50))], "url_key string, fetched_at timestamp"
    )
    assert seqs(dedup.ttl_first_seen(df, 100, ts="fetched_at", marked=marked)) == {1}
    later = spark.createDataFrame(
        [("k", T0 + timedelta(seconds=50))], "url_key string, fetched_at timestamp"
    )
    # Rows older than the mark, and those it still covers, are seen.
    assert seqs(dedup.ttl_first_seen(df, 100, ts="fetched_at", marked=later)) == set()
    assert seqs(dedup.ttl_first_seen(df, 50, ts="fetched_at", marked=later)) == {2}
    assert seqs(dedup.ttl_first_seen(df, None, ts="fetched_at", marked=later)) == set()


def test_one_moment_of_one_key_is_cut_into_slices(spark):
    rows = [("k", T0, n, f"h{n // 7 % 3}", n % 50 == 3) for n in range(2_000)]
    rows += [("k", T0 + timedelta(hours=2), 5_000, "h1", False), ("j", T0, 1, "h0", True)]
    df = spark.createDataFrame(rows, "url_key string, at timestamp, seq long, sha string, marked boolean").repartition(5)
    df = cut(df)
    sliced = ordering._sliced(df, "url_key", "at", "seq", 3_600, 100)
    sizes = sliced.groupBy("url_key", *ordering._SLICE).count()
    assert sizes.agg(F.max("count")).first()[0] <= 100 and sizes.count() >= 22
    got = {r.seq: r.previous for r in ordering.with_previous(df.filter("url_key = 'k'"), "url_key", "at", "seq", "sha", slice_rows=100).collect()}
    ordered = sorted(r[2:4] for r in rows if r[0] == "k")
    assert got == {n: (ordered[i - 1][1] if i else None) for i, (n, _) in enumerate(ordered)}
    marks = ordering.with_latest_mark(df, "url_key", "at", "seq", "marked", slice_rows=100)
    for r in marks.collect():
        want = max((n for k, _, n, _, m in rows if m and k == r.url_key and n <= r.seq), default=None)
        assert (r.mark.seq if r.mark else None) == want
    # Without a slice that holds too many, no row is numbered.
    assert ordering._sliced(df, "url_key", "at", "seq", 3_600, 5_000).select("_piece").distinct().count() == 1


@pytest.mark.parametrize("slice_seconds", [300, 86_400 * 30])
def test_changed_matches_a_fold(spark, slice_seconds):
    rows = random_rows()
    df = observations(spark, rows)
    got = change.content_changed(df, slice_seconds=slice_seconds)
    assert got.count() == len(rows)
    assert seqs(got.filter("changed")) == changed_by_hand(rows)


@pytest.mark.parametrize("hot_rows", [5, 1_000])
def test_changed_with_ttl_and_state_matches_a_fold(spark, hot_rows):
    rows = random_rows(n=300)
    state = {"hot": ("a", -100), "k0": ("b", -90_000), "other": ("a", -5)}
    stored = spark.createDataFrame(
        [(k, v, T0 + timedelta(seconds=s)) for k, (v, s) in state.items()],
        "url_key string, content_sha1 string, set_at timestamp",
    )
    df = observations(spark, rows)
    for ttl in (7_200, None):
        got = change.content_changed_ttl(
            df, ttl, stored, slice_seconds=1_800, hot_rows=hot_rows
        ).cache()
        assert got.count() == len(rows)
        assert seqs(got.filter("changed")) == changed_by_hand(rows, ttl, state)
        after = {
            r["url_key"]: (r["content_sha1"], (r["set_at"] - T0).total_seconds())
            for r in change.content_state(got, stored).collect()
        }
        expected = dict(state)
        taken = changed_by_hand(rows, ttl, state)
        for key, events in ordered(rows).items():
            hits = [(v, s) for s, n, v in events if n in taken]
            expected[key] = hits[-1] if hits else state[key]
        assert after == expected


def test_number_rows_per_group_and_overall(spark):
    rng = random.Random(3)
    orders = rng.sample(range(5_000), 400)
    data = [(o, rng.choice(["a", "b", ""])) for o in orders]
    df = spark.createDataFrame(data, "o long, g string").repartition(4)
    got = {
        (r["o"], r["g"]): r["ordinal"]
        for r in ordering.number_rows(df, "o", ("g",), slice_rows=100).collect()
    }
    for group in ("a", "b", ""):
        members = sorted(o for o, g in data if g == group)
        assert [got[(o, group)] for o in members] == list(range(1, len(members) + 1))
    overall = ordering.number_rows(df, "o", slice_rows=64).orderBy("o").collect()
    assert [r["ordinal"] for r in overall] == list(range(1, 401))


def test_bloom_screen(spark):
    shape = bloom.Shape(capacity=20_000, error_rate=0.001)
    keys = spark.range(40_000).select(F.sha1(F.col("id").cast("string")).alias("url_key"), "id")
    low, high = keys.filter("id < 10000"), keys.filter("id >= 10000 and id < 20000")
    sketch = bloom.merge_sketches(
        bloom.build_sketch(low, shape), bloom.build_sketch(high, shape)
    )
    got = bloom.might_be_seen(keys, sketch, shape).join(keys, "url_key")
    inside = got.filter("id < 20000").agg(F.count_if(F.col("might_be_seen"))).first()[0]
    outside = got.filter("id >= 20000").agg(F.count_if(F.col("might_be_seen"))).first()[0]
    assert inside == 20_000
    assert outside < 40
