"""Duplicate gates: first occurrence per key, the seen table, and a time-to-live variant."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from pagemill.functions.urls import url_key
from pagemill.operators.ordering import SLICE_SECONDS, first_rows
from pagemill.session import cut, look_up

HOT_ROWS = 1_000_000


def with_key(df: DataFrame, url: str = "url", out: str = "url_key") -> DataFrame:
    return df.withColumn(out, url_key(url))


def mark_first(
    df: DataFrame, key: str = "url_key", ts: str = "arrived_at", seq: str = "seq",
    out: str = "is_first",
) -> DataFrame:
    """Flag the first row per key in (`ts`, `seq`) order.

    The first rows come from a partial aggregate. They are joined back on the whole
    (key, ts, seq) triple, which is unique, so the rows of a hot key spread over all tasks.
    """
    firsts = first_rows(df, key, ts, seq).select(
        F.col(key).alias("_key"), F.col(ts).alias("_ts"), F.col(seq).alias("_seq")
    )
    same = (
        (df[key] == firsts["_key"])
        & df[ts].eqNullSafe(firsts["_ts"])
        & (df[seq] == firsts["_seq"])
    )
    return (
        df.join(firsts, same, "left")
        .withColumn(out, F.col("_key").isNotNull())
        .drop("_key", "_ts", "_seq")
    )


def first_seen(
    df: DataFrame, seen: DataFrame | None = None, key: str = "url_key",
    ts: str = "arrived_at", seq: str = "seq",
) -> DataFrame:
    """(key, ts, seq) of the rows that pass the gate: first of their key, key not seen before."""
    firsts = first_rows(df, key, ts, seq)
    return firsts if seen is None else unseen(firsts, seen, key)


def unseen(df: DataFrame, seen: DataFrame, key: str = "url_key") -> DataFrame:
    """Rows whose key is not in the seen table."""
    return df.join(seen.select(key), key, "left_anti")


def mark_seen(seen: DataFrame, marks: DataFrame) -> DataFrame:
    """The seen table after adding `marks`; a key keeps its first time."""
    both = seen.select("url_key", "seen_at").unionByName(marks.select("url_key", "seen_at"))
    return both.groupBy("url_key").agg(F.min("seen_at").alias("seen_at"))


def ttl_first_seen(
    df: DataFrame, ttl_sec: float | None, keys: tuple[str, ...] = ("url_key",),
    ts: str = "arrived_at", seq: str = "seq", marked: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """(keys, ts, seq) of the rows accepted by a gate whose marks expire `ttl_sec` later.

    Per key: the first row is accepted and marks the key; a later row is accepted once the mark
    has expired (strictly later than mark + ttl), and marks it anew. `marked` (keys, ts) holds
    marks from earlier runs; a row older than its key's mark counts as seen.

    This is a fold in time order. Keys with up to `hot_rows` rows are folded over sorted
    partitions, in constant memory. The rows of keys above it stay spread over all tasks: each
    row gets the row that would be accepted next, and the chain from a key's first row is found
    by doubling, in log2(accepted rows per key) rounds.
    """
    rows = df.select(
        *keys, F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(seq).alias("seq")
    )
    if marked is not None:
        rows = _past_marks(rows, marked, keys, ts, ttl_sec)
    ts_type = df.schema[ts].dataType.simpleString()
    if ttl_sec is None:
        firsts = rows.groupBy(*keys).agg(F.min(F.struct("at", "seq")).alias("first"))
        accepted = firsts.select(*keys, "first.at", "first.seq")
    else:
        accepted = _fold(rows, keys, int(ttl_sec * 1_000_000), hot_rows)
    return accepted.select(
        *keys,
        F.timestamp_micros("at").cast(ts_type).alias(ts),
        F.col("seq").alias(seq),
    )


def _past_marks(
    rows: DataFrame, marked: DataFrame, keys: tuple[str, ...], ts: str, ttl_sec: float | None
) -> DataFrame:
    """The rows that the marks of earlier runs leave open, one row per key on the marks' side."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    marks = marked.groupBy(*keys).agg(F.max(at).alias("_mark"))
    if ttl_sec is None:
        return rows.join(cut(marks), list(keys), "left_anti")
    expired = F.col("at") > F.col("_mark") + F.lit(int(ttl_sec * 1_000_000))
    joined = look_up(rows, marks, list(keys))
    return joined.filter(F.col("_mark").isNull() | expired).drop("_mark")


def _fold(rows: DataFrame, keys: tuple[str, ...], ttl: int, hot_rows: int) -> DataFrame:
    """Keys whose rows lie within one `ttl` accept their first row, which an aggregate finds.

    Only the rows of the others are shuffled and folded. The lists of keys are written, so the
    planner broadcasts them only while they are small.
    """
    names = list(keys)
    spans = cut(
        rows.groupBy(*names).agg(
            F.count("*").alias("n"),
            F.min(F.struct("at", "seq")).alias("first"),
            F.max("at").alias("last"),
        )
    )
    is_short = F.col("last") <= F.col("first.at") + F.lit(ttl)
    accepted = spans.filter(is_short).select(*names, "first.at", "first.seq")
    long = spans.filter(~is_short)
    cold = rows.join(long.filter(F.col("n") <= hot_rows).select(*names), names, "left_semi")
    accepted = accepted.unionByName(_fold_sorted(cold, keys, ttl))
    hot = long.filter(F.col("n") > hot_rows).select(*names)
    if hot.isEmpty():
        return accepted
    return accepted.unionByName(_follow(rows.join(hot, names, "left_semi"), keys, ttl))


def _follow(rows: DataFrame, keys: tuple[str, ...], ttl: int) -> DataFrame:
    """The accepted rows of hot keys; joins run on (keys, time), which is unique."""
    names = list(keys)
    # Of several rows at one time only the first can be accepted.
    moments = cut(rows.groupBy(*names, "at").agg(F.min("seq").alias("seq")))
    jump = cut(_next_accepted(moments.select(*names, "at"), names, ttl))
    reached = cut(moments.groupBy(*names).agg(F.min("at").alias("at")))
    while True:
        # `jump` leaps over as many accepted rows as `reached` holds per key.
        further = jump.join(reached, [*names, "at"], "left_semi").select(
            *names, F.col("next").alias("at")
        )
        counted = Observation()
        more = cut(further.observe(counted, F.count("*").alias("n")))
        if counted.get["n"] == 0:
            return moments.join(reached, [*names, "at"], "left_semi")
        reached = cut(reached.unionByName(more))
        longer = jump.withColumnRenamed("at", "from").withColumnRenamed("next", "at")
        jump = cut(longer.join(jump, [*names, "at"]).select(*names, F.col("from").alias("at"), "next"))


def _next_accepted(moments: DataFrame, names: list[str], ttl: int) -> DataFrame:
    """(keys, at, next): the first moment of the key later than `at` + ttl, where there is one.

    Every moment asks at `at` + ttl. Questions and answers are put in one order and cut into time
    slices; within a slice a window finds the next moment, a carry per slice supplies the rest.
    """
    answer = moments.select(*names, "at", F.lit(None).cast("long").alias("asked_by"))
    question = moments.select(
        *names, (F.col("at") + F.lit(ttl)).alias("at"), F.col("at").alias("asked_by")
    )
    both = answer.unionByName(question).withColumn(
        "slice", F.floor(F.col("at") / F.lit(SLICE_SECONDS * 1_000_000))
    )
    moment = F.when(F.col("asked_by").isNull(), F.col("at"))
    later = (
        Window.partitionBy(*names, "slice")
        .orderBy(F.desc("at"), F.desc_nulls_last("asked_by"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    carry = (
        Window.partitionBy(*names)
        .orderBy(F.desc("slice"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    beyond = (
        both.groupBy(*names, "slice")
        .agg(F.min(moment).alias("_first"))
        .select(*names, "slice", F.min("_first").over(carry).alias("_beyond"))
    )
    return (
        both.withColumn("_near", F.min(moment).over(later))
        .filter(F.col("asked_by").isNotNull())
        .join(beyond, [*names, "slice"])
        .select(*names, F.col("asked_by").alias("at"), F.coalesce("_near", "_beyond").alias("next"))
        .filter(F.col("next").isNotNull())
    )


def _fold_sorted(rows: DataFrame, keys: tuple[str, ...], ttl: int) -> DataFrame:
    names = [*keys, "at", "seq"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried_key, limit = None, 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            at = batch.column(len(keys)).to_numpy(zero_copy_only=False)
            starts = _run_starts([batch.column(i) for i in range(len(keys))])
            ends = [*starts[1:], batch.num_rows]
            taken: list[int] = []
            for start, end in zip(starts, ends):
                key = tuple(batch.column(i)[start].as_py() for i in range(len(keys)))
                position = start
                if key == carried_key:
                    position = start + int(np.searchsorted(at[start:end], limit, "right"))
                while position < end:
                    taken.append(position)
                    limit = int(at[position]) + ttl
                    position += int(np.searchsorted(at[position:end], limit, "right"))
                carried_key = key
            yield batch.take(pa.array(taken, pa.int64()))

    placed = rows.repartition(*keys).sortWithinPartitions(*names)
    return placed.select(*names).mapInArrow(run, placed.select(*names).schema)


def _run_starts(columns: list[pa.Array]) -> list[int]:
    """Positions where a key differs from the row before."""
    size = len(columns[0])
    changed = np.zeros(size, dtype=bool)
    changed[0] = True
    for column in columns:
        codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy()
        changed[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(changed).tolist()
