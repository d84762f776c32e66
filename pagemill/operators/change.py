"""Change detection: is a page's content different from what was last seen under its key?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.operators.dedup import HOT_ROWS, ttl_first_seen
from pagemill.operators.ordering import SLICE_SECONDS, with_latest_mark, with_previous
from pagemill.session import cut


def content_changed(
    observed: DataFrame, state: DataFrame | None = None, key: str = "url_key",
    sha1: str = "content_sha1", ts: str = "fetched_at", seq: str = "seq",
    slice_seconds: int = SLICE_SECONDS,
) -> DataFrame:
    """Add `changed`: the hash differs from the key's previous one, or there is none.

    `state` (key, sha1, set_at) holds the hash of earlier runs.
    """
    rows = _with_state(observed, state, key, sha1, ts, seq)
    marked = with_previous(rows, key, ts, seq, sha1, "_previous", slice_seconds)
    return (
        marked.filter("not _stored")
        .withColumn("changed", ~F.col(sha1).eqNullSafe(F.col("_previous")))
        .drop("_previous", "_set_at", "_stored")
    )


def content_changed_ttl(
    observed: DataFrame, ttl_sec: float | None, state: DataFrame | None = None,
    key: str = "url_key", sha1: str = "content_sha1", ts: str = "fetched_at", seq: str = "seq",
    slice_seconds: int = SLICE_SECONDS, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """As `content_changed`, with a stored hash that expires `ttl_sec` after it was set.

    Between two changes the hash stays the same, so the stored hash always equals the previous
    one. What is left is a gate with expiring marks inside every run of equal hashes.
    """
    if ttl_sec is None:
        return content_changed(observed, state, key, sha1, ts, seq, slice_seconds)
    rows = _with_state(observed, state, key, sha1, ts, seq)
    # Both steps feed several passes with narrow rows, so each is worked out once.
    marked = cut(
        with_previous(rows, key, ts, seq, sha1, "_previous", slice_seconds).withColumn(
            "_starts", ~F.col(sha1).eqNullSafe(F.col("_previous"))
        )
    )
    runs = with_latest_mark(marked, key, ts, seq, "_starts", "_run", slice_seconds)
    runs = cut(runs.withColumn("_run", F.col("_run.seq")))
    stored = runs.filter("_stored").select(key, "_run", F.col("_set_at").alias(ts))
    runs = runs.filter("not _stored").drop("_set_at", "_stored")
    accepted = ttl_first_seen(
        runs, ttl_sec, keys=(key, "_run"), ts=ts, seq=seq, marked=stored, hot_rows=hot_rows
    ).select(
        F.col(key).alias("_key"), F.col(ts).alias("_ts"), F.col(seq).alias("_seq")
    )
    same = (
        (runs[key] == accepted["_key"])
        & (runs[ts] == accepted["_ts"])
        & (runs[seq] == accepted["_seq"])
    )
    return (
        runs.join(accepted, same, "left")
        .withColumn("changed", F.col("_key").isNotNull())
        .drop("_key", "_ts", "_seq", "_previous", "_starts", "_run")
    )


def content_state(
    changed: DataFrame, state: DataFrame | None = None, key: str = "url_key",
    sha1: str = "content_sha1", ts: str = "fetched_at", seq: str = "seq",
) -> DataFrame:
    """The stored hash per key after a run: the last changed row, else the earlier state."""
    rows = changed.filter("changed").select(
        F.col(key).alias("url_key"),
        F.col(sha1).alias("content_sha1"),
        F.col(ts).cast("timestamp").alias("set_at"),
        F.lit(True).alias("new"),
        F.col(seq).alias("seq"),
    )
    if state is not None:
        earlier = state.select("url_key", "content_sha1", "set_at", F.lit(False).alias("new"))
        rows = rows.unionByName(earlier, allowMissingColumns=True)
    order = F.struct("set_at", "new", "seq")
    return (
        rows.groupBy("url_key")
        .agg(F.max_by(F.struct("content_sha1", "set_at"), order).alias("s"))
        .select("url_key", "s.content_sha1", "s.set_at")
    )


def _with_state(
    observed: DataFrame, state: DataFrame | None, key: str, sha1: str, ts: str, seq: str
) -> DataFrame:
    """The observations and the stored hashes, which come before any observation."""
    kind = observed.schema[ts].dataType
    rows = observed.withColumn("_set_at", F.lit(None).cast(kind)).withColumn("_stored", F.lit(False))
    if state is None:
        return rows
    stored = state.select(
        F.col("url_key").alias(key),
        F.col("content_sha1").alias(sha1),
        F.lit("1900-01-01").cast(kind).alias(ts),
        F.lit(-(1 << 63)).cast("long").alias(seq),
        F.col("set_at").cast(kind).alias("_set_at"),
        F.lit(True).alias("_stored"),
    )
    return rows.unionByName(stored, allowMissingColumns=True)
