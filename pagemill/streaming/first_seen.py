"""Streams of requests and of page contents whose state is a table.

A batch is worked through by the batch operators, so a hot key is spread over tasks as it is
there. `stateful` has the same gates with per-key state in the state store, for small triggers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from pagemill.operators.change import content_changed_ttl, content_state
from pagemill.operators.dedup import first_seen, ttl_first_seen
from pagemill.session import cut, tables_of_run
from pagemill.sources.stores import BatchTable, latest_hashes


def first_seen_stream(
    requests: DataFrame, seen: BatchTable, passed: BatchTable,
    ts: str = "arrived_at", seq: str = "seq", ttl_sec: float | None = None,
) -> DataStreamWriter:
    """Write the rows that pass the gate, batch by batch; the seen table is the state.

    `requests` has url_key, `ts`, `seq`. Marks never expire, or do so after `ttl_sec`. A batch
    reads the marks that earlier batches left on its keys, so a batch that runs again gives the
    same rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        with tables_of_run(batch.sparkSession):
            route(batch, batch_id)

    def route(batch: DataFrame, batch_id: int) -> None:
        batch = cut(batch)
        seen.compact_due(batch_id)
        marks = seen.matching(batch.select("url_key"), before=batch_id)
        if ttl_sec is None:
            rows = first_seen(batch, marks, ts=ts, seq=seq)
        else:
            marks = marks.withColumnRenamed("seen_at", ts)
            rows = ttl_first_seen(batch, ttl_sec, ts=ts, seq=seq, marked=marks)
        passed.write(rows, batch_id)
        new = passed.read_batch(batch_id).select(
            "url_key", F.col(ts).cast("timestamp").alias("seen_at")
        )
        seen.write(new, batch_id)

    return requests.writeStream.foreachBatch(write)


def changed_stream(
    observed: DataFrame, state: BatchTable, flagged: BatchTable,
    ts: str = "fetched_at", seq: str = "seq", ttl_sec: float | None = None,
) -> DataStreamWriter:
    """Write (url_key, content_sha1, ts, seq, changed) batch by batch; `state` holds the hashes."""

    def write(batch: DataFrame, batch_id: int) -> None:
        with tables_of_run(batch.sparkSession):
            route(batch, batch_id)

    def route(batch: DataFrame, batch_id: int) -> None:
        rows = cut(batch.select("url_key", "content_sha1", ts, seq))
        state.compact_due(batch_id)
        stored = latest_hashes(
            state.matching(rows.select("url_key"), before=batch_id, keep_batch=True)
        )
        flagged.write(content_changed_ttl(rows, ttl_sec, stored, ts=ts, seq=seq), batch_id)
        state.write(content_state(flagged.read_batch(batch_id), ts=ts, seq=seq), batch_id)

    return observed.writeStream.foreachBatch(write)
