"""A stream of landed fetches, routed batch by batch into all tables of a crawl store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from pagemill.config import Settings
from pagemill.plans.scrape import run_requests
from pagemill.session import cut, tables_of_run
from pagemill.sources.stores import CrawlStore, ItemStore
from pagemill.streaming.attempts import GAP_SEC, LATE_SEC, crawls_stream


def upsert_stream(records: DataFrame, items: ItemStore) -> DataStreamWriter:
    """Records (url, item fields, fetched_at, seq) into the item table.

    A batch writes one partition by overwrite and reads only the batches before it, so running
    it again changes nothing.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        with tables_of_run(batch.sparkSession):
            items.upsert(batch, batch_id)

    return records.writeStream.foreachBatch(write)


def routed_stream(
    landed: DataFrame, store: CrawlStore, settings: Settings | None = None
) -> DataStreamWriter:
    """Landed rows (url, html, force, use_ai, arrived_at, seq) into items, results, marks,
    hashes, dead letters and counters.

    The batch is written once to the checkpoint folder and every table is derived from that.
    Each row is a request and the page version it sees, so the size of batches does not matter.
    """

    def route(batch: DataFrame, batch_id: int) -> None:
        with tables_of_run(batch.sparkSession):
            rows = cut(batch)
            pages = rows.select("url", "html", F.col("arrived_at").alias("fetched_at"), "seq")
            requests = rows.select("url", "force", "use_ai", "arrived_at", "seq")
            run_requests(store, requests, pages, batch_id, settings)

    return landed.writeStream.foreachBatch(route)


ATTEMPTS = "url string, attempt int, status int, error string, body string, attempted_at timestamp, seq long"


def attempts_stream(
    log: DataFrame, store: CrawlStore, settings: Settings | None = None,
    gap_sec: float = GAP_SEC, late_sec: float = LATE_SEC,
) -> DataStreamWriter:
    """Fetch-log rows, which may come in any batches, into the same tables.

    Each crawl of a URL is one request and the page it got, if any, so a URL that is crawled again
    has another outcome, and a crawl without a page is a dead letter. `log` has the columns of
    ATTEMPTS. A crawl whose attempts stay away is closed by a timer, `gap_sec` after its last one.
    """
    limits = settings or Settings()

    def route(batch: DataFrame, batch_id: int) -> None:
        with tables_of_run(batch.sparkSession):
            # A stream's own session plans without AQE, in full for every number of rows.
            crawls = cut(batch, session=store.spark)
            if crawls.isEmpty():
                # A batch that moved the clock, or whose crawls are all still open.
                store.write_nothing(batch_id, limits.incremental)
                return
            pages = crawls.select("url", "html", F.col("arrived_at").alias("fetched_at"), "seq")
            forms = [F.lit(False).alias("force"), F.lit(False).alias("use_ai")]
            run_requests(store, crawls.select("url", *forms, "arrived_at", "seq"), pages, batch_id, limits)

    return crawls_stream(log, limits.max_retries, gap_sec, late_sec).writeStream.foreachBatch(route)
