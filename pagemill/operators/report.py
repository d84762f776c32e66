"""Run results in numbers: counters, gauges, events, dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUCCESS = ("ok", "updated")
# The counters that exist, and the identity of every metric.
COUNTERS = ("pages_processed", "failed_fetch")
METRICS = {
    "pages_processed": ("pagemill_pages_processed_total", "counter", "Pages turned into items"),
    "failed_fetch": ("pagemill_failed_fetch_total", "counter", "Fetches that gave no page"),
    "dead_letter_depth": ("pagemill_dead_letter_depth", "gauge", "Tasks in the dead-letter table"),
    "db_items": ("pagemill_db_items", "gauge", "Items in the table"),
}
TASK = "pagemill.scrape"
DEAD_LETTER_ROW = "task string, task_id string, args array<string>, error string"


def is_success(status: Column | str = "status") -> Column:
    status = F.col(status) if isinstance(status, str) else status
    return F.coalesce(status.isin(*SUCCESS), F.lit(False))


def status_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count("*").alias("n"))


def counter_increments(results: DataFrame) -> DataFrame:
    """(name, amount) of one run, to be appended to the counter log."""
    totals = results.agg(
        F.count_if(is_success()).alias("pages_processed"),
        F.count_if(F.col("status") == "fetch_failed").alias("failed_fetch"),
    )
    pairs = [F.struct(F.lit(name).alias("name"), F.col(name).alias("amount")) for name in COUNTERS]
    return totals.select(F.inline(F.array(*pairs)))


def counters(log: DataFrame) -> DataFrame:
    """(name, value) per known counter over the whole log; unknown names are ignored."""
    known = log.filter(F.col("name").isin(*COUNTERS))
    totals = known.agg(
        *[
            F.coalesce(F.sum(F.when(F.col("name") == name, F.col("amount"))), F.lit(0)).alias(name)
            for name in COUNTERS
        ]
    )
    pairs = [F.struct(F.lit(name).alias("name"), F.col(name).alias("value")) for name in COUNTERS]
    return totals.select(F.inline(F.array(*pairs)))


def dead_letter_depth(dead_letters: DataFrame) -> DataFrame:
    return dead_letters.agg(F.count("*").alias("value"))


def metrics_snapshot(log: DataFrame, dead_letters: DataFrame, items: DataFrame) -> DataFrame:
    """(name, type, help, value) of the two counters and the two gauges."""
    depth = dead_letter_depth(dead_letters).select(F.lit("dead_letter_depth").alias("name"), "value")
    stored = items.agg(F.count("*").alias("value")).select(F.lit("db_items").alias("name"), "value")
    values = counters(log).unionByName(depth).unionByName(stored)
    return values.select(
        _metric(0).alias("name"), _metric(1).alias("type"), _metric(2).alias("help"), "value"
    )


def metrics_text(snapshot: DataFrame) -> DataFrame:
    """(line_no, line) in exposition format, three lines per metric in the order of METRICS."""
    order = F.lit(0)
    for at, (name, _, _) in enumerate(METRICS.values()):
        order = F.when(F.col("name") == name, F.lit(at)).otherwise(order)
    lines = F.array(
        F.concat(F.lit("# HELP "), "name", F.lit(" "), "help"),
        F.concat(F.lit("# TYPE "), "name", F.lit(" "), "type"),
        F.concat(F.col("name"), F.lit(" "), F.col("value").cast("string")),
    )
    return snapshot.select(order.alias("at"), F.posexplode(lines).alias("pos", "line")).select(
        (F.col("at") * 3 + F.col("pos") + 1).cast("int").alias("line_no"), "line"
    )


def write_metrics_text(snapshot: DataFrame, path: str) -> None:
    """The exposition as one text file; it has three lines per metric and there are four."""
    lines = metrics_text(snapshot).coalesce(1).sortWithinPartitions("line_no")
    lines.select("line").write.mode("overwrite").text(path)


def completion_event(
    results: DataFrame, pages_scanned: int, dispatched: int, ai_used: bool = False
) -> DataFrame:
    """One JSON row once all URLs of a crawl are through."""
    meta = F.struct(
        F.lit(pages_scanned).alias("pages_scanned"),
        F.lit(dispatched).alias("books_dispatched"),
        F.lit(ai_used).alias("ai_used"),
    )
    totals = results.agg(
        F.count("*").alias("total_processed"), F.count_if(is_success()).alias("successful_inserts")
    )
    event = F.struct(
        F.lit("scraping_completed").alias("event"),
        meta.alias("meta"),
        "total_processed",
        "successful_inserts",
    )
    return totals.select(F.to_json(event).alias("payload"))


def dead_letters(
    failures: DataFrame, task_id: Column | str, error: Column | str, failed_at: Column | str,
    task: str = TASK,
) -> DataFrame:
    """One dead-letter row per failure; `failures` has at least `url`."""
    return failures.select(
        F.lit(task).alias("task"),
        _as_column(task_id).alias("task_id"),
        F.array("url").alias("args"),
        _as_column(error).alias("error"),
        "url",
        _as_column(failed_at).cast("timestamp").alias("failed_at"),
    )


def fetch_error(url: Column | str = "url", ai: Column | None = None) -> Column:
    """The error text of a page that could not be fetched."""
    what = F.lit("Fetch failed: ")
    if ai is not None:
        what = F.when(ai, F.lit("Browser fetch failed: ")).otherwise(what)
    return F.concat(F.lit("FetchError('"), what, _as_column(url), F.lit("')"))


def dead_letter_payload(rows: DataFrame) -> DataFrame:
    payload = F.to_json(F.struct("task", "task_id", "args", "error"))
    return rows.select(payload.alias("payload"), "url", "failed_at")


def read_dead_letters(payloads: DataFrame, limit: int = 100) -> DataFrame:
    """The oldest `limit` entries; of these, the ones that cannot be decoded are left out."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be between 1 and 1000")
    oldest = payloads.orderBy("failed_at", "url", "payload").limit(limit)
    # A record that is no JSON object reads as an empty row, so the kind is checked on its own.
    sound = F.schema_of_variant(F.try_parse_json("payload")).startswith("OBJECT")
    return (
        oldest.filter(sound)
        .withColumn("row", F.from_json("payload", DEAD_LETTER_ROW))
        .select("row.*", "url", "failed_at")
    )


def dead_letter_listing(payloads: DataFrame, limit: int = 100) -> DataFrame:
    """One row: `count`, the entries read, and `items`, the entries, oldest first."""
    rows = read_dead_letters(payloads, limit)
    names = [name for name in rows.columns if name not in ("failed_at", "url")]
    # At most `limit` entries.
    listed = F.sort_array(F.collect_list(F.struct("failed_at", "url", *names)))
    return rows.agg(F.count("*").alias("count"), listed.alias("items"))


def _metric(part: int) -> Column:
    pairs: list[Column] = []
    for name, identity in METRICS.items():
        pairs += [F.lit(name), F.lit(identity[part])]
    return F.element_at(F.create_map(*pairs), F.col("name"))


def _as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value
