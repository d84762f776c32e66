"""One run: requests and fetched pages in, one outcome row per request out.

The HTML is not shuffled, and only what the run needs of it is read. Requests choose their page
version by URL and time alone. The bodies of these versions are read for their hash, the gates run
on narrow rows (keys, times, flags, hashes), and only pages that a request behind the gates asks
for are parsed, in a second read of just their rows (`sources.places`).
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.config import Settings
from pagemill.functions.urls import content_sha1
from pagemill.operators import report
from pagemill.operators.assisted import extract_from_replies
from pagemill.operators.change import content_changed_ttl, content_state
from pagemill.operators.dedup import ttl_first_seen, with_key
from pagemill.operators.extract import extract_records
from pagemill.operators.ordering import number_rows, with_latest_mark
from pagemill.operators.politeness import delays_from_text, politeness_plan, with_delay
from pagemill.operators.robots import robots_allowed
from pagemill.schemas import ITEM_FIELDS, item_defect
from pagemill.session import cut, look_up, side_by_side
from pagemill.sources.places import PLACE, read_at, with_places
from pagemill.sources.tables import has_body

ORDER = ("arrived_at", "seq")
VERSION = ("fetched_at", "version_seq")


@dataclass(frozen=True)
class Run:
    """The outcome rows of a run and the tables they stand for."""

    outcome: DataFrame
    settings: Settings

    def results(self) -> DataFrame:
        done = report.is_success()
        return self.outcome.filter(~F.col("status").isin("fetch_failed", "store_failed")).select(
            "url",
            "status",
            F.when(done, F.col("title")).alias("title"),
            F.when(done, F.col("price")).alias("price"),
        )

    def items(self) -> DataFrame:
        """Records for the item table: url, fields, fetched_at, seq."""
        return self.outcome.filter(report.is_success()).select(
            "url", *ITEM_FIELDS, F.col("arrived_at").alias("fetched_at"), "seq"
        )

    def marks(self) -> DataFrame:
        """Keys to add to the seen table."""
        parse_failed = (F.col("status") == "parse_failed") & ~F.col("force")
        other = F.col("status") == "skipped_unchanged" if self.settings.incremental else parse_failed
        marked = self.outcome.filter(report.is_success() | other)
        return marked.groupBy("url_key").agg(F.min("arrived_at").alias("seen_at"))

    def content_state(self) -> DataFrame:
        """Hashes set by this run; empty unless the run was incremental."""
        changed = self.outcome.filter(~F.col("force") & F.col("changed"))
        return content_state(changed, ts="arrived_at")

    def dead_letters(self, run_id: str) -> DataFrame:
        """One entry per URL whose fetch failed and per row the item table refused."""
        failed = self.outcome.filter(F.col("status").isin("fetch_failed", "store_failed"))
        per_url = failed.groupBy("url", "error").agg(
            F.min(F.struct(*ORDER)).alias("first"),
        )
        return report.dead_letters(
            per_url,
            F.concat(F.lit(run_id + ":"), F.col("first.seq").cast("string")),
            "error",
            F.col("first.arrived_at"),
        )

    def fetch_plan(self) -> DataFrame:
        """(url, arrived_at, seq, ordinal, host, delay_sec, start_after_sec) of each fetch.

        Requests that the seen gate holds back are not fetched. The others of a host start one after
        another, as far apart as `domain_delays` and `request_delay_sec` ask for.
        """
        sent = self.outcome.filter(F.col("status") != "skipped_duplicate").select("url", *ORDER)
        numbered = number_rows(sent, ORDER, out="ordinal")
        delays = delays_from_text(sent.sparkSession, self.settings.domain_delays)
        return politeness_plan(with_delay(numbered, delays, self.settings.request_delay_sec))

    def counter_increments(self) -> DataFrame:
        """A failing URL counts once per run however many requests name it."""
        failed = self.outcome.filter(F.col("status") == "fetch_failed")
        once = failed.groupBy("url").agg(F.first("status").alias("status")).select("status")
        done = self.outcome.filter(report.is_success()).select("status")
        return report.counter_increments(once.unionByName(done))


def scrape(
    requests: DataFrame,
    pages: DataFrame,
    settings: Settings | None = None,
    seen: DataFrame | None = None,
    stored_hashes: DataFrame | None = None,
    robots: DataFrame | None = None,
    replies: DataFrame | None = None,
) -> Run:
    """Run requests (url, force, use_ai, arrived_at, seq) over pages (url, html).

    Pages may have `fetched_at` and `seq`, and then be several versions of a URL: a request sees
    the first version fetched at or after its own (arrived_at, seq), or else the last one before.
    Without them a URL has one page; of several rows the one of least hash is it. A URL without a
    page, with an empty one, or denied by `robots` (`default_rules`), has failed to fetch. A failed
    fetch leaves no mark, so a later request for the same key is tried anew. Marks expire after
    `dedup_ttl_sec`, in the run and in `seen` (url_key, seen_at).
    """
    settings = settings or Settings()
    asked = _asked(requests, settings, robots)
    version = VERSION if "fetched_at" in pages.columns else ()
    pages = with_places(pages.withColumnRenamed("seq", "version_seq") if version else pages)
    on = ["url", *version]
    if version:
        asked, wanted = _with_version(asked, pages)
    else:
        wanted = _at_urls(pages, asked, on)
    done = cut(_with_heads(asked, _heads(pages, wanted, on), on, replies is not None))

    def read(rows: DataFrame) -> DataFrame:
        return _fields(pages, rows, on, replies)

    if settings.incremental:
        done = cut(_with_changed(done, settings, stored_hashes).withColumn("late", F.lit(False)))
        skips = F.col("fetched") & ~F.col("force") & ~F.col("changed")
        skipped = F.when(skips, F.lit("skipped_unchanged"))
        fields = read(done.filter("fetched and (force or changed)"))
    else:
        # Whether a forced request marks its key depends on its page being parsed; no other does.
        forced = done.filter("fetched and force")
        fields = None if forced.isEmpty() else cut(read(forced))
        done = _with_parsed(done, fields, on).withColumns(
            {"content_sha1": F.lit(None).cast("string"), "changed": F.lit(None).cast("boolean")}
        )
        if settings.dedup_ttl_sec is None:
            done = look_up(done, _key_marks(done, seen), "url_key")
            passed = F.struct(*ORDER) > F.col("first_mark")
            late = F.col("was_seen") | F.coalesce(passed, F.lit(False))
            done = cut(done.withColumn("late", late).drop("was_seen", "first_mark"))
        else:
            done = cut(_with_expiring_marks(cut(done), seen, settings.dedup_ttl_sec))
        skipped = F.when(~F.col("force") & F.col("late"), F.lit("skipped_duplicate"))
        rest = done.filter("fetched and not force and not late")
        if fields is None:
            fields = read(rest)
        else:
            page = [*on, "use_ai"]
            fields = fields.unionByName(read(rest.join(fields.select(*page), page, "left_anti")))
        done = done.drop("parsed")
    done = done.join(cut(fields), [*on, "use_ai"], "left").drop(*version, PLACE)
    done = done.withColumn("parsed", F.col("title").isNotNull())
    success = "updated" if settings.incremental else "ok"
    status = F.coalesce(
        skipped,
        F.when(~F.col("fetched"), F.lit("fetch_failed")),
        F.when(~F.col("parsed"), F.lit("parse_failed")),
        F.when(item_defect().isNotNull(), F.lit("store_failed")),
        F.lit(success),
    )
    with_status = done.withColumn("status", status)
    error = F.when(
        F.col("status") == "fetch_failed", report.fetch_error("url", F.col("use_ai"))
    ).when(F.col("status") == "store_failed", item_defect())
    keep_fields = F.col("status").isin(success, "store_failed")
    outcome = with_status.select(
        "url",
        "url_key",
        "force",
        "use_ai",
        *ORDER,
        "status",
        *[F.when(keep_fields, F.col(name)).alias(name) for name in ITEM_FIELDS],
        error.alias("error"),
        "content_sha1",
        "changed",
    )
    return Run(cut(outcome), settings)


def _asked(requests: DataFrame, settings: Settings, robots: DataFrame | None) -> DataFrame:
    """The requests with their key and whether robots allow them; narrow rows."""
    asked = with_key(requests).select(
        "url",
        "url_key",
        F.coalesce("force", F.lit(False)).alias("force"),
        F.coalesce("use_ai", F.lit(False)).alias("use_ai"),
        *ORDER,
    )
    if robots is None or not settings.respect_robots:
        return asked.withColumn("allowed", F.lit(True))
    return cut(robots_allowed(asked, robots))


def _at_urls(pages: DataFrame, asked: DataFrame, on: list[str]) -> DataFrame:
    """(url, version, place) of the pages whose URL is asked for."""
    return cut(pages.select(*on, PLACE).join(cut(asked.select("url").distinct()), "url", "left_semi"))


def _with_version(asked: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The requests with the (fetched_at, seq) of the page version each sees, null if there is none,
    and (url, version, place) of the versions seen; both are written.

    A version of a request's own (arrived_at, seq) is the first one at or after it, and is found by
    its key. For the other requests, see `_near_version`.
    """
    on = ["url", *VERSION]
    moment = ["url", "_at", "_n"]
    kinds = {name: pages.schema[name].dataType for name in VERSION}
    asked_at = asked.withColumns({"_at": _micros("arrived_at"), "_n": F.col("seq").cast("long")})
    placed = pages.select(*on, PLACE).withColumns({"_at": _micros("fetched_at"), "_n": F.col("version_seq").cast("long")})
    own = cut(placed.join(cut(asked_at.select(*moment).distinct()), moment, "left_semi"))
    found = asked_at.join(own.select(*moment).distinct().withColumn("_own", F.lit(True)), moment, "left")
    values = {"fetched_at": F.timestamp_micros("_at"), "version_seq": F.col("_n")}
    found = found.withColumns({name: F.when(F.col("_own"), values[name].cast(kinds[name])) for name in VERSION})
    found, own = cut(found.select(*asked.columns, *VERSION, "_own")), own.select(*on, PLACE)
    rest = found.filter(F.col("_own").isNull()).select(*asked.columns)
    found = found.filter("_own").drop("_own")
    if rest.isEmpty():
        return found, own
    versions = _at_urls(pages, rest, on)
    near = cut(_near_version(rest, versions))
    seen = versions.join(cut(near.select(*on).distinct()), on, "left_semi")
    return cut(found.unionByName(near)), cut(own.unionByName(seen).distinct())


def _micros(name: str) -> Column:
    return F.unix_micros(F.col(name).cast("timestamp"))


def _near_version(asked: DataFrame, records: DataFrame) -> DataFrame:
    """Add the first version at or after each request, or else the last one before.

    Versions and requests are put in one order, once from the end and once from the start, so that
    each request finds the version next to it. Even numbers are requests, odd ones versions.
    """
    have = records.select("url", *VERSION).distinct()

    def nearest(sign: int, out: str) -> DataFrame:
        at = lambda name: F.timestamp_micros(sign * _micros(name)).alias("at")
        points = have.select(
            "url", at("fetched_at"), (2 * sign * F.col("version_seq") - 1).alias("n"),
            F.lit(True).alias("is_version"),
        ).unionByName(
            asked.select("url", at("arrived_at"), (2 * sign * F.col("seq")).alias("n")).distinct()
            .withColumn("is_version", F.lit(False))
        )
        found = with_latest_mark(cut(points), "url", "at", "n", "is_version", "mark")
        return found.filter("not is_version and mark is not null").select(
            "url",
            F.timestamp_micros(sign * F.unix_micros("at")).alias("arrived_at"),
            F.expr(f"{sign} * (n div 2)").alias("seq"),
            F.struct(
                F.timestamp_micros(sign * F.unix_micros("mark.ts")).alias("fetched_at"),
                F.expr(f"{sign} * ((mark.seq + 1) div 2)").alias("version_seq"),
            ).alias(out),
        )

    on = ["url", *ORDER]
    kind = asked.schema["arrived_at"].dataType
    after, before = (
        nearest(sign, out).withColumn("arrived_at", F.col("arrived_at").cast(kind))
        for sign, out in ((-1, "after"), (1, "before"))
    )
    near = asked.join(after, on, "left").join(before, on, "left")
    chosen = F.coalesce("after", "before")
    kinds = {name: records.schema[name].dataType for name in VERSION}
    return near.withColumns({name: chosen[name].cast(kinds[name]) for name in VERSION}).drop("after", "before")


def _with_changed(
    done: DataFrame, settings: Settings, stored_hashes: DataFrame | None
) -> DataFrame:
    """Add `changed` to the fetched requests that are not forced; the test sees narrow rows."""
    checked = done.filter("fetched and not force").select("url_key", "content_sha1", *ORDER)
    flagged = content_changed_ttl(
        checked, settings.content_hash_ttl_sec, stored_hashes, ts="arrived_at"
    )
    on = ["url_key", *ORDER]
    return done.join(flagged.select(*on, "changed"), on, "left")


def _heads(pages: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """(url, version, has_body, content_sha1, place) of each page version at the places `wanted`.

    Of several rows of a version it is the one of least hash.
    """

    def work(rows: DataFrame) -> DataFrame:
        return rows.select(*on, PLACE, has_body().alias("has_body"), content_sha1("html").alias("content_sha1"))

    rows = read_at(pages, wanted.select(PLACE), work)
    order = F.struct(F.col("content_sha1").isNull(), "content_sha1")
    head = F.min_by(F.struct("has_body", "content_sha1", PLACE), order).alias("head")
    return rows.groupBy(*on).agg(head).select(*on, "head.*")


def _with_heads(asked: DataFrame, heads: DataFrame, on: list[str], by_model: bool) -> DataFrame:
    """The requests with the head of their page, and whether it counts as fetched.

    Without replies, a request that is to be read by the model has no page.
    """
    readable = ~F.col("use_ai") | F.lit(by_model)
    has_one = F.col("allowed") & readable & F.coalesce("has_body", F.lit(False))
    done = asked.join(cut(heads), on, "left")
    return done.withColumns(
        {"fetched": has_one, "content_sha1": F.when(readable, F.col("content_sha1"))}
    ).drop("has_body", "allowed")


def _fields(pages: DataFrame, rows: DataFrame, on: list[str], replies: DataFrame | None) -> DataFrame:
    """(url, version, use_ai, item fields) for the pages of these requests, one row per page.

    Only their rows of `pages` are parsed; a request for the model takes the reply instead.
    """
    chosen = cut(rows.select(*on, "use_ai", PLACE).distinct())

    def parse(bodies: DataFrame) -> DataFrame:
        return extract_records(bodies.select(*on, "html")).select(*on, F.lit(False).alias("use_ai"), *ITEM_FIELDS)

    records = read_at(pages, chosen.filter("not use_ai").select(PLACE), parse)
    if replies is not None:
        by_model = extract_from_replies(chosen.filter("use_ai").select(*on), replies)
        records = records.unionByName(by_model.select(*on, F.lit(True).alias("use_ai"), *ITEM_FIELDS))
    one = F.min(F.struct(F.col("title").isNull(), *ITEM_FIELDS)).alias("row")
    return records.groupBy(*on, "use_ai").agg(one).select(*on, "use_ai", *[F.col(f"row.{x}").alias(x) for x in ITEM_FIELDS])


def _with_parsed(done: DataFrame, fields: DataFrame | None, on: list[str]) -> DataFrame:
    """Add `parsed`: the page has been read, and has a title."""
    if fields is None:
        return done.withColumn("parsed", F.lit(False))
    titled = fields.filter("title is not null").select(*on, "use_ai", F.lit(True).alias("parsed"))
    return done.join(titled, [*on, "use_ai"], "left").withColumn("parsed", F.coalesce("parsed", F.lit(False)))


def _with_expiring_marks(done: DataFrame, seen: DataFrame | None, ttl: int) -> DataFrame:
    """Add `late`: at this request its key had a mark that had not expired.

    A request that passes and is fetched marks its key; a forced one that parses always does, so
    each of these starts a run of its own, inside which the gate with expiring marks decides.
    """
    marking = F.col("fetched") & (~F.col("force") | F.col("parsed"))
    rows = done.select(
        "url_key", *ORDER, "force", marking.alias("marking"), (marking & F.col("force")).alias("forced")
    )
    runs = with_latest_mark(cut(rows), "url_key", *ORDER, "forced", "_force")
    runs = cut(runs.withColumn("run", F.coalesce(F.col("_force.seq").cast("string"), F.lit(""))).drop("_force"))
    forced = runs.filter("forced").select("url_key", "run", *ORDER)
    held = forced.select("url_key", "run", "arrived_at")
    kind = done.schema["arrived_at"].dataType
    if seen is not None:
        earlier = seen.select("url_key", F.lit("").alias("run"), F.col("seen_at").cast(kind).alias("arrived_at"))
        held = held.unionByName(earlier)
    accepted = ttl_first_seen(
        runs.filter("marking and not force"), ttl, keys=("url_key", "run"), ts="arrived_at", seq="seq", marked=held
    )
    marks = accepted.select("url_key", *ORDER).unionByName(forced.select("url_key", *ORDER))
    on = ["url_key", *ORDER]
    flagged = runs.select(*on).join(marks.withColumn("own", F.lit(True)), on, "left")
    flagged = cut(flagged.withColumn("own", F.coalesce("own", F.lit(False))))
    near = with_latest_mark(flagged, "url_key", *ORDER, "own", "_near")
    if seen is not None:
        last = seen.groupBy("url_key").agg(F.max(F.col("seen_at").cast(kind)).alias("_seen"))
        near = look_up(near, last, "url_key")
    else:
        near = near.withColumn("_seen", F.lit(None).cast(kind))
    mark = F.coalesce("_near.ts", "_seen")
    age = F.unix_micros(F.col("arrived_at").cast("timestamp")) - F.unix_micros(mark.cast("timestamp"))
    late = ~F.col("own") & F.coalesce(age <= F.lit(ttl * 1_000_000), F.lit(False))
    return done.join(near.select(*on, late.alias("late")), on)


def _key_marks(done: DataFrame, seen: DataFrame | None) -> DataFrame:
    """(url_key, first_mark, was_seen): when a key was first marked in this run, or before it."""
    marking = F.col("fetched") & (~F.col("force") | F.col("parsed"))
    marks = done.groupBy("url_key").agg(
        F.min(F.when(marking, F.struct(*ORDER))).alias("first_mark")
    )
    if seen is None:
        return marks.withColumn("was_seen", F.lit(False))
    known = seen.select("url_key").distinct().withColumn("was_seen", F.lit(True))
    return marks.join(known, "url_key", "left").withColumn(
        "was_seen", F.coalesce("was_seen", F.lit(False))
    )


def run_requests(
    store, requests: DataFrame, pages: DataFrame, batch_id: int,
    settings: Settings | None = None, robots: DataFrame | None = None,
    replies: DataFrame | None = None,
) -> Mapping[str, DataFrame]:
    """Run a batch against a `CrawlStore` and write all its tables; safe to repeat."""
    store.compact_due(batch_id)
    keys = with_key(requests).select("url_key")
    incremental = settings is not None and settings.incremental
    run = scrape(
        requests,
        pages,
        settings,
        seen=None if incremental else store.seen.matching(keys, before=batch_id),
        stored_hashes=store.current_content_state(before=batch_id, keys=keys) if incremental else None,
        robots=robots,
        replies=replies,
    )
    tables = {
        "results": run.results(),
        "seen": run.marks(),
        "dead_letters": run.dead_letters(f"batch-{batch_id}"),
        "counters": run.counter_increments(),
    }
    if run.settings.incremental:
        tables["content_state"] = run.content_state()
    writes = [partial(getattr(store, name).write, rows, batch_id) for name, rows in tables.items()]
    side_by_side(store.spark, partial(store.items.upsert, run.items(), batch_id), *writes)
    return tables
