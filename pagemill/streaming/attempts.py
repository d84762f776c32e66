"""A stream of fetch attempts, put together into crawls of URLs.

A URL may be crawled again and again, and every crawl numbers its attempts from 1. State per URL,
in event time: the attempts of crawls that are not decided, and the spans of crawls that are. A
crawl is given out once all its attempts up to the deciding one, or up to the last allowed one, are
there; a timer closes one whose attempts stay away. Spans are kept for `gap_sec`, so that what comes
late for a decided crawl is not taken for another. Attempts may come in any order within a
micro-batch, and over micro-batches too if more than `gap_sec` lies between the crawls of a URL.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields
from itertools import islice
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pagemill.operators.fetchlog import is_deciding
from pagemill.streaming.stateful import GROUPS, by_group

#: A crawl without an attempt for so long is over; rows may be late by `LATE_SEC`.
GAP_SEC, LATE_SEC = 3_600, 86_400
CRAWLS = "url string, html string, arrived_at timestamp, seq long, attempts int"


@dataclass(frozen=True)
class Attempt:
    at: int
    seq: int
    number: int
    decides: bool
    body: str | None


@dataclass(frozen=True)
class Span:
    """From the first to the deciding attempt of a crawl that has been given out."""

    first: int
    last: int
    number: int


@dataclass(frozen=True)
class Crawl:
    at: int
    seq: int
    attempts: int
    body: str | None


def segments(attempts: list[Attempt], spans: list[Span], gap: int) -> list[list[Attempt]]:
    """Attempts in time order, cut where the number does not rise, or where more than `gap` or a
    decided crawl lies between."""
    out: list[list[Attempt]] = []
    for one in sorted(set(attempts), key=lambda x: (x.at, x.seq)):
        last = out[-1][-1] if out else None
        if last is None or one.number <= last.number or one.at > last.at + gap or any(last.at < x.first < one.at for x in spans):
            out.append([])
        out[-1].append(one)
    return out


def settle(
    attempts: list[Attempt], spans: list[Span], most: int, gap: int, closed_before: int | None = None
) -> tuple[list[Crawl], list[Attempt], list[Span]]:
    """The crawls that are decided, the attempts that still wait, and the spans to remember.

    With `closed_before`, crawls whose last attempt lies before it are decided by what is there, but
    for the rest of a decided one, and spans that ended before it are forgotten.
    """
    done, waiting, spans = [], [], list(spans)
    again = [x for x in attempts if any(span.first <= x.at <= span.last for span in spans)]
    for part in segments([x for x in attempts if x not in again], spans, gap):
        upto = next((x.number for x in part if x.decides), most)
        known = [x for x in part if x.number <= upto]
        whole = [x.number for x in known] == list(range(1, upto + 1))
        closed = closed_before is not None and part[-1].at < closed_before
        if not whole and not closed:
            waiting += part
        elif whole or not _is_rest(part[0], spans, gap):
            last = known[-1]
            done.append(Crawl(known[0].at, min(x.seq for x in known), last.number, last.body if last.decides else None))
            spans.append(Span(known[0].at, last.at, last.number))
            # What follows the deciding one may yet prove to be of a later crawl.
            waiting += [x for x in part if x.number > upto and not closed]
    if closed_before is not None:
        spans = [x for x in spans if x.last >= closed_before]
    return done, waiting, spans


def _is_rest(one: Attempt, spans: list[Span], gap: int) -> bool:
    """An attempt that came after its crawl had been decided."""
    return any(x.last < one.at <= x.last + gap and one.number > x.number for x in spans)


#: What is kept of a group: attempts that wait, spans of crawls given out, and the URLs' timers.
PARTS = {
    "waiting": "url array<string>, at array<bigint>, seq array<bigint>, number array<int>, decides array<boolean>, body array<string>",
    "span": "url array<string>, first array<bigint>, last array<bigint>, number array<int>",
    "timer": "url array<string>, at array<bigint>",
}


class Crawls(StatefulProcessor):
    """The URLs of a group, each for itself; their states lie together in one value (see `stateful`)."""

    def __init__(self, most: int, gap: int) -> None:
        self.most, self.gap = most, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # One value, so that a call asks the store once and tells it once.
        self.stored = handle.getValueState("stored", ", ".join(f"{name}_{column}" for name, ddl in PARTS.items() for column in ddl.split(", ")))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new: dict[str, list[Attempt]] = {}
        for part in rows:
            columns = (part[name] for name in ("url", "at", "seq", "number", "decides", "body"))
            for url, at, seq, number, decides, body in zip(*columns, strict=True):
                one = Attempt(int(at), int(seq), int(number), bool(decides), body if isinstance(body, str) else None)
                new.setdefault(url, []).append(one)
        yield self._advance(lambda timers: new, None)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        # One timer may stand for several crawls, so what counts is how far the clock has come.
        clock = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        yield self._advance(lambda timers: {url: [] for url, at in timers.items() if at <= clock}, clock * 1_000 - self.gap)

    def _advance(self, choose: Callable[[dict[str, int]], dict[str, list[Attempt]]], closed_before: int | None) -> pd.DataFrame:
        """Settle the URLs that `choose` takes by their timers, with their new attempts."""
        columns = iter(self.stored.get() or [[] for ddl in PARTS.values() for _ in ddl.split(", ")])
        waiting, spans, timers = ([*islice(columns, len(ddl.split(", ")))] for ddl in PARTS.values())
        waiting, spans, timers = _by_url(waiting, Attempt), _by_url(spans, Span), dict(zip(*timers, strict=True))
        # The group has one timer, the first of its URLs'.
        before, out = min(timers.values(), default=None), []
        for url, new in choose(timers).items():
            done, attempts, known = settle(waiting.get(url, []) + new, spans.get(url, []), self.most, self.gap, closed_before)
            out += [(url, one) for one in done]
            ends = [part[-1].at for part in segments(attempts, known, self.gap)] + [x.last for x in known]
            # The first millisecond at which something is more than the gap old.
            at = (min(ends) + self.gap) // 1_000 + 1 if ends else None
            for state, value in ((waiting, attempts), (spans, known), (timers, at)):
                if value or value == 0:
                    state[url] = value
                else:
                    state.pop(url, None)
        if timers:
            self.stored.update((*_columns(waiting, Attempt), *_columns(spans, Span), list(timers), list(timers.values())))
        else:
            # A URL with attempts that wait, or with spans, has a timer.
            self.stored.clear()
        first = min(timers.values(), default=None)
        if first != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if first is not None:
                self.handle.registerTimer(first)
        return pd.DataFrame(
            {
                "url": pd.Series([url for url, _ in out], dtype=object),
                "html": pd.Series([x.body for _, x in out], dtype=object),
                "at": pd.Series([x.at for _, x in out], dtype="int64"),
                "seq": pd.Series([x.seq for _, x in out], dtype="int64"),
                "attempts": pd.Series([x.attempts for _, x in out], dtype="int32"),
            }
        )

    def close(self) -> None:
        pass


def _by_url(columns: list[list], kind: type) -> dict[str, list]:
    found: dict[str, list] = {}
    for url, *values in zip(*columns, strict=True):
        found.setdefault(url, []).append(kind(*values))
    return found


def _columns(by_url: dict[str, list], kind: type) -> list[list]:
    """The inverse of `_by_url`."""
    urls = [url for url, some in by_url.items() for _ in some]
    return [urls, *([getattr(x, field.name) for some in by_url.values() for x in some] for field in fields(kind))]


def crawls_stream(
    log: DataFrame, max_retries: int = 3, gap_sec: float = GAP_SEC, late_sec: float = LATE_SEC, groups: int = GROUPS
) -> DataFrame:
    """(url, html, arrived_at, seq, attempts) of every crawl in a log with the columns of `ATTEMPTS`.

    `html` is null for a crawl without a page, `arrived_at` the time of its first attempt. Rows
    without a time or URL, and attempts outside 1 to `max_retries`, are no part of a crawl, but
    their time moves the clock: a row of attempt 0 closes what is long over.
    """
    rows = (
        log.withWatermark("attempted_at", f"{int(late_sec)} seconds")
        # One test on the time, so that it is made behind the watermark: all rows move the clock.
        .filter(F.when(F.col("attempted_at").isNotNull(), F.col("attempt").between(1, max_retries) & F.col("url").isNotNull()))
        .select(
            "url",
            "attempted_at",
            F.unix_micros("attempted_at").alias("at"),
            F.coalesce("seq", F.lit(0)).cast("long").alias("seq"),
            F.col("attempt").cast("int").alias("number"),
            is_deciding("status").alias("decides"),
            F.when((F.col("status") == 200) & (F.col("body") != ""), F.col("body")).alias("body"),
        )
    )
    found = by_group(rows, "url", groups).transformWithStateInPandas(
        statefulProcessor=Crawls(max_retries, int(gap_sec * 1_000_000)),
        outputStructType="url string, html string, at long, seq long, attempts int",
        outputMode="Append",
        timeMode="EventTime",
    )
    return found.select("url", "html", F.timestamp_micros("at").alias("arrived_at"), "seq", "attempts")
