"""Attempts, waits, delays and robots."""

from __future__ import annotations

from datetime import datetime, timedelta
from urllib.robotparser import RobotFileParser

import pytest

from pagemill.config import Settings
from pagemill.operators import fetchlog, politeness, robots
from pagemill.schemas import FETCH_LOG, ROBOTS_FILES

T0 = datetime(2024, 1, 1)


def log(spark, attempts):
    rows = [
        (url, n, status, error, body, T0 + timedelta(seconds=n))
        for url, tries in attempts.items()
        for n, (status, error, body) in enumerate(tries, 1)
    ]
    return spark.createDataFrame(rows, FETCH_LOG)


def test_outcomes(spark):
    df = log(spark, {
        "second": [(503, None, None), (200, None, "page")],
        "gone": [(404, None, "x"), (200, None, "late")],
        "down": [(500, None, None)] * 3,
        "blank": [(200, None, "")],
        "slow": [(None, "timeout", None), (403, None, None), (429, None, None), (200, None, "4th")],
        "odd": [(302, None, None), (204, None, None), (200, None, "ok")],
    })
    got = {
        r["url"]: (r["outcome"], r["attempts"], r["html"])
        for r in fetchlog.fetch_outcomes(df, 3).collect()
    }
    assert got == {
        "second": ("ok", 2, "page"),
        "gone": ("failed", 1, None),
        "down": ("failed", 3, None),
        "blank": ("failed", 1, None),
        "slow": ("failed", 3, None),
        "odd": ("ok", 3, "ok"),
    }


def test_waits(spark):
    df = log(spark, {"a": [(503, None, None), (None, "reset", None), (500, None, None)]})
    waits = fetchlog.retry_waits(df, 0.5)
    got = [row["wait_sec"] for row in waits.orderBy("attempt").collect()]
    assert got == [1.0, 2.0, 0.0]
    assert fetchlog.total_waits(waits).first()["total_wait_sec"] == 3.0


def delays(spark, raw):
    df = politeness.domain_delays(spark.createDataFrame([(raw,)], "raw string"))
    return {row["host"]: row["delay_sec"] for row in df.collect()}


def test_domain_delays(spark):
    assert delays(spark, "shop.example:0.75,no colon here,late.example:soon") == {"shop.example": 0.75}
    assert delays(spark, " A.example : 2 ,a.example:3e0,") == {"a.example": 3.0}
    assert delays(spark, "h:80:1.5,h2:1d,:4") == {"h:80": 1.5, "": 4.0}
    assert delays(spark, "") == {}


def test_delay_of_request(spark):
    table = politeness.delays_from_text(spark, "one.example:0.25,two.example:2")
    urls = ["https://one.example/x", "https://www.two.example/", "https://WWW.one.example", "https://b.two.example", "x"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r["url"]: r["delay_sec"] for r in politeness.with_delay(df, table, 0.5).collect()}
    assert [got[u] for u in urls] == [0.25, 2.0, 0.25, 0.5, 0.5]


def test_politeness_plan(spark):
    rows = [(n, "a" if n % 3 else "b", 0.5 if n % 3 else 2.0) for n in range(1, 50)]
    df = spark.createDataFrame(rows, "ordinal long, host string, delay_sec double")
    got = politeness.politeness_plan(df, slice_rows=7).collect()
    for row in got:
        earlier = [n for n, host, _ in rows if host == row["host"] and n < row["ordinal"]]
        assert row["start_after_sec"] == len(earlier) * row["delay_sec"]


FILES = {
    "plain.example": "User-agent: *\nDisallow: /private\nAllow: /private/ok\n",
    "order.example": "user-agent: bot\nDisallow: /\n\nUSER-AGENT: *\nallow: /a/b\ndisallow: /a # why\n",
    "twice.example": "User-agent: *\nDisallow: /x\n\nUser-agent: *\nDisallow: /\n",
    "shared.example": "User-agent: bot\nUser-agent: *\nDisallow: /s p\nDisallow: /q?x=1\n",
    "lost.example": "User-agent: *\n\nDisallow: /\n",
    "empty.example": "User-agent: *\nDisallow:\nDisallow: /after\n",
    "star.example": "User-agent: *\nAllow: /ok\nDisallow: *\n",
    "none.example": "Disallow: /\nSitemap: http://none.example/s.xml\n",
    "spaced.example": "User-agent: *\n   \nDisallow: /w\n#c\nCrawl-delay: 4\nDisallow: /%7Ehome\n",
    "delay.example": "User-agent: *\nCrawl-delay: 4\nUser-agent: z\nDisallow: /\n",
    "crlf.example": "User-agent: *\r\nDisallow: /c\r\n\r\nDisallow: /d\r\n",
}
PATHS = [
    "/", "", "/private", "/private/ok", "/a/b/c", "/a/c", "/x", "/y", "/s%20p/1", "/s p", "/q?x=1&y",
    "/q?x=2", "/ok", "/after", "/w/1", "/~home/me", "/%7Ehome", "/c", "/d", "?x=1", "/A",
]


def test_robots_follow_the_standard_reader(spark):
    files = spark.createDataFrame([(h, 200, b) for h, b in FILES.items()], ROBOTS_FILES)
    urls = [f"https://{host}{path}" for host in FILES for path in PATHS]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {
        r["url"]: r["allowed"]
        for r in robots.robots_allowed(df, robots.default_rules(files)).collect()
    }
    for host, body in FILES.items():
        reader = RobotFileParser()
        reader.parse(body.splitlines())
        for path in PATHS:
            url = f"https://{host}{path}"
            assert got[url] == reader.can_fetch("*", url), url


@pytest.mark.parametrize(
    ("status", "allowed"), [(401, False), (403, False), (404, True), (500, False), (None, False)]
)
def test_robots_status(spark, status, allowed):
    files = spark.createDataFrame([("h.example", status, "")], ROBOTS_FILES)
    df = spark.createDataFrame([("http://h.example/x",), ("http://other/x",)], "url string")
    got = robots.robots_allowed(df, robots.default_rules(files), default=True)
    assert {r["url"]: r["allowed"] for r in got.collect()} == {
        "http://h.example/x": allowed, "http://other/x": True
    }


def test_settings_from_env():
    got = Settings.from_env({"REQUEST_DELAY": "2.5", "INCREMENTAL": "True", "MAX_RETRIES": "7"})
    assert (got.request_delay_sec, got.incremental, got.max_retries) == (2.5, True, 7)
    assert Settings.from_env({}) == Settings()


def test_gates(spark):
    df = spark.createDataFrame([(s,) for s in (200, 403, 404, 429, 500, 503, None)], "status int")
    rows = df.select("status", fetchlog.is_retryable(), fetchlog.is_deciding()).collect()
    assert {r[0] for r in rows if r[1]} == {403, 429, 503}
    assert {r[0] for r in rows if r[2]} == {200, 404}
