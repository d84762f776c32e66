"""Registered queries over the given tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.config import Settings
from pagemill.functions import urls as U
from pagemill.functions import values as V
from pagemill.operators import (
    assisted,
    bloom,
    change,
    dedup,
    extract,
    fetchlog,
    frontier,
    items,
    politeness,
    report,
    robots,
)
from pagemill.operators.html import page_nodes
from pagemill.operators.ordering import number_rows
from pagemill.operators.select import element, page_text, within
from pagemill.plans.catalog import crawl_catalog
from pagemill.plans.local import run_batch, run_site
from pagemill.plans.scrape import scrape
from pagemill.schemas import item_defect
from pagemill.session import cut, shared_folder
from pagemill.sources.stores import BatchTable, CrawlStore, ItemStore
from pagemill.sources.tables import stream_table, without_body
from pagemill.streaming import first_seen as seen_stream
from pagemill.streaming import routing, stateful
from pagemill.streaming.attempts import crawls_stream

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SITE = "https://shop.example"
U_HOST = "shop.example"
NO_EXPIRY = Settings(dedup_ttl_sec=None)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


# --- inputs derived from the given tables -------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt_out(rows: DataFrame) -> DataFrame:
    """A small table that lies in fewer splits than there are cores, over all of them."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt_out(table(spark, sf_dir, "pages"))


def product_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The products that pages are made of; dealt out before there is any HTML."""
    return dealt_out(table(spark, sf_dir, "part"))


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests: one URL per user."""
    events = table(spark, sf_dir, "events")
    return events.select(
        F.concat(F.lit(f"{SITE}/u/"), F.col("user_id").cast("string")).alias("url"),
        F.col("ts").alias("arrived_at"),
        F.col("event_id").alias("seq"),
        "event_type",
        "value",
        "props",
        "user_id",
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observed page contents."""
    return dedup.with_key(visits(spark, sf_dir)).select(
        "url_key",
        F.sha1("props").alias("content_sha1"),
        F.col("arrived_at").alias("fetched_at"),
        "seq",
    )


VISIT_SQL = f"""
visits AS (
  SELECT concat('{SITE}/u/', user_id) AS url,
         sha1(concat('{SITE}/u/', user_id)) AS url_key,
         ts, event_id AS seq, event_type, value, props, user_id
  FROM events)"""


def text_of(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def product_url() -> Column:
    return text_of(f"{SITE}/p/", F.col("p_partkey"), ".html")


def star_word() -> Column:
    words = F.array(*[F.lit(word.title()) for word in V.RATING_WORDS])
    return F.element_at(words, F.col("p_size") % 5 + 1)


def css_pages(parts: DataFrame) -> DataFrame:
    p = F.col
    return parts.select(
        product_url().alias("url"),
        text_of(
            '<title>Floor</title><main><h1>Offers</h1><div class="product_main wide"><ul><li>'
            '<p class="few availability">In stock (', p("p_size"),
            ' available)</p><li><p class="sum price_color">&pound; ', p("p_retailprice"),
            '</p></ul><section><p class="star-rating ', star_word(), ' big"></p><h1>',
            p("p_name"), " ", p("p_partkey"),
            ' </h1></section></div><ol id="product_description"><li>Facts</ol><q>-</q><p> ',
            p("p_brand"), " &amp; ", p("p_type"), "</p><p>next</p></main>",
        ).alias("html"),
    )


def jsonld_pages(parts: DataFrame) -> DataFrame:
    p = F.col
    block = text_of(
        '{"@type": "Product", "name": "', p("p_name"), " ", p("p_partkey"),
        '", "description": " ', p("p_brand"), ' ", "aggregateRating": {"ratingValue": ',
        p("p_size") % 5 + 1, '}, "offers": [{"price": "', p("p_retailprice"),
        '", "availability": "http://schema.org/InStock"}]}',
    )
    wrapped = (
        F.when(p("p_partkey") % 3 == 0, block)
        .when(p("p_partkey") % 3 == 1, text_of('[{"@type": "Site"}, ', block, "]"))
        .otherwise(text_of('{"@graph": [7, ', block, "]}"))
    )
    return parts.select(
        product_url().alias("url"),
        text_of(
            '<script type="application/ld+json">{broken</script>',
            '<script type="application/ld+json">', wrapped,
            '</script><h1>Misleading</h1><p class="price">1</p>',
        ).alias("html"),
    )


def meta_pages(parts: DataFrame) -> DataFrame:
    p = F.col
    return parts.select(
        product_url().alias("url"),
        text_of(
            '<head><meta property="og:title" content=" ', p("p_name"), " ", p("p_partkey"),
            ' "><meta name="og:description" content="', p("p_brand"),
            '"><meta property="product:price:amount" content=""/>',
            '<meta name="og:price:amount" content="', p("p_retailprice"),
            '"><meta name="rating" content="', p("p_size") % 8, ' of 5"></head><h1>No</h1>',
        ).alias("html"),
    )


def plain_pages(parts: DataFrame) -> DataFrame:
    p = F.col
    return parts.select(
        product_url().alias("url"),
        text_of(
            "<title>", p("p_name"), " ", p("p_partkey"), " | Shop</title><div>Only <b>€ ",
            p("p_retailprice"), "</b> - ",
            F.when(p("p_size") % 2 == 0, "OUT OF STOCK").otherwise("in stock"),
            ". Rated ", p("p_size") % 5 + 1, " out of 5.</div>",
        ).alias("html"),
    )


def listing_pages(parts: DataFrame) -> DataFrame:
    """Listing pages of 20 products each, linked by `next`, as one chain over all products.

    They are spread over the cores, as a landed table of pages would be.
    """
    number = F.floor(F.col("p_partkey") / 20)
    link = text_of('<article class="product_pod"><h3><a href="../p/', F.col("p_partkey"),
                   '.html">', F.col("p_name"), "</a></h3></article>")
    pages = parts.groupBy(number.alias("n")).agg(
        F.array_sort(F.collect_list(F.struct("p_partkey", link.alias("link")))).alias("links")
    )
    joined = F.array_join(F.transform("links", lambda x: x["link"]), "\n")
    following = text_of('<ul><li class="next"><a href="page-', F.col("n") + 2, '.html">next</a></ul>')
    return pages.select(
        listing_url(F.col("n")).alias("url"),
        text_of("<body><h1>All</h1>", joined, following, "</body>").alias("html"),
        "n",
    ).repartition(parts.sparkSession.sparkContext.defaultParallelism)


def listing_url(number: Column) -> Column:
    return text_of(f"{SITE}/catalogue/page-", number + 1, ".html")


def seeds(listings: DataFrame) -> DataFrame:
    """A walk starts at every fifth listing page."""
    return listings.filter(F.col("n") % 5 == 0).select(
        "url", F.lit("2024-01-01").cast("timestamp").alias("arrived_at"), F.col("n").alias("seq")
    )


LISTING_SQL = f"""
links AS (
  SELECT p_partkey, p_partkey // 20 AS n, p_partkey % 20 AS pos,
         concat('{SITE}/p/', p_partkey, '.html') AS url, p_name, p_retailprice FROM part),
walks AS (
  SELECT DISTINCT n, n // 5 * 5 AS walk, n % 5 AS page_depth,
         concat('{SITE}/catalogue/page-', n + 1, '.html') AS url FROM links)"""


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as fetch attempts: the requests of a user and a day are attempts at one URL."""
    rows = visits(spark, sf_dir).withColumn(
        "url", text_of(F.col("url"), "/", F.to_date("arrived_at"))
    )
    kind = F.col("event_type")
    status = (
        F.when(kind == "view", 200)
        .when(kind == "click", 503)
        .when(kind == "purchase", 429)
        .when(kind == "signup", F.when(F.col("value") < 10, 404).otherwise(500))
    )
    numbered = number_rows(rows, "seq", by=("url",), out="attempt")
    return numbered.select(
        "url",
        F.col("attempt").cast("int").alias("attempt"),
        status.alias("status"),
        F.when(kind == "error", F.lit("timeout")).alias("error"),
        F.when(F.col("value") < 5, "").otherwise(F.col("props")).alias("body"),
        F.col("arrived_at").cast("timestamp").alias("attempted_at"),
        "seq",
    )


ATTEMPT_SQL = VISIT_SQL + """,
attempts AS (
  SELECT concat(url, '/', CAST(ts AS DATE)) AS url, seq,
         row_number() OVER (PARTITION BY url, CAST(ts AS DATE) ORDER BY seq) AS attempt,
         CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 503 WHEN 'purchase' THEN 429
              WHEN 'signup' THEN CASE WHEN value < 10 THEN 404 ELSE 500 END END AS status,
         CASE WHEN event_type = 'error' THEN 'timeout' END AS error,
         CASE WHEN value < 5 THEN '' ELSE props END AS body
  FROM visits),
tried AS (SELECT * FROM attempts WHERE attempt <= 3),
deciding AS (
  SELECT url, min(attempt) AS decided FROM tried WHERE status IN (200, 404) GROUP BY url),
ends AS (
  SELECT t.url, d.decided,
         max(t.attempt) AS last, max(CASE WHEN t.attempt = l.last THEN t.status END) AS last_status,
         max(CASE WHEN t.attempt = d.decided THEN t.status END) AS status,
         max(CASE WHEN t.attempt = d.decided THEN t.body END) AS body,
         max(CASE WHEN t.attempt = l.last THEN t.error END) AS end_error
  FROM tried t JOIN (SELECT url, max(attempt) AS last FROM tried GROUP BY url) l USING (url)
       LEFT JOIN deciding d USING (url)
  GROUP BY t.url, d.decided),
outcomes AS (
  SELECT url,
         CASE WHEN status = 200 AND body <> '' THEN 'ok' ELSE 'failed' END AS outcome,
         CASE WHEN status = 200 AND body <> '' THEN 'ok'
              WHEN status = 200 THEN 'empty body'
              WHEN status IS NOT NULL THEN concat('status ', status)
              WHEN end_error IS NOT NULL THEN concat('gave up: ', end_error)
              ELSE concat('gave up: status ', last_status) END AS reason,
         CAST(coalesce(decided, last) AS INTEGER) AS attempts,
         CASE WHEN status = 200 AND body <> '' THEN body END AS html
  FROM ends)"""


# --- keys, hashes, single values ----------------------------------------------------------


@query("SELECT page_id, sha1(lower(trim(url))) AS url_key FROM pages")
def url_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = text_of("\t  ", F.upper("url"), " \r\n")
    return table(spark, sf_dir, "pages").select("page_id", U.url_key(padded).alias("url_key"))


@query("SELECT doc_id, sha1(text) AS content_sha1 FROM documents")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", U.content_sha1("text").alias("content_sha1")
    )


@query(
    """
SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS host,
       concat(regexp_extract(url, '^([a-z]+://[^/]*)', 1), '/catalogue/page-1.html') AS seed
FROM pages"""
)
def page_hosts_and_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "pages").withColumnRenamed("url", "page_url")
    root = base.withColumn("root", U.resolve_url("page_url", F.lit("/")))
    return frontier.seed_urls(root, "root").select(
        "page_id", U.host_of("page_url").alias("host"), F.col("url").alias("seed")
    )


@query(
    """
SELECT event_id,
       value AS price,
       least(5, (event_id % 9)) AS rating,
       CASE WHEN event_id % 4 = 0 THEN 'unknown' ELSE event_type END AS availability,
       concat('ok: ', left(repeat(event_type, 9), 40), ' (£', CAST(value AS VARCHAR), ')') AS line
FROM events"""
)
def field_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    amount = F.replace(F.col("value").cast("string"), F.lit("."), F.lit(","))
    stock = F.when(F.col("event_id") % 4 == 0, "").otherwise(
        text_of("http://schema.org/", F.col("event_type"), " ")
    )
    stars = text_of("score ", F.col("event_id") % 9, ".2")
    title = F.repeat("event_type", 9)
    return events.select(
        "event_id",
        V.to_price(text_of("from € ", amount, " only")).alias("price"),
        V.clamp_rating(V.to_rating(stars)).cast("long").alias("rating"),
        V.availability_tail(stock).alias("availability"),
        V.status_line(F.lit("ok"), title, "value").alias("line"),
    )


@query(
    """
SELECT page_id, page_id % 3 <> 1 AS is_block, page_id % 5 = 0 AS no_body FROM pages"""
)
def block_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    marker = (
        F.when(F.col("page_id") % 3 == 0, "<i>DataDome</i>")
        .when(F.col("page_id") % 3 == 2, '<i id="CF-browser-verification">')
        .otherwise("")
    )
    marked = pages.select("page_id", F.concat("html", marker).alias("html"))
    emptied = pages.select(
        "page_id", F.when(F.col("page_id") % 5 == 0, "").otherwise(F.col("html")).alias("html")
    )
    failed = without_body(emptied).select("page_id", F.lit(True).alias("failed"))
    return (
        marked.select("page_id", V.is_block_page("html").alias("is_block"))
        .join(failed, "page_id", "left")
        .select("page_id", "is_block", F.coalesce("failed", F.lit(False)).alias("no_body"))
    )


# --- reading pages ------------------------------------------------------------------------

DECODED = """
replace(replace(replace(replace(regexp_replace({0}, '&amp$', '&'), '&quot;', '"'),
  '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"""


VISIBLE_SQL = f"""
bare AS (
  SELECT page_id, regexp_replace(html,
    '<script.*?</script>|<style.*?</style>', '', 'gs') AS html FROM pages),
texts AS (
  SELECT page_id, array_to_string(list_filter(list_transform(
    string_split_regex(html, '<!--.*?-->|<[^>]*>'),
    lambda t: trim({DECODED.format("t")}, chr(32) || chr(9) || chr(10) || chr(13))),
    lambda t: t <> ''), ' ') AS text FROM bare)"""


@query(
    rf"""
WITH {VISIBLE_SQL}
SELECT p.page_id,
       {DECODED.format(r"regexp_replace(regexp_extract(p.html, '<h1>(.*?)</h1>', 1, 's'), '^\s+|\s+$', '', 'g')")} AS title,
       coalesce(TRY_CAST(regexp_extract(replace(
         regexp_extract(t.text, '[£$€₺]\s?[0-9]+(?:[.,][0-9]+)?'), ',', '.'),
         '[0-9]+(?:\.[0-9]+)?') AS DOUBLE), 0) AS price,
       coalesce(nullif(regexp_extract(t.text,
         '(?i)(In stock(?:\s*\([0-9]+\s*available\))?|Out of stock|Stokta(?:\s*yok)?)'), ''),
         'unknown') AS availability,
       least(5, coalesce(CAST(round_even(TRY_CAST(regexp_extract(t.text,
         '(?i)([0-9](?:\.[0-9])?)\s*(?:/|out of)\s*5', 1) AS DOUBLE), 0) AS INTEGER), 0)) AS rating,
       '' AS description
FROM pages p JOIN texts t USING (page_id)"""
)
def page_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_pages(spark, sf_dir).select("page_id", "html")
    return extract.extract_records(pages)


@query(f"WITH {VISIBLE_SQL} SELECT page_id, text FROM texts")
def visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = page_nodes(html_pages(spark, sf_dir).select("page_id", "html"))
    return nodes.select("page_id", page_text(F.col("texts")).alias("text"))


@query(
    f"WITH {VISIBLE_SQL} SELECT page_id, concat('"
    + assisted.INSTRUCTION
    + "', left(text, 6000)) AS prompt FROM texts"
)
def prompt_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assisted.prompt_requests(html_pages(spark, sf_dir).select("page_id", "html"))


@query(
    f"""
SELECT page_id, CAST(g.i - 1 AS INTEGER) AS pos,
       concat(regexp_extract(url, '^([a-z]+://[^/]*)', 1),
              {DECODED.format("hrefs[g.i]")}) AS link
FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM pages) p,
     LATERAL (SELECT unnest(range(1, len(hrefs) + 1)) AS i) g"""
)
def links_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = page_nodes(html_pages(spark, sf_dir))
    hrefs = F.transform(within(element("a"))(F.col("els")), lambda a: a["attrs"]["href"])
    found = nodes.select("page_id", "url", F.posexplode(hrefs).alias("pos", "href"))
    return found.select("page_id", "pos", U.resolve_url("url", "href").alias("link"))


# --- products -----------------------------------------------------------------------------


@query(
    f"""
SELECT concat('{SITE}/p/', p_partkey, '.html') AS url, concat(p_name, ' ', p_partkey) AS title,
       p_retailprice AS price, concat('In stock (', p_size, ' available)') AS availability,
       CAST(p_size % 5 + 1 AS INTEGER) AS rating, concat(p_brand, ' & ', p_type) AS description
FROM part"""
)
def product_extract_css(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_records(css_pages(product_table(spark, sf_dir)))


@query(
    f"""
SELECT concat('{SITE}/p/', p_partkey, '.html') AS url, concat(p_name, ' ', p_partkey) AS title,
       p_retailprice AS price, 'InStock' AS availability,
       CAST(p_size % 5 + 1 AS INTEGER) AS rating, p_brand AS description
FROM part"""
)
def product_extract_jsonld(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_records(jsonld_pages(product_table(spark, sf_dir)))


@query(
    f"""
SELECT concat('{SITE}/p/', p_partkey, '.html') AS url, p_name AS title, p_retailprice AS price,
       concat('{{''of'': [''', p_type, ''', None]}}') AS availability, 0 AS rating,
       concat('[''', p_name, ' ', p_size, ''', ''say "', p_brand, ', now"'', ', p_size, ', True]')
         AS description
FROM part"""
)
def jsonld_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col
    block = text_of(
        '{"name": "', p("p_name"), '", "price": ', p("p_retailprice"), ', "description": ["',
        p("p_name"), " ", p("p_size"), '", "say \\"', p("p_brand"), ', now\\"", ', p("p_size"),
        ', true], "offers": {"availability": {"of": ["', p("p_type"), '", null]}}}',
    )
    html = text_of('<script type="application/ld+json">', block, "</script>")
    pages = product_table(spark, sf_dir).select(product_url().alias("url"), html.alias("html"))
    return extract.extract_records(pages)


@query(
    f"""
SELECT concat('{SITE}/log/', n) AS url, concat('Log ', n) AS title, 0.0 AS price,
       concat('Event ', lo) AS availability, 0 AS rating, concat('End of ', n) AS description
FROM (SELECT event_id // 5000 AS n, min(event_id) AS lo FROM events GROUP BY 1)"""
)
def extract_large_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of 5,000 sibling blocks each, with what the fields need at either end."""
    n = F.floor(F.col("event_id") / 5000)
    block = text_of('<div><p class="availability">Event ', F.col("event_id"), "</p></div>")
    pages = table(spark, sf_dir, "events").groupBy(n.alias("n")).agg(
        F.array_sort(F.collect_list(F.struct("event_id", block.alias("block")))).alias("blocks")
    )
    html = text_of(
        "<h1>Log ", F.col("n"), "</h1>", F.array_join("blocks.block", ""),
        '<div class="product_main"><p>End of ', F.col("n"), "</p></div>",
    )
    return extract.extract_records(
        pages.select(text_of(f"{SITE}/log/", F.col("n")).alias("url"), html.alias("html"))
    )


@query(
    f"""
SELECT concat('{SITE}/p/', p_partkey, '.html') AS url, concat(p_name, ' ', p_partkey) AS title,
       p_retailprice AS price, 'unknown' AS availability,
       CAST(least(5, p_size % 8) AS INTEGER) AS rating, p_brand AS description
FROM part"""
)
def product_extract_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_records(meta_pages(product_table(spark, sf_dir)))


@query(
    f"""
SELECT concat('{SITE}/p/', p_partkey, '.html') AS url, concat(p_name, ' ', p_partkey) AS title,
       p_retailprice AS price,
       CASE WHEN p_size % 2 = 0 THEN 'OUT OF STOCK' ELSE 'in stock' END AS availability,
       CAST(p_size % 5 + 1 AS INTEGER) AS rating, '' AS description
FROM part"""
)
def product_extract_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_records(plain_pages(product_table(spark, sf_dir)))


@query(
    """
SELECT event_id AS seq,
       CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 'Bilinmeyen Başlık'
            ELSE event_type END AS title,
       CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 0.0 ELSE value END AS price,
       CASE WHEN event_id % 11 = 0 THEN NULL ELSE 'unknown' END AS availability,
       CASE WHEN event_id % 11 = 0 THEN NULL
            ELSE CAST(least(5, event_id % 9) AS INTEGER) END AS rating,
       CASE WHEN event_id % 11 = 0 THEN NULL ELSE props END AS description
FROM events"""
)
def reply_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = visits(spark, sf_dir)
    n = F.col("seq")
    reply = F.when(n % 11 == 0, F.col("props").substr(F.lit(1), F.lit(5))).otherwise(
        text_of(
            '{"title": ',
            F.when(n % 5 == 0, "null").otherwise(text_of('"', F.col("event_type"), '"')),
            ', "price": ',
            F.when(n % 7 == 0, '""')
            .when(n % 2 == 0, F.col("value").cast("string"))
            .otherwise(text_of('" ', F.col("value"), ' "')),
            ', "rating": ',
            F.when(n % 3 == 0, text_of('"', n % 9, '"')).otherwise(text_of(n % 9, ".7")),
            ', "availability": false, "description": "',
            F.replace("props", F.lit('"'), F.lit('\\"')),
            '"}',
        )
    )
    return assisted.decode_replies(events.select("seq", reply.alias("reply")))


@query(
    f"""
SELECT concat('{SITE}/p/', p_partkey, '.html') AS url,
       CASE WHEN p_partkey % 2 = 0 THEN p_name END AS title,
       CASE WHEN p_partkey % 2 = 0 THEN p_retailprice END AS price,
       CASE WHEN p_partkey % 2 = 0 THEN 'unknown' END AS availability,
       CASE WHEN p_partkey % 2 = 0 THEN CAST(0 AS INTEGER) END AS rating,
       CASE WHEN p_partkey % 2 = 0 THEN '' END AS description
FROM part"""
)
def items_from_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = product_table(spark, sf_dir)
    answer = text_of('{"title": "', F.col("p_name"), '", "price": ', F.col("p_retailprice"), "}")
    reply = F.when(F.col("p_partkey") % 2 == 0, answer).otherwise("no idea")
    replies = parts.select(product_url().alias("url"), reply.alias("reply"))
    return assisted.extract_from_replies(parts.select(product_url().alias("url")), replies)


# --- gates and change ---------------------------------------------------------------------


@query(
    f"""
WITH {VISIT_SQL}
SELECT seq, url_key, row_number() OVER (PARTITION BY url_key ORDER BY ts, seq) = 1 AS is_first
FROM visits"""
)
def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = dedup.with_key(visits(spark, sf_dir))
    return dedup.mark_first(keyed).select("seq", "url_key", "is_first")


@query(
    f"""
WITH {VISIT_SQL},
late AS (SELECT url_key, min(seq) AS seq FROM visits WHERE ts >= '2024-01-01 12:00:00' GROUP BY url_key)
SELECT url_key, seq FROM late l
WHERE NOT EXISTS (SELECT 1 FROM visits v WHERE v.ts < '2024-01-01 12:00:00' AND v.url_key = l.url_key)"""
)
def unseen_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = dedup.with_key(visits(spark, sf_dir))
    return dedup.first_seen(
        keyed.filter("arrived_at >= '2024-01-01 12:00:00'"), keyed.filter("arrived_at < '2024-01-01 12:00:00'")
    ).select("url_key", "seq")


@query(
    f"""
WITH {VISIT_SQL}
SELECT url_key, min(ts) AS seen_at FROM visits GROUP BY url_key"""
)
def seen_after_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = dedup.with_key(visits(spark, sf_dir)).withColumnRenamed("arrived_at", "seen_at")
    return dedup.mark_seen(
        keyed.filter("seen_at >= '2024-01-10'"), keyed.filter("seen_at < '2024-01-10'")
    )


TTL_SQL = f"""
WITH RECURSIVE {VISIT_SQL},
o AS (SELECT url_key, ts, seq, row_number() OVER (PARTITION BY url_key ORDER BY ts, seq) AS rn
      FROM visits),
walk AS (
  SELECT url_key, rn, seq, ts AS mark, true AS accepted FROM o WHERE rn = 1
  UNION ALL
  SELECT o.url_key, o.rn, o.seq,
         CASE WHEN o.ts > w.mark + INTERVAL 1 DAY THEN o.ts ELSE w.mark END,
         o.ts > w.mark + INTERVAL 1 DAY
  FROM walk w JOIN o ON o.url_key = w.url_key AND o.rn = w.rn + 1)
SELECT url_key, seq FROM walk WHERE accepted"""


@query(TTL_SQL)
def ttl_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = dedup.with_key(visits(spark, sf_dir))
    return dedup.ttl_first_seen(keyed, 86_400).select("url_key", "seq")


@query(
    f"""
WITH {VISIT_SQL}
SELECT url_key, seq,
       lag(props) OVER (PARTITION BY url_key ORDER BY ts, seq) IS DISTINCT FROM props AS changed
FROM visits"""
)
def content_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change.content_changed(observations(spark, sf_dir)).select("url_key", "seq", "changed")


def repeated_hash() -> Column:
    """The hash of a content that the visits of a URL often repeat: the kind of visit."""
    return U.content_sha1("event_type").alias("content_sha1")


CHANGED_TTL_SQL = f"""
WITH RECURSIVE {VISIT_SQL},
o AS (SELECT url_key, ts, seq, sha1(event_type) AS content,
             row_number() OVER (PARTITION BY url_key ORDER BY ts, seq) AS rn FROM visits),
walk AS (
  SELECT url_key, rn, seq, content, ts AS set_at, true AS changed FROM o WHERE rn = 1
  UNION ALL
  SELECT o.url_key, o.rn, o.seq, o.content,
         CASE WHEN o.content <> w.content OR o.ts > w.set_at + INTERVAL 1 DAY
              THEN o.ts ELSE w.set_at END,
         o.content <> w.content OR o.ts > w.set_at + INTERVAL 1 DAY
  FROM walk w JOIN o ON o.url_key = w.url_key AND o.rn = w.rn + 1)
SELECT url_key, seq, changed FROM walk"""


@query(CHANGED_TTL_SQL)
def content_changed_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = dedup.with_key(visits(spark, sf_dir))
    rows = keyed.select(
        "url_key",
        repeated_hash(),
        F.col("arrived_at").alias("fetched_at"),
        "seq",
    )
    return change.content_changed_ttl(rows, 86_400).select("url_key", "seq", "changed")


@query(
    f"""
WITH {VISIT_SQL}, r AS (
  SELECT *, lag(props) OVER (PARTITION BY url_key ORDER BY ts, seq)
            IS DISTINCT FROM props AS changed FROM visits)
SELECT url_key, sha1(arg_max(props, ts)) AS content_sha1, max(ts) AS set_at
FROM r WHERE changed GROUP BY url_key"""
)
def content_hashes_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change.content_state(change.content_changed(observations(spark, sf_dir)))


@query("SELECT sha1(lower(url)) AS url_key, starts_with(url, 'https:') AS might_be_seen FROM pages")
def bloom_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    keyed = dedup.with_key(pages.select("url"))
    # An error rate far below one in the number of keys: a false positive is practically impossible.
    shape = bloom.Shape(capacity=max(1, pages.count()), error_rate=1e-12)
    # Two earlier runs took the secure pages, those of one language and the others.
    secure, english = F.startswith(F.col("url"), F.lit("https:")), F.contains(F.col("url"), F.lit("/en/"))
    sketch = bloom.merge_sketches(
        bloom.build_sketch(keyed.filter(secure & english), shape),
        bloom.build_sketch(keyed.filter(secure & ~english), shape),
    )
    return bloom.might_be_seen(keyed, sketch, shape)


# --- items --------------------------------------------------------------------------------

ITEM_SQL = VISIT_SQL + """,
items AS (
  SELECT url, arg_max(event_type, ts) AS title, arg_max(value, ts) AS price,
         arg_max(props, ts) AS description, min(seq) AS first_seq FROM visits GROUP BY url),
numbered AS (SELECT *, row_number() OVER (ORDER BY first_seq) AS id FROM items)"""


def item_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visits(spark, sf_dir).select(
        "url",
        F.col("event_type").alias("title"),
        F.col("value").alias("price"),
        F.col("props").alias("description"),
        F.col("arrived_at").alias("fetched_at"),
        "seq",
    )


ITEM_RECORD_FIELDS = ("title", "price", "description")


def stored_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches: the second updates items of the first and adds new ones."""
    records = item_records(spark, sf_dir)
    none = spark.createDataFrame([], "url string, id long")
    early = items.new_versions(records.filter("fetched_at < '2024-01-02'"), none, ITEM_RECORD_FIELDS)
    late = items.new_versions(records.filter("fetched_at >= '2024-01-02'"), early, ITEM_RECORD_FIELDS)
    return items.current_items(early.unionByName(late), ITEM_RECORD_FIELDS)


@query(f"WITH {ITEM_SQL} SELECT id, url, title, price, description FROM numbered")
def items_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_items(spark, sf_dir).select("id", "url", "title", "price", "description")


@query(f"WITH {ITEM_SQL} SELECT id, url, title FROM numbered ORDER BY id DESC LIMIT 50 OFFSET 20")
def items_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items.items_page(stored_items(spark, sf_dir), 50, 20).select("id", "url", "title")


@query(f"WITH {ITEM_SQL} SELECT count(*) AS items FROM items")
def items_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items.count_items(stored_items(spark, sf_dir))


@query(
    f"""
WITH {ITEM_SQL}, page AS (SELECT id, url FROM numbered ORDER BY id DESC LIMIT 50 OFFSET 20)
SELECT (SELECT count(*) FROM items) AS total, coalesce(string_agg(id || ' ' || url, ',' ORDER BY id DESC), '') AS listed FROM page"""
)
def items_page_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = items.items_listing(stored_items(spark, sf_dir).select("id", "url"), 50, 20)
    rows = F.transform("items", lambda x: text_of(x["id"], " ", x["url"]))
    return listed.select("total", F.array_join(rows, ",").alias("listed"))


# --- fetching -----------------------------------------------------------------------------


@query(f"WITH {ATTEMPT_SQL} SELECT url, outcome, reason, attempts, html FROM outcomes")
def fetch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fetchlog.fetch_outcomes(attempts(spark, sf_dir))


@query(
    f"""
WITH {ATTEMPT_SQL}
SELECT url, sum(CASE WHEN status IN (429, 503) OR error IS NOT NULL
                     THEN 0.5 * 2 ** attempt ELSE 0 END) AS total_wait_sec
FROM tried GROUP BY url"""
)
def retry_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fetchlog.total_waits(fetchlog.retry_waits(attempts(spark, sf_dir), 0.5))


@query(
    f"""
WITH {ATTEMPT_SQL}
SELECT 'pagemill.scrape' AS task, concat('run:', attempts) AS task_id, [url] AS args,
       concat('FetchError(''Fetch failed: ', url, ''')') AS error, url
FROM outcomes WHERE outcome = 'failed'"""
)
def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = fetchlog.failed_fetches(fetchlog.fetch_outcomes(attempts(spark, sf_dir)))
    rows = report.dead_letters(
        failed,
        text_of("run:", F.col("attempts")),
        report.fetch_error(),
        F.lit("2024-02-01").cast("timestamp"),
    )
    return rows.drop("failed_at")


@query(
    f"""
WITH {ATTEMPT_SQL}
SELECT concat('FetchError(''Fetch failed: ', url, ''')') AS error, url
FROM outcomes WHERE outcome = 'failed' ORDER BY url LIMIT 100"""
)
def dead_letters_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = fetchlog.failed_fetches(fetchlog.fetch_outcomes(attempts(spark, sf_dir)))
    rows = report.dead_letters(
        failed, F.lit("run"), report.fetch_error(), F.lit("2024-02-01").cast("timestamp")
    )
    return report.read_dead_letters(report.dead_letter_payload(rows), 100).select("error", "url")


@query(
    f"""
WITH {ATTEMPT_SQL}, oldest AS (SELECT url FROM outcomes WHERE outcome = 'failed' ORDER BY url LIMIT 100)
SELECT count(*) AS count, coalesce(string_agg(url, ',' ORDER BY url), '') AS urls FROM oldest"""
)
def dead_letters_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = fetchlog.failed_fetches(fetchlog.fetch_outcomes(attempts(spark, sf_dir)))
    rows = report.dead_letters(
        failed, F.lit("run"), report.fetch_error(), F.lit("2024-02-01").cast("timestamp")
    )
    listed = report.dead_letter_listing(report.dead_letter_payload(rows), 100)
    return listed.select("count", F.array_join(F.col("items.url"), ",").alias("urls"))


HOST_SQL = "regexp_extract(url, '^[a-z]+://([^/]*)', 1)"


@query(f"SELECT DISTINCT {HOST_SQL} AS host, length({HOST_SQL}) * 0.25::DOUBLE AS delay_sec FROM pages")
def domain_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = U.host_of("url")
    raw = text_of(
        host, ":9, no-number,", F.upper(host), " : ", F.length(host) * F.lit(0.25), ",", host, ":x"
    )
    return politeness.domain_delays(table(spark, sf_dir, "pages").select(raw.alias("raw")))


# A settings text; hosts of the pages table with and without `www.`.
DELAYS = "blog.tionsh.example.com:2, tionble.example.org:1.25,ththon.example.org:3.5,bad"
DELAY_SQL = f"""
planned AS (
  SELECT page_id, {HOST_SQL} AS host,
         CASE {HOST_SQL} WHEN 'blog.tionsh.example.com' THEN 2.0
              WHEN 'tionble.example.org' THEN 1.25 WHEN 'www.tionble.example.org' THEN 1.25
              WHEN 'www.ththon.example.org' THEN 3.5 WHEN 'ththon.example.org' THEN 3.5
              WHEN 'www.blog.tionsh.example.com' THEN 2.0 ELSE 0.5 END::DOUBLE AS delay_sec
  FROM pages)"""


def delayed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    delays = politeness.delays_from_text(spark, DELAYS)
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return politeness.with_delay(pages, delays, Settings().request_delay_sec)


@query(f"WITH {DELAY_SQL} SELECT page_id, host, delay_sec FROM planned")
def request_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delayed_pages(spark, sf_dir).select("page_id", "host", "delay_sec")


@query(
    f"""
WITH {DELAY_SQL}
SELECT page_id, (row_number() OVER (PARTITION BY host ORDER BY page_id) - 1) * delay_sec
       AS start_after_sec FROM planned"""
)
def politeness_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = politeness.politeness_plan(delayed_pages(spark, sf_dir), order="page_id")
    return plan.select("page_id", "start_after_sec")


def robots_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = table(spark, sf_dir, "pages").select(U.host_of("url").alias("host")).distinct()
    kind = F.length("host") % 6
    status = F.when(kind == 0, 404).when(kind == 1, 503).when(kind == 2, 403).otherwise(200)
    body = text_of(
        "# rules\nUser-agent: other\nDisallow: /\n\nUser-Agent: first\nuser-agent: *\n",
        "Allow: /en/7\nDisallow: /en/ # all else\nDisallow: /%66r/8\nCrawl-delay: 3\n\n",
        "Disallow: /\n\nUser-agent: *\nDisallow: /",
    )
    return hosts.select("host", status.alias("status"), body.alias("body"))


@query(
    f"""
WITH p AS (SELECT page_id, length({HOST_SQL}) % 6 AS kind,
                  regexp_replace(url, '^[a-z]+://[^/]*', '') AS path FROM pages)
SELECT page_id, CASE kind WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false
       ELSE CASE WHEN starts_with(path, '/en/7') THEN true WHEN starts_with(path, '/en/') THEN false
                 WHEN starts_with(path, '/fr/8') THEN false ELSE true END END AS allowed
FROM p"""
)
def robots_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = robots.default_rules(robots_files(spark, sf_dir))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return robots.robots_allowed(pages, rules).select("page_id", "allowed")


@query(
    f"""
WITH h AS (SELECT DISTINCT {HOST_SQL} AS host FROM pages),
r(group_id, agent, rule_no, allow, prefix) AS (VALUES
  (1, 'other', 2, false, '/'),
  (2, 'first', 6, true, '/en/7'), (2, 'first', 7, false, '/en/'), (2, 'first', 8, false, '/fr/8'),
  (2, 'first', 9, NULL, NULL),
  (2, '*', 6, true, '/en/7'), (2, '*', 7, false, '/en/'), (2, '*', 8, false, '/fr/8'),
  (2, '*', 9, NULL, NULL),
  (3, '*', 14, false, '/'))
SELECT host, agent, group_id, rule_no, allow, prefix FROM h, r WHERE length(host) % 6 > 2"""
)
def robots_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    loaded = robots_files(spark, sf_dir).filter("status = 200")
    return robots.robots_rules(loaded).select(
        "host", "agent", F.col("group_id").cast("int").alias("group_id"), "rule_no", "allow", "prefix"
    )


# --- listings -----------------------------------------------------------------------------


@query(f"WITH {LISTING_SQL} SELECT walk, CAST(page_depth AS INTEGER) AS page_depth, url FROM walks")
def catalog_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    listings = listing_pages(product_table(spark, sf_dir))
    read = frontier.listing_links(listings.select("url", "html"))
    return frontier.walk_listings(seeds(listings), read, 5).select("walk", "page_depth", "url")


PLAN_SQL = LISTING_SQL + """,
plan AS (
  SELECT w.walk, w.page_depth, l.pos, l.url, l.p_partkey, l.p_name, l.p_retailprice,
         row_number() OVER (PARTITION BY w.walk ORDER BY w.page_depth, l.pos) AS ordinal
  FROM walks w JOIN links l USING (n))"""


def walked(spark: SparkSession, sf_dir: str) -> DataFrame:
    listings = listing_pages(product_table(spark, sf_dir))
    read = frontier.listing_links(listings.select("url", "html"))
    return frontier.walk_listings(seeds(listings), read, 5)


@query(
    f"""
WITH {PLAN_SQL}
SELECT walk, CAST(page_depth AS INTEGER) AS page_depth, CAST(pos AS INTEGER) AS pos, ordinal,
       (ordinal - 1) // 10 AS chunk_id, url FROM plan"""
)
def chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier.frontier(walked(spark, sf_dir), 10)


@query(
    f"""
WITH {PLAN_SQL}
SELECT walk, 'chunked' AS mode, count(DISTINCT page_depth) AS pages_scanned,
       count(*) AS books_dispatched, CAST(ceil(count(*) / 7) AS BIGINT) AS chunks,
       CAST(7 AS INTEGER) AS chunk_size, true AS webhook_attached
FROM plan GROUP BY walk"""
)
def dispatch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    visited = walked(spark, sf_dir)
    urls = frontier.frontier(visited, 7)
    return frontier.dispatch_summary(urls, visited, 7, callback=True)


# --- whole runs ---------------------------------------------------------------------------


def run_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Requests from events over product pages; some pages have no body or no title."""
    requests = visits(spark, sf_dir).select(
        text_of(f"{SITE}/p/", F.col("user_id"), ".html").alias("url"),
        (F.col("event_type") == "signup").alias("force"),
        F.lit(False).alias("use_ai"),
        F.col("arrived_at").cast("timestamp").alias("arrived_at"),
        "seq",
    )
    pages = css_pages(product_table(spark, sf_dir))
    last_digit = F.regexp_extract("url", r"(\d)\.html$", 1)
    html = (
        F.when(last_digit == "0", "")
        .when(last_digit == "1", "<p>nothing here</p>")
        .otherwise(F.col("html"))
    )
    return requests, pages.select("url", html.alias("html"))


RUN_SQL = f"""
asked AS (
  SELECT event_id AS seq, ts, concat('{SITE}/p/', user_id, '.html') AS url, user_id,
         event_type = 'signup' AS force, user_id % 10 <> 0 AS fetched, user_id % 10 > 1 AS parsed,
         CASE WHEN user_id % 10 > 1 THEN concat(p_name, ' ', p_partkey) END AS title,
         CASE WHEN user_id % 10 > 1 THEN p_retailprice END AS price
  FROM events JOIN part ON p_partkey = user_id),
marked AS (
  SELECT *, min(CASE WHEN fetched AND (NOT force OR parsed) THEN seq END)
            OVER (PARTITION BY url) AS first_mark FROM asked),
stated AS (
  SELECT seq, url, CASE
    WHEN NOT force AND user_id % 10 = 7 THEN 'skipped_duplicate'
    WHEN NOT force AND seq > first_mark THEN 'skipped_duplicate'
    WHEN NOT fetched THEN 'fetch_failed' WHEN NOT parsed THEN 'parse_failed' ELSE 'ok' END AS status,
    title, price FROM marked)"""


def seen_sevens(requests: DataFrame) -> DataFrame:
    return dedup.with_key(requests.filter(F.rlike("url", F.lit("7\\.html$")))).select(
        "url_key", F.lit("2023-01-01").cast("timestamp").alias("seen_at")
    )


@query(
    f"""
WITH {RUN_SQL}
SELECT seq, url, status, CASE WHEN status = 'ok' THEN title END AS title,
       CASE WHEN status = 'ok' THEN price END AS price FROM stated"""
)
def scrape_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests, pages = run_inputs(spark, sf_dir)
    run = scrape(requests, pages, NO_EXPIRY, seen=seen_sevens(requests))
    return run.outcome.select("seq", "url", "status", "title", "price")


@query(
    f"""
WITH {RUN_SQL.replace("p_partkey = user_id)", "p_partkey = user_id WHERE event_type = 'purchase' AND value > 150)")}
SELECT seq, url, status, CASE WHEN status = 'ok' THEN title END AS title FROM stated"""
)
def scrape_run_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few requests over all pages: those of large purchases; the other pages are not parsed."""
    requests, pages = run_inputs(spark, sf_dir)
    large = visits(spark, sf_dir).filter("event_type = 'purchase' AND value > 150").select("seq")
    run = scrape(requests.join(large, "seq", "left_semi"), pages, NO_EXPIRY, seen=seen_sevens(requests))
    return run.outcome.select("seq", "url", "status", "title")


@query(
    f"""
WITH {RUN_SQL}
SELECT seq, url, '{U_HOST}' AS host, 0.25::DOUBLE AS delay_sec,
       (row_number() OVER (ORDER BY seq) - 1) * 0.25::DOUBLE AS start_after_sec
FROM stated WHERE status <> 'skipped_duplicate'"""
)
def scrape_run_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each fetch of a run may start, by the delays of its settings."""
    requests, pages = run_inputs(spark, sf_dir)
    settings = Settings(dedup_ttl_sec=None, domain_delays=f"other.example:9,{U_HOST}:0.25")
    run = scrape(requests, pages, settings, seen=seen_sevens(requests))
    return run.fetch_plan().select("seq", "url", "host", "delay_sec", "start_after_sec")


@query(
    f"""
WITH RECURSIVE {RUN_SQL},
o AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ts, seq) AS rn FROM asked),
walk AS (
  SELECT url, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS seq, '' AS status,
         CASE WHEN any_value(user_id) % 10 = 7 THEN TIMESTAMP '2023-12-31 20:00:00' END AS mark
  FROM o GROUP BY url
  UNION ALL
  SELECT o.url, o.rn, o.seq,
         CASE WHEN NOT o.force AND coalesce(o.ts <= w.mark + INTERVAL 1 DAY, false)
              THEN 'skipped_duplicate'
              WHEN NOT o.fetched THEN 'fetch_failed' WHEN NOT o.parsed THEN 'parse_failed' ELSE 'ok' END,
         CASE WHEN o.fetched AND (o.parsed OR NOT o.force)
                   AND (o.force OR NOT coalesce(o.ts <= w.mark + INTERVAL 1 DAY, false))
              THEN o.ts ELSE w.mark END
  FROM walk w JOIN o ON o.url = w.url AND o.rn = w.rn + 1)
SELECT seq, url, status FROM walk WHERE rn > 0"""
)
def scrape_run_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks expire after a day, those of earlier runs too; each page lies there twice."""
    requests, pages = run_inputs(spark, sf_dir)
    seen = seen_sevens(requests).withColumn("seen_at", F.lit("2023-12-31 20:00:00").cast("timestamp"))
    run = scrape(requests, pages.unionByName(pages), Settings(dedup_ttl_sec=86_400), seen=seen)
    return run.outcome.select("seq", "url", "status")


@query(
    f"""
WITH {RUN_SQL.replace("user_id % 10 <> 0 AS fetched, user_id % 10 > 1 AS parsed",
    "user_id % 10 <> 0 AND NOT CAST(user_id AS VARCHAR) LIKE '1%' AS fetched, "
    "user_id % 10 > 1 AND NOT CAST(user_id AS VARCHAR) LIKE '1%' AS parsed")}
SELECT seq, url, status FROM stated"""
)
def scrape_run_robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The site's rules deny every product whose number starts with 1."""
    requests, pages = run_inputs(spark, sf_dir)
    files = spark.createDataFrame(
        [(U_HOST, 200, "User-agent: *\nDisallow: /p/1\n")], "host string, status int, body string"
    )
    run = scrape(requests, pages, NO_EXPIRY, seen=seen_sevens(requests), robots=robots.default_rules(files))
    return run.outcome.select("seq", "url", "status")


@query(
    f"""
WITH RECURSIVE {VISIT_SQL},
o AS (SELECT url, ts, seq, event_type AS content,
             row_number() OVER (PARTITION BY url ORDER BY ts, seq) AS rn
      FROM visits WHERE event_type <> 'view'),
walk AS (
  SELECT url, rn, seq, content, ts AS set_at, true AS changed FROM o WHERE rn = 1
  UNION ALL
  SELECT o.url, o.rn, o.seq, o.content,
         CASE WHEN o.content <> w.content OR o.ts > w.set_at + INTERVAL 7 DAY THEN o.ts ELSE w.set_at END,
         o.content <> w.content OR o.ts > w.set_at + INTERVAL 7 DAY
  FROM walk w JOIN o ON o.url = w.url AND o.rn = w.rn + 1)
SELECT v.seq, v.url, CASE WHEN v.event_type = 'view' THEN 'fetch_failed'
       WHEN NOT w.changed THEN 'skipped_unchanged' WHEN v.event_type = 'error' THEN 'parse_failed'
       ELSE 'updated' END AS status
FROM visits v LEFT JOIN walk w ON w.url = v.url AND w.seq = v.seq"""
)
def incremental_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each visit fetches its own version of the page, a minute later; versions lie there twice."""
    rows = visits(spark, sf_dir).withColumn("arrived_at", F.col("arrived_at").cast("timestamp"))
    kind = F.col("event_type")
    html = F.when(kind == "view", "").when(kind == "error", "<p>no title</p>").otherwise(
        text_of("<h1>", kind, "</h1>")
    )
    pages = rows.select("url", html.alias("html"), F.col("arrived_at").alias("fetched_at"), "seq")
    requests = rows.select(
        "url", F.lit(False).alias("force"), F.lit(False).alias("use_ai"), "arrived_at", "seq"
    )
    run = scrape(requests, pages.unionByName(pages), Settings(incremental=True))
    return run.outcome.select("seq", "url", "status")


@query(
    """
SELECT doc_id, CASE WHEN text IS NULL THEN 'title is missing' WHEN n_chars % 7 = 0 THEN 'price is missing'
       WHEN length(text) > 512 THEN 'title is longer than 512'
       WHEN length(source) * 30 > 128 THEN 'availability is longer than 128' END AS defect
FROM documents"""
)
def item_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as item rows: which the item table would refuse, and why."""
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        text_of(f"{SITE}/d/", F.col("doc_id")).alias("url"),
        F.col("text").alias("title"),
        F.when(F.col("n_chars") % 7 != 0, 1.0).alias("price"),
        F.repeat("source", 30).alias("availability"),
    )
    return rows.select("doc_id", item_defect().alias("defect"))


@query(
    f"""
WITH {RUN_SQL},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY url, fetched AND NOT force ORDER BY seq) AS nth
  FROM marked)
SELECT seq, url, CASE WHEN NOT fetched THEN 'fetch_failed'
    WHEN NOT force AND (nth > 1 OR user_id % 10 = 7) THEN 'skipped_unchanged'
    WHEN NOT parsed THEN 'parse_failed' ELSE 'updated' END AS status
FROM ranked"""
)
def incremental_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests, pages = run_inputs(spark, sf_dir)
    stored = dedup.with_key(pages.filter(F.rlike("url", F.lit("7\\.html$")))).select(
        "url_key",
        U.content_sha1("html").alias("content_sha1"),
        F.lit("2023-12-31").cast("timestamp").alias("set_at"),
    )
    settings = Settings(incremental=True, content_hash_ttl_sec=None)
    run = scrape(requests, pages, settings, stored_hashes=stored)
    return run.outcome.select("seq", "url", "status")


@query(
    f"""
WITH {RUN_SQL},
ranked AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ts, seq) AS nth FROM asked)
SELECT seq, CASE WHEN nth > 1 THEN 'skip(dup)' WHEN NOT fetched THEN 'fetch_failed'
    WHEN NOT parsed THEN 'parse_failed'
    ELSE concat('ok: ', left(title, 40), ' (£', CAST(price AS VARCHAR), ')') END AS line
FROM ranked"""
)
def local_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests, pages = run_inputs(spark, sf_dir)
    return run_batch(requests.select("url", "arrived_at", "seq"), pages).select("seq", "line")


@query(
    f"""
WITH {PLAN_SQL}
SELECT url, row_number() OVER (ORDER BY walk, ordinal) AS seq,
       CASE WHEN p_partkey % 10 = 0 THEN 'fetch_failed' WHEN p_partkey % 10 = 1 THEN 'parse_failed'
            ELSE 'ok' END AS status,
       CASE WHEN p_partkey % 10 > 1 THEN p_retailprice END AS price
FROM plan"""
)
def catalog_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    listings = listing_pages(product_table(spark, sf_dir))
    _, pages = run_inputs(spark, sf_dir)
    crawl = crawl_catalog(seeds(listings), listings.select("url", "html"), pages, NO_EXPIRY)
    return crawl.run.outcome.select("url", "seq", "status", "price")


@query(
    f"""
WITH {PLAN_SQL}
SELECT concat('{{"event":"scraping_completed","meta":{{"pages_scanned":',
              (SELECT count(*) FROM walks), ',"books_dispatched":', count(*),
              ',"ai_used":true}},"total_processed":', count(*), ',"successful_inserts":',
              count(*) FILTER (p_partkey % 2 = 0), '}}') AS payload
FROM plan"""
)
def completion_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl whose products are read by model replies; every second reply is unusable."""
    parts = product_table(spark, sf_dir)
    listings = listing_pages(parts)
    answer = text_of('{"title": "', F.col("p_name"), '"}')
    reply = F.when(F.col("p_partkey") % 2 == 0, answer).otherwise("[]")
    replies = parts.select(product_url().alias("url"), reply.alias("reply"))
    crawl = crawl_catalog(
        seeds(listings), listings.select("url", "html"), css_pages(parts), NO_EXPIRY, use_ai=True,
        replies=replies,
    )
    return crawl.event(use_ai=True)


@query(
    f"""
WITH {PLAN_SQL},
gated AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY walk, ordinal) AS nth FROM plan),
stored AS (
  SELECT row_number() OVER (ORDER BY walk, ordinal) AS id, url, concat(p_name, ' ', p_partkey) AS title,
         p_retailprice AS price
  FROM gated WHERE nth = 1 AND p_partkey % 10 > 1)
SELECT 'item' AS kind, id, url, title, price, 0 AS n FROM stored
UNION ALL
SELECT CASE WHEN nth > 1 THEN 'skipped_duplicate' WHEN p_partkey % 10 = 0 THEN 'fetch_failed'
            WHEN p_partkey % 10 = 1 THEN 'parse_failed' ELSE 'ok' END, 0, '', '', 0.0, count(*)
FROM gated GROUP BY 1"""
)
def local_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole plain run: listings, gate, extraction, item table and tally."""
    listings = listing_pages(product_table(spark, sf_dir))
    _, pages = run_inputs(spark, sf_dir)
    store = ItemStore(spark, f"{scratch(spark)}/items")
    run = run_site(seeds(listings), listings.select("url", "html"), pages, store, 0)
    items = store.current().select(
        F.lit("item").alias("kind"), "id", "url", "title", "price", F.lit(0).cast("long").alias("n")
    )
    blank = [F.lit(0).cast("long").alias("id"), F.lit("").alias("url"), F.lit("").alias("title")]
    return items.unionByName(
        run.tally.select(F.col("status").alias("kind"), *blank, F.lit(0.0).alias("price"), "n")
    )


# --- numbers about runs -------------------------------------------------------------------


def event_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    status = (
        F.when(kind == "view", "ok")
        .when(kind == "click", "updated")
        .when(kind == "error", "fetch_failed")
        .when(kind == "signup", "parse_failed")
        .otherwise("skipped_duplicate")
    )
    return visits(spark, sf_dir).select("url", status.alias("status"))


@query(
    """
SELECT CASE event_type WHEN 'view' THEN 'ok' WHEN 'click' THEN 'updated'
       WHEN 'error' THEN 'fetch_failed' WHEN 'signup' THEN 'parse_failed'
       ELSE 'skipped_duplicate' END AS status, count(*) AS n
FROM events GROUP BY event_type"""
)
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.status_counts(event_results(spark, sf_dir))


METRIC_SQL = """
snap AS (
  SELECT 0 AS nth, 'pagemill_pages_processed_total' AS name, 'counter' AS type,
         'Pages turned into items' AS help,
         count(*) FILTER (event_type IN ('view', 'click')) + 5 AS value FROM events
  UNION ALL SELECT 1, 'pagemill_failed_fetch_total', 'counter', 'Fetches that gave no page',
         count(*) FILTER (event_type = 'error') FROM events
  UNION ALL SELECT 2, 'pagemill_dead_letter_depth', 'gauge', 'Tasks in the dead-letter table',
         count(*) FILTER (event_type = 'error') FROM events
  UNION ALL SELECT 3, 'pagemill_db_items', 'gauge', 'Items in the table',
         count(DISTINCT user_id) FROM events)"""


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = event_results(spark, sf_dir)
    earlier = spark.createDataFrame(
        [("pages_processed", 5), ("no_such_counter", 9)], "name string, amount long"
    )
    log = report.counter_increments(results).unionByName(earlier)
    failed = results.filter("status = 'fetch_failed'")
    return report.metrics_snapshot(log, failed, results.select("url").distinct())


@query(f"WITH {METRIC_SQL} SELECT name, type, help, value FROM snap")
def metrics_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot(spark, sf_dir)


@query(
    f"""
WITH {METRIC_SQL}
SELECT CAST(nth * 3 + 1 AS INTEGER) AS line_no, concat('# HELP ', name, ' ', help) AS line FROM snap
UNION ALL SELECT CAST(nth * 3 + 2 AS INTEGER), concat('# TYPE ', name, ' ', type) FROM snap
UNION ALL SELECT CAST(nth * 3 + 3 AS INTEGER), concat(name, ' ', value) FROM snap"""
)
def metrics_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.metrics_text(snapshot(spark, sf_dir))


# --- streams ------------------------------------------------------------------------------


def scratch(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/pagemill-{uuid4().hex}"


#: Landed rows are streamed in so many micro-batches, and a file has about so many rows.
SLICES, FILE_ROWS = 3, 1_000_000


def land(rows: DataFrame, ts: str, path: str) -> DataFrame:
    """Land rows in slices of time, and stream them slice by slice.

    The bounds come from the data, so that slices have about as many rows, and as many files, each;
    rows without a time are in the first.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    shares = F.array(*[F.lit(n / SLICES) for n in range(1, SLICES)])
    bounds, n = rows.agg(F.percentile_approx(at, shares), F.count("*")).first()
    files = 1 + n // (SLICES * FILE_ROWS)
    reached = F.filter(F.array(*map(F.lit, bounds or [])), lambda x: F.coalesce(x <= at, F.lit(False)))
    for slice_no in range(SLICES):
        rows.filter(F.size(reached) == slice_no).repartition(files).write.mode("append").parquet(path)
    ddl = ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in rows.schema)
    return stream_table(rows.sparkSession, path, ddl, files_per_trigger=files)


def streamed_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = land(table(spark, sf_dir, "events"), "ts", f"{scratch(spark)}/events")
    return events.select(
        text_of(f"{SITE}/u/", F.col("user_id")).alias("url"),
        F.col("ts").alias("arrived_at"),
        F.col("event_id").alias("seq"),
        "event_type",
        "value",
        "props",
    )


#: Seconds without an attempt that end a crawl, and by which landed slices may overlap.
DAY, LATE = 86_400, 100 * 86_400


def land_log(log: DataFrame, path: str) -> DataFrame:
    """Land a fetch log, and behind it a row of no attempt that lets the last crawls end."""
    stateful.use_rocksdb(log.sparkSession)
    # The numbers of the attempts cost a shuffle, and every slice reads the log.
    log = cut(log)
    stream = land(log, "attempted_at", path)
    end = log.agg(F.max("attempted_at").alias("at")).select((F.col("at") + F.make_dt_interval(F.lit(2 * LATE // DAY))).alias("attempted_at"))
    tick = end.withColumns({"url": F.lit(""), "attempt": F.lit(0)})
    log.limit(0).unionByName(tick, allowMissingColumns=True).coalesce(1).write.mode("append").parquet(path)
    return stream


def finish(writer, folder: str) -> None:
    running = writer.option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True)
    started = running.start()
    started.awaitTermination()
    if started.exception() is not None:
        raise started.exception()


@query(f"WITH {VISIT_SQL} SELECT url_key, min(seq) AS seq FROM visits GROUP BY url_key")
def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark)
    seen = CrawlStore(spark, folder).seen
    passed = BatchTable(
        spark, f"{folder}/passed", "url_key string, arrived_at timestamp_ntz, seq long"
    )
    keyed = dedup.with_key(streamed_visits(spark, sf_dir))
    finish(seen_stream.first_seen_stream(keyed, seen, passed), folder)
    return passed.read().select("url_key", "seq")


@query(TTL_SQL)
def stream_ttl_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    stateful.use_rocksdb(spark)
    folder = scratch(spark)
    keyed = dedup.with_key(streamed_visits(spark, sf_dir))
    accepted = stateful.ttl_first_seen_stream(keyed, 86_400)
    finish(accepted.writeStream.format("parquet").option("path", f"{folder}/out"), folder)
    return spark.read.schema(accepted.schema).parquet(f"{folder}/out").select("url_key", "seq")


@query(TTL_SQL)
def stream_ttl_first_seen_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark)
    seen = CrawlStore(spark, folder).seen
    passed = BatchTable(
        spark, f"{folder}/passed", "url_key string, arrived_at timestamp_ntz, seq long"
    )
    keyed = dedup.with_key(streamed_visits(spark, sf_dir))
    finish(seen_stream.first_seen_stream(keyed, seen, passed, ttl_sec=86_400), folder)
    return passed.read().select("url_key", "seq")


@query(CHANGED_TTL_SQL)
def stream_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    stateful.use_rocksdb(spark)
    folder = scratch(spark)
    rows = dedup.with_key(streamed_visits(spark, sf_dir)).select(
        "url_key",
        repeated_hash(),
        F.col("arrived_at").alias("fetched_at"),
        "seq",
    )
    flagged = stateful.content_changed_stream(rows, 86_400)
    finish(flagged.writeStream.format("parquet").option("path", f"{folder}/out"), folder)
    return spark.read.schema(flagged.schema).parquet(f"{folder}/out").drop("fetched_at")


@query(CHANGED_TTL_SQL)
def stream_changed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark)
    rows = dedup.with_key(streamed_visits(spark, sf_dir)).select(
        "url_key", repeated_hash(), F.col("arrived_at").alias("fetched_at"), "seq"
    )
    state = CrawlStore(spark, folder).content_state
    flagged = BatchTable(
        spark, f"{folder}/flagged",
        "url_key string, content_sha1 string, fetched_at timestamp_ntz, seq long, changed boolean",
    )
    finish(seen_stream.changed_stream(rows, state, flagged, ttl_sec=86_400), folder)
    return flagged.read().select("url_key", "seq", "changed")


@query(f"WITH {ITEM_SQL} SELECT id, url, title, price, description FROM numbered")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark)
    rows = streamed_visits(spark, sf_dir).select(
        "url",
        F.col("event_type").alias("title"),
        F.col("value").alias("price"),
        F.lit("unknown").alias("availability"),
        F.lit(0).alias("rating"),
        F.col("props").alias("description"),
        F.col("arrived_at").cast("timestamp").alias("fetched_at"),
        "seq",
    )
    store = ItemStore(spark, f"{folder}/items")
    finish(routing.upsert_stream(rows, store), folder)
    return store.current().select("id", "url", "title", "price", "description")


@query(
    f"""
WITH {VISIT_SQL}, landed AS (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY ts, seq) AS nth FROM visits),
marked AS (
  SELECT *, min(CASE WHEN event_type <> 'error' THEN nth END) OVER (PARTITION BY url) AS first FROM landed)
SELECT url, CASE WHEN nth > first THEN 'skipped_duplicate' WHEN event_type = 'view' THEN 'parse_failed'
       ELSE 'ok' END AS status, count(*) AS n
FROM marked WHERE nth >= first GROUP BY ALL"""
)
def stream_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark)
    kind = F.col("event_type")
    body = F.when(kind == "error", "").when(kind == "view", "<p>no title</p>").otherwise(
        text_of("<h1>", kind, "</h1>")
    )
    rows = streamed_visits(spark, sf_dir).select(
        "url",
        body.alias("html"),
        F.lit(False).alias("force"),
        F.lit(False).alias("use_ai"),
        F.col("arrived_at").cast("timestamp").alias("arrived_at"),
        "seq",
    )
    store = CrawlStore(spark, f"{folder}/store")
    finish(routing.routed_stream(rows, store, NO_EXPIRY), folder)
    return store.results.read().groupBy("url", "status").agg(F.count("*").alias("n"))


@query(
    f"""
WITH {ATTEMPT_SQL}
SELECT 'pagemill.scrape' AS task, url, concat('FetchError(''Fetch failed: ', url, ''')') AS error
FROM outcomes WHERE outcome = 'failed'"""
)
def stream_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts land as files and are streamed; crawls without a page end as dead letters."""
    folder = scratch(spark)
    store = CrawlStore(spark, f"{folder}/store")
    stream = land_log(attempts(spark, sf_dir), f"{folder}/log")
    finish(routing.attempts_stream(stream, store, NO_EXPIRY, DAY, LATE), folder)
    return store.dead_letters.read().select("task", "url", "error")


@query(
    f"""
WITH {ATTEMPT_SQL}
SELECT regexp_replace(o.url, '/[^/]*$', '') AS url, a.seq, o.attempts, o.html
FROM outcomes o JOIN attempts a ON a.url = o.url AND a.attempt = 1"""
)
def stream_recrawl_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A URL per user, crawled anew every day: each crawl has an outcome of its own."""
    folder = scratch(spark)
    log = attempts(spark, sf_dir).withColumn("url", F.regexp_replace("url", "/[^/]*$", ""))
    crawls = crawls_stream(land_log(log, f"{folder}/log"), 3, DAY, LATE)
    finish(crawls.writeStream.format("parquet").option("path", f"{folder}/out"), folder)
    return spark.read.schema(crawls.schema).parquet(f"{folder}/out").drop("arrived_at")
