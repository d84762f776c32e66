"""Table schemas as DDL, and the row checks the item table demands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAGES = "url string, html string, fetched_at timestamp, seq long"
REQUESTS = "url string, force boolean, use_ai boolean, arrived_at timestamp, seq long"
FETCH_LOG = (
    "url string, attempt int, status int, error string, body string, attempted_at timestamp"
)
SEEN = "url_key string, seen_at timestamp"
CONTENT_STATE = "url_key string, content_sha1 string, set_at timestamp"
ITEMS = (
    "id long, title string, price double, availability string, rating int, url string, "
    "description string"
)
RESULTS = "url string, status string, title string, price double"
DEAD_LETTER = (
    "task string, task_id string, args array<string>, error string, url string, "
    "failed_at timestamp"
)
REPLIES = "url string, reply string"
ROBOTS_FILES = "host string, status int, body string"
METRICS = "name string, type string, help string, value long"

# What a page looks like once its HTML has been read. `i` numbers elements and texts in document
# order and `e` is the first number past an element's end, so "inside" is an interval test.
# `p` is the parent's number and `k` the position among the parent's child elements.
# `cls` holds the class names separated and surrounded by one space.
ELEMENTS = (
    "array<struct<i:int,e:int,p:int,k:int,tag:string,cls:string,attrs:map<string,string>>>"
)
TEXTS = "array<struct<i:int,s:string>>"
LD = "array<string>"

ITEM_FIELDS = ("title", "price", "availability", "rating", "description")

# Column widths of the item table.
MAX_LENGTHS = {"title": 512, "availability": 128, "url": 1024}


def item_defect() -> Column:
    """Why an item row may not enter the table, or null for a good row."""
    checks = [
        F.when(F.length(name) > limit, F.lit(f"{name} is longer than {limit}"))
        for name, limit in MAX_LENGTHS.items()
    ]
    missing = [
        F.when(F.col(name).isNull(), F.lit(f"{name} is missing"))
        for name in ("url", "title", "price")
    ]
    return F.coalesce(*missing, *checks)
