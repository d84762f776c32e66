"""Main text of web pages, with a host suffix array of what pages repeat.

Pages are cut into blocks. What is inside the article is the article's, also where it repeats;
what is marked as page furniture (menus, adverts, footers, ...) by its tag or by a whole known name in
class, id or role goes, unless it holds most of the main run. Names that a subject may also have
(a restaurant's menu, an article on search) are only a doubt inside an article: such an element
goes if links make up most of its text, and is otherwise judged by repetition. So is the rest of
the page: the token streams of a host's pages, without what is surely their articles', are put
together, and substrings of `DEPTH` tokens or more that occur on a `SHARE` of its pages, and on
`LEAST_PAGES` or most of a small host's, are boilerplate.

The suffix array is truncated at DEPTH tokens, where it already tells which suffixes agree so far,
and it is made by grouping equal truncated suffixes of a host instead of sorting them: a group is a
run of neighbours in the array whose common prefix is DEPTH or longer, and it is boilerplate if it is
on enough of the host's pages: a few copies of an article are not. That is a partial aggregate, so neither a hot host nor a menu on
every page meets in one task. A block is boilerplate when repeated substrings cover at least
`COVERED` of its tokens; unique runs stay. Groups go back only to pages that have blocks to be
judged, by (host, suffix), and each page gets its own suffixes, never its host's.

Pages are read twice; the HTML itself is not shuffled unless many pages have blocks to be judged.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import Memo, map_batches
from pagemill.session import cut

DEPTH, COVERED = 8, 0.6
#: Boilerplate is on this share of the host's pages and on so many of them, or on more than half of a small host.
SHARE, LEAST_PAGES = 0.05, 5

# Elements of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript iframe object svg math canvas audio video select option datalist button textarea title".split())
FURNITURE = frozenset("nav footer aside form dialog menu".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr input".split()
)
SCOPE = frozenset("article main".split())
# Names in class, id and role of furniture, each a whole name in lower case with hyphens.
# FIRM ones may be longer than the article; the others are also given to wrappers of whole pages.
FIRM = frozenset(
    "ad ads advert adverts advertisement advertisements ad-slot ad-container ad-wrapper ad-unit ad-banner ad-box sponsor sponsored "
    "breadcrumb breadcrumbs pagination pager cookie-banner cookie-consent cookie-notice cookies gdpr "
    "comments commentlist comment-list comments-area comments-section comment-form comment-respond disqus disqus-thread".split()
)
MARKS = FIRM | frozenset(
    "nav navbar navigation main-nav main-navigation site-nav site-navigation primary-nav nav-menu nav-bar nav-links "
    "menu menus main-menu menu-list menu-item banner banners toolbar topbar footer site-footer page-footer main-footer "
    "sidebar sidebars side-bar left-sidebar right-sidebar sidebar-left sidebar-right complementary contentinfo widget widgets "
    "widget-area cookie consent popup modal overlay newsletter newsletter-signup subscribe signup login login-form search "
    "search-form search-box promo comment respond share sharing share-buttons share-links social social-links social-share "
    "social-media related related-posts related-articles related-links recommended recommended-articles recommendations "
    "skip skip-link skip-links masthead".split()
)
# An id is often the subject of a section ("search", "modal"), so only these count there.
IDS = FIRM | frozenset(
    "navbar main-nav main-navigation site-nav site-navigation primary-nav nav-menu nav-bar main-menu topbar footer site-footer page-footer "
    "main-footer sidebar sidebars side-bar left-sidebar right-sidebar sidebar-left sidebar-right newsletter-signup login-form "
    "search-form search-box share-buttons social-links social-share related-posts related-articles masthead".split()
)
# Names that may as well be the subject of a part of an article.
DOUBTFUL = frozenset(
    "menu menus menu-list menu-item search search-box login signup modal overlay banner banners widget widgets cookie consent "
    "navigation toolbar share sharing social respond skip".split()
)
# Names of what readers wrote, where they are inside an article.
READERS = frozenset("comment reader-comment user-comment comment-body comment-content".split())
MARK_OUTSIDE = frozenset("header head site-header main-header".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# How far into the main run an element leads.
MAIN, ARTICLE, BODY = 1, 2, 3

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
# One attribute with its value, so that no name is looked for inside a value.
ATTRIBUTE = re.compile(r"([^\s\"'>/=][^\s>/=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAMED = frozenset("class id role itemprop hidden aria-hidden style".split())
WORD_ENDS = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Block:
    """A run of text between block-level tags."""

    text: str
    article: bool
    furniture: bool
    doubtful: bool = False  # inside an article, and only repetition can tell whether it is its own
    links: int = 0  # characters inside links, without white space


@dataclass
class Mark:
    """An element marked as furniture: what it holds decides whether that can be so."""

    parent: int  # the mark around it, or -1
    firm: bool
    doubtful: bool
    level: int  # of the main run around it
    deepest: int  # of the main run in it
    chars: int = 0  # of the main run
    solid: int = 0  # characters without white space, and of these the ones in links
    links: int = 0


def _names(value: str) -> set[str]:
    return {"-".join(filter(None, WORD_ENDS.split(x))).lower() for x in value.split()}


def _role(name: str, attributes: str, inside: bool) -> tuple[bool, bool, bool, int, bool]:
    """(unseen, furniture, firmly so, level, doubtful) of an element; `inside` an article its header is its own."""
    unseen, level = name in UNSEEN, {"main": MAIN, "article": ARTICLE}.get(name, 0)
    furniture = name in FURNITURE or (name == "header" and not inside)
    firm = furniture and name not in ("form", "header")
    certain = furniture
    named = name not in HEADINGS
    for match in ATTRIBUTE.finditer(attributes):
        key, value = match[1].lower(), match[2] or match[3] or match[4] or ""
        if key not in NAMED:
            continue
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            unseen = True
        elif key == "style":
            unseen = unseen or HIDDEN.search(value) is not None
        elif key == "itemprop":
            level = max(level, BODY * (value.lower() == "articlebody"))
        elif key == "role" and value.lower() in ("main", "article"):
            level = max(level, MAIN if value.lower() == "main" else ARTICLE)
        elif key != "aria-hidden" and named:
            found = _names(value)
            marks = found & (IDS if key == "id" else MARKS)
            if not inside:
                marks |= found & MARK_OUTSIDE
            elif key != "id":
                marks |= found & READERS
            furniture = furniture or bool(marks)
            certain = certain or not inside or bool(marks - DOUBTFUL)
            firm = firm or bool(found & FIRM) or (inside and bool(marks & READERS))
    if name in ("html", "body"):
        return False, False, False, level, False
    if level == MAIN:
        furniture = firm = False
    return unseen, furniture, firm, level, furniture and not certain


def _unmark(blocks: list[Block], within: list[int], marks: list[Mark]) -> None:
    """Set `furniture` and `doubtful`: an element with most of the main run, or of a page without one, is no furniture.

    One that is firmly marked is, unless a further part of the main run begins in it. `within` is
    the innermost mark around a block, or -1; a mark comes behind the one around it.
    """
    scoped = any(x.article for x in blocks)
    total = 0
    for block, i in zip(blocks, within, strict=True):
        size = len(block.text) if block.article or not scoped else 0
        total += size
        if i >= 0:
            marks[i].chars += size
            marks[i].solid += len(block.text) - block.text.count(" ")
            marks[i].links += block.links
    for mark in reversed(marks):
        if mark.parent >= 0:
            around = marks[mark.parent]
            around.chars += mark.chars
            around.solid += mark.solid
            around.links += mark.links
            around.deepest = max(around.deepest, mark.deepest)
    fates: list[tuple[bool, bool]] = []
    for mark in marks:
        gone, doubted = fates[mark.parent] if mark.parent >= 0 else (False, False)
        real = 2 * mark.chars <= total or (mark.firm and mark.deepest <= mark.level)
        unsure = mark.doubtful and 2 * mark.links <= mark.solid
        fates.append((gone or (real and not unsure), doubted or (real and unsure)))
    for block, i in zip(blocks, within, strict=True):
        if i >= 0:
            block.furniture, block.doubtful = fates[i]


def blocks_of(source: str | None) -> list[Block]:
    """The visible blocks of a page, in order, with character references decoded."""
    source = source or ""
    lower: str | None = None
    open_tags: list[tuple[str, int, int, int]] = []  # name, and what was in force before it
    opened: Counter[str] = Counter()  # how many of each name are open, so that a stray end tag costs nothing
    unseen = level = links = 0
    furniture, linked = -1, False
    marked: list[Mark] = []
    within: list[int] = []
    out: list[Block] = []
    parts: list[str] = []

    def end() -> None:
        nonlocal links
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            out.append(Block(text, level > 0, False, links=links))
            within.append(furniture)
        links = 0

    at, size = 0, len(source)
    while at < size:
        match = TAG.search(source, at)
        stop = match.start() if match else size
        if stop > at and not unseen:
            data = source[at:stop]
            parts.append(html.unescape(data) if "&" in data else data)
            if linked:
                links += sum(map(len, parts[-1].split()))
        if not match:
            break
        at = match.end()
        close, name, attributes = (match[1], match[2], match[3]) if match[2] else (match[4], match[5], match[6])
        if not name:
            continue
        name = name.lower()
        if name == "br" or name == "wbr":
            if name == "br" and not unseen:
                parts.append(" ")
            continue
        if name == "a":
            linked = not close
        if name not in INLINE:
            end()
        if close:
            while opened[name]:
                last, unseen, furniture, level = open_tags.pop()
                opened[last] -= 1
                if last == name:
                    break
            continue
        if name in VOID or attributes.endswith("/") and name not in RAW and name not in SCOPE and name not in FURNITURE:
            continue
        marks = _role(name, attributes, level > 0) if attributes or name not in INLINE else (False, False, False, 0, False)
        if name in INLINE and not any(marks):
            continue
        if name in INLINE:
            end()
        if name in ("p", "li", "td", "th", "tr", "dt", "dd", "option") and open_tags and open_tags[-1][0] == name:
            _, unseen, furniture, level = open_tags.pop()
            opened[name] -= 1
        open_tags.append((name, unseen, furniture, level))
        opened[name] += 1
        if marks[3] and furniture >= 0:
            marked[furniture].deepest = max(marked[furniture].deepest, marks[3])
        if marks[1]:
            marked.append(Mark(furniture, marks[2], marks[4], level, level))
            furniture = len(marked) - 1
        unseen, level = unseen + marks[0], max(level, marks[3])
        if name in RAW:
            lower = source.lower() if lower is None else lower
            stop = lower.find("</" + name, at) if len(lower) == size else source.find("</" + name, at)
            at = size if stop < 0 else stop
    end()
    _unmark(out, within, marked)
    return out


def kinds(blocks: list[Block]) -> list[str]:
    """article, furniture, or open: what only repetition can tell."""
    return ["furniture" if x.furniture else "article" if x.article and not x.doubtful else "open" for x in blocks]


def suffixes(blocks: list[Block], hasher: Memo) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the truncated suffixes of the page's stream outside what is surely its article's, and each token's block."""
    words, owner = [], []
    for i, (block, kind) in enumerate(zip(blocks, kinds(blocks), strict=True)):
        if kind != "article":
            own = block.text.split(" ")
            words += own
            owner += [i] * len(own)
    if len(words) < DEPTH:
        return np.zeros(0, np.int64), np.array(owner, np.int64)
    codes = np.array([hasher[x] for x in words], np.uint64)
    found = np.zeros(len(codes) - DEPTH + 1, np.uint64)
    for i in range(DEPTH):
        found = (found ^ codes[i : i + len(found)]) * np.uint64(0x9FB21C651E98DF25)
        found ^= found >> np.uint64(31)
    return found.view(np.int64), np.array(owner, np.int64)


def covered(blocks: list[Block], repeated: set[int], hasher: Memo) -> np.ndarray:
    """The share of each block's tokens that repeated substrings cover."""
    found, owner = suffixes(blocks, hasher)
    marked = np.zeros(len(owner) + 1, np.int64)
    for at in np.flatnonzero([x in repeated for x in found.tolist()]).tolist():
        marked[at] += 1
        marked[at + DEPTH] -= 1
    inside = np.cumsum(marked[:-1]) > 0
    total = np.bincount(owner, minlength=len(blocks))
    return np.bincount(owner, inside, len(blocks)) / np.maximum(total, 1)


def main_text(source: str | None, repeated: set[int], hasher: Memo) -> str:
    blocks = blocks_of(source)
    kind = kinds(blocks)
    share = covered(blocks, repeated, hasher) if "open" in kind and repeated else np.zeros(len(blocks))
    kept = [b.text for b, k, s in zip(blocks, kind, share, strict=True) if k == "article" or (k == "open" and s < COVERED)]
    return "\n\n".join(kept)


def _hasher() -> Memo:
    return Memo(lambda word: xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace")), 100_000)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), one row per input row.

    A null or empty page has an empty text. Rows with the same address and HTML are one page for
    the question of repetition. Pages without an address are a host of their own. On a page with
    an article the unique runs outside it stay only if nothing marks them as furniture.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(source).alias("html"))
    key = F.xxhash64("url", "html")

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        hasher, found, judged = _hasher(), [], []
        for body in batch.column(2):
            blocks = blocks_of(body.as_py())
            own, owner = suffixes(blocks, hasher)
            found.append(np.unique(own).tolist())
            open_blocks = [i for i, kind in enumerate(kinds(blocks)) if kind == "open"]
            near = np.isin(owner, open_blocks)
            some = [i for i in range(len(own)) if near[i : i + DEPTH].any()] if open_blocks else []
            judged.append(np.unique(own[some]).tolist())
        lists = [pa.array(x, pa.list_(pa.int64())) for x in (found, judged)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["host", "key", "found", "judged"])

    streams = cut(
        map_batches(
            rows.select(F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), key.alias("key"), "html"),
            read,
            "host string, key long, found array<long>, judged array<long>",
        )
    )
    # Rows with the same address and HTML are one page.
    pages_of = streams.groupBy("key").agg(F.first("host").alias("host"), F.first("found").alias("found"))
    totals = cut(streams.select("host", "key").distinct().groupBy("host").agg(F.count("*").alias("total")))
    shared = (
        pages_of.select("host", F.explode("found").alias("suffix"))
        .groupBy("host", "suffix")
        .agg(F.count("*").alias("pages"))
        .filter(F.col("pages") > 1)
    )
    most = F.least(F.lit(LEAST_PAGES), F.floor(F.col("total") / 2) + 1)
    repeated = (
        shared.join(totals, "host")
        .filter((F.col("pages") >= most) & (F.col("pages") >= SHARE * F.col("total")))
        .select("host", "suffix")
    )
    per_page = cut(
        streams.select("host", "key", F.explode("judged").alias("suffix"))
        .distinct()
        .join(repeated, ["host", "suffix"])
        .groupBy(F.col("key").alias("page_key"))
        .agg(F.collect_list("suffix").alias("repeated"))
    )

    def decide(batch: pa.RecordBatch) -> pa.RecordBatch:
        hasher = _hasher()
        texts = [
            main_text(body.as_py(), set(found.as_py() or ()), hasher)
            for body, found in zip(batch.column(2), batch.column(3), strict=True)
        ]
        arrays = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "text", "n_chars"])

    kind = rows.schema["page_id"].dataType.simpleString()
    joined = rows.withColumn("page_key", key).join(per_page, "page_key", "left").select("page_id", "url", "html", "repeated")
    return map_batches(joined, decide, f"page_id {kind}, url string, text string, n_chars long")
