"""URL keys, hosts and reference resolution as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: every character that counts as white space.
SPACE = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(
    map(chr, [*range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
# Scheme, authority, path, query, fragment; an absent part reads as ''.
_PARTS = (
    r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
)
_HOST = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#]*@)?(?:\[([^\]/?#]*)\]|([^:/?#]*))"


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(text: Column | str) -> Column:
    """Drop white space of any kind at both ends (plain `trim` drops the space only)."""
    return F.btrim(col(text), F.lit(SPACE))


def url_key(url: Column | str) -> Column:
    """SHA-1 of the stripped, lower-cased URL."""
    return F.sha1(F.lower(strip(url)))


def content_sha1(html: Column | str) -> Column:
    return F.sha1(col(html))


def host_of(url: Column | str) -> Column:
    """Lower-case host without user info and port; '' where the URL has none."""
    url = col(url)
    found = F.concat(F.regexp_extract(url, _HOST, 1), F.regexp_extract(url, _HOST, 2))
    return F.lower(F.coalesce(found, F.lit("")))


def path_of(url: Column | str) -> Column:
    """Path with query and fragment, percent-decoded, '/' where empty (robots matching)."""
    plain = percent_decoded(url)
    rest = F.regexp_replace(plain, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", "")
    return F.when(rest == "", F.lit("/")).otherwise(rest)


def percent_decoded(text: Column | str) -> Column:
    text = col(text)
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def resolve_url(base: Column | str, href: Column | str) -> Column:
    """The absolute form of `href` as found on the page `base`.

    A null or empty href is the page itself; another scheme is left alone; dot segments of a
    relative path are folded away.
    """
    href = F.regexp_replace(F.coalesce(col(href), F.lit("")), r"^[\x00-\x20]+|[\t\r\n]", "")
    return bind(F.struct(_split(col(base)).alias("b"), _split(href).alias("h")), _resolved)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with a costly `value` worked out once however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _split(url: Column) -> Column:
    parts = [
        F.regexp_extract(url, _PARTS, group).alias(name)
        for group, name in enumerate(("scheme", "net", "path", "query", "fragment"), 1)
    ]
    return F.struct(url.alias("whole"), *parts)


def _resolved(both: Column) -> Column:
    base, href = both["b"], both["h"]
    scheme = F.lower(base["scheme"])
    same_scheme = (href["scheme"] == "") | (F.lower(href["scheme"]) == scheme)
    own_path = href["path"] != ""
    query = F.when(own_path | (href["query"] != ""), href["query"]).otherwise(base["query"])
    elsewhere = _build(scheme, href["net"], href["path"], href["query"], href["fragment"])
    here = bind(
        F.when(own_path, _join_path(base["path"], href["path"])).otherwise(base["path"]),
        lambda path: _build(scheme, base["net"], path, query, href["fragment"]),
    )
    return (
        F.when(href["whole"] == "", base["whole"])
        .when(~same_scheme, href["whole"])
        .when(href["net"] != "", elsewhere)
        .otherwise(here)
    )


def _build(scheme: Column, net: Column, path: Column, query: Column, fragment: Column) -> Column:
    slash = (net != "") & (path != "") & ~F.startswith(path, F.lit("/"))
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        F.when(net != "", F.concat(F.lit("//"), net)).otherwise(""),
        F.when(slash, F.lit("/")).otherwise(""),
        path,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""),
    )


def _join_path(base: Column, path: Column) -> Column:
    folder = F.regexp_replace(base, r"[^/]*$", "")
    absolute = F.startswith(path, F.lit("/"))
    # Only a relative reference loses the empty segments between the ends.
    raw = F.when(absolute, path).otherwise(
        F.regexp_replace(F.concat(folder, path), "/{2,}", "/")
    )
    dots = F.lit(r"(^|/)\.\.?(/|$)")
    return bind(raw, lambda r: F.when(F.rlike(r, dots), _without_dots(r)).otherwise(r))


def _without_dots(path: Column) -> Column:
    segments = F.split(path, "/")

    def step(done: Column, segment: Column) -> Column:
        return (
            F.when(segment == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
            .when(segment == ".", done)
            .otherwise(F.concat(done, F.array(segment)))
        )

    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    ends_in_dot = F.element_at(segments, -1).isin(".", "..")
    kept = F.when(ends_in_dot, F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    text = F.array_join(kept, "/")
    return F.when(text == "", F.lit("/")).otherwise(text)
