"""URL scalars as column expressions.

The split follows RFC 3986 appendix B rather than ``parse_url``, which raises on malformed input
under ANSI mode.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitemill.constants import DENY_HOSTS, PRIORITY_PATH

SCHEME = r"^([^:/?#]+):"
HOST = r"^(?:[^:/?#]+:)?//([^/?#]*)"
PATH = r"^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)"
BARE_ORIGIN = r"^([^:/?#]+://[^/?#]*)(?=[?#]|$)"
QUERY = r"^[^?#]*\?([^#]*)"
ASSET_SUFFIX = r"(?i)\.(css|js|png|jpg|jpeg|gif|svg|ico|pdf|zip|mp3|mp4)$"
MAX_URL_LENGTH = 500
UTM_PARAMETER = r"(^|&)utm_[^&]*"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, SCHEME, 1))


def host(url: Column) -> Column:
    return F.regexp_extract(url, HOST, 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, PATH, 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, QUERY, 1)


def origin(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), host(url))


def is_origin(url: Column) -> Column:
    """True when the link is its own origin, with or without the closing slash."""
    o = origin(url)
    return (url == o) | (url == F.concat(o, F.lit("/")))


def is_denied(url: Column, deny_hosts: Sequence[str] = DENY_HOSTS) -> Column:
    return host(url).isin(list(deny_hosts)) if deny_hosts else F.lit(False)


def is_priority(url: Column) -> Column:
    return F.lower(path(url)).rlike(PRIORITY_PATH)


def is_good(url: Column, max_length: int | None = MAX_URL_LENGTH) -> Column:
    """Web link to a page: http(s), dotted host, no blanks, not a static asset, and not too long."""
    good = (
        scheme(url).isin("http", "https")
        & host(url).contains(".")
        & ~url.rlike(r"[ \t\r\n]")
        & ~path(url).rlike(ASSET_SUFFIX)
    )
    return good if max_length is None else good & (F.length(url) <= max_length)


def is_too_long(url: Column, max_length: int = MAX_URL_LENGTH) -> Column:
    """Links that the filter drops for their length alone."""
    return is_good(url, None) & (F.length(url) > max_length)


def clean_url(url: Column) -> Column:
    """Lower-case the host, drop the fragment and ``utm_*`` parameters."""
    params = F.regexp_replace(F.regexp_replace(query(url), UTM_PARAMETER, ""), "^&", "")
    return F.concat(
        scheme(url),
        F.lit("://"),
        F.lower(host(url)),
        path(url),
        F.when(params != "", F.concat(F.lit("?"), params)).otherwise(""),
    )


def page_key(url: Column) -> Column:
    """The key under which stored pages are looked up.

    A fragment never reaches a server, and the root page has one key with and without its slash.
    """
    return rooted(clean_url(url))


def rooted(clean: Column) -> Column:
    """The key of an address that is clean already."""
    return F.regexp_replace(clean, BARE_ORIGIN, "$1/")


def site_key(url: Column) -> Column:
    """The site a page or homepage belongs to."""
    return F.concat(scheme(url), F.lit("://"), F.lower(host(url)))


def extends(key: Column, source: Column) -> Column:
    """True when ``key`` lies below ``source``: it starts with it, and the source ends at a separator."""
    after = F.substr(key, F.length(source) + 1, F.lit(1))
    return key.startswith(source) & (key != source) & (source.endswith("/") | after.isin("/", "?", "#"))


def has_junk_suffix(url: Column) -> Column:
    return url.endswith('/"') | url.endswith("\\")


def strip_junk(url: Column) -> Column:
    return F.translate(url, '"\\', "")


def is_self_link(homepage: Column, link: Column) -> Column:
    slash = F.lit("/")
    return link.endswith(F.concat(homepage, slash)) | homepage.endswith(F.concat(link, slash))


def _without_dot_segments(p: Column) -> Column:
    """Fold ``.`` and ``..`` segments of an absolute path."""
    parts = F.split(p, "/")
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when((s == "..") & (F.size(acc) > 1), F.slice(acc, 1, F.size(acc) - 1))
        .when(s == "..", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    tail = F.when(p.rlike(r"/\.\.?$"), "/").otherwise("")
    joined = F.concat(F.array_join(folded, "/"), tail)
    return F.when(p.rlike(r"/\.\.?(/|$)"), joined).otherwise(p)


def resolve(base: Column, href: Column) -> Column:
    """Absolute form of ``href`` found on page ``base``; an empty one is the page itself."""
    href_path = F.regexp_extract(href, r"^[^?#]*", 0)
    href_tail = F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    folder = F.regexp_extract(path(base), r"^(.*/)", 1)
    folder = F.when(folder == "", "/").otherwise(folder)
    return (
        F.when(href == "", base)
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href))
        .when(href.startswith("#"), F.concat(F.regexp_extract(base, "^[^#]*", 0), href))
        .when(href.startswith("?"), F.concat(origin(base), path(base), href))
        .when(href.startswith("/"), F.concat(origin(base), _without_dot_segments(href_path), href_tail))
        .otherwise(F.concat(origin(base), _without_dot_segments(F.concat(folder, href_path)), href_tail))
    )
