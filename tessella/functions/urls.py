"""URL keys and predicates of the crawl, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters that don't change a page, sections that only add noise, suffixes that aren't pages.
DROPPED_PARAMS = ("gclid", "fbclid", "yclid", "_ga", "_openstat", "_ym_uid", "phpsessid", "jsessionid", "sessionid", "page", "pagenum", "page_num")
DROPPED_PREFIXES = ("utm_", "pagen_")
SKIPPED_SECTIONS = ("/events/", "/news/", "/vacancies/", "/press/")
ASSET_SUFFIXES = (
    "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "rtf", "csv", "zip", "rar", "7z", "jpg", "jpeg", "png", "gif", "webp", "svg",
    "ico", "mp3", "mp4", "avi", "apk", "exe", "css", "js", "xml",
)


def _without_fragment(url: Column) -> Column:
    return F.regexp_replace(F.trim(url), "#.*$", "")


def authority(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(_without_fragment(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def clean_url(url: Column) -> Column:
    """What a server sees alike, spelled alike: no fragment, lower-case scheme and host, no default port, upper-case
    percent escapes, sorted parameters without tracking, sessions and paging; ``/`` for an empty path."""
    bare = _without_fragment(url)
    scheme = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.when(scheme == "http", F.regexp_replace(authority(bare), ":80$", "")).when(scheme == "https", F.regexp_replace(authority(bare), ":443$", "")).otherwise(authority(bare))
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    name = lambda p: F.lower(F.substring_index(p, "=", 1))

    def kept(p: Column) -> Column:
        keep = (p != "") & ~name(p).isin(*DROPPED_PARAMS)
        for prefix in DROPPED_PREFIXES:
            keep = keep & ~name(p).startswith(prefix)
        return keep

    params = F.array_join(F.sort_array(F.filter(F.split(query, "&"), kept)), "&")
    tail = F.when(params != "", F.concat(F.lit("?"), params)).otherwise("")
    shown = F.when(path(bare) == "", "/").otherwise(path(bare))
    pieces = F.split(F.concat(scheme, F.lit("://"), host, shown, tail), "%")
    upper = F.transform(pieces, lambda x, i: F.when((i > 0) & x.rlike("^[0-9A-Fa-f]{2}"), F.concat(F.upper(F.substring(x, 1, 2)), F.substring(x, 3, 1 << 30))).otherwise(x))
    return F.array_join(upper, "%")


def url_key(url: Column) -> Column:
    """For comparing only: the clean URL without slashes at the end of its path, the root's own excepted."""
    return F.regexp_replace(clean_url(url), r"^([^:]*://[^/?]*/[^?]*[^/?])/+(\?|$)", "$1$2")


def is_asset(url: Column) -> Column:
    return F.lower(path(url)).rlike(r"\.(" + "|".join(ASSET_SUFFIXES) + ")$")


def is_skipped(url: Column, sections: tuple[str, ...] = SKIPPED_SECTIONS) -> Column:
    """Whether the path is in a section: whole segments, so ``/news`` and ``/news/x`` but not ``/newsletter``."""
    whole = F.concat(F.regexp_replace(F.lower(path(url)), "/+$", ""), F.lit("/"))
    hit = F.lit(False)
    for section in sections:
        hit = hit | whole.startswith(section)
    return hit


def same_domain(url: Column, root: Column, allowed: tuple[str, ...] = ()) -> Column:
    """Equal hosts (subdomains are other sites), or a host that is allowed as a language version."""
    host = authority(clean_url(url))
    same = host == authority(clean_url(root))
    return same | host.isin(*allowed) if allowed else same


def title_from_url(url: Column) -> Column:
    """Last segment of the path, else the host."""
    segment = F.regexp_extract(F.regexp_replace(path(url), "/+$", ""), "([^/]*)$", 1)
    return F.coalesce(F.nullif(segment, F.lit("")), authority(url))
