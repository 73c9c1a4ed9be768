"""URL columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, trim_u

# Path segments that announce a book id.
BOOK_SEGMENTS = ("book", "info", "read")


def with_scheme(c: Column | str) -> Column:
    """Trim and add https when the URL names no web scheme."""
    x = trim_u(c)
    return F.when(x.rlike(r"^https?://"), x).otherwise(F.concat(F.lit("https://"), x))


def host_of(c: Column | str) -> Column:
    """Lower-case host without port or trailing dot."""
    h = F.regexp_extract(with_scheme(c), r"^https?://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(F.lower(h), r"\.\z", "")


def bare_host(c: Column | str) -> Column:
    """Host without a leading www."""
    return F.regexp_replace(host_of(c), r"^www\.(?=.)", "")


def path_of(c: Column | str) -> Column:
    return F.regexp_extract(with_scheme(c), r"^https?://[^/?#]*([^?#]*)", 1)


def is_web_url(c: Column | str) -> Column:
    """True for text with an http(s) scheme and a host; anything else is a search keyword."""
    return trim_u(c).rlike(r"^(?i:https?)://[^/?#\s]+([/?#]|\z)")


def https_if_protocol_relative(c: Column | str) -> Column:
    x = trim_u(c)
    return F.when(F.startswith(x, F.lit("//")), F.concat(F.lit("https:"), x)).otherwise(x)


def _without_dots(path: Column) -> Column:
    """Path with `.` and `..` segments resolved."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: (
        F.when(p == "..", F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc))
        .when(p == ".", acc).otherwise(F.concat(acc, F.array(p)))))
    folder = last.isin(".", "..") & ((F.size(walked) == 1) | (F.element_at(walked, -1) != ""))
    return F.array_join(F.when(folder, F.concat(walked, F.array(F.lit("")))).otherwise(walked), "/")


def absolute_url(base: Column | str, raw: Column | str) -> Column:
    """Absolute form of a link found on the page `base`."""
    b, r = trim_u(base), trim_u(raw)
    origin = F.regexp_extract(b, r"^(https?://[^/?#]+)", 1)
    page = F.regexp_extract(b, r"^[^#]*", 0)
    base_path = F.regexp_extract(b, r"^https?://[^/?#]+([^?#]*)", 1)
    folder = F.regexp_replace(F.when(base_path == "", F.lit("/")).otherwise(base_path), r"[^/]*\z", "")
    path, rest = F.regexp_extract(r, r"^[^?#]*", 0), F.regexp_extract(r, r"[?#].*\z", 0)
    whole = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(folder, path))
    # most links have no dot segments and skip the walk over the segments
    clean = F.when(whole.rlike(r"(^|/)\.{1,2}(/|\z)"), _without_dots(whole)).otherwise(whole)
    joined_plain = F.concat(F.regexp_replace(b, r"/+\z", ""), F.when(F.startswith(r, F.lit("/")), F.lit("")).otherwise(F.lit("/")), r)
    return (F.when(r == "", F.lit(""))
            .when(r.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), r)
            .when(F.startswith(r, F.lit("//")), F.concat(F.lit("https:"), r))
            .when(origin == "", joined_plain)
            .when(F.startswith(r, F.lit("#")), F.concat(page, r))
            .when(F.startswith(r, F.lit("?")), F.concat(origin, base_path, r))
            .otherwise(F.concat(origin, clean, rest)))


def usable_metadata(c: Column | str) -> Column:
    """Trimmed text, or empty when it is a dot name or looks like a local path."""
    x = trim_u(c)
    slashed = F.replace(x, F.lit("\\"), F.lit("/"))
    path_like = slashed.rlike(r"^(\.{0,2}/|[A-Za-z]:/)")
    return F.when(x.isin("", ".", "..") | path_like, F.lit("")).otherwise(x)


def book_id_from_url(c: Column | str) -> Column:
    """Id after the first book-like segment, else the last usable path segment."""
    path = F.regexp_replace(F.regexp_extract(trim_u(c), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1),
                            r"^/+|/+\z", "")
    parts = F.split(path, "/")
    n = F.size(parts)
    spots = F.filter(F.transform(parts, lambda p, i: F.when(F.lower(p).isin(*BOOK_SEGMENTS) & (i + 1 < n), i)),
                     lambda i: i.isNotNull())
    usable = F.filter(F.transform(parts, usable_metadata), lambda p: p != "")
    return (F.when(F.size(spots) > 0, usable_metadata(F.get(parts, F.get(spots, F.lit(0)) + 1)))
            .when(F.size(usable) > 0, F.element_at(usable, -1))
            .otherwise(F.lit("")))
