"""Labels and identifiers derived from numbers and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, first_non_blank, trim_u

# Unit words of the duration labels.
HOURS, MINUTES, SECONDS, NO_TIME = "小时", "分", "秒", "0s"


def _hms(seconds: Column) -> tuple[Column, Column, Column]:
    whole = F.floor(seconds)
    return F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) and not isinstance(p, str) else F.lit(p) for p in parts])


def eta_seconds(done: Column | str, total: Column | str, rate: Column | str) -> Column:
    """Seconds left at the current rate; NULL without a rate."""
    d, t, r = _col(done), _col(total), _col(rate)
    return F.when(r > 0, F.greatest(t - d, F.lit(0)) / r)


def eta_label(seconds: Column | str) -> Column:
    """Remaining time; seconds are left out from one hour on.  Empty when there is no estimate."""
    s = _col(seconds)
    h, m, sec = _hms(s)
    i = lambda c: c.cast("bigint").cast("string")
    return (F.when(s.isNull(), F.lit(""))
            .when(s <= 0, F.lit(NO_TIME))
            .when(h > 0, _text(i(h), HOURS, i(m), MINUTES))
            .when(m > 0, _text(i(m), MINUTES, i(sec), SECONDS))
            .otherwise(_text(i(sec), SECONDS)))


def elapsed_label(seconds: Column | str) -> Column:
    s = _col(seconds)
    h, m, sec = _hms(s)
    i = lambda c: c.cast("bigint").cast("string")
    return (F.when(s <= 0, F.lit(NO_TIME))
            .when(h > 0, _text(i(h), HOURS, i(m), MINUTES, i(sec), SECONDS))
            .when(m > 0, _text(i(m), MINUTES, i(sec), SECONDS))
            .otherwise(_text(i(sec), SECONDS)))


def percent(done: Column | str, total: Column | str) -> Column:
    """Rounded percent, at most 100, zero without a total."""
    d, t = _col(done), _col(total)
    return F.when(F.coalesce(t, F.lit(0)) == 0, F.lit(0).cast("bigint")).otherwise(
        F.least(F.lit(100).cast("bigint"), F.floor(d / t * 100 + 0.5)))


def chapter_key(site, book_id, chapter_id, url, title) -> Column:
    return F.concat_ws("/", _col(site), _col(book_id), trim_u(first_non_blank(chapter_id, url, title)))


def book_uuid(site, book_id, title) -> Column:
    """Name-based UUID of a book: leading SHA-1 bytes with version 5 and RFC variant bits."""
    h = F.sha1(F.concat_ws(":", _col(site), _col(book_id), _col(title)).cast("binary"))
    part = lambda at, n: F.substring(h, at, n)
    variant = F.lower(F.hex(F.conv(part(17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8)).cast("bigint")))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"),
                    variant, part(18, 3), F.lit("-"), part(21, 12))
