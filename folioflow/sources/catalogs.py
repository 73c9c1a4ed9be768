"""Catalog sources: feeds, sitemaps and embedded JSON as row tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import _col, clean_text, nullif_blank, trim_u
from ..functions.urls import path_of

FEED_SCHEMA = ("struct<channel: struct<item: array<struct<title: string, link: string, image: string, author: string, pubDate: string>>>>")
VOLUME_SCHEMA = ("struct<data: struct<vs: array<struct<vN: string, isVip: string, cs: array<struct<"
                 "id: string, chapterId: string, cId: string, uuid: string, cU: string, cN: string, isVip: string, needSubscribe: string>>>>>>")
PAGE_SCHEMA = ("struct<volumeNameList: array<string>, chapterListWithVolume: array<array<struct<"
               "itemId: string, title: string, realChapterOrder: string, isChapterLock: string>>>>")
# Fixed value: name of volumes without one, followed by their number.
VOLUME_WORD = "卷 "


def feed_hits(feeds: DataFrame, markup: str, site: str, id_pattern: str, keys: list[str]) -> DataFrame:
    """Hits of RSS documents: id from the link path, first of each id, blank titles dropped.

    One document is one row; its items become rows before anything is compared, and the first of an
    id is an aggregate, so a feed may be as long as a row may be.
    """
    items = F.from_xml(_col(markup), FEED_SCHEMA)["channel"]["item"]
    rows = feeds.select(*keys, F.posexplode(items).alias("_p", "i"))
    hits = rows.select(
        *keys, "_p", F.lit(site).alias("site"), F.regexp_extract(path_of("i.link"), id_pattern, 1).alias("book_id"),
        clean_text(F.coalesce("i.title", F.lit(""))).alias("title"), clean_text(F.coalesce("i.author", F.lit(""))).alias("author"),
        clean_text(F.coalesce("i.pubDate", F.lit(""))).alias("latest_chapter"), trim_u(F.coalesce("i.image", F.lit(""))).alias("cover_url"))
    order = F.struct(*keys, "_p")
    return (hits.filter((F.col("book_id") != "") & (F.col("title") != "")).groupBy("site", "book_id")
            .agg(F.min_by(F.struct("title", "author", "latest_chapter", "cover_url"), order).alias("h"), F.min(order).alias("first_seen"))
            .select("site", "book_id", "h.*", "first_seen"))


def sitemap_ids(maps: DataFrame, markup: str, pattern: str, keys: list[str]) -> DataFrame:
    """Distinct ids named in sitemap documents with the place each is first seen."""
    found = F.transform(F.regexp_extract_all(_col(markup), F.lit(pattern), F.lit(1)), trim_u)
    rows = maps.select(*keys, F.posexplode(found).alias("_p", "book_id")).filter(F.col("book_id") != "")
    return rows.groupBy("book_id").agg(F.min(F.struct(*keys, "_p")).alias("first_seen"))


def embedded_json(markup: Column | str, pattern: str) -> Column:
    """Object captured from a script assignment; NULL when absent or malformed."""
    raw = F.regexp_extract(_col(markup), pattern, 1)
    return F.when(raw != "", F.try_parse_json(raw))


def json_at(value: Column, path: str, kind: str = "string") -> Column:
    """Value at a path of a parsed object; NULL where a step is missing."""
    return F.try_variant_get(value, path, kind)


def _truthy(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit(""))).isin("true", "1")


def volume_catalog(books: DataFrame, payload: str, keys: list[str], include_locked: bool = False) -> DataFrame:
    """Chapters of a volumes-with-chapters JSON payload: fallback volume names, id from the first
    filled of four keys else from the chapter URL, locked chapters left out unless asked for."""
    volumes = F.from_json(_col(payload), VOLUME_SCHEMA)["data"]["vs"]
    v = books.select(*keys, F.posexplode(volumes).alias("volume_pos", "v"))
    name = F.coalesce(trim_u(nullif_blank("v.vN")), F.concat(F.lit(VOLUME_WORD), (F.col("volume_pos") + 1).cast("string")))
    c = v.select(*keys, "volume_pos", name.alias("volume"), F.col("v.isVip").alias("_vip"), F.posexplode("v.cs").alias("item_pos", "c"))
    chapter_id = F.coalesce(*[nullif_blank(f"c.{k}") for k in ("id", "chapterId", "cId", "uuid")],
                            F.regexp_extract(F.coalesce("c.cU", F.lit("")), r"/(\d+)/?(?:[?#].*)?\z", 1), F.lit(""))
    locked = F.contains(F.upper("volume"), F.lit("VIP")) | _truthy(F.col("_vip")) | _truthy(F.col("c.isVip")) | _truthy(F.col("c.needSubscribe"))
    rows = c.select(*keys, "volume_pos", "item_pos", chapter_id.alias("chapter_id"),
                    F.coalesce("c.cN", F.lit("")).alias("title"), "volume", locked.alias("locked")).filter(F.col("chapter_id") != "")
    return rows if include_locked else rows.filter(~F.col("locked"))


def listed_catalog(books: DataFrame, payload: str, keys: list[str], include_locked: bool = False) -> DataFrame:
    """Chapters of a payload with parallel volume names and chapter groups; inside a volume they
    sort by real order, else by item id.  Reading order is (volume_pos, sort_key, item_pos)."""
    page = F.from_json(_col(payload), PAGE_SCHEMA)
    g = books.select(*keys, page["volumeNameList"].alias("_names"), F.posexplode(page["chapterListWithVolume"]).alias("volume_pos", "_items"))
    named = nullif_blank(F.get("_names", F.col("volume_pos")))
    volume = F.coalesce(named, F.concat(F.lit(VOLUME_WORD), (F.col("volume_pos") + 1).cast("string")))
    c = g.select(*keys, "volume_pos", volume.alias("volume"), F.posexplode("_items").alias("item_pos", "c"))
    order = F.coalesce(F.nullif(F.col("c.realChapterOrder").try_cast("bigint"), F.lit(0)), F.col("c.itemId").try_cast("bigint"), F.lit(0))
    rows = c.select(*keys, "volume_pos", "item_pos", F.coalesce("c.itemId", F.lit("")).alias("chapter_id"),
                    F.coalesce("c.title", F.lit("")).alias("title"), "volume", order.alias("sort_key"),
                    _truthy(F.col("c.isChapterLock")).alias("locked")).filter(F.col("chapter_id") != "")
    return rows if include_locked else rows.filter(~F.col("locked"))


def json_tags(raw: Column | str) -> Column:
    """Names of a JSON array of objects with a Name; empty for blank or malformed text."""
    parsed = F.from_json(_col(raw), "array<struct<Name: string>>")
    return F.coalesce(F.filter(F.transform(parsed, lambda t: t["Name"]), lambda n: n.isNotNull() & (n != "")),
                      F.array().cast("array<string>"))
