"""URL queries over the page table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators.urls import resolve_urls
from . import query
from .views import table

_HOST = "regexp_extract(url, '^https?://([^/?#:]*)', 1)"
_PATH = "regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)"


@query("url_parts", f"SELECT page_id, lower({_HOST}) AS host, regexp_replace(lower({_HOST}), '^www\\.', '') AS bare, {_PATH} AS path FROM pages")
def url_parts(spark, d):
    return table(spark, d, "pages").select("page_id", U.host_of("url").alias("host"), U.bare_host("url").alias("bare"),
                                           U.path_of("url").alias("path"))


@query("url_scheme_fix", "SELECT page_id, 'https://' || url[9:] AS added, 'https://x/' || page_id AS from_relative, url AS kept FROM pages")
def url_scheme_fix(spark, d):
    return table(spark, d, "pages").select(
        "page_id", U.with_scheme(F.concat(F.lit(" "), F.substr("url", F.lit(9)))).alias("added"),
        U.https_if_protocol_relative(F.concat(F.lit(" //x/"), F.col("page_id").cast("string"))).alias("from_relative"),
        U.https_if_protocol_relative("url").alias("kept"))


@query("absolute_urls", f"""WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)
  SELECT page_id, href, CASE WHEN href = '' THEN '' WHEN starts_with(href, 'http') THEN href ELSE regexp_extract(url, '^(https?://[^/?#]+)', 1) || href END AS link, count(*) AS n
  FROM l GROUP BY ALL""")
def absolute_urls(spark, d):
    p = table(spark, d, "pages").select("page_id", "url", F.explode(
        F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("href"))
    return (p.select("page_id", "href", U.absolute_url("url", "href").alias("link"))
            .groupBy("page_id", "href", "link").agg(F.count(F.lit(1)).alias("n")))


@query("relative_urls", f"SELECT page_id, regexp_extract({_PATH}, '^(.*/)', 1) || 'next.html' AS p1, "
       f"regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/top' AS p2 FROM pages")
def relative_urls(spark, d):
    p = table(spark, d, "pages").select("page_id", U.absolute_url("url", F.lit("next.html")).alias("a"),
                                        U.absolute_url("url", F.lit(" /x/../top")).alias("p2"))
    return p.select("page_id", U.path_of("a").alias("p1"), "p2")


@query("url_or_keyword", "SELECT count(*) AS n, x AS is_url FROM (SELECT true AS x FROM pages UNION ALL SELECT false FROM pages UNION ALL SELECT false FROM benchmark) GROUP BY x")
def url_or_keyword(spark, d):
    p = table(spark, d, "pages")
    texts = (p.select("url").union(p.select(F.concat(F.lit("ftp://"), F.substr("url", F.lit(9)))))
             .union(table(spark, d, "benchmark").select("text")))
    return texts.select(U.is_web_url("url").alias("is_url")).groupBy("is_url").agg(F.count(F.lit(1)).alias("n"))


@query("book_id_from_url", f"""WITH p AS (SELECT page_id, regexp_extract({_PATH}, '^/*(.*?)/*$', 1) AS path FROM pages)
  SELECT page_id, list_last(string_split(path, '/')) AS last_id, string_split(path, '/')[1] AS named_id FROM p""")
def book_id_from_url(spark, d):
    p = table(spark, d, "pages")
    named = F.concat(F.lit("https://h.example.com/Book"), U.path_of("url"))
    return p.select("page_id", U.book_id_from_url("url").alias("last_id"), U.book_id_from_url(named).alias("named_id"))


def _rules(spark, d):
    """Rules of each language section for the hosts of the pages; `numbers` may match any host."""
    hosts = table(spark, d, "pages").select(U.bare_host("url").alias("host")).distinct()
    own = hosts.select(
        F.concat(F.lit("site-"), "host").alias("site"), "host",
        F.explode(F.array(*[F.struct(F.lit(rx).alias("path_regex"), F.lit(b).alias("book_group"), F.lit(c).alias("chapter_group"),
                                     F.lit(p).alias("priority"))
                            for rx, b, c, p in [(r"^/(en|fr)/(\d+)\.html$", 1, 2, 1), (r"^/(en|fr)/(\d+)/?$", 2, 0, 2)]])).alias("r"))
    own = own.select("site", "host", "r.*", F.lit(False).alias("any_host"))
    # rules for any host: by a language, by alternatives at the top, and a last one that knows no language
    anywhere = [("german", r"^/de/(\d+)/?$", 1, 0, 5), ("either", r"^/es/(\d+)\.html$|^/es/x(\d+)$", 1, 0, 1), ("numbers", r"^/[a-z]{2}/(\d+)", 1, 0, 9)]
    other = hosts.limit(1).select(F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(
        ("site", "path_regex", "book_group", "chapter_group", "priority"), r, strict=True)]) for r in anywhere])).alias("r")).select("r.*")
    return own.unionByName(other.withColumns({"host": F.concat("site", F.lit(".example.com")), "any_host": F.lit(True)}))


@query("resolve_urls", f"""WITH p AS (SELECT page_id, regexp_replace(lower({_HOST}), '^www\\.', '') AS host, {_PATH} AS path FROM pages)
  SELECT page_id, CASE WHEN regexp_matches(path, '^/(en|fr)/\\d+(\\.html|/?)$') THEN 'site-' || host WHEN regexp_matches(path, '^/es/(\\d+\\.html|x\\d+)$') THEN 'either'
    WHEN regexp_matches(path, '^/de/\\d+/?$') THEN 'german' WHEN regexp_matches(path, '^/[a-z]{{2}}/\\d+') THEN 'numbers' END AS site,
    CASE WHEN regexp_matches(path, '^/(en|fr)/\\d+\\.html$') THEN path[2:3] WHEN regexp_matches(path, '^/[a-z]{{2}}/\\d+') THEN regexp_extract(path, '^/[a-z]{{2}}/(\\d+)', 1) END AS book_id,
    CASE WHEN regexp_matches(path, '^/(en|fr)/\\d+\\.html$') THEN regexp_extract(path, '/(\\d+)', 1) WHEN regexp_matches(path, '^/[a-z]{{2}}/\\d+') THEN '' END AS chapter_id,
    CASE WHEN regexp_matches(path, '^/[a-z]{{2}}/\\d+') THEN 'https://' || host || path END AS canonical FROM p""")
def resolve(spark, d):
    return resolve_urls(table(spark, d, "pages").select("page_id", "url"), _rules(spark, d)).drop("url")
