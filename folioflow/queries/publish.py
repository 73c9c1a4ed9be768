"""Publishing and stage-store queries: documents and conversations as books."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.checkpoints import scratch_dir
from ..sources import library_store as L
from ..sources import publish as P
from . import query
from .text import sql_trim
from .views import CHAPTERS, chapters, table


def _books(spark, d):
    """One book per source and twenty documents."""
    return (chapters(spark, d).groupBy("site", "book_id").agg(F.count(F.lit(1)).alias("n")).selectExpr(
        "site", "book_id", "concat('Book <', book_id, '>') AS title", "concat('A & ', site) AS author",
        "CASE WHEN n % 2 = 0 THEN '' ELSE concat('line \"1\"\nof ', n) END AS description", "'' AS source_url", "'/c.png' AS cover_url"))


_BOOKS = """books AS (SELECT site, book_id, 'Book <' || book_id || '>' AS title, 'A & ' || site AS author,
  CASE WHEN count(*) % 2 = 0 THEN '' ELSE 'line "1"' || chr(10) || 'of ' || count(*) END AS description FROM chapters GROUP BY 1, 2)"""

_TXT = f"""lines AS (SELECT site, book_id, order_index, title, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM chapters),
  bodies AS (SELECT site, book_id, order_index, title, string_agg('    ' || {sql_trim('line')}, chr(10) || chr(10) || chr(10) ORDER BY i) FILTER (WHERE {sql_trim('line')} <> '') AS body
    FROM lines GROUP BY 1, 2, 3, 4),
  full_text AS (SELECT b.site, b.book_id, string_agg(chr(10) || chr(10) || '# ' || c.title || chr(10) || chr(10) || coalesce(c.body, '') || chr(10), '' ORDER BY c.order_index) AS t FROM books b
    JOIN bodies c ON b.site = c.site AND b.book_id = c.book_id GROUP BY 1, 2)"""


@query("txt_books", f"""WITH {CHAPTERS}, {_BOOKS}, {_TXT} SELECT b.site, b.book_id, 0 AS part, md5(b.title || chr(10) || 'Author: ' || b.author || chr(10) ||
  CASE WHEN description <> '' THEN chr(10) || description || chr(10) ELSE '' END || t) AS h FROM books b JOIN full_text f ON f.site = b.site AND f.book_id = b.book_id""")
def txt_books(spark, d):
    return P.txt_parts(_books(spark, d), chapters(spark, d)).select("site", "book_id", "part", F.md5("body").alias("h"))


def _esc(c: str) -> str:
    return f"replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&#34;'), '''', '&#39;')"


@query("html_books", f"""WITH {CHAPTERS}, {_BOOKS}, a AS (SELECT site, book_id, string_agg('<article><h2>' || {_esc('title')} || '</h2><pre>' || {_esc('content')} || '</pre></article>', '' ORDER BY order_index) AS t
    FROM chapters GROUP BY 1, 2)
  SELECT b.site, b.book_id, 0 AS part, md5('<!doctype html><html><head><meta charset="utf-8"><title>' || {_esc('b.title')} || '</title><style>{P.HTML_STYLE}</style></head><body><h1>' || {_esc('b.title')} ||
    '</h1><p><strong>' || {_esc('b.author')} || '</strong></p>' || CASE WHEN description <> '' THEN '<p style="white-space:pre-line;">' || replace({_esc('description')}, chr(10), '<br/>') || '</p>' ELSE '' END
    || t || '</body></html>') AS h FROM books b JOIN a ON a.site = b.site AND a.book_id = b.book_id""")
def html_books(spark, d):
    return P.html_parts(_books(spark, d), chapters(spark, d)).select("site", "book_id", "part", F.md5("body").alias("h"))


def _xml(c: str) -> str:
    return f"replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _tag(name: str, inside: str, attributes: str = "") -> str:
    """An element of escaped text; an empty one is short."""
    return f"CASE WHEN {inside} = '' THEN '<{name}{attributes} />' ELSE '<{name}{attributes}>' || {inside} || '</{name}>' END"


_DECLARED = "'<?xml version=''1.0'' encoding=''utf-8''?>' || chr(10) || "


def _page(title: str, inside: str, space: str = "") -> str:
    return (f"""{_DECLARED}'<html{space} xmlns="{P.XHTML}"><head>' || {_tag('title', title)} || '<link rel="stylesheet" type="text/css" href="sheet.css" /></head><body>' || {inside} || '</body></html>'""")


_LINES = f"""string_agg('<p class="line">' || {_xml(sql_trim('line'))} || '</p>', '' ORDER BY i) FILTER (WHERE {sql_trim('line')} <> '')"""
_PICTURE = "'<div class=\"picture\"><img src=\"pictures/p1\" alt=\"' || t || '\" /></div>'"
_EPUB = rf"""lines AS (SELECT site, book_id, order_index, title, unnest(string_split(regexp_replace(content, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'), chr(10))) AS line,
    generate_subscripts(string_split(content, chr(10)), 1) AS i FROM chapters),
  docs AS (SELECT site, book_id, order_index, {_xml('title')} AS t, coalesce({_LINES}, '') AS body FROM lines GROUP BY site, book_id, order_index, title),
  b AS (SELECT site, book_id, {_xml('title')} AS t, {_xml('author')} AS a, description AS d, sha1(site || ':' || book_id || ':' || title) AS u FROM books),
  l AS (SELECT site, book_id, string_agg('<li><a href="c' || order_index || '.xhtml">' || CASE WHEN t = '' THEN 'c' || order_index ELSE t END || '</a></li>', '' ORDER BY order_index) AS toc,
    string_agg('<item id="c' || order_index || '" href="c' || order_index || '.xhtml" media-type="application/xhtml+xml" />', '' ORDER BY order_index) AS items,
    string_agg('<itemref idref="c' || order_index || '" />', '' ORDER BY order_index) AS refs FROM docs GROUP BY 1, 2),
  about AS (SELECT site, book_id, string_agg('<p class="line">' || {_xml('line')} || '</p>', '' ORDER BY i) AS x
    FROM (SELECT site, book_id, unnest(string_split(d, chr(10))) AS line, generate_subscripts(string_split(d, chr(10)), 1) AS i FROM b WHERE d <> '') GROUP BY 1, 2),
  named AS (SELECT b.*, toc, items, refs, coalesce(x, '') AS x, u[1:8] || '-' || u[9:12] || '-5' || u[14:16] || '-' || CASE WHEN u[17] IN ('0', '4', '8', 'c') THEN '8' WHEN u[17] IN ('1', '5', '9', 'd') THEN '9'
      WHEN u[17] IN ('2', '6', 'a', 'e') THEN 'a' ELSE 'b' END || u[18:20] || '-' || u[21:32] AS uuid
    FROM b JOIN l ON l.site = b.site AND l.book_id = b.book_id LEFT JOIN about ON about.site = b.site AND about.book_id = b.book_id),
  entries AS (
    SELECT site, book_id, 'mimetype' AS entry, '{P.MIMETYPE}' AS data FROM named
    UNION ALL SELECT site, book_id, 'META-INF/container.xml', {_DECLARED}'<container xmlns="{P.OCF}" version="1.0"><rootfiles><rootfile full-path="OEBPS/book.opf" media-type="application/oebps-package+xml" /></rootfiles></container>' FROM named
    UNION ALL SELECT site, book_id, 'OEBPS/book.opf', {_DECLARED}'<package xmlns="{P.OPF}" version="3.0" unique-identifier="uid"><metadata xmlns:dc="{P.DC}"><dc:identifier id="uid">urn:uuid:' || uuid || '</dc:identifier><dc:title>' || t ||
      '</dc:title><dc:language>{P.LANGUAGE}</dc:language><dc:creator>' || a || '</dc:creator><meta property="dcterms:modified">2024-01-01T00:00:00Z</meta></metadata><manifest><item id="toc" href="toc.xhtml" media-type="application/xhtml+xml" properties="nav" /><item id="sheet" href="sheet.css" media-type="text/css" /><item id="about" href="about.xhtml" media-type="application/xhtml+xml" />' || items ||
      '<item id="p1" href="pictures/p1" media-type="image/png" properties="cover-image" /></manifest><spine><itemref idref="about" />' || refs || '</spine></package>' FROM named
    UNION ALL SELECT site, book_id, 'OEBPS/toc.xhtml', {_page('t', f"'<nav ns0:type=\"toc\"><ol><li><a href=\"about.xhtml\">{P.INFO_TITLE}</a></li>' || toc || '</ol></nav>'", f' xmlns:ns0="{P.OPS}"')} FROM named
    UNION ALL SELECT site, book_id, 'OEBPS/sheet.css', '{P.SHEET}' FROM named
    UNION ALL SELECT site, book_id, 'OEBPS/about.xhtml', {_page('t', f"{_PICTURE} || '<h1>' || t || '</h1><p>' || a || '</p>' || CASE WHEN x <> '' THEN '<h2>{P.INTRO_TITLE}</h2>' || x ELSE '' END")} FROM named
    UNION ALL SELECT site, book_id, 'OEBPS/c' || order_index || '.xhtml', {_page('t', f"{_tag('h2', 't')} || body")} FROM docs
    UNION ALL SELECT site, book_id, 'OEBPS/pictures/p1', 'png' FROM named)"""


@query("epub_books", f"WITH {CHAPTERS}, {_BOOKS}, {_EPUB} SELECT site, book_id, 0 AS part, entry, strlen(data) AS bytes, md5(data) AS md5 FROM entries")
def epub_books(spark, d):
    """Every file in the volume of each book, with a cover asset."""
    assets = table(spark, d, "region").limit(1).select(F.lit("/c.png").alias("url"), F.lit("image/png").alias("media_type"), F.lit("png").cast("binary").alias("data"))
    volumes = P.epub_parts(_books(spark, d), chapters(spark, d), assets, "2024-01-01T00:00:00Z")
    return P.volume_entries(volumes).drop("position")


@query("output_names", r"""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'b' || p_partkey ELSE CAST(p_partkey AS VARCHAR) END ELSE 'T_' || p_name END
  || '_' || CASE WHEN p_partkey % 5 = 0 THEN 'unknown' ELSE p_brand END || '.' || CASE WHEN p_partkey % 4 = 0 THEN 'epub' ELSE 'txt' END AS file_name FROM part""")
def output_names(spark, d):
    p = table(spark, d, "part").selectExpr(
        "p_partkey", r"CASE WHEN p_partkey % 2 = 0 THEN concat('b', p_partkey) ELSE '..' END AS book_id", r"CASE WHEN p_partkey % 3 = 0 THEN 'C:\\x\\y' ELSE concat('T?*', p_name) END AS title",
        "CASE WHEN p_partkey % 5 = 0 THEN './a' ELSE p_brand END AS author", "concat('https://h.example.com/book/', p_partkey, '/') AS url",
        "CASE WHEN p_partkey % 4 = 0 THEN 'epub' ELSE 'txt' END AS fmt")
    return p.select("p_partkey", P.output_name(None, F.col("fmt"), F.lit("s"), F.col("book_id"), F.col("title"), F.col("author"), F.col("url")).alias("file_name"))


@query("format_requests", """WITH f AS (SELECT p_partkey, unnest(CASE p_partkey % 3 WHEN 0 THEN ['txt', 'pdf'] WHEN 1 THEN ['epub'] ELSE ['txt'] END) AS format FROM part)
  SELECT p_partkey, format, format <> 'pdf' AS supported FROM f""")
def format_requests(spark, d):
    p = table(spark, d, "part").selectExpr(
        "p_partkey", "CASE WHEN p_partkey % 3 = 0 THEN array(' TXT', 'pdf', ' ') ELSE CAST(array() AS ARRAY<STRING>) END AS req",
        "CASE WHEN p_partkey % 3 = 1 THEN array('Epub ') END AS conf")
    return P.format_requests(p, "req", "conf").select("p_partkey", "format", "supported")


@query("stage_round_trip", f"""WITH {CHAPTERS} SELECT site, chapter_id, CASE WHEN site = 'src1' THEN 'clean' ELSE 'raw' END AS stage, CASE WHEN order_index > 2 THEN order_index ELSE doc_id END AS order_index,
  md5(CASE WHEN site = 'src1' THEN 'new ' || content ELSE content END) AS h, content <> '' AS downloaded FROM chapters""")
def stage_round_trip(spark, d):
    """Save a raw stage twice, then a second stage of one source; load the latest stage of each book."""
    root = scratch_dir(spark)
    c = (chapters(spark, d).withColumn("order_index", F.when(F.col("order_index") > 2, F.col("order_index")).otherwise(F.lit(0)))
         .withColumn("position", F.col("doc_id")).withColumn("downloaded", F.lit(False)))
    rows = L.chapter_rows(c)
    books = _books(spark, d).selectExpr("*", "array('t') AS tags", "timestamp'2024-01-01' AS downloaded_at", "timestamp'2024-01-01' AS updated_at")
    L.save_stage(root, "raw", 1, books, rows.withColumn("content", F.lit("old")))
    L.save_stage(root, "raw", 2, books, rows)
    one = F.col("site") == "src1"
    L.save_stage(root, "clean", 3, books.filter(one), rows.filter(one).withColumn("content", F.concat(F.lit("new "), "content")))
    return L.load_chapters(spark, root).select("site", "chapter_id", "stage", "order_index", F.md5("content").alias("h"), "downloaded")
