"""Extraction queries over the page table, and over markup and JSON derived from other tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markup as M
from ..functions.text import clean_text
from ..operators.extraction import extract
from ..operators.lines import is_ad_line
from ..operators.library import collect_after_marker
from ..operators.search import build_index, dedupe_hits
from ..plans.checkpoints import scratch_dir
from ..plans.ordering import join_text
from ..plans.sizing import in_pieces
from ..sources import catalogs as C
from ..sources import pages as P
from ..sources import snapshots as N
from . import query
from .text import sql_clean
from .views import table


def _nodes(spark, d, html="html"):
    return P.with_nodes(table(spark, d, "pages").select("page_id", "url", F.expr(html).alias("html")))


def sql_unescape(c: str) -> str:
    return (f"replace(replace(replace(replace({c}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')")


def sql_strip(c: str) -> str:
    return sql_unescape(f"regexp_replace({c}, '<[^>]*>', '', 'g')")


_ARTICLE = "regexp_extract(html, '(?s)<article>(.*?)</article>', 1)"

META = ("replace(html, '<head>', concat('<head><meta property=\"og:title\" content=\" \"><meta property=\"og:title\" content=\" P', page_id, ' \">"
        "<META NAME=\"Author\" content=\"A', page_id, '\"><script type=\"application/ld+json\">{\"description\": \"D \\\\\"q\\\\\" ', page_id, '\", \"n\": 1}</script>'))")


@query("page_meta", "SELECT page_id, 'P' || page_id AS og_title, 'A' || page_id AS author, 'D \"q\" ' || page_id AS description FROM pages")
def page_meta(spark, d):
    return _nodes(spark, d, META).select(
        "page_id", M.meta_content("nodes", "og:title").alias("og_title"), M.meta_content("nodes", "author", "name").alias("author"),
        M.json_ld_field("nodes", r'"description"\s*:\s*("(?:[^"\\]|\\.)*"|[^,\r\n]+)').alias("description"))


@query("page_elements", f"""SELECT page_id, {sql_clean(sql_unescape("regexp_extract(html, '<title>(.*?)</title>', 1)"))} AS title,
  {sql_clean(sql_unescape("regexp_extract(html, '<h1>(.*?)</h1>', 1)"))} AS heading, len(regexp_extract_all(html, '<a href')) AS n_links,
  len(regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1), '<li>')) AS n_nav_items FROM pages""")
def page_elements(spark, d):
    n = F.col("nodes")
    return _nodes(spark, d).select(
        "page_id", clean_text(M.node_text(n, M.first(M.select(n, "title")))).alias("title"),
        clean_text(M.node_text(n, M.first(M.select(n, "h1")))).alias("heading"), F.size(M.select(n, "a")).alias("n_links"),
        F.size(M.within(M.select(n, "li"), M.select(n, "nav"))).alias("n_nav_items"))


@query("page_links", f"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')) AS a FROM pages)
  SELECT page_id, {sql_unescape("regexp_extract(a, 'href=\"([^\"]*)\"', 1)")} AS href, {sql_clean(sql_unescape("regexp_extract(a, '>([^<]*)<', 1)"))} AS link_text, count(*) AS n FROM l GROUP BY ALL""")
def page_links(spark, d):
    x = _nodes(spark, d).select("page_id", F.explode(M.links("nodes", M.select("nodes", "a"))).alias("l"))
    return x.groupBy("page_id", F.col("l.href").alias("href"), F.col("l.text").alias("link_text")).agg(F.count(F.lit(1)).alias("n"))


_BLOCK_TEXT = "replace(replace(replace(replace(" + _ARTICLE + ", '<br>', chr(10)), '<p>', chr(10)), '</p>', chr(10)), '</h1>', chr(10))"

#: Rules of three sources: where each finds its fields, in order of trial.
RULES = [
    ("s0", "title", 1, "head > title", "text", "", "first"), ("s0", "links", 1, "a[href]", "text", "", "all"), ("s0", "hrefs", 1, "nav > ul li > a", "url", "href", "all"),
    ("s1", "title", 1, "head meta[name=title]", "attr", "content", "first"), ("s1", "title", 2, "body > p.title, h1", "text", "", "first"), ("s1", "title", 3, "article > h1", "text", "", "first"),
    ("s1", "charset", 1, "meta[charset]", "attr", "charset", "first"), ("s1", "nothing", 1, "article nav", "text", "", "all"),
    ("s2", "body", 1, "#content", "blocks", "", "first"), ("s2", "body", 2, "article", "blocks", "", "first"), ("s2", "advert", 1, "body > div.ad", "text", "", "first"), ("s2", "lang", 1, "html[lang]", "attr", "lang", "all")]

_LABELS = f"list_transform(regexp_extract_all(html, '<a href=\"[^\"]*\">[^<]*</a>'), lambda x: {sql_clean(sql_strip('x'))})"
_NAV = "regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1), '<li><a href=\"([^\"]*)\"', 1)"


@query("extracted_fields", f"""WITH p AS (SELECT page_id, page_id % 3 AS s, html, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS base FROM pages),
  f AS (SELECT page_id, 'title' AS field, [{sql_clean(sql_unescape("regexp_extract(html, '<title>(.*?)</title>', 1)"))}] AS v FROM p WHERE s = 0
    UNION ALL SELECT page_id, 'links', list_filter({_LABELS}, lambda x: x <> '') FROM p WHERE s = 0
    UNION ALL SELECT page_id, 'hrefs', list_transform({_NAV}, lambda x: base || {sql_unescape('x')}) FROM p WHERE s = 0
    UNION ALL SELECT page_id, 'title', [{sql_clean(sql_unescape("regexp_extract(html, '<h1>(.*?)</h1>', 1)"))}] FROM p WHERE s = 1
    UNION ALL SELECT page_id, 'charset', [regexp_extract(html, 'charset="([^"]*)"', 1)] FROM p WHERE s = 1
    UNION ALL SELECT page_id, 'body', [{sql_clean(sql_strip(_BLOCK_TEXT))}] FROM p WHERE s = 2
    UNION ALL SELECT page_id, 'advert', [{sql_clean(sql_strip("regexp_extract(html, '(?s)<div class=.ad.>(.*?)</div>', 1)"))}] FROM p WHERE s = 2
    UNION ALL SELECT page_id, 'lang', [regexp_extract(html, '<html lang="([^"]*)"', 1)] FROM p WHERE s = 2)
  SELECT page_id, field, len(v) AS n, md5(array_to_string(v, '|')) AS h FROM f WHERE len(v) > 0 AND v <> ['']""")
def extracted_fields(spark, d):
    rules = spark.createDataFrame(RULES, "site string, field string, ord int, selector string, mode string, attribute string, take string")
    pages = _nodes(spark, d).withColumn("site", F.concat(F.lit("s"), F.col("page_id") % 3))
    return extract(pages, rules).select("page_id", "field", F.size("values").alias("n"), F.md5(F.array_join("values", "|")).alias("h"))


def _article(nodes="nodes"):
    return M.first(M.select(nodes, "article"))




@query("node_texts", f"""SELECT page_id, md5({sql_clean(sql_strip(_BLOCK_TEXT))}) AS chapter_text, md5({sql_clean(sql_strip(_ARTICLE))}) AS plain,
  md5({sql_clean(sql_strip("replace(" + _ARTICLE + ", '<br>', chr(10))"))}) AS with_breaks FROM pages""")
def node_texts(spark, d):
    x = _nodes(spark, d).withColumn("a", _article())
    return x.select("page_id", F.md5(clean_text(M.chapter_text("nodes", F.col("a")))).alias("chapter_text"),
                    F.md5(clean_text(M.node_text("nodes", F.col("a")))).alias("plain"),
                    F.md5(clean_text(M.node_text_breaks("nodes", F.col("a")))).alias("with_breaks"))


_PARAGRAPHS = f"""pieces AS (SELECT page_id, unnest(string_split({_ARTICLE}, '<p>')[2:]) AS p, generate_subscripts(string_split({_ARTICLE}, '<p>')[2:], 1) AS i FROM pages),
  texts AS (SELECT page_id, i, {sql_clean(sql_strip("replace(p, '<br>', chr(10))"))} AS t FROM pieces)"""


@query("page_paragraphs", f"""WITH {_PARAGRAPHS} SELECT page_id, count(*) AS n, md5(string_agg(t, '|' ORDER BY i)) AS h FROM texts
  WHERE t <> '' AND NOT contains(t, '月票') GROUP BY page_id""")
def page_paragraphs(spark, d):
    salted = "replace(html, '</h1>', '</h1><p>投 月票 here</p>')"
    x = _nodes(spark, d, salted)
    ps = M.within(M.select("nodes", "p"), M.select("nodes", "article"))
    x = x.select("page_id", M.paragraphs("nodes", ps, lambda t: is_ad_line(t, "votes")).alias("p")).filter(F.size("p") > 0)
    return x.select("page_id", F.size("p").alias("n"), F.md5(F.array_join("p", "|")).alias("h"))


@query("loose_lines", f"""WITH x AS (SELECT page_id, unnest(string_split({sql_clean(sql_strip("replace(" + _ARTICLE + ", '<br>', chr(10))"))}, chr(10))) AS line FROM pages)
  SELECT page_id, line, count(*) AS n FROM x WHERE line <> '' GROUP BY ALL""")
def loose_lines(spark, d):
    x = _nodes(spark, d).select("page_id", F.explode(M.loose_lines("nodes", _article())).alias("line"))
    return x.groupBy("page_id", "line").agg(F.count(F.lit(1)).alias("n"))


@query("flush_lines", f"""WITH x AS (SELECT page_id, {sql_clean(sql_strip('p'))} AS line FROM (SELECT page_id, unnest(string_split_regex({_ARTICLE}, '<br>|</?p>')) AS p FROM pages))
  SELECT page_id, md5(line) AS h, count(*) AS n FROM x WHERE line <> '' GROUP BY ALL""")
def flush_lines(spark, d):
    salted = "replace(html, '<article>', '<article><div class=\"a Tips\"><p>menu</p></div>')"
    x = _nodes(spark, d, salted).select("page_id", F.explode(M.flush_lines("nodes", _article(), ["Tips", "yuedu_menu"])).alias("line"))
    return x.groupBy("page_id", F.md5("line").alias("h")).agg(F.count(F.lit(1)).alias("n"))


@query("readable_paragraphs", f"""WITH {_PARAGRAPHS}, allt AS (SELECT page_id, i + 3 AS i, t FROM texts UNION ALL SELECT page_id, 1, 'loose ' || page_id FROM pages
  UNION ALL SELECT page_id, 2, 'in p' FROM pages UNION ALL SELECT page_id, 3, '[图片] ' || regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/i.png' FROM pages)
  SELECT page_id, count(*) AS n, md5(string_agg(t, '|' ORDER BY i)) AS h FROM allt WHERE t <> '' GROUP BY page_id""")
def readable_paragraphs(spark, d):
    salted = ("replace(html, '<article>', concat('<article><div>loose ', page_id, '</div><section>x<p>in p<img src=\" \" data-src=\"/i.png\"></p></section>'))")
    x = _nodes(spark, d, salted).select("page_id", M.readable_paragraphs("nodes", _article(), "url").alias("p"))
    return x.select("page_id", F.size("p").alias("n"), F.md5(F.array_join("p", "|")).alias("h"))


@query("longest_paragraph", f"""WITH {_PARAGRAPHS} SELECT page_id, md5(first(t ORDER BY strlen(replace(t, chr(10), '')) DESC, i)) AS h FROM texts GROUP BY page_id""")
def longest_paragraph(spark, d):
    x = _nodes(spark, d).select("page_id", M.longest_paragraph("nodes", _article()).alias("p"))
    return x.select("page_id", F.md5(F.array_join("p", "\n")).alias("h"))


@query("image_sources", """SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/a/' || page_id || '.png' AS first_image, 'https://c.example.com/b.png' AS second_image, 2 AS n FROM pages""")
def image_sources(spark, d):
    salted = ("replace(html, '<article>', concat('<article><img src=\"/a/', page_id, '.png\"><img src=\"/x.png\" data-original=\" /a/', page_id, '.png\">"
              "<img srcset=\"//c.example.com/b.png 1x, /d.png 2x\"><img alt=\"none\">'))")
    x = _nodes(spark, d, salted).select("page_id", M.image_sources("nodes", _article(), "url").alias("i"))
    return x.select("page_id", F.get("i", F.lit(0)).alias("first_image"), F.get("i", F.lit(1)).alias("second_image"), F.size("i").alias("n"))


@query("chapter_links", """WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">', 1)) AS href FROM pages)
  SELECT page_id, 'V1' AS volume, count(*) AS n FROM l WHERE regexp_matches(href, '^/[^?#]') GROUP BY ALL UNION ALL SELECT page_id, 'Extra', 1 FROM pages
  UNION ALL SELECT page_id, 'V1 end', 1 FROM pages UNION ALL SELECT page_id, 'Intro', 1 FROM pages""")
def chapter_links(spark, d):
    salted = ("replace(replace(html, '<nav><ul>', '<nav><p>Intro</p><a href=\"/start\">s</a><p>no volume</p><h3>V1</h3><ul>'), '</ul></nav>', "
              "'</ul><details><summary>Extra</summary><a href=\"/zz1\" data-title=\" Z \"></a></details><a href=\"https://h.example.com/zz2?x\">last</a><a href=\"/t\"> </a></nav>')")
    x = _nodes(spark, d, salted).select("page_id", F.explode(M.chapter_links("nodes", M.first(M.select("nodes", "nav")), "^/(.+)$")).alias("c"))
    volume = F.when(F.col("c.id") == "zz2", F.concat("c.volume", F.lit(" end"))).otherwise(F.col("c.volume"))
    return x.groupBy("page_id", volume.alias("volume")).agg(F.count(F.lit(1)).alias("n"))


@query("volume_lists", """WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a>')) AS a FROM pages)
  SELECT page_id, 'Vol ' || page_id AS volume, count(*) AS n FROM l GROUP BY page_id UNION ALL SELECT page_id, '正文', 1 FROM pages""")
def volume_lists(spark, d):
    salted = ("replace(html, '<ul>', concat('<ul class=\"chapter-list\"><li><a href=\"/first.html\">F</a></li><div class=\"volume\"> Vol ', page_id, '</div>'))")
    x = _nodes(spark, d, salted)
    rows = M.list_entries("nodes", M.select("nodes", "ul", "chapter-list"), lambda c: (c["tag"] == "div") & M.has_class(c, "volume"),
                          lambda c: c["tag"] == "li", "正文")
    return x.select("page_id", F.explode(rows).alias("e")).groupBy("page_id", F.col("e.volume").alias("volume")).agg(F.count(F.lit(1)).alias("n"))


@query("marked_chapter_list", """WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">', 1)) AS href FROM pages)
  SELECT page_id, href, count(*) AS n FROM l GROUP BY ALL""")
def marked_chapter_list(spark, d):
    """Links after the body heading of a definition list; pages without the heading give all."""
    salted = ("replace(replace(replace(replace(html, '<ul>', CASE WHEN page_id % 2 = 0 THEN '<dl id=\"list\"><dt>最新</dt><dd><a href=\"/new\">n</a></dd><dt> 正文 </dt>'"
              " ELSE '<dl id=\"list\"><dt>其它</dt>' END), '</ul>', '</dl>'), '<li>', '<dd>'), '</li>', '</dd>')")
    x = _nodes(spark, d, salted)
    kids = M.children("nodes", M.first(M.select("nodes", "dl", id="list")), ["dt", "dd"])
    rows = x.select("page_id", F.posexplode(F.transform(kids, lambda k: F.struct(
        k["tag"].alias("tag"), clean_text(M.node_text("nodes", k)).alias("text"),
        M.attr(M.first(M.select(M.subtree("nodes", k), "a")), "href").alias("href")))).alias("i", "k"))
    marker = (F.col("k.tag") == "dt") & F.contains("k.text", F.lit("正文"))
    kept = collect_after_marker(rows, ["page_id"], "i", marker).filter(F.col("k.tag") == "dd")
    return kept.groupBy("page_id", F.col("k.href").alias("href")).agg(F.count(F.lit(1)).alias("n"))


@query("page_fragment", """SELECT page_id, md5(regexp_extract(html, '(?s)<div class="ad">.*?</div>', 0)) AS h FROM pages""")
def page_fragment(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(M.fragment("html", 'class="ad"')).alias("h"))


@query("multi_page_chapters", f"""WITH x AS (SELECT conv_id, turn, {sql_clean('text')} AS t FROM conversations)
  SELECT conv_id, md5(string_agg(t, chr(10) ORDER BY turn)) AS h, 'Title 1' AS title FROM x GROUP BY conv_id HAVING max(turn) >= 1""")
def multi_page_chapters(spark, d):
    """Conversations as chapters over several pages: lines cleaned, end mark cut, in page order."""
    html = F.concat(F.when(F.col("turn") > 0, F.concat(F.lit("<div class='bookname'><h1>Title "), F.col("turn"), F.lit("</h1></div>"))).otherwise(F.lit("")),
                    F.lit("<div id='content'><p>"), F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                    F.lit("</p><p>点击下一页</p></div>"))
    x = P.with_nodes(table(spark, d, "conversations").select("conv_id", "turn", html.alias("html")))
    from ..operators.lines import clean_body_lines
    body = M.node_text_breaks("nodes", M.first(M.select(M.subtree("nodes", M.first(M.select("nodes", id="content"))), "p")))
    title = clean_text(M.node_text("nodes", M.first(M.within(M.select("nodes", "h1"), M.select("nodes", cls="bookname")))))
    rows = x.select("conv_id", "turn", F.array_join(clean_body_lines(body, "next_page"), "\n").alias("body"), title.alias("title"))
    parts = join_text(rows.filter("body <> ''"), ["conv_id"], "turn", "body", "\n", F.lit(0))  # a chapter is one text
    titles = rows.groupBy("conv_id").agg(F.min_by("title", F.when(F.col("title") != "", F.col("turn"))).alias("title"))
    return parts.join(titles, "conv_id").filter("title IS NOT NULL").select("conv_id", F.md5("body").alias("h"), "title")


# ---- markup derived from the part table ------------------------------------------------------------

#: Bytes of the part table, some 7,000 rows, whose markup one task reads.
MARKUP_BYTES = 1 << 16


def _parts(spark, d):
    """Parts for markup: a small file becomes a thousand times as much work."""
    part = table(spark, d, "part")
    return in_pieces(part, part, MARKUP_BYTES)


def _cards(spark, d):
    html = F.concat(
        F.lit('<dl><dt><img src="/i/'), F.col("p_partkey"), F.lit('.jpg"></dt><dd><h3><a href="/tag/1">no</a><a href="/book/'), F.col("p_partkey"),
        F.lit('/">[cat] '), F.col("p_name"), F.lit('</a></h3></dd><dd class="book_other">作者：<span>'), F.col("p_brand"),
        F.lit('</span></dd><dd class="book_other">最新章节：<a href="/c">Chapter '), F.col("p_size"),
        F.lit('</a></dd></dl><dl><dt>x</dt><dd><h3><a href="/other">y</a></h3></dd></dl>'),
        F.lit('<dl><dt>x</dt><dd><h3><a href="/book/'), F.col("p_partkey"), F.lit('/">again</a></h3></dd></dl>'))
    return P.with_nodes(_parts(spark, d).select("p_partkey", F.lit("https://s.example.com/search?q=1").alias("url"), html.alias("html")))


@query("search_cards", """SELECT CAST(p_partkey AS VARCHAR) AS book_id, p_name AS title, p_brand AS author, 'https://s.example.com/book/' || p_partkey || '/' AS url,
  'Chapter ' || p_size AS latest_chapter, 'https://s.example.com/i/' || p_partkey || '.jpg' AS cover_url FROM part""")
def search_cards(spark, d):
    c = M.search_cards("nodes", "url", r"^/book/(\d+)/?$", "作者：", "最新章节：")
    rows = _cards(spark, d).select("p_partkey", F.posexplode(c).alias("i", "c")).select(F.lit("s").alias("site"), "c.*", F.struct("p_partkey", "i").alias("ord"))
    return dedupe_hits(rows).drop("site", "ord")


def _store(spark, d):
    html = F.concat(
        F.lit('<em id="pagestats">1/'), F.col("p_size"), F.lit('</em><div class="bookbox"><div class="bookimg"><img src="/no.png" data-original="/img/'), F.col("p_partkey"),
        F.lit('.png"></div><div class="bookname"><a href="/novel/'), F.col("p_partkey"), F.lit('.html"> '), F.col("p_name"),
        F.lit(' </a></div><div class="bookilnk"><span>'), F.col("p_brand"), F.lit('</span><span>x</span></div><div class="bookintro">a<br>b '), F.col("p_type"),
        F.lit('</div></div><div class="bookbox"><div class="bookname"><a href="/x">bad</a></div></div><a class="last" href="/w/list_77_0.html">l</a>'))
    return P.with_nodes(_parts(spark, d).select("p_partkey", F.lit("https://s.example.com/w/").alias("url"), html.alias("html")))


@query("store_boxes", """SELECT CAST(p_partkey AS VARCHAR) AS book_id, p_name AS title, p_brand AS author, 'a' || chr(10) || 'b ' || p_type AS description,
  'https://s.example.com/img/' || p_partkey || '.png' AS cover_url, greatest(1, p_size) AS total_pages FROM part""")
def store_boxes(spark, d):
    x = _store(spark, d)
    n = F.col("nodes")
    stats = M.node_text(n, M.first(M.select(n, id="pagestats")))
    pages = M.page_total(stats, M.attr(M.first(M.select(n, "a", "last")), "href"), r"_(\d+)_0\.html$")
    rows = x.select(pages.alias("total_pages"), F.explode(M.store_boxes("nodes", "url", r"^/novel/(\d+)\.html$")).alias("b"))
    return rows.select("b.book_id", "b.title", "b.author", "b.description", "b.cover_url", "total_pages")


@query("detail_pages", """SELECT CAST(p_partkey AS VARCHAR) AS book_id, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE p_name END AS title,
  CASE p_partkey % 4 WHEN 0 THEN 'Unknown' ELSE p_brand END AS author, 'one' || chr(10) || p_type AS description, 'https://s.example.com/g.png' AS cover_url FROM part""")
def detail_pages(spark, d):
    html = F.concat(
        F.lit('<h2 class="p text-normal"> '), F.when(F.col("p_partkey") % 3 != 0, F.col("p_name")).otherwise(F.lit("")), F.lit('<b>x</b></h2><ul><li>状态: ok</li>'),
        F.expr("CASE p_partkey % 4 WHEN 0 THEN '<li>none</li>' WHEN 1 THEN concat('<li>作者: ', p_brand, '</li>') ELSE concat('<li>作者: <a href=\"/a\">', p_brand, '</a></li>') END"),
        F.lit('</ul><div class="product-gallery"><a><img src="../g.png"></a></div><div class="description"><p>one</p><p> </p><p>'), F.col("p_type"), F.lit('</p><span>no</span></div>'))
    # the heading of every third part is empty, and its first text is then that of the bold part
    html = F.when(F.col("p_partkey") % 3 == 0, F.replace(html, F.lit("<b>x</b>"), F.lit(""))).otherwise(html)
    x = P.with_nodes(_parts(spark, d).select(F.col("p_partkey").cast("string").alias("id"), F.lit("https://s.example.com/detail/1.html").alias("url"), html.alias("html")))
    return x.select(M.detail_page("nodes", "url", "id", "作者").alias("b")).select("b.book_id", "b.title", "b.author", "b.description", "b.cover_url")


@query("max_page_numbers", "SELECT p_partkey, greatest(1, p_size, p_partkey % 300) AS pages, CASE WHEN p_partkey % 300 > 100 THEN greatest(1, p_size) ELSE greatest(1, p_size, p_partkey % 300) END AS capped FROM part")
def max_page_numbers(spark, d):
    html = F.concat(F.lit("<a href='/x/index_"), F.col("p_size"), F.lit(".html'>a</a><a href=\"index_"), F.col("p_partkey") % 300, F.lit('.html">b</a><a href="index_a.html">'))
    pattern = r"""href=["'][^"']*index_(\d+)\.html"""
    return table(spark, d, "part").select("p_partkey", M.max_page(html, pattern).alias("pages"), M.max_page(html, pattern, 100).alias("capped"))


@query("zipped_title_lists", "SELECT p_partkey, CAST(p_partkey + i AS VARCHAR) AS id, CASE i WHEN 0 THEN p_name ELSE p_brand END AS title FROM part, (VALUES (0), (1)) v(i) WHERE p_partkey % 5 <> 0")
def zipped_title_lists(spark, d):
    m = F.concat(F.lit("var a = '"), F.col("p_partkey"), F.lit(", "), F.col("p_partkey") + 1, F.when(F.col("p_partkey") % 5 != 0, F.lit(",9")).otherwise(F.lit("")),
                 F.lit("'.split(','); b=\""), F.col("p_name"), F.lit(" , "), F.col("p_brand"), F.lit("\".split( ',' )"))
    return table(spark, d, "part").select("p_partkey", F.explode(M.zipped_titles(m)).alias("id", "title"))


# ---- catalogs and snapshots ---------------------------------------------------------------------------

#: Text of a page, its bytes in a charset, and what they read as.
_CHARSETS = [("GB2312", "C4E3BAC3", "你好"), ("gbk", "D6D0FF41", "中\ufffdA"), ("Big5", "A7DAAD CC".replace(" ", ""), "我們"), ("Shift_JIS", "93FA967B8340", "日本ァ"),
             ("euc-kr", "C7D1B1DB", "한글"), ("windows-1252", "E98093", "é€“"), ("utf-8", "E4BDA0FFE5A5BD", "你\ufffd好"), ("none", "E4BDA0", "你"), ("none", "E920", "é "),
             ("utf-16le", "604F0000", "你\x00"), ("EUC-JP", "C6FCCBDC", "日本"), ("windows-1251", "CFF0E8", "При"), ("koi8-r", "F0D2C9", "При")]


def _charset_sql(i, text):
    return f"WHEN {i} THEN " + " || ".join(f"chr({ord(c)})" for c in text)


@query("decoded_pages", f"""SELECT page_id, md5(regexp_replace(html, '[^ -~]|charset', '', 'g') || CASE page_id % {len(_CHARSETS)} {' '.join(_charset_sql(i, t) for i, (_, _, t) in enumerate(_CHARSETS) if i != 9)}
  ELSE '' END) AS h, page_id % {len(_CHARSETS)} AS kind FROM pages WHERE page_id % {len(_CHARSETS)} <> 9
  UNION ALL SELECT page_id, md5(chr(20320)) AS h, 9 AS kind FROM pages WHERE page_id % {len(_CHARSETS)} = 9""")
def decoded_pages(spark, d):
    """Pages with a tail in one of thirteen charsets, some broken, named by the content type or a meta tag."""
    n = len(_CHARSETS)
    kind = F.col("page_id") % n
    chosen = lambda values: F.element_at(F.array(*map(F.lit, values)), (kind + 1).cast("int"))
    plain = F.regexp_replace("html", "[^ -~]|charset", "")
    label, tail = chosen([c for c, _, _ in _CHARSETS]), F.unhex(chosen([b for _, b, _ in _CHARSETS]))
    x = table(spark, d, "pages").select(
        "page_id", kind.alias("kind"), F.when(kind == 9, F.unhex(F.lit("FFFE604F"))).otherwise(F.concat(plain.cast("binary"), tail)).alias("body"),
        F.when((label != "none") & (kind % 2 == 0), F.concat(F.lit("text/html; charset="), label)).otherwise(F.lit("text/html")).alias("content_type"), label.alias("label"))
    # odd kinds name the charset in the page itself, which must not change what is compared
    tag = F.concat(F.lit('<meta charset="'), F.col("label"), F.lit('">'))
    inside = (F.col("kind") % 2 == 1) & (F.col("label") != "none") & (F.col("kind") != 9)
    x = x.withColumn("body", F.when(inside, F.concat(tag.cast("binary"), F.col("body"))).otherwise(F.col("body")))
    text = P.decoded("body", "content_type")
    return x.select("page_id", "kind", "label", text.alias("t")).select(
        "page_id", F.md5(F.when(inside, F.substring("t", F.char_length("label") + 18, F.char_length("t"))).otherwise(F.col("t"))).alias("h"), "kind")


@query("feed_hits", "SELECT CAST(p_partkey + i AS VARCHAR) AS book_id, min(p_partkey * 10 + i) AS first_at, arg_min(p_name || ' ' || i, p_partkey * 10 + i) AS title, "
       "arg_min(p_brand, p_partkey * 10 + i) AS author FROM part, (VALUES (0), (1)) v(i) GROUP BY 1")
def feed_hits(spark, d):
    item = lambda i: F.concat(F.lit("<item><title> "), F.replace("p_name", F.lit("&"), F.lit("&amp;")), F.lit(f" {i}</title><link>https://s.example.com/book/"),
                              F.col("p_partkey") + i, F.lit("/</link><author>"), F.col("p_brand"), F.lit("</author><pubDate>2024</pubDate></item>"))
    xml = F.concat(F.lit("<rss><channel>"), item(0), F.lit("<item><title> </title><link>https://s.example.com/book/5</link></item><item><title>z</title><link>/none</link></item>"),
                   item(1), F.lit("</channel></rss>"))
    feeds = table(spark, d, "part").select("p_partkey", xml.alias("xml"))
    hits = C.feed_hits(feeds, "xml", "s", r"^/book/(\d+)/?$", ["p_partkey"])
    at = F.col("first_seen.p_partkey") * 10 + F.when(F.col("first_seen._p") == 0, 0).otherwise(1)
    return hits.select("book_id", at.alias("first_at"), "title", "author")


@query("sitemap_ids", "SELECT CAST(l_partkey AS VARCHAR) AS book_id, min(l_orderkey) AS first_order FROM lineitem GROUP BY 1")
def sitemap_ids(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", F.concat(
        F.lit("<url><loc>https://s.example.com/modules/article/articleinfo.php?id="), F.col("l_partkey"), F.lit("</loc></url>")).alias("xml"))
    return C.sitemap_ids(li, "xml", r"modules/article/articleinfo\.php\?id=(\d+)", ["l_orderkey"]).select(
        "book_id", F.col("first_seen.l_orderkey").alias("first_order"))


@query("embedded_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id % 2 = 0 AS present FROM events")
def embedded_json(spark, d):
    m = F.concat(F.lit("<script>window.__STATE__="), F.lit('{"page":{"props":'), F.col("props"), F.lit("}};</script>"))
    x = table(spark, d, "events").select("event_id", C.embedded_json(m, r"__STATE__=(\{.*\});").alias("v"), F.when(F.col("event_id") % 2 == 0, m).otherwise(F.lit("none")).alias("m"))
    return x.select("event_id", C.json_at(F.col("v"), "$.page.props.k", "bigint").alias("k"),
                    C.embedded_json("m", r"__STATE__=(\{.*\});").isNotNull().alias("present"))


_VOL = """v AS (SELECT p_partkey AS k, 0 AS vp, 0 AS ip, CAST(p_partkey AS VARCHAR) AS id, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN '卷 1' ELSE p_brand END AS volume, p_partkey % 7 = 0 AS locked FROM part
  UNION ALL SELECT p_partkey, 0, 1, '9' || p_partkey, p_type, CASE WHEN p_partkey % 2 = 0 THEN '卷 1' ELSE p_brand END, false FROM part
  UNION ALL SELECT p_partkey, 1, 0, 'u' || p_size, p_type, CASE WHEN p_partkey % 3 = 0 THEN 'Vip part' ELSE '卷 2' END, p_partkey % 3 = 0 FROM part)"""


@query("volume_catalog", f"WITH {_VOL} SELECT k AS part, vp AS volume_pos, ip AS item_pos, id AS chapter_id, title, volume FROM v WHERE NOT locked")
def volume_catalog(spark, d):
    j = F.expr("""to_json(named_struct('data', named_struct('vs', array(
        named_struct('vN', CASE WHEN p_partkey % 2 = 0 THEN ' ' ELSE p_brand END, 'cs', array(
          named_struct('id', CAST(p_partkey AS STRING), 'uuid', '', 'cN', p_name, 'cU', '', 'isVip', p_partkey % 7 = 0),
          named_struct('id', '', 'uuid', '', 'cN', p_type, 'cU', concat('https://m.example.com/chapter/1/9', p_partkey, '/'), 'isVip', false),
          named_struct('id', '', 'uuid', '', 'cN', 'lost', 'cU', '/none', 'isVip', false))),
        named_struct('vN', CASE WHEN p_partkey % 3 = 0 THEN 'Vip part' ELSE '' END, 'cs', array(
          named_struct('id', '', 'uuid', concat('u', p_size), 'cN', p_type, 'cU', '', 'isVip', false)))))))""")
    x = table(spark, d, "part").select(F.col("p_partkey").alias("part"), j.alias("payload"))
    return C.volume_catalog(x, "payload", ["part"]).select("part", "volume_pos", "item_pos", "chapter_id", "title", "volume")


@query("listed_catalog", """SELECT p_partkey AS part, 0 AS volume_pos, CAST(p_partkey AS VARCHAR) AS chapter_id, p_brand AS volume, CASE WHEN p_size = 0 THEN p_partkey ELSE p_size END AS sort_key FROM part
  WHERE p_partkey % 4 <> 0 UNION ALL SELECT p_partkey, 1, '77', '卷 2', 77 FROM part""")
def listed_catalog(spark, d):
    j = F.expr("""to_json(named_struct('volumeNameList', array(p_brand, ' '), 'chapterListWithVolume', array(
        array(named_struct('itemId', CAST(p_partkey AS STRING), 'title', p_name, 'realChapterOrder', CAST(p_size AS STRING), 'isChapterLock', p_partkey % 4 = 0)),
        array(named_struct('itemId', '77', 'title', 't', 'realChapterOrder', '', 'isChapterLock', false)))))""")
    x = table(spark, d, "part").select(F.col("p_partkey").alias("part"), j.alias("payload"))
    return C.listed_catalog(x, "payload", ["part"]).select("part", "volume_pos", "chapter_id", "volume", "sort_key")


@query("json_tags", "SELECT p_partkey, p_brand || ',' || p_type AS tags FROM part")
def json_tags(spark, d):
    raw = F.concat(F.lit('[{"Name":"'), F.col("p_brand"), F.lit('"},{"Name":""},{"X":1},{"Name":"'), F.col("p_type"), F.lit('"}]'))
    return table(spark, d, "part").select("p_partkey", F.array_join(C.json_tags(raw), ",").alias("tags"))


def _snapshots(spark, d):
    """Every order is a snapshot of its customer's index; its line items are the entries."""
    o = table(spark, d, "orders").selectExpr("concat('c', o_custkey) AS site", "o_orderdate AS generated_at", "o_orderkey")
    return o.join(table(spark, d, "lineitem").selectExpr("l_orderkey AS o_orderkey", "CAST(l_partkey AS STRING) AS book_id"), "o_orderkey").drop("o_orderkey")


_SNAP = "snap AS (SELECT 'c' || o_custkey AS site, o_orderdate AS made, CAST(l_partkey AS VARCHAR) AS book_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"
_NOW = "2000-06-01"


@query("fresh_snapshots", f"WITH {_SNAP} SELECT site, count(*) AS n FROM snap WHERE made >= TIMESTAMP '{_NOW}' - INTERVAL 90 DAY GROUP BY site")
def fresh_snapshots(spark, d):
    s = N.fresh(_snapshots(spark, d), F.lit(_NOW).cast("timestamp_ntz"), 90)
    return s.groupBy("site").agg(F.count(F.lit(1)).alias("n"))


@query("usable_snapshots", f"""WITH {_SNAP}, m AS (SELECT site, max(made) AS made FROM snap GROUP BY site)
  SELECT s.site, s.book_id, count(*) AS n, s.made >= TIMESTAMP '{_NOW}' - INTERVAL 90 DAY AS is_fresh FROM snap s JOIN m ON m.site = s.site AND m.made = s.made GROUP BY ALL""")
def usable_snapshots(spark, d):
    s = N.usable(_snapshots(spark, d), F.lit(_NOW).cast("timestamp_ntz"), 90)
    return s.groupBy("site", "book_id", "is_fresh").agg(F.count(F.lit(1)).alias("n"))


@query("sources_to_rebuild", f"WITH {_SNAP} SELECT DISTINCT site FROM snap WHERE site NOT IN (SELECT site FROM snap WHERE made >= TIMESTAMP '{_NOW}' - INTERVAL 90 DAY)")
def sources_to_rebuild(spark, d):
    s = _snapshots(spark, d)
    return N.missing_sources(s.select("site").distinct(), s, F.lit(_NOW).cast("timestamp_ntz"), 90)


@query("refreshed_index", """WITH x AS (SELECT p_partkey, p_partkey % 6 AS s FROM part)
  SELECT 's' || s AS site, CASE WHEN s IN (2, 3, 4) THEN '' ELSE 'old' END || p_partkey AS book_id, s <> 5 AS is_fresh FROM x WHERE s NOT IN (2, 3, 4) OR p_partkey % 17 <> 0""")
def refreshed_index(spark, d):
    """Six sources: two with a fresh index, two with a stale one, one with none, one stale and out of reach."""
    now = F.lit("2024-03-01 12:00:00").cast("timestamp")
    source = F.concat(F.lit("s"), F.col("p_partkey") % 6)
    part = table(spark, d, "part").select("p_partkey", source.alias("site"), "p_name")
    path = f"{scratch_dir(spark)}/index"
    blank = [F.lit("").alias(c) for c in ("author", "description", "url", "latest_chapter", "cover_url")]
    old = part.filter("site <> 's4'").select("site", F.concat(F.lit("old"), "p_partkey").alias("book_id"), F.col("p_name").alias("title"), *blank)
    N.write_snapshot(old.filter("site IN ('s0', 's1')"), path, now - F.expr("INTERVAL 1 DAY"))
    N.write_snapshot(old, path, now - F.expr("INTERVAL 30 DAY"))
    listings = _cards(spark, d).withColumns({"site": source, "error": F.when((F.col("p_partkey") % 17 == 0) | (F.col("p_partkey") % 6 == 5), F.lit("http 404"))})
    cards = M.search_cards("nodes", "url", r"^/book/(\d+)/?$", "作者：", "最新章节：")

    def build(sources):
        hits = build_index(listings.join(sources, "site", "left_semi"), cards, ["p_partkey"])
        return hits.withColumns({c: F.lit("") for c in N.ITEM if c not in hits.columns})

    return N.refreshed(spark, path, part.select("site"), build, now).select("site", "book_id", "is_fresh")


@query("scanned_pages", "SELECT url, md5(html) AS h, count(*) AS n FROM pages GROUP BY ALL")
def scanned_pages(spark, d):
    """Pages as a crawl table of raw bytes, written and scanned with its fixed schema."""
    path = f"{scratch_dir(spark)}/crawl"
    table(spark, d, "pages").select("url", F.lit("text/html; charset=utf-8").alias("content_type"), F.col("html").cast("binary").alias("body"),
                                    F.timestamp_micros("page_id").alias("fetched_at"), F.lit(1).alias("more")).write.parquet(path)
    x = P.scan_pages(spark, path)
    return x.groupBy("url", F.md5(P.decoded("body", "content_type")).alias("h")).agg(F.count(F.lit(1)).alias("n"))
