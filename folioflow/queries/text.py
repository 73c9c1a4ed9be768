"""Cleaning and text-rule queries over documents, conversations and pages."""

from __future__ import annotations

import itertools
import string

from pyspark.sql import functions as F

from ..functions import blocks as B
from ..functions import convert, labels
from ..functions import text as T
from ..operators import lines as L
from . import query
from .views import table

# White space for the SQL side, spelled out.
W = r"\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def sql_trim(c: str) -> str:
    return f"regexp_replace({c}, '^[{W}]+|[{W}]+$', '', 'g')"


def sql_clean(c: str) -> str:
    w = W.replace(r"\s", r"\t\f ")
    x = f"regexp_replace(replace({c}, chr(13), ''), '[{w}]+', ' ', 'g')"
    x = f"regexp_replace({x}, ' ?\\n[ \\n]*', chr(10), 'g')"
    return f"regexp_replace({x}, '^[ \\n]+|[ \\n]+$', '', 'g')"


def sql_norm(c: str) -> str:
    return f"regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}\\p{{Han}}]', '', 'g')"


# A body with every kind of white space around and inside it, built from the document text.
RAGGED = "concat('\u00a0 ', replace(text, '. ', ' \\t.\\r\\n\u3000\\n '), ' \u200b\u00a0')"
RAGGED_SQL = "chr(160) || ' ' || replace(text, '. ', ' ' || chr(9) || '.' || chr(13) || chr(10) || chr(12288) || chr(10) || ' ') || ' ' || chr(8203) || chr(160)"


def docs(spark, d):
    return table(spark, d, "documents")


def ragged(spark, d):
    return docs(spark, d).select("doc_id", F.expr(RAGGED).alias("raw"))


_RAGGED = f"r AS (SELECT doc_id, {RAGGED_SQL} AS raw FROM documents)"


@query("normalised_text", f"SELECT doc_id, md5({sql_norm('text')}) AS h, length({sql_norm('text')}) AS n FROM documents")
def normalised_text(spark, d):
    x = docs(spark, d).select("doc_id", T.norm("text").alias("t"))
    return x.select("doc_id", F.md5("t").alias("h"), F.char_length("t").cast("bigint").alias("n"))


@query("index_text", f"SELECT doc_id, md5({sql_norm(sql_trim('translate(text, ' + chr(39) + 'éè' + chr(39) + ', ' + chr(39) + 'ee' + chr(39) + ')'))}) AS h FROM documents")
def index_text(spark, d):
    return docs(spark, d).select("doc_id", F.md5(T.norm_index("text", {"é": "e", "è": "e"})).alias("h"))


@query("clean_text", f"WITH {_RAGGED} SELECT doc_id, md5({sql_clean('raw')}) AS h, "
       f"len(string_split({sql_clean('raw')}, chr(10))) AS n_lines FROM r")
def clean_text(spark, d):
    x = ragged(spark, d).select("doc_id", T.clean_text("raw").alias("t"))
    return x.select("doc_id", F.md5("t").alias("h"), F.size(F.split("t", "\n")).cast("bigint").alias("n_lines"))


@query("cleaner_stage", f"WITH {_RAGGED} SELECT doc_id, md5({sql_trim('replace(replace(replace(replace(raw, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(8203), ' + chr(39)*2 + '), chr(65279), ' + chr(39)*2 + ')')}) AS h FROM r")
def cleaner_stage(spark, d):
    return ragged(spark, d).select("doc_id", F.md5(T.cleaner("raw", remove_invisible=True)).alias("h"))


@query("compact_whitespace", f"WITH {_RAGGED} SELECT doc_id, md5({sql_trim('regexp_replace(raw, ' + chr(39) + '[ \\t\\n\\f\\r]+' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')}) AS h FROM r")
def compact_whitespace(spark, d):
    return ragged(spark, d).select("doc_id", F.md5(T.compact_whitespace("raw")).alias("h"))


@query("html_escape", r"""SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'),
  '"', '&#34;'), '''', '&#39;')) AS h, md5(replace(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'),
  '"', '&#34;'), '''', '&#39;'), chr(10), '<br/>')) AS hb FROM pages""")
def html_escape(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(T.html_escape("html")).alias("h"),
                                           F.md5(T.html_escape_breaks("html")).alias("hb"))


@query("export_spaces", "SELECT page_id, md5(replace(replace(replace(replace(replace(x, '&nbsp;', ' '), '&#160;', ' '), '&#xa0;', ' '), "
       "chr(160), ' '), chr(8239), ' ')) AS h FROM (SELECT page_id, replace(html, '&amp;', '&nbsp;' || chr(8239)) AS x FROM pages)")
def export_spaces(spark, d):
    x = F.replace("html", F.lit("&amp;"), F.lit("&nbsp;\u202f"))
    return table(spark, d, "pages").select("page_id", F.md5(T.export_spaces(x)).alias("h"))


@query("first_non_blank", "SELECT o_orderkey, CASE WHEN trim(a) <> '' THEN a WHEN trim(b) <> '' THEN b ELSE c END AS v FROM "
       "(SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN chr(160) ELSE o_orderpriority END AS a, "
       "CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END AS b, 'last' AS c FROM orders)")
def first_non_blank(spark, d):
    o = table(spark, d, "orders").selectExpr(
        "o_orderkey", "CASE WHEN o_orderkey % 2 = 0 THEN '\u00a0' ELSE o_orderpriority END AS a",
        "CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END AS b", "'last' AS c")
    return o.select("o_orderkey", T.first_non_blank("a", "b", "c").alias("v"))


@query("file_names", r"""SELECT page_id, regexp_replace(url, '[\\/:*?"<>|]+', '_', 'g') AS file_name,
  regexp_replace(url, '[\\/:*?"<>|]', '_', 'g') AS store_name FROM pages""")
def file_names(spark, d):
    return table(spark, d, "pages").select("page_id", T.file_name("url").alias("file_name"),
                                           T.store_name("url").alias("store_name"))


@query("substitution_map", "SELECT doc_id, md5(replace(replace(replace(text, 'e', '3'), 't', '+'), 'æ', 'ae')) AS h, "
       "md5(translate(text, 'aeo', '430')) AS h1 FROM documents")
def substitution_map(spark, d):
    return docs(spark, d).select("doc_id", F.md5(T.substitute("text", {"e": "3", "t": "+", "æ": "ae"})).alias("h"),
                                 F.md5(T.substitute("text", {"a": "4", "e": "3", "o": "0"})).alias("h1"))


@query("script_conversion", """SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN text ELSE
  replace(replace(text, 'é', 'e'), 'ü', 'u') END AS v FROM conversations""")
def script_conversion(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("v"))
    return convert.convert_columns(c, " Zh-Hans ", {"é": "e", "ü": "u"}, ["v"])


@query("phrase_conversion", "SELECT doc_id, md5(replace(replace(text, 'the', 'DAS'), 'of', 'VON')) AS h FROM documents")
def phrase_conversion(spark, d):
    x = convert.to_simplified("text", {"the": "DAS", "of": "VON"})
    return docs(spark, d).select("doc_id", x.alias("x")).select("doc_id", F.md5("x").alias("h"))


@query("phrase_table_conversion", r"""SELECT doc_id, md5(regexp_replace(text, '([etaoi][a-z]{3})|([a-z]{3})', '<\1|\2>', 'g')) AS h FROM documents""")
def phrase_table_conversion(spark, d):
    """A table of 105,456 phrases: all of three letters, and those of four that begin with a frequent one."""
    three = ["".join(x) for x in itertools.product(string.ascii_lowercase, repeat=3)]
    mapping = {x: f"<|{x}>" for x in three} | {c + x: f"<{c}{x}|>" for c in "etaoi" for x in three}
    x = convert.to_simplified("text", mapping)
    return docs(spark, d).select("doc_id", x.alias("x")).select("doc_id", F.md5("x").alias("h"))


@query("keyword_locale", "SELECT item_id, CASE WHEN item_id % 3 = 0 THEN replace(text, 'e', 'E') ELSE text END AS keyword FROM benchmark")
def keyword_locale(spark, d):
    b = table(spark, d, "benchmark")
    style = F.when(F.col("item_id") % 3 == 0, F.lit(" ZH_CN")).otherwise(F.lit("traditional"))
    return b.select("item_id", convert.keyword_for_locale("text", style, {"e": "E"}).alias("keyword"))


@query("title_cleanup", r"""WITH x AS (SELECT doc_id, lang, source, doc_id % 4 AS m FROM documents)
  SELECT doc_id, 'T ' || lang AS category_stripped, 'B ' || source AS book_title,
    CASE WHEN m = 3 THEN 'other ' ELSE '' END || 'C' || doc_id AS chapter_title, CASE WHEN m IN (0, 2) THEN '' ELSE 'B ' || source || ' ' END || 'part ' || doc_id AS without_book FROM x""")
def title_cleanup(spark, d):
    x = docs(spark, d).selectExpr(
        "doc_id", "concat('[cat', doc_id, '] T ', lang) AS t", "concat(' 《《B ', source, '》 ') AS b",
        "CASE doc_id % 4 WHEN 0 THEN concat('B ', source, ' 正文 C', doc_id) WHEN 1 THEN concat('正文C', doc_id) "
        "WHEN 2 THEN concat('B ', source, 'C', doc_id) ELSE concat('other C', doc_id) END AS c",
        "concat('  B ', source, '  part ', doc_id) AS p", "CASE WHEN doc_id % 2 = 0 THEN concat('B  ', source, ' ') ELSE concat('C ', source) END AS n")
    return x.select("doc_id", T.strip_book_name("p", "n").alias("without_book"), T.strip_category("t").alias("category_stripped"),
                    T.clean_book_title("b").alias("book_title"), T.clean_chapter_title("c", "b").alias("chapter_title"))


@query("label_strip", "SELECT doc_id, source AS author, lang AS description FROM documents")
def label_strip(spark, d):
    x = docs(spark, d).selectExpr("doc_id", "concat(' 作者：', source, '作品全集') AS a", "concat('内容简介: ', lang) AS s")
    return x.select("doc_id", T.clean_author("a").alias("author"), T.clean_description("s").alias("description"))


@query("summary_tail", f"SELECT doc_id, md5({sql_trim('text')}) AS h FROM documents")
def summary_tail(spark, d):
    x = docs(spark, d).selectExpr(
        "doc_id", "source", "CASE doc_id % 3 WHEN 0 THEN concat(text, '喜欢《x》', text) "
        "WHEN 1 THEN concat(text, '《', source, '》最新章节预览 tail') ELSE text END AS s")
    return x.select("doc_id", F.md5(T.trim_summary_tail("s", "source")).alias("h"))


@query("labelled_field", "SELECT doc_id, source AS author, lang AS status FROM documents")
def labelled_field(spark, d):
    x = docs(spark, d).selectExpr("doc_id", "concat('书名：T 作者：', source, ' 状态:', lang, ' 更新：', doc_id) AS s")
    return x.select("doc_id", T.labelled_field("s", "作者", ["进度", "状态"]).alias("author"),
                    T.labelled_field("s", "状态", ["更新"]).alias("status"))


@query("description_newlines", f"""SELECT doc_id, md5({sql_clean("replace(text, '. ', '.' || chr(10))")}) AS h FROM documents""")
def description_newlines(spark, d):
    x = docs(spark, d).select("doc_id", F.replace("text", F.lit(". "), F.lit(".\\r\\n")).alias("s"))
    return x.select("doc_id", F.md5(T.unescape_newlines("s")).alias("h"))


@query("markup_summary", f"""SELECT doc_id, md5({sql_trim("list_aggregate(list_transform(string_split(replace(text, '. ', chr(10)), chr(10)), lambda x: " + sql_trim("regexp_replace(x, '[ \\t\\n\\f\\r]+', ' ', 'g')") + "), 'string_agg', chr(10))")}) AS h FROM documents""")
def markup_summary(spark, d):
    x = docs(spark, d).select("doc_id", F.replace("text", F.lit(". "), F.lit("<br />&nbsp; ")).alias("s"))
    return x.select("doc_id", F.md5(T.clean_markup_summary("s")).alias("h"))


@query("nested_html_strip", r"""SELECT page_id, md5(regexp_replace(replace(replace(replace(replace(html, '<html>', ''), '</html>', ''),
  '<body>', ''), '</body>', ''), '(?is)<head>.*?</head>', '', 'g')) AS h FROM pages""")
def nested_html_strip(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(T.strip_nested_html("html")).alias("h"))


@query("tag_split", f"""WITH x AS (SELECT doc_id, unnest(string_split_regex({sql_trim('text')}, '[{W}]+')) AS tag FROM documents)
  SELECT doc_id, tag, count(*) AS n FROM x WHERE tag <> '' GROUP BY ALL""")
def tag_split(spark, d):
    x = docs(spark, d).select("doc_id", F.explode(T.split_tags(F.concat(F.lit("作品Tags："), "text"))).alias("tag"))
    return x.groupBy("doc_id", "tag").agg(F.count(F.lit(1)).alias("n"))


@query("distinct_tags", f"""WITH x AS (SELECT doc_id, unnest(string_split(text, '.')) AS p FROM documents),
  y AS (SELECT DISTINCT doc_id, {sql_clean('p')} AS tag FROM x) SELECT doc_id, tag FROM y WHERE tag <> ''""")
def distinct_tags(spark, d):
    return docs(spark, d).select("doc_id", F.explode(T.distinct_tags(F.split("text", r"\."))).alias("tag"))


@query("truncated_labels", "SELECT doc_id, CASE WHEN length(text) <= 40 THEN text ELSE left(text, 37) || '...' END AS short, "
       "left(text, 2) AS tiny, CASE WHEN doc_id % 2 = 0 THEN '-' ELSE lang END AS latest FROM documents")
def truncated_labels(spark, d):
    latest = F.when(F.col("doc_id") % 2 == 0, F.lit(" ")).otherwise(F.col("lang"))
    return docs(spark, d).select("doc_id", T.truncate_chars("text", 40).alias("short"),
                                 T.truncate_chars("text", 2).alias("tiny"), T.missing_label(latest).alias("latest"))


@query("leading_title_strip", f"SELECT doc_id, md5({sql_trim('text')}) AS h FROM documents")
def leading_title_strip(spark, d):
    x = docs(spark, d).selectExpr("doc_id", r"concat('\n CHAPTER  ', doc_id, ' \n', text) AS body", "concat('Chapter ', doc_id) AS t")
    return x.select("doc_id", F.md5(T.strip_leading_title("body", "t")).alias("h"))


@query("version_compare", """WITH v AS (SELECT l_orderkey, l_linenumber, l_quantity::INT AS a, l_partkey % 12 AS b, l_suppkey % 12 AS c FROM lineitem)
  SELECT l_orderkey, l_linenumber, CASE WHEN a > 25 OR (a = 25 AND b > c) THEN 1 WHEN a < 25 OR b < c THEN -1 ELSE 0 END AS cmp FROM v""")
def version_compare(spark, d):
    x = table(spark, d, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "concat(CAST(l_quantity AS INT), '.', l_partkey % 12, '.0') AS a",
        "concat('25.', l_suppkey % 12, '-rc') AS b")
    return x.select("l_orderkey", "l_linenumber", T.version_compare("a", "b").alias("cmp"))


@query("image_placeholders", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '[图片]' ELSE '[图片] ' || url END AS line FROM pages")
def image_placeholders(spark, d):
    u = F.when(F.col("page_id") % 2 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" "), "url"))
    return table(spark, d, "pages").select("page_id", B.image_placeholder(u).alias("line"))


# A document whose sentences become lines, with image markup added on its own lines.
MARKED = (r"concat(replace(text, '. ', '.\n\n'), '\n![a](https://i.example.com/', doc_id, '.png) tail<img src=\"/b.png\" "
          r"data-src=\" /c.png\">\n[插图] https://i.example.com/', source, '\n')")
_MARKED = r"""m AS (SELECT doc_id, source, replace(text, '. ', '.' || chr(10) || chr(10)) AS t FROM documents)"""


@query("inline_images", "SELECT doc_id, 'https://i.example.com/' || doc_id || '.png' AS first_url, '/c.png' AS second_url, "
       "2 AS n, md5(replace(text, '. ', '.' || chr(10) || chr(10)) || chr(10) || ' tail' || chr(10) || "
       "'[插图] https://i.example.com/' || source || chr(10)) AS stripped FROM documents")
def inline_images(spark, d):
    x = docs(spark, d).select("doc_id", F.expr(MARKED).alias("body"))
    x = x.select("doc_id", B.inline_images("body").alias("u"), F.md5(B.strip_inline_images("body")).alias("stripped"))
    return x.select("doc_id", F.get("u", F.lit(0)).alias("first_url"), F.get("u", F.lit(1)).alias("second_url"),
                    F.size("u").alias("n"), "stripped")


@query("chapter_blocks", f"""WITH {_MARKED},
  s AS (SELECT doc_id, unnest(string_split(t || chr(10) || 'tail', chr(10) || chr(10))) AS p FROM m),
  c AS (SELECT doc_id, count(*) FILTER (WHERE {sql_trim('p')} <> '') AS texts, sum(length({sql_clean('p')}))
    FILTER (WHERE {sql_trim('p')} <> '') AS chars FROM s GROUP BY doc_id)
  SELECT doc_id, texts, CAST(chars AS BIGINT) AS chars, CAST(3 AS BIGINT) AS images FROM c""")
def chapter_blocks(spark, d):
    x = docs(spark, d).select("doc_id", F.expr(MARKED).alias("body"))
    b = x.select("doc_id", F.explode(B.chapter_blocks("body")).alias("b"))
    text = F.col("b.kind") == "text"
    return b.groupBy("doc_id").agg(
        F.count_if(text).alias("texts"), F.sum(F.when(text, F.char_length(T.clean_text("b.paragraph")))).alias("chars"),
        F.count_if(~text).alias("images"))


@query("txt_bodies", f"""WITH s AS (SELECT doc_id, unnest(string_split(replace(text, '. ', '.' || chr(10)), chr(10))) AS line,
    generate_subscripts(string_split(replace(text, '. ', '.' || chr(10)), chr(10)), 1) AS i FROM documents)
  SELECT doc_id, md5(string_agg('    ' || {sql_trim('line')}, chr(10) || chr(10) || chr(10) ORDER BY i)) AS h
  FROM s WHERE {sql_trim('line')} <> '' GROUP BY doc_id""")
def txt_bodies(spark, d):
    body = F.replace("text", F.lit(". "), F.lit(".\n"))
    return docs(spark, d).select("doc_id", F.md5(B.txt_body(body)).alias("h"))


@query("paragraph_markup", f"""WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
  SELECT doc_id, md5(string_agg('<p class="novel-paragraph">' || replace(replace(replace(replace(replace({sql_trim('line')},
    '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&#34;'), '''', '&#39;') || '</p>', '' ORDER BY i)) AS h
  FROM s WHERE {sql_trim('line')} <> '' GROUP BY doc_id""")
def paragraph_markup(spark, d):
    return docs(spark, d).select("doc_id", F.md5(B.paragraph_markup("text")).alias("h"))


@query("data_images", "SELECT doc_id, 'image/png' AS media_type, md5(text) AS h FROM documents")
def data_images(spark, d):
    u = F.concat(F.lit("data:image/PNG;base64,"), F.base64(F.col("text").cast("binary")))
    x = docs(spark, d).select("doc_id", B.data_image(u).alias("i"))
    return x.select("doc_id", "i.media_type", F.md5("i.data").alias("h"))


# ---- line rules --------------------------------------------------------------------------------

# One marker line per document, by its id.
SALT = ("CASE doc_id % 8 WHEN 0 THEN '月票 now' WHEN 1 THEN 'see 推荐票' WHEN 2 THEN 'plain line' WHEN 3 THEN '' "
        "WHEN 4 THEN 'WWW.SHUHAIGE.NET x' WHEN 5 THEN '首 发 地 址' WHEN 6 THEN '第(1/3)页' ELSE ' 下一章 ' END")


def _salted(spark, d):
    """Sentences of every document as lines, plus one marker line each."""
    x = docs(spark, d).selectExpr("doc_id", "source AS site", f"concat(replace(text, '. ', '.\\n'), '\\n', {SALT}) AS body")
    return x.select("doc_id", "site", F.posexplode(F.split("body", "\n")).alias("i", "line"))


_SALTED = f"""b AS (SELECT doc_id, source AS site, string_split(replace(text, '. ', '.' || chr(10)) || chr(10) || {SALT}, chr(10)) AS ls
    FROM documents), l AS (SELECT doc_id, site, unnest(ls) AS line FROM b)"""


def _any(c, markers):
    return "(" + " OR ".join(f"contains({c}, '{m}')" for m in markers) + ")"


@query("ad_lines", f"""WITH {_SALTED} SELECT doc_id, count(*) FILTER (WHERE {_any('line', L.AD_MARKERS['votes'])}) AS votes,
    count(*) FILTER (WHERE trim(line) = '' OR {_any('lower(line)', L.AD_MARKERS['next_page'])}) AS next_page,
    count(*) FILTER (WHERE {_any('line', L.AD_MARKERS['paged_list'])}) AS paged_list,
    count(*) FILTER (WHERE trim(line) = '' OR {_any('line', L.AD_MARKERS['key_hints'])}) AS key_hints,
    count(*) FILTER (WHERE trim(line) = '' OR {_any('line', L.AD_MARKERS['numbered_host'])}) AS numbered_host,
    count(*) FILTER (WHERE trim(line) = '' OR {_any('line', L.AD_MARKERS['short_host'])}) AS short_host
  FROM l GROUP BY doc_id""")
def ad_lines(spark, d):
    rules = ["votes", "next_page", "paged_list", "key_hints", "numbered_host", "short_host"]
    return _salted(spark, d).groupBy("doc_id").agg(*[F.count_if(L.is_ad_line("line", r)).alias(r) for r in rules])


@query("ad_lines_by_source", f"""WITH {_SALTED}, r AS (SELECT 'src' || n_nationkey AS site, n_nationkey AS k FROM nation)
  SELECT l.site, count(*) AS n_lines, count(*) FILTER (WHERE k IS NOT NULL AND (contains(line, '月票') OR
    contains(line, ' ' || k || ' ') OR contains(line, '票'))) AS ads FROM l LEFT JOIN r ON l.site = r.site GROUP BY l.site""")
def ad_lines_by_source(spark, d):
    rules = table(spark, d, "nation").select(
        F.concat(F.lit("src"), "n_nationkey").alias("site"),
        F.explode(F.array(F.lit("月票"), F.lit("票"), F.concat(F.lit(" "), "n_nationkey", F.lit(" ")))).alias("marker"))
    m = L.marked_lines(_salted(spark, d), rules)
    return m.groupBy("site").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if("is_ad").alias("ads"))


@query("ad_lines_compact", f"""WITH {_SALTED} SELECT doc_id, count(*) FILTER (WHERE {_any('line', L.AD_MARKERS['spaced'])} OR
  {_any("replace(line, ' ', '')", L.AD_MARKERS['spaced'])}) AS n FROM l GROUP BY doc_id""")
def ad_lines_compact(spark, d):
    return _salted(spark, d).groupBy("doc_id").agg(F.count_if(L.is_ad_line("line", "spaced")).alias("n"))


@query("ad_lines_lookalike", "SELECT doc_id, doc_id % 4 < 2 AS is_ad FROM documents")
def ad_lines_lookalike(spark, d):
    line = F.expr("CASE doc_id % 4 WHEN 0 THEN ' ８ＮovEL。Com ' WHEN 1 THEN '8NOxEL.Cxm' WHEN 2 THEN '8xOxxL.Com' ELSE text END")
    return docs(spark, d).select("doc_id", L.is_lookalike_line(line).alias("is_ad"))


@query("navigation_lines", f"WITH {_SALTED} SELECT doc_id, count(*) FILTER (WHERE trim(line) IN ('上一章', '目录', '下一章')) AS nav, "
       r"count(*) FILTER (WHERE regexp_matches(trim(line), '^第\(.*/.*\)页$')) AS indicators FROM l GROUP BY doc_id")
def navigation_lines(spark, d):
    return _salted(spark, d).groupBy("doc_id").agg(F.count_if(L.is_navigation_line("line")).alias("nav"),
                                                   F.count_if(L.is_page_indicator("line")).alias("indicators"))


@query("unsupported_paragraphs", f"""SELECT doc_id, md5({sql_trim('text')}) AS h, doc_id % 2 = 0 AS unsupported FROM documents""")
def unsupported_paragraphs(spark, d):
    x = docs(spark, d).selectExpr("doc_id", "concat('（内容加载失败！） ', text, '内容加载失败！') AS p",
                                  "CASE WHEN doc_id % 2 = 0 THEN concat(text, '请考虑使用 x') ELSE text END AS q")
    return x.select("doc_id", F.md5(L.drop_load_failures("p")).alias("h"),
                    L.is_ad_line("q", "browser_hint").alias("unsupported"))


@query("clean_body_lines", f"""WITH b AS (SELECT doc_id, string_split({sql_clean("text || chr(10) || " + SALT)}, chr(10)) AS ls FROM documents),
  l AS (SELECT doc_id, unnest(ls) AS line FROM b)
  SELECT doc_id, count(*) FILTER (WHERE NOT ({_any('lower(line)', L.AD_MARKERS['next_page'])}) AND line <> '') AS kept FROM l GROUP BY doc_id""")
def clean_body_lines(spark, d):
    body = F.concat("text", F.lit("(本章完)\n"), F.expr(SALT))
    return docs(spark, d).select("doc_id", F.size(L.clean_body_lines(body, "next_page")).cast("bigint").alias("kept"))


@query("reusable_bodies", """SELECT doc_id, doc_id % 4 = 3 AND trim(text) <> '' AS reusable,
  doc_id % 4 = 3 AND trim(text) <> '' AND length(trim(text)) >= 400 AS reusable_strict FROM documents""")
def reusable_bodies(spark, d):
    x = docs(spark, d).selectExpr("doc_id", r"""CASE doc_id % 4 WHEN 0 THEN concat(text, '\n [插图] \n', text)
        WHEN 1 THEN concat('[圖片] https://x.example.com\n', text) WHEN 2 THEN '\u200b\u200c \ufeff' ELSE text END AS c""")
    return x.select("doc_id", L.is_reusable("c").alias("reusable"), L.is_reusable_for("c", 400).alias("reusable_strict"))


@query("page_quality", "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'login' WHEN 1 THEN 'password' WHEN 2 THEN 'locked' "
       "WHEN 3 THEN 'probe' ELSE 'ok' END AS status FROM pages")
def page_quality(spark, d):
    salt = F.expr("""CASE page_id % 5 WHEN 0 THEN '<a href="/my/login">' WHEN 1 THEN 'btn-send-pw' WHEN 2 THEN '需要订阅'
        WHEN 3 THEN '/C2WF946J0/probe.js' ELSE '' END""")
    return table(spark, d, "pages").select("page_id", L.page_status(F.concat("html", salt)).alias("status"))


_ERR = ("CASE event_type WHEN 'click' THEN 'GET x: HTTP 503 for ' WHEN 'error' THEN 'http 404 for ' WHEN 'view' THEN 'Client.Timeout exceeded ' "
        "WHEN 'signup' THEN '' ELSE 'bad certificate ' END")


@query("error_classes", """SELECT event_id, CASE event_type WHEN 'click' THEN 'retry' WHEN 'error' THEN 'gone' WHEN 'view' THEN 'retry'
  WHEN 'signup' THEN '' ELSE 'fatal' END AS error_class, CASE event_type WHEN 'view' THEN 'timeout' ELSE 'other' END AS warning_class FROM events""")
def error_classes(spark, d):
    e = table(spark, d, "events").select("event_id", F.expr(_ERR).alias("m"))
    return e.select("event_id", L.error_class("m").alias("error_class"), L.warning_class("m").alias("warning_class"))


# ---- labels and identifiers ----------------------------------------------------------------------

@query("eta_and_percent", """WITH x AS (SELECT o_orderkey, o_custkey % 40 AS done, o_custkey % 40 + o_orderkey % 9000 - 5 AS total,
    CASE WHEN o_orderkey % 5 = 0 THEN 0.0 ELSE 0.25 END AS rate FROM orders),
  y AS (SELECT *, CASE WHEN rate > 0 THEN greatest(total - done, 0) / rate END AS s FROM x),
  z AS (SELECT *, CAST(floor(s) AS BIGINT) AS w FROM y)
  SELECT o_orderkey, CASE WHEN s IS NULL THEN '' WHEN s <= 0 THEN '0s'
    WHEN w >= 3600 THEN (w // 3600) || '小时' || (w // 60 % 60) || '分'
    WHEN w >= 60 THEN (w // 60) || '分' || (w % 60) || '秒' ELSE w || '秒' END AS eta,
    CASE WHEN s IS NULL THEN '' WHEN s <= 0 THEN '0s' WHEN w >= 3600 THEN (w // 3600) || '小时' || (w // 60 % 60) || '分' || (w % 60) || '秒'
    WHEN w >= 60 THEN (w // 60) || '分' || (w % 60) || '秒' ELSE w || '秒' END AS elapsed,
    CASE WHEN total = 0 THEN 0 ELSE least(100, CAST(floor(done::DOUBLE / total * 100 + 0.5) AS BIGINT)) END AS pct FROM z""")
def eta_and_percent(spark, d):
    x = table(spark, d, "orders").selectExpr(
        "o_orderkey", "o_custkey % 40 AS done", "o_custkey % 40 + o_orderkey % 9000 - 5 AS total",
        "CASE WHEN o_orderkey % 5 = 0 THEN 0.0D ELSE 0.25D END AS rate")
    x = x.withColumn("s", labels.eta_seconds("done", "total", "rate"))
    return x.select("o_orderkey", labels.eta_label("s").alias("eta"),
                    F.coalesce(labels.elapsed_label("s"), F.lit("")).alias("elapsed"),
                    labels.percent("done", "total").alias("pct"))


@query("chapter_keys", "SELECT l_orderkey, l_linenumber, 's/' || l_orderkey || '/' || CASE WHEN l_linenumber % 3 = 0 THEN "
       "'u' || l_partkey WHEN l_linenumber % 3 = 1 THEN CAST(l_linenumber AS VARCHAR) ELSE 't' || l_suppkey END AS chapter_key FROM lineitem")
def chapter_keys(spark, d):
    x = table(spark, d, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "CASE WHEN l_linenumber % 3 = 1 THEN CAST(l_linenumber AS STRING) ELSE '' END AS id",
        "CASE WHEN l_linenumber % 3 = 2 THEN ' ' ELSE concat('u', l_partkey) END AS url", "concat('t', l_suppkey) AS title")
    return x.select("l_orderkey", "l_linenumber", labels.chapter_key(
        F.lit("s"), F.col("l_orderkey").cast("string"), "id", "url", "title").alias("chapter_key"))


@query("book_uuids", """WITH h AS (SELECT p_partkey, sha1('catalog:' || p_partkey || ':' || p_name) AS h FROM part)
  SELECT p_partkey, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' ||
    CASE WHEN h[17] IN ('0', '4', '8', 'c') THEN '8' WHEN h[17] IN ('1', '5', '9', 'd') THEN '9'
      WHEN h[17] IN ('2', '6', 'a', 'e') THEN 'a' ELSE 'b' END || h[18:20] || '-' || h[21:32] AS uuid FROM h""")
def book_uuids(spark, d):
    return table(spark, d, "part").select("p_partkey", labels.book_uuid(
        F.lit("catalog"), F.col("p_partkey").cast("string"), "p_name").alias("uuid"))
