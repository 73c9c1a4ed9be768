"""Library queries: documents and line items as chapters of books."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import library as L
from ..plans.ordering import block_of, number_rows
from ..plans.stages import register_step, staged
from . import query
from .text import sql_trim
from .views import CHAPTERS, HITS, chapters, hits, table, turns


def _plan(spark, d):
    return chapters(spark, d).withColumn("content", F.lit("")).withColumn("downloaded", F.lit(False))


def _stored(spark, d):
    """Labelled documents are stored; toxic ones only as an image placeholder."""
    lab = table(spark, d, "labels")
    return chapters(spark, d).join(lab, "doc_id").selectExpr(
        "site", "book_id", "chapter_id", "concat('Stored ', chapter_id) AS title",
        r"CASE WHEN toxic = 1 THEN concat(content, '\n[图片]') WHEN quality = 0 AND doc_id % 2 = 0 THEN 'short' ELSE content END AS content",
        "url", "volume", "order_index", "doc_id % 2 = 0 AS downloaded")


_STORED = """stored AS (SELECT c.site, c.book_id, c.chapter_id, 'Stored ' || c.chapter_id AS title, toxic, c.doc_id,
    CASE WHEN quality = 0 AND c.doc_id % 2 = 0 THEN 'short' ELSE content END AS content
  FROM chapters c JOIN labels l ON c.doc_id = l.doc_id)"""


def _strict(spark, d):
    return table(spark, d, "nation").selectExpr("concat('src', n_nationkey) AS site",
                                                "CASE WHEN n_nationkey < 10 THEN 20 ELSE 0 END AS min_content_len")


_OK = "toxic = 0 AND (length(content) >= 20 OR CAST(site[4:] AS INT) >= 10)"


@query("merge_stored_chapters", f"""WITH {CHAPTERS}, {_STORED}, ok AS (SELECT * FROM stored WHERE {_OK})
  SELECT c.chapter_id, CASE WHEN o.chapter_id IS NOT NULL AND c.title = '' THEN o.title ELSE c.title END AS title,
    md5(coalesce(o.content, '')) AS h, o.chapter_id IS NOT NULL AS downloaded
  FROM chapters c LEFT JOIN ok o ON c.site = o.site AND c.chapter_id = o.chapter_id""")
def merge_stored(spark, d):
    m = L.merge_stored(_plan(spark, d), _stored(spark, d), _strict(spark, d))
    return m.select("chapter_id", "title", F.md5("content").alias("h"), "downloaded")


@query("pending_chapters", f"""WITH {CHAPTERS}, {_STORED}, ok AS (SELECT * FROM stored WHERE {_OK})
  SELECT site, count(*) AS pending, min(doc_id) AS first_doc FROM chapters c
  WHERE NOT EXISTS (SELECT 1 FROM ok o WHERE o.chapter_id = c.chapter_id) GROUP BY site""")
def pending_chapters(spark, d):
    p = L.pending_chapters(_plan(spark, d).drop("content"), _stored(spark, d), _strict(spark, d))
    return p.groupBy("site").agg(F.count(F.lit(1)).alias("pending"), F.min("doc_id").alias("first_doc"))


# A supplier's line items are its chapter list; a part listed twice is the same chapter.
def _listing(spark, d):
    return table(spark, d, "lineitem").selectExpr(
        "'catalog' AS site", "CAST(nullif(l_suppkey, 3) AS STRING) AS book_id",
        "CASE WHEN l_partkey % 50 = 0 THEN '' ELSE CAST(l_partkey AS STRING) END AS chapter_id",
        "(l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey AS pos", "l_returnflag AS title")


_LISTING = """listing AS (SELECT CAST(nullif(l_suppkey, 3) AS VARCHAR) AS book_id, CASE WHEN l_partkey % 50 = 0 THEN '' ELSE
    CAST(l_partkey AS VARCHAR) END AS chapter_id, (l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey AS pos, l_returnflag AS title FROM lineitem),
  once AS (SELECT book_id, chapter_id, min(pos) AS pos, arg_min(title, pos) AS title FROM listing WHERE chapter_id <> '' GROUP BY 1, 2),
  numbered AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY pos) AS order_index FROM once)"""


def _numbered(spark, d):
    # ten thousand orders to a block
    return L.dedupe_chapters(_listing(spark, d), "pos", block_of("pos", 10 ** 12))


@query("dedupe_chapters", f"WITH {_LISTING} SELECT book_id, chapter_id, title, order_index FROM numbered")
def dedupe_chapters(spark, d):
    return _numbered(spark, d).select("book_id", "chapter_id", "title", "order_index")


@query("renumber_chapters", """SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY nullif(l_suppkey, 5) ORDER BY
  pos NULLS FIRST, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS n FROM (SELECT *, CASE WHEN l_orderkey % 70 = 1 THEN NULL ELSE l_orderkey * 10 + l_linenumber END AS pos FROM lineitem)""")
def renumber_chapters(spark, d):
    """Line items of a supplier in order; some have no supplier, some no order."""
    li = table(spark, d, "lineitem").selectExpr(
        "'catalog' AS site", "nullif(l_suppkey, 5) AS book_id", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        "CASE WHEN l_orderkey % 70 = 1 THEN NULL ELSE l_orderkey * 10 + l_linenumber END AS pos")
    order = [F.col(c).asc_nulls_first() for c in ("pos", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    return number_rows(li, ["site", "book_id"], order, "n", block_of("pos", 20_000)).select("l_suppkey", "l_orderkey", "l_linenumber", "n")


@query("chapter_range", f"""WITH {_LISTING}, r AS (SELECT CAST(s_suppkey AS VARCHAR) AS book_id,
    CAST(s_suppkey * 7 % 2000 AS VARCHAR) AS start_id, CAST(s_suppkey * 13 % 2000 AS VARCHAR) AS end_id, s_suppkey FROM supplier),
  m AS (SELECT n.book_id, coalesce(min(n.order_index) FILTER (WHERE chapter_id = start_id), 1) AS s,
    coalesce(min(n.order_index) FILTER (WHERE chapter_id = end_id), max(n.order_index)) AS e, min(s_suppkey) AS k
    FROM numbered n JOIN r ON n.book_id = r.book_id GROUP BY n.book_id)
  SELECT n.book_id, n.chapter_id, n.order_index FROM numbered n JOIN m ON n.book_id = m.book_id
  WHERE n.order_index BETWEEN least(s, e) AND greatest(s, e) AND n.chapter_id <> CAST(k + 1 AS VARCHAR) AND n.chapter_id <> '77'""")
def chapter_range(spark, d):
    req = table(spark, d, "supplier").selectExpr(
        "'catalog' AS site", "CAST(s_suppkey AS STRING) AS book_id", "CAST(s_suppkey * 7 % 2000 AS STRING) AS start_id",
        "CAST(s_suppkey * 13 % 2000 AS STRING) AS end_id", "array(CAST(s_suppkey + 1 AS STRING), '77') AS ignore_ids")
    return L.chapter_range(_numbered(spark, d), req).select("book_id", "chapter_id", "order_index")


_SCATTERED = ["CASE WHEN conv_id % 10 <> 3 THEN conv_id END AS book", "CASE WHEN conv_id % 10 <> 4 OR turn <> 1 THEN conv_id * 1000 + turn END AS place"]


@query("volume_fill", f"""WITH x AS (SELECT conv_id, turn, role, {', '.join(_SCATTERED)} FROM conversations)
  SELECT conv_id, turn AS pos, coalesce(last_value(CASE WHEN role = 'user' THEN 'Volume ' || turn END IGNORE NULLS)
  OVER (PARTITION BY book ORDER BY place NULLS FIRST), '') AS volume FROM x""")
def volume_fill(spark, d):
    """A tenth of the conversations are one group without a name, another tenth have a turn without a place."""
    rows = turns(spark, d).withColumn("turn", F.col("pos")).selectExpr("*", *_SCATTERED)
    return L.forward_fill(rows, ["book"], "place", "heading").select("conv_id", "pos", "volume")


@query("collect_after_marker", """WITH m AS (SELECT conv_id, min(turn) AS f FROM conversations WHERE role = 'assistant' GROUP BY 1)
  SELECT c.conv_id, turn AS pos FROM conversations c LEFT JOIN m ON c.conv_id = m.conv_id
  WHERE role <> 'assistant' AND (f IS NULL OR turn > f)""")
def collect_after_marker(spark, d):
    return L.collect_after_marker(turns(spark, d), ["conv_id"], "pos", F.col("site") == "assistant").select("conv_id", "pos")


@query("context_window", f"""WITH {_LISTING} SELECT book_id, chapter_id, string_agg(chapter_id, ',') OVER (PARTITION BY book_id
  ORDER BY order_index ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS neighbours FROM numbered""")
def context_window(spark, d):
    return L.context_window(_numbered(spark, d), 2).select(
        "book_id", "chapter_id", F.array_join("neighbours", ",").alias("neighbours"))


@query("coverage_stats", f"""WITH {CHAPTERS} SELECT site, book_id, count(*) AS total_chapters,
  count(*) FILTER (WHERE doc_id % 3 = 0 OR {sql_trim('content')} <> '') AS cached_chapters FROM
  (SELECT site, book_id, doc_id, CASE WHEN doc_id % 4 = 0 THEN chr(12288) ELSE content END AS content FROM chapters) GROUP BY 1, 2""")
def coverage_stats(spark, d):
    c = chapters(spark, d).withColumn("content", F.when(F.col("doc_id") % 4 == 0, F.lit("　")).otherwise(F.col("content")))
    return L.coverage(c.withColumn("downloaded", F.col("doc_id") % 3 == 0))


@query("usable_books", f"""WITH {CHAPTERS} SELECT site, book_id, bool_or(doc_id % 4 = 0 AND {sql_trim('content')} <> '') AS usable FROM chapters GROUP BY 1, 2""")
def usable_books(spark, d):
    c = chapters(spark, d).withColumn("content", F.when(F.col("doc_id") % 4 == 0, F.col("content")).otherwise(
        F.concat("content", F.lit("\n [插圖] \n"))))
    return L.usable_books(c)


@query("failure_totals", f"""WITH x AS (SELECT user_id, CASE WHEN event_type = 'error' THEN 'http 500' ELSE '' END AS error,
    CASE WHEN event_type IN ('click', 'error') THEN ' ' ELSE props END AS content FROM events)
  SELECT CAST(user_id AS VARCHAR) AS book_id, count(*) AS pending, count(*) FILTER (WHERE error <> '') AS failed,
    count(*) FILTER (WHERE error = '' AND content = ' ') AS empty, count(*) FILTER (WHERE error = '' AND content <> ' ') AS succeeded,
    count(*) FILTER (WHERE error = '' AND content <> ' ') = 0 AS all_failed FROM x GROUP BY user_id""")
def failure_totals(spark, d):
    r = table(spark, d, "events").selectExpr(
        "'log' AS site", "CAST(user_id AS STRING) AS book_id", "CASE WHEN event_type = 'error' THEN 'http 500' ELSE '' END AS error",
        "CASE WHEN event_type IN ('click', 'error') THEN ' ' ELSE props END AS content")
    return L.failure_totals(r).drop("site")


def _log(spark, d, removals=True):
    """Stage log of customers: an order commits or removes the stage its priority names."""
    o = table(spark, d, "orders")
    op = "CASE WHEN o_orderstatus = 'P' THEN 'remove' ELSE 'commit' END" if removals else "'commit'"
    return o.selectExpr("'log' AS site", "CAST(o_custkey AS STRING) AS book_id", "substr(o_orderpriority, 3) AS stage",
                        "o_orderkey AS seq", f"{op} AS op")


@query("stage_state", """WITH l AS (SELECT CAST(o_custkey AS VARCHAR) AS b, substr(o_orderpriority, 3) AS s, o_orderkey AS q, o_orderstatus = 'P' AS rm FROM orders),
  p AS (SELECT b, s, max(q) FILTER (WHERE rm) AS r, max(q) FILTER (WHERE NOT rm) AS c FROM l GROUP BY 1, 2),
  a AS (SELECT l.b, l.s, min(l.q) AS f FROM l JOIN p ON l.b = p.b AND l.s = p.s WHERE NOT rm AND (r IS NULL OR q > r) GROUP BY 1, 2),
  j AS (SELECT p.b, p.s, p.c, a.f FROM p LEFT JOIN a ON a.b = p.b AND a.s = p.s)
  SELECT b AS book_id, coalesce(CASE WHEN arg_max(coalesce(f, -1), c) >= 0 THEN arg_max(s, c) ELSE arg_max(s, f) END, '') AS latest_stage,
    coalesce(string_agg(s, ',' ORDER BY f) FILTER (WHERE f IS NOT NULL), '') AS stages FROM j GROUP BY b""")
def stage_state(spark, d):
    s = L.stage_state(_log(spark, d))
    return s.select("book_id", "latest_stage", F.array_join("stages", ",").alias("stages"))


@query("library_listing", """WITH latest AS (SELECT o_custkey, arg_max(substr(o_orderpriority, 3), o_orderkey) AS stage FROM orders GROUP BY 1),
  st AS (SELECT DISTINCT o_custkey, substr(o_orderpriority, 3) AS stage FROM orders),
  n AS (SELECT o_custkey, substr(o_orderpriority, 3) AS stage, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)
  SELECT CAST(c_custkey AS VARCHAR) AS book_id, l.stage, c_name AS title, coalesce(n, 0) AS chapter_count FROM latest l
  JOIN customer ON c_custkey = l.o_custkey LEFT JOIN n ON n.o_custkey = l.o_custkey AND n.stage = l.stage WHERE c_custkey % 9 <> 0""")
def library_listing(spark, d):
    log = _log(spark, d, removals=False)
    meta = table(spark, d, "customer").filter("c_custkey % 9 <> 0").selectExpr(
        "CAST(c_custkey AS STRING) AS book_id", "c_name AS title", "c_mktsegment AS author", "timestamp_ntz'2024-01-01' AS updated_at")
    books = log.select("site", "book_id", "stage").distinct().join(meta, "book_id")
    ch = (table(spark, d, "lineitem").join(log.select("site", "book_id", "stage", F.col("seq").alias("l_orderkey")), "l_orderkey")
          .select("site", "book_id", "stage"))
    return L.list_books(books, ch, L.latest_of(log)).select("book_id", "stage", "title", "chapter_count")


@query("first_source_wins", """WITH p AS (SELECT l_suppkey AS b, l_partkey AS v, l_orderkey AS pos FROM lineitem WHERE l_suppkey % 2 = 0 AND l_returnflag = 'R'),
  o AS (SELECT l_suppkey AS b, l_partkey AS v, l_orderkey AS pos FROM lineitem WHERE l_returnflag = 'A')
  SELECT b, count(*) AS n, min(pos) AS first_pos FROM (SELECT * FROM p UNION ALL SELECT b, v, -pos FROM o WHERE b NOT IN (SELECT b FROM p)) GROUP BY b""")
def first_source_wins(spark, d):
    li = table(spark, d, "lineitem").selectExpr("'c' AS site", "l_suppkey AS book_id", "l_partkey AS v", "l_orderkey AS pos", "l_returnflag AS f")
    p = li.filter("book_id % 2 = 0 AND f = 'R'").drop("f")
    o = li.filter("f = 'A'").drop("f")
    return (L.first_source(p, o).groupBy(F.col("book_id").alias("b"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos")))


def _requests(spark, d):
    """One request per line item: a third by id, a third by url, a third by title."""
    # equal items are found by their numbers, which a name without nulls holds; the texts are longer
    numbers = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    items = table(spark, d, "lineitem").select(*numbers).distinct()
    rows = items.selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS request_id", "'catalog' AS site", "CAST(l_suppkey AS STRING) AS book_id",
        "CASE WHEN l_orderkey % 3 = 0 THEN CAST(l_partkey + 1 AS STRING) ELSE '' END AS chapter_id",
        "CASE WHEN l_orderkey % 3 = 1 THEN concat('u', l_partkey % 300) ELSE '' END AS url",
        "CASE WHEN l_orderkey % 3 = 2 THEN concat('t', l_partkey % 40) ELSE '' END AS title",
        "CAST(l_partkey % 5 AS BIGINT) AS order_index", "CAST(l_partkey % 90 AS BIGINT) AS fallback_index", f"{' IS NULL OR '.join(numbers)} IS NULL AS unsure")
    return rows.filter("NOT unsure").drop("unsure").unionByName(rows.filter("unsure").drop("unsure").distinct())


_REQ = """req AS (SELECT DISTINCT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS request_id, CAST(l_suppkey AS VARCHAR) AS book_id,
    CASE WHEN l_orderkey % 3 = 0 THEN CAST(l_partkey + 1 AS VARCHAR) ELSE '' END AS chapter_id,
    CASE WHEN l_orderkey % 3 = 1 THEN 'u' || (l_partkey % 300) ELSE '' END AS url,
    CASE WHEN l_orderkey % 3 = 2 THEN 't' || (l_partkey % 40) ELSE '' END AS title,
    l_partkey % 5 AS order_index, l_partkey % 90 AS fallback_index FROM lineitem),
  lib AS (SELECT book_id, chapter_id, 'u' || (CAST(chapter_id AS BIGINT) % 300) AS url, 't' || (CAST(chapter_id AS BIGINT) % 40) AS title,
    order_index, CAST(chapter_id AS BIGINT) % 5 AS ord5, order_index - 1 AS position, CASE WHEN CAST(chapter_id AS BIGINT) % 6 = 0 THEN ' ' ELSE 'body' END AS content FROM numbered)"""


def _lib(spark, d):
    return _numbered(spark, d).selectExpr(
        "site", "book_id", "chapter_id", "concat('u', chapter_id % 300) AS url", "concat('t', chapter_id % 40) AS title",
        "order_index", "chapter_id % 5 AS ord5", "order_index - 1 AS position", "CASE WHEN chapter_id % 6 = 0 THEN ' ' ELSE 'body' END AS content")


@query("stored_chapter_lookup", f"""WITH {_LISTING}, {_REQ}, m AS (
    SELECT request_id, 0 AS tier, l.order_index AS o, l.chapter_id AS id FROM req r JOIN lib l ON r.book_id = l.book_id AND r.chapter_id = l.chapter_id WHERE content <> ' '
    UNION ALL SELECT request_id, 1, l.order_index, l.chapter_id FROM req r JOIN lib l ON r.book_id = l.book_id AND r.url = l.url WHERE content <> ' '
    UNION ALL SELECT request_id, 1, l.order_index, l.chapter_id FROM req r JOIN lib l ON r.book_id = l.book_id AND r.title = l.title WHERE content <> ' ')
  SELECT r.request_id, (SELECT first(id ORDER BY tier, o) FROM m WHERE m.request_id = r.request_id) AS stored_id FROM req r""")
def stored_chapter_lookup(spark, d):
    return L.lookup_stored(_requests(spark, d), _lib(spark, d)).select("request_id", "stored_id")


@query("same_chapter", f"""WITH {_LISTING}, {_REQ}, m AS (
    SELECT request_id, l.position AS p FROM req r JOIN lib l ON r.book_id = l.book_id AND r.chapter_id = l.chapter_id
    UNION ALL SELECT request_id, l.position FROM req r JOIN lib l ON r.book_id = l.book_id AND r.url = l.url
    UNION ALL SELECT request_id, l.position FROM req r JOIN lib l ON r.book_id = l.book_id AND r.title = l.title AND r.order_index = l.ord5 AND r.order_index <> 0),
  b AS (SELECT request_id, min(p) AS p FROM m GROUP BY 1), z AS (SELECT book_id, max(position) AS last FROM lib GROUP BY 1)
  SELECT r.request_id, CASE WHEN EXISTS (SELECT 1 FROM m WHERE m.request_id = r.request_id AND m.p = CASE WHEN last IS NULL THEN 0 ELSE greatest(0, least(coalesce(fallback_index, 0), last)) END)
    THEN CASE WHEN last IS NULL THEN 0 ELSE greatest(0, least(coalesce(fallback_index, 0), last)) END ELSE coalesce(p, CASE WHEN last IS NULL THEN 0 ELSE greatest(0, least(coalesce(fallback_index, 0), last)) END) END AS matched_index
  FROM req r LEFT JOIN b ON b.request_id = r.request_id LEFT JOIN z ON z.book_id = r.book_id""")
def same_chapter(spark, d):
    lib = _lib(spark, d).drop("order_index").withColumnRenamed("ord5", "order_index")
    return L.same_chapter(_requests(spark, d), lib).select("request_id", "matched_index")


@query("resume_index", f"""WITH {_LISTING}, i AS (SELECT CAST(s_suppkey AS VARCHAR) AS book_id, CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey * 3 AS VARCHAR) ELSE '' END AS id,
    s_suppkey * 17 - 50 AS hint FROM supplier), n AS (SELECT book_id, count(*) AS n FROM numbered GROUP BY 1)
  SELECT i.book_id, CASE WHEN n IS NULL THEN 0 WHEN c.order_index IS NOT NULL THEN c.order_index - 1 WHEN hint > 0 THEN least(hint, n - 1) ELSE 0 END AS resume_index
  FROM i LEFT JOIN n ON n.book_id = i.book_id LEFT JOIN numbered c ON c.book_id = i.book_id AND c.chapter_id = i.id""")
def resume_index(spark, d):
    items = table(spark, d, "supplier").selectExpr(
        "'catalog' AS site", "CAST(s_suppkey AS STRING) AS book_id",
        "CASE WHEN s_suppkey % 2 = 0 THEN concat(' ', s_suppkey * 3) ELSE '' END AS last_read_chapter_id", "s_suppkey * 17 - 50 AS last_read_chapter_index")
    return L.resume_index(items, _lib(spark, d)).select("book_id", "resume_index")


def _weak_books(spark, d):
    """Books with unreliable ids, some without title or author."""
    return hits(spark, d).selectExpr(
        "site", "CASE WHEN book_id % 3 = 0 THEN book_id ELSE concat('x', book_id) END AS book_id",
        "CASE WHEN book_id % 5 = 0 THEN '' ELSE concat(' ', title) END AS title",
        "CASE WHEN book_id % 7 = 0 THEN '' ELSE author END AS author",
        "'' AS description", "'' AS cover_url", "'' AS source_url")


@query("fallback_match", f"""WITH {HITS}, b AS (SELECT site, CASE WHEN CAST(book_id AS BIGINT) % 3 = 0 THEN book_id ELSE 'x' || book_id END AS book_id,
    CASE WHEN CAST(book_id AS BIGINT) % 5 = 0 THEN '' ELSE replace(title, ' ', '') END AS t, CASE WHEN CAST(book_id AS BIGINT) % 7 = 0 THEN '' ELSE author END AS a FROM hits),
  h AS (SELECT *, replace(title, ' ', '') AS t FROM hits),
  m AS (SELECT b.site, b.book_id, 0 AS tier, ord, h.book_id AS id FROM b JOIN h ON b.site = h.site AND b.book_id = h.book_id
    UNION ALL SELECT b.site, b.book_id, 1, ord, h.book_id FROM b JOIN h ON b.site = h.site AND (b.t = '' OR b.t = h.t) AND (b.a = '' OR b.a = h.author))
  SELECT site, book_id, first(id ORDER BY tier, ord) AS match_id FROM m GROUP BY 1, 2""")
def fallback_match(spark, d):
    return L.fallback_match(_weak_books(spark, d), hits(spark, d)).select("site", "book_id", F.col("match.book_id").alias("match_id"))


@query("fill_from_match", f"WITH {HITS} SELECT site, book_id, title, author, description FROM hits")
def fill_from_match(spark, d):
    h = hits(spark, d)
    b = h.selectExpr("site", "book_id", "CASE WHEN book_id % 2 = 0 THEN title ELSE ' ' END AS title", "'' AS author", "'' AS description",
                     "'' AS cover_url", "'' AS source_url")
    return L.fill_from_match(L.fallback_match(b, h)).select("site", "book_id", "title", "author", "description")


_ARRIVAL = "((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 100 + ascii(l_returnflag)"


@query("catalog_page_merge", f"""SELECT l_suppkey AS book_id, (l_partkey % 7) * 50 + l_quantity::BIGINT % 50 AS position, arg_max(l_returnflag || l_orderkey, {_ARRIVAL}) AS title
  FROM lineitem GROUP BY 1, 2""")
def catalog_page_merge(spark, d):
    p = table(spark, d, "lineitem").selectExpr(
        "'c' AS site", "l_suppkey AS book_id", "l_partkey % 7 + 1 AS page", "50L AS page_size", "CAST(l_quantity AS BIGINT) % 50 AS index",
        f"{_ARRIVAL} AS arrival", "concat(l_returnflag, l_orderkey) AS title")
    return L.merge_catalog_pages(p).select("book_id", "position", "title")


@query("paragraph_permutation", """WITH s AS (SELECT doc_id, string_split(text, '. ') AS p FROM documents),
  e AS (SELECT doc_id, unnest(p) AS v, len(p) - generate_subscripts(p, 1) AS slot FROM s)
  SELECT doc_id, md5(string_agg(v, '|' ORDER BY slot)) AS h FROM e GROUP BY doc_id""")
def paragraph_permutation(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.split("text", r"\. ").alias("p"))
    x = x.withColumn("o", F.transform("p", lambda _, i: F.size("p") - 1 - i))
    return x.select("doc_id", F.md5(F.array_join(L.permute("p", "o"), "|")).alias("h"))


@query("chapter_page", f"""WITH {_LISTING}, n AS (SELECT book_id, max(order_index) AS t FROM numbered GROUP BY 1),
  b AS (SELECT book_id, least(3, greatest(1, (t + 199) // 200)) AS page FROM n)
  SELECT n.book_id, page, chapter_id, order_index FROM numbered n JOIN b ON b.book_id = n.book_id
  WHERE order_index > (page - 1) * 200 AND order_index <= page * 200""")
def chapter_page(spark, d):
    return L.chapter_page(_numbered(spark, d), 3, 200).select("book_id", "page", "chapter_id", "order_index")


@query("chapter_page_info", f"""WITH {_LISTING}, n AS (SELECT book_id, max(order_index) AS total FROM numbered GROUP BY 1),
  b AS (SELECT *, least(2, greatest(1, (total + 499) // 500)) AS page FROM n)
  SELECT book_id, page, 500 AS page_size, total, page > 1 AS has_prev, total > page * 500 AS has_next FROM b""")
def chapter_page_info(spark, d):
    n = _numbered(spark, d).groupBy("book_id").agg(F.max("order_index").alias("n"))
    return n.select("book_id", *L.chapter_page_bounds(F.col("n"), 2, 9999)).drop("offset", "end")


@query("zero_based_pages", """WITH x AS (SELECT o_orderkey, o_orderkey % 57 AS total, o_custkey % 9 AS page, o_custkey % 60 AS i FROM orders)
  SELECT o_orderkey, (total + 9) // 10 AS pages, CASE WHEN total = 0 THEN 0 ELSE least(page, (total + 9) // 10 - 1) * 10 END AS start_at,
    CASE WHEN total = 0 THEN 0 ELSE least(least(page, (total + 9) // 10 - 1) * 10 + 10, total) END AS end_at, i // 10 AS page_of FROM x""")
def zero_based_pages(spark, d):
    x = table(spark, d, "orders").selectExpr("o_orderkey", "o_orderkey % 57 AS total", "o_custkey % 9 AS page", "o_custkey % 60 AS i")
    start, end = L.page_bounds(F.col("total"), F.col("page"), 10)
    return x.select("o_orderkey", L.page_count(F.col("total"), 10).alias("pages"), start.alias("start_at"), end.alias("end_at"),
                    L.page_of_index(F.col("i"), 10).alias("page_of"))


@query("volume_sorted_catalog", """SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag,
  CASE WHEN l_partkey % 3 = 0 THEN l_suppkey ELSE l_partkey END, l_linenumber, l_partkey) AS pos FROM lineitem""")
def volume_sorted_catalog(spark, d):
    li = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag",
                                                "coalesce(nullif(CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE l_partkey END, 0), l_suppkey) AS sort_key")
    return L.volume_positions(li, ["l_orderkey"], "l_returnflag", "sort_key", ["l_linenumber", "l_partkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "pos")


@query("ordered_union_and_removal", """WITH x AS (SELECT o_custkey, o_orderkey, o_orderstatus AS a, substr(o_orderpriority, 1, 1) AS b FROM orders)
  SELECT o_orderkey, CASE WHEN a = b THEN a ELSE a || ',' || b || ',z' END AS merged, a || ',z' AS removed FROM x""")
def ordered_union_and_removal(spark, d):
    o = table(spark, d, "orders").selectExpr("o_orderkey", "array(o_orderstatus, substr(o_orderpriority, 1, 1)) AS a",
                                             "array(substr(o_orderpriority, 1, 1), 'z', o_orderstatus) AS b", "array(o_orderstatus, 'q', 'z') AS c")
    return o.select("o_orderkey", F.array_join(L.merge_ordered("a", "b"), ",").alias("merged"),
                    F.array_join(L.without("c", "q"), ",").alias("removed"))


@query("ordered_unique", """WITH x AS (SELECT page_id, regexp_replace(url, '/+$', '') AS u FROM pages) SELECT page_id, u AS first_url, 2 AS n FROM x""")
def ordered_unique(spark, d):
    from ..functions.text import ordered_unique as unique
    p = table(spark, d, "pages").select("page_id", unique(F.array(F.concat(F.lit(" "), "url", F.lit("//")), F.col("url"), F.lit(" "), F.lit("x"))).alias("u"))
    return p.select("page_id", F.get("u", F.lit(0)).alias("first_url"), F.size("u").alias("n"))


@query("staged_chapters", f"""WITH {CHAPTERS} SELECT chapter_id, 'Capital E' AS stage, md5(replace({sql_trim("replace(replace(replace(content, chr(13), chr(10)), chr(8203), ''), chr(65279), '')")}, 'e', 'E')) AS h FROM chapters""")
def staged_chapters(spark, d):
    """A chain of named steps: the cleaner, one that nobody knows and one of the caller's own, which names the stage."""
    register_step("capital e", lambda df, _: df.withColumn("content", F.replace("content", F.lit("e"), F.lit("E"))))
    staged_rows = staged(chapters(spark, d), [("cleaner", {"remove_invisible": True}), ("nobody knows", {}), ("Capital E", {})])
    return staged_rows.select("chapter_id", "stage", F.md5("content").alias("h"))
