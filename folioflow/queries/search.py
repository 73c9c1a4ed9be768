"""Search queries over hits derived from lineitem, part and supplier."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search as S
from ..functions import scores
from ..functions.text import norm
from . import query
from .views import HITS, hits, sources, table

KEYWORD = "Cold Widget"
TOP = 20

# SQL of the score columns; `k`, `t`, `a` are the normalised keyword, title and author.
_SIM = """CASE WHEN {a} = '' OR {b} = '' THEN 0.0 WHEN {a} = {b} THEN 1.0
  WHEN contains({a}, {b}) OR contains({b}, {a})
    THEN 0.75::DOUBLE + least(length({a}), length({b}))::DOUBLE / greatest(length({a}), length({b})) * 0.2::DOUBLE
  WHEN levenshtein({a}, {b}) >= greatest(length({a}), length({b})) THEN 0.0
  ELSE 1.0::DOUBLE - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b})) END"""


def _sim(a: str, b: str) -> str:
    return "CAST(" + _SIM.format(a=a, b=b) + " AS DOUBLE)"


def _norm(c: str) -> str:
    return f"regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}\\p{{Han}}]', '', 'g')"


_FOUND = " OR ".join(f"contains({_norm(c)}, k)" for c in ("title", "author", "description", "latest_chapter"))


def _scored(source: str) -> str:
    """CTEs from `source` (hit columns plus keyword) to `scored`."""
    return f"""
normed AS (SELECT *, {_norm('keyword')} AS k, {_norm('title')} AS t, {_norm('author')} AS a FROM {source}),
scored AS (SELECT *,
  CASE WHEN t = '' AND a = '' THEN site || '|' || book_id WHEN a = '' THEN t ELSE t || '|' || a END AS group_key,
  greatest({_sim('k', 't')},
    CASE WHEN t <> '' AND contains(t, k) THEN 0.9::DOUBLE + length(k)::DOUBLE / length(t) * 0.1::DOUBLE ELSE 0.0 END,
    CASE WHEN a <> '' THEN {_sim('k', 'a')} * 0.6::DOUBLE ELSE 0.0 END) AS relevance,
  {_sim('k', 't')} * 0.8::DOUBLE
    + CASE WHEN a <> '' THEN {_sim('k', 'a')} * 0.15::DOUBLE ELSE 0.0::DOUBLE END
    + CASE WHEN a <> '' AND contains(k, a) THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END
    + CASE WHEN description <> '' THEN 0.03::DOUBLE ELSE 0.0::DOUBLE END
    + CASE WHEN cover_url <> '' THEN 0.03::DOUBLE ELSE 0.0::DOUBLE END
    + CASE WHEN latest_chapter <> '' THEN 0.02::DOUBLE ELSE 0.0::DOUBLE END
    + CASE WHEN site_rank >= 1000 THEN 0.0::DOUBLE ELSE 0.12::DOUBLE - site_rank * 0.005::DOUBLE END AS score
  FROM normed)"""


_ONE = f"hits1 AS (SELECT '{KEYWORD}' AS keyword, * FROM hits)"
_EXACT = f"exact AS (SELECT * EXCLUDE (k) FROM (SELECT *, {_norm('keyword')} AS k FROM hits1) WHERE {_FOUND})"

_BOOKS = """
books AS (SELECT keyword, group_key, count(*) AS source_count, max(relevance) AS relevance,
    first(site ORDER BY score DESC, site_rank, octet_length(encode(description)) DESC, cover_url = '', book_id, ord)
      AS preferred_site,
    first(book_id ORDER BY score DESC, site_rank, octet_length(encode(description)) DESC, cover_url = '', book_id, ord)
      AS primary_book_id,
    first(site_rank ORDER BY score DESC, site_rank, octet_length(encode(description)) DESC, cover_url = '', book_id, ord)
      AS preferred_rank,
    first(title ORDER BY score DESC, site_rank, octet_length(encode(description)) DESC, cover_url = '', book_id, ord)
      AS title,
    first(author ORDER BY score DESC, site_rank, octet_length(encode(description)) DESC, cover_url = '', book_id, ord)
      AS author,
    first(description ORDER BY octet_length(encode(description)) DESC, score DESC, site_rank, cover_url = '', book_id,
      ord) AS description,
    coalesce(nullif(first(cover_url ORDER BY score DESC, site_rank, octet_length(encode(description)) DESC,
      cover_url = '', book_id, ord), ''), first(cover_url ORDER BY site_rank, book_id, ord)
      FILTER (WHERE cover_url <> ''), '') AS cover_url,
    coalesce(nullif(first(latest_chapter ORDER BY score DESC, site_rank, octet_length(encode(description)) DESC,
      cover_url = '', book_id, ord), ''), first(latest_chapter ORDER BY site_rank, book_id, ord)
      FILTER (WHERE latest_chapter <> ''), '') AS latest_chapter,
    max(score) + (count(*) - 1) * 0.05::DOUBLE AS score
  FROM scored GROUP BY keyword, group_key)"""

_RANK = """ranked AS (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY round(relevance, 9) DESC, score DESC,
    source_count DESC, preferred_rank, title, primary_book_id, group_key) AS position FROM books)"""

RESULT = ["keyword", "position", "group_key", "title", "author", "description", "cover_url", "latest_chapter",
          "preferred_site", "primary_book_id", "source_count"]


def _rounded(df):
    return df.select(*RESULT, F.round("score", 6).alias("score"), F.round("relevance", 6).alias("relevance"))


_OUT = ", ".join(RESULT) + ", round(score, 6) AS score, round(relevance, 6) AS relevance"


def _keyed(spark, d):
    return hits(spark, d).withColumn("keyword", F.lit(KEYWORD))


def _scored_hits(spark, d, exact=True):
    h = _keyed(spark, d)
    if exact:
        h = S.keyword_filter(h, F.col("keyword"))
    return S.score_hits(h, F.col("keyword"))


def _books(spark, d, exact=True):
    return S.resolve_books(S.variants(_scored_hits(spark, d, exact)))


def federated(spark, d):
    """Exact filter, scoring, entity resolution and ranking of one keyword."""
    return _rounded(S.rank_results(_books(spark, d), TOP))


query("federated_search", f"WITH {HITS}, {_ONE}, {_EXACT}, {_scored('exact')}, {_BOOKS}, {_RANK} "
      f"SELECT {_OUT} FROM ranked WHERE position <= {TOP}")(federated)


@query("fuzzy_search", f"WITH {HITS}, {_ONE}, {_scored('hits1')}, {_BOOKS}, {_RANK} "
       f"SELECT {_OUT} FROM ranked WHERE position <= {TOP}")
def fuzzy(spark, d):
    return _rounded(S.rank_results(_books(spark, d, exact=False), TOP))


@query("keyword_filter", f"WITH {HITS}, {_ONE}, {_EXACT} SELECT site, book_id, title, author, latest_chapter FROM exact")
def keyword_filter(spark, d):
    return S.keyword_filter(_keyed(spark, d), F.col("keyword")).select(
        "site", "book_id", "title", "author", "latest_chapter")


@query("similarity_scores", f"""WITH {HITS}, pairs AS (SELECT DISTINCT title, author FROM hits),
  x AS (SELECT title, author, {_norm("'" + KEYWORD + "'")} AS k, {_norm('title')} AS t, {_norm('author')} AS a FROM pairs)
  SELECT title, author, round({_sim('k', 't')}, 9) AS title_similarity, round({_sim('k', 'a')}, 9) AS author_similarity
  FROM x""")
def similarity_scores(spark, d):
    h = hits(spark, d).select("title", "author").distinct()
    k = norm(F.lit(KEYWORD))
    return h.select("title", "author", F.round(scores.similarity(k, norm("title")), 9).alias("title_similarity"),
                    F.round(scores.similarity(k, norm("author")), 9).alias("author_similarity"))


@query("hit_scores", f"WITH {HITS}, {_ONE}, {_scored('hits1')} SELECT site, book_id, group_key, "
       "round(score, 6) AS score, round(relevance, 6) AS relevance FROM scored")
def hit_scores(spark, d):
    return _scored_hits(spark, d, exact=False).select(
        "site", "book_id", "group_key", F.round("score", 6).alias("score"), F.round("relevance", 6).alias("relevance"))


@query("source_bonus", "SELECT s_name AS site, CASE WHEN s_suppkey >= 24 THEN 0.0 ELSE "
       "round(0.12::DOUBLE - s_suppkey * 0.005::DOUBLE, 9) END AS bonus FROM supplier")
def source_bonus(spark, d):
    rank = F.coalesce("default_rank", F.lit(scores.UNRANKED))
    return sources(spark, d).select("site", F.round(scores.source_bonus(rank), 9).alias("bonus"))


@query("entity_groups", f"WITH {HITS}, {_ONE}, {_scored('hits1')} SELECT group_key, count(*) AS source_count, "
       "min(ord) AS first_ord FROM scored GROUP BY group_key")
def entity_groups(spark, d):
    v = S.variants(_scored_hits(spark, d, exact=False))
    return v.groupBy("group_key").agg(F.count(F.lit(1)).alias("source_count"), F.min("ord").alias("first_ord"))


_ALL = ("(SELECT s_name AS site, CAST(p_partkey AS VARCHAR) AS book_id, p_name AS title, l_orderkey * 10 + l_linenumber"
        " AS ord FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)")


def _all_hits(spark, d):
    """One hit per line item, so the same (site, book) arrives several times."""
    return (table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
            .join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
            .selectExpr("s_name AS site", "CAST(p_partkey AS STRING) AS book_id", "p_name AS title",
                        "l_orderkey * 10 + l_linenumber AS ord"))


@query("dedupe_hits", f"SELECT site, book_id, arg_min(title, ord) AS title, min(ord) AS ord FROM {_ALL} "
       "GROUP BY site, book_id")
def dedupe_hits(spark, d):
    return S.dedupe_hits(_all_hits(spark, d)).select("site", "book_id", "title", "ord")


@query("variant_dedupe", f"WITH {HITS}, {_ONE}, {_scored('hits1')} SELECT group_key, site, book_id, site_rank, "
       "min(ord) AS ord FROM scored GROUP BY ALL")
def variant_dedupe(spark, d):
    doubled = _scored_hits(spark, d, exact=False)
    doubled = doubled.unionByName(doubled.withColumn("ord", F.col("ord") + 1).withColumn("title", F.lit("late")))
    return S.variants(doubled).select("group_key", "site", "book_id", F.col("site_rank").cast("bigint"), "ord")


@query("primary_variant", f"WITH {HITS}, {_ONE}, {_EXACT}, {_scored('exact')}, {_BOOKS} SELECT group_key, "
       "preferred_site, primary_book_id FROM books")
def primary_variant(spark, d):
    return _books(spark, d).select("group_key", "preferred_site", "primary_book_id")


@query("group_score", f"WITH {HITS}, {_ONE}, {_EXACT}, {_scored('exact')}, {_BOOKS} SELECT group_key, source_count, "
       "round(score, 6) AS score, round(relevance, 6) AS relevance FROM books")
def group_score(spark, d):
    return _books(spark, d).select("group_key", "source_count", F.round("score", 6).alias("score"),
                                   F.round("relevance", 6).alias("relevance"))


@query("best_fields", f"WITH {HITS}, {_ONE}, {_EXACT}, {_scored('exact')}, {_BOOKS} SELECT group_key, title, author, "
       "description, cover_url, latest_chapter FROM books")
def best_fields(spark, d):
    return _books(spark, d).select("group_key", "title", "author", "description", "cover_url", "latest_chapter")


@query("variant_order", f"WITH {HITS}, {_ONE}, {_EXACT}, {_scored('exact')} SELECT group_key, site, book_id, "
       "row_number() OVER (PARTITION BY group_key ORDER BY site_rank, book_id, ord) AS variant_pos FROM scored")
def variant_order(spark, d):
    from ..plans.ordering import number_rows_any
    v = S.variants(_scored_hits(spark, d)).select("group_key", "site", "book_id", "site_rank", "ord")
    order = [F.col("site_rank"), F.col("book_id"), F.col("ord")]
    return number_rows_any(v, ["group_key"], order, "variant_pos").drop("site_rank", "ord")


@query("top_hits_per_source", f"WITH {HITS} SELECT site, book_id, ord FROM hits QUALIFY row_number() OVER "
       "(PARTITION BY site ORDER BY ord) <= 8")
def top_hits_per_source(spark, d):
    return S.top_per_source(_keyed(spark, d)).select("site", "book_id", "ord")


@query("sequential_search", f"WITH {HITS}, {_ONE}, {_EXACT} SELECT site, book_id FROM exact ORDER BY site_rank, ord LIMIT 50")
def sequential_search(spark, d):
    h = S.keyword_filter(_keyed(spark, d), F.col("keyword"))
    return S.sequential_union(h, 50, source_pos="site_rank").select("site", "book_id")


@query("result_page", f"WITH {HITS}, {_ONE}, {_EXACT}, {_scored('exact')}, {_BOOKS}, {_RANK} SELECT position, group_key, "
       "title FROM ranked WHERE position > 5 AND position <= 10")
def result_page(spark, d):
    return S.result_page(_books(spark, d), 2, 5).select("position", "group_key", "title")


@query("result_page_info", f"WITH {HITS}, {_ONE}, {_EXACT}, {_scored('exact')}, {_BOOKS} SELECT 2 AS page, 3 AS page_size, "
       "count(*) AS total, true AS has_prev, count(*) > 6 AS has_next, count(*) <= 6 AS total_exact FROM books")
def result_page_info(spark, d):
    n = _books(spark, d).agg(F.count(F.lit(1)).alias("n"))
    return n.select(*S.page_info(F.col("n"), 2, 3))


@query("union_of_sources", f"WITH {HITS} SELECT site, count(*) AS hits, min(ord) AS first_ord FROM hits GROUP BY site")
def union_of_sources(spark, d):
    h = hits(spark, d)
    parts = [h.filter(F.col("site_rank") < 12), h.filter(F.col("site_rank").between(12, 999)),
             h.filter(F.col("site_rank") == 1000)]
    return S.union_hits(*parts).groupBy("site").agg(F.count(F.lit(1)).alias("hits"), F.min("ord").alias("first_ord"))


_FIRST = "regexp_extract(text, '^[^\\n]*', 0)"


def _documents(spark, d):
    return table(spark, d, "documents").selectExpr(
        "source AS site", "CAST(doc_id AS STRING) AS book_id", r"regexp_extract(text, '^[^\n]*', 0) AS title",
        "lang AS author", "text AS description", "'' AS latest_chapter", "'' AS cover_url")


_ITEMS = f"""SELECT source AS site, CAST(doc_id AS VARCHAR) AS book_id, {_FIRST} AS title, lang AS author,
  text AS description FROM documents"""


def _index_sql(items: str, keywords: str) -> str:
    tier = lambda c, x: (f"CASE WHEN {c} = k THEN {x[0]} WHEN starts_with({c}, k) THEN {x[1]} "
                         f"WHEN contains({c}, k) THEN {x[2]} ELSE 0 END")
    return f"""WITH items AS ({items}),
  ni AS (SELECT site, book_id, description AS raw_d, {_norm('title')} AS t, {_norm('author')} AS a,
    {_norm('description')} AS dd FROM items),
  nk AS (SELECT DISTINCT keyword, {_norm('keyword')} AS k FROM ({keywords})),
  m AS (SELECT keyword, site, book_id, raw_d, {tier('t', scores.INDEX_TITLE)} + {tier('a', scores.INDEX_AUTHOR)}
    + CASE WHEN contains(dd, k) THEN 220 ELSE 0 END AS hit FROM ni JOIN nk ON k <> '' AND
    (contains(t, k) OR contains(a, k) OR contains(dd, k))),
  s AS (SELECT keyword, site, book_id, raw_d, hit + CASE WHEN raw_d <> '' THEN 15 ELSE 0 END AS score FROM m WHERE hit > 0)"""


@query("keyword_index_match", _index_sql(_ITEMS, "SELECT text AS keyword FROM benchmark")
       + " SELECT keyword, site, book_id, score FROM s")
def keyword_index_match(spark, d):
    keywords = table(spark, d, "benchmark").select(F.col("text").alias("keyword"))
    return S.match_keywords(_documents(spark, d), keywords, ["site", "book_id"]).select(
        "keyword", "site", "book_id", F.col("score").cast("bigint"))


_PARTS = """SELECT 'catalog' AS site, CAST(p_partkey AS VARCHAR) AS book_id, p_name AS title, p_brand AS author,
  p_type AS description FROM part"""
_WORDS = "SELECT DISTINCT unnest(string_split(p_name, ' ')) AS keyword FROM part"


@query("keyword_index_many", _index_sql(_ITEMS, "SELECT DISTINCT text[i * 40 + 1:i * 40 + 14] AS keyword FROM documents, range(6) r(i)")
       + " SELECT md5(keyword) AS keyword, site, book_id, score FROM s")
def keyword_index_many(spark, d):
    """Six keywords a text, cut out of it, against all texts: thousands of keywords, some very short."""
    cuts = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.substring("text", i * 40 + 1, F.lit(14)))
    keywords = table(spark, d, "documents").select(F.explode(cuts).alias("keyword"))
    return S.match_keywords(_documents(spark, d), keywords, ["site", "book_id"]).select(
        F.md5("keyword").alias("keyword"), "site", "book_id", F.col("score").cast("bigint"))


@query("index_top_matches", _index_sql(_PARTS, _WORDS) + """ SELECT keyword, book_id, score, row_number() OVER
  (PARTITION BY keyword ORDER BY score DESC, strlen(raw_d) DESC, book_id) AS position FROM s
  QUALIFY position <= 10""")
def index_top_matches(spark, d):
    part = table(spark, d, "part")
    items = part.selectExpr("'catalog' AS site", "CAST(p_partkey AS STRING) AS book_id", "p_name AS title",
                            "p_brand AS author", "p_type AS description", "'' AS latest_chapter", "'' AS cover_url")
    words = part.select(F.explode(F.split("p_name", " ")).alias("keyword")).distinct()
    m = S.match_keywords(items, words, ["site", "book_id"])
    return S.top_index_matches(m, 10).select("keyword", "book_id", F.col("score").cast("bigint"), "position")


@query("title_index_ranking", f"""WITH x AS (SELECT CAST(p_partkey AS VARCHAR) AS book_id, p_name AS title,
    {_norm('p_name')} AS t, 'bolt' AS k FROM part),
  s AS (SELECT book_id, title, CASE WHEN t = k THEN 4000 WHEN starts_with(t, k) THEN 3000 - abs(strlen(t) - strlen(k))
    WHEN contains(t, k) THEN 2000 - abs(strlen(t) - strlen(k)) ELSE -1 END AS score FROM x)
  SELECT book_id, title, CAST(score AS BIGINT) AS score FROM s WHERE score >= 0
  ORDER BY score DESC, strlen(title), book_id""")
def title_index_ranking(spark, d):
    items = table(spark, d, "part").selectExpr("CAST(p_partkey AS STRING) AS book_id", "p_name AS title")
    return (S.title_ranking(items, F.lit("Bolt!")).orderBy(*S.title_order())
            .select("book_id", "title", F.col("score").cast("bigint")))


@query("searchable_sources", "SELECT s_name AS site FROM supplier WHERE s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0 "
       "AND s_name <> 'Supplier#000000001'")
def searchable_sources(spark, d):
    return S.searchable_sources(sources(spark, d), ["Supplier#000000001"]).select("site")


@query("default_sources", "SELECT s_name AS site, CAST(s_suppkey AS INT) AS default_rank FROM supplier "
       "WHERE s_suppkey < 24 AND s_suppkey % 7 <> 0")
def default_sources(spark, d):
    return S.default_sources(sources(spark, d), "search").select("site", "default_rank")


@query("allowed_sources", f"WITH {HITS} SELECT site, book_id FROM hits WHERE site IN "
       "(SELECT s_name FROM supplier WHERE s_acctbal > 5000)")
def allowed_sources(spark, d):
    ok = table(spark, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_name").alias("site"))
    return S.allowed_sources(hits(spark, d).select("site", "book_id"), ok)


@query("clean_source_keys", """WITH x AS (SELECT o_custkey, trim(v) AS v, min(p) AS p FROM (SELECT o_custkey,
    unnest(['  ' || o_orderpriority, o_orderstatus || ' ', '', o_orderpriority]) AS v, unnest([1, 2, 3, 4]) AS p
    FROM orders WHERE true) WHERE trim(v) <> '' GROUP BY 1, 2)
  SELECT o_custkey, v AS source, count(*) AS n FROM x GROUP BY ALL""")
def clean_source_keys(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.array(
        F.concat(F.lit("  "), "o_orderpriority"), F.concat("o_orderstatus", F.lit(" ")), F.lit(""),
        F.col("o_orderpriority")).alias("keys"))
    one = o.select("o_custkey", F.explode(S.clean_source_keys("keys")).alias("source")).distinct()
    return one.groupBy("o_custkey", "source").agg(F.count(F.lit(1)).alias("n"))


@query("sources_with_tags", "SELECT s_name AS site FROM supplier WHERE s_suppkey % 3 = 0 AND s_acctbal >= 0")
def sources_with_tags(spark, d):
    return S.with_all_tags(sources(spark, d), ["third", "credit"]).select("site")


@query("tag_facets", """WITH t AS (SELECT s_suppkey AS o, 0 AS p, 'nation' || s_nationkey AS tag FROM supplier
  UNION ALL SELECT s_suppkey, 1, CASE WHEN s_acctbal < 0 THEN 'debt' ELSE 'credit' END FROM supplier
  UNION ALL SELECT s_suppkey, 2, 'third' FROM supplier WHERE s_suppkey % 3 = 0)
  SELECT tag, count(*) AS n, min(o) AS first_source FROM t GROUP BY tag""")
def tag_facets(spark, d):
    return S.tag_facets(sources(spark, d), "ord").select("tag", "n", F.col("first_seen._o").alias("first_source"))


@query("prune_selection", "SELECT s_suppkey % 3 = 0 AS kept, count(*) AS n FROM supplier WHERE s_suppkey % 2 = 0 GROUP BY 1")
def prune_selection(spark, d):
    src = sources(spark, d)
    chosen = src.filter("ord % 2 = 0").select("site")
    return (S.prune_selection(chosen, S.with_all_tags(src, ["third"])).groupBy("kept")
            .agg(F.count(F.lit(1)).alias("n")))


@query("configured_features", """SELECT s_name AS site, concat_ws(',', CASE WHEN s_suppkey % 2 = 0 THEN '用户名' END,
    CASE WHEN s_suppkey % 6 = 0 THEN '密码' END, CASE WHEN s_suppkey % 9 = 0 THEN 'Cookie' END,
    CASE WHEN s_suppkey % 8 = 0 THEN '镜像' END,
    CASE WHEN s_nationkey % 5 > 0 THEN '协程=' || (s_nationkey % 5) END,
    CASE WHEN s_suppkey % 10 = 0 THEN '不抓图' END) AS enabled FROM supplier WHERE enabled <> ''""")
def configured_features(spark, d):
    return S.configured_features(sources(spark, d)).select("site", F.array_join("enabled", ",").alias("enabled"))


@query("enrich_hits", f"""WITH {HITS}, latest AS (SELECT CAST(l_suppkey AS VARCHAR) AS s, CAST(l_partkey AS VARCHAR) AS b,
    arg_max(l_returnflag || l_orderkey, l_orderkey * 10 + l_linenumber) AS latest FROM lineitem GROUP BY 1, 2)
  SELECT h.site, h.book_id, CASE WHEN p_partkey % 2 = 0 THEN 'Book ' || p_partkey ELSE h.title END AS title,
    CASE WHEN p_partkey % 3 = 0 THEN h.description ELSE 'About ' || p_partkey END AS description,
    latest AS latest_chapter
  FROM hits h JOIN part ON h.book_id = CAST(p_partkey AS VARCHAR) JOIN supplier ON s_name = h.site
  JOIN latest ON s = CAST(s_suppkey AS VARCHAR) AND b = h.book_id""")
def enrich_hits(spark, d):
    h = hits(spark, d)
    books = h.selectExpr("site", "book_id", "CASE WHEN book_id % 2 = 0 THEN concat('Book ', book_id) ELSE ' ' END AS title",
                         "'' AS author", "CASE WHEN book_id % 3 = 0 THEN '' ELSE concat(' About ', book_id) END AS description",
                         "'' AS source_url", "'' AS cover_url")
    ch = (table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
          .selectExpr("s_name AS site", "CAST(l_partkey AS STRING) AS book_id",
                      "concat(l_returnflag, l_orderkey) AS title", "l_orderkey * 10 + l_linenumber AS order_index"))
    return S.enrich_hits(h, books, S.latest_titles(ch)).select(
        "site", "book_id", "title", "description", "latest_chapter")


@query("chapter_counts", f"""WITH {HITS}, c AS (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2)
  SELECT site, book_id, CASE WHEN s_suppkey % 4 <> 0 THEN n END AS chapter_count FROM hits
  JOIN supplier ON s_name = site JOIN c ON l_suppkey = s_suppkey AND CAST(l_partkey AS VARCHAR) = book_id""")
def chapter_counts(spark, d):
    ch = (table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
          .selectExpr("s_name AS site", "CAST(l_partkey AS STRING) AS book_id"))
    return S.with_chapter_counts(hits(spark, d).select("site", "book_id"), ch, sources(spark, d))


@query("search_warnings", """SELECT 'task' || user_id AS site, event_type AS error, count(*) AS n FROM events GROUP BY ALL""")
def search_warnings(spark, d):
    e = table(spark, d, "events").selectExpr("concat('task', user_id) AS site", "event_type AS error")
    return S.warnings_by_source(e)
