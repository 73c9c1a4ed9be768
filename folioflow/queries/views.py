"""Catalog, library, shelf and progress tables derived from the shared tables.

Every view is written twice, as DataFrame code and as SQL text, so a query and its SQL start from
the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import UNRANKED
from ..plans.sizing import in_pieces

#: Bytes of the line item table whose hits one task gets: some 300,000, of 400 bytes each.
HIT_BYTES = 4 << 20


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- search hits: one per distinct (part, supplier) pair ----------------------------------------

def hits(spark: SparkSession, d: str) -> DataFrame:
    """Pairs are small and hits are not, so the pairs are dealt by the hits they will become."""
    items = table(spark, d, "lineitem")
    pairs = in_pieces(items.select("l_partkey", "l_suppkey").distinct(), items, HIT_BYTES, "l_partkey", "l_suppkey")
    return (pairs.join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
            .join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
            .selectExpr(
                "s_name AS site", "CAST(p_partkey AS STRING) AS book_id", "p_name AS title",
                "CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_brand END AS author",
                "CASE WHEN p_size % 3 = 0 THEN '' ELSE concat(p_type, ' size ', p_size) END AS description",
                "concat('https://s', s_suppkey, '.example.com/book/', p_partkey) AS url",
                "CASE WHEN p_partkey % 5 = 0 THEN '' ELSE concat('Chapter ', p_size) END AS latest_chapter",
                "CASE WHEN (p_partkey + s_suppkey) % 4 = 0 THEN '' ELSE concat('/cover/', p_partkey, '.jpg') END"
                " AS cover_url",
                f"CAST(CASE WHEN s_suppkey < 24 THEN s_suppkey ELSE {UNRANKED} END AS INT) AS site_rank",
                "s_suppkey * 10000000000 + p_partkey AS ord"))


HITS = f"""hits AS (
  SELECT s_name AS site, CAST(p_partkey AS VARCHAR) AS book_id, p_name AS title,
    CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_brand END AS author,
    CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type || ' size ' || p_size END AS description,
    'https://s' || s_suppkey || '.example.com/book/' || p_partkey AS url,
    CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'Chapter ' || p_size END AS latest_chapter,
    CASE WHEN (p_partkey + s_suppkey) % 4 = 0 THEN '' ELSE '/cover/' || p_partkey || '.jpg' END AS cover_url,
    CASE WHEN s_suppkey < 24 THEN s_suppkey ELSE {UNRANKED} END AS site_rank,
    s_suppkey * 10000000000 + p_partkey AS ord
  FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
  JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""


# ---- sources: one per supplier ---------------------------------------------------------------

def sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").selectExpr(
        "s_name AS key", "s_name AS site", "s_suppkey AS ord",
        "array(concat('nation', s_nationkey), CASE WHEN s_acctbal < 0 THEN 'debt' ELSE ' credit ' END,"
        " CASE WHEN s_suppkey % 3 = 0 THEN 'third' ELSE '' END) AS tags",
        "named_struct('download', s_suppkey % 5 <> 0, 'search', s_suppkey % 7 <> 0, 'login', s_suppkey % 4 = 0)"
        " AS capabilities",
        "CAST(CASE WHEN s_suppkey < 24 THEN s_suppkey END AS INT) AS default_rank",
        "CASE WHEN s_suppkey % 2 = 0 THEN concat('user', s_suppkey) ELSE ' ' END AS username",
        "CASE WHEN s_suppkey % 6 = 0 THEN 'secret' ELSE '' END AS password",
        "CASE WHEN s_suppkey % 9 = 0 THEN 'c=1' ELSE '' END AS cookie",
        "CASE WHEN s_suppkey % 8 = 0 THEN array('m.example.com') ELSE CAST(array() AS ARRAY<STRING>) END"
        " AS mirror_hosts",
        "CAST(s_nationkey % 5 AS INT) AS workers", "s_suppkey % 10 <> 0 AS include_picture")


# ---- chapters: documents of a source, twenty to a book ------------------------------------------

def chapters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").selectExpr(
        "source AS site", "CAST(doc_id DIV 20 AS STRING) AS book_id", "CAST(doc_id AS STRING) AS chapter_id",
        "CASE WHEN doc_id % 13 = 0 THEN '' ELSE concat('Title ', doc_id) END AS title", "text AS content",
        "concat('https://', source, '.example.com/', doc_id) AS url", "lang AS volume",
        "CAST(doc_id % 20 + 1 AS INT) AS order_index", "doc_id")


CHAPTERS = """chapters AS (
  SELECT source AS site, CAST(doc_id // 20 AS VARCHAR) AS book_id, CAST(doc_id AS VARCHAR) AS chapter_id,
    CASE WHEN doc_id % 13 = 0 THEN '' ELSE 'Title ' || doc_id END AS title, text AS content,
    'https://' || source || '.example.com/' || doc_id AS url, lang AS volume,
    CAST(doc_id % 20 + 1 AS INT) AS order_index, doc_id
  FROM documents)"""


# ---- turns: a conversation is a book, its turns are chapters ------------------------------------

def turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").selectExpr(
        "CAST(conv_id AS STRING) AS book_id", "role AS site", "turn AS pos", "conv_id", "text AS content",
        "CASE WHEN role = 'user' THEN concat('Volume ', turn) END AS heading")


# ---- progress: events of one type are one task; time runs sixty times faster ------------------------

PROGRESS_TOTAL = 1000


def progress(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr(
        "event_type AS task_id", "event_id AS seq",
        "timestamp_micros(unix_micros(CAST(ts AS TIMESTAMP)) DIV 60) AS ts",
        f"CAST(event_id % {PROGRESS_TOTAL} AS INT) AS done", f"{PROGRESS_TOTAL} AS total",
        "concat(' Chapter ', user_id) AS title")


PROGRESS = f"""progress AS (
  SELECT event_type AS task_id, event_id AS seq, epoch_us(ts) // 60 AS us,
    CAST(event_id % {PROGRESS_TOTAL} AS INT) AS done, {PROGRESS_TOTAL} AS total,
    ' Chapter ' || user_id AS title FROM events)"""


# ---- task events: one task per user -------------------------------------------------------------

KINDS = ("CASE WHEN rn = 1 THEN 'queued' WHEN rn = 2 THEN 'loading' WHEN event_type = 'view' THEN 'running'"
         " WHEN event_type = 'click' THEN 'progress' WHEN event_type = 'signup' THEN 'exporting'"
         " WHEN event_type = 'purchase' THEN 'completed' ELSE 'failed' END")


# ---- shelf: regions and nations are folders, customers are books --------------------------------

def shelf_items(spark: SparkSession, d: str) -> DataFrame:
    read = (table(spark, d, "orders").groupBy("o_custkey").agg(
        F.max("o_orderdate").alias("last_read_at"), F.count(F.lit(1)).alias("n")))
    regions = table(spark, d, "region").selectExpr(
        "r_regionkey + 1L AS item_id", "CAST(NULL AS BIGINT) AS parent_id", "'folder' AS kind", "r_name AS title",
        "false AS implicit", "CAST(NULL AS TIMESTAMP_NTZ) AS last_read_at", "r_regionkey AS sort")
    nations = table(spark, d, "nation").selectExpr(
        "n_nationkey + 101L AS item_id", "n_regionkey + 1L AS parent_id", "'folder' AS kind", "n_name AS title",
        "false AS implicit", "CAST(NULL AS TIMESTAMP_NTZ) AS last_read_at", "n_nationkey AS sort")
    books = (table(spark, d, "customer").join(read, F.col("c_custkey") == F.col("o_custkey"), "left").selectExpr(
        "c_custkey + 1001L AS item_id", "c_nationkey + 101L AS parent_id", "'book' AS kind", "c_name AS title",
        "c_acctbal < 0 AS implicit", "CASE WHEN n > 9 THEN last_read_at END AS last_read_at",
        "CAST(c_custkey % 7 AS INT) AS sort"))
    return regions.unionByName(nations).unionByName(books)


SHELF = """read_at AS (SELECT o_custkey, max(o_orderdate) AS last_read_at, count(*) AS n FROM orders GROUP BY 1),
shelf AS (
  SELECT r_regionkey + 1 AS item_id, CAST(NULL AS BIGINT) AS parent_id, 'folder' AS kind, r_name AS title,
    false AS implicit, CAST(NULL AS TIMESTAMP) AS last_read_at, r_regionkey AS sort FROM region
  UNION ALL SELECT n_nationkey + 101, n_regionkey + 1, 'folder', n_name, false, NULL, n_nationkey FROM nation
  UNION ALL SELECT c_custkey + 1001, c_nationkey + 101, 'book', c_name, c_acctbal < 0,
    CASE WHEN n > 9 THEN last_read_at END, c_custkey % 7
  FROM customer LEFT JOIN read_at ON c_custkey = o_custkey)"""
