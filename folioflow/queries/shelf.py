"""Shelf queries: regions and nations are folders, customers are books, orders are events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import shelf as S
from . import query
from .views import SHELF, shelf_items, table


def _events(spark, d):
    return as_shelf_events(table(spark, d, "orders"))


def as_shelf_events(orders):
    """Orders as shelf events of customers."""
    return orders.selectExpr(
        "o_orderkey AS seq", "o_orderdate AS ts", "CASE WHEN o_orderstatus = 'F' THEN 'add' ELSE 'progress' END AS op",
        "' shop ' AS site", "CAST(o_custkey AS STRING) AS book_id",
        "CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey END AS parent_id",
        "CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE concat('T', o_orderkey) END AS title",
        "CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE concat(' A', o_orderkey) END AS author",
        "CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE concat('/c/', o_orderkey) END AS cover_url", "o_orderpriority AS description",
        "CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE concat('Ch ', o_orderkey) END AS latest_chapter", "'' AS source_url",
        "CAST(o_orderkey AS STRING) AS chapter_id", "CAST(o_orderkey % 40 - 5 AS INT) AS chapter_index", "concat('C', o_orderkey) AS chapter_title")


_EVENTS = """ev AS (SELECT o_orderkey AS seq, o_orderdate AS ts, o_orderstatus = 'F' AS is_add, CAST(o_custkey AS VARCHAR) AS book_id,
    CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey END AS parent_id, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'T' || o_orderkey END AS title,
    CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'A' || o_orderkey END AS author, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '/c/' || o_orderkey END AS cover_url,
    o_orderpriority AS description, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'Ch ' || o_orderkey END AS latest_chapter FROM orders),
  books AS (SELECT book_id, coalesce(nullif(arg_min(title, seq), ''), book_id) AS title, coalesce(arg_min(author, seq) FILTER (WHERE author <> ''), '') AS author,
    coalesce(arg_min(cover_url, seq) FILTER (WHERE cover_url <> ''), '') AS cover_url, arg_min(description, seq) AS description,
    coalesce(arg_max(latest_chapter, seq) FILTER (WHERE latest_chapter <> ''), '') AS latest_chapter,
    arg_max(parent_id, seq) FILTER (WHERE is_add AND parent_id IS NOT NULL) AS parent_id, NOT bool_or(is_add) AS implicit,
    max(seq) FILTER (WHERE NOT is_add) AS rq FROM ev GROUP BY book_id)"""


@query("shelf_fold", f"""WITH {_EVENTS} SELECT book_id, title, author, cover_url, description, latest_chapter, parent_id, implicit, coalesce(CAST(rq AS VARCHAR), '') AS last_read_chapter_id,
  coalesce(greatest(rq % 40 - 5, 0), 0) AS last_read_chapter_index FROM books""")
def shelf_fold(spark, d):
    return S.fold_books(_events(spark, d)).select(
        "book_id", "title", "author", "cover_url", "description", "latest_chapter", "parent_id", "implicit",
        "last_read_chapter_id", "last_read_chapter_index")


@query("shelf_incremental_fold", f"""WITH {_EVENTS} SELECT book_id, title, author, cover_url, latest_chapter, parent_id, implicit, coalesce(CAST(rq AS VARCHAR), '') AS last_read_chapter_id FROM books""")
def shelf_incremental_fold(spark, d):
    """The fold of the first half merged with the fold of the rest equals the fold of everything."""
    e = _events(spark, d)
    middle = e.agg((F.max("seq") / 2).alias("_half"))
    old, new = (S.fold_books(e.join(middle, on).drop("_half")) for on in (F.col("seq") <= F.col("_half"), F.col("seq") > F.col("_half")))
    return S.merge_fold(old, new).select("book_id", "title", "author", "cover_url", "latest_chapter", "parent_id", "implicit", "last_read_chapter_id")


@query("latest_positions", """SELECT CAST(o_custkey AS VARCHAR) AS book_id, CAST(max(o_orderkey) AS VARCHAR) AS chapter_id, greatest(max(o_orderkey) % 40 - 5, 0) AS chapter_index
  FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_custkey""")
def latest_positions(spark, d):
    return S.latest_positions(_events(spark, d).filter("op = 'progress'")).select("book_id", "chapter_id", "chapter_index")


@query("shelf_listing", f"""WITH {SHELF}, n AS (SELECT parent_id, count(*) AS n FROM shelf WHERE NOT implicit GROUP BY 1)
  SELECT item_id, kind, title, sort, CASE WHEN kind = 'folder' THEN coalesce(n, 0) END AS child_count FROM shelf LEFT JOIN n ON n.parent_id = item_id
  WHERE NOT implicit AND shelf.parent_id IS NULL""")
def shelf_listing(spark, d):
    items = shelf_items(spark, d)
    return (S.with_child_counts(S.visible_items(items), items).orderBy(*S.shelf_order())
            .select("item_id", "kind", "title", "sort", "child_count"))


@query("folder_contents", f"WITH {SHELF} SELECT item_id, kind, sort FROM shelf WHERE NOT implicit AND parent_id = 103 ORDER BY kind, sort, item_id")
def folder_contents(spark, d):
    return S.visible_items(shelf_items(spark, d), 103).orderBy(*S.shelf_order()).select("item_id", "kind", "sort")


@query("child_counts", f"WITH {SHELF} SELECT parent_id, count(*) AS child_count FROM shelf WHERE NOT implicit AND parent_id IS NOT NULL GROUP BY 1")
def child_counts(spark, d):
    return S.child_counts(shelf_items(spark, d))


@query("child_counts_on_folders", f"""WITH {SHELF}, n AS (SELECT parent_id, count(*) AS n FROM shelf WHERE NOT implicit GROUP BY 1)
  SELECT item_id, kind, CASE WHEN kind = 'folder' THEN coalesce(n, 0) END AS child_count FROM shelf LEFT JOIN n ON n.parent_id = item_id""")
def child_counts_on_folders(spark, d):
    items = shelf_items(spark, d)
    return S.with_child_counts(items, items).select("item_id", "kind", "child_count")


@query("reading_history", f"WITH {SHELF} SELECT item_id, title, last_read_at FROM shelf WHERE kind = 'book' AND last_read_at IS NOT NULL ORDER BY last_read_at DESC, item_id LIMIT 500")
def reading_history(spark, d):
    return S.history(shelf_items(spark, d), 9999).select("item_id", "title", "last_read_at")


@query("breadcrumbs", f"""WITH RECURSIVE {SHELF}, up AS (SELECT item_id, parent_id AS cursor, CAST(item_id AS VARCHAR) AS path FROM shelf
  UNION ALL SELECT up.item_id, s.parent_id, s.item_id || '/' || path FROM up JOIN shelf s ON s.item_id = up.cursor)
  SELECT item_id, path, false AS cycle FROM up WHERE cursor IS NULL""")
def breadcrumbs(spark, d):
    return S.breadcrumbs(shelf_items(spark, d)).select("item_id", F.array_join("path", "/").alias("path"), "cycle")


@query("descendants", f"""WITH RECURSIVE {SHELF}, down AS (SELECT item_id AS root_id, item_id, 0 AS depth FROM shelf WHERE kind = 'folder'
  UNION ALL SELECT root_id, s.item_id, depth + 1 FROM down JOIN shelf s ON s.parent_id = down.item_id)
  SELECT root_id, item_id, depth FROM down WHERE depth > 0""")
def descendants(spark, d):
    items = shelf_items(spark, d)
    return S.descendants(items, items.filter("kind = 'folder'"))


@query("move_violations", f"""WITH RECURSIVE {SHELF}, down AS (SELECT item_id AS root_id, item_id FROM shelf WHERE kind = 'folder'
  UNION ALL SELECT root_id, s.item_id FROM down JOIN shelf s ON s.parent_id = down.item_id),
  mv AS (SELECT item_id, CASE item_id % 4 WHEN 0 THEN item_id WHEN 1 THEN 102 WHEN 2 THEN 1003 ELSE 99 END AS new_parent FROM shelf)
  SELECT mv.item_id, new_parent, CASE WHEN new_parent = mv.item_id THEN 'itself' WHEN s.kind = 'folder' THEN 'folder below root' WHEN p.kind IS NULL THEN 'parent missing'
    WHEN p.kind <> 'folder' THEN 'parent is no folder' END AS violation FROM mv JOIN shelf s ON s.item_id = mv.item_id LEFT JOIN shelf p ON p.item_id = new_parent
  WHERE violation IS NOT NULL""")
def move_violations(spark, d):
    items = shelf_items(spark, d)
    moves = items.selectExpr("item_id", "CASE item_id % 4 WHEN 0 THEN item_id WHEN 1 THEN 102 WHEN 2 THEN 1003 ELSE 99 END AS new_parent")
    return S.move_violations(moves, items)


@query("patch_fold", f"""WITH {SHELF}, pt AS (SELECT o_orderkey AS seq, o_custkey + 1001 AS item_id, CASE WHEN o_orderkey % 3 = 0 THEN 'N' || o_orderkey END AS title,
    CASE WHEN o_orderkey % 4 = 0 THEN 'https://h/' || o_orderkey END AS url, CASE WHEN o_orderkey % 5 = 0 THEN o_custkey % 25 + 101 END AS parent_id, o_orderkey % 8 = 0 AS clr FROM orders),
  g AS (SELECT item_id, arg_max(title, seq) FILTER (WHERE title IS NOT NULL) AS t, arg_max(url, seq) FILTER (WHERE url IS NOT NULL) AS u, max(seq) FILTER (WHERE clr OR parent_id IS NOT NULL) AS ms,
    arg_max(CASE WHEN clr THEN -1 ELSE parent_id END, seq) FILTER (WHERE clr OR parent_id IS NOT NULL) AS mp FROM pt GROUP BY 1)
  SELECT s.item_id, coalesce(t, s.title) AS title, u AS source_url, CASE WHEN ms IS NULL THEN s.parent_id ELSE nullif(mp, -1) END AS parent_id FROM shelf s LEFT JOIN g ON g.item_id = s.item_id""")
def patch_fold(spark, d):
    patches = table(spark, d, "orders").selectExpr(
        "o_orderkey AS seq", "o_custkey + 1001 AS item_id", "CASE WHEN o_orderkey % 3 = 0 THEN concat(' N', o_orderkey) END AS title",
        "CASE WHEN o_orderkey % 4 = 0 THEN concat('https://h/', o_orderkey) END AS source_url",
        "CASE WHEN o_orderkey % 5 = 0 THEN o_custkey % 25 + 101 END AS parent_id", "o_orderkey % 8 = 0 AS clear_parent")
    return S.fold_patches(shelf_items(spark, d), patches).select("item_id", "title", "source_url", "parent_id")


@query("delete_items", f"""WITH RECURSIVE {SHELF}, rm AS (SELECT item_id FROM shelf WHERE item_id = 2 OR item_id % 17 = 0),
  down AS (SELECT item_id, kind FROM shelf WHERE item_id IN (SELECT item_id FROM rm) UNION ALL SELECT s.item_id, s.kind FROM down JOIN shelf s ON s.parent_id = down.item_id WHERE down.kind = 'folder'),
  gone AS (SELECT DISTINCT item_id FROM down)
  SELECT s.item_id, CASE WHEN g.item_id IS NULL THEN s.parent_id END AS parent_id, s.implicit OR g.item_id IS NOT NULL AS implicit FROM shelf s LEFT JOIN gone g ON g.item_id = s.item_id
  WHERE g.item_id IS NULL OR (kind = 'book' AND last_read_at IS NOT NULL)""")
def delete_items(spark, d):
    items = shelf_items(spark, d)
    return S.delete_items(items, items.filter("item_id = 2 OR item_id % 17 = 0")).select("item_id", "parent_id", "implicit")


def _chains(spark, d):
    """Customers as folders inside each other, four hundred levels deep, and their orders as books."""
    folders = table(spark, d, "customer").selectExpr(
        "c_custkey AS item_id", "CASE WHEN c_custkey % 400 <> 0 THEN c_custkey - 1 END AS parent_id", "'folder' AS kind", "false AS implicit",
        "CAST(NULL AS TIMESTAMP_NTZ) AS last_read_at")
    books = table(spark, d, "orders").selectExpr("o_orderkey + 1000000000L AS item_id", "o_custkey AS parent_id", "'book' AS kind", "false AS implicit",
                                                 "CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS TIMESTAMP_NTZ) END AS last_read_at")
    return folders.unionByName(books)


# what a folder's key says about its chain, since every key from 0 on is a customer
_CHAIN = """chain AS (SELECT c_custkey AS item_id, c_custkey // 400 * 400 AS top FROM customer),
  book AS (SELECT o_orderkey + 1000000000 AS item_id, o_custkey AS parent_id, o_orderkey % 3 = 0 AS was_read FROM orders)"""


@query("deep_breadcrumbs", f"""WITH RECURSIVE {_CHAIN}, up AS (SELECT c_custkey AS item_id, c_custkey AS cursor, CAST(c_custkey AS VARCHAR) AS path FROM customer
  UNION ALL SELECT item_id, cursor - 1, (cursor - 1) || '/' || path FROM up WHERE cursor % 400 <> 0),
  f AS (SELECT item_id, path FROM up WHERE cursor % 400 = 0)
  SELECT item_id, md5(path) AS h FROM f UNION ALL SELECT b.item_id, md5(path || '/' || b.item_id) FROM book b JOIN f ON f.item_id = b.parent_id""")
def deep_breadcrumbs(spark, d):
    return S.breadcrumbs(_chains(spark, d)).select("item_id", F.md5(F.array_join("path", "/")).alias("h"))


@query("deep_descendants", f"""WITH {_CHAIN}, r AS (SELECT c_custkey AS root_id FROM customer WHERE c_custkey % 50 = 0),
  below AS (SELECT root_id, item_id, item_id - root_id AS depth FROM r JOIN chain ON item_id > root_id AND top = root_id // 400 * 400)
  SELECT root_id, count(*) AS n, CAST(sum(depth) AS BIGINT) AS depths FROM (SELECT * FROM below UNION ALL SELECT root_id, b.item_id, depth + 1 FROM below JOIN book b ON b.parent_id = below.item_id
    UNION ALL SELECT root_id, b.item_id, 1 FROM r JOIN book b ON b.parent_id = root_id) GROUP BY root_id""")
def deep_descendants(spark, d):
    items = _chains(spark, d)
    below = S.descendants(items, items.filter("kind = 'folder' AND item_id % 50 = 0"))
    return below.groupBy("root_id").agg(F.count(F.lit(1)).alias("n"), F.sum("depth").alias("depths"))


@query("deep_delete", f"""WITH {_CHAIN}, cut AS (SELECT item_id, top, item_id % 400 >= 300 AS gone FROM chain)
  SELECT item_id, CASE WHEN item_id <> top THEN item_id - 1 END AS parent_id, false AS implicit FROM cut WHERE NOT gone
  UNION ALL SELECT b.item_id, CASE WHEN NOT gone THEN parent_id END, gone FROM book b JOIN cut ON cut.item_id = parent_id WHERE NOT gone OR was_read""")
def deep_delete(spark, d):
    """The three hundredth folder of each chain goes, with what is below it."""
    items = _chains(spark, d)
    return S.delete_items(items, items.filter("kind = 'folder' AND item_id % 400 = 300")).select("item_id", "parent_id", "implicit")


@query("refused_patches", f"""WITH {SHELF}, pt AS (SELECT o_orderkey AS seq, o_custkey + 1001 AS item_id, CASE WHEN o_orderkey % 5 < 3 THEN o_custkey % 30 + 101 ELSE o_custkey % 9 + 1000 END AS parent_id FROM orders)
  SELECT pt.item_id, seq, pt.parent_id, CASE WHEN pt.parent_id = pt.item_id THEN 'itself' WHEN p.kind IS NULL THEN 'parent missing' WHEN p.kind <> 'folder' THEN 'parent is no folder' END AS violation
  FROM pt LEFT JOIN shelf p ON p.item_id = pt.parent_id WHERE pt.parent_id = pt.item_id OR p.kind IS NULL OR p.kind <> 'folder'""")
def refused_patches(spark, d):
    patches = table(spark, d, "orders").selectExpr("o_orderkey AS seq", "o_custkey + 1001 AS item_id",
                                                   "CASE WHEN o_orderkey % 5 < 3 THEN o_custkey % 30 + 101 ELSE o_custkey % 9 + 1000 END AS parent_id")
    return S.refused_changes(patches, shelf_items(spark, d))
