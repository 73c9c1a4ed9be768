"""Staged library: reuse, pending work, ranges, stage state, listings and chapter lookup."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions.text import is_blank, nullif_blank, trim_u
from ..plans.checkpoints import materialise, written
from ..plans.ordering import block_of, number_rows, number_rows_any
from .lines import is_reusable, is_reusable_for

BOOK = ["site", "book_id"]
CHAPTER = ["site", "book_id", "chapter_id"]
BLOCK_ROWS = 100_000
#: Books and hits that one task matches; a site with more of them is matched by key.
SITE_ROWS = 100_000
#: Requests and chapters of books that one task looks up; a book with more of them goes by its keys.
BOOK_ROWS = 100_000
#: Requests and chapters that are shuffled together; more go in rounds of whole books.
ROUND_ROWS = 20_000_000
MAX_PAGE_SIZE, DEFAULT_PAGE_SIZE = 500, 100


def _min_length(chapters: DataFrame, sources: DataFrame | None) -> tuple[DataFrame, Column]:
    if sources is None:
        return chapters, F.lit(0)
    return (chapters.join(sources.select("site", "min_content_len"), "site", "left"),
            F.coalesce("min_content_len", F.lit(0)))


def reusable_chapters(stored: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Last reusable stored body per chapter id."""
    rows, least = _min_length(stored, sources)
    kept = rows.filter((F.col("downloaded") | (F.coalesce("content", F.lit("")) != ""))
                       & is_reusable_for("content", least))
    return (kept.groupBy(*CHAPTER).agg(F.max_by(F.struct("content", "title"), F.col("order_index")).alias("_s"))
            .select(*CHAPTER, F.col("_s.content").alias("stored_content"), F.col("_s.title").alias("stored_title")))


def merge_stored(plan: DataFrame, stored: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Plan chapters filled from reusable stored ones; the stored title only fills a blank title."""
    hit = F.col("stored_content").isNotNull()
    return (plan.join(reusable_chapters(stored, sources), CHAPTER, "left")
            .withColumn("content", F.when(hit, F.col("stored_content")).otherwise(F.col("content")))
            .withColumn("downloaded", hit | F.col("downloaded"))
            .withColumn("title", F.when(hit & (F.coalesce("title", F.lit("")) == ""), F.col("stored_title"))
                        .otherwise(F.col("title")))
            .drop("stored_content", "stored_title"))


def pending(merged: DataFrame) -> DataFrame:
    """Chapters still to fetch: not downloaded, or without content."""
    return merged.filter(~F.col("downloaded") | (F.coalesce("content", F.lit("")) == ""))


def pending_chapters(plan: DataFrame, stored: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """`pending` of a plan without bodies, as an anti join: no content is carried."""
    return plan.join(reusable_chapters(stored, sources).select(*CHAPTER), CHAPTER, "left_anti")


def dedupe_chapters(chapters: DataFrame, order: str, block: Column | None = None) -> DataFrame:
    """First of each chapter id in a book, blank ids dropped, renumbered from 1.  NULL books are one
    group; a NULL order comes first.  What is left is written once and then numbered."""
    rest = [c for c in chapters.columns if c not in CHAPTER]
    once = (chapters.filter(F.coalesce("chapter_id", F.lit("")) != "")
            .groupBy(*CHAPTER).agg(F.min_by(F.struct(*rest), F.struct(order)).alias("_c")).select(*CHAPTER, "_c.*"))
    return renumber(materialise(once), order, block)


def renumber(chapters: DataFrame, order: str, block: Column | None = None, out: str = "order_index") -> DataFrame:
    """Order 1..n inside each book, whatever the size of the book."""
    cut = block if block is not None else block_of(order, BLOCK_ROWS)
    numbered = number_rows(chapters, BOOK, [F.col(order)], "_no", cut)
    return numbered.withColumn(out, F.col("_no")).drop("_no")


def chapter_range(chapters: DataFrame, requests: DataFrame, order: str = "order_index") -> DataFrame:
    """Chapters between the requested start and end ids inclusive, without ignored ids.

    A missing or empty id means the end of the list on its side; reversed ends are swapped.
    """
    r = requests.select(*BOOK, "start_id", "end_id")
    marks = (chapters.select(*CHAPTER, F.col(order).alias("_o")).join(r, BOOK)
             .groupBy(*BOOK).agg(
                 F.min("_o").alias("_first"), F.max("_o").alias("_last"),
                 F.min(F.when((F.col("start_id") != "") & (F.col("chapter_id") == F.col("start_id")), F.col("_o"))).alias("_s"),
                 F.min(F.when((F.col("end_id") != "") & (F.col("chapter_id") == F.col("end_id")), F.col("_o"))).alias("_e")))
    ends = marks.select(*BOOK, F.coalesce("_s", "_first").alias("_s"), F.coalesce("_e", "_last").alias("_e"))
    kept = (chapters.join(ends, BOOK)
            .filter(F.col(order).between(F.least("_s", "_e"), F.greatest("_s", "_e"))).drop("_s", "_e"))
    ignored = requests.select(*BOOK, F.explode("ignore_ids").alias("chapter_id"))
    return kept.join(ignored, CHAPTER, "left_anti")


# ---- aggregates -------------------------------------------------------------------------------

def coverage(chapters: DataFrame) -> DataFrame:
    """Total and cached chapter counts of each book."""
    cached = F.col("downloaded") | ~is_blank("content")
    return chapters.groupBy(*BOOK).agg(F.count(F.lit(1)).alias("total_chapters"),
                                       F.count_if(cached).alias("cached_chapters"))


def usable_books(chapters: DataFrame) -> DataFrame:
    return chapters.groupBy(*BOOK).agg(F.bool_or(is_reusable("content")).alias("usable"))


def failure_totals(results: DataFrame) -> DataFrame:
    """Fetch outcome per book from (site, book_id, error, content) rows of its pending chapters."""
    failed = F.coalesce("error", F.lit("")) != ""
    empty = ~failed & is_blank("content")
    g = results.groupBy(*BOOK).agg(F.count(F.lit(1)).alias("pending"), F.count_if(failed).alias("failed"),
                                   F.count_if(empty).alias("empty"))
    return (g.withColumn("succeeded", F.col("pending") - F.col("failed") - F.col("empty"))
            .withColumn("all_failed", F.col("succeeded") == 0))


# ---- stages -----------------------------------------------------------------------------------

def stage_state(log: DataFrame) -> DataFrame:
    """Latest stage and stages in first-seen order from a log of (site, book_id, stage, seq, op)
    with op `commit` or `remove`.

    A removed stage leaves the list until it is committed again.  When the last committed stage is
    gone, the latest is the last of those left; with none left it is empty.
    """
    per_stage = log.groupBy(*BOOK, "stage").agg(
        F.max(F.when(F.col("op") == "remove", F.col("seq"))).alias("_removed"),
        F.max(F.when(F.col("op") == "commit", F.col("seq"))).alias("_last"))
    # first commit after the last removal
    alive = (log.filter(F.col("op") == "commit").join(per_stage, [*BOOK, "stage"])
             .filter(F.col("_removed").isNull() | (F.col("seq") > F.col("_removed")))
             .groupBy(*BOOK, "stage").agg(F.min("seq").alias("_first")))
    joined = per_stage.join(alive, [*BOOK, "stage"], "left")
    # stages are few per book: the names of the configured chain
    g = joined.groupBy(*BOOK).agg(
        F.max_by(F.struct("stage", "_first"), F.col("_last")).alias("_l"),
        F.array_sort(F.collect_list(F.when(F.col("_first").isNotNull(), F.struct("_first", "stage")))).alias("_s"))
    names = F.transform("_s", lambda s: s["stage"])
    latest = F.when(F.col("_l._first").isNotNull(), F.col("_l.stage")).when(
        F.size(names) > 0, F.element_at(names, -1)).otherwise(F.lit(""))
    return g.select(*BOOK, latest.alias("latest_stage"), names.alias("stages"))


def latest_of(log: DataFrame) -> DataFrame:
    """Newest commit per book of an append-only log without removals."""
    return log.groupBy(*BOOK).agg(F.max_by("stage", "seq").alias("stage"))


def list_books(books: DataFrame, chapters: DataFrame, latest: DataFrame) -> DataFrame:
    """Library listing at each book's latest stage; books without metadata there are left out."""
    keys = [*BOOK, "stage"]
    counts = chapters.join(latest, keys, "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("chapter_count"))
    return (books.join(latest, keys, "left_semi").join(counts, keys, "left")
            .select(*keys, "title", "author", "updated_at",
                    F.coalesce("chapter_count", F.lit(0)).alias("chapter_count")).orderBy(*BOOK))


def first_source(primary: DataFrame, other: DataFrame, position: str = "pos") -> DataFrame:
    """Rows of `primary`; books it does not have come from `other` in reverse order."""
    backup = other.join(primary.select(*BOOK).distinct(), BOOK, "left_anti")
    return primary.unionByName(backup.withColumn(position, -F.col(position)))


# ---- lookup -----------------------------------------------------------------------------------

def _keys(*kinds: tuple[str, Column, Column]) -> Column:
    """Array of lookup keys (kind, a, b) whose `a` is filled."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    made = [F.struct(F.lit(kind).alias("kind"), text(x).alias("a"), text(y).alias("b")) for kind, x, y in kinds]
    return F.filter(F.array(*made), lambda k: k["a"] != "")


def _lookup_keys(of: Callable[[str], Column]) -> Column:
    none = F.lit("")
    return _keys(("id", of("chapter_id"), none), ("url", of("url"), none), ("title", of("title"), none))


def _same_keys(of: Callable[[str], Column]) -> Column:
    none, order = F.lit(""), F.nullif(F.coalesce(of("order_index"), F.lit(0)), F.lit(0))
    return _keys(("id", of("chapter_id"), none), ("url", of("url"), none), ("title", F.when(order.isNotNull(), of("title")), order))


def _in_books(requests: DataFrame, chapters: DataFrame, answer: Callable, by_keys: Callable) -> DataFrame:
    """What `answer` makes of requests and chapters (`_c` tells which) that are shuffled once, by book, as they are.
    It also gets what gives a column that both have.  More than `ROUND_ROWS` rows go in rounds of whole books,
    each written before the next is shuffled.  Books of more than `BOOK_ROWS` rows are left to `by_keys`;
    requests without a book find nothing."""
    known = F.col("site").isNotNull() & F.col("book_id").isNotNull()
    asked, rows = requests.filter(known), chapters.filter(known)
    sizes = asked.select(*BOOK).unionByName(rows.select(*BOOK)).groupBy(*BOOK).agg(F.count(F.lit(1)).alias("n"))
    found = sizes.agg(F.sum("n").alias("n"), F.collect_list(F.when(F.col("n") > BOOK_ROWS, F.struct(*BOOK))).alias("large")).first()
    kinds = dict(requests.dtypes)
    own = {c: c if kinds.get(c, kind) == kind else f"_c_{c}" for c, kind in chapters.dtypes}
    either = lambda c: F.col(c) if own[c] == c else F.when(F.col("_c"), F.col(own[c]).cast("string")).otherwise(F.col(c).cast("string"))
    n = found["n"] or 0
    rounds = max(1, -(-n // ROUND_ROWS))
    out = requests.filter(~known)
    if found["large"]:
        large = requests.sparkSession.createDataFrame(found["large"], asked.select(*BOOK).schema)
        out = out.unionByName(by_keys(_of(asked, large), _of(rows, large)), allowMissingColumns=True)
        asked, rows = (df.join(large, BOOK, "left_anti") for df in (asked, rows))
    for i in range(rounds):
        now = F.pmod(F.xxhash64(*BOOK), F.lit(rounds)) == i
        near = (asked.filter(now).select(*requests.columns, F.lit(False).alias("_c"))
                .unionByName(rows.filter(now).select(*[F.col(c).alias(new) for c, new in own.items()], F.lit(True).alias("_c")), allowMissingColumns=True)
                .repartition(max(1, -(-n // rounds // BOOK_ROWS)), *BOOK))
        found = answer(near, either)
        out = out.unionByName(written(found) if rounds > 1 else found, allowMissingColumns=True)
    return out


def _of(df: DataFrame, large: DataFrame) -> DataFrame:
    return df.join(large, BOOK, "left_semi").select(*df.columns)


def _inside(*of: str) -> WindowSpec:
    """All rows of a book that agree in `of`; hashes are sorted by first, which compare faster than texts."""
    return Window.partitionBy(F.xxhash64(*BOOK, *of), *BOOK, *of)


def _best_of_requests(rows: DataFrame, value: str) -> DataFrame:
    """Least value of a request id among the rows that name it, of any book; a null id has none."""
    return rows.withColumn(value, F.when(F.col("request_id").isNotNull(), F.min(value).over(Window.partitionBy("request_id"))))


def lookup_stored(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored body for a requested chapter: the last stored one of its id when that has content,
    else the first with content, in order, that shares url, id or title.

    Every match lies inside a book, so requests and stored chapters are written once, shuffled once by
    book as they are, and list their keys behind the shuffle; a book of more than `BOOK_ROWS` rows goes by its keys.
    """
    names = requests.columns
    requests = written(requests)
    stored = written(stored.select(*CHAPTER, "url", "title", F.col("order_index").alias("_o"), (~is_blank("content")).alias("_filled")))
    found = _in_books(requests, stored, lambda near, either: _stored_in_books(near, either).select(*names, "_m"), _stored_by_keys)
    return _best_of_requests(found, "_m").select(*names, F.col("_m.id").alias("stored_id"), F.col("_m.o").alias("stored_order"))


def _stored_in_books(near: DataFrame, either: Callable[[str], Column]) -> DataFrame:
    listed = near.select("*", F.posexplode_outer(_lookup_keys(either)).alias("_at", "_k"))
    by_key, by_id, c = _inside("_k"), F.col("_k.kind") == "id", F.col("_c")
    # the last chapter matters for ids alone
    last = F.max(F.when(c & by_id, F.struct("_o", "_filled", either("chapter_id").alias("_id")))).over(by_key)
    first = F.min(F.when(c & F.col("_filled"), F.struct("_o", either("chapter_id").alias("_id")))).over(by_key)
    # a chapter without keys shares the null of requests without keys
    return (listed.withColumns({"_last": last, "_first": first}).filter(~c)
            .withColumn("_m", F.when(F.col("_k").isNotNull(), _stored_match()))
            .withColumn("_m", F.min("_m").over(_inside("request_id"))).filter(F.coalesce("_at", F.lit(0)) == 0))


def _stored_match() -> Column:
    return F.when(F.col("_last._filled"), F.struct(F.lit(0).alias("tier"), F.col("_last._o").alias("o"), F.col("_last._id").alias("id"))).when(
        F.col("_first").isNotNull(), F.struct(F.lit(1).alias("tier"), F.col("_first._o").alias("o"), F.col("_first._id").alias("id")))


def _stored_by_keys(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """Requests with the match `_m` of each of their keys, by one equi-join; many stored chapters with one key
    are reduced before it.  Each request is one row for each of its keys."""
    keys, by_id = _lookup_keys(F.col), F.col("_k.kind") == "id"
    side = (stored.select(*BOOK, "_o", "_filled", F.col("chapter_id").alias("_id"), F.explode(keys).alias("_k"))
            .filter(F.col("_filled") | by_id)
            .groupBy(*BOOK, "_k").agg(F.max(F.when(by_id, F.struct("_o", "_filled", "_id"))).alias("_last"),
                                      F.min(F.when(F.col("_filled"), F.struct("_o", "_id"))).alias("_first")))
    asked = (requests.select(*requests.columns, F.posexplode_outer(keys).alias("_at", "_k"))
             .join(side.select(*BOOK, "_k", _stored_match().alias("_m")), [*BOOK, "_k"], "left"))
    return _best_of_requests(asked, "_m").filter(F.coalesce("_at", F.lit(0)) == 0).select(*requests.columns, "_m")


def same_chapter(requests: DataFrame, chapters: DataFrame) -> DataFrame:
    """Position of a chapter identical to a requested one, by id, by url, or by title and order
    together: the clamped fallback index if that chapter is one, else the first; the fallback index
    when none matches.

    Requests and chapters are shuffled as by `lookup_stored`.  A key is listed alone, for the least position, and
    with a position, to tell whether the fallback chapter has it, which counts as position -1.
    """
    names = ["request_id", *BOOK, *[c for c in requests.columns if c not in ("request_id", *BOOK)]]
    requests = written(requests)
    chapters = written(chapters.select(*CHAPTER, "url", "title", "order_index", "position"))
    chapters = chapters.withColumnRenamed("position", "_position")
    found = _in_books(requests, chapters, lambda near, either: _same_in_books(near, either).select(*names, "_at", "_p"), _same_by_keys)
    at = F.coalesce("_at", F.lit(0))
    return _best_of_requests(found, "_p").select(*names, F.when(F.col("_p") >= 0, F.col("_p")).otherwise(at).alias("matched_index"))


def _same_in_books(near: DataFrame, either: Callable[[str], Column]) -> DataFrame:
    c = F.col("_c")
    placed = near.withColumn("_last", F.max("_position").over(_inside())).withColumn("_at", F.when(c, F.col("_position")).otherwise(_clamped(F.col("fallback_index"))))
    keys = _same_keys(either)
    alone = F.transform(keys, lambda k: F.struct(k.alias("k"), F.lit(None).cast("long").alias("p")))
    there = F.filter(F.transform(keys, lambda k: F.struct(k.alias("k"), F.col("_at").cast("long").alias("p"))), lambda k: k["p"].isNotNull())
    listed = placed.select("*", F.posexplode_outer(F.concat(alone, there)).alias("_n", "_k"))
    first = F.min("_position").over(_inside("_k")).cast("long")
    return (listed.withColumn("_p", F.when(F.col("_k").isNotNull(), first)).filter(~c)
            .withColumn("_p", F.when(F.col("_p").isNotNull() & F.col("_k.p").isNotNull(), F.lit(-1).cast("long")).otherwise(F.col("_p")))
            .withColumn("_p", F.min("_p").over(_inside("request_id"))).filter(F.coalesce("_n", F.lit(0)) == 0))


def _clamped(index: Column) -> Column:
    return F.when(F.col("_last").isNull(), F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(F.coalesce(index, F.lit(0)), F.col("_last"))))


def _same_by_keys(requests: DataFrame, chapters: DataFrame) -> DataFrame:
    """Requests with the fallback index `_at` and the least position `_p`, by equi-joins."""
    both = _same_keys(F.col)
    side = chapters.select(*BOOK, F.explode(both).alias("_k"), F.col("_position").alias("_p"))
    sizes = chapters.groupBy(*BOOK).agg(F.max("_position").alias("_last"))
    asked = requests.join(sizes, BOOK, "left").withColumn("_at", _clamped(F.col("fallback_index")))
    keyed = asked.select("request_id", *BOOK, "_at", F.explode(both).alias("_k"))
    # the least position of a key combines before the shuffle; the fallback chapter is found by its
    # position, where its keys are compared, so they are not shuffled a second time
    first = keyed.join(side.groupBy(*BOOK, "_k").agg(F.min("_p").alias("_p")), [*BOOK, "_k"]).select("request_id", "_p")
    there = chapters.select(*BOOK, F.col("_position").alias("_at"), both.alias("_has"))
    here = (asked.select("request_id", *BOOK, "_at", both.alias("_ks")).join(there, [*BOOK, "_at"])
            .filter(F.arrays_overlap("_ks", "_has")).select("request_id", F.lit(-1).cast("long").alias("_p")))
    best = first.select("request_id", F.col("_p").cast("long").alias("_p")).unionByName(here).groupBy("request_id").agg(F.min("_p").alias("_p"))
    return asked.join(best, "request_id", "left").select(*requests.columns, "_at", "_p")


def resume_index(items: DataFrame, chapters: DataFrame) -> DataFrame:
    """Zero-based chapter index to resume at: last read id, else the stored index clamped, else 0."""
    by_id = chapters.filter(~is_blank("chapter_id")).groupBy(*BOOK, trim_u("chapter_id").alias("_id")).agg(
        F.min("position").alias("_p"))
    sizes = chapters.groupBy(*BOOK).agg(F.count(F.lit(1)).alias("_n"))
    df = (items.withColumn("_id", trim_u(F.coalesce("last_read_chapter_id", F.lit(""))))
          .join(by_id, [*BOOK, "_id"], "left").join(sizes, BOOK, "left"))
    hint = F.coalesce("last_read_chapter_index", F.lit(0))
    index = (F.when(F.coalesce("_n", F.lit(0)) == 0, F.lit(0).cast("bigint"))
             .when(F.col("_p").isNotNull(), F.col("_p"))
             .when(hint > 0, F.least(hint, F.col("_n") - 1)).otherwise(F.lit(0).cast("bigint")))
    return df.withColumn("resume_index", index).drop("_id", "_p", "_n")


def fallback_match(books: DataFrame, hits: DataFrame) -> DataFrame:
    """Hit for a book: same id, else the first hit whose title and author equal the book's without
    white space; a blank title or author of the book matches anything.  Books of one id share a match.

    Every match lies inside a site, so books and hits are shuffled once, by site, as they are; the keys
    they meet by are listed behind the shuffle.  Sites of more than `SITE_ROWS` rows go by their keys.
    """
    sizes = books.select("site").unionByName(hits.select("site")).groupBy("site").agg(F.count(F.lit(1)).alias("n"))
    found = sizes.agg(F.sum("n").alias("n"), F.collect_list(F.when(F.col("n") > SITE_ROWS, F.col("site"))).alias("large")).first()
    parts = max(1, -(-(found["n"] or 0) // SITE_ROWS))
    if not found["large"]:
        return _match_in_sites(books, hits, parts)
    large = F.coalesce(F.col("site").isin(found["large"]), F.lit(False))
    return (_match_in_sites(books.filter(~large), hits.filter(~large), parts)
            .unionByName(_match_by_keys(books.filter(large), hits.filter(large))))


_HIT = ("ord", "book_id", "title", "author", "description", "cover_url", "url")


def _match_key(kind: str, *of: Column) -> Column:
    a, b = (*of, F.lit(""), F.lit(""))[:2]
    return F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"))


def _hit_keys(t: Column, a: Column, i: Column) -> Column:
    """Every key a book may ask by."""
    return F.array(_match_key("id", i), _match_key("both", t, a), _match_key("title", t), _match_key("author", a), _match_key("any"))


def _book_keys(t: Column, a: Column, i: Column) -> Column:
    """The id, and the one other key that a book does ask by."""
    ask = (F.when((t != "") & (a != ""), _match_key("both", t, a)).when(t != "", _match_key("title", t))
           .when(a != "", _match_key("author", a)).otherwise(_match_key("any")))
    return F.array(_match_key("id", i), ask)


def _asked_by(title: Column, author: Column, book_id: Column) -> tuple[Column, Column, Column]:
    """What keys are made of: title and author without white space, and the id."""
    squash = lambda c: F.regexp_replace(trim_u(F.coalesce(c, F.lit(""))), r"[ \t\n\f\r]+", "")
    return squash(title), squash(author), trim_u(book_id)


def _match_in_sites(books: DataFrame, hits: DataFrame, parts: int) -> DataFrame:
    """`fallback_match` with all rows of a site in one task.  Rows are sorted by hashes of their keys
    first, which compare faster than texts."""
    asked = books.select("site", F.struct(*books.columns).alias("_b"))
    offered = hits.filter(F.col("site").isNotNull()).select("site", F.struct(*_HIT).alias("_h"))
    near = asked.unionByName(offered, allowMissingColumns=True).repartition(parts, "site")
    is_hit = F.col("_h").isNotNull()
    either = lambda c: F.when(is_hit, F.col(f"_h.{c}")).otherwise(F.col(f"_b.{c}"))
    t, a, i = (F.col(c) for c in ("_t", "_a", "_i"))
    keyed = (near.withColumns(dict(zip(("_t", "_a", "_i"), _asked_by(either("title"), either("author"), either("book_id")), strict=True)))
             .select("site", "_b", "_h", F.when(is_hit, _hit_keys(t, a, i)).otherwise(_book_keys(t, a, i)).alias("_keys")))
    listed = keyed.select("site", "_b", "_h", F.posexplode_outer("_keys").alias("_tier", "_k")).withColumn("_hash", F.xxhash64("site", "_k"))
    by_key = Window.partitionBy("_hash", "site", "_k")
    found = F.when(F.count("_h").over(by_key) > 0, F.struct(F.min_by("_h", "_h.ord").over(by_key).alias("hit")))
    answered = listed.select("site", "_b", "_h", "_tier", found.alias("_found")).filter(~is_hit)
    by_book = Window.partitionBy(F.xxhash64("site", "_b.book_id"), "site", "_b.book_id")
    order = F.when(F.col("_found").isNotNull(), F.struct("_tier", "_found.hit.ord"))
    best = answered.select("_b", "_tier", F.min_by("_found.hit", order).over(by_book).alias("_m"))
    known = F.col("_b.site").isNotNull() & F.col("_b.book_id").isNotNull()
    return best.filter(F.col("_tier") == 1).select("_b.*", F.when(known, F.col("_m")).alias("match"))


def _match_by_keys(books: DataFrame, hits: DataFrame) -> DataFrame:
    """`fallback_match` as one equi-join on keys reduced to their first hit, before they are shuffled."""
    own = [F.col(c) for c in ("title", "author", "book_id")]
    side = (hits.select("site", F.struct(*_HIT).alias("_hit"), F.explode(_hit_keys(*_asked_by(*own))).alias("_k"))
            .groupBy("site", "_k").agg(F.min_by("_hit", F.col("_hit.ord")).alias("_h")))
    best = (books.select(*BOOK, F.posexplode(_book_keys(*_asked_by(*own))).alias("_tier", "_k")).join(side, ["site", "_k"])
            .groupBy(*BOOK).agg(F.min_by("_h", F.struct("_tier", "_h.ord")).alias("match")))
    return books.join(best, BOOK, "left").select(*books.columns, "match")


def fill_from_match(matched: DataFrame) -> DataFrame:
    """Fill blank book fields from the matched hit."""
    pairs = [("title", "title"), ("author", "author"), ("description", "description"),
             ("cover_url", "cover_url"), ("source_url", "url")]
    return matched.withColumns({
        c: F.coalesce(nullif_blank(c), F.col(f"match.{m}"), F.col(c)) for c, m in pairs}).drop("match")


def merge_catalog_pages(pages: DataFrame) -> DataFrame:
    """Chapters by absolute position from pages of (page, page_size, index, arrival); the page that
    arrived last wins a position."""
    rest = [c for c in pages.columns if c not in (*BOOK, "page", "page_size", "index", "arrival")]
    pos = F.greatest((F.col("page") - 1) * F.col("page_size"), F.lit(0)) + F.col("index")
    return (pages.withColumn("position", pos).groupBy(*BOOK, "position")
            .agg(F.max_by(F.struct(*rest), F.col("arrival")).alias("_c")).select(*BOOK, "position", "_c.*"))


def permute(items: Column | str, order: Column | str) -> Column:
    """Array with element i moved to slot order[i]."""
    c = F.col(items) if isinstance(items, str) else items
    o = F.col(order) if isinstance(order, str) else order
    moved = F.array_sort(F.transform(c, lambda x, i: F.struct(F.get(o, i).alias("to"), x.alias("v"))))
    return F.transform(moved, lambda s: s["v"])


# ---- paging -----------------------------------------------------------------------------------

def chapter_page_bounds(total: Column, page: int, page_size: int) -> list[Column]:
    """Chapter page envelope: size at most 500, page clamped to the last one."""
    page = page if page > 0 else 1
    size = min(page_size if page_size > 0 else DEFAULT_PAGE_SIZE, MAX_PAGE_SIZE)
    pages = F.greatest(F.ceil(total / size), F.lit(1)).cast("bigint")
    at = F.least(F.lit(page).cast("bigint"), pages)
    offset = F.least((at - 1) * size, total)
    end = F.least(offset + size, total)
    return [at.alias("page"), F.lit(size).alias("page_size"), total.alias("total"), (offset > 0).alias("has_prev"),
            (total > end).alias("has_next"), offset.alias("offset"), end.alias("end")]


def chapter_page(numbered: DataFrame, page: int, page_size: int) -> DataFrame:
    """One chapter page of every book; rows carry `order_index` 1..n."""
    sizes = numbered.groupBy(*BOOK).agg(F.max("order_index").alias("_n"))
    bounds = sizes.select(*BOOK, *chapter_page_bounds(F.col("_n"), page, page_size)).select(
        *BOOK, "page", "offset", "end")
    return (numbered.join(bounds, BOOK)
            .filter((F.col("order_index") > F.col("offset")) & (F.col("order_index") <= F.col("end")))
            .drop("offset", "end"))


def page_count(total: Column, size: int) -> Column:
    return F.when((total <= 0) | F.lit(size <= 0), F.lit(0).cast("bigint")).otherwise(
        F.ceil(total / max(size, 1)).cast("bigint"))


def page_bounds(total: Column, page: Column, size: int) -> tuple[Column, Column]:
    """Zero-based page clamped into range, as start and end offsets."""
    last = page_count(total, size) - 1
    at = F.greatest(F.lit(0), F.least(page, last))
    none = (total <= 0) | F.lit(size <= 0)
    zero = F.lit(0).cast("bigint")
    start = F.when(none, zero).otherwise(at * size)
    return start, F.when(none, zero).otherwise(F.least(at * size + size, total))


def page_of_index(index: Column, size: int) -> Column:
    return F.when((index <= 0) | F.lit(size <= 0), F.lit(0).cast("bigint")).otherwise(F.floor(index / max(size, 1)))


def context_window(chapters: DataFrame, radius: int, order: str = "order_index", value: str = "chapter_id") -> DataFrame:
    """Neighbours within `radius` positions, for chapters numbered without gaps in a book.  Blocks
    overlap by the radius, so a window never spans more than one block."""
    block = F.floor((F.col(order) - 1) / BLOCK_ROWS).cast("bigint")
    at = (F.col(order) - 1) % BLOCK_ROWS
    blocks = F.array_compact(F.array(
        block, F.when((at < radius) & (block > 0), block - 1), F.when(at >= BLOCK_ROWS - radius, block + 1)))
    rows = (chapters.withColumn("_own", block).withColumn("_b", F.explode(blocks)))
    w = Window.partitionBy(*BOOK, "_b").orderBy(order).rowsBetween(-radius, radius)
    return (rows.withColumn("neighbours", F.collect_list(value).over(w))
            .filter(F.col("_b") == F.col("_own")).drop("_b", "_own"))


def forward_fill(rows: DataFrame, keys: list[str], order: str, heading: str, out: str = "volume") -> DataFrame:
    """Volume of each row: the last heading at or before it, else empty."""
    from ..plans.ordering import running
    filled = running(rows, keys, order, block_of(order, BLOCK_ROWS), **{out: ("last", nullif_blank(heading))})
    return filled.withColumn(out, F.coalesce(out, F.lit("")))


def collect_after_marker(rows: DataFrame, keys: list[str], order: str, is_marker: Column) -> DataFrame:
    """Rows after the first marker of their group; every row when the group has no marker."""
    starts = rows.filter(is_marker).groupBy(*keys).agg(F.min(order).alias("_from"))
    return (rows.join(starts, keys, "left")
            .filter(F.col("_from").isNull() | (F.col(order) > F.col("_from"))).filter(~is_marker).drop("_from"))


def volume_positions(items: DataFrame, keys: list[str], volume_pos: str, key: str, pos: list[str], out: str = "pos") -> DataFrame:
    """Reading order of catalog items as a number: volumes in place, items by key inside a volume."""
    return number_rows_any(items, keys, [F.col(c) for c in (volume_pos, key, *pos)], out)


def merge_ordered(a: Column | str, b: Column | str) -> Column:
    return F.array_union(a, b)


def without(items: Column | str, value: str) -> Column:
    return F.filter(F.col(items) if isinstance(items, str) else items, lambda x: x != value)
