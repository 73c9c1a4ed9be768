"""Federated catalog search: filter, resolve hits to books, score, rank and page."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scores
from ..functions.text import first_non_blank, norm, norm_index, nullif_blank, trim_u

DEFAULT_PER_SOURCE = 8
#: Words of the filter of keyword grams: a million bits at least, 16 for each keyword, 67 million at most.
FILTER_WORDS, MOST_FILTER_WORDS = 1 << 14, 1 << 20
HIT_FIELDS = ["title", "author", "description", "url", "latest_chapter", "cover_url"]
HIT_COLUMNS = ["site", "book_id", *HIT_FIELDS]


# ---- sources ---------------------------------------------------------------------------------

def clean_source_keys(keys: Column | str) -> Column:
    """Array of source keys: trimmed, blanks dropped, first of equals kept in order."""
    c = F.col(keys) if isinstance(keys, str) else keys
    return F.array_distinct(F.filter(F.transform(c, trim_u), lambda x: x != ""))


def allowed_sources(df: DataFrame, allowed: DataFrame, key: str = "site") -> DataFrame:
    return df.join(allowed.select(key).distinct(), key, "left_semi")


def searchable_sources(sources: DataFrame, hidden: list[str] = ()) -> DataFrame:
    """Sources that can search and download and are not hidden."""
    keep = F.col("capabilities.search") & F.col("capabilities.download")
    if hidden:
        keep = keep & ~F.col("key").isin(*hidden)
    return sources.filter(keep)


def default_sources(sources: DataFrame, capability: str) -> DataFrame:
    """Curated sources having a capability, in curated order."""
    return (sources.filter(F.col("default_rank").isNotNull() & F.col(f"capabilities.{capability}"))
            .orderBy("default_rank"))


def with_all_tags(sources: DataFrame, selected: list[str]) -> DataFrame:
    """Sources carrying every selected tag; no selection keeps all."""
    if not selected:
        return sources
    tags = F.transform("tags", trim_u)
    return sources.filter(F.size(F.array_except(F.array(*map(F.lit, selected)), tags)) == 0)


def tag_facets(sources: DataFrame, order: str) -> DataFrame:
    """Tag counts with the position where a tag is first seen."""
    tags = F.filter(F.transform("tags", trim_u), lambda t: t != "")
    return (sources.select(F.col(order).alias("_o"), F.posexplode(tags).alias("_p", "tag"))
            .groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_o", "_p")).alias("first_seen")))


def prune_selection(selected: DataFrame, visible: DataFrame, key: str = "site") -> DataFrame:
    """Selected keys flagged with whether they stay visible."""
    seen = visible.select(key).distinct().withColumn("_v", F.lit(True))
    return selected.join(seen, key, "left").withColumn("kept", F.coalesce("_v", F.lit(False))).drop("_v")


def configured_features(sources: DataFrame) -> DataFrame:
    """Names of the non-empty settings of each source; sources without any are left out."""
    # Labels of the settings.
    named = [("username", "用户名"), ("password", "密码"), ("cookie", "Cookie")]
    flags = [F.when(nullif_blank(c).isNotNull(), F.lit(label)) for c, label in named]
    flags += [F.when(F.size("mirror_hosts") > 0, F.lit("镜像")),
              F.when(F.col("workers") > 0, F.concat(F.lit("协程="), F.col("workers").cast("string"))),
              F.when(~F.col("include_picture"), F.lit("不抓图"))]
    return (sources.select("site", F.array_compact(F.array(*flags)).alias("enabled"))
            .filter(F.size("enabled") > 0))


# ---- hits ------------------------------------------------------------------------------------

def union_hits(*per_source: DataFrame) -> DataFrame:
    out = per_source[0]
    for h in per_source[1:]:
        out = out.unionByName(h)
    return out


def keyword_filter(hits: DataFrame, keyword: Column) -> DataFrame:
    """Hits whose title, author, description or latest chapter contains the normalised keyword;
    an empty keyword keeps every hit."""
    k = norm(keyword)
    found = F.lit(False)
    for c in ("title", "author", "description", "latest_chapter"):
        found = found | F.contains(norm(F.coalesce(F.col(c), F.lit(""))), k)
    return hits.filter((k == "") | found)


def top_per_source(hits: DataFrame, limit: int = DEFAULT_PER_SOURCE, by: list[str] = ("keyword", "site"),
                   order: str = "ord") -> DataFrame:
    """First `limit` hits of each source.  The rank filter becomes a limit before the shuffle."""
    w = Window.partitionBy(*by).orderBy(order)
    return hits.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit).drop("_rn")


def sequential_union(hits: DataFrame, overall: int, source_pos: str = "source_pos", order: str = "ord") -> DataFrame:
    """Hits in source order up to an overall cap."""
    return hits.orderBy(source_pos, order).limit(overall) if overall > 0 else hits.orderBy(source_pos, order)


def dedupe_hits(hits: DataFrame, order: str = "ord", keys: list[str] = ("site", "book_id")) -> DataFrame:
    """First hit of each (site, book id); blank ids are dropped.  Aggregated before the shuffle."""
    rest = [c for c in hits.columns if c not in keys]
    return (hits.filter(F.coalesce("book_id", F.lit("")) != "")
            .groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_h"))
            .select(*keys, "_h.*"))


def score_hits(hits: DataFrame, keyword: Column, sources: DataFrame | None = None) -> DataFrame:
    """Add group key, source rank, score and relevance.

    `sources` gives (site, site_rank); hits that already carry `site_rank` need none.
    """
    df = hits
    if sources is not None:
        df = df.join(sources.select("site", "site_rank"), "site", "left")
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    df = df.withColumns({c: blank(c) for c in HIT_FIELDS})
    df = df.withColumns({
        "_k": norm(keyword), "_t": norm(F.col("title")), "_a": norm(F.col("author")),
        "site_rank": F.coalesce("site_rank", F.lit(scores.UNRANKED)).cast("int")})
    key = (F.when((F.col("_t") == "") & (F.col("_a") == ""), F.concat_ws("|", "site", "book_id"))
           .when(F.col("_a") == "", F.col("_t")).otherwise(F.concat_ws("|", "_t", "_a")))
    k, t, a = F.col("_k"), F.col("_t"), F.col("_a")
    # the edit distances are columns of their own, so both scores share one computation
    df = df.withColumns({"group_key": key, "_st": scores.similarity(k, t), "_sa": scores.similarity(k, a)})
    st, sa = F.col("_st"), F.col("_sa")
    return df.withColumns({
        "relevance": scores.relevance(k, t, a, st, sa),
        "score": scores.hit_score(k, a, st, sa, F.col("description"), F.col("cover_url"), F.col("latest_chapter"), F.col("site_rank")),
    }).drop("_k", "_t", "_a", "_st", "_sa")


def variants(scored: DataFrame, by: list[str] = ("keyword",)) -> DataFrame:
    """One row per distinct (site, book id) of a group: the first by `ord`."""
    keys = [*by, "group_key", "site", "book_id"]
    rest = [c for c in scored.columns if c not in keys]
    return (scored.filter(F.coalesce("book_id", F.lit("")) != "")
            .groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col("ord")).alias("_h"))
            .select(*keys, "_h.*"))


def resolve_books(variant_rows: DataFrame, by: list[str] = ("keyword",)) -> DataFrame:
    """Merge the variants of a group into one book row.

    Every pick is a min over an ordering struct, so groups are combined on the map side and no
    group is ever gathered.  Variant order is (source rank, book id, arrival).
    """
    place = ["site_rank", "book_id", "ord"]
    longest = lambda c: F.min(F.struct((-F.octet_length(c)).alias("l"), *place, F.col(c).alias("v")))
    first_set = lambda c: F.min(F.when(F.col(c) != "", F.struct(*place, F.col(c).alias("v"))))
    preference = F.struct(
        (-F.col("score")).alias("neg_score"), F.col("site_rank"),
        (-F.octet_length("description")).alias("neg_description"),
        (F.col("cover_url") == "").alias("no_cover"), F.col("book_id"), F.col("ord"),
        F.col("site"), *[F.col(c) for c in HIT_FIELDS])
    g = variant_rows.groupBy(*by, "group_key").agg(
        F.min(preference).alias("p"), F.count(F.lit(1)).alias("source_count"),
        F.max("relevance").alias("relevance"),
        longest("title").alias("t"), longest("author").alias("a"), longest("description").alias("d"),
        first_set("cover_url").alias("c"), first_set("latest_chapter").alias("n"))
    described = F.when(F.col("p.neg_description") <= F.col("d.l"), F.col("p.description")).otherwise(F.col("d.v"))
    or_first = lambda own, alt: F.when(own != "", own).otherwise(F.coalesce(alt, F.lit("")))
    return g.select(
        *by, "group_key",
        first_non_blank("p.title", "t.v").alias("title"),
        first_non_blank("p.author", "a.v").alias("author"),
        described.alias("description"),
        or_first(F.col("p.cover_url"), F.col("c.v")).alias("cover_url"),
        or_first(F.col("p.latest_chapter"), F.col("n.v")).alias("latest_chapter"),
        F.col("p.site").alias("preferred_site"), F.col("p.book_id").alias("primary_book_id"),
        F.col("p.url").alias("primary_url"), F.col("p.site_rank").alias("preferred_rank"),
        "source_count",
        (-F.col("p.neg_score") + (F.col("source_count") - 1) * F.lit(scores.EXTRA_VARIANT)).alias("score"),
        "relevance")


def result_order() -> list[Column]:
    """Ranking of results.  Relevance is compared at nine decimals: the pairwise tolerance it
    stands for is not an order."""
    return [F.round("relevance", 9).desc(), F.col("score").desc(), F.col("source_count").desc(),
            F.col("preferred_rank").asc(), F.col("title").asc(), F.col("primary_book_id").asc(),
            F.col("group_key").asc()]


def rank_results(books: DataFrame, limit: int, by: list[str] = ("keyword",)) -> DataFrame:
    """Top `limit` results of each keyword with their 1-based position."""
    w = Window.partitionBy(*by).orderBy(*result_order())
    return books.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= limit)


def result_page(books: DataFrame, page: int, page_size: int) -> DataFrame:
    """One page of one keyword's results: top-k of everything up to the page end, then the slice."""
    page, page_size = max(page, 1), page_size if page_size > 0 else 20
    top = books.orderBy(*result_order()).limit(page * page_size)
    w = Window.orderBy(*result_order())
    return (top.withColumn("position", F.row_number().over(w))
            .filter(F.col("position") > (page - 1) * page_size))


def page_info(total: Column, page: int, page_size: int) -> list[Column]:
    """Page envelope columns from the number of results."""
    page, page_size = max(page, 1), page_size if page_size > 0 else 20
    offset = F.least(F.lit((page - 1) * page_size).cast("bigint"), total)
    end = F.least(offset + page_size, total)
    return [F.lit(page).alias("page"), F.lit(page_size).alias("page_size"), total.alias("total"),
            (offset > 0).alias("has_prev"), (total > end).alias("has_next"),
            (total <= end).alias("total_exact")]


def warnings_by_source(errors: DataFrame) -> DataFrame:
    """Distinct source errors with their counts, ordered by source."""
    return errors.groupBy("site", "error").agg(F.count(F.lit(1)).alias("n")).orderBy("site", "error")


# ---- keyword index ---------------------------------------------------------------------------

def _grams(text: Column, n: int) -> Column:
    """Character n-grams, in one pass over the text."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


def _filter_words(keywords: int) -> int:
    """A power of two, so that filters of few different sizes are made."""
    return min(MOST_FILTER_WORDS, max(FILTER_WORDS, 1 << (keywords // 4).bit_length()))


def _filter_places(gram: Column, words: int) -> list[Column]:
    return [F.pmod(F.xxhash64(*seed, gram), F.lit(64 * words)) for seed in ((), (F.lit(1),))]


def _filter_of(grams: DataFrame, words: int) -> Column:
    """Bits of all grams as one array of `words`, a scalar subquery."""
    place = F.col("_place")
    bits = (grams.select(F.explode(F.array(*_filter_places(F.col("_gram"), words))).alias("_place"))
            .select(F.shiftright(place, 6).alias("id"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int")).alias("_bit"))
            .groupBy("id").agg(F.bit_or("_bit").alias("_bits")))
    every = grams.sparkSession.range(words).join(bits, "id", "left").agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("_bits", F.lit(0).cast("long")).alias("b")))).alias("w"))
    return every.select(F.transform("w", lambda w: w["b"])).scalar()


def _in_filter(bits: Column, gram: Column, words: int) -> Column:
    one, two = (F.call_function("shiftright", F.get(bits, F.shiftright(place, 6).cast("int")), F.pmod(place, F.lit(64)).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
                for place in _filter_places(gram, words))
    return one & two


def match_keywords(items: DataFrame, keywords: DataFrame, item_key: list[str], char_map: Mapping[str, str] | None = None, max_gram: int = 8) -> DataFrame:
    """All (keyword, item) pairs whose index score is positive, by one plan for any number of keywords.

    A pair can only match if every gram of the keyword occurs in the item.  Each keyword is looked up by
    a single gram of `max_gram` characters (shorter keywords as a whole), the one that fewest keywords
    share.  Items drop all grams that are not in a filter of these before grams and ids are shuffled; what
    meets is verified on the texts.  Keywords are counted first, for the size of the filter: one that many
    keywords fill lets all grams of all texts through.
    """
    fields = ("title", "author", "description", "latest_chapter")
    k = (keywords.select("keyword").distinct()
         .withColumn("_k", norm_index("keyword", char_map)).filter(F.col("_k") != "")
         .withColumn("_len", F.least(F.char_length("_k"), F.lit(max_gram))))
    sizes = range(1, max_gram + 1)
    cut = F.coalesce(*[F.when(F.col("_len") == n, F.array_distinct(_grams(F.col("_k"), n))) for n in sizes])
    k_grams = k.withColumn("_gram", F.explode(cut))
    shared = k_grams.groupBy("_gram").agg(F.count(F.lit(1)).alias("_f"))
    anchors = (k_grams.join(shared, "_gram").groupBy("keyword", "_k", "_len")
               .agg(F.min(F.struct("_f", "_gram"))["_gram"].alias("_gram")))
    texts = items.withColumns({f"_n_{c}": norm_index(F.coalesce(F.col(c), F.lit("")), char_map) for c in fields})
    # fields are joined by a character that `norm` never keeps, so no match spans two fields
    whole = F.concat_ws("\n", *[f"_n_{c}" for c in fields])
    words = _filter_words(k.count())
    bits, lengths = _filter_of(anchors, words), anchors.agg(F.collect_set("_len")).scalar()
    none = F.array().cast("array<string>")
    wanted = lambda n: F.when(F.array_contains(lengths, n), _grams(whole, n)).otherwise(none)
    grams = texts.select(*item_key, F.explode(F.flatten(F.array(*[wanted(n) for n in sizes]))).alias("_gram")).filter(_in_filter(bits, F.col("_gram"), words))
    pairs = grams.distinct().join(anchors, "_gram").select(*item_key, "keyword", "_k")
    return _scored_matches(pairs.join(texts, item_key), fields)


def _scored_matches(found: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    score = scores.index_score(F.col("_k"), *[F.col(f"_n_{c}") for c in fields],
                               F.coalesce("cover_url", F.lit("")), F.coalesce("description", F.lit("")))
    return (found.withColumn("score", score).filter(F.col("score") > 0)
            .drop("_k", *[f"_n_{c}" for c in fields]))


def top_index_matches(matches: DataFrame, limit: int, by: list[str] = ("keyword",)) -> DataFrame:
    """Best index matches of each keyword: score, then description bytes, then id."""
    w = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.octet_length("description").desc(), "book_id")
    return matches.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= limit)


def title_ranking(items: DataFrame, keyword: Column) -> DataFrame:
    """Title matches with their score; order by `title_order`."""
    k = norm(trim_u(keyword))
    return (items.withColumn("score", scores.title_score(norm(trim_u("title")), k))
            .filter(F.col("score") >= 0))


def title_order() -> list[Column]:
    return [F.col("score").desc(), F.octet_length("title").asc(), F.col("book_id").asc()]


# ---- enrichment ------------------------------------------------------------------------------

def enrich_hits(hits: DataFrame, books: DataFrame, latest: DataFrame, max_items: int | None = None) -> DataFrame:
    """Overlay non-blank book fields on hits; `latest` gives the last non-blank chapter title.
    With `max_items` only hits ranked that high (column `position`) are touched."""
    b = books.select("site", "book_id", *[F.col(c).alias(f"_b_{s}") for c, s in
                     [("title", "title"), ("author", "author"), ("description", "description"),
                      ("source_url", "url"), ("cover_url", "cover_url")]])
    df = hits.join(b, ["site", "book_id"], "left").join(
        latest.select("site", "book_id", F.col("latest_chapter").alias("_b_latest_chapter")),
        ["site", "book_id"], "left")
    on = F.lit(True) if max_items is None else F.col("position") <= max_items
    over = {c: F.when(on, F.coalesce(trim_u(nullif_blank(f"_b_{c}")), F.col(c))).otherwise(F.col(c))
            for c in HIT_FIELDS}
    return df.withColumns(over).drop(*[f"_b_{c}" for c in HIT_FIELDS])


def latest_titles(chapters: DataFrame) -> DataFrame:
    """Last non-blank chapter title of each book."""
    return (chapters.filter(nullif_blank("title").isNotNull()).groupBy("site", "book_id")
            .agg(trim_u(F.max_by("title", "order_index")).alias("latest_chapter")))


def with_chapter_counts(results: DataFrame, chapters: DataFrame, sources: DataFrame) -> DataFrame:
    """Chapter counts of results; sources that need a login, and empty books, give no count."""
    open_sites = sources.filter(~F.col("capabilities.login")).select("site")
    counts = (chapters.join(open_sites, "site", "left_semi").groupBy("site", "book_id")
              .agg(F.count(F.lit(1)).alias("chapter_count")))
    return results.join(counts, ["site", "book_id"], "left")


def build_index(listings: DataFrame, cards: Column, order: list[str]) -> DataFrame:
    """Index rows of listing pages (site, error and what `cards` reads): the cards of all pages that
    could be fetched, each (site, book id) once, the first by `order` and its place on the page."""
    read = listings.filter(F.coalesce("error", F.lit("")) == "")
    hits = read.select("site", *order, F.posexplode(cards).alias("_place", "_card")).select("site", F.struct(*order, "_place").alias("ord"), "_card.*")
    return dedupe_hits(hits).drop("ord")
