import random

from pyspark.sql import functions as F

from folioflow.operators import search as S

HIT = "keyword string, site string, book_id string, title string, author string, description string, url string, latest_chapter string, cover_url string, site_rank int, ord long"


def hit(keyword, site, book_id, title, author="", description="", latest="", cover="", rank=1000, ord=0):
    return (keyword, site, book_id, title, author, description, "", latest, cover, rank, ord)


def books(spark, rows):
    scored = S.score_hits(spark.createDataFrame(rows, HIT), F.col("keyword"))
    return S.resolve_books(S.variants(scored))


def test_same_title_and_author_is_one_book(spark):
    rows = [hit("three body", "second", "200", "Three Body", "Liu", rank=4, ord=2),
            hit("three body", "first", "100", "Three  Body!", "liu", "desc", rank=1, ord=1)]
    got = books(spark, rows).collect()
    assert len(got) == 1
    assert (got[0].source_count, got[0].preferred_site, got[0].description) == (2, "first", "desc")


def test_keyword_in_any_field_keeps_a_hit(spark):
    rows = [hit("Alpha", "s", "100", "Alpha Journey"), hit("Alpha", "s", "101", "Unrelated"),
            hit("Alpha", "s", "102", "x", description="has ALPHA"), hit("Alpha", "s", "103", "y", latest="alpha 9")]
    df = spark.createDataFrame(rows, HIT)
    assert sorted(r.book_id for r in S.keyword_filter(df, F.col("keyword")).collect()) == ["100", "102", "103"]
    assert S.keyword_filter(df, F.lit(" !")).count() == 4


def test_exact_title_beats_a_better_ranked_partial_one(spark):
    rows = [hit("诡秘之主", "top", "1", "诡秘之主的衍生外传故事集", "佚名", "d", cover="c", rank=0),
            hit("诡秘之主", "low", "2", "诡秘之主", "爱潜水的乌贼", rank=5)]
    ranked = S.rank_results(books(spark, rows), 10).orderBy("position").collect()
    assert [r.primary_book_id for r in ranked] == ["2", "1"]
    assert ranked[0].relevance > ranked[1].relevance


def test_edit_distance_counts_characters(spark):
    from folioflow.functions.scores import similarity
    got = spark.range(1).select(similarity(F.lit("诡秘之主"), F.lit("诡秘之王")).alias("s")).first().s
    assert abs(got - 0.75) < 1e-12


def sequential(rows):
    """One hit at a time, in arrival order: the definition the aggregates must equal."""
    groups = {}
    for r in sorted(rows, key=lambda r: r["ord"]):
        g = groups.setdefault(r["group_key"], {"variants": [], "best": None})
        if any((v["site"], v["book_id"]) == (r["site"], r["book_id"]) for v in g["variants"]):
            continue
        g["variants"].append(r)
        order = lambda h: (-h["score"], h["site_rank"], -len(h["description"].encode()), h["cover_url"] == "", h["book_id"])
        if g["best"] is None or order(r) < order(g["best"]):
            g["best"] = r
    out = {}
    for key, g in groups.items():
        vs, p = sorted(g["variants"], key=lambda v: (v["site_rank"], v["book_id"])), g["best"]
        description, cover = p["description"], p["cover_url"]
        for v in vs:
            if len(v["description"].encode()) > len(description.encode()):
                description = v["description"]
            cover = cover or v["cover_url"]
        out[key] = (p["site"], p["book_id"], description, cover, len(vs), round(p["score"] + 0.05 * (len(vs) - 1), 9))
    return out


def test_resolution_equals_the_sequential_fold_for_any_partitioning(spark):
    rnd = random.Random(7)
    rows = [hit("cold widget", f"s{rnd.randint(0, 6)}", str(rnd.randint(1, 25)), rnd.choice(["Cold Widget", "cold bolt", "Widget"]),
                rnd.choice(["", "Ann", "Bo"]), rnd.choice(["", "é" * rnd.randint(1, 4), "text"]), cover=rnd.choice(["", "/c"]),
                rank=0, ord=i) for i in range(400)]
    rows = [(*r[:9], int(r[1][1:]) if int(r[1][1:]) < 4 else 1000, r[10]) for r in rows]
    df = spark.createDataFrame(rows, HIT)
    want = sequential([r.asDict() for r in S.score_hits(df, F.col("keyword")).collect()])
    for n in (1, 7, 64):
        scored = S.score_hits(df.repartition(n), F.col("keyword"))
        got = {r.group_key: (r.preferred_site, r.primary_book_id, r.description, r.cover_url, r.source_count, round(r.score, 9))
               for r in S.resolve_books(S.variants(scored)).collect()}
        assert got == want


def test_keyword_matches_agree_with_brute_force(spark, monkeypatch):
    rnd = random.Random(3)
    words = ["abc", "zed", "é1", "主", "longerword", "kk"]
    items = [("s", str(i), " ".join(rnd.choices(words, k=3)), rnd.choice(words), " ".join(rnd.choices(words, k=30)), "", "") for i in range(60)]
    df = spark.createDataFrame(items, "site string, book_id string, title string, author string, description string, latest_chapter string, cover_url string")
    keys = ["abc", "Zed é1", "主", "k", "longerwordabc", "nothing here", "kk kk", "!"]
    kw = spark.createDataFrame([(k,) for k in keys], "keyword string")
    strip = lambda t: "".join(c for c in t.lower() if c.isalnum())
    want = {(k, i[1]) for k in keys if strip(k) for i in items if any(strip(k) in strip(f) for f in (i[2], i[3], i[4]))}
    for words_of_filter, gram in ((1 << 14, 8), (1, 8), (1 << 14, 2)):  # a full filter lets everything through
        monkeypatch.setattr(S, "FILTER_WORDS", words_of_filter)
        got = S.match_keywords(df, kw, ["site", "book_id"], max_gram=gram)
        pairs = [(r.keyword, r.book_id) for r in got.collect()]
        assert len(pairs) == len(set(pairs)) and set(pairs) == want
    assert S.match_keywords(df, kw.limit(0), ["site", "book_id"]).collect() == []


def test_page_is_a_slice_of_the_ranking(spark):
    rows = [hit("w", "s", str(i), f"w{i:02d}", ord=i) for i in range(23)]
    b = books(spark, rows)
    whole = [r.primary_book_id for r in S.rank_results(b, 100).orderBy("position").collect()]
    assert [r.primary_book_id for r in S.result_page(b, 3, 10).orderBy("position").collect()] == whole[20:]
    info = b.agg(F.count(F.lit(1)).alias("n")).select(*S.page_info(F.col("n"), 3, 10)).first()
    assert (info.total, info.has_prev, info.has_next, info.total_exact) == (23, True, False, True)
