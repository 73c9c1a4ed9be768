"""Keyword search: the filter of keyword grams grows with the keywords."""

from folioflow.operators import search as S
from pyspark.sql import functions as F


def test_many_keywords_do_not_fill_their_filter(spark, monkeypatch):
    monkeypatch.setattr(S, "FILTER_WORDS", 16)
    keywords = spark.range(3000).select(F.concat(F.lit("kw"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("keyword"))
    seen = []
    inside = S._in_filter
    monkeypatch.setattr(S, "_in_filter", lambda bits, gram, *size: seen.append(inside(bits, gram, *size)) or seen[-1])
    items = spark.range(300).select(F.lit("s").alias("site"), F.col("id").cast("string").alias("book_id"), F.concat(F.lit("other"), F.md5(F.col("id").cast("string"))).alias("title"),
                                    *[F.lit("").alias(c) for c in ("author", "description", "latest_chapter", "cover_url")])
    more = items.limit(1).withColumn("title", F.lit("a kw002999 b"))
    found = S.match_keywords(items.unionByName(more), keywords, ["site", "book_id"])
    assert {r.keyword for r in found.collect()} == {"kw002999"}
    grams = spark.range(20_000).select(F.concat(F.lit("g"), F.col("id").cast("string")).alias("_gram"))
    assert grams.filter(seen[0]).count() < 1500
