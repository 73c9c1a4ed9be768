"""Match scores between a normalised keyword and normalised catalog text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the scores.
UNRANKED = 1000
SIMILAR_CONTAINED, SIMILAR_SPAN = 0.75, 0.2
RELEVANCE_CONTAINED, RELEVANCE_SPAN, RELEVANCE_AUTHOR = 0.9, 0.1, 0.6
SCORE_TITLE, SCORE_AUTHOR, SCORE_AUTHOR_IN_KEYWORD = 0.8, 0.15, 0.1
SCORE_DESCRIPTION, SCORE_COVER, SCORE_LATEST = 0.03, 0.03, 0.02
SOURCE_BONUS, SOURCE_BONUS_STEP, EXTRA_VARIANT = 0.12, 0.005, 0.05
INDEX_TITLE = (1200, 950, 820)
INDEX_AUTHOR = (620, 500, 360)
INDEX_DESCRIPTION, INDEX_LATEST, INDEX_COVER, INDEX_HAS_DESCRIPTION = 220, 120, 20, 15
TITLE_EXACT, TITLE_PREFIX, TITLE_CONTAINS = 4000, 3000, 2000


def similarity(a: Column, b: Column) -> Column:
    """0 to 1: equality, containment by length ratio, else edit distance over the longer length."""
    la, lb = F.char_length(a), F.char_length(b)
    short, long_ = F.least(la, lb), F.greatest(la, lb)
    distance = F.levenshtein(a, b)
    return (F.when((a == "") | (b == ""), F.lit(0.0))
            .when(a == b, F.lit(1.0))
            .when(F.contains(a, b) | F.contains(b, a), F.lit(SIMILAR_CONTAINED) + short / long_ * SIMILAR_SPAN)
            .when(distance >= long_, F.lit(0.0))
            .otherwise(F.lit(1.0) - distance / long_))


def relevance(keyword: Column, title: Column, author: Column, title_similarity: Column, author_similarity: Column) -> Column:
    """How closely a hit matches a keyword, apart from its source; all arguments normalised."""
    coverage = F.char_length(keyword) / F.char_length(title)
    contained = F.when((title != "") & F.contains(title, keyword),
                       F.lit(RELEVANCE_CONTAINED) + coverage * RELEVANCE_SPAN).otherwise(F.lit(0.0))
    by_author = F.when(author != "", author_similarity * RELEVANCE_AUTHOR).otherwise(F.lit(0.0))
    return F.when(keyword == "", F.lit(0.0)).otherwise(
        F.greatest(title_similarity, contained, by_author))


def source_bonus(rank: Column) -> Column:
    return F.when(rank >= UNRANKED, F.lit(0.0)).otherwise(F.lit(SOURCE_BONUS) - rank * SOURCE_BONUS_STEP)


def hit_score(keyword: Column, author: Column, title_similarity: Column, author_similarity: Column,
              description: Column, cover: Column, latest: Column, rank: Column) -> Column:
    """Preference score of one hit; `keyword` and `author` normalised, the rest raw."""
    flag = lambda c, w: F.when(c != "", F.lit(w)).otherwise(F.lit(0.0))
    by_author = F.when(author != "", author_similarity * SCORE_AUTHOR).otherwise(F.lit(0.0))
    named = F.when((author != "") & F.contains(keyword, author),
                   F.lit(SCORE_AUTHOR_IN_KEYWORD)).otherwise(F.lit(0.0))
    return (title_similarity * SCORE_TITLE + by_author + named
            + flag(description, SCORE_DESCRIPTION) + flag(cover, SCORE_COVER)
            + flag(latest, SCORE_LATEST) + source_bonus(rank))


def _tiered(text: Column, keyword: Column, tiers: tuple[int, int, int]) -> Column:
    return (F.when(text == keyword, F.lit(tiers[0]))
            .when(F.startswith(text, keyword), F.lit(tiers[1]))
            .when(F.contains(text, keyword), F.lit(tiers[2]))
            .otherwise(F.lit(0)))


def index_score(keyword: Column, title: Column, author: Column, description: Column, latest: Column,
                raw_cover: Column, raw_description: Column) -> Column:
    """Integer score against an index row; 0 when nothing matches."""
    match = (_tiered(title, keyword, INDEX_TITLE) + _tiered(author, keyword, INDEX_AUTHOR)
             + F.when(F.contains(description, keyword), INDEX_DESCRIPTION).otherwise(0)
             + F.when(F.contains(latest, keyword), INDEX_LATEST).otherwise(0))
    extra = (F.when(raw_cover != "", INDEX_COVER).otherwise(0)
             + F.when(raw_description != "", INDEX_HAS_DESCRIPTION).otherwise(0))
    return F.when(match == 0, F.lit(0)).otherwise(match + extra)


def title_score(title: Column, keyword: Column) -> Column:
    """Title-only score; -1 without a match.  Lengths are in bytes."""
    gap = F.abs(F.octet_length(title) - F.octet_length(keyword))
    return (F.when((title == "") | (keyword == ""), F.lit(-1))
            .when(title == keyword, F.lit(TITLE_EXACT))
            .when(F.startswith(title, keyword), F.lit(TITLE_PREFIX) - gap)
            .when(F.contains(title, keyword), F.lit(TITLE_CONTAINS) - gap)
            .otherwise(F.lit(-1)))
