"""Incremental library update as one plan: requests, plans, stored chapters, fetched pages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.convert import convert_columns
from ..functions.text import is_blank, nullif_blank
from ..operators.library import BOOK, CHAPTER, chapter_range, failure_totals, merge_stored, pending, usable_books
from .stages import staged


def plan_work(requests: DataFrame, listing: DataFrame, stored: DataFrame, sources: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Chapters of the requested ranges filled from the store, and those still to fetch."""
    wanted = chapter_range(listing, requests)
    merged = merge_stored(wanted, stored, sources)
    return merged, pending(merged)


def apply_fetched(merged: DataFrame, fetched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replace pending chapters by their fetch results (site, book_id, chapter_id, content, error, and where
    given title, url and volume), and the outcome per book.  A fetched chapter keeps the planned title,
    URL or volume only where the fetch has none.  Books whose pending chapters all failed are left out."""
    own = [c for c in ("title", "url", "volume") if c in fetched.columns and c in merged.columns]
    got = fetched.select(*CHAPTER, F.col("content").alias("_content"), F.col("error").alias("_error"), *[F.col(c).alias(f"_{c}") for c in own])
    totals = failure_totals(fetched)
    df = merged.join(got, CHAPTER, "left").join(totals.filter("all_failed").select(*BOOK), BOOK, "left_anti")
    ok = (F.coalesce("_error", F.lit("")) == "") & ~is_blank("_content")
    df = df.withColumns({"content": F.when(ok, F.col("_content")).otherwise(F.col("content")), "downloaded": F.col("downloaded") | ok,
                         **{c: F.when(ok, F.coalesce(nullif_blank(f"_{c}"), F.col(c))).otherwise(F.col(c)) for c in own}})
    return df.drop("_content", "_error", *[f"_{c}" for c in own]), totals


def finish(chapters: DataFrame, steps: Sequence[tuple[str, dict]], locale_style: str | None = None,
           mapping: Mapping[str, str] | None = None) -> DataFrame:
    """Convert, clean and drop books without any usable body; the result carries its stage."""
    df = convert_columns(chapters, locale_style, mapping or {}, ["title", "content", "volume"])
    df = staged(df, steps)
    return df.join(usable_books(df).filter("usable").select(*BOOK), BOOK, "left_semi")
