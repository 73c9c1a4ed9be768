"""Staged library on files: append-only stage commits with a commit log.

A save appends its rows under a new commit id and then one log row per book; readers join the log,
so replacing a (book, stage) rewrites nothing, and a failed or repeated write is never visible
twice.  A commit id written again (a retried micro-batch) overwrites its own partition only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.library import BOOK

BOOK_COLUMNS = ["title", "author", "description", "source_url", "cover_url", "tags", "downloaded_at", "updated_at"]
CHAPTER_COLUMNS = ["chapter_id", "title", "content", "url", "volume", "order_index", "downloaded"]


def chapter_rows(chapters: DataFrame, position: str = "position") -> DataFrame:
    """Stored form of chapters: the given order when positive, else the position; downloaded when
    flagged or when there is content."""
    return (chapters.withColumn("order_index", F.when(F.col("order_index") > 0, F.col("order_index")).otherwise(F.col(position)))
            .withColumn("downloaded", F.coalesce("downloaded", F.lit(False)) | (F.coalesce("content", F.lit("")) != ""))
            .select(*BOOK, *CHAPTER_COLUMNS))


def _write(df: DataFrame, path: str, stage: str, commit: int) -> None:
    (df.withColumn("stage", F.lit(stage or "raw")).withColumn("commit", F.lit(commit).cast("bigint"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stage", "commit").parquet(path))


def save_stage(root: str, stage: str, commit: int, books: DataFrame, chapters: DataFrame) -> None:
    """Save books and chapters as one commit; the log row of a book is written last."""
    _write(chapters.select(*BOOK, *CHAPTER_COLUMNS), f"{root}/chapters", stage, commit)
    _write(books.select(*BOOK, *BOOK_COLUMNS), f"{root}/books", stage, commit)
    _write(books.select(*BOOK).distinct(), f"{root}/commits", stage, commit)


def _current(spark: SparkSession, root: str, stage: str | None) -> DataFrame:
    """Newest commit per book and stage, or of each book's latest stage."""
    log = spark.read.parquet(f"{root}/commits")
    if stage:
        return log.filter(F.col("stage") == stage).groupBy(*BOOK, "stage").agg(F.max("commit").alias("commit"))
    return log.groupBy(*BOOK).agg(F.max(F.struct("commit", "stage")).alias("_l")).select(*BOOK, "_l.stage", "_l.commit")


def load_chapters(spark: SparkSession, root: str, stage: str | None = None) -> DataFrame:
    """Chapters of a stage, or of the latest stage of each book.  Order by `order_index`."""
    return spark.read.parquet(f"{root}/chapters").join(_current(spark, root, stage), [*BOOK, "stage", "commit"]).drop("commit")


def load_books(spark: SparkSession, root: str, stage: str | None = None) -> DataFrame:
    return spark.read.parquet(f"{root}/books").join(_current(spark, root, stage), [*BOOK, "stage", "commit"]).drop("commit")
