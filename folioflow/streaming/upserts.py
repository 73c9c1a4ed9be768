"""Micro-batch upserts: reading progress into the shelf, fetched pages into the library.

What micro-batches fold to is kept as a base and the batches after it (`MergedTable`).  A micro-batch may
run again after a failure, so it writes only what is named by its own id; overwriting that gives the
same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import is_blank, nullif_blank
from ..operators.library import BOOK, CHAPTER, failure_totals, pending_chapters
from ..operators.shelf import fold_books

COMPACT_EVERY = 16
CHAPTER_REST = ["title", "content", "url", "volume", "order_index", "downloaded", "fetched_at"]


def _write(df: DataFrame, path: str, batch: int) -> None:
    (df.withColumn("batch", F.lit(batch).cast("bigint")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path))


class MergedTable:
    """A table folded from micro-batches: `fold` turns rows with a `batch` column into the current rows.

    Every `every` batches the current rows are written as a new base, named by the last batch in it, so
    a reader folds the newest complete base and fewer than `every` batches.  `fold` must be associative
    along `batch`.
    """

    def __init__(self, spark: SparkSession, root: str, fold: Callable[[DataFrame], DataFrame], every: int = COMPACT_EVERY) -> None:
        self.spark, self.root, self.fold, self.every = spark, root.rstrip("/"), fold, every

    def _base(self, before: int | None) -> int | None:
        """Last batch of the newest base that is whole."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        found = jvm.org.apache.hadoop.fs.Path(f"{self.root}/base-*/_SUCCESS")
        whole = found.getFileSystem(conf).globStatus(found) or []
        upto = [int(f.getPath().getParent().getName().removeprefix("base-")) for f in whole]
        return max((n for n in upto if before is None or n < before), default=None)

    def current(self, before: int | None = None) -> DataFrame:
        """Rows after all batches, or after those before a batch."""
        base = self._base(before)
        rows = self.spark.read.parquet(f"{self.root}/batches")
        if before is not None:
            rows = rows.filter(F.col("batch") < before)
        if base is not None:
            rows = rows.filter(F.col("batch") > base).unionByName(self.spark.read.parquet(f"{self.root}/base-{base}").withColumn("batch", F.lit(base).cast("bigint")))
        return self.fold(rows)

    def put(self, rows: DataFrame, batch: int) -> None:
        """Add what a micro-batch folds to."""
        _write(rows, f"{self.root}/batches", batch)
        if (batch + 1) % self.every == 0:
            self.current(batch + 1).write.mode("overwrite").parquet(f"{self.root}/base-{batch}")


def merge_partials(partials: DataFrame) -> DataFrame:
    """Shelf rows from the folds of successive micro-batches (column `batch`)."""
    b = F.col("batch")
    first = lambda c: F.coalesce(F.min_by(c, F.when(nullif_blank(c).isNotNull(), b)), F.lit(""))
    read = F.col("last_read_at").isNotNull()
    position = F.struct("last_read_chapter_id", "last_read_chapter_index", "last_read_chapter_title", "last_read_at")
    g = partials.groupBy(*BOOK).agg(
        F.min("first_seq").alias("first_seq"), F.min_by("title", "batch").alias("title"),
        *[first(c).alias(c) for c in ("author", "cover_url", "description", "source_url")],
        F.coalesce(F.max_by("latest_chapter", F.when(nullif_blank("latest_chapter").isNotNull(), b)), F.lit("")).alias("latest_chapter"),
        F.max_by("parent_id", F.when(F.col("parent_id").isNotNull(), b)).alias("parent_id"),
        F.bool_and("implicit").alias("implicit"), F.max_by(position, F.when(read, b)).alias("_p"))
    return g.select(
        *[c for c in g.columns if c != "_p"], F.coalesce("_p.last_read_chapter_id", F.lit("")).alias("last_read_chapter_id"),
        F.coalesce("_p.last_read_chapter_index", F.lit(0)).alias("last_read_chapter_index"),
        F.coalesce("_p.last_read_chapter_title", F.lit("")).alias("last_read_chapter_title"), F.col("_p.last_read_at").alias("last_read_at"))


def shelf_table(spark: SparkSession, root: str, every: int = COMPACT_EVERY) -> MergedTable:
    return MergedTable(spark, f"{root}/shelf", merge_partials, every)


def shelf_at(spark: SparkSession, root: str) -> DataFrame:
    return shelf_table(spark, root).current()


def upsert_shelf(events: DataFrame, root: str, checkpoint: str, trigger: dict, every: int = COMPACT_EVERY) -> StreamingQuery:
    """Fold each micro-batch of shelf events into the shelf; `outcomes` tells which books were there before."""
    def put(batch: DataFrame, batch_id: int) -> None:
        shelf = shelf_table(batch.sparkSession, root, every)
        fold = fold_books(batch)
        shelf.put(fold, batch_id)
        known = shelf.current(batch_id).select(*BOOK).withColumn("_k", F.lit(True))
        touched = batch.sparkSession.read.parquet(f"{shelf.root}/batches").filter(F.col("batch") == batch_id).select(*BOOK)
        _write(touched.join(known, BOOK, "left").select(*BOOK, F.coalesce("_k", F.lit(False)).alias("updated")), f"{root}/outcomes", batch_id)

    return events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def newest_chapters(rows: DataFrame) -> DataFrame:
    """One row per chapter: the newest fetch with a body, else the newest; of equal times the greatest row."""
    row = F.struct((~is_blank("content")).alias("filled"), "fetched_at", *[c for c in CHAPTER_REST if c != "fetched_at"])
    return rows.groupBy(*CHAPTER).agg(F.max(row).alias("_c")).select(*CHAPTER, *[f"_c.{c}" for c in CHAPTER_REST])


def chapter_table(spark: SparkSession, root: str, stage: str = "raw", every: int = COMPACT_EVERY) -> MergedTable:
    return MergedTable(spark, f"{root}/{stage}", newest_chapters, every)


def chapters_at(spark: SparkSession, root: str, stage: str = "raw") -> DataFrame:
    """Chapters of a stage after all micro-batches."""
    return chapter_table(spark, root, stage).current()


def still_pending(spark: SparkSession, root: str, listing: DataFrame, stage: str = "raw", sources: DataFrame | None = None) -> DataFrame:
    """Listed chapters without a reusable body after all micro-batches."""
    return pending_chapters(listing, chapters_at(spark, root, stage), sources)


def ingest_pages(pages: DataFrame, extract: Callable[[DataFrame], DataFrame], root: str, stage: str, checkpoint: str, trigger: dict,
                 every: int = COMPACT_EVERY) -> StreamingQuery:
    """Fetched pages to stored chapters; what earlier micro-batches stored stays.

    `extract` turns pages into chapter rows (site, book_id, chapter_id, title, content, url, volume,
    order_index, fetched_at, error).  A chapter has the row of its newest fetch with a body, with the title, URL
    and volume of that fetch; a failed or empty fetch never replaces a body.  A book whose fetches in a
    micro-batch all failed gets nothing from it; `outcomes` has the totals of each book and micro-batch.
    """
    def put(batch: DataFrame, batch_id: int) -> None:
        rows = extract(batch).withColumn("error", F.coalesce("error", F.lit("")))
        rows = rows.withColumn("content", F.when(F.col("error") == "", F.coalesce("content", F.lit(""))).otherwise(F.lit("")))
        totals = failure_totals(rows)
        _write(totals, f"{root}/outcomes-{stage}", batch_id)
        kept = rows.withColumn("downloaded", ~is_blank("content")).join(totals.filter("all_failed").select(*BOOK), BOOK, "left_anti")
        chapter_table(batch.sparkSession, root, stage, every).put(newest_chapters(kept), batch_id)

    return pages.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def run_available(df: DataFrame, out: str, checkpoint: str) -> None:
    """Run a stream over everything available now into a table."""
    q = (df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
