"""Search-index snapshots: write, read with a time to live, choose the best available."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.checkpoints import materialise

# Fixed value: age at which an index counts as stale.
TTL_DAYS = 7
ITEM = ["book_id", "title", "author", "description", "url", "latest_chapter", "cover_url"]


def write_snapshot(items: DataFrame, path: str, generated_at: Column) -> None:
    """Add one snapshot per source.  Rows stay rows: a source's index is never one cell.  A snapshot of
    the same source and time is replaced, so a repeated write changes nothing."""
    (items.select("site", generated_at.alias("generated_at"), *ITEM)
     .write.partitionBy("site", "generated_at").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path))


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def fresh(snapshots: DataFrame, now: Column, ttl_days: int = TTL_DAYS) -> DataFrame:
    """Rows of snapshots not older than the time to live; an unknown time counts as fresh."""
    age = now - F.make_interval(days=F.lit(ttl_days if ttl_days > 0 else TTL_DAYS))
    return snapshots.filter(F.col("generated_at").isNull() | (F.col("generated_at") >= age))


def usable(snapshots: DataFrame, now: Column, ttl_days: int = TTL_DAYS) -> DataFrame:
    """Per source the newest fresh snapshot, else the newest stale one.  Snapshots are rows, so an
    empty one simply is not there."""
    age = now - F.make_interval(days=F.lit(ttl_days if ttl_days > 0 else TTL_DAYS))
    is_fresh = (F.col("generated_at").isNull() | (F.col("generated_at") >= age)).alias("is_fresh")
    best = (snapshots.groupBy("site").agg(F.max(F.struct(is_fresh, F.col("generated_at"))).alias("_b"))
            .select("site", F.col("_b.generated_at").alias("generated_at"), F.col("_b.is_fresh").alias("is_fresh")))
    s, b = snapshots.alias("s"), best.alias("b")
    on = (F.col("s.site") == F.col("b.site")) & F.col("s.generated_at").eqNullSafe(F.col("b.generated_at"))
    return s.join(b, on).select("s.*", "b.is_fresh")


def missing_sources(sources: DataFrame, snapshots: DataFrame, now: Column, ttl_days: int = TTL_DAYS) -> DataFrame:
    """Sources whose index must be rebuilt: no fresh snapshot."""
    return sources.join(fresh(snapshots, now, ttl_days).select("site").distinct(), "site", "left_anti")


def refreshed(spark: SparkSession, path: str, sources: DataFrame, build: Callable[[DataFrame], DataFrame], now: Column, ttl_days: int = TTL_DAYS) -> DataFrame:
    """The index of all sources, rebuilt where it is missing or stale.

    `build` turns the sources to rebuild into hits; what it finds is written as a snapshot of `now` and read
    again.  A source whose building yields nothing keeps its stale snapshot; one that never had any is
    not in the result.
    """
    rebuild = materialise(missing_sources(sources.select("site").distinct(), read_snapshots(spark, path), now, ttl_days))
    built = build(rebuild)
    write_snapshot(built.join(rebuild, "site", "left_semi"), path, now)
    return usable(read_snapshots(spark, path), now, ttl_days).join(sources.select("site").distinct(), "site", "left_semi")
