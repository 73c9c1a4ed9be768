"""Stream queries: the event and order tables replayed as streams to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.urls import host_of
from ..plans.checkpoints import scratch_dir
from ..plans.ordering import block_of, number_rows
from ..streaming import progress as P
from ..streaming import upserts as U
from . import ORACLES, query
from .progress import FAST, KINDS, _TASKS
from .shelf import as_shelf_events
from .views import PROGRESS_TOTAL, table


def _stream(spark, d, name):
    P.use_state_store(spark)
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}*.parquet")


def _progress(spark, d):
    return _stream(spark, d, "events").selectExpr(
        "event_type AS task_id", "event_id AS seq", "timestamp_micros(unix_micros(CAST(ts AS TIMESTAMP)) DIV 60) AS ts",
        f"event_id % {PROGRESS_TOTAL} AS done", f"CAST({PROGRESS_TOTAL} AS BIGINT) AS total")


def _finished(spark, stream):
    root = scratch_dir(spark)
    U.run_available(stream, f"{root}/out", f"{root}/state")
    return spark.read.parquet(f"{root}/out")


@query("streamed_rate", ORACLES["windowed_rate"])
def streamed_rate(spark, d):
    out = _finished(spark, P.stream_rates(_progress(spark, d)))
    return out.select("task_id", "seq", F.round("rate", 6).alias("rate"), "eta")


@query("streamed_throttle", ORACLES["throttled_progress"])
def streamed_throttle(spark, d):
    return _finished(spark, P.stream_throttled(_progress(spark, d).selectExpr("* EXCEPT (ts)", *FAST)))


@query("streamed_messages", """SELECT CAST(user_id AS VARCHAR) AS task_id, md5(string_agg(event_type || ' ' || event_id, '|' ORDER BY event_id)) AS h FROM
  (SELECT * FROM events WHERE event_type <> 'view' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 20) GROUP BY user_id""")
def streamed_messages(spark, d):
    m = _stream(spark, d, "events").selectExpr(
        "user_id AS task_id", "event_id AS seq", "CASE WHEN event_type = 'view' THEN ' ' ELSE concat(event_type, ' ', event_id) END AS text")
    root = scratch_dir(spark)

    def keep(batch, batch_id):
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
            .partitionBy("batch").parquet(f"{root}/out")

    q = (P.stream_messages(m, 20).writeStream.foreachBatch(keep).outputMode("update")
         .option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start())
    q.awaitTermination()
    last = spark.read.parquet(f"{root}/out").groupBy("task_id").agg(F.max_by("texts", "upto").alias("t"))
    return last.select("task_id", F.md5(F.array_join("t", "|")).alias("h"))


@query("streamed_shelf", ORACLES["shelf_fold"])
def streamed_shelf(spark, d):
    root = scratch_dir(spark)
    events = as_shelf_events(_stream(spark, d, "orders"))
    q = U.upsert_shelf(events, root, f"{root}/state", {"availableNow": True})
    q.awaitTermination()
    return U.shelf_at(spark, root).select(
        "book_id", "title", "author", "cover_url", "description", "latest_chapter", "parent_id", "implicit",
        "last_read_chapter_id", "last_read_chapter_index")


_CRAWLS = """crawl AS (SELECT page_id, url, regexp_extract(html, '<h1>(.*?)</h1>', 1) AS h1, 0 AS round FROM pages
    UNION ALL SELECT page_id, url, 'again ' || regexp_extract(html, '<h1>(.*?)</h1>', 1), 1 FROM pages WHERE page_id % 3 = 0
    UNION ALL SELECT page_id, url, CASE WHEN page_id % 4 = 0 THEN '' ELSE 'third' END, 2 FROM pages WHERE page_id % 6 = 0)"""


def _crawls(spark, d):
    """Three rounds of a crawl: every page, a third of them again, a sixth for a third time and partly in vain."""
    p = table(spark, d, "pages").select("page_id", "url", F.regexp_extract("html", "<h1>(.*?)</h1>", 1).alias("h1"))
    again = p.filter("page_id % 3 = 0").withColumn("h1", F.concat(F.lit("again "), "h1"))
    third = p.filter("page_id % 6 = 0").withColumn("h1", F.when(F.col("page_id") % 4 == 0, F.lit("")).otherwise(F.lit("third")))
    rounds = [x.withColumn("round", F.lit(i)) for i, x in enumerate((p, again, third))]
    return rounds[0].unionByName(rounds[1]).unionByName(rounds[2]).withColumn("fetched_at", F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("round") * 1000 + F.col("page_id") % 7))


def _ingested(spark, d):
    """The crawl in eight files of mixed rounds, one a micro-batch, compacted every third one."""
    root = scratch_dir(spark)
    pages = _crawls(spark, d)
    pages.repartition(8, "page_id").write.parquet(f"{root}/in")
    stream = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")

    def extract(batch):
        return batch.select(host_of("url").alias("site"), F.lit("b").alias("book_id"), F.col("page_id").cast("string").alias("chapter_id"),
                            F.concat(F.lit("round "), "round").alias("title"), F.col("h1").alias("content"), "url", F.lit("").alias("volume"),
                            F.col("page_id").alias("order_index"), "fetched_at", F.when((F.col("round") == 2) & (F.col("page_id") % 5 == 0), F.lit("http 500")).alias("error"))

    U.ingest_pages(stream, extract, root, "raw", f"{root}/state", {"availableNow": True}, every=3).awaitTermination()
    return root


@query("streamed_ingest", f"""WITH {_CRAWLS}, ok AS (SELECT *, CASE WHEN round = 2 AND page_id % 5 = 0 THEN '' ELSE h1 END AS body FROM crawl)
  SELECT CAST(page_id AS VARCHAR) AS chapter_id, regexp_extract(url, '^https?://([^/?#:]*)', 1) AS site, arg_max(round, CASE WHEN trim(body) <> '' THEN 10 ELSE 0 END + round) AS round,
    md5(arg_max(body, CASE WHEN trim(body) <> '' THEN 10 ELSE 0 END + round)) AS h FROM ok GROUP BY page_id, url""")
def streamed_ingest(spark, d):
    """Every page is stored; of repeated fetches the newest with a body wins."""
    stored = U.chapters_at(spark, _ingested(spark, d))
    return stored.select("chapter_id", "site", F.substring("title", 7, 9).cast("int").alias("round"), F.md5("content").alias("h"))


@query("streamed_pending", f"""WITH {_CRAWLS}, done AS (SELECT DISTINCT page_id FROM crawl WHERE trim(CASE WHEN round = 2 AND page_id % 5 = 0 THEN '' ELSE h1 END) <> '')
  SELECT CAST(i AS VARCHAR) AS chapter_id FROM (SELECT unnest([page_id, page_id + 1000000]) AS i, page_id FROM pages) WHERE i >= 1000000 OR page_id NOT IN (SELECT page_id FROM done)""")
def streamed_pending(spark, d):
    """A listing of all stored chapters and as many others: the others are still to fetch."""
    listing = table(spark, d, "pages").select(host_of("url").alias("site"), F.lit("b").alias("book_id"),
                                              F.explode(F.array(F.col("page_id").cast("string"), (F.col("page_id") + 1000000).cast("string"))).alias("chapter_id"))
    return U.still_pending(spark, _ingested(spark, d), listing).select("chapter_id")


@query("streamed_task_state", f"WITH {_TASKS} SELECT task_id, status, phase, title, completed_chapters FROM tasks")
def streamed_task_state(spark, d):
    # the kind of an event depends on its place in its task, which the batch side numbers
    e = table(spark, d, "events")
    numbered = number_rows(e, ["user_id"], [F.col("event_id")], "rn", block_of("event_id", 100_000))
    root = scratch_dir(spark)
    numbered.write.parquet(f"{root}/in")
    P.use_state_store(spark)
    s = spark.readStream.schema(numbered.schema).option("maxFilesPerTrigger", 4).parquet(f"{root}/in")
    events = s.selectExpr(
        "user_id AS task_id", "event_id AS seq", "ts", f"{KINDS} AS kind", "'' AS site", "'' AS book_id", "CASE WHEN event_id % 3 = 0 THEN ' ' ELSE concat('T', event_id) END AS title",
        "CASE user_id % 4 WHEN 0 THEN 'local' WHEN 1 THEN 'export' WHEN 2 THEN 'shelf' ELSE 'browser' END AS target",
        "CAST(event_id % 50 AS INT) AS done", "CAST(CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 60 END AS INT) AS total",
        "CAST(array() AS ARRAY<STRING>) AS exported", "'' AS error")

    def keep(batch, batch_id):
        batch.select("task_id", "status", "phase", "title", "completed_chapters", F.lit(batch_id).alias("batch")).write.mode("overwrite") \
            .option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{root}/out")

    q = (P.stream_task_state(events).writeStream.foreachBatch(keep).outputMode("update")
         .option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start())
    q.awaitTermination()
    out = spark.read.parquet(f"{root}/out")
    return (out.groupBy("task_id").agg(F.max_by(F.struct("status", "phase", "title", "completed_chapters"), "batch").alias("t"))
            .select("task_id", "t.*"))
