"""Progress logs: windowed rates, task state, probes; see `throttle` for the emission throttle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.labels import eta_label, eta_seconds
from ..functions.text import is_blank, nullif_blank, trim_u
from ..plans.ordering import BLOCK, block_of, running, with_lookback, with_previous

# Rate window, sample cap, message cap, fast-probe limit, restart text.
RATE_WINDOW_SECONDS = 30.0
RATE_MAX_SAMPLES = 256
MAX_MESSAGES = 200
FAST_PROBE_MS = 800
RESTART_REASON = "进程已重启，任务被中断"
LOCAL_TARGETS = ("local", "shelf")


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def windowed_rates(progress: DataFrame, window: float = RATE_WINDOW_SECONDS, max_samples: int = RATE_MAX_SAMPLES,
                   block: float = 900.0) -> DataFrame:
    """Rate and ETA after every progress row of (task_id, seq, ts, done, total).

    Slope between the oldest sample in the window and the newest.  A lower `done` restarts the
    buffer, a repeat of the last sample at the same time adds nothing.  All of that looks back at
    most one window, so tasks are cut into time blocks that overlap by the window: a task of any
    length spreads over many partitions.  Within a task, `ts` must not decrease along `seq`.
    """
    keep = progress.columns
    micros = lambda seconds: int(round(seconds * 1e6))
    rows = with_lookback(progress.withColumn("_at", _micros("ts")), F.col("_at"), micros(block), micros(window))
    part = Window.partitionBy("task_id", BLOCK)
    by_seq = part.orderBy("seq")
    last_done, last_at = F.lag("done").over(by_seq), F.lag("_at").over(by_seq)
    rows = rows.withColumns({
        "_reset": last_done.isNotNull() & (F.col("done") < last_done),
        "_repeat": last_done.isNotNull() & (F.col("done") == last_done) & (F.col("_at") <= last_at)})
    so_far = by_seq.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({
        "_segment": F.sum(F.col("_reset").cast("int")).over(so_far),
        "_sample_no": F.sum((~F.col("_repeat")).cast("int")).over(so_far)})
    in_segment = Window.partitionBy("task_id", BLOCK, "_segment")
    recent = in_segment.orderBy("_at").rangeBetween(-micros(window), 0)
    capped = in_segment.orderBy("_sample_no").rangeBetween(-(max_samples - 1), 0)
    start = F.struct("_sample_no", "_at", "done")
    # the later of the two starts: window begin or sample cap
    first = F.greatest(F.min(start).over(recent), F.min(start).over(capped))
    rows = rows.filter(~F.col("_repeat") | ~F.col("_context")).withColumn("_first", first)
    span, gain = F.col("_at") - F.col("_first._at"), F.col("done") - F.col("_first.done")
    rate = F.when((span > 0) & (gain > 0), gain / (span / F.lit(1e6))).otherwise(F.lit(0.0))
    out = rows.filter(~F.col("_context")).withColumn("rate", rate)
    return (out.select(*keep, "rate")
            .withColumn("eta", eta_label(eta_seconds("done", "total", "rate"))))


def sample_flags(progress: DataFrame, block_rows: int = 100_000) -> DataFrame:
    """Progress rows with `reset` (fewer done than before), `repeat` (as many, at no later time) and
    `segment`, the number of resets up to the row."""
    block = block_of("seq", block_rows)
    rows = with_previous(progress.withColumn("_at", _micros("ts")), ["task_id"], "seq", block, _done="done", _before="_at")
    flags = rows.withColumns({"reset": F.coalesce(F.col("done") < F.col("_done"), F.lit(False)),
                              "repeat": F.coalesce((F.col("done") == F.col("_done")) & (F.col("_at") <= F.col("_before")), F.lit(False))})
    return running(flags.drop("_done", "_before", "_at"), ["task_id"], "seq", block, segment=("sum", F.col("reset").cast("bigint")))


# ---- task state -------------------------------------------------------------------------------

def fold_tasks(events: DataFrame) -> DataFrame:
    """Current task rows from lifecycle events (task_id, seq, ts, kind, site, book_id, title,
    target, done, total, exported, error, and where given formats).

    Kinds: queued, loading, running, progress, exporting, completed, failed.  Every column is an
    arg-max over the log, so the fold combines before the shuffle and no task is gathered.
    """
    k = F.col("kind")
    at = lambda cond, value: F.max(F.when(cond, F.struct("seq", value.alias("v"))))
    sets_total = (k == "running") | ((k == "progress") & (F.col("total") > 0))
    g = events.groupBy("task_id").agg(
        F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"),
        F.max(F.struct("seq", "kind")).alias("_last"),
        at(k == "queued", F.coalesce("target", F.lit("browser"))).alias("_target"),
        at(k.isin("queued", "loading", "running"), F.struct("site", "book_id")).alias("_book"),
        at(k.isin("running", "completed") & ~is_blank("title"), F.col("title")).alias("_title"),
        at(sets_total, F.col("total")).alias("_total"),
        at(k == "exporting", F.struct("total", "done")).alias("_export"),
        at(k.isin("running", "progress"), F.when(k == "running", F.lit(0)).otherwise(F.col("done"))).alias("_done"),
        at(k.isin("running", "progress", "exporting"), F.when(k == "progress", trim_u(F.coalesce("title", F.lit(""))))
           .otherwise(F.lit(""))).alias("_chapter"),
        at(k == "completed", F.coalesce("exported", F.array().cast("array<string>"))).alias("_completed"),
        at(k == "queued", F.coalesce("formats" if "formats" in events.columns else F.lit(None).cast("array<string>"), F.array().cast("array<string>"))).alias("_formats"),
        at(k.isin("failed", "completed"), F.when(k == "failed", F.col("error")).otherwise(F.lit(""))).alias("_error"),
        F.max(F.when(k.isin("completed", "failed"), F.struct("seq", "ts"))).alias("_finished"),
        F.min(F.when(k.isin("loading", "running"), F.struct("seq", "ts"))).alias("_started"))
    v = lambda c: F.col(f"{c}.v")
    target = F.coalesce(v("_target"), F.lit("browser"))
    base = F.coalesce(v("_total"), F.lit(0))
    # exporting sets the total from its argument, else the known total, else what is done, else 1
    pos = lambda c: F.when(c > 0, c)
    exported = F.coalesce(pos(v("_export")["total"]), pos(base), pos(v("_export")["done"]), F.lit(1))
    after_export = F.coalesce(F.col("_export.seq") > F.coalesce("_total.seq", F.lit(-1)), F.lit(False))
    total = F.when(after_export, F.when(target.isin(*LOCAL_TARGETS), exported).otherwise(exported + 1)).otherwise(base)
    done_by_export = F.coalesce(F.col("_export.seq") > F.coalesce("_done.seq", F.lit(-1)), F.lit(False))
    done = F.when(done_by_export, F.least(v("_export")["done"], exported)).otherwise(F.coalesce(v("_done"), F.lit(0)))
    ended = F.coalesce(F.col("_completed.seq") > F.greatest(
        F.coalesce("_done.seq", F.lit(-1)), F.coalesce("_total.seq", F.lit(-1)), F.coalesce("_export.seq", F.lit(-1))), F.lit(False))
    status = (F.when(F.col("_last.kind").isin("completed", "failed", "queued"), F.col("_last.kind")).otherwise(F.lit("running")))
    phase = (F.when(F.col("_last.kind") == "exporting", F.when(target.isin(*LOCAL_TARGETS), F.lit("saving")).otherwise(F.lit("exporting")))
             .when(F.col("_last.kind") == "loading", F.lit("loading_chapters"))
             .when(F.col("_last.kind").isin("running", "progress"), F.lit("downloading")).otherwise(F.col("_last.kind")))
    final_total = F.when(ended & (total <= 0), F.lit(1)).otherwise(total)
    return g.select(
        "task_id", v("_book")["site"].alias("site"), v("_book")["book_id"].alias("book_id"),
        F.coalesce(v("_title"), F.lit("")).alias("title"), status.alias("status"), phase.alias("phase"), target.alias("target"),
        final_total.cast("bigint").alias("total_chapters"),
        F.when(ended, final_total).otherwise(done).cast("bigint").alias("completed_chapters"),
        F.coalesce(v("_chapter"), F.lit("")).alias("current_chapter"), F.coalesce(v("_error"), F.lit("")).alias("error"),
        F.coalesce(v("_completed"), F.array().cast("array<string>")).alias("exported"), F.coalesce(v("_formats"), F.array().cast("array<string>")).alias("formats"),
        F.col("_started.ts").alias("start_time"), F.col("_finished.ts").alias("finished_at"), "created_at", "updated_at")


def task_rows(events: DataFrame, messages: DataFrame, limit: int = MAX_MESSAGES, block_rows: int = 100_000) -> DataFrame:
    """Complete task rows: `fold_tasks` with speed, ETA and the last messages (task_id, seq, at, level, text).

    Speed and ETA are those of the last progress event since the last run began, from the samples of that run;
    0 and empty where there is none.  ETA counts to the total known at that event.
    """
    k = F.col("kind")
    steps = events.filter(k.isin("running", "progress")).select("task_id", "seq", "ts", "kind", "done", "total")
    known = F.when((k == "running") | (F.col("total") > 0), F.col("total"))
    runs = running(steps, ["task_id"], "seq", block_of("seq", block_rows), _run=("sum", (k == "running").cast("bigint")), _known=("last", known))
    samples = runs.filter(k == "progress").select(F.struct("task_id", "_run").alias("task_id"), "seq", "ts", "done", F.coalesce("_known", F.lit(0)).alias("total"))
    rates = windowed_rates(samples).select("task_id.*", "seq", "rate", "eta")
    newest = runs.groupBy("task_id").agg(F.max("_run").alias("_newest"))
    last = rates.join(newest, "task_id").filter(F.col("_run") == F.col("_newest")).groupBy("task_id").agg(F.max_by(F.struct("rate", "eta"), "seq").alias("_r"))
    logs = message_arrays(messages, limit)
    return (fold_tasks(events).join(last, "task_id", "left").join(logs, "task_id", "left")
            .withColumns({"speed": F.coalesce("_r.rate", F.lit(0.0)), "eta": F.coalesce("_r.eta", F.lit(""))}).drop("_r"))


def last_messages(messages: DataFrame, limit: int = MAX_MESSAGES) -> DataFrame:
    """The last `limit` non-blank messages of each task; older ones are cut before the shuffle."""
    w = Window.partitionBy("task_id").orderBy(F.col("seq").desc())
    return (messages.filter(~is_blank("text")).withColumn("text", trim_u("text"))
            .withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit).drop("_rn"))


def message_arrays(messages: DataFrame, limit: int = MAX_MESSAGES) -> DataFrame:
    """Bounded message array of each task in order."""
    kept = F.array_sort(F.collect_list(F.struct("seq", "at", "level", "text")))
    return last_messages(messages, limit).groupBy("task_id").agg(kept.alias("messages"))


def close_orphans(tasks: DataFrame, now: Column, reason: str = "") -> DataFrame:
    """Tasks left queued or running by a restart become failed with the reason."""
    text = reason.strip() or RESTART_REASON
    lost = F.col("status").isin("queued", "running")
    return (tasks.withColumn("_lost", lost)
            .withColumns({"phase": F.when(F.col("_lost"), F.lit("failed")).otherwise(F.col("phase")),
                          "error": F.when(F.col("_lost"), F.lit(text)).otherwise(F.col("error")),
                          "finished_at": F.when(F.col("_lost"), now).otherwise(F.col("finished_at")),
                          "updated_at": F.when(F.col("_lost"), now).otherwise(F.col("updated_at")),
                          "status": F.when(F.col("_lost"), F.lit("failed")).otherwise(F.col("status"))})
            .withColumnRenamed("_lost", "closed"))


def task_order() -> list[Column]:
    return [F.col("updated_at").desc(), F.col("created_at").desc()]


def can_export_again(tasks: DataFrame) -> DataFrame:
    named = nullif_blank("site").isNotNull() & nullif_blank("book_id").isNotNull()
    return tasks.filter(named & F.col("status").isin("completed", "failed", "queued"))


# ---- probes -----------------------------------------------------------------------------------

def best_probes(log: DataFrame) -> DataFrame:
    """One result per source from its first two samples (site, sample, elapsed_ms, count, error,
    timed_out).  A failed first sample is final; the second counts only when the first was slow,
    succeeded, and the second was faster."""
    one, two = F.col("sample") == 1, F.col("sample") == 2
    sample = F.struct("elapsed_ms", "count", "error", "timed_out")
    g = log.groupBy("site").agg(F.first(F.when(one, sample), ignorenulls=True).alias("a"),
                                F.first(F.when(two, sample), ignorenulls=True).alias("b"))
    failed = F.coalesce("a.error", F.lit("")) != ""
    second = ~failed & (F.col("a.elapsed_ms") >= FAST_PROBE_MS)
    better = second & (F.coalesce("b.error", F.lit("")) == "") & (F.col("b.elapsed_ms") < F.col("a.elapsed_ms"))
    pick = lambda f: F.when(better, F.col(f"b.{f}")).otherwise(F.col(f"a.{f}"))
    return g.filter(F.col("a").isNotNull()).select(
        "site", pick("elapsed_ms").alias("elapsed_ms"), pick("count").alias("count"),
        F.when(second & F.col("b").isNotNull(), 2).otherwise(1).alias("samples"),
        F.coalesce("a.error", F.lit("")).alias("error"), (failed & F.col("a.timed_out")).alias("timed_out"))


def probe_summary(probes: DataFrame, order: str = "ord") -> DataFrame:
    """Success and failure counts, fastest and slowest source; the first wins a tie."""
    ok = F.col("error") == ""
    return probes.agg(
        F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"),
        F.min(F.when(ok, F.struct("elapsed_ms", order, "site")))["site"].alias("fastest"),
        F.min(F.when(ok, F.struct((-F.col("elapsed_ms")).alias("e"), order, "site")))["site"].alias("slowest"))
