"""Progress, task and probe queries over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import first_non_blank
from ..operators import progress as P
from ..operators.throttle import throttled
from ..plans.ordering import block_of, number_rows
from . import query
from .views import KINDS, PROGRESS, progress, table

_RATES = f"""{PROGRESS},
  a AS (SELECT *, lag(done) OVER w AS pd, lag(us) OVER w AS pu FROM progress WINDOW w AS (PARTITION BY task_id ORDER BY seq)),
  b AS (SELECT *, coalesce(done < pd, false) AS reset, coalesce(done = pd AND us <= pu, false) AS rep FROM a),
  c AS (SELECT *, sum(reset::INT) OVER w AS seg, sum((NOT rep)::INT) OVER w AS sn FROM b WINDOW w AS (PARTITION BY task_id ORDER BY seq)),
  e AS (SELECT *, greatest(min(sn) OVER (PARTITION BY task_id, seg ORDER BY us RANGE BETWEEN 30000000 PRECEDING AND CURRENT ROW),
    min(sn) OVER (PARTITION BY task_id, seg ORDER BY sn RANGE BETWEEN 255 PRECEDING AND CURRENT ROW)) AS fs FROM c),
  f AS (SELECT e.task_id, e.seq, e.done, e.total, e.reset, e.rep, e.us - s.us AS du, e.done - s.done AS dd FROM e
    JOIN c s ON s.task_id = e.task_id AND s.sn = e.fs AND NOT s.rep),
  rates AS (SELECT *, CASE WHEN du > 0 AND dd > 0 THEN dd::DOUBLE / (du::DOUBLE / 1e6) ELSE 0.0 END AS rate FROM f),
  etas AS (SELECT *, CASE WHEN rate > 0 THEN greatest(total - done, 0) / rate END AS s, CAST(floor(CASE WHEN rate > 0 THEN greatest(total - done, 0) / rate END) AS BIGINT) AS w FROM rates)"""


@query("windowed_rate", f"""WITH {_RATES} SELECT task_id, seq, round(rate, 6) AS rate, CASE WHEN s IS NULL THEN '' WHEN s <= 0 THEN '0s'
  WHEN w >= 3600 THEN (w // 3600) || '小时' || (w // 60 % 60) || '分' WHEN w >= 60 THEN (w // 60) || '分' || (w % 60) || '秒' ELSE w || '秒' END AS eta FROM etas""")
def windowed_rate(spark, d):
    return P.windowed_rates(progress(spark, d)).select("task_id", "seq", F.round("rate", 6).alias("rate"), "eta")


@query("reset_segments", f"""WITH {PROGRESS}, a AS (SELECT *, lag(done) OVER (PARTITION BY task_id ORDER BY seq) AS pd FROM progress)
  SELECT task_id, seq, CAST(sum(CASE WHEN done < pd THEN 1 ELSE 0 END) OVER (PARTITION BY task_id ORDER BY seq) AS BIGINT) AS segment FROM a""")
def reset_segments(spark, d):
    return P.sample_flags(progress(spark, d), 5_000).select("task_id", "seq", "segment")


@query("repeat_samples", """WITH p AS (SELECT event_type AS task_id, event_id AS seq, epoch_us(ts) // 3600000000 AS hour, event_id // 100 AS done FROM events),
  a AS (SELECT *, lag(done) OVER w AS pd, lag(hour) OVER w AS ph FROM p WINDOW w AS (PARTITION BY task_id ORDER BY seq))
  SELECT task_id, count(*) AS n, count(*) FILTER (WHERE done = pd AND hour <= ph) AS repeats FROM a GROUP BY task_id""")
def repeat_samples(spark, d):
    """Times in whole hours and counts in hundreds, so that samples repeat."""
    p = table(spark, d, "events").selectExpr("event_type AS task_id", "event_id AS seq", "date_trunc('HOUR', ts) AS ts", "event_id DIV 100 AS done")
    flags = P.sample_flags(p, 5_000)
    return flags.groupBy("task_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("repeat").alias("repeats"))


#: Progress twenty times as fast, with a new book every 211th row; the SQL walks all tasks row by row.
FAST = ["seq % 211 = 0 AS starts", "timestamp_micros(CAST(unix_micros(ts) / 20 AS BIGINT)) AS ts"]


@query("throttled_progress", f"""WITH RECURSIVE {PROGRESS},
  fast AS (SELECT task_id, seq, us // 20 AS t, done, total, seq % 211 = 0 AS starts, row_number() OVER (PARTITION BY task_id ORDER BY seq) AS rn FROM progress),
  walk AS (SELECT task_id, seq, rn, CASE WHEN starts THEN -{1 << 61} ELSE t END AS last_t, done AS last_done, true AS ok FROM fast WHERE rn = 1
    UNION ALL SELECT task_id, seq, rn, CASE WHEN NOT ok THEN last_t WHEN starts THEN -{1 << 61} ELSE t END, CASE WHEN ok THEN done ELSE last_done END, ok FROM (
      SELECT f.*, w.last_t, w.last_done, f.starts OR f.total <= 0 OR f.done >= f.total OR f.t - w.last_t >= 350000 OR f.done - w.last_done >= 3 AS ok
      FROM walk w JOIN fast f ON f.task_id = w.task_id AND f.rn = w.rn + 1))
  SELECT task_id, seq FROM walk WHERE ok""")
def throttled_progress(spark, d):
    return throttled(progress(spark, d).selectExpr("* EXCEPT (ts)", *FAST))


def _task_events(spark, d):
    e = table(spark, d, "events")
    numbered = number_rows(e, ["user_id"], [F.col("event_id")], "rn", block_of("event_id", 100_000))
    return numbered.selectExpr(
        "user_id AS task_id", "event_id AS seq", "ts", f"{KINDS} AS kind", "concat('s', user_id % 7) AS site",
        "CAST(event_id % 90 AS STRING) AS book_id", "CASE WHEN event_id % 3 = 0 THEN ' ' ELSE concat('T', event_id) END AS title",
        "CASE user_id % 4 WHEN 0 THEN 'local' WHEN 1 THEN 'export' WHEN 2 THEN 'shelf' ELSE 'browser' END AS target",
        "CAST(event_id % 50 AS INT) AS done", "CAST(CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 60 END AS INT) AS total",
        "CASE WHEN event_id % 2 = 0 THEN array('a.epub') ELSE CAST(array() AS ARRAY<STRING>) END AS exported",
        "CASE WHEN event_type = 'error' THEN props ELSE '' END AS error")


_TASKS = f"""te AS (SELECT user_id AS task_id, event_id AS seq, ts, {KINDS} AS kind, event_id, CAST(event_id % 50 AS INT) AS done,
    CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 60 END AS total, CASE WHEN event_id % 3 = 0 THEN ' ' ELSE 'T' || event_id END AS title,
    CASE user_id % 4 WHEN 0 THEN 'local' WHEN 1 THEN 'export' WHEN 2 THEN 'shelf' ELSE 'browser' END AS target, props
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events)),
  g AS (SELECT task_id, arg_max(kind, seq) AS last, any_value(target) AS target, min(ts) AS created_at, max(ts) AS updated_at,
    coalesce(arg_max(title, seq) FILTER (WHERE kind IN ('running', 'completed') AND trim(title) <> ''), '') AS title,
    coalesce(max(seq) FILTER (WHERE kind = 'running' OR (kind = 'progress' AND total > 0)), -1) AS tq,
    coalesce(arg_max(total, seq) FILTER (WHERE kind = 'running' OR (kind = 'progress' AND total > 0)), 0) AS tt,
    coalesce(max(seq) FILTER (WHERE kind = 'exporting'), -1) AS eq, arg_max(total, seq) FILTER (WHERE kind = 'exporting') AS et,
    arg_max(done, seq) FILTER (WHERE kind = 'exporting') AS ed,
    coalesce(max(seq) FILTER (WHERE kind IN ('running', 'progress')), -1) AS dq,
    coalesce(arg_max(CASE WHEN kind = 'running' THEN 0 ELSE done END, seq) FILTER (WHERE kind IN ('running', 'progress')), 0) AS dd,
    coalesce(max(seq) FILTER (WHERE kind = 'completed'), -1) AS cq,
    coalesce(arg_max(CASE WHEN kind = 'failed' THEN props ELSE '' END, seq) FILTER (WHERE kind IN ('failed', 'completed')), '') AS error
    FROM te GROUP BY task_id),
  h AS (SELECT *, CASE WHEN et > 0 THEN et WHEN tt > 0 THEN tt WHEN ed > 0 THEN ed ELSE 1 END AS ex FROM g),
  i AS (SELECT *, CASE WHEN eq > tq THEN ex + CASE WHEN target IN ('local', 'shelf') THEN 0 ELSE 1 END ELSE tt END AS total,
    CASE WHEN eq > dq THEN least(ed, ex) ELSE dd END AS done, cq > greatest(tq, eq, dq) AS ended FROM h),
  tasks AS (SELECT task_id, CASE WHEN last IN ('completed', 'failed', 'queued') THEN last ELSE 'running' END AS status,
    CASE WHEN last = 'exporting' THEN CASE WHEN target IN ('local', 'shelf') THEN 'saving' ELSE 'exporting' END WHEN last = 'loading' THEN 'loading_chapters'
      WHEN last IN ('running', 'progress') THEN 'downloading' ELSE last END AS phase, target, title, error,
    CAST(CASE WHEN ended AND total <= 0 THEN 1 ELSE total END AS BIGINT) AS total_chapters,
    CAST(CASE WHEN ended THEN CASE WHEN total <= 0 THEN 1 ELSE total END ELSE done END AS BIGINT) AS completed_chapters, created_at, updated_at FROM i)"""


@query("task_state", f"WITH {_TASKS} SELECT task_id, status, phase, target, title, error, total_chapters, completed_chapters FROM tasks")
def task_state(spark, d):
    return P.fold_tasks(_task_events(spark, d)).select(
        "task_id", "status", "phase", "target", "title", "error", "total_chapters", "completed_chapters")


@query("task_rows", f"""WITH {_TASKS}, r AS (SELECT task_id, seq, kind, done, epoch_us(ts) // 20000 AS us, sum((kind = 'running')::INT) OVER w AS run,
    last_value(CASE WHEN kind = 'running' OR total > 0 THEN total END IGNORE NULLS) OVER w AS known FROM te WHERE kind IN ('running', 'progress') WINDOW w AS (PARTITION BY task_id ORDER BY seq)),
  a AS (SELECT *, lag(done) OVER w AS pd, lag(us) OVER w AS pu FROM r WHERE kind = 'progress' WINDOW w AS (PARTITION BY task_id, run ORDER BY seq)),
  b AS (SELECT *, coalesce(done < pd, false) AS reset, coalesce(done = pd AND us <= pu, false) AS rep FROM a),
  c AS (SELECT *, sum(reset::INT) OVER w AS seg, sum((NOT rep)::INT) OVER w AS sn FROM b WINDOW w AS (PARTITION BY task_id, run ORDER BY seq)),
  e AS (SELECT *, min(sn) OVER (PARTITION BY task_id, run, seg ORDER BY us RANGE BETWEEN 30000000 PRECEDING AND CURRENT ROW) AS fs FROM c),
  f AS (SELECT e.task_id, e.seq, e.run, greatest(e.known - e.done, 0) AS remaining, CASE WHEN e.us > s.us AND e.done > s.done THEN (e.done - s.done)::DOUBLE / ((e.us - s.us)::DOUBLE / 1e6) ELSE 0.0 END AS rate
    FROM e JOIN c s ON s.task_id = e.task_id AND s.run = e.run AND s.sn = e.fs AND NOT s.rep),
  n AS (SELECT task_id, max(run) AS run FROM r GROUP BY 1),
  l AS (SELECT f.task_id, arg_max(rate, seq) AS rate, arg_max(remaining, seq) AS remaining FROM f JOIN n ON n.task_id = f.task_id AND n.run = f.run GROUP BY 1),
  x AS (SELECT task_id, arg_max(seq % 2, seq) FILTER (WHERE kind = 'completed') AS odd FROM te GROUP BY 1),
  m AS (SELECT user_id AS task_id, count(*) AS messages FROM (SELECT * FROM events WHERE event_type <> 'view' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 5) GROUP BY 1)
  SELECT t.task_id, status, CASE WHEN odd = 0 THEN 'a.epub' ELSE '' END AS exported, 'txt' AS formats, round(coalesce(rate, 0), 6) AS speed, coalesce(messages, 0) AS messages,
    CASE WHEN coalesce(rate, 0) <= 0 THEN '' WHEN remaining / rate <= 0 THEN '0s' WHEN remaining / rate >= 3600 THEN (floor(remaining / rate)::BIGINT // 3600) || '小时' || (floor(remaining / rate)::BIGINT // 60 % 60) || '分'
      WHEN remaining / rate >= 60 THEN (floor(remaining / rate)::BIGINT // 60) || '分' || (floor(remaining / rate)::BIGINT % 60) || '秒' ELSE floor(remaining / rate)::BIGINT || '秒' END AS eta
  FROM tasks t LEFT JOIN l ON l.task_id = t.task_id LEFT JOIN x ON x.task_id = t.task_id LEFT JOIN m ON m.task_id = t.task_id""")
def task_rows(spark, d):
    """Whole task rows, with time running twenty thousand times faster so that samples share a window."""
    events = (_task_events(spark, d).withColumn("formats", F.when(F.col("kind") == "queued", F.array(F.lit("txt"))))
              .withColumn("ts", F.timestamp_micros(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 20000))))
    log = table(spark, d, "events").selectExpr("user_id AS task_id", "event_id AS seq", "ts AS at", "'info' AS level", "CASE WHEN event_type = 'view' THEN ' ' ELSE event_type END AS text")
    t = P.task_rows(events, log, 5)
    return t.select("task_id", "status", F.array_join("exported", ",").alias("exported"), F.array_join("formats", ",").alias("formats"), F.round("speed", 6).alias("speed"),
                    F.greatest(F.size("messages"), F.lit(0)).alias("messages"), "eta")


@query("task_messages", """SELECT user_id AS task_id, event_id AS seq, event_type || ' ' || event_id AS text FROM events WHERE event_type <> 'view'
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 20""")
def task_messages(spark, d):
    m = table(spark, d, "events").selectExpr(
        "user_id AS task_id", "event_id AS seq", "CASE WHEN event_type = 'view' THEN ' ' ELSE concat(' ', event_type, ' ', event_id) END AS text",
        "ts AS at", "'info' AS level")
    arrays = P.message_arrays(m, 20)
    return arrays.select("task_id", F.explode("messages").alias("m")).select("task_id", "m.seq", "m.text")


@query("closed_orphans", f"""WITH {_TASKS} SELECT task_id, CASE WHEN status IN ('queued', 'running') THEN 'failed' ELSE status END AS status,
  CASE WHEN status IN ('queued', 'running') THEN 'restart' ELSE error END AS error, status IN ('queued', 'running') AS closed FROM tasks""")
def closed_orphans(spark, d):
    t = P.fold_tasks(_task_events(spark, d))
    return P.close_orphans(t, F.lit("2024-02-01").cast("timestamp_ntz"), " restart ").select("task_id", "status", "error", "closed")


@query("task_order", f"WITH {_TASKS} SELECT task_id, status FROM tasks ORDER BY updated_at DESC, created_at DESC")
def task_order(spark, d):
    return P.fold_tasks(_task_events(spark, d)).orderBy(*P.task_order()).select("task_id", "status")


@query("tasks_to_export_again", f"WITH {_TASKS} SELECT task_id, status FROM tasks WHERE status IN ('completed', 'failed', 'queued')")
def tasks_to_export_again(spark, d):
    return P.can_export_again(P.fold_tasks(_task_events(spark, d))).select("task_id", "status")


def _probe_log(spark, d):
    """First two events of a user are the two probe samples of a source."""
    e = table(spark, d, "events")
    n = number_rows(e, ["user_id"], [F.col("event_id")], "sample", block_of("event_id", 100_000)).filter("sample <= 2")
    return n.selectExpr("concat('p', user_id) AS site", "sample", "CAST(value * 40 AS BIGINT) AS elapsed_ms", "event_id % 9 AS count",
                        "CASE WHEN event_type = 'error' THEN 'timeout' ELSE '' END AS error", "event_type = 'error' AS timed_out", "user_id AS ord")


_PROBES = """s AS (SELECT 'p' || user_id AS site, user_id AS ord, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS sample,
    CAST(trunc(value * 40) AS BIGINT) AS elapsed_ms, event_id % 9 AS n, event_type = 'error' AS bad FROM events),
  j AS (SELECT a.site, a.ord, a.bad, a.elapsed_ms AS e1, a.n AS n1, b.elapsed_ms AS e2, b.n AS n2, NOT a.bad AND a.elapsed_ms >= 800 AS second, b.bad AS bad2
    FROM (SELECT * FROM s WHERE sample = 1) a LEFT JOIN (SELECT * FROM s WHERE sample = 2) b ON a.site = b.site),
  probes AS (SELECT site, ord, CASE WHEN second AND NOT bad2 AND e2 < e1 THEN e2 ELSE e1 END AS elapsed_ms,
    CASE WHEN second AND NOT bad2 AND e2 < e1 THEN n2 ELSE n1 END AS count, CASE WHEN second AND e2 IS NOT NULL THEN 2 ELSE 1 END AS samples,
    CASE WHEN bad THEN 'timeout' ELSE '' END AS error, bad AS timed_out FROM j)"""


@query("best_probes", f"WITH {_PROBES} SELECT site, elapsed_ms, count, samples, error, timed_out FROM probes")
def best_probes(spark, d):
    return P.best_probes(_probe_log(spark, d))


@query("probe_summary", f"""WITH {_PROBES} SELECT count(*) FILTER (WHERE error = '') AS ok, count(*) FILTER (WHERE error <> '') AS failed,
  first(site ORDER BY elapsed_ms, ord) FILTER (WHERE error = '') AS fastest, first(site ORDER BY elapsed_ms DESC, ord) FILTER (WHERE error = '') AS slowest FROM probes""")
def probe_summary(spark, d):
    log = _probe_log(spark, d)
    return P.probe_summary(P.best_probes(log).join(log.select("site", "ord").distinct(), "site"))


@query("chapter_titles_of_tasks", f"WITH {PROGRESS} SELECT task_id, arg_max(trim(title), seq) AS current_chapter FROM progress GROUP BY task_id")
def chapter_titles_of_tasks(spark, d):
    t = progress(spark, d).withColumn("kind", F.lit("progress")).selectExpr(
        "task_id", "seq", "ts", "kind", "'' AS site", "'' AS book_id", "title", "'local' AS target", "done", "total",
        "CAST(array() AS ARRAY<STRING>) AS exported", "'' AS error")
    return P.fold_tasks(t).select("task_id", first_non_blank("current_chapter").alias("current_chapter"))
