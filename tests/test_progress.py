import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from folioflow.operators import progress as P
from folioflow.operators.throttle import throttled

SCHEMA = "task_id string, seq long, ts timestamp, done int, total int"
START = dt.datetime(2024, 1, 1)


def rows_of(task, steps, total=1000):
    """steps: (seconds since start, done)"""
    return [(task, i, START + dt.timedelta(seconds=s), d, total) for i, (s, d) in enumerate(steps)]


def sequential_rates(rows):
    out, kept = {}, {}
    for task, seq, ts, done, _ in sorted(rows, key=lambda r: (r[0], r[1])):
        buf = kept.setdefault(task, [])
        if buf and done < buf[-1][1]:
            buf.clear()
        if not (buf and done == buf[-1][1] and ts <= buf[-1][0]):
            buf.append((ts, done))
            buf[:] = ([b for b in buf[:-1] if b[0] >= ts - dt.timedelta(seconds=30)] + buf[-1:])[-256:]
        span = (buf[-1][0] - buf[0][0]).total_seconds()
        gain = buf[-1][1] - buf[0][1]
        out[task, seq] = gain / span if span > 0 and gain > 0 else 0.0
    return out


def rates(spark, rows, **kw):
    df = P.windowed_rates(spark.createDataFrame(rows, SCHEMA), **kw)
    return {(r.task_id, r.seq): (r.rate, r.eta) for r in df.collect()}


def test_steady_accelerated_and_stalled_series(spark):
    steady = rows_of("steady", [(i, 10 * i) for i in range(30)])
    faster = rows_of("faster", [(i, 5 * i) for i in range(35)] + [(35 + i, 175 + 15 * i) for i in range(35)])
    single = rows_of("single", [(0, 4)])
    stalled = rows_of("stalled", [(i, 4) for i in range(5)])
    got = rates(spark, steady + faster + single + stalled)
    assert got["steady", 29][0] == pytest.approx(10, abs=0.5)
    assert got["faster", 69][0] == pytest.approx(15, abs=0.5)
    assert got["single", 0] == (0.0, "") and got["stalled", 4] == (0.0, "")


@pytest.mark.parametrize("seed", range(4))
def test_rates_equal_the_sequential_fold(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for task in "ab":
        at, done, steps = 0.0, 0, []
        for _ in range(900):
            at += rnd.choice([0.0, 0.02, 0.05, 0.5, 7.0, 29.5, 30.0])
            done = 0 if rnd.random() < 0.02 else done + rnd.choice([0, 0, 1, 2])
            steps.append((round(at, 3), done))
        rows += rows_of(task, steps)
    want = sequential_rates(rows)
    for block in (30.0, 60.0, 900.0):
        got = rates(spark, rows, block=block)
        assert got.keys() == want.keys()
        for k in want:
            assert got[k][0] == pytest.approx(want[k], abs=1e-9), k


def test_more_samples_than_the_cap_drop_the_oldest(spark):
    rows = rows_of("t", [(i * 0.05, i if i < 200 else 200 + 3 * (i - 200)) for i in range(500)])
    got, want = rates(spark, rows), sequential_rates(rows)
    assert got["t", 499][0] == pytest.approx(want["t", 499])


def sequential_throttle(rows):
    out, last = set(), {}
    for task, seq, ts, done, total, starts in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1])):
        prev = last.get(task)
        if prev is None or starts or done >= total or total <= 0 or prev[0] is None or (ts - prev[0]).total_seconds() >= 0.35 or done - prev[1] >= 3:
            last[task] = (None if starts else ts, done)
            out.add((task, seq))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_throttle_equals_the_sequential_fold(spark, seed):
    """Tasks that span several partitions, times and counts that go back, books that begin on the way."""
    rnd = random.Random(seed)
    rows = []
    for task, n in (("x", 900), ("y", 600), (None, 40), ("z", 3)):
        at, done = 0, 0
        for i in range(n):
            at += rnd.choice([0, 0, 1, 5, 50, 340, 350, -20] if seed else [0, 0, 0, 1])
            done = 0 if rnd.random() < 0.03 else max(0, done + rnd.choice([0, 0, 0, 1, -1, 4] if seed else [0, 0, 0, 0, 1, -1]))
            rows.append((task, i, START + dt.timedelta(milliseconds=at), done, 400, rnd.random() < 0.01))
    df = spark.createDataFrame(rows, SCHEMA + ", starts boolean").repartition(5)
    got = {(r.task_id, r.seq) for r in throttled(df).collect()}
    assert got == sequential_throttle(rows)


EVENTS = ("task_id string, seq long, ts timestamp, kind string, site string, book_id string, title string, target string, done int, "
          "total int, exported array<string>, error string")


def sequential_task(events):
    t = dict(status="", phase="", title="", total=0, done=0, chapter="", error="", target="browser")
    for _, _, _, kind, _, _, title, target, done, total, exported, error in events:
        local = t["target"] in ("local", "shelf")
        if kind == "queued":
            t.update(status="queued", phase="queued", target=target or "browser")
        elif kind == "loading":
            t.update(status="running", phase="loading_chapters")
        elif kind == "running":
            t.update(status="running", phase="downloading", total=total, done=0, chapter="", title=title if title.strip() else t["title"])
        elif kind == "progress":
            t.update(status="running", phase="downloading", done=done, total=total if total > 0 else t["total"], chapter=title.strip())
        elif kind == "exporting":
            n = total if total > 0 else t["total"] if t["total"] > 0 else done if done > 0 else 1
            t.update(status="running", phase="saving" if local else "exporting", total=n if local else n + 1, done=min(done, n), chapter="")
        elif kind == "completed":
            n = t["total"] if t["total"] > 0 else 1
            t.update(status="completed", phase="completed", error="", total=n, done=n, title=title if title.strip() else t["title"])
        elif kind == "failed":
            t.update(status="failed", phase="failed", error=error)
    return t


def test_task_fold_equals_the_state_machine(spark):
    rnd = random.Random(11)
    rows = []
    for task in range(60):
        kinds = ["queued"] + ["loading"] * rnd.randint(0, 1)
        if rnd.random() < 0.9:
            kinds += ["running"] + ["progress"] * rnd.randint(0, 6)
            if rnd.random() < 0.7:
                kinds += ["exporting"] + (["completed"] if rnd.random() < 0.7 else ["failed"] if rnd.random() < 0.5 else [])
            elif rnd.random() < 0.5:
                kinds += ["failed"]
        target = rnd.choice(["local", "shelf", "export", None])
        for i, k in enumerate(kinds):
            rows.append((str(task), i, START + dt.timedelta(seconds=i), k, "s", "b", rnd.choice([" ", f"T{i}"]), target,
                         rnd.randint(0, 30), rnd.choice([0, 0, 20, 25]), ["a.epub"], f"bad {i}"))
    got = {r.task_id: r for r in P.fold_tasks(spark.createDataFrame(rows, EVENTS).repartition(7)).collect()}
    for task in range(60):
        want = sequential_task([r for r in rows if r[0] == str(task)])
        r = got[str(task)]
        assert (r.status, r.phase, r.title, r.total_chapters, r.completed_chapters, r.current_chapter, r.error, r.target) == (
            want["status"], want["phase"], want["title"], want["total"], want["done"], want["chapter"], want["error"], want["target"])


def test_restart_closes_open_tasks_only(spark):
    df = spark.createDataFrame([("a", "running"), ("b", "queued"), ("c", "completed")], "task_id string, status string").selectExpr(
        "*", "status AS phase", "'' AS error", "timestamp'2024-01-01' AS finished_at", "timestamp'2024-01-01' AS updated_at")
    got = {r.task_id: (r.status, r.error) for r in P.close_orphans(df, F.lit("2024-02-01").cast("timestamp")).collect()}
    assert got == {"a": ("failed", P.RESTART_REASON), "b": ("failed", P.RESTART_REASON), "c": ("completed", "")}


def test_probe_rules(spark):
    log = [("fast", 1, 100, 3, "", False), ("fast", 2, 50, 9, "", False), ("slow", 1, 900, 3, "", False), ("slow", 2, 700, 5, "", False),
           ("worse", 1, 900, 3, "", False), ("worse", 2, 990, 5, "", False), ("bad", 1, 10, 0, "x", True), ("bad", 2, 5, 1, "", False)]
    df = spark.createDataFrame(log, "site string, sample int, elapsed_ms long, count int, error string, timed_out boolean")
    got = {r.site: (r.elapsed_ms, r["count"], r.samples, r.error) for r in P.best_probes(df).collect()}
    assert got == {"fast": (100, 3, 1, ""), "slow": (700, 5, 2, ""), "worse": (900, 3, 2, ""), "bad": (10, 0, 1, "x")}
