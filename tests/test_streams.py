"""Streams over several files give the answer of their batch twins."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from folioflow.operators import progress as BP
from folioflow.operators.shelf import fold_books
from folioflow.operators.throttle import throttled
from folioflow.streaming import progress as SP
from folioflow.streaming import upserts as U
from test_publish import EVENTS

START = dt.datetime(2024, 1, 1)
SCHEMA = "task_id string, seq long, ts timestamp, done long, total long"


@pytest.fixture
def log(spark, tmp_path):
    rnd = random.Random(2)
    rows, at, done = [], 0.0, 0
    for i in range(400):
        at += rnd.choice([0.0, 0.1, 0.4, 20.0])
        done = 0 if rnd.random() < 0.03 else done + rnd.choice([0, 1, 3])
        rows.append(("t", i, START + dt.timedelta(seconds=round(at, 3)), done, 900))
    for n in range(4):  # four files, read one per micro-batch in order
        part = spark.createDataFrame(rows[n * 100:(n + 1) * 100], SCHEMA).coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "in"))
    return spark.createDataFrame(rows, SCHEMA), str(tmp_path)


def stream(spark, path):
    SP.use_state_store(spark)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path + "/in")


def test_rates(spark, log):
    rows, path = log
    U.run_available(SP.stream_rates(stream(spark, path)), path + "/out", path + "/state")
    got = {r.seq: (round(r.rate, 9), r.eta) for r in spark.read.parquet(path + "/out").collect()}
    assert got == {r.seq: (round(r.rate, 9), r.eta) for r in BP.windowed_rates(rows).collect()}


def test_throttle(spark, log):
    rows, path = log
    U.run_available(SP.stream_throttled(stream(spark, path)), path + "/out", path + "/state")
    assert sorted(r.seq for r in spark.read.parquet(path + "/out").collect()) == sorted(r.seq for r in throttled(rows).collect())


def test_shelf_upserts_in_batches_equal_one_fold(spark, tmp_path):
    rnd = random.Random(4)
    text = lambda p: rnd.choice(["", " ", f"{p}{rnd.randint(0, 99)}"])
    rows = [(i, START + dt.timedelta(hours=i), rnd.choice(["add", "progress"]), "s", f"b{rnd.randint(0, 9)}", rnd.choice([None, i]), text("T"), text("A"), text("C"), text("D"),
             text("L"), text("U"), f"c{i}", rnd.randint(-2, 9), text("x")) for i in range(120)]
    for n in range(3):
        spark.createDataFrame(rows[n * 40:(n + 1) * 40], EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    ev = spark.readStream.schema(spark.createDataFrame(rows[:1], EVENTS).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    U.upsert_shelf(ev, str(tmp_path / "shelf"), str(tmp_path / "state"), {"availableNow": True}, every=2).awaitTermination()
    want = fold_books(spark.createDataFrame(rows, EVENTS))
    columns = sorted(want.columns)
    key = lambda df: sorted(map(repr, df.select(*columns).collect()))
    assert key(U.shelf_at(spark, str(tmp_path / "shelf"))) == key(want)
    outcomes = spark.read.parquet(str(tmp_path / "shelf" / "outcomes"))
    assert outcomes.filter("batch = 0 AND updated").count() == 0
    assert outcomes.filter("batch > 0 AND updated").count() > 0


def test_silent_tasks_are_closed(spark, tmp_path):
    SP.use_state_store(spark)
    rows = [("a", 1, "running"), ("b", 1, "running"), ("b", 2, "completed")]
    spark.createDataFrame(rows, "task_id string, seq long, kind string").coalesce(1).write.parquet(str(tmp_path / "in"))
    ev = spark.readStream.schema("task_id string, seq long, kind string").parquet(str(tmp_path / "in"))
    seen = []
    q = (SP.stream_idle_tasks(ev, 200, "gone").writeStream.foreachBatch(lambda df, _: seen.extend(tuple(r) for r in df.collect()))
         .option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").start())
    for _ in range(20):
        if seen:
            break
        q.awaitTermination(2)
    q.stop()
    assert seen == [("a", "failed", "gone")]
