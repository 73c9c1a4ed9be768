"""Emission throttle of progress rows, over tasks of any length.

A row passes if it begins a book, is the first of its task, comes 0.35 s or 3 chapters after the last row
that passed, or is a final one.  The first row after the beginning of a book always passes.  Whether a row
passes depends on the last one that did, so every row has a pointer to the row that would pass next, and
the rows that pass are those on the pointers' path from the first.

Rows are sorted by (task, seq) into range partitions.  Pointers inside a partition are found there, in
numpy.  Of a task that spans partitions only two things leave a partition: rows whose pointer leads out
of it, and rows that a pointer may lead to (the first that are later, or further, than all before them in
the partition), each with the last row on its path inside the partition.  These join to pointers from
partition to partition, which are doubled until the path is marked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..plans.checkpoints import materialise

# Time and chapters between two rows that pass.
THROTTLE_MICROS = 350_000
THROTTLE_CHAPTERS = 3
LONG_AGO = -(1 << 61)  # a book's beginning lets any time pass
NEVER = 1 << 62


def _first_reaching(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """For each place, the first later one whose value is at least `wanted` there; the length if none."""
    n = len(values)
    levels = [values]  # maxima over ranges of 1, 2, 4, ... places
    while 2 ** len(levels) <= n:
        half = 2 ** (len(levels) - 1)
        last = levels[-1]
        levels.append(np.maximum(last, np.concatenate((last[half:], np.full(half, -NEVER)))))
    at = np.arange(1, n + 1)
    for k in range(len(levels) - 1, -1, -1):
        inside = at < n
        short = np.zeros(n, bool)
        short[inside] = levels[k][at[inside]] < wanted[inside]
        at = np.minimum(np.where(short, at + 2 ** k, at), n)
    return at


class Part:
    """Rows of a sorted partition."""

    def __init__(self, table: pa.Table) -> None:
        self.task = table.column("task_id")
        tasks = self.task.to_pandas().to_numpy()
        self.seq, self.at, self.done = (table.column(c).to_numpy() for c in ("seq", "at", "done"))
        starts, certain = (table.column(c).to_numpy(zero_copy_only=False) for c in ("starts", "certain"))
        n = len(tasks)
        new = np.ones(n, bool)
        new[1:] = [a != b for a, b in zip(tasks[:-1], tasks[1:], strict=True)]
        self.first = np.flatnonzero(new)
        self.segment = np.cumsum(new) - 1
        self.end = np.append(self.first[1:], n)
        since = np.where(starts, LONG_AGO, self.at)
        self.since = since
        following = np.full(n + 1, n)
        sure = np.flatnonzero(certain)
        following[:n] = np.append(sure, n)[np.searchsorted(sure, np.arange(n), side="right")]
        ahead = np.minimum(_first_reaching(self.at, since + THROTTLE_MICROS), _first_reaching(self.done, self.done + THROTTLE_CHAPTERS))
        self.next = np.minimum(ahead, following[:n])
        self.next[self.next >= self.end[self.segment]] = -1
        self.certain = certain

    def passing(self, entries: list[int]) -> np.ndarray:
        """Places on the paths from some places."""
        out, nxt = [], self.next.tolist()
        for i in entries:
            while i >= 0:
                out.append(i)
                i = nxt[i]
        return np.array(out, np.int64)

    def exits(self) -> np.ndarray:
        """The last place on the path from each."""
        out, nxt = list(range(len(self.next))), self.next.tolist()
        for i in range(len(out) - 1, -1, -1):
            if nxt[i] >= 0:
                out[i] = out[nxt[i]]
        return np.array(out, np.int64)


def _whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    parts = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(parts) if parts else None


def _resolve(asking: pd.DataFrame, open_: pd.DataFrame) -> pd.DataFrame:
    """Where the pointers that lead into a partition end: the first row in it that is late or far enough."""
    open_ = open_.sort_values("place")
    late, far = np.maximum.accumulate(open_["at"].to_numpy()), np.maximum.accumulate(open_["done"].to_numpy())
    sure = np.flatnonzero(open_["certain"].to_numpy())
    first_sure = sure[0] if len(sure) else len(open_)
    at = np.minimum(np.minimum(np.searchsorted(late, asking["left_at"].to_numpy() + THROTTLE_MICROS), np.searchsorted(far, asking["left_done"].to_numpy() + THROTTLE_CHAPTERS)), first_sure)
    hit = np.minimum(at, len(open_) - 1)
    return pd.DataFrame({"exit_part": asking["exit_part"], "exit_place": asking["exit_place"], "part": open_["part"].iloc[0], "place": open_["place"].to_numpy()[hit]})


def throttled(progress: DataFrame) -> DataFrame:
    """(task_id, seq) of the rows that pass, of (task_id, seq, ts, done, total) and, where books are told
    apart, `starts`, which marks the rows at which a book begins.

    Rows of a task are in order of `seq`, which is unique in it; times and counts may go back.  NULL
    counts are 0; a NULL time is before all others; rows with a NULL task are one task.
    """
    schema = progress.schema
    starts = F.coalesce("starts", F.lit(False)) if "starts" in progress.columns else F.lit(False)
    done, total = F.coalesce(F.col("done").cast("long"), F.lit(0)), F.coalesce(F.col("total").cast("long"), F.lit(0))
    rows = progress.select("task_id", "seq", F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(LONG_AGO)).alias("at"), done.alias("done"),
                           starts.alias("starts"), (starts | (total <= 0) | (done >= total)).alias("certain"))
    order = [F.col("task_id").asc_nulls_first(), "seq"]
    ordered = materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("part", F.spark_partition_id())
    kind = schema["task_id"].dataType.simpleString()
    task_type = to_arrow_type(schema["task_id"].dataType)

    edge_type = f"task_id {kind}, part int, role string, place long, since long, at long, done long, certain boolean, exit long"
    edge_schema = pa.schema([("task_id", task_type), ("part", pa.int32()), ("role", pa.string()), ("place", pa.int64()), ("since", pa.int64()), ("at", pa.int64()),
                             ("done", pa.int64()), ("certain", pa.bool_()), ("exit", pa.int64())])

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """`out`: rows of the last task whose pointer leads out; `start`: its first row; `open`: rows of the
        first task that a pointer may lead to; `sum`: the greatest time and count of both tasks."""
        table = _whole(batches)
        if table is None:
            return
        part, number = Part(table), table.column("part")[0].as_py()
        exits = part.exits()
        low = part.first[-1]
        out = low + np.flatnonzero(part.next[low:] < 0)
        high = part.end[0]
        late, far = (np.concatenate(([True], v[1:high] > np.maximum.accumulate(v[:high])[:-1])) for v in (part.at, part.done))
        open_ = np.flatnonzero(late | far | part.certain[:high])
        sure = np.flatnonzero(part.certain[:high])
        if len(sure):
            open_ = open_[open_ <= sure[0]]
        for role, places in (("out", out), ("start", part.first[-1:]), ("open", open_)):
            yield pa.RecordBatch.from_arrays([
                pa.array(part.task.take(pa.array(places)).to_pylist(), task_type), pa.array(np.full(len(places), number), pa.int32()), pa.array([role] * len(places), pa.string()),
                pa.array(places), pa.array(part.since[places]), pa.array(part.at[places]), pa.array(part.done[places]), pa.array(part.certain[places]), pa.array(exits[places])], schema=edge_schema)
        yield pa.RecordBatch.from_pylist([
            {"task_id": part.task[int(part.first[s])].as_py(), "part": number, "role": "sum", "place": 0, "since": 0, "at": int(part.at[a:b].max()), "done": int(part.done[a:b].max()),
             "certain": bool(part.certain[a:b].any()), "exit": 0} for s in dict.fromkeys((0, len(part.first) - 1)) for a, b in ((part.first[s], part.end[s]),)], schema=edge_schema)

    found = materialise(ordered.mapInArrow(edges, edge_type))
    same = F.col("task_id").eqNullSafe(F.col("t"))
    sums = found.filter("role = 'sum'")
    # a task that lies in several partitions: its partitions in order, with what they reach
    spread = (sums.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("part", "at", "done", "certain"))).alias("parts")).filter(F.size("parts") > 1)
              .withColumnRenamed("task_id", "t"))
    target = F.array_min(F.transform(F.filter("parts", lambda p: (p["part"] > F.col("part")) & (
        p["certain"] | (p["at"] >= F.col("since") + THROTTLE_MICROS) | (p["done"] >= F.col("done") + THROTTLE_CHAPTERS))), lambda p: p["part"]))
    asking = found.filter("role = 'out'").join(F.broadcast(spread), same).select(
        F.col("part").alias("exit_part"), F.col("place").alias("exit_place"), F.col("since").alias("left_at"), F.col("done").alias("left_done"), target.alias("to")).filter("to IS NOT NULL")
    begins = F.col("parts")[0]["part"] == F.col("part")
    nodes = (found.filter("role IN ('open', 'start')").join(F.broadcast(spread), same).filter((F.col("role") == "start") == begins)
             .select("part", "place", "at", "done", "certain", "exit", begins.alias("begins")))
    open_ = nodes.filter("NOT begins")
    hits = (asking.groupBy("to").cogroup(open_.select("part", "place", "at", "done", "certain").groupBy("part"))
            .applyInPandas(_resolve, "exit_part int, exit_place long, part int, place long"))
    # from a row that a pointer may lead to, along its path, to the next such row
    step = materialise(nodes.select(F.col("part").alias("p"), F.col("place").alias("q"), "exit")
                       .join(hits, (F.col("p") == F.col("exit_part")) & (F.col("exit") == F.col("exit_place"))).select("p", "q", "part", "place"))
    marked, size = materialise(nodes.filter("begins").select("part", "place", "begins")), -1
    while (now := marked.count()) != size:
        size = now
        ahead = marked.select(F.col("part").alias("p"), F.col("place").alias("q")).join(step, ["p", "q"]).select("part", "place", F.lit(False).alias("begins"))
        marked = materialise(marked.unionByName(ahead).distinct())
        on = step.select(F.col("p").alias("part"), F.col("q").alias("place"), F.col("part").alias("x"), F.col("place").alias("y"))
        step = materialise(step.join(on, ["part", "place"]).select("p", "q", F.col("x").alias("part"), F.col("y").alias("place")))
    # one row a partition at most: where the path enters the task that began before it
    entries = {r["part"]: r["place"] for r in marked.filter("NOT begins").collect()}
    shared = progress.sparkSession.sparkContext.broadcast((entries, {r["part"] for r in open_.select("part").distinct().collect()}))

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _whole(batches)
        if table is None:
            return
        part, number = Part(table), table.column("part")[0].as_py()
        where, continued = shared.value
        begin = part.first.tolist()
        if number in continued:
            begin = begin[1:] + ([where[number]] if number in where else [])
        at = pa.array(np.sort(part.passing(begin)))
        yield pa.RecordBatch.from_arrays([pa.array(part.task.take(at).to_pylist(), task_type), table.column("seq").take(at).combine_chunks()], ["task_id", "seq"])

    return ordered.mapInArrow(passed, f"task_id {kind}, seq {schema['seq'].dataType.simpleString()}")
