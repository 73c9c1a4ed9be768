"""Live progress: windowed rates, emission throttle, message log, idle tasks, task state.

Each job has a batch twin in `operators.progress` with the same answer.  Rows of a key are put in
`seq` order inside a micro-batch; a lower `done` is a reset and never dropped, so the watermark of
the caller only bounds state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.labels import eta_label, eta_seconds
from ..operators.progress import MAX_MESSAGES, RATE_MAX_SAMPLES, RATE_WINDOW_SECONDS, RESTART_REASON, fold_tasks
from ..operators.throttle import LONG_AGO, THROTTLE_CHAPTERS, THROTTLE_MICROS

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Keyed state of these jobs needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def _time_mode(ttl_ms: int | None) -> str:
    """State that expires needs the clock, and a query with the clock never ends by itself: a stream that
    runs for good names `ttl_ms`, the silence after which a task's state is dropped; a replay of what
    is there does not."""
    return "ProcessingTime" if ttl_ms else "None"


def _in_order(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(batches, ignore_index=True).sort_values("seq", kind="stable")


def _sorted_slices(batches: Iterator[pd.DataFrame], names: list[str], most: int = 50_000) -> Iterator[pd.DataFrame]:
    """The named number columns of all rows by `seq`, `most` rows at a time: a task may have most rows of a
    micro-batch, so only their numbers are held together."""
    held: dict[str, list[np.ndarray]] = {n: [] for n in names}
    for pdf in batches:
        for n in names:
            held[n].append(pdf[n].to_numpy())
    whole = {n: np.concatenate(held.pop(n)) for n in names}
    # as pandas sorts: missing numbers come last, equal ones as they came
    order = np.argsort(whole["seq"], kind="stable")
    for start in range(0, len(order), most):
        at = order[start:start + most]
        yield pd.DataFrame({n: c[at] for n, c in whole.items()})


class RateWindow(StatefulProcessor):
    """Samples of the last window per task, at most `max_samples`."""

    def __init__(self, window: float, max_samples: int, ttl_ms: int | None) -> None:
        self.window, self.cap, self.ttl = int(round(window * 1e6)), max_samples, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.samples = handle.getListState("samples", "at bigint, done bigint", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = [tuple(s) for s in self.samples.get()] if self.samples.exists() else []
        for pdf in _sorted_slices(rows, ["seq", "at_us", "done", "total"]):
            rates = []
            for at, done in zip(pdf["at_us"].tolist(), pdf["done"].tolist()):
                if kept and done < kept[-1][1]:
                    kept = []
                if not (kept and done == kept[-1][1] and at <= kept[-1][0]):
                    kept.append((at, done))
                    fresh = [s for s in kept[:-1] if s[0] >= at - self.window] + kept[-1:]
                    kept = fresh[-self.cap:]
                span, gain = kept[-1][0] - kept[0][0], kept[-1][1] - kept[0][1]
                rates.append(gain / (span / 1e6) if span > 0 and gain > 0 else 0.0)
            yield pdf.assign(task_id=[key[0]] * len(pdf), rate=rates)[["task_id", "seq", "done", "total", "rate"]]
        self.samples.put(kept)

    def close(self) -> None:
        pass


def stream_rates(progress: DataFrame, window: float = RATE_WINDOW_SECONDS, max_samples: int = RATE_MAX_SAMPLES, ttl_ms: int | None = None) -> DataFrame:
    """Live form of `windowed_rates` for (task_id, seq, ts, done, total) rows."""
    rows = progress.select("task_id", "seq", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), "done", "total")
    out = rows.groupBy("task_id").transformWithStateInPandas(
        statefulProcessor=RateWindow(window, max_samples, ttl_ms),
        outputStructType="task_id string, seq bigint, done bigint, total bigint, rate double", outputMode="Append", timeMode=_time_mode(ttl_ms))
    return out.withColumn("eta", eta_label(eta_seconds("done", "total", "rate")))


class Throttle(StatefulProcessor):
    """Time and count of the last emitted row per task."""

    def __init__(self, ttl_ms: int | None) -> None:
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at bigint, done bigint", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get() if self.last.exists() else None
        pdf = _in_order(rows)
        passed = []
        for at, done, total, starts in zip(pdf["at_us"].tolist(), pdf["done"].tolist(), pdf["total"].tolist(), pdf["starts"].tolist()):
            ok = (last is None or starts or total <= 0 or done >= total or at - last[0] >= THROTTLE_MICROS
                  or done - last[1] >= THROTTLE_CHAPTERS)
            if ok:
                last = (LONG_AGO if starts else at, done)
            passed.append(ok)
        if last is not None:
            self.last.update(tuple(last))
        yield pdf.loc[passed, ["task_id", "seq"]]

    def close(self) -> None:
        pass


def stream_throttled(progress: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Live form of `throttle.throttled`."""
    starts = F.coalesce("starts", F.lit(False)) if "starts" in progress.columns else F.lit(False)
    rows = progress.select("task_id", "seq", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), "done", "total", starts.alias("starts"))
    return rows.groupBy("task_id").transformWithStateInPandas(
        statefulProcessor=Throttle(ttl_ms), outputStructType="task_id string, seq bigint", outputMode="Append", timeMode=_time_mode(ttl_ms))


class MessageLog(StatefulProcessor):
    """Last messages per task."""

    def __init__(self, limit: int, ttl_ms: int | None) -> None:
        self.limit, self.ttl = limit, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.log = handle.getListState("log", "seq bigint, text string", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = [tuple(m) for m in self.log.get()] if self.log.exists() else []
        pdf = _in_order(rows)
        kept += [(int(s), t.strip()) for s, t in zip(pdf["seq"], pdf["text"]) if t and t.strip()]
        kept = kept[-self.limit:]
        self.log.put(kept)
        if kept:
            yield pd.DataFrame({"task_id": [str(key[0])], "upto": [int(pdf["seq"].iloc[-1])], "texts": [[t for _, t in kept]]})

    def close(self) -> None:
        pass


def stream_messages(messages: DataFrame, limit: int = MAX_MESSAGES, ttl_ms: int | None = None) -> DataFrame:
    """Message array of a task after every micro-batch that touches it."""
    return messages.select(F.col("task_id").cast("string").alias("task_id"), "seq", "text").groupBy("task_id").transformWithStateInPandas(
        statefulProcessor=MessageLog(limit, ttl_ms), outputStructType="task_id string, upto bigint, texts array<string>",
        outputMode="Update", timeMode=_time_mode(ttl_ms))


class IdleTasks(StatefulProcessor):
    """Closes a task that has been silent for longer than allowed and has not ended."""

    def __init__(self, idle_ms: int, reason: str) -> None:
        self.idle, self.reason = idle_ms, reason

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "kind string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _in_order(rows)
        kind = str(pdf["kind"].iloc[-1])
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if kind in ("completed", "failed"):
            self.last.clear()
        else:
            self.last.update((kind,))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            self.last.clear()
            yield pd.DataFrame({"task_id": [str(key[0])], "status": ["failed"], "error": [self.reason]})

    def close(self) -> None:
        pass


def stream_idle_tasks(events: DataFrame, idle_ms: int, reason: str = "") -> DataFrame:
    """Failure rows for tasks that fell silent before they ended."""
    return events.select(F.col("task_id").cast("string").alias("task_id"), "seq", "kind").groupBy("task_id").transformWithStateInPandas(
        statefulProcessor=IdleTasks(idle_ms, reason.strip() or RESTART_REASON), outputStructType="task_id string, status string, error string",
        outputMode="Append", timeMode="ProcessingTime")


def stream_task_state(events: DataFrame) -> DataFrame:
    """Task rows from a stream of lifecycle events: the batch fold is one aggregation, so it is the
    live one too.  Write with output mode `update` or `complete`."""
    return fold_tasks(events)
