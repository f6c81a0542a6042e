"""Streams over task logs: completion notices and progress."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from mediatally.streaming.ordered import BUCKETS, InOrder, in_buckets, in_order
from mediatally.streaming.requests import with_event_time

STEP_BYTES = 8 * 1024 * 1024
PAUSE_MS = 400


def completion_windows(completions: DataFrame, *, span: str = "2 seconds") -> DataFrame:
    """Completions per window of event time. Only a count and the two end titles are kept, so a burst
    costs no more than a single completion. Works on a batch and on a stream."""
    windows = completions.groupBy(F.window("event_time", span).alias("w")).agg(
        F.count(F.lit(1)).alias("completions"), F.min("title").alias("first_title"), F.max("title").alias("last_title"))
    return windows.select(F.unix_millis(F.col("w.start")).alias("window_ms"), "completions", "first_title", "last_title")


def completion_notices(windows: DataFrame) -> DataFrame:
    """Three or more completions of a window give one summary, fewer give one notice each."""
    summary = F.array(F.concat(F.col("completions").cast("string"), F.lit(" completed")))
    notices = (
        F.when(F.col("completions") >= 3, summary)
        .when(F.col("completions") == 2, F.array("first_title", "last_title")).otherwise(F.array("first_title")))
    return windows.select("window_ms", "completions", F.explode(notices).alias("notice"))


def finished_tasks(events: DataFrame) -> DataFrame:
    """Completions of a stage log, with event time and title."""
    title = F.concat(F.lit("task-"), F.col("task_id").cast("string"))
    return events.filter("stage = 'done'").select(F.timestamp_millis("ts_ms").alias("event_time"), title.alias("title"))


def stream_completions(events: DataFrame, *, watermark: str = "10 seconds") -> DataFrame:
    """R8 on a stream, in update mode: the latest row of a window counts."""
    return completion_windows(finished_tasks(events).withWatermark("event_time", watermark))


def stream_task_state(events: DataFrame, *, watermark: str = "10 minutes") -> DataFrame:
    """Running current stage of every task, in update mode."""
    return with_event_time(events, watermark).groupBy("task_id").agg(
        F.max_by("stage", F.struct("ts_ms", "seq")).alias("stage"), F.max("ts_ms").alias("updated_ms"))


class _Progress(InOrder):
    """Running bytes of every task and when it was last put out."""

    def __init__(self, step: int, pause_ms: int):
        super().__init__(["ts_ms", "seq"], ["task_id", "ts_ms", "seq", "bytes"], ["task_id", "ts_ms", "seq", "total_bytes"])
        self.step, self.pause_ms = step, pause_ms

    def decide(self, rows, upto, memory):
        held = memory.get("tasks", pd.DataFrame(columns=["task_id", "total", "shown_ms"]))
        state = {task: (total, shown) for task, total, shown in held.itertuples(index=False, name=None)}
        out, after = [], []
        for task, own in rows.groupby("task_id", sort=False):
            total, shown = state.pop(task, (0, None))
            before = total + np.concatenate([[0], np.cumsum(own["bytes"].to_numpy(dtype=np.int64))])
            crossed = np.flatnonzero(before[1:] // self.step > before[:-1] // self.step)
            ts, seq = own["ts_ms"].to_numpy(), own["seq"].to_numpy()
            for i in crossed.tolist():
                if shown is None or ts[i] - shown >= self.pause_ms:
                    shown = int(ts[i])
                    out.append((task, shown, int(seq[i]), int(before[i + 1])))
            after.append((task, int(before[-1]), -(2**62) if shown is None else shown))
        after += [(task, *s) for task, s in state.items()]
        return out, {"tasks": pd.DataFrame(after, columns=["task_id", "total", "shown_ms"])} if after else {}


def stream_progress(chunks: DataFrame, *, watermark: str = "10 seconds", step: int = STEP_BYTES, pause_ms: int = PAUSE_MS,
                    buckets: int = BUCKETS) -> DataFrame:
    """A task's running bytes where they cross a multiple of `step`, at most once in `pause_ms` of event time, in event order.

    `chunks`: task_id, ts_ms, seq (order at equal times) and bytes (NULL counts as none). With `pause_ms=0` the rows are those of
    `fetch.progress_samples`. Rows without task, time or number are left out.
    """
    rows = chunks.filter("task_id IS NOT NULL AND ts_ms IS NOT NULL AND seq IS NOT NULL").select(
        "task_id", "ts_ms", "seq", F.coalesce("bytes", F.lit(0)).cast("bigint").alias("bytes"))
    dealt = in_buckets(with_event_time(rows, watermark), [F.col("task_id")], buckets=buckets)
    return in_order(dealt, _Progress(step, pause_ms), "task_id bigint, ts_ms bigint, seq bigint, total_bytes bigint")
