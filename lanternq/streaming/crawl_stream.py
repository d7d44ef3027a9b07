"""The crawl queue as a stream: events change the state of their url, and every change comes out.

An event is (url, kind, error, at); kinds are enqueue, claim, complete, fail and recover.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENTS = "url string, kind string, error string, at string, seq long"
TASKS = "url string, state string, attempts int, last_error string, finished_at string, seq long"


def step(task: tuple | None, kind: str, error: str | None, at: str | None, most: int) -> tuple | None:
    """The task (state, attempts, last_error, finished_at) after an event; None where the event does not apply."""
    if task is None:
        return ("pending", 0, None, None) if kind == "enqueue" else None
    state, attempts, last, finished = task
    if kind == "claim" and state == "pending":
        return "processing", attempts + 1, None, finished
    if state == "processing":
        if kind == "complete":
            return "done", attempts, None, at
        if kind == "fail":
            return ("pending", attempts, error, None) if attempts < most else ("failed", attempts, error, at)
        if kind == "recover":
            return "pending", attempts, last, None
    return None


class Queue(StatefulProcessor):
    """State of one url; events of a batch apply in the order of seq."""

    def __init__(self, most: int = 3) -> None:
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.task = handle.getValueState("task", "state string, attempts int, last_error string, finished_at string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        task = tuple(self.task.get()) if self.task.exists() else None
        out = []
        for e in pd.concat(list(rows)).sort_values("seq").itertuples(index=False):
            new = step(task, e.kind, e.error, e.at, self.most)
            if new is not None:
                task = new
                out.append((key[0], *task, e.seq))
        if out:
            self.task.update(task)
            yield pd.DataFrame(out, columns=["url", "state", "attempts", "last_error", "finished_at", "seq"])

    def close(self) -> None:
        pass


def transitions(events: DataFrame, most: int = 3) -> DataFrame:
    """Stream of task states after every event that applied. Needs the RocksDB state store."""
    return events.groupBy("url").transformWithStateInPandas(Queue(most), TASKS, "Append", "None")


def latest(changes: DataFrame) -> DataFrame:
    """The last state per url of a table of changes."""
    from pyspark.sql import functions as F

    best = F.max_by(F.struct("state", "attempts", "last_error", "finished_at"), "seq").alias("x")
    return changes.groupBy("url").agg(best).select("url", "x.*")
