"""Starting again after failures, watching and stopping streaming queries."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

# How often a connection is tried, and the seconds between.
ATTEMPTS, WAIT_SECONDS = 10, 2.0


def run(start: Callable[[], StreamingQuery], attempts: int = ATTEMPTS, wait: float = WAIT_SECONDS) -> None:
    """Starts a bounded query and waits for its end; if it fails, starts it again, from the checkpoint that it names."""
    for attempt in range(1, attempts + 1):
        query = start()
        try:
            query.awaitTermination()
            return
        except StreamingQueryException:
            if attempt == attempts:
                raise
            time.sleep(wait)
        finally:
            stop(query)


def stop(query: StreamingQuery) -> bool:
    """Stops a query; whether it was running. Stopping again does nothing."""
    active = query.isActive
    if active:
        query.stop()
    return active


class Watcher(StreamingQueryListener):
    """Counts of all queries of a session, by query id: `started`, `rows` read, `batches`, `ended` with the error or None.

    Use as a context manager around queries, or register with `spark.streams.addListener`.
    """

    def __init__(self, spark=None):
        self.spark, self.lock = spark, threading.Lock()
        self.started: dict[str, str | None] = {}
        self.rows: dict[str, int] = {}
        self.batches: dict[str, int] = {}
        self.ended: dict[str, str | None] = {}

    def onQueryStarted(self, event) -> None:
        with self.lock:
            self.started[str(event.id)] = event.name

    def onQueryProgress(self, event) -> None:
        with self.lock:
            at = str(event.progress.id)
            self.rows[at] = self.rows.get(at, 0) + event.progress.numInputRows
            self.batches[at] = self.batches.get(at, 0) + 1

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self.lock:
            self.ended[str(event.id)] = event.exception

    def __enter__(self) -> Watcher:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self.spark.streams.removeListener(self)
