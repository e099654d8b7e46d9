"""Run events of streaming batches (V3, V10): one per micro-batch, with its rows, rejects and time.

The batch's writer knows what it stored and refused, the engine what the trigger took. A
``StreamingQueryListener`` brings both together when the engine reports a batch as done, and a
failed query becomes one failure event. Events are collected as plain facts, a row per batch, and
appended to the run's log once the query has ended (or whenever the caller flushes a stream that
does not end).
"""

from __future__ import annotations

import threading

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from tillroll.streaming.events import FACT_SCHEMA, RunLog


class BatchLog(StreamingQueryListener):
    """Follows the query of one name. ``stored`` is for the writer of its batches."""

    def __init__(self, log: RunLog, name: str, stage: str = "ingest"):
        self.log, self.name, self.stage = log, name, stage
        self._lock = threading.Lock()
        self._stored: dict[int, dict] = {}
        self._facts: list[dict] = []
        self._run: str | None = None
        self._ended = threading.Event()

    def stored(self, batch: int, accepted: int, rejected: int) -> None:
        """What a batch has written; a batch that runs again says so again."""
        rows = accepted + rejected
        share = round(100 * rejected / rows, 1) if rows else 0.0
        with self._lock:
            self._stored[batch] = {"rows": rows, "rows_written": accepted, "rows_dropped": rejected, "pct_dropped": share}

    def onQueryStarted(self, event) -> None:  # noqa: N802 - the listener's interface
        if event.name == self.name:
            self._run = str(event.runId)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        done = event.progress
        if done.name != self.name:
            return
        with self._lock:
            metrics = self._stored.pop(done.batchId, None)
            if metrics is None:  # a trigger without a batch
                return
            self._facts.append(
                {
                    "stage": self.stage,
                    "outcome": "success",
                    "duration_ms": float(done.durationMs.get("triggerExecution", 0)),
                    "metrics": metrics,
                }
            )

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if self._run != str(event.runId):
            return
        if event.exception:
            with self._lock:
                failure = {"stage": self.stage, "outcome": "failure", "error": {"type": "StreamingQueryException", "message": event.exception[:2000]}}
                self._facts.append(failure)
        self._ended.set()

    def flush(self) -> bool:
        """Append what is new to the run's log."""
        with self._lock:
            facts, self._facts = self._facts, []
        if not facts:
            return False
        self.log.add(self.log.spark.createDataFrame(facts, FACT_SCHEMA))
        return self.log.flush()

    def follow(self, spark: SparkSession, start, wait_s: float = 60.0) -> None:
        """Run the queries that ``start`` gives to their end, and log their batches."""
        spark.streams.addListener(self)
        try:
            queries: list[StreamingQuery] = start()
            try:
                for query in queries:
                    query.awaitTermination()
            finally:
                self._ended.wait(wait_s)  # the engine reports on a thread of its own
                self.flush()
        finally:
            spark.streams.removeListener(self)
