"""The run log of a stream: a listener turns its progress into steps and chunk timings.

Progress reports come to the driver while the stream runs, one for each micro-batch, with what
was observed inside the batch's own job; nothing is read again to be counted. They are a few
numbers each, kept until the stream ends and then written as one batch of the log.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

from tallyspark.schema import CHUNK_TIMINGS, STEP_EXECUTIONS

READ, SETTLED = "orders_read", "orders_settled"
STEP = "settle"


def watched(orders: DataFrame, name: str = READ) -> DataFrame:
    """The same rows, counted under that name in each micro-batch."""
    return orders.observe(name, F.count(F.lit(1)).alias("rows"))


class StreamLog(StreamingQueryListener):
    """Counts and times of the micro-batches of streams; add it to ``spark.streams``."""

    def __init__(self) -> None:
        self._batches: dict[str, dict[int, tuple[int, int, float]]] = {}
        self._ended: dict[str, threading.Event] = {}
        self._lock = threading.Lock()

    def _end(self, query_id: str) -> threading.Event:
        with self._lock:
            return self._ended.setdefault(query_id, threading.Event())

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self._end(str(event.runId))

    def onQueryProgress(self, event) -> None:  # noqa: N802
        progress = event.progress
        if READ not in progress.observedMetrics:
            return  # an idle trigger runs no batch
        read = progress.observedMetrics[READ]["rows"]
        settled = progress.observedMetrics.get(SETTLED)
        wrote = settled["rows"] if settled else 0
        elapsed = float(progress.durationMs.get("triggerExecution", 0))
        with self._lock:
            # a report that comes twice counts once
            batches = self._batches.setdefault(str(progress.runId), {})
            batches[progress.batchId] = (read, wrote, elapsed)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self._end(str(event.runId)).set()

    def batches(self, query: StreamingQuery, patience: float = 60) -> dict[int, tuple[int, int, float]]:
        """(read, settled, milliseconds) by batch of a stream that has ended. Reports arrive
        after the fact, that of the end last."""
        if not self._end(str(query.runId)).wait(patience):
            raise TimeoutError("the stream's last report has not come")
        return dict(self._batches.get(str(query.runId), {}))


def step_executions(spark: SparkSession, log: StreamLog, query: StreamingQuery, case: str) -> DataFrame:
    """One step for the stream's run: read, written, skipped as settled before, time."""
    batches = log.batches(query).values()
    read, wrote = sum(b[0] for b in batches), sum(b[1] for b in batches)
    row = (case, STEP, read, wrote, read - wrote, round(sum(b[2] for b in batches)))
    return spark.createDataFrame([row], STEP_EXECUTIONS)


def chunk_timings(spark: SparkSession, log: StreamLog, query: StreamingQuery) -> DataFrame:
    """The time of each micro-batch as a chunk's."""
    rows = [(STEP, batch + 1, times[2]) for batch, times in sorted(log.batches(query).items())]
    return spark.createDataFrame(rows, CHUNK_TIMINGS)
