"""Progress of streams, for a status line beside a run."""

from __future__ import annotations

from collections import deque

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener


class Progress(StreamingQueryListener):
    """Keeps the last batches of every stream: name, batch number and rows read."""

    def __init__(self, keep: int = 100) -> None:
        self.batches: deque[tuple[str, int, int]] = deque(maxlen=keep)
        self.failed: list[str] = []

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.batches.append((p.name or str(p.id), p.batchId, p.numInputRows))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if event.exception:
            self.failed.append(event.exception)


def watch(spark: SparkSession) -> Progress:
    listener = Progress()
    spark.streams.addListener(listener)
    return listener
