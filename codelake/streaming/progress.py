"""The progress of streaming queries as a table."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

PROGRESS = "query string, batch long, at string, rows long, seconds double"


class BatchLog(StreamingQueryListener):
    """Appends a row for each micro-batch of the session's streams to a Parquet table; `every` batches at a time, or on flush."""

    def __init__(self, spark: SparkSession, path: str, every: int = 100):
        self._spark, self._path, self._every = spark, path, every
        self._rows: list[tuple] = []
        self._lock = threading.Lock()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        if p.numInputRows:
            with self._lock:
                self._rows.append((str(p.id), p.batchId, p.timestamp, p.numInputRows, p.batchDuration / 1000))
                full = len(self._rows) >= self._every
            if full:
                self.flush()

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.flush()

    def flush(self) -> None:
        with self._lock:
            rows, self._rows = self._rows, []
        if rows:
            self._spark.createDataFrame(rows, PROGRESS).coalesce(1).write.mode("append").parquet(self._path)

    def read(self) -> DataFrame:
        """A row a batch: query, batch, when it began, its rows and seconds. A batch that ran twice has one row for each time."""
        return self._spark.read.schema(PROGRESS).parquet(self._path)
