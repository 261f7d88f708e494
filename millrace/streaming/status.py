"""Status of running queries that fills itself: rows of every micro-batch, which `health`, `speed` and `lag` read.

A listener turns what streams report into rows: one for each set of observed counts (`errors.observed`), and one for the
batch itself, with the rows it read and how far it lags behind its sources. Rows wait on the driver, a few for each
batch, and are written as files when there are enough of them, when a query ends, and when they are read.
"""

from __future__ import annotations

import datetime
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from .. import storage
from .pull import lag

SCHEMA = "query string, stage string, batch_id long, ok long, failed long, message string, lag long, seconds double, at timestamp"
#: Stage name of a batch as a whole.
BATCH = "batch"


class Status(StreamingQueryListener):
    def __init__(self, spark: SparkSession, path: str, hold: int = 500):
        self.spark, self.path, self.hold = spark, path.rstrip("/"), hold
        self.rows, self.lock, self.writing = [], threading.Lock(), threading.Lock()

    def add(self, query: str, stage: str, batch_id: int, ok: int, failed: int = 0, message: str | None = None, behind: int | None = None, seconds: float | None = None, at=None) -> None:
        """A row by hand, for work that no stream reports, such as a stage inside foreachBatch."""
        at = at or datetime.datetime.now(datetime.timezone.utc)
        with self.lock:
            self.rows.append((query, stage, batch_id, ok, failed, message, behind, seconds, at))

    def onQueryStarted(self, event) -> None: ...

    def onQueryIdle(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        p = event.progress
        query, at = p.name or str(p.id), datetime.datetime.fromisoformat(p.timestamp.replace("Z", "+00:00"))
        for stage, counts in p.observedMetrics.items():
            own = counts.asDict()
            bad = own.get("errors", 0) or 0
            self.add(query, stage, p.batchId, (own.get("rows", 0) or 0) - bad, bad, own.get("message"), at=at)
        report = {"sources": [{"endOffset": _json(s.endOffset), "latestOffset": _json(s.latestOffset)} for s in p.sources]}
        self.add(query, BATCH, p.batchId, p.numInputRows, behind=lag(report), seconds=p.batchDuration / 1000, at=at)
        if len(self.rows) >= self.hold:
            threading.Thread(target=self.flush).start()

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.add(str(event.id), BATCH, -1, 0, 1, event.exception[:500])
        threading.Thread(target=self.flush).start()

    def flush(self) -> None:
        """Write the waiting rows, behind those that another thread is writing."""
        with self.writing:
            with self.lock:
                rows, self.rows = self.rows, []
            if rows:
                storage.write_once(self.spark.createDataFrame(rows, SCHEMA).coalesce(1), f"{self.path}/part={uuid.uuid4().hex}")

    def table(self) -> DataFrame:
        """All rows by now."""
        self.flush()
        if not storage.names(self.spark, self.path):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.path)


def _json(text: str | None) -> dict:
    import json

    try:
        found = json.loads(text) if text else {}
    except ValueError:
        return {}
    return found if isinstance(found, dict) and all(isinstance(v, dict) for v in found.values()) else {}
