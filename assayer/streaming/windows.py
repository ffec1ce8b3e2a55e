"""Windowed aggregation, fingerprint dedup and idempotent batches; all but the sink take batch or stream frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def _timed(rows: DataFrame, late: str) -> DataFrame:
    """Event time as a timestamp, which watermarks need; a watermark on streams."""
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withWatermark("ts", late) if rows.isStreaming else rows


def tumbling(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, events, total) per window; rows later than ``late`` are left out of a stream."""
    rows = _timed(events, late)
    out = rows.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "events", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, start, stop, events) per run of events with no gap that long."""
    rows = _timed(events, late)
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("events"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "events")


def once(requests: DataFrame, fingerprint: list[str], late: str = "1 day") -> DataFrame:
    """Requests whose fingerprint hasn't been seen within the watermark: equal ones are served from the cache."""
    if requests.isStreaming:
        return _timed(requests, late).dropDuplicatesWithinWatermark(fingerprint)
    return requests.dropDuplicates(fingerprint)


def idempotent(write: Callable[[DataFrame, str], None], folder: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that gives each batch a path of its own; a repeated batch overwrites itself."""

    def run(batch: DataFrame, batch_id: int) -> None:
        write(batch, f"{folder}/batch={batch_id:012d}")

    return run


def overwrite(batch: DataFrame, path: str) -> None:
    batch.write.mode("overwrite").parquet(path)


class Progress(StreamingQueryListener):
    """Keeps what running queries report: one entry per batch, and how each query ended.  A failure is noted, not raised."""

    def __init__(self) -> None:
        self.batches: list[dict] = []
        self.ended: dict[str, str | None] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.ended.pop(str(event.id), None)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.batches.append({"query": str(p.id), "name": p.name, "batch": p.batchId, "rows": p.numInputRows})

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended[str(event.id)] = event.exception


def drained(stream: DataFrame, write: Callable[[DataFrame, str], None], folder: str, mode: str = "append", name: str | None = None) -> DataFrame:
    """Runs a stream over all that is there now and gives back what the batches wrote.

    Batches go to paths of their own below ``folder``, offsets to its checkpoint, so a run that is started again goes on
    where it stopped and writes no batch twice.  In ``complete`` mode the last batch holds everything.
    """
    sink = stream.writeStream.outputMode(mode).foreachBatch(idempotent(write, f"{folder}/batches")).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    (sink.queryName(name) if name else sink).start().awaitTermination()
    rows = stream.sparkSession.read.option("basePath", f"{folder}/batches").parquet(f"{folder}/batches")
    if mode == "complete":
        rows = rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0])
    return rows.drop("batch")
