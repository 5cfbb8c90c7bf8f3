"""Writing streams: several sinks, refreshed side tables, late rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from netsift.sources.packets import JSON_TIMES

Sink = Callable[[DataFrame, int], None]


def json_sink(path: str) -> Sink:
    """JSON lines under one folder per batch; a repeated batch replaces its folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").options(**JSON_TIMES).json(f"{path}/batch_id={batch_id}")

    return write


def parquet_sink(path: str) -> Sink:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def fan_out(
    stream: DataFrame,
    sinks: dict[str, Sink],
    checkpoint: str,
    on_failure: Callable[[int, str, Exception], None] | None = None,
    available_now: bool = True,
    dead_letter: Callable[[str], Sink] | None = None,
) -> StreamingQuery:
    """Write each batch to every sink; one failing sink does not stop the others, and none loses a batch.

    Sinks are called with the batch id, by which they make repeats harmless. Failures go to ``on_failure``.
    The batch of a failed sink goes to ``dead_letter(name)``; without one, or if that fails too or no sink
    took the batch, the batch fails after all sinks had it and is retried as a whole.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist(StorageLevel.MEMORY_AND_DISK)
        failures = {}
        try:
            for name, sink in sinks.items():
                try:
                    sink(kept, batch_id)
                except Exception as error:
                    failures[name] = error
                    if on_failure:
                        on_failure(batch_id, name, error)
            if failures and (dead_letter is None or len(failures) == len(sinks)):
                raise next(iter(failures.values()))
            for name in failures:
                dead_letter(name)(kept, batch_id)
        finally:
            kept.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def enrich_each_batch(
    stream: DataFrame,
    load: Callable[[], dict[str, DataFrame]],
    enrich: Callable[[DataFrame, dict[str, DataFrame]], DataFrame],
    sink: Sink,
    checkpoint: str,
    available_now: bool = True,
) -> StreamingQuery:
    """Stream-static enrichment whose tables (feeds, locations, names) are loaded anew for each batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        sink(enrich(batch, load()), batch_id)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _dropped(progress) -> int:
    operators = progress.stateOperators if hasattr(progress, "stateOperators") else progress["stateOperators"]
    return sum(int(op.numRowsDroppedByWatermark if hasattr(op, "numRowsDroppedByWatermark") else op["numRowsDroppedByWatermark"]) for op in operators)


def late_rows(query: StreamingQuery) -> int:
    """Rows that stateful steps dropped behind the watermark, over the batches that the query still
    remembers (the last 100 by default); :class:`LateRows` counts all of them."""
    return sum(_dropped(progress) for progress in query.recentProgress)


class LateRows(StreamingQueryListener):
    """Counts the rows that each query has dropped behind the watermark since the listener was added.

    ``spark.streams.addListener(counter)`` before the query starts; ``counter.total(query)`` after.
    """

    def __init__(self) -> None:
        self.by_query: dict[str, int] = {}

    def total(self, query: StreamingQuery) -> int:
        return self.by_query.get(str(query.id), 0)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        key = str(event.progress.id)
        self.by_query[key] = self.by_query.get(key, 0) + _dropped(event.progress)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def mark_late(stream: DataFrame, ts: str, seen_at: str, seconds: float) -> DataFrame:
    """Add ``is_late``: the row arrived more than ``seconds`` after its event time."""
    delay = F.col(seen_at).cast("timestamp").cast("double") - F.col(ts).cast("timestamp").cast("double")
    return stream.withColumn("is_late", delay > seconds)
