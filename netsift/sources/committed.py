"""Alert files that are written by batch: all of a batch or nothing, and once.

A data source in Python. Tasks write JSON lines into files of their own; a file counts only when the
commit record of its batch names it. A batch that is written again (a restarted stream, a retried sink)
finds its record and adds nothing; what a failed attempt left behind no record names. Rows are
``(alert_id, value)`` and are read back with their ``batch_id``.

The folder may be a path or a URI that pyarrow can open; driver and executors must share it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage

from netsift.sources.packets import JSON_TIMES

FORMAT = "committed_alerts"
SCHEMA = "batch_id string, alert_id string, value string"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    """What one task has written: the file's name, or none for no rows."""

    name: str | None
    rows: int


def write_part(folder: str, rows: Iterator) -> Written:
    """Write one task's rows to a new file; an empty task writes none."""
    store, root = _open(folder)
    name, n, out = f"part-{uuid.uuid4().hex}.json", 0, None
    try:
        for row in rows:
            if out is None:
                store.create_dir(f"{root}/data", recursive=True)
                out = store.open_output_stream(f"{root}/data/{name}")
            out.write((json.dumps({"alert_id": row["alert_id"], "value": row["value"]}) + "\n").encode())
            n += 1
    finally:
        if out is not None:
            out.close()
    return Written(name if n else None, n)


def _record(root: str, batch_id: str) -> str:
    return f"{root}/commits/{batch_id}.json"


def drop_parts(folder: str, messages: list[Written | None]) -> None:
    store, root = _open(folder)
    for message in messages:
        if message is not None and message.name:
            store.delete_file(f"{root}/data/{message.name}")


def commit_batch(folder: str, batch_id: str, messages: list[Written]) -> bool:
    """Name the batch's files in its record; False, and the files go, if the batch has a record already."""
    store, root = _open(folder)
    store.create_dir(f"{root}/commits", recursive=True)
    record = _record(root, batch_id)
    if store.get_file_info(record).type != fs.FileType.NotFound:
        drop_parts(folder, messages)
        return False
    body = {"batch_id": batch_id, "files": sorted(m.name for m in messages if m.name), "rows": sum(m.rows for m in messages)}
    # a reader never sees half a record
    draft = f"{record}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(draft) as out:
        out.write(json.dumps(body).encode())
    store.move(draft, record)
    return True


def commits(folder: str) -> list[dict]:
    """The commit records."""
    store, root = _open(folder)
    found = store.get_file_info(fs.FileSelector(f"{root}/commits", allow_not_found=True))
    out = []
    for info in sorted(found, key=lambda i: i.path):
        if info.path.endswith(".json"):
            with store.open_input_stream(info.path) as source:
                out.append(json.loads(source.read()))
    return out


class _BatchWriter(DataSourceWriter):
    def __init__(self, folder: str, batch_id: str) -> None:
        self.folder, self.batch_id = folder, batch_id

    def write(self, iterator: Iterator) -> Written:
        return write_part(self.folder, iterator)

    def commit(self, messages: list) -> None:
        commit_batch(self.folder, self.batch_id, messages)

    def abort(self, messages: list) -> None:
        drop_parts(self.folder, messages)


class _StreamWriter(DataSourceStreamWriter):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def write(self, iterator: Iterator) -> Written:
        return write_part(self.folder, iterator)

    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803
        commit_batch(self.folder, str(batchId), messages)

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803
        drop_parts(self.folder, messages)


class _Reader(DataSourceReader):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((c["batch_id"], name)) for c in commits(self.folder) for name in c["files"]] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        batch_id, name = partition.value
        store, root = _open(self.folder)
        with store.open_input_stream(f"{root}/data/{name}") as source:
            rest = b""
            while chunk := source.read(1 << 20):
                *lines, rest = (rest + chunk).split(b"\n")
                for line in lines:
                    row = json.loads(line)
                    yield batch_id, row["alert_id"], row["value"]


class CommittedAlerts(DataSource):
    """``format("committed_alerts")``: options ``path`` and, for a batch write, ``batchId`` (a new one if missing)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("batches are only added")
        return _BatchWriter(self.options["path"], self.options.get("batchId") or uuid.uuid4().hex)

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:  # noqa: N802
        return _StreamWriter(self.options["path"])


def as_lines(alerts: DataFrame, alert_id: str) -> DataFrame:
    """``(alert_id, value)``: the alert as one JSON object."""
    value = F.to_json(F.struct(*[F.col(f"`{c}`") for c in alerts.columns]), JSON_TIMES)
    return alerts.select(F.col(alert_id).cast("string").alias("alert_id"), value.alias("value"))


def write_batch(alerts: DataFrame, path: str, batch_id: str | int, alert_id: str = "id") -> None:
    """Write a batch once: alerts that share an id are one, and a batch that is there already stays as it is."""
    spark = alerts.sparkSession
    spark.dataSource.register(CommittedAlerts)
    lines = as_lines(alerts, alert_id).groupBy("alert_id").agg(F.min("value").alias("value"))
    lines.write.format(FORMAT).option("path", path).option("batchId", str(batch_id)).mode("append").save()


def committed_sink(path: str, alert_id: str = "id"):
    """A sink for ``fan_out``: batches that are handed over again are not written again."""
    return lambda batch, batch_id: write_batch(batch, path, batch_id, alert_id)


def write_stream(alerts: DataFrame, path: str, checkpoint: str, alert_id: str = "id", available_now: bool = True):
    """Start a stream that commits each of its batches once."""
    alerts.sparkSession.dataSource.register(CommittedAlerts)
    writer = as_lines(alerts, alert_id).writeStream.format(FORMAT).option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_committed(spark: SparkSession, path: str, schema) -> DataFrame:
    """The alerts of all committed batches, as ``schema`` has them, and ``batch_id``."""
    spark.dataSource.register(CommittedAlerts)
    lines = spark.read.format(FORMAT).option("path", path).load()
    return lines.select("batch_id", F.from_json("value", schema, JSON_TIMES).alias("a")).select("batch_id", "a.*")
