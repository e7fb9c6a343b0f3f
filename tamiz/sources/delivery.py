"""Outgoing messages, each delivered once: a Spark data source that files batches of messages.

``data`` holds files of JSON lines and ``commits`` one small file to each finished batch, which names the data files that count.
A task reports what it wrote; the driver publishes a batch by renaming its commit file. What a failed attempt left behind is named
nowhere, and a batch whose commit file is there already changes nothing. ``delivered`` reads what counts.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage,
)
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..config import DEFAULT, TriageConfig
from . import files, sinks

MESSAGE = "message_id string, channel string, recipient string, payload string"
_FIELDS = [f.split()[0] for f in MESSAGE.split(", ")]
#: Messages to a data file at most, and those turned into text at a time.
ROWS, AT_ONCE = 50_000, 500


@dataclass
class Filed(WriterCommitMessage):
    """(file name, messages) of what a task wrote."""

    written: list[tuple[str, int]]


class _Box:
    """The folder of an outbox."""

    def __init__(self, uri: str):
        self.uri = uri
        self.store, self.base = files.file_system(uri)

    def __getstate__(self) -> str:
        return self.uri

    def __setstate__(self, uri: str) -> None:
        self.__init__(uri)

    def prepare(self) -> None:
        for folder in ("data", "commits"):
            self.store.create_dir(f"{self.base}/{folder}", recursive=True)

    def put(self, rows: list[dict]) -> str:
        name = f"{uuid.uuid4().hex}.json"
        with self.store.open_output_stream(f"{self.base}/data/{name}") as f:
            f.write(self._lines(rows))
        return name

    @staticmethod
    def _lines(rows: list[dict]) -> bytes:
        return "".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows).encode()

    def file(self, batches: Iterator[pa.RecordBatch]) -> Filed:
        """Writes a task's messages, a few at a time, whatever the size of a file."""
        written, out = [], None
        try:
            for batch in batches:
                batch, at = batch.select(_FIELDS), 0
                while at < batch.num_rows:
                    if out is None or written[-1][1] == ROWS:
                        if out is not None:
                            out.close()
                        written.append((f"{uuid.uuid4().hex}.json", 0))
                        out = self.store.open_output_stream(f"{self.base}/data/{written[-1][0]}")
                    name, rows = written[-1]
                    part = batch.slice(at, min(AT_ONCE, ROWS - rows))
                    out.write(self._lines(part.to_pylist()))
                    written[-1], at = (name, rows + part.num_rows), at + part.num_rows
        finally:
            if out is not None:
                out.close()
        return Filed(written)

    def publish(self, batch: str, messages: list[Filed | None]) -> None:
        """Makes the batch's files count, unless the batch has been published before."""
        final = f"{self.base}/commits/{batch}.json"
        if self.store.get_file_info(final).type != pafs.FileType.NotFound:
            self.drop(messages)
            return
        lines = [{"batch": batch, "file": name, "rows": rows} for m in messages if m for name, rows in m.written]
        hidden = f"{self.base}/commits/.{uuid.uuid4().hex}"
        with self.store.open_output_stream(hidden) as f:
            f.write("".join(json.dumps(line) + "\n" for line in lines).encode())
        self.store.move(hidden, final)

    def drop(self, messages: list[Filed | None]) -> None:
        for message in messages:
            for name, _ in message.written if message else ():
                self.store.delete_file(f"{self.base}/data/{name}")


class OutboxWriter(DataSourceArrowWriter):
    def __init__(self, box: _Box, batch: str):
        self.box, self.batch = box, batch
        box.prepare()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Filed:
        return self.box.file(iterator)

    def commit(self, messages: list[Filed | None]) -> None:
        self.box.publish(self.batch, messages)

    def abort(self, messages: list[Filed | None]) -> None:
        self.box.drop(messages)


class OutboxStreamWriter(DataSourceStreamArrowWriter):
    """Batches are named by the query's own numbers, so a box belongs to one checkpoint."""

    def __init__(self, box: _Box):
        self.box = box
        box.prepare()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Filed:
        return self.box.file(iterator)

    def commit(self, messages: list[Filed | None], batchId: int) -> None:
        self.box.publish(str(batchId), messages)

    def abort(self, messages: list[Filed | None], batchId: int) -> None:
        self.box.drop(messages)


class Outbox(DataSource):
    """Sink for ``MESSAGE`` rows. Options: path and, for batch writes, batch: the name under which a repeat is known."""

    @classmethod
    def name(cls) -> str:
        return "tamiz_outbox"

    def writer(self, schema: StructType, overwrite: bool) -> OutboxWriter:
        return OutboxWriter(_Box(self.options["path"]), self.options["batch"])

    def streamWriter(self, schema: StructType, overwrite: bool) -> OutboxStreamWriter:
        return OutboxStreamWriter(_Box(self.options["path"]))


def messages(analyses: DataFrame, cfg: TriageConfig = DEFAULT) -> DataFrame:
    """``MESSAGE`` rows of analyses: channels alert, case, notice, webhook-spam and webhook-legitimo."""
    def of(channel, rows, recipient, payload):
        return rows.select(F.col("mensaje_id").alias("message_id"), channel.alias("channel"), recipient.cast("string").alias("recipient"), payload.alias("payload"))

    nobody, payload = F.lit(None), F.col("payload")
    alerts = of(F.lit("alert"), sinks.alerts_outbox(analyses, cfg), nobody, payload)
    cases = of(F.lit("case"), sinks.cases_outbox(analyses, cfg), nobody, payload)
    notices = of(F.lit("notice"), sinks.reporter_notices(analyses, cfg), F.col("recipient"), F.to_json(F.struct("subject", "body")))
    hooks = of(F.concat(F.lit("webhook-"), F.col("webhook")), sinks.webhook_payloads(analyses), nobody, payload)
    return alerts.unionByName(cases).unionByName(notices).unionByName(hooks)


def deliver(rows: DataFrame, path: str, batch: str | int) -> None:
    """Files ``MESSAGE`` rows as one batch; a batch that is filed already stays as it is."""
    rows.sparkSession.dataSource.register(Outbox)
    rows.select(*_FIELDS).write.format("tamiz_outbox").option("path", path).option("batch", str(batch)).mode("append").save()


def deliver_stream(rows: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts a query that files a stream of ``MESSAGE`` rows, a batch each."""
    rows.sparkSession.dataSource.register(Outbox)
    return rows.select(*_FIELDS).writeStream.format("tamiz_outbox").option("path", path).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"processingTime": "5 seconds"})).start()


def delivered(spark: SparkSession, path: str) -> DataFrame:
    """(batch, message_id, channel, recipient, payload) of the published batches."""
    commits = spark.read.schema("batch string, file string, rows long").json(f"{path}/commits")
    data = spark.read.schema(MESSAGE).json(f"{path}/data").withColumn("file", F.col("_metadata.file_name"))
    return data.join(commits.select("batch", "file"), "file").select("batch", *_FIELDS)
