"""Report files as a Spark data source: batch, stream and sink.

``spark.read.format("tamiz_reports")`` gives (path, arrived_at, content), one row per ``*.txt`` file, files without a byte included.
The driver lists nothing: partitions are shares of the names (``files.share_of``), and each task lists, looks at and reads its own.

As a stream, an offset is an instant. A batch holds the files that came to the folder after its start and up to its end, again
found by the tasks. A repeated batch looks at the same interval. The driver asks one thing of the folder, when it last
changed, and lets a batch begin only if that is recent or ``refresh`` has passed.

As a sink, rows (name, content) become files; each is written under a hidden name and renamed when it is whole.
"""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from . import files

SCHEMA = "path string, arrived_at timestamp, content string"
SUFFIX = ".txt"
#: Bytes of content, or files, to an Arrow batch.
BYTES, FILES = 8 << 20, 1000
_ARROW = pa.schema([("path", pa.string()), ("arrived_at", pa.timestamp("us", tz="UTC")), ("content", pa.string())])


@dataclass
class Share(InputPartition):
    """One of so many shares of a folder; of files that came after ``after`` and up to ``upto``, where given."""

    number: int
    shares: int
    after: int | None = None
    upto: int | None = None


def _rows(uri: str, share: Share) -> Iterator[pa.RecordBatch]:
    """Undecodable bytes are dropped, as a text reader that ignores errors does."""
    rows, size = [], 0
    for found in files.share_of(uri, SUFFIX, share.number, share.shares):
        if share.upto is not None and not (share.after or 0) < found.arrived <= share.upto:
            continue
        content = files.read_bytes(uri, found.path).decode("utf-8", "ignore")
        rows.append((found.uri, found.modified * 1000, content))
        size += len(content)
        if size >= BYTES or len(rows) >= FILES:
            yield _batch(rows)
            rows, size = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


class ReportReader(DataSourceReader):
    def __init__(self, uri: str, shares: int):
        self.uri, self.shares = uri, shares

    def partitions(self) -> list[Share]:
        return [Share(k, self.shares) for k in range(self.shares)]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        return _rows(self.uri, partition)


class ReportStream(DataSourceStreamReader):
    """``settle`` ms are left to files that are still being written; ``refresh`` ms after the last batch the folder is looked at
    whether it changed or not (files in its subfolders do not change it); a folder counts as changed for ``quiet`` ms."""

    def __init__(self, uri: str, shares: int, settle: int, refresh: int, quiet: int):
        self.uri, self.shares, self.settle, self.refresh, self.quiet = uri, shares, settle, refresh, quiet
        self.last: int | None = None

    def initialOffset(self) -> dict:
        return {"upto": 0}

    def changed(self) -> int:
        """When the folder last changed, in ms; one request, no listing. Stores without folder times count as changed now."""
        path = files.local_path(self.uri)
        if path is None:
            return self.now()
        try:
            seen = os.stat(path)
        except FileNotFoundError:
            return 0
        return max(seen.st_mtime_ns, seen.st_ctime_ns) // 1_000_000

    @staticmethod
    def now() -> int:
        return time.time_ns() // 1_000_000

    def latestOffset(self) -> dict:
        upto = self.now() - self.settle
        idle = self.last is not None and upto - self.last < self.refresh and self.changed() <= self.last - self.quiet
        if not idle:
            self.last = upto
        return {"upto": self.last}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        return [Share(k, self.shares, start["upto"], end["upto"]) for k in range(self.shares)]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        return _rows(self.uri, partition)

    def commit(self, end: dict) -> None:
        self.last = max(self.last or 0, end["upto"])


class ReportWriter(DataSourceArrowWriter):
    """Writes rows (name, content) as ``<name>.txt``; a file is seen when it is whole, and a repeated task replaces its files."""

    def __init__(self, uri: str):
        self.folder = files.local_path(uri)
        if self.folder is None:
            raise ValueError("report files are written to local or mounted folders")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        os.makedirs(self.folder, exist_ok=True)
        for batch in iterator:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
                hidden = os.path.join(self.folder, f".{uuid.uuid4().hex}")
                with open(hidden, "wb") as f:
                    f.write((content or "").encode())
                os.replace(hidden, os.path.join(self.folder, name + SUFFIX))
        return WriterCommitMessage()


class ReportSource(DataSource):
    """Options: path, shares (default 8) and, for streams, settle, refresh and quiet in ms."""

    @classmethod
    def name(cls) -> str:
        return "tamiz_reports"

    def schema(self) -> str:
        return SCHEMA

    def _shares(self) -> int:
        return max(1, int(self.options.get("shares", 8)))

    def reader(self, schema: StructType) -> ReportReader:
        return ReportReader(self.options["path"], self._shares())

    def streamReader(self, schema: StructType) -> ReportStream:
        settle, refresh, quiet = (int(self.options.get(k, v)) for k, v in (("settle", 0), ("refresh", 60_000), ("quiet", 60_000)))
        return ReportStream(self.options["path"], self._shares(), settle, refresh, quiet)

    def writer(self, schema: StructType, overwrite: bool) -> ReportWriter:
        return ReportWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ReportSource)
