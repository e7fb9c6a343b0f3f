"""Tables made of one folder per batch, compacted without their readers noticing.

A stream leaves a small folder a batch, ``<table>/batch=<n>``. ``compact`` merges the finished ones into a *snapshot* and publishes it by
renaming one small manifest, ``<table>/_log/<version>.json``, into place. A manifest says which snapshot folder holds all batches up
to a number; batches after it are read where they are. So a reader, who looks at the newest manifest first, sees every batch
exactly once, before, during and after a compaction, also one that was killed half-way.

Folders that a snapshot replaces are deleted by ``clean`` only one compaction later, so a reader that began under the
last manifest still finds its files. Snapshots are merged by size: each takes in the earlier snapshots that are smaller than twice
what is new, so a row is rewritten a number of times that grows with the logarithm of the table, not with its age.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOG = "_log"


@dataclass
class Manifest:
    """``parts``: [folder, first batch, last batch, rows] of each snapshot; ``old``: folders the last version still read."""

    version: int
    parts: list
    old: list

    @property
    def upto(self) -> int:
        """The last batch that a snapshot holds, -1 for none."""
        return max((last for _, _, last, _ in self.parts), default=-1)


class _Store:
    """The few file operations that publishing needs, through Spark's own file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        folder = self._path(name)
        return [f.getPath().getName() for f in self.fs.listStatus(folder)] if self.fs.exists(folder) else []

    def put(self, name: str, text: str) -> bool:
        """Writes a small file and renames it into place; False if it is there already."""
        hidden = self._path(f"{_LOG}/.{uuid.uuid4().hex}")
        out = self.fs.create(hidden)
        out.write(bytearray(text.encode()))
        out.close()
        if self.fs.exists(self._path(name)) or not self.fs.rename(hidden, self._path(name)):
            self.fs.delete(hidden, False)
            return False
        return True

    def text(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def drop(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


def newest(spark: SparkSession, path: str) -> Manifest:
    """The manifest that counts now; an empty one of version 0 where there is none."""
    store = _Store(spark, path)
    versions = [int(n.removesuffix(".json")) for n in store.names(_LOG) if n.endswith(".json") and not n.startswith(".")]
    return Manifest(**json.loads(store.text(f"{_LOG}/{max(versions)}.json"))) if versions else Manifest(0, [], [])


def _batches(store: _Store) -> list[int]:
    return sorted(int(n.removeprefix("batch=")) for n in store.names() if n.startswith("batch="))


def folders(spark: SparkSession, path: str) -> int:
    """Folders that hold rows, snapshots and batches."""
    return sum(n.startswith(("batch=", "snapshot-")) for n in _Store(spark, path).names())


def read_log(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """All rows of the table with their ``batch``; with ``before`` only of batches before that number.

    The driver lists one name for each batch since the last compaction.
    """
    store, manifest = _Store(spark, path), newest(spark, path)
    open_ = [b for b in _batches(store) if b > manifest.upto and (before is None or b < before)]
    kept = [folder for folder, first, _, _ in manifest.parts if before is None or first < before]
    rows = spark.createDataFrame([], f"{schema}, batch long")
    if kept:
        rows = rows.unionByName(spark.read.schema(f"{schema}, batch long").parquet(*[f"{path}/{folder}" for folder in kept]))
    if open_:
        fresh = spark.read.schema(f"{schema}, batch long").option("basePath", path).parquet(*[f"{path}/batch={b}" for b in open_])
        rows = rows.unionByName(fresh)
    return rows if before is None else rows.where(F.col("batch") < before)


def compact(spark: SparkSession, path: str, schema: str, upto: int, rows_per_file: int = 1_000_000) -> Manifest:
    """Merges the batches up to ``upto``, all of them finished, into a snapshot and publishes it.

    Nothing is deleted but what the version before last left behind. A second compaction at the same time loses: the one that
    publishes a version first counts, and the other's snapshot is removed.
    """
    store, manifest = _Store(spark, path), newest(spark, path)
    fresh = [b for b in _batches(store) if manifest.upto < b <= upto]
    if not fresh:
        return manifest
    new = spark.read.schema(f"{schema}, batch long").option("basePath", path).parquet(*[f"{path}/batch={b}" for b in fresh])
    count, merged, kept = new.count(), [], list(manifest.parts)
    while kept and kept[-1][3] < 2 * max(count, 1):
        part = kept.pop()
        merged.append(part)
        count += part[3]
    rows = new
    if merged:
        rows = rows.unionByName(spark.read.schema(f"{schema}, batch long").parquet(*[f"{path}/{part[0]}" for part in merged]))
    folder = f"snapshot-{uuid.uuid4().hex}"
    rows.repartition(max(1, -(-count // rows_per_file))).write.parquet(f"{path}/{folder}")
    first = min([fresh[0], *(part[1] for part in merged)])
    replaced = [f"batch={b}" for b in fresh] + [part[0] for part in merged]
    after = Manifest(manifest.version + 1, [*kept, [folder, first, fresh[-1], count]], replaced)
    if not store.put(f"{_LOG}/{after.version}.json", json.dumps(asdict(after))):
        store.drop(folder)
        return newest(spark, path)
    for name in manifest.old:
        store.drop(name)
    return after


def clean(spark: SparkSession, path: str) -> None:
    """Deletes what no manifest reads any more; call it when no reader of the version before is left."""
    store, manifest = _Store(spark, path), newest(spark, path)
    for name in manifest.old:
        store.drop(name)
    live = {part[0] for part in manifest.parts}
    for name in store.names():
        if name.startswith("snapshot-") and name not in live:
            store.drop(name)
    for name in store.names(_LOG):
        if name.endswith(".json") and not name.startswith(".") and int(name.removesuffix(".json")) < manifest.version:
            store.drop(f"{_LOG}/{name}")
