"""The model's bookkeeping as a stateful stream: accuracy, size and threshold of each model, kept from batch to batch.

``operators.training`` computes the same figures over a stored log. Here the log is a stream: the state of a model is the outcome of
its last feedbacks, the number of examples it has seen and the threshold in force, a few dozen bytes whatever its age. State
lives in the query's checkpoint, so a restarted query goes on where the last batch ended, and ``read_books`` shows it as a table.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import constants as C
from ..config import DEFAULT

#: What each feedback row gives.
OUTPUT = "model string, seq bigint, accuracy double, training_size bigint, threshold double, threshold_before double"
_STATE = "recent array<boolean>, added bigint, threshold double, last_seq bigint"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def thresholds(sizes: np.ndarray) -> np.ndarray:
    """The threshold that belongs to each training size."""
    out = np.full(len(sizes), C.THRESHOLD_FLOOR)
    for below, value in reversed(C.THRESHOLD_STEPS):
        out[sizes < below] = value
    return out


class ModelBook(StatefulProcessor):
    """Rows (model, seq, correct) in, ``OUTPUT`` rows out, one each.

    A batch's rows are taken in order of seq; between batches the order of arrival counts. ``accuracy`` is over the last ``window``
    feedbacks up to the row. The threshold is looked at on every ``every``-th example, as a stored model does.
    """

    def __init__(self, window: int, seeds: int, cap: int, every: int, start: float):
        self.window, self.seeds, self.cap, self.every, self.start = window, seeds, cap, every, start

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.book = handle.getValueState("book", _STATE)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        """Takes over a book that another query left (rows of ``read_books``)."""
        row = initialState.iloc[0]
        self.book.update(([bool(x) for x in row["recent"]][-self.window:], int(row["added"]), float(row["threshold"]), int(row["last_seq"])))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values("seq", kind="stable")
        recent, added, threshold, last = self.book.get() if self.book.exists() else ([], 0, self.start, -1)
        flags = np.concatenate([np.array(recent, dtype=bool), batch["correct"].to_numpy(dtype=bool)])
        n, behind = len(batch), len(recent)
        hits = np.concatenate([[0], np.cumsum(flags)])
        upto = np.arange(behind + 1, behind + n + 1)
        since = np.maximum(upto - self.window, 0)
        count = added + np.arange(1, n + 1)
        looked = count // self.every * self.every
        # Before its first look in this batch a model keeps the threshold it came with.
        now = np.where(looked > added, thresholds(np.minimum(self.seeds + looked, self.cap)), threshold)
        before = np.concatenate([[threshold], now[:-1]])
        self.book.update((flags[-self.window:].tolist(), int(added + n), float(now[-1]), int(max(last, batch["seq"].iloc[-1]))))
        yield pd.DataFrame({
            "model": [key[0]] * n, "seq": batch["seq"].to_numpy(), "accuracy": (hits[upto] - hits[since]) / (upto - since),
            "training_size": np.minimum(self.seeds + count, self.cap), "threshold": now, "threshold_before": before,
        })


def stream_books(feedback: DataFrame, initial: DataFrame | None = None, window: int = DEFAULT.accuracy_window,
                 seeds: int = len(C.SEED_TRAINING), cap: int = DEFAULT.training_cap, every: int = 10,
                 start: float = DEFAULT.knn_threshold) -> DataFrame:
    """``OUTPUT`` rows of the stream feedback(model, seq, correct).

    ``initial`` holds rows of ``read_books`` for models that go on from another query's state. Start the query inside ``state_store``.
    """
    rows = feedback.select(F.col("model").cast("string").alias("model"), F.col("seq").cast("long").alias("seq"),
                           F.coalesce(F.col("correct"), F.lit(False)).alias("correct"))
    known = None if initial is None else initial.select("model", "recent", "added", "threshold", "last_seq").groupBy("model")
    return rows.groupBy("model").transformWithStateInPandas(
        ModelBook(window, seeds, cap, every, start), outputStructType=OUTPUT, outputMode="Append", timeMode="None", initialState=known)


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep state of this kind; the session's own setting is put back afterwards."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def write_books(feedback: DataFrame, path: str, checkpoint: str, initial: DataFrame | None = None, **trigger):
    """Start a query that appends ``OUTPUT`` rows below ``path`` as Parquet, each once."""
    spark = feedback.sparkSession
    with state_store(spark):
        return stream_books(feedback, initial).writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(
            **(trigger or {"processingTime": "5 seconds"})).start(path, format="parquet")


def read_books(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(model, added, threshold, accuracy, recent, last_seq): the state of every model after the last finished batch."""
    with state_store(spark):
        state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "book").load()
    book = state.select(F.col("key")[state.schema["key"].dataType.names[0]].alias("model"), "value.*")
    hits = F.aggregate("recent", F.lit(0), lambda n, x: n + x.cast("int"))
    return book.select("model", "added", "threshold", (hits / F.size("recent")).alias("accuracy"), "recent", "last_seq")
