"""The training table and the model's bookkeeping.

A model is its append-only training log ``(model, seq, vector, label)``; the live table is the
newest rows of it.  ``model`` may be left out for a single model.  Retention uses windows with a row
limit, which Spark applies before the shuffle; numberings split a model's rows into ranges.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..config import DEFAULT, TriageConfig
from ..functions.scoring import knn_threshold
from ..session import settle

TRAINING_SCHEMA = "seq bigint, vector array<double>, label int"
_PARTS = 64


def seed_training(spark: SparkSession) -> DataFrame:
    """The rows a fresh model starts from; given as a table, they are read without a Python worker."""
    vectors, labels = zip(*C.SEED_TRAINING)
    rows = pa.table({"seq": pa.array(range(len(labels)), pa.int64()),
                     "vector": pa.array([[float(x) for x in v] for v in vectors], pa.list_(pa.float64())),
                     "label": pa.array(labels, pa.int32())})
    return spark.createDataFrame(rows, TRAINING_SCHEMA)


def _model(by: str | None):
    return [by] if by else []


def keep_last(log: DataFrame, n: int, order: str = "seq", by: str | None = None) -> DataFrame:
    """The newest ``n`` rows (per model).

    Reduced per hash of the order first, so that the last step sees ``n`` rows of each hash and not of each input
    partition, however many there are.
    """
    keys = _model(by)
    part = F.pmod(F.hash(order), F.lit(_PARTS))
    within = Window.partitionBy(*keys, "_part").orderBy(F.desc(order))
    newest = Window.partitionBy(*keys).orderBy(F.desc(order))
    few = log.withColumn("_part", part).withColumn("_rn", F.row_number().over(within)).where(F.col("_rn") <= n)
    return few.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= n).drop("_rn", "_part")


def known_examples(examples: DataFrame) -> DataFrame:
    """(order, vector, label) of examples ``(order, vector, classification)`` with a known label.

    A vector of the wrong length is refused.
    """
    width = len(C.FEATURE_NAMES)
    label = F.array_position(F.array(*[F.lit(x) for x in C.LABELS]), F.col("classification"))
    return examples.where(F.col("classification").isin(*C.LABELS)).select(
        "order",
        F.when(F.size("vector") == width, F.col("vector").cast("array<double>")).otherwise(
            F.raise_error(F.lit(f"vectors must have {width} values"))).alias("vector"),
        (label - 1).cast("int").alias("label"))


def number_examples(training: DataFrame, examples: DataFrame) -> DataFrame:
    """(seq, vector, label): *every* known example, numbered in arrival order after the training rows.

    Examples are dealt out by ranges of their order; a range's rows are numbered in one task and
    shifted by the counts of the ranges before it.
    """
    last = training.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("m")).first()["m"]
    ranged = settle(known_examples(examples).repartitionByRange("order").withColumn("_range", F.spark_partition_id()), "examples")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).select(
        "_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    within = Window.partitionBy("_range").orderBy("order")
    return ranged.withColumn("_rn", F.row_number().over(within)).join(shifts, "_range").select(
        (F.lit(last) + F.col("shift") + F.col("_rn")).cast("bigint").alias("seq"), "vector", "label")


def append_training(training: DataFrame, examples: DataFrame,
                    cap: int = DEFAULT.training_cap) -> DataFrame:
    """The live rows after appending labelled examples ``(order, vector, classification)``.

    Every example is numbered; then the newest ``cap`` rows are kept.
    """
    merged = training.select("seq", "vector", "label").unionByName(number_examples(training, examples))
    return keep_last(merged, cap)


def training_size_log(log: DataFrame, by: str | None = None, seeds: int = 0,
                      cap: int = DEFAULT.training_cap, bucket_rows: int = 1_000_000) -> DataFrame:
    """(model, seq, added, training_size) after each append.

    A busy model is not numbered in one task: its rows are split into ranges of ``seq``, numbered
    there and shifted by the counts of the ranges before.
    """
    keys = _model(by)
    ranged = log.select(*keys, "seq").withColumn("_b", F.floor(F.col("seq") / bucket_rows))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shifts = ranged.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n")).select(
        *keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    within = Window.partitionBy(*keys, "_b").orderBy("seq")
    added = (F.row_number().over(within) + F.col("_shift")).cast("bigint")
    return ranged.join(shifts, [*keys, "_b"]).withColumn("added", added).select(
        *keys, "seq", "added", F.least(F.col("added") + seeds, F.lit(cap)).cast("bigint").alias("training_size"))


def threshold_log(log: DataFrame, by: str | None = None, seeds: int = 0,
                  start: float = DEFAULT.knn_threshold, every: int = 10,
                  cap: int = DEFAULT.training_cap, bucket_rows: int = 1_000_000) -> DataFrame:
    """(model, seq, training_size, from, to): every change of the confidence threshold.

    The threshold is looked at on every ``every``-th append. It only falls as the table grows, so each of its
    values begins once: at the first look that gives it. One row per model and value is compared.
    """
    keys = _model(by)
    sizes = training_size_log(log, by, seeds, cap, bucket_rows)
    checked = sizes.where(F.col("added") % every == 0).withColumn("to", knn_threshold(F.col("training_size")))
    first = checked.groupBy(*keys, "to").agg(F.min(F.struct("added", "seq", "training_size")).alias("_at"))
    arrival = Window.partitionBy(*keys).orderBy("_at.added")
    previous = F.coalesce(F.lag("to").over(arrival), F.lit(start))
    return first.withColumn("from", previous).where(F.col("from") != F.col("to")).select(
        *keys, "_at.seq", "_at.training_size", "from", "to")


def threshold_after(appended: int, seeds: int, start: float = DEFAULT.knn_threshold,
                    cap: int = DEFAULT.training_cap, every: int = 10, reloaded: int | None = None) -> float:
    """The threshold in force once ``appended`` rows have joined the ``seeds``.

    A fresh model has ``start`` until the first look. Reloading a model, here after ``reloaded`` appends, is a look too.
    """
    looked = appended // every * every
    if reloaded is not None and looked <= reloaded:
        looked = reloaded
    elif appended < every:
        return start
    size = min(seeds + looked, cap)
    return next((t for n, t in C.THRESHOLD_STEPS if size < n), C.THRESHOLD_FLOOR)


def confidence_threshold(training: DataFrame, by: str | None = None) -> DataFrame:
    """(model, training_size, threshold) for a reloaded model."""
    return training.groupBy(*_model(by)).agg(
        F.count(F.lit(1)).alias("training_size")
    ).withColumn("threshold", knn_threshold(F.col("training_size")))


def training_summary(log: DataFrame, seeds: int, feedback: DataFrame | None = None,
                     cfg: TriageConfig = DEFAULT) -> DataFrame:
    """One row: live size, counts by label over everything ever added, threshold, feedback.

    ``seeds`` is the number of rows the model started from; they are not counted as training.
    """
    counted = log.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col("label") == i).alias(n) for i, n in enumerate(C.LABELS)])
    live = F.least(F.col("rows"), F.lit(cfg.training_cap))
    feedback_count = 0 if feedback is None else feedback.limit(cfg.feedback_cap).count()
    return counted.select(
        live.alias("total_examples"), *C.LABELS,
        (F.col("rows") - seeds).alias("training_count"),
        knn_threshold(live).alias("current_threshold"),
        F.lit(cfg.knn_threshold).alias("base_threshold"),
        F.lit(feedback_count).alias("feedback_count"))


# --- feedback ------------------------------------------------------------------------------

def label_feedback(predictions: DataFrame, actual: DataFrame) -> DataFrame:
    """(report_id, predicted, actual, correct) where the final label contradicts the vote."""
    joined = predictions.select("report_id", F.col("classification").alias("predicted")).join(
        actual.select("report_id", F.col("classification").alias("actual")), "report_id")
    return joined.where("predicted <> actual").withColumn("correct", F.lit(False))


def record_feedback(history: DataFrame, entries: DataFrame,
                    cap: int = DEFAULT.feedback_cap) -> DataFrame:
    """Feedback rows ``(seq, predicted, actual, correct)`` after appending, newest ``cap``."""
    added = entries.withColumn("correct", F.col("predicted") == F.col("actual"))
    return keep_last(history.unionByName(added, allowMissingColumns=True), cap)


def rolling_accuracy(feedback: DataFrame, by: str | None = None,
                     window: int = DEFAULT.accuracy_window,
                     bucket_rows: int = 1_000_000) -> DataFrame:
    """Feedback rows plus ``accuracy`` over the last ``window`` entries up to each.

    A busy model is not sorted in one task: its rows are split into ranges of ``seq``, and each
    range is given the few rows that precede it, found from the ranges' own tails.
    """
    keys = _model(by)
    behind = window - 1
    ranged = feedback.withColumn("_b", F.floor(F.col("seq") / bucket_rows))
    newest = Window.partitionBy(*keys, "_b").orderBy(F.desc("seq"))
    tails = ranged.select(*keys, "_b", "seq", "correct").withColumn(
        "_rn", F.row_number().over(newest)).where(F.col("_rn") <= behind)
    packed = tails.groupBy(*keys, "_b").agg(
        F.array_sort(F.collect_list(F.struct("seq", "correct"))).alias("_tail"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(-behind, -1)
    carried = packed.withColumn("_all", F.flatten(F.collect_list("_tail").over(before))).select(
        *keys, "_b", F.inline(F.slice(
            F.col("_all"), F.greatest(F.size("_all") - behind + 1, F.lit(1)), F.lit(behind)))
    ).withColumn("_context", F.lit(True))
    merged = ranged.withColumn("_context", F.lit(False)).unionByName(
        carried, allowMissingColumns=True)
    last = Window.partitionBy(*keys, "_b").orderBy("seq").rowsBetween(-behind, 0)
    return merged.withColumn(
        "accuracy", F.avg(F.col("correct").cast("double")).over(last)
    ).where(~F.col("_context")).drop("_context", "_b")


def recent_accuracy(feedback: DataFrame, window: int = DEFAULT.accuracy_window) -> DataFrame:
    """One row: accuracy over the newest ``window`` entries."""
    return keep_last(feedback, window).agg(
        F.avg(F.col("correct").cast("double")).alias("accuracy"),
        F.count(F.lit(1)).alias("entries"))
