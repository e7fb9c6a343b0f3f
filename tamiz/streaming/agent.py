"""The continuous agent: report files in, decisions, outboxes and a growing model out.

Each micro-batch runs the batch triage plan with the allow-list and training log as they
are on disk at that moment, so edits to the list and what earlier batches learned take effect
without a restart.  Every output is written under its batch id and replaced on a retry, which
makes a re-run of a batch harmless.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULT, TriageConfig
from ..constants import SEED_TRAINING
from ..functions.features import feedback_vector
from ..operators import training as TR
from ..operators.parsing import extract_signals, parse_reports
from ..plans.triage import triage_signals
from ..sources import readers, sinks
from ..sources.delivery import deliver, messages


@dataclass
class AgentPaths:
    """Folders of the agent; it writes below ``root``.

    Tables: signals, analyses, cases, manual_review, quarantine, feedback, training (rows learned
    per batch) and model (the live rows after each batch). Messages are filed in ``outbox``, read by
    ``delivery.delivered``.
    """

    ingress: str
    root: str
    whitelist: str
    archive: str | None = None

    def table(self, name: str) -> str:
        return f"{self.root}/{name}"


def _put(df: DataFrame, path: str, batch_id: int) -> None:
    # Overwriting one batch's own folder keeps retries idempotent.
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def _stored(df: DataFrame, paths: AgentPaths, name: str, batch_id: int) -> DataFrame:
    _put(df, paths.table(name), batch_id)
    return df.sparkSession.read.schema(df.schema).parquet(
        f"{paths.table(name)}/batch={batch_id}")


def live_training(spark: SparkSession, paths: AgentPaths, batch_id: int) -> DataFrame:
    """The model as the batch before left it: one small folder, however long the agent has run."""
    if batch_id == 0:
        return TR.seed_training(spark)
    return spark.read.schema(TR.TRAINING_SCHEMA).parquet(
        f"{paths.table('model')}/batch={batch_id - 1}")


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def newest_model(spark: SparkSession, paths: AgentPaths) -> int | None:
    """Number of the last batch that left a model; None before the first."""
    if not _exists(spark, paths.table("model")):
        return None
    folder = spark._jvm.org.apache.hadoop.fs.Path(paths.table("model"))
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    batches = [int(f.getPath().getName().removeprefix("batch=")) for f in found if f.getPath().getName().startswith("batch=")]
    return max(batches, default=None)


def _earlier_empty(spark: SparkSession, paths: AgentPaths, batch_id: int) -> DataFrame | None:
    """Paths of the empty files that batches before this one have handled."""
    if not batch_id or not _exists(spark, paths.table("empty")):
        return None
    stored = spark.read.schema("path string, batch bigint").parquet(paths.table("empty"))
    return stored.where(F.col("batch") < batch_id).select("path").distinct()


def learned_examples(gated_rows: DataFrame) -> DataFrame:
    """(order, vector, classification) of the rows that may enter the model."""
    order = F.struct(F.col("arrived_at").alias("at"), F.col("path"))
    return gated_rows.where("quality.action IN ('ADD', 'MANUAL_REVIEW')").select(
        order.alias("order"),
        feedback_vector(F.col("indicators"), F.col("microsoft_url_check"),
                        F.size("urls_found")).alias("vector"),
        "classification")


def process_batch(batch: DataFrame, batch_id: int, paths: AgentPaths,
                  cfg: TriageConfig = DEFAULT, ip_reputation: DataFrame | None = None,
                  responses: DataFrame | None = None, reloaded: int | None = None, list_empty: bool = True) -> None:
    """Triage one micro-batch and write all its tables; ``list_empty``: the batch lacks the files without a byte."""
    spark = batch.sparkSession
    if list_empty:
        # Spark's file source skips files without a byte; the folder is asked for those not yet seen.
        empty = readers.empty_reports(spark, paths.ingress)
        earlier = _earlier_empty(spark, paths, batch_id)
        empty = _stored(empty if earlier is None else empty.join(earlier, "path", "left_anti"), paths, "empty", batch_id)
        batch = batch.unionByName(empty.join(batch.select("path"), "path", "left_anti").select(*batch.columns))
    whitelist = readers.read_whitelist(spark, paths.whitelist)
    training = live_training(spark, paths, batch_id)
    last, seeds = training.agg(F.max("seq")).first()[0], len(SEED_TRAINING)
    threshold = TR.threshold_after(last + 1 - seeds, seeds, cfg.knn_threshold, cfg.training_cap, reloaded=reloaded)
    # Both tables are written once and read back: the mail is parsed and decided a single time.
    signals = _stored(extract_signals(parse_reports(batch), cfg), paths, "signals", batch_id)
    if not list_empty and not signals.limit(1).count():
        # No file came; the next batch finds the model where it looks for it.
        _put(training, paths.table("model"), batch_id)
        return
    decided = triage_signals(signals, whitelist, training, ip_reputation, responses, cfg,
                             threshold)
    done = _stored(decided, paths, "analyses", batch_id)
    gate = sinks.gated(done, cfg)
    _put(sinks.cases_of(done), paths.table("cases"), batch_id)
    _put(sinks.manual_review(done, cfg), paths.table("manual_review"), batch_id)
    _put(sinks.quarantined(gate), paths.table("quarantine"), batch_id)
    known = done.where("source <> 'unreported'")
    deliver(messages(known, cfg), paths.table("outbox"), batch_id)
    wrong = known.where("source = 'llm' AND knn.classification <> classification").select(
        "report_id", F.col("knn.classification").alias("predicted"),
        F.col("classification").alias("actual"), F.lit(False).alias("correct"))
    _put(wrong, paths.table("feedback"), batch_id)
    # The log gets every example; only the live model forgets.
    added = _stored(TR.number_examples(training, learned_examples(gate)), paths, "training", batch_id)
    _put(TR.keep_last(training.unionByName(added), cfg.training_cap), paths.table("model"), batch_id)


def start_agent(spark: SparkSession, paths: AgentPaths, cfg: TriageConfig = DEFAULT,
                checkpoint: str | None = None, max_files: int | None = None,
                available_now: bool = False, ip_reputation: DataFrame | None = None,
                responses: DataFrame | None = None) -> StreamingQuery:
    """Start the agent.  ``max_files=1`` learns after every mail; larger batches run faster."""
    checkpoint = checkpoint or f"{paths.root}/_checkpoint"
    newest = newest_model(spark, paths)
    if newest is not None and not _exists(spark, f"{checkpoint}/commits"):
        # Batch numbers would begin anew and replace what is stored.
        raise ValueError(f"{paths.root} holds the tables of another checkpoint; give that one, or another root")
    reloaded = None
    if newest is not None:
        reloaded = live_training(spark, paths, newest + 1).agg(F.max("seq")).first()[0] + 1 - len(SEED_TRAINING)
    stream = readers.stream_reports(spark, paths.ingress, max_files, paths.archive)
    list_empty = readers.lists_folder(paths.ingress, max_files, paths.archive)
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, i: process_batch(batch, i, paths, cfg, ip_reputation, responses, reloaded, list_empty))
    trigger = {"availableNow": True} if available_now else {"processingTime": "5 seconds"}
    return writer.trigger(**trigger).start()


