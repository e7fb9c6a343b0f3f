"""A training corpus from raw documents: five stages, each one of the corpus operators.

``run`` writes every stage's result as Parquet to the shared folder and reads it again for the next. The last one is the corpus itself,
texts included; write it elsewhere before ``tamiz.session.release``.

In every stage texts without words, null ones included, are texts like others (never toxic, equal to each other, free of leaks, taking no
words), a null doc_id is an id like others, an empty table gives an empty table, and further columns, whatever their names, go along.
Repeated rows are one near-duplicate class, of which one row stays where the text has words enough to compare.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.llm import disclosure, order_minhash, source_mixing, spaced_seeds, toxicity_chain
from tamiz.llm.common import table
from tamiz.session import configure, settle


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier chain, fitted to the labelled ones among them, does not find toxic."""
    return toxicity_chain.without_toxic(docs, table(configure(spark), sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one with the least doc_id."""
    return order_minhash.deduplicated(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with the benchmark."""
    return spaced_seeds.decontaminated(docs, table(configure(spark), sf_dir, "benchmark"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and the terms that give it away replaced."""
    return disclosure.sanitised(docs)


MIXED = ("size", "source_size", "target", "copies", "taken")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus: every document with its text and all its columns, and how often the mix takes it.

    Adds size (words), source_size, target, copies and taken (words, all copies). Rows equal in doc_id, source and text are one document
    that takes the copies of all of them. Columns of these names that the documents brought along are replaced.
    """
    parts = [F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in ("doc_id", "source", "text")]
    keyed = docs.withColumn("text_key", F.xxhash64(*parts))
    rates = source_mixing.mix_sources(keyed.select(F.col("text_key").alias("doc_id"), "text", "source"))
    rates = rates.groupBy(F.col("doc_id").alias("text_key")).agg(
        *[F.first(c).alias(c) for c in MIXED[:3]], *[F.sum(c).alias(c) for c in MIXED[3:]])
    rows = keyed.drop(*MIXED).dropDuplicates(["text_key", "doc_id", "source", "text"])
    return rows.join(rates, "text_key").drop("text_key")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("personal_data", sanitise),
    ("mixing", mix),
]
#: Trained models and alignments are beyond SQL; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(configure(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"corpus-{name}")
    return docs
