"""Helpers that several corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.session import settle

#: Characters that separate words: space and the control characters tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
#: Maximal runs of anything else.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def body(text: str | Column = "text") -> Column:
    """The text, with null read as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def spaced_words(text: Column) -> Column:
    """Words between white space, in order."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def plain_words(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order; punctuation only separates."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def with_small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Whole texts travel to Python, so an Arrow batch holds few of them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def _stars_only(edges: DataFrame) -> bool:
    """Whether every node of distinct ``edges(a, b)``, b < a, is either a root or linked to one root only; both steps then change nothing."""
    ends = edges.select(F.explode(F.array(F.struct("a", F.lit(1).alias("up")), F.struct(F.col("b").alias("a"), F.lit(0).alias("up")))).alias("e"))
    nodes = ends.groupBy("e.a").agg(F.sum("e.up").alias("up"), F.min("e.up").alias("low"))
    return not nodes.where("up > 1 OR up = 1 AND low = 0").limit(1).count()


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; root is the smallest node it is linked to.

    Alternates two steps until every node but the roots has one neighbour, a root. *Large star*: every node hands its larger neighbours
    to the smallest node it knows. *Small star*: every node hands itself and its smaller neighbours to
    the smallest of them. The number of steps grows with the logarithm of the longest chain. Each step
    is a pre-aggregated minimum joined back, so that one hub with very many neighbours is split by
    AQE; each step's result is a table in the shared folder.
    """
    edges = settle(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(),
        f"{name}-links",
    )
    while edges.limit(1).count() and not _stars_only(edges):
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = (
            both.where("b > a").join(low, "a")
            .select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        )
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = (
            large.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("low").alias("b"))
            .where("a <> b").distinct()
        )
        edges = settle(small, f"{name}-stars")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
