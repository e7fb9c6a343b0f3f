"""Exact k-nearest-neighbour classification.

Two exact physical forms, chosen by the size of the training table:

* up to ``BROADCAST_ROWS`` rows (the live model is capped at 1000) the training matrix travels
  with a vectorised UDF and classification is a map-only projection over the queries;
* above that, the index of ``metric_index``, which compares a query only with the cells that can hold a
  neighbour. ``knn_neighbours`` is the plain block join: queries and training rows are hashed into groups of
  bounded size, each pair of groups is compared block by block and yields only its k best per query, and a second step merges those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .metric_index import GROUP_ROWS, few_equals, index_neighbours, matrix, nearest, turns_of

BROADCAST_ROWS = 20_000
BLOCK_ROWS = 20_000
VOTE_TYPE = "struct<label:int,confidence:double,proba:array<double>>"


def _vote_udf(vectors: list, labels: list, k: int, weights: str, n_classes: int):
    @F.arrow_udf(VOTE_TYPE)
    def vote(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        train = np.ascontiguousarray(np.asarray(vectors, dtype="float64"))
        classes = np.asarray(labels)
        near = min(k, len(classes))
        for batch in batches:
            out_label = np.ones(len(batch), dtype="int32")
            out_proba = np.zeros((len(batch), n_classes))
            if near and len(batch):
                queries = batch.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
                picked, best = nearest(queries, train, near, nan_first=True)
                if weights == "distance":
                    zero = best == 0.0
                    has_zero = zero.any(axis=1)[:, None]
                    w = np.where(has_zero, zero.astype("float64"),
                                 1.0 / np.where(zero, 1.0, best))
                else:
                    w = np.ones_like(best)
                for c in range(n_classes):
                    out_proba[:, c] = np.where(classes[picked] == c, w, 0.0).sum(axis=1)
                out_proba /= out_proba.sum(axis=1)[:, None]
                out_label = out_proba.argmax(axis=1).astype("int32")
            confidence = (out_proba[np.arange(len(batch)), out_label]
                          if near else np.zeros(len(batch)))
            ends = pa.array(np.arange(len(batch) + 1, dtype="int32") * n_classes)
            yield pa.StructArray.from_arrays(
                [pa.array(out_label), pa.array(confidence), pa.ListArray.from_arrays(ends, pa.array(out_proba.ravel()))],
                ["label", "confidence", "proba"])

    # As a function that may answer differently it is asked once a row; a condition on the vote would otherwise be moved below
    # it together with a copy of it, and every task would hold two Python workers.
    return vote.asNondeterministic()


def knn_vote(vector: Column, training: DataFrame, k: int = 5, weights: str = "distance",
             n_classes: int = 3) -> Column:
    """STRUCT<label, confidence, proba> of a vector against a small training table.

    Raises when the table has more than ``BROADCAST_ROWS`` rows; ``with_vote`` takes any size.
    An empty table votes class 1 with confidence 0.
    """
    rows = training.select("seq", "vector", "label").limit(BROADCAST_ROWS + 1).collect()
    if len(rows) > BROADCAST_ROWS:
        raise ValueError("training table too large to broadcast; use with_vote")
    rows.sort(key=lambda r: r["seq"])
    vote = _vote_udf([list(r["vector"]) for r in rows], [int(r["label"]) for r in rows],
                     k, weights, n_classes)
    if not rows:
        return vote(vector)
    width = len(rows[0]["vector"])
    # Naming the vector twice also keeps its expression in a projection of its own, below the UDF.
    return vote(F.when(F.size(vector) == width, vector).otherwise(
        F.raise_error(F.lit(f"vectors must have {width} values")).cast("array<double>")))


def _checked(vector: Column, width: int) -> Column:
    return F.when(F.size(vector) == width, vector.cast("array<double>")).otherwise(
        F.raise_error(F.lit(f"vectors must have {width} values")).cast("array<double>"))


def knn_neighbours(queries: DataFrame, training: DataFrame, k: int = 5, id_col: str = "id",
                   block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, seq, label, dist, rank): the k nearest training rows of every query, exactly.

    Groups hold ``block_rows`` rows at least where there are so many; no more are made than memory or idle cores ask for, because rows
    are copied for every pair of groups.
    """
    training = settle(few_equals(training, k), "knn-training")
    n_queries, n_training = queries.count(), training.count()
    t_blocks = max(1, -(-n_training // max(block_rows, GROUP_ROWS)))
    q_blocks = turns_of(n_queries, t_blocks, block_rows, queries.sparkSession.sparkContext.defaultParallelism)
    q = queries.select(F.col(id_col).alias("id"), F.col("vector").cast("array<double>")).select(
        F.pmod(F.xxhash64("id"), F.lit(q_blocks)).cast("int").alias("qb"),
        F.explode(F.sequence(F.lit(0), F.lit(t_blocks - 1))).alias("tb"), "id", "vector")
    t = training.select("seq", F.col("vector").cast("array<double>"), "label").select(
        F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"),
        F.pmod(F.xxhash64("seq"), F.lit(t_blocks)).cast("int").alias("tb"),
        "seq", "vector", F.col("label").cast("int").alias("label"))
    id_type, seq_type = (df.schema[c].dataType.simpleString() for df, c in ((q, "id"), (t, "seq")))

    def best_of_blocks(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"id": left["id"].slice(0, 0), "seq": right["seq"].slice(0, 0), "label": pa.array([], pa.int32()), "dist": pa.array([], pa.float64())})
        right = right.sort_by("seq")
        found, dist = nearest(matrix(left), matrix(right), k, nan_first=True)
        who, place = np.nonzero(found >= 0)
        picked = right.take(pa.array(found[who, place]))
        return pa.table({"id": left["id"].take(pa.array(who)), "seq": picked["seq"], "label": picked["label"], "dist": pa.array(dist[who, place])})

    local = q.groupBy("qb", "tb").cogroup(t.groupBy("qb", "tb")).applyInArrow(
        best_of_blocks, f"id {id_type}, seq {seq_type}, label int, dist double")
    order = Window.partitionBy("id").orderBy("dist", "seq")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def vote_neighbours(neighbours: DataFrame, weights: str = "distance",
                    n_classes: int = 3) -> DataFrame:
    """(id, label, confidence, proba) from ``knn_neighbours`` rows."""
    per_id = Window.partitionBy("id")
    if weights == "distance":
        closest = F.min("dist").over(per_id)
        weight = F.when(closest == 0, (F.col("dist") == 0).cast("double")).otherwise(
            1.0 / F.col("dist"))
    else:
        weight = F.lit(1.0)
    weighted = neighbours.withColumn("w", weight)
    shares = [F.sum(F.when(F.col("label") == c, F.col("w")).otherwise(0.0))
              for c in range(n_classes)]
    votes = weighted.groupBy("id").agg(
        F.array(*[s / F.sum("w") for s in shares]).alias("proba"))
    top = F.array_max("proba")
    return votes.select(
        "id", (F.array_position("proba", top) - 1).cast("int").alias("label"),
        top.alias("confidence"), "proba")


def with_vote(rows: DataFrame, name: str, training: DataFrame, k: int = 5,
              weights: str = "distance", n_classes: int = 3) -> DataFrame:
    """``rows`` plus the vote on their ``vector`` as column ``name``, for a training table of any size.

    Small tables travel with a vectorised function. For larger ones the distinct vectors are voted on
    through the index of cells (``metric_index``) and joined back; the answers are the same.
    """
    if training.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.withColumn(name, knn_vote(F.col("vector"), training, k, weights, n_classes))
    width = len(training.select("vector").first()["vector"])
    vectors = rows.select(_checked(F.col("vector"), width).alias("vector")).distinct().withColumn("id", F.monotonically_increasing_id())
    vectors = settle(vectors, "knn-asked")
    votes = vote_neighbours(index_neighbours(vectors, training, k), weights, n_classes).join(vectors, "id")
    votes = votes.select(F.col("vector").alias("_voted"), F.struct("label", "confidence", "proba").alias(name))
    return rows.join(votes, F.col("vector").cast("array<double>") == F.col("_voted")).drop("_voted")


def knn_classify(queries: DataFrame, training: DataFrame, k: int = 5,
                 weights: str = "distance", n_classes: int = 3, id_col: str = "id") -> DataFrame:
    """(id, label, confidence, proba) for every query row with a ``vector``."""
    rows = queries.select(F.col(id_col).alias("id"), "vector")
    return with_vote(rows, "v", training, k, weights, n_classes).select("id", "v.*")
