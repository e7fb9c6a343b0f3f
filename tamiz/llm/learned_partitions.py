"""Nearest neighbours by learned partitions.

A neighbour graph of a bounded sample is cut into balanced parts with few edges between them. A small network learns, from the parts of
a vector's neighbours, in which parts a query's neighbours will lie. It then places every row of the table (most probable part) and
routes every query: to the most probable parts until their probability adds up to a mass. That mass is measured on sample
vectors the network was not fitted to, so that ``RECALL`` of their neighbours lie in the parts they are sent to; hard data makes
queries visit more parts instead of losing neighbours. In the parts all rows are ranked by the exact inner product.

Rows and queries of a part meet in blocks of bounded size. Of equal vectors only the smallest ids can be among a query's nearest, so
a vector that occurs very often is kept once, with those ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamiz.llm.common import table
from tamiz.session import settle

#: Neighbours to a query, and rows (about) to a part.
NEAREST, PART_ROWS = 20, 1024
#: Parts at most, and rows (about) of the sample that graph and network are fitted to.
MAX_PARTS, MAX_SAMPLE = 256, 8192
#: Share of the neighbours of held-out vectors that routing must reach.
RECALL = 0.95
#: Neighbours in the graph, hidden units, passes over the sample.
DEGREE, HIDDEN, EPOCHS = 16, 128, 30
#: Rows and queries that meet in one block.
BLOCK = 4096


# --- fitting, on the bounded sample --------------------------------------------------------

def nearest_in(rows: np.ndarray, k: int) -> np.ndarray:
    """The k rows of largest inner product with each row, itself excluded."""
    out = []
    for at in range(0, len(rows), 256):
        scores = rows[at:at + 256] @ rows.T
        scores[np.arange(len(scores)), at + np.arange(len(scores))] = -np.inf
        out.append(np.argpartition(-scores, k - 1, axis=1)[:, :k] if k < len(rows) else np.argsort(-scores, axis=1)[:, :k])
    return np.concatenate(out)


def halved(rows: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """Parts of equal size: cut again and again at the middle of the direction of most variance."""
    label = np.zeros(len(rows), np.int64)
    todo = [(np.arange(len(rows)), 0, parts)]
    while todo:
        members, first, count = todo.pop()
        if count == 1:
            label[members] = first
            continue
        spread = rows[members] - rows[members].mean(axis=0)
        axis = rng.standard_normal(rows.shape[1])
        for _ in range(12):
            axis = spread.T @ (spread @ axis)
            axis /= np.linalg.norm(axis) or 1.0
        order, left = np.argsort(spread @ axis, kind="stable"), count // 2
        cut = len(members) * left // count
        todo += [(members[order[:cut]], first, left), (members[order[cut:]], first + left, count - left)]
    return label


def balanced_parts(rows: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 8, slack: float = 1.1) -> np.ndarray:
    """A part for each row, none larger than ``slack`` times the mean; moves that cut fewer edges of the graph are made."""
    label = halved(rows, parts, np.random.default_rng(7))
    if parts == 1:
        return label
    sources, ends = np.repeat(np.arange(len(graph)), graph.shape[1]), graph.ravel()
    around: list[np.ndarray] = [np.empty(0, np.int64)] * len(rows)
    both = np.concatenate([np.stack([sources, ends], 1), np.stack([ends, sources], 1)])
    both = both[np.argsort(both[:, 0], kind="stable")]
    for block in np.split(both, np.flatnonzero(np.diff(both[:, 0])) + 1):
        around[block[0, 0]] = block[:, 1]
    most, sizes = int(np.ceil(slack * len(rows) / parts)), np.bincount(label, minlength=parts)
    edges = np.zeros((len(rows), parts), np.int32)
    np.add.at(edges, (both[:, 0], label[both[:, 1]]), 1)
    for _ in range(rounds):
        gain = edges.max(axis=1) - edges[np.arange(len(rows)), label]
        moved = 0
        for node in np.argsort(-gain, kind="stable"):
            if gain[node] <= 0:
                break
            old = label[node]
            to = int(np.where(sizes < most, edges[node], -1).argmax())
            if edges[node, to] > edges[node, old]:
                label[node], moved = to, moved + 1
                sizes[old], sizes[to] = sizes[old] - 1, sizes[to] + 1
                np.add.at(edges, (around[node], old), -1)
                np.add.at(edges, (around[node], to), 1)
        if not moved:
            break
    return label


@dataclass
class Router:
    """The network, and the probability mass that queries are routed by."""

    scale: float
    weights: list[np.ndarray]
    mass: float

    @property
    def parts(self) -> int:
        return self.weights[3].shape[0]

    def logits(self, vectors: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.maximum(vectors / self.scale @ w1 + b1, 0) @ w2 + b2

    def probabilities(self, vectors: np.ndarray) -> np.ndarray:
        z = self.logits(vectors)
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def place(self, vectors: np.ndarray) -> np.ndarray:
        return self.logits(vectors).argmax(axis=1)

    def route(self, vectors: np.ndarray, sizes: np.ndarray, least: int) -> list[np.ndarray]:
        """The parts each query visits: the most probable until ``mass`` is reached and they hold ``least`` rows."""
        p = self.probabilities(vectors)
        order = np.argsort(-p, axis=1, kind="stable")
        mass = np.cumsum(np.take_along_axis(p, order, 1), axis=1)
        enough = np.maximum((mass < self.mass).sum(axis=1) + 1, (np.cumsum(sizes[order], axis=1) < least).sum(axis=1) + 1)
        return [row[:n] for row, n in zip(order, np.minimum(enough, self.parts))]


def fit_network(rows: np.ndarray, targets: np.ndarray, scale: float, epochs: int) -> Router:
    """A network of one hidden layer that gives the share of each part, by stochastic gradient steps (Adam)."""
    rng = np.random.default_rng(11)
    x, parts = rows / scale, targets.shape[1]
    weights = [rng.standard_normal((x.shape[1], HIDDEN)) / np.sqrt(x.shape[1]), np.zeros(HIDDEN),
               rng.standard_normal((HIDDEN, parts)) / np.sqrt(HIDDEN), np.zeros(parts)]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for epoch in range(epochs):
        rate = 3e-3 * (1 - epoch / epochs) + 1e-4
        for batch in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
            hidden = np.maximum(x[batch] @ weights[0] + weights[1], 0)
            z = hidden @ weights[2] + weights[3]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            error = (p / p.sum(axis=1, keepdims=True) - targets[batch]) / len(batch)
            back = error @ weights[2].T * (hidden > 0)
            step += 1
            for k, gradient in enumerate((x[batch].T @ back, back.sum(0), hidden.T @ error, error.sum(0))):
                first[k] = 0.9 * first[k] + 0.1 * gradient
                second[k] = 0.999 * second[k] + 0.001 * gradient ** 2
                weights[k] = weights[k] - rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-9)
    return Router(scale, weights, 1.0)


def fit_router(rows: np.ndarray, parts: int, nearest: int = NEAREST, recall: float = RECALL) -> Router:
    """Graph, parts and network of a sample; the mass is measured on the tenth of it that the network does not see.

    A tenth of few rows says little, so less than 256 held-out rows leave the mass at 1: queries visit all parts.
    """
    scale = float(np.sqrt((rows ** 2).sum(axis=1).mean()))
    k = min(DEGREE, len(rows) - 1)
    if parts == 1 or k < 1:
        return fit_network(rows, np.ones((len(rows), 1)), scale, 0)
    graph = nearest_in(rows, k)
    label = balanced_parts(rows, graph, parts)
    targets = np.zeros((len(rows), parts))
    np.add.at(targets, (np.repeat(np.arange(len(rows)), k), label[graph].ravel()), 1.0 / (k + 1))
    targets[np.arange(len(rows)), label] += 1.0 / (k + 1)
    held = np.arange(len(rows)) % 10 == 0
    router = fit_network(rows[~held], targets[~held], scale, EPOCHS)
    if held.sum() >= 256:
        placed = router.place(rows)
        wanted = placed[nearest_in(rows, min(nearest, len(rows) - 1))[held]]
        p = router.probabilities(rows[held])
        order = np.argsort(-p, axis=1, kind="stable")
        sorted_p = np.take_along_axis(p, order, 1)
        before = np.empty_like(p)
        np.put_along_axis(before, order, np.cumsum(sorted_p, axis=1) - sorted_p, 1)
        router.mass = min(1.0, float(np.quantile(np.take_along_axis(before, wanted, 1), recall)) + 1e-9)
    return router


# --- tables --------------------------------------------------------------------------------

def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector as doubles) of the rows that take part.

    Out: null vec_id or vector, and vectors that are empty, zero or hold a null or non-finite component.
    """
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    return rows.where("vec_id IS NOT NULL AND vector IS NOT NULL").where(finite & F.exists("vector", lambda x: x != 0))


def common_length(rows: DataFrame) -> int:
    """The most frequent length of rows(vector), ties: the shorter; 0 for none."""
    length = rows.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), "length").first()
    return length["length"] if length else 0


def distinct_vectors(rows: DataFrame, nearest: int) -> tuple[DataFrame, DataFrame]:
    """(index rows (ids, vector), frequent vectors (mark, vector, ids)) of rows(vec_id, vector).

    Vectors with more than ``nearest`` + 1 rows are looked for by counting hashes; only their rows are gathered, and reduced to the
    smallest ids before the shuffle. All others stay where they are.
    """
    keep = nearest + 1
    marked = rows.withColumn("mark", F.xxhash64("vector"))
    often = settle(marked.groupBy("mark").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > keep).select("mark"), "ann-often")
    order = Window.partitionBy("mark", "vector").orderBy("vec_id")
    frequent = marked.join(often, "mark", "left_semi").withColumn("nth", F.dense_rank().over(order)).where(F.col("nth") <= keep)
    frequent = settle(frequent.groupBy("mark", "vector").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")), "ann-frequent")
    rare = marked.join(often, "mark", "left_anti").select(F.array("vec_id").alias("ids"), "vector")
    return rare.unionByName(frequent.select("ids", "vector")), frequent


def _matrix(batch: pa.RecordBatch | pa.Table, name: str = "vector") -> np.ndarray:
    column = batch[name]
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1) if batch.num_rows else np.empty((0, 0))


_MODEL = "parts int, scale double, mass double, " + ", ".join(f"w{k} array<double>" for k in range(4))


def fitted(index: DataFrame, part_rows: int, max_parts: int, max_sample: int, nearest: int, recall: float) -> Router | None:
    """The router for the index rows; None for an empty table. One task fits it to about ``max_sample`` rows, chosen by hash."""
    rows = index.count()
    share = min(1.0, max_sample / max(1, rows))
    mixed = F.xxhash64(F.lit(3), F.col("ids")[0])
    chosen = index.where(F.pmod(mixed, F.lit(1 << 20)) < int(share * (1 << 20)) + 1)

    def fit(key: tuple, sample: pa.Table) -> pa.Table:
        sample = sample.sort_by("id")
        parts = max(1, min(max_parts, -(-rows // part_rows), sample.num_rows // 16))
        router = fit_router(_matrix(sample), parts, nearest, recall)
        columns = {"parts": pa.array([parts], pa.int32()), "scale": pa.array([router.scale]), "mass": pa.array([router.mass])}
        columns |= {f"w{k}": pa.array([w.ravel()], pa.list_(pa.float64())) for k, w in enumerate(router.weights)}
        return pa.table(columns)

    sample = chosen.select(F.lit(0).alias("one"), F.col("ids")[0].alias("id"), "vector")
    model = sample.groupBy("one").applyInArrow(lambda key, part: fit(key, part.drop_columns(["one"])), _MODEL).first()
    if model is None and rows:  # no row hashed into the sample: one part holds all
        length = index.select(F.size("vector").alias("n")).first()["n"]
        return Router(1.0, [np.zeros((length, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)], 1.0)
    if model is None:
        return None
    w = [np.array(model[f"w{k}"]) for k in range(4)]
    return Router(model["scale"], [w[0].reshape(-1, len(w[1])), w[1], w[2].reshape(len(w[1]), -1), w[3]], model["mass"])


def ranked(vectors: np.ndarray, ids: list[list[int]], queries: np.ndarray, keep: int) -> list[list[tuple[float, int]]]:
    """To each query its ``keep`` best (score, id): largest inner product, then smallest id, an id once.

    A matrix product finds who comes near the last place; those products are then summed again term by term, in
    the order of the components, so that a score does not depend on the block it was computed in.
    """
    def best_of(near: np.ndarray, query: np.ndarray) -> list[tuple[float, int]]:
        exact, best, last = np.add.accumulate(vectors[near] * query, axis=1)[:, -1], {}, 0.0
        for place in np.argsort(-exact, kind="stable"):
            if len(best) >= keep and exact[place] < last:
                break
            last = float(exact[place])
            for number in ids[near[place]]:
                best.setdefault(number, last)
        return sorted(((s, i) for i, s in best.items()), key=lambda x: (-x[0], x[1]))[:keep]

    out, everything = [], np.arange(len(vectors))
    for at in range(0, len(queries), 512):
        block = queries[at:at + 512]
        scores = block @ vectors.T
        last = np.partition(scores, -keep, axis=1)[:, -keep] if keep < len(vectors) else np.full(len(block), -np.inf)
        margin = 1e-9 * np.linalg.norm(block, axis=1) * np.abs(vectors).max() * np.sqrt(vectors.shape[1])
        for row, query, bound in zip(scores, block, last - margin):
            found = best_of(np.flatnonzero(row >= bound), query)
            # Repeated ids can leave too few among the nearest rows.
            out.append(found if len(found) == keep else best_of(everything, query))
    return out


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, nearest: int = NEAREST, part_rows: int = PART_ROWS, max_parts: int = MAX_PARTS,
                       max_sample: int = MAX_SAMPLE, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): to each of ``queries``(vec_id, embedding) the nearest of ``vectors``(vec_id, embedding) found.

    Nearness is the inner product in double precision, ties go to the smaller vec_id, and rows of a query's own vec_id are no
    candidates. ``usable`` says which rows take part, and of those only vectors of the most common length. A repeated vec_id is ranked once, by its best row. Every row is in the index;
    a query that finds fewer than ``nearest`` visits more parts, so it gets all candidates where there are fewer. An empty table gives
    no rows; other columns are ignored. Same input, same result.
    """
    keep = nearest + 1  # a query's own row is among its best
    rows = settle(usable(vectors), "ann-rows")
    alike = F.size("vector") == F.lit(common_length(rows))
    index, frequent = distinct_vectors(rows.where(alike), nearest)
    index = settle(index, "ann-distinct")
    asked = usable(queries).where(alike).withColumn("mark", F.xxhash64("vector"))
    known = frequent.select(F.col("mark").alias("same_mark"), F.col("vector").alias("same"), F.col("ids")[0].alias("first"))
    asked = asked.join(known, (F.col("mark") == F.col("same_mark")) & (F.col("vector") == F.col("same")), "left")
    # Queries with one and the same frequent vector are answered once.
    asked = settle(asked.select("vec_id", "vector", F.coalesce("first", "vec_id").alias("query"), F.col("first").isNotNull().alias("shared")), "ann-queries")
    router = fitted(index, part_rows, max_parts, max_sample, nearest, recall)
    if router is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.append_column("part", pa.array(router.place(_matrix(batch)), pa.int32()))

    placed = settle(index.mapInArrow(place, "ids array<long>, vector array<double>, part int"), "ann-index")
    by_part = {r["part"]: r for r in placed.groupBy("part").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.size("ids")).alias("ids")).collect()}  # a row a part
    sizes = np.array([by_part[p]["ids"] if p in by_part else 0 for p in range(router.parts)])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                parts = router.route(_matrix(batch), sizes, keep)
                yield batch.append_column("parts", pa.array([p.tolist() for p in parts], pa.list_(pa.int32())))

    alone = asked.where("NOT shared").groupBy("query").agg(F.first("vector").alias("vector"))
    once = alone.unionByName(frequent.select(F.col("ids")[0].alias("query"), "vector").join(asked.where("shared").select("query").distinct(), "query", "left_semi"))
    routed = settle(once.mapInArrow(route, "query long, vector array<double>, parts array<int>"), "ann-routes")
    visits = routed.select("query", "vector", F.explode("parts").alias("part"))
    asked_of = {r["part"]: r["n"] for r in routed.select(F.explode("parts").alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}

    def blocks(counts: dict[int, int]) -> Column:
        return F.element_at(F.array(*[F.lit(max(1, -(-counts.get(p, 0) // BLOCK))) for p in range(router.parts)]), F.col("part") + 1)

    def one_of(column: Column, counts: dict[int, int]) -> Column:
        return F.pmod(F.xxhash64(F.lit(5), column), blocks(counts)).cast("int")

    def each_of(counts: dict[int, int]) -> Column:
        return F.explode(F.sequence(F.lit(0), blocks(counts) - 1))

    held = {p: r["rows"] for p, r in by_part.items()}
    left = placed.withColumn("block", one_of(F.col("ids")[0], held)).withColumn("turn", each_of(asked_of))
    right = visits.withColumn("turn", one_of(F.col("query"), asked_of)).withColumn("block", each_of(held))

    def compare(key: tuple, some: pa.Table, wanted: pa.Table) -> pa.Table:
        found = [] if not some.num_rows or not wanted.num_rows else ranked(_matrix(some), some["ids"].to_pylist(), _matrix(wanted), keep)
        numbers = wanted["query"].to_pylist() if found else []
        return pa.table({"query": pa.array(numbers, pa.int64()),
                         "scores": pa.array([[s for s, _ in f] for f in found], pa.list_(pa.float64())),
                         "ids": pa.array([[i for _, i in f] for f in found], pa.list_(pa.int64()))})

    keys = ("part", "block", "turn")
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "query long, scores array<double>, ids array<long>")

    def merge(key: tuple, lists: pa.Table) -> pa.Table:
        best: dict[int, float] = {}
        for scores, ids in zip(lists["scores"].to_pylist(), lists["ids"].to_pylist()):
            for score, number in zip(scores, ids):
                best[number] = max(score, best.get(number, score))
        first = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:keep]
        return pa.table({"query": pa.array([key[0].as_py()], pa.int64()),
                         "best": pa.array([[{"id": i, "score": s} for i, s in first]], pa.list_(pa.struct([("id", pa.int64()), ("score", pa.float64())])))})

    merged = met.groupBy("query").applyInArrow(merge, "query long, best array<struct<id:long,score:double>>")
    answers = asked.select(F.col("vec_id").alias("query_id"), "query").distinct().join(merged, "query")
    others = F.slice(F.filter("best", lambda x: x["id"] != F.col("query_id")), 1, nearest)
    return answers.select("query_id", F.posexplode(others).alias("at", "one")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("one.id").alias("vec_id"), F.col("one.score").alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose vec_id 20 divides, against all others."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, vectors.where("vec_id % 20 = 0"))


#: Exact, so the same as long as the table fits one part (PART_ROWS) or queries visit all parts.
SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM pairs)
SELECT query_id, CAST(place AS INT) AS rank, vec_id, score FROM placed WHERE place <= 20
"""
