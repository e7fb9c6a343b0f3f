"""Exact nearest neighbours by an index of cells.

A bounded number of training rows are pivots, and every row belongs to the cell of its nearest pivot and keeps its distance to it. For a
query q, a cell of pivot p whose rows lie between ``near`` and ``far`` from p holds nothing closer than any of

* d(q, p) - far and near - d(q, p) (triangle inequality), and
* (d(q, p) - d(q, p')) / 2 for the query's nearest pivot p' (its rows are closer to p than to p').

A query is first compared with the cells next to it, until they hold k rows; the k-th distance found then rules out cells. It
visits the cells that are left, and what remains is compared exactly, so the answer is that of a full product. Data without structure
rules out little and costs that product, which is why neighbouring cells travel together: a query is sent once to a group of cells.

Comparing is a matrix product first. Its rounding is bounded, and the rows it cannot rule out are measured component by component.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle

#: Pivots at most, and the fewest rows or queries that a group is divided for.
MAX_PIVOTS, BLOCK_ROWS = 512, 8192
#: Rows, and queries, of a task's group at most, and those compared at a time.
GROUP_ROWS, AT_ONCE = 32_768, (2048, 512)
#: Slack for rounding where bounds are compared.
_SLACK = 1e-9


def distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Euclidean distances, summed component by component so that they do not depend on the block."""
    out = np.zeros((len(left), len(right)))
    for at in range(0, len(left), 256):
        part, sums = left[at:at + 256], out[at:at + 256]
        for j in range(left.shape[1]):
            diff = part[:, j, None] - right[None, :, j]
            sums += diff * diff
    return np.sqrt(out, out)


def nearest(ask: np.ndarray, train: np.ndarray, k: int, limits: np.ndarray | None = None, cells: np.ndarray | None = None,
            visits: list[np.ndarray] | None = None, nan_first: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(rows, distances), k to each query and nearest first, ties to the first row; -1 and infinity where fewer lie within its limit.

    With ``cells``, the cell of each row, a query is compared only with the rows of the cells in its ``visits``.
    A distance that is no number comes last, or first (``nan_first``).
    """
    limits = np.full(len(ask), np.inf) if limits is None else limits
    best_row, best = np.full((len(ask), k), -1, np.int64), np.full((len(ask), k), np.inf)
    places = np.arange(len(train)) if cells is None else np.argsort(cells, kind="stable")
    ask_2, train_2 = (ask * ask).sum(axis=1), (train * train).sum(axis=1)
    finite = bool(np.isfinite(ask_2).all() and np.isfinite(train_2).all())
    doubt = 8 * (ask.shape[1] + 8) * np.finfo(float).eps * (ask_2 + train_2.max(initial=0))
    blocks = []
    for at in range(0, len(places), AT_ONCE[0]):
        rows = places[at:at + AT_ONCE[0]]
        blocks.append((rows, train[rows], train_2[rows], None if cells is None else np.unique(cells[rows], return_inverse=True)))
    for begin in range(0, len(ask), AT_ONCE[1]):
        part = np.arange(begin, min(len(ask), begin + AT_ONCE[1]))
        reach = limits[part].copy()
        asked = None
        if cells is not None:
            asked = np.zeros((len(part), 1 + max(int(x.max(initial=0)) for x in (cells, *(visits[i] for i in part)))), bool)
            for n, i in enumerate(part):
                asked[n, visits[i]] = True
        for rows, vectors, squares, held in blocks:
            some, mask = np.arange(len(part)), None
            if held is not None:
                open_ = asked[:, held[0]]
                some = np.flatnonzero(open_.any(axis=1))
                if not len(some):
                    continue
                mask = None if open_[some].all() else open_[some][:, held[1]]
            at = part[some]
            if finite:
                near = ask[at] @ vectors.T
                near *= -2
                near += squares
                near += ask_2[at, None]
                if mask is not None:
                    near[~mask] = np.inf
                bound = reach[some] ** 2
                if len(rows) > k and np.isinf(bound).any():
                    bound = np.minimum(bound, np.partition(near, k - 1, axis=1)[:, k - 1] + doubt[at])
                who, col = np.nonzero(near <= (bound + doubt[at])[:, None])
                if mask is not None:
                    allowed = mask[who, col]
                    who, col = who[allowed], col[allowed]
                apart = np.zeros(len(who))
                for left, right in zip(ask[at[who]].T, vectors[col].T):
                    diff = left - right
                    apart += diff * diff
                apart = np.sqrt(apart)
            else:
                apart = distances(ask[at], vectors)
                who, col = np.nonzero(np.ones_like(apart, bool) if mask is None else mask)
                apart = apart[who, col]
            within = (apart <= reach[some][who]) | (np.isnan(apart) if nan_first else False)
            who, row, apart = some[who[within]], rows[col[within]], apart[within]
            if not len(who):
                continue
            kept_who, kept_at = np.nonzero(best_row[part] >= 0)
            who = np.concatenate([kept_who, who])
            row = np.concatenate([best_row[part][kept_who, kept_at], row])
            apart = np.concatenate([best[part][kept_who, kept_at], apart])
            order = np.lexsort((row, np.where(np.isnan(apart), -np.inf, apart), who))
            who, row, apart = who[order], row[order], apart[order]
            rank = np.arange(len(who)) - np.searchsorted(who, who)
            first = rank < k
            best_row[part[who[first]], rank[first]], best[part[who[first]], rank[first]] = row[first], apart[first]
            full = best_row[part, k - 1] >= 0
            reach[full] = np.fmin(reach[full], best[part[full], k - 1])
    return best_row, best


def matrix(table: pa.Table | pa.RecordBatch, name: str = "vector") -> np.ndarray:
    column = table[name]
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count or len(np.unique(column.value_lengths())) > 1:
        raise ValueError("vectors must not be null and have one width")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


@dataclass
class Cells:
    """Pivots and, to each, how many rows its cell holds and between which distances."""

    pivots: np.ndarray
    rows: np.ndarray
    near: np.ndarray
    far: np.ndarray

    def home(self, to_pivots: np.ndarray, k: int) -> list[np.ndarray]:
        """The cells next to each query, until they hold ``k`` rows."""
        order = np.argsort(to_pivots, axis=1, kind="stable")
        held = np.cumsum(self.rows[order], axis=1)
        return [row[:n] for row, n in zip(order, np.minimum((held < k).sum(axis=1) + 1, len(self.rows)))]

    def within(self, to_pivots: np.ndarray, limits: np.ndarray) -> np.ndarray:
        """Whether a cell can hold a row within each query's limit."""
        closest = to_pivots.min(axis=1, keepdims=True)
        bound = np.maximum(np.maximum(to_pivots - self.far, self.near - to_pivots), (to_pivots - closest) / 2)
        return (bound <= limits[:, None] * (1 + _SLACK) + _SLACK) & (self.rows > 0)


def few_equals(training: DataFrame, k: int) -> DataFrame:
    """Of equal vectors only the k lowest ``seq`` can be among the k nearest of any query.

    Vectors that occur more than k times are found by counting hashes; only their rows are gathered.
    """
    rows = training.select("seq", F.col("vector").cast("array<double>").alias("vector"), F.col("label").cast("int").alias("label"))
    rows = rows.withColumn("_mark", F.xxhash64("vector"))
    often = settle(rows.groupBy("_mark").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > k).select("_mark"), "knn-often")
    equal = Window.partitionBy("_mark", "vector").orderBy("seq")
    hot = rows.join(often, "_mark", "left_semi").withColumn("_rn", F.row_number().over(equal)).where(F.col("_rn") <= k).drop("_rn")
    return rows.join(often, "_mark", "left_anti").unionByName(hot).drop("_mark")


def build_index(training: DataFrame, max_pivots: int = MAX_PIVOTS) -> tuple[DataFrame, Cells | None]:
    """(rows (seq, vector, label, cell, radius) in the shared folder, their cells); no cells for an empty table."""
    rows = training.count()
    if not rows:
        return training.select("seq", "vector", "label", F.lit(0).alias("cell"), F.lit(0.0).alias("radius")), None
    chosen = training.select("seq", "vector").orderBy(F.xxhash64("seq"), "seq").limit(min(max_pivots, max(1, isqrt(rows))))
    pivots = np.unique(np.array([r["vector"] for r in chosen.collect()], dtype="float64"), axis=0)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, radius = (x[:, 0] for x in nearest(matrix(batch), pivots, 1, nan_first=True))
                yield batch.append_column("cell", pa.array(cell, pa.int32())).append_column("radius", pa.array(radius))

    kind = training.schema["seq"].dataType.simpleString()
    index = settle(training.mapInArrow(place, f"seq {kind}, vector array<double>, label int, cell int, radius double"), "knn-index")
    rows, near, far = np.zeros(len(pivots), np.int64), np.full(len(pivots), np.inf), np.zeros(len(pivots))
    for r in index.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("radius").alias("near"), F.max("radius").alias("far")).collect():
        rows[r["cell"]], near[r["cell"]], far[r["cell"]] = r["n"], r["near"], r["far"]
    return index, Cells(pivots, rows, near, far)


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))


def _routed(queries: DataFrame, cells: Cells, k: int) -> DataFrame:
    """queries(id, vector, limit) plus cells: those to visit. Without a limit the home cells, with one all others it allows."""
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            apart = distances(matrix(batch), cells.pivots)
            home = cells.home(apart, k)
            if batch["limit"].null_count == batch.num_rows:
                visits, ends = np.concatenate(home), np.cumsum([0, *map(len, home)])
            else:
                open_ = cells.within(apart, batch["limit"].fill_null(np.inf).to_numpy(zero_copy_only=False))
                for row, h in zip(open_, home):
                    row[h] = False
                visits, ends = np.nonzero(open_)[1], np.concatenate([[0], open_.sum(axis=1).cumsum()])
            yield batch.append_column("cells", _lists(visits, ends))

    kind = queries.schema["id"].dataType.simpleString()
    return queries.mapInArrow(route, f"id {kind}, vector array<double>, limit double, cells array<int>")


def turns_of(queries: int, held: int, block_rows: int, cores: int) -> int:
    """Into how many parts the queries of one of ``held`` groups of rows go: no more than memory or idle cores ask for."""
    room = max(block_rows, GROUP_ROWS)
    return max(1, -(-queries // room), min(-(-queries // block_rows), -(-2 * cores // held)))


def _groups(sizes: list[int], room: int) -> list[int]:
    """The number of each cell's group: cells in a row that hold ``room`` rows together, or one larger cell."""
    groups, at, held = [], 0, 0
    for n in sizes:
        if held and held + n > room:
            at, held = at + 1, 0
        groups.append(at)
        held += n
    return groups


def _met(index: DataFrame, cells: Cells, routed: DataFrame, k: int, block_rows: int) -> DataFrame:
    """(id, seq, label, dist): the k best that a query finds in each group of cells that it visits."""
    room = max(block_rows, GROUP_ROWS)
    of_cell = _groups([int(n) for n in cells.rows], room)
    held = [0] * (of_cell[-1] + 1)
    for g, n in zip(of_cell, cells.rows):
        held[g] += int(n)

    def of(values) -> Column:
        return F.array(*[F.lit(int(v)) for v in values])

    numbers = np.array(of_cell, np.int32)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each group that a query visits, with its cells there."""
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                cell, row = part["cells"].flatten().to_numpy(), np.repeat(np.arange(len(part)), part["cells"].value_lengths().to_numpy())
                order = np.lexsort((cell, row))
                cell, row = cell[order], row[order]
                begins = np.flatnonzero(np.diff(row * len(numbers) + numbers[cell], prepend=-1))
                yield pa.RecordBatch.from_arrays(
                    [*(part[c].take(pa.array(row[begins])) for c in part.schema.names if c != "cells"),
                     _lists(cell, np.append(begins, len(cell))), pa.array(numbers[cell[begins]])],
                    [*(c for c in part.schema.names if c != "cells"), "cells", "group"])

    counts = routed.select("cells").mapInArrow(spread, "cells array<int>, group int").groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    asked = {r["group"]: r["n"] for r in counts.collect()}
    id_kind, seq_kind = routed.schema["id"].dataType.simpleString(), index.schema["seq"].dataType.simpleString()

    parts = [max(1, -(-n // room)) for n in held]
    cores = index.sparkSession.sparkContext.defaultParallelism
    turns = [turns_of(asked.get(g, 0), sum(parts), block_rows, cores) for g in range(len(held))]
    parts, turns = (F.element_at(of(x), F.col("group") + 1) for x in (parts, turns))
    left = index.withColumn("group", F.element_at(of(of_cell), F.col("cell") + 1)).withColumn("block", F.pmod(F.xxhash64("seq"), parts).cast("int"))
    left = left.withColumn("turn", F.explode(F.sequence(F.lit(0), turns - 1)))
    right = routed.select("id", "vector", "limit", "cells").mapInArrow(
        spread, f"id {id_kind}, vector array<double>, limit double, cells array<int>, group int")
    right = right.withColumn("turn", F.pmod(F.xxhash64("id"), turns).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), parts - 1)))

    def compare(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        if not rows.num_rows or not wanted.num_rows:
            return pa.table({"id": wanted["id"].slice(0, 0), "seq": rows["seq"].slice(0, 0), "label": pa.array([], pa.int32()), "dist": pa.array([], pa.float64())})
        rows = rows.sort_by("seq")
        limits = wanted["limit"].fill_null(np.inf).to_numpy() * (1 + _SLACK) + _SLACK
        to_visit = wanted["cells"].combine_chunks()
        visits = np.split(to_visit.flatten().to_numpy(), np.cumsum(to_visit.value_lengths().to_numpy())[:-1])
        found, dist = nearest(matrix(wanted), matrix(rows), k, limits, rows["cell"].to_numpy(), visits)
        who, place = np.nonzero(found >= 0)
        picked = rows.take(pa.array(found[who, place]))
        return pa.table({"id": wanted["id"].take(pa.array(who)), "seq": picked["seq"], "label": picked["label"], "dist": pa.array(dist[who, place])})

    keys = ("group", "block", "turn")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, f"id {id_kind}, seq {seq_kind}, label int, dist double")


def compared_pairs(routed: DataFrame, cells: Cells) -> int:
    """Pairs of a query and a row whose cell it visits."""
    sizes = F.element_at(F.array(*[F.lit(int(n)) for n in cells.rows]), F.col("cell") + 1)
    return routed.select(F.explode("cells").alias("cell")).agg(F.coalesce(F.sum(sizes), F.lit(0))).first()[0]


def visits_of(queries: DataFrame, index: DataFrame, cells: Cells, k: int, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(home visits, later visits, what the home visits found) of queries(id, vector)."""
    asked = queries.withColumn("limit", F.lit(None).cast("double"))
    home = settle(_routed(asked, cells, k), "knn-home")
    first = settle(_met(index, cells, home, k, block_rows), "knn-first")
    best = Window.partitionBy("id").orderBy("dist", "seq")
    limit = first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select(F.col("id").alias("_id"), F.col("dist").alias("limit"))
    bounded = queries.join(limit, F.col("id") == F.col("_id"), "left").select("id", "vector", F.coalesce("limit", F.lit(float("inf"))).alias("limit"))
    later = settle(_routed(bounded, cells, k), "knn-later")
    return home, later, first


def index_neighbours(queries: DataFrame, training: DataFrame, k: int = 5, id_col: str = "id", max_pivots: int = MAX_PIVOTS,
                     block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, seq, label, dist, rank): the k nearest training rows of every query, exactly, ties to the lowest seq."""
    queries = settle(queries.select(F.col(id_col).alias("id"), F.col("vector").cast("array<double>").alias("vector")), "knn-queries")
    index, cells = build_index(few_equals(training, k), max_pivots)
    if cells is None:
        kind, seq = queries.schema["id"].dataType.simpleString(), index.schema["seq"].dataType.simpleString()
        return queries.sparkSession.createDataFrame([], f"id {kind}, seq {seq}, label int, dist double, rank int")
    _, later, first = visits_of(queries, index, cells, k, block_rows)
    found = first.unionByName(_met(index, cells, later, k, block_rows))
    order = Window.partitionBy("id").orderBy("dist", "seq")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
