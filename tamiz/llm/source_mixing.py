"""Mixing sources to target token weights by entropy balancing."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamiz.llm.common import WORD, body, table
from tamiz.session import settle

#: Documents of a source that are rounded together.
BLOCK = 1024


def source_targets(totals: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """Adds weight and target to totals(key, source, source_size), one row per source.

    Sources in code-point order (null last) get the weights in turn and share the total by weight. A target
    stops at ``most`` times the source's size; what it leaves is shared by weight among the others,
    until no target is above its bound. That is one water level: in order of bound / weight the
    bounded sources come first, so running sums give the level. One row per source, no documents.
    """
    everything = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last()))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    bounded = totals.withColumn("weight", F.element_at(cycle, (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int")))
    bounded = bounded.withColumn("bound", F.col("source_size") * F.lit(float(most)))
    order = everything.orderBy(F.col("bound") / F.col("weight"), "key")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = bounded.select(
        "*", F.row_number().over(order).alias("at"),
        ((F.sum("source_size").over(everything) - F.coalesce(F.sum("bound").over(before), F.lit(0.0)))
         / F.sum("weight").over(after)).alias("level"),
    )
    free = F.col("bound") > F.col("level") * F.col("weight")
    first = F.min(F.when(free, F.struct("at", "level"))).over(everything)
    return level.select(
        "key", "source", "source_size", "n_docs", "least", "weight",
        F.least("bound", F.coalesce(F.col("weight") * first["level"], F.col("bound"))).alias("target"),
    )


def tilts(cells: DataFrame, targets: DataFrame, most: float, rounds: int = 60) -> DataFrame:
    """Adds tilt and mean to ``targets``: the solution of the convex dual, by Newton steps on all sources at once.

    Among all document rates r in [0, most] with sum(r * size) = target, those closest to 1 in relative entropy are
    r = min(most, exp(tilt * size / mean)). The dual's gradient and curvature are sums over
    cells(key, size, n), documents of one source and size, so each step is one pre-aggregated sum per source.
    A step that leaves the bracket of the root is replaced by its middle. Sources at their bound get
    an infinite tilt (null). The state is a table of one row per source; it is written after each step.
    """
    limit = F.lit(float(most))
    ratio = F.try_divide("target", "source_size")
    state = targets.withColumn("mean", F.try_divide("source_size", "n_docs"))
    solvable = (F.col("source_size") > 0) & (ratio < limit * (1 - 1e-12))
    flat = F.log(ratio)
    reach = F.try_divide("mean", "least")
    state = state.select(
        "*", F.when(solvable, flat).alias("tilt"),
        F.when(flat < 0, flat * reach).otherwise(F.lit(0.0)).alias("low"),
        F.when(flat > 0, F.log(limit) * reach).otherwise(F.lit(0.0)).alias("high"),
        solvable.alias("open"),
    )
    state = settle(state, "mix-state")
    for _ in range(rounds):
        if not state.where("open").limit(1).count():
            break
        tilted = F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.log(limit)))
        loose = F.col("tilt") * F.col("size") / F.col("mean") < F.log(limit)
        mass = F.col("n") * F.col("size") * tilted
        sums = cells.join(state.where("open").select("key", "tilt", "mean"), "key").groupBy("key").agg(
            F.sum(mass).alias("got"),
            F.sum(F.when(loose, mass * F.col("size") / F.col("mean")).otherwise(0.0)).alias("slope"),
        )
        gap = F.col("got") - F.col("target")
        low = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - F.try_divide(gap, F.col("slope"))
        inside = (F.col("slope") > 0) & (newton > low) & (newton < high)
        wide = F.abs(gap) > 0.25 + 1e-6 * F.col("target")
        moved = F.col("got").isNotNull() & wide & (high - low > 1e-10)
        state = settle(state.join(sums, "key", "left").select(
            *targets.columns, "mean",
            F.round(F.when(moved, F.when(inside, newton).otherwise((low + high) / 2)).otherwise(F.col("tilt")), 12).alias("tilt"),
            F.coalesce(low, "low").alias("low"), F.coalesce(high, "high").alias("high"),
            (F.col("open") & F.coalesce(moved, F.lit(False))).alias("open"),
        ), "mix-state")
    return state.withColumn("tilt", F.round("tilt", 9))


def _round_up_or_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """copies: each rate's floor or one more, whichever keeps the block's running token error least.

    Rows come sorted by key, block and falling size, so the last and shortest documents settle what is left over.
    """
    block, error = None, 0.0
    for batch in batches:
        copies = []
        for key, part, size, rate in zip(*(batch[c].to_pylist() for c in ("key", "block", "size", "rate"))):
            if (key, part) != block:
                block, error = (key, part), 0.0
            down = int(rate)
            up = down + (rate > down)
            few, many = error + (down - rate) * size, error + (up - rate) * size
            copies.append(down if abs(few) <= abs(many) else up)
            error = few if abs(few) <= abs(many) else many
        yield batch.append_column("copies", pa.array(copies, pa.int64()))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken) for each row of docs(doc_id, text, source).

    size counts words (null text: 0). The mix takes ``copies`` whole copies of a document, ``taken`` words. Documents
    without words get rate 1 (3 where their source stands at its bound) and take no words. Null
    is a source of its own, the last. Repeated rows are documents of their own; rows with a null doc_id too.
    An empty table gives no rows; further columns are ignored. The same input gives the same result.
    """
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    sized = settle(
        docs.select("doc_id", "source", key.alias("key"), F.regexp_count(body(), F.lit(WORD)).cast("long").alias("size")),
        "mix-sizes",
    )
    cells = settle(sized.groupBy("key", "source", "size").agg(F.count("*").alias("n")), "mix-cells")
    totals = cells.groupBy("key", "source").agg(
        F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("n_rows"),
        F.sum(F.when(F.col("size") > 0, F.col("n"))).alias("n_docs"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"),
    )
    rows = totals.select("key", F.col("n_rows"))
    state = tilts(cells.where("size > 0"), source_targets(totals, weights, most), most).join(rows, "key")
    limit = F.lit(float(most))
    rate = F.when(F.col("tilt").isNull(), F.when(F.col("source_size") > 0, limit).otherwise(1.0)).otherwise(
        F.least(limit, F.exp(F.try_divide(F.col("tilt") * F.col("size"), F.col("mean")))))
    blocks = F.ceil(F.col("n_rows") / BLOCK)
    rated = sized.drop("source").join(state, "key").select(
        "doc_id", "source", "key", "size", "source_size", "target", rate.alias("rate"),
        F.pmod(F.xxhash64("doc_id", "size"), blocks).alias("block"),
    )
    rated = rated.repartition("key", "block").sortWithinPartitions("key", "block", F.desc("size"), "doc_id")
    out = "doc_id long, source string, key string, size long, source_size long, target double, rate double, block long, copies long"
    rated = rated.withColumns({"doc_id": F.col("doc_id").cast("long"), "source": F.col("source").cast("string")})
    return rated.mapInArrow(_round_up_or_down, out).select(
        "doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))
