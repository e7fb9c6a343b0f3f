"""Repeated passages from a sparse suffix array.

Only suffixes that begin at a minimiser are kept: of every ``WINDOW`` neighbouring seeds of ``SEED`` words the one of least hash.
A passage of LEAST = WINDOW + SEED - 1 words has one minimiser and chooses it by its own words alone, so equal passages are
found at the same kept suffix. Suffixes whose seed only one text holds are dropped by count. The rest are sorted by the words to
their right across the cluster; a task compares each with its neighbours of other texts, extends the matches left and right, and
does the same in the order of the words to the left. The longest match to either side bounds what any text can share with a
suffix; where the neighbours' matches fill these bounds, as they do when few texts hold a seed, the suffix is done. Where they
leave a gap (the longest match to the left and that to the right belong to different texts), or a seed's suffixes lie in several
tasks or number more than ``GROUP``, the passages within the bounds are hashed and counted instead, so no neighbour is left out:
first among the suffixes that lie together, then across the cluster, with one row for all that are already known to repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamiz.llm.common import WORD, body, spaced_words, table, with_small_batches
from tamiz.session import settle

#: Words of a repeated passage at least; a window of seeds fills it: LEAST = SEED + WINDOW - 1.
LEAST = 50
SEED, WINDOW = 11, 40
#: Suffixes to an Arrow batch that a task hands back.
ROWS = 4_000
#: Suffixes of one seed that a task compares at once; a seed with more goes by passage counts.
GROUP = 10_000


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def owners(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(seed hash at each place, place of the minimiser of each LEAST words) of one text's word hashes; a shorter text has none."""
    n = len(words) - SEED + 1
    if n < WINDOW:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    seeds = words[:n].copy()
    with np.errstate(over="ignore"):
        for k in range(1, SEED):
            seeds = _mix(seeds * np.uint64(3) + words[k:k + n])
    windows = np.lib.stride_tricks.sliding_window_view(_mix(seeds ^ np.uint64(0x5851F42D4C957F2D)), WINDOW)
    return seeds, windows.argmin(axis=1) + np.arange(len(windows))


def minimisers(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, seed hashes) of the minimisers of one text's word hashes; a shorter text than a window has none."""
    seeds, owner = owners(words)
    places = np.unique(owner)
    return places, seeds[places]


def passages(words: np.ndarray) -> np.ndarray:
    """Hash of each LEAST words in a row (last axis), made of hashes of twice as many words at each step."""
    with np.errstate(over="ignore"):
        powers, size = {1: _mix(words)}, 1
        while size * 2 <= LEAST:
            half = powers[size]
            powers[size * 2] = _mix(half[..., :-size] * np.uint64(3) + half[..., size:])
            size *= 2
        n, at = words.shape[-1] - LEAST + 1, 0
        out = np.zeros((*words.shape[:-1], n), np.uint64)
        for size in sorted(powers, reverse=True):
            if LEAST & size:
                out, at = _mix(out * np.uint64(3) + powers[size][..., at:at + n]), at + size
    return out


def _lists(batch: pa.RecordBatch, name: str) -> Iterator[np.ndarray]:
    column = batch[name]
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    for begin, end in zip(ends[:-1], ends[1:]):
        yield flat[begin:end]


def _select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [minimisers(words.view(np.uint64)) for words in _lists(batch, "words")]
        counts = [len(p) for p, _ in found]
        yield pa.RecordBatch.from_arrays([
            batch["tid"].take(pa.array(np.repeat(np.arange(len(found)), counts))),
            pa.array(np.concatenate([p for p, _ in found]).astype(np.int32)),
            pa.array(np.concatenate([s for _, s in found]).view(np.int64)),
        ], ["tid", "place", "seed"])


def contexts(words: np.ndarray, places: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(place, seed, low, high, right, left) of kept suffixes of one text, ROWS at a time.

    A passage that chooses the suffix begins low to high words before it. right and left hold the words that such passages have
    from the suffix on and before it, nearest first, as hashes of 32 bits that are never 0; what lies beyond is 0.
    """
    seeds, owner = owners(words)
    short = (_mix(words) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    for k in range(0, len(places), ROWS):
        place = places[k:k + ROWS].astype(np.int64)
        low, high = place + 1 - np.searchsorted(owner, place, "right"), place - np.searchsorted(owner, place)

        def taken(width: int, size: np.ndarray, at: np.ndarray) -> np.ndarray:
            return np.where(np.arange(width) < size[:, None], short[at.clip(0, len(short) - 1)], np.uint32(0))

        right = taken(LEAST, LEAST - low, place[:, None] + np.arange(LEAST))
        yield place, seeds[place], low, high, right, taken(WINDOW - 1, high, place[:, None] - 1 - np.arange(WINDOW - 1))


def _packed(words: np.ndarray) -> pa.Array:
    """One binary value to a row, in an order of bytes that sorts like the words."""
    n, width = words.shape
    ends = pa.py_buffer((np.arange(n + 1) * width * 4).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), n, [None, ends, pa.py_buffer(words.astype(">u4").tobytes())])


def _unpacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u4").reshape(len(column), -1).astype(np.uint32)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for tid, words, places in zip(batch["tid"], _lists(batch, "words"), _lists(batch, "places")):
            for place, seed, low, high, right, left in contexts(words.view(np.uint64), places):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tid.as_py()] * len(place), pa.binary()), pa.array(place.astype(np.int32)), pa.array(seed.view(np.int64)),
                     pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), _packed(right), _packed(left)],
                    ["tid", "place", "seed", "low", "high", "right", "left"])


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading words that each two rows have in common."""
    differ = (a != b) | (a == 0)
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


def _others(seed: np.ndarray, text: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their nearest rows of another text), before and after, among sorted rows of equal seed."""
    n = len(seed)
    fresh = np.r_[True, (seed[1:] != seed[:-1]) | (text[1:] != text[:-1])]
    begins = np.r_[np.flatnonzero(fresh), n]
    run = fresh.cumsum() - 1
    for near in (begins[run] - 1, begins[run + 1]):
        rows = np.flatnonzero((near >= 0) & (near < n))
        rows = rows[seed[near[rows]] == seed[rows]]
        yield rows, near[rows]


def bounds(seed: np.ndarray, text: np.ndarray, low: np.ndarray, high: np.ndarray, right: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first, last, gap) of whole seeds, sorted by seed and right: another text can share the passages that begin first to last
    words before a suffix, none if first > last; gap: the neighbours do not hold all of them."""
    n, steps = len(seed), np.arange(WINDOW)
    ahead, behind, held = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros((n, WINDOW), bool)
    words = np.hstack([left, right]).astype(">u4").view(np.uint8)
    by_left = np.hstack([seed.astype(">i8").view(np.uint8).reshape(n, 8), words]).view(f"S{8 + words.shape[1]}").ravel().argsort(kind="stable")
    for order in (np.arange(n), by_left):
        for rows, near in _others(seed[order], text[order]):
            i, j = order[rows], order[near]
            r, l = _common(right[i], right[j]), _common(left[i], left[j])
            ahead[i], behind[i] = np.maximum(ahead[i], r), np.maximum(behind[i], l)
            held[i] |= (steps >= np.maximum(low[i], LEAST - r)[:, None]) & (steps <= np.minimum(high[i], l)[:, None])
    first, last = np.maximum(low, LEAST - ahead), np.minimum(high, behind)
    gap = ((steps >= first[:, None]) & (steps <= last[:, None]) & ~held).any(axis=1)
    return first, last, gap


_FOUND = "tid binary, place int, seed long, first int, last int, hash long, many boolean"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_FOUND of suffixes sorted by seed and right: what is settled here with null as hash, the passages of all others.

    A passage that two texts of these rows hold is settled, and named once more, as held by many, for other tasks. The first and the last seed of a task may go on in another, so they count as not settled.
    """
    def found(rows: pa.Table, first: np.ndarray, last: np.ndarray, hashes: np.ndarray | None = None, many: bool = False) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [*(rows[name].combine_chunks() for name in ("tid", "place", "seed")), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)),
             pa.nulls(len(rows), pa.int64()) if hashes is None else pa.array(hashes.view(np.int64)), pa.array(np.full(len(rows), many))],
            ["tid", "place", "seed", "first", "last", "hash", "many"])

    def listed(rows: pa.Table, first: np.ndarray, last: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(rows), ROWS):
            some, who = rows.slice(k, ROWS), numbers(rows.slice(k, ROWS), "who")
            right, left = _unpacked(some["right"]), _unpacked(some["left"])
            hashes = passages(np.hstack([left[:, ::-1], right]).astype(np.uint64))[:, ::-1]  # by words before the suffix
            steps = np.arange(WINDOW)
            row, step = np.nonzero((steps >= first[k:k + ROWS, None]) & (steps <= last[k:k + ROWS, None]))
            if not len(row):
                continue
            order = np.lexsort((who[row], hashes[row, step], step))
            row, step = row[order], step[order]
            held, text = hashes[row, step], who[row]
            begins = np.flatnonzero(np.r_[True, (step[1:] != step[:-1]) | (held[1:] != held[:-1])])
            ends = np.r_[begins[1:], len(row)]
            shared = text[begins] != text[ends - 1]
            here = np.repeat(shared, ends - begins)
            if here.any():
                at = np.unique(row[here])
                least, most = np.full(len(some), WINDOW), np.full(len(some), -1)
                np.minimum.at(least, row[here], step[here])
                np.maximum.at(most, row[here], step[here])
                yield found(some.take(pa.array(at)), least[at], most[at])
                one = begins[shared]
                yield found(some.take(pa.array(row[one])), step[one], step[one], held[one], True)
            if not here.all():
                yield found(some.take(pa.array(row[~here])), step[~here], step[~here], held[~here])

    def numbers(rows: pa.Table, name: str) -> np.ndarray:
        return rows[name].to_numpy().astype(np.int64)

    def settled(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        seed = numbers(rows, "seed")
        first, last, gap = bounds(seed, numbers(rows, "who"), numbers(rows, "low"), numbers(rows, "high"), _unpacked(rows["right"]), _unpacked(rows["left"]))
        some = first <= last
        gap = np.isin(seed, seed[gap])
        if (some & ~gap).any():
            at = np.flatnonzero(some & ~gap)
            yield found(rows.take(pa.array(at)), first[at], last[at])
        at = np.flatnonzero(some & gap)
        yield from listed(rows.take(pa.array(at)), first[at], last[at])

    def whole(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        yield from listed(rows, numbers(rows, "low"), numbers(rows, "high"))

    held, still = None, None  # rows of seeds that may go on; a seed whose rows are listed, not held
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        seed = numbers(rows, "seed")
        if still is None:
            still = seed[0]
        go = np.searchsorted(seed, still, "right")
        yield from whole(rows.slice(0, go))
        rows, seed = rows.slice(go), seed[go:]
        cut = np.searchsorted(seed, seed[-1]) if len(seed) else 0
        if cut:
            yield from settled(rows.slice(0, cut).combine_chunks())
        held = rows.slice(cut).combine_chunks()
        if len(held) > GROUP:
            yield from whole(held)
            still, held = seed[-1], None
    if held is not None:
        yield from whole(held)


def _hashes(texts: DataFrame) -> DataFrame:
    return texts.withColumn("words", F.transform(spaced_words(F.col("text")), lambda w: F.xxhash64(w)))


def repeated_stretches(texts: DataFrame, firsts: DataFrame) -> DataFrame:
    """(tid, begin, stop), word places, of pieces of passages that other texts hold as well.

    texts(tid, row, text) may repeat a text; firsts(tid, row) names the row of each text that stands for it.
    """
    with_small_batches(texts.sparkSession)
    places = settle(_hashes(texts).select("tid", "words").mapInArrow(_select, "tid binary, place int, seed long"), "suffix-places")
    who = F.xxhash64("tid")
    seeds = places.groupBy("seed").agg(F.min(who).alias("a"), F.max(who).alias("b")).where("a <> b").select("seed")
    seeds = settle(seeds, "suffix-seeds")  # a table of its own: only then can the join split a frequent seed's places
    kept = places.join(seeds, "seed", "left_semi").groupBy("tid").agg(F.sort_array(F.collect_set("place")).alias("places"))
    kept = settle(kept.join(firsts, "tid"), "suffix-kept")
    suffixes = _hashes(texts.join(kept, ["tid", "row"])).select("tid", "words", "places").mapInArrow(
        _contexts, "tid binary, place int, seed long, low int, high int, right binary, left binary")
    suffixes = settle(suffixes, "suffix-contexts").withColumn("who", who)
    found = settle(suffixes.orderBy("seed", "right", "left", "tid").mapInArrow(_compare, _FOUND), "suffix-found")
    same = Window.partitionBy("seed", "first", "hash")  # a row or two to each ROWS suffixes that hold the passage, and a text's own repeats
    left_over = found.where("hash is not null").withColumn("who", who).select(
        "tid", "place", "first", "last", "many", (F.bool_or("many").over(same) | (F.min("who").over(same) < F.max("who").over(same))).alias("repeats"))
    counted = left_over.where("repeats and not many").groupBy("tid", "place").agg(  # all of a place's passages hold its seed
        F.min("first").alias("first"), F.max("last").alias("last"))
    both = found.where("hash is null").select("tid", "place", "first", "last").unionByName(counted)
    return both.select("tid", (F.col("place") - F.col("last")).cast("long").alias("begin"), (F.col("place") - F.col("first") + LEAST).cast("long").alias("stop"))


def merged(stretches: DataFrame) -> DataFrame:
    """(tid, spans): overlapping and touching stretches of a text as one, in order."""
    order = Window.partitionBy("tid").orderBy("begin", "stop")
    reached = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.sum(F.when(F.col("begin") <= reached, 0).otherwise(1)).over(order)
    spans = stretches.distinct().withColumn("span", fresh).groupBy("tid", "span").agg(F.min("begin").alias("begin"), F.max("stop").alias("stop"))
    return spans.groupBy("tid").agg(F.sort_array(F.collect_list(F.struct("begin", "stop"))).alias("spans"))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, n_spans, n_words, spans) of each row of docs(doc_id, text) that shares a passage with another text.

    A passage has LEAST words (separated by white space, compared exactly) at least; spans are word places, end exclusive. Equal
    texts repeat each other whole, if long enough. A passage that only one text repeats within itself is left alone.
    Null text is empty; repeated rows count as equal texts and are all reported; empty table: no rows.
    """
    row = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    rows = docs.select("doc_id", F.unhex(F.md5(body())).alias("tid"), row.alias("row"), body().alias("text"))
    counted = settle(rows.groupBy("tid").agg(F.count("*").alias("rows"), F.min("row").alias("row")), "suffix-texts")
    spans = settle(merged(repeated_stretches(rows, counted.select("tid", "row"))), "suffix-spans")
    copies = counted.where("rows > 1").select("tid", "rows")
    known = rows.select("doc_id", "tid", F.regexp_count("text", F.lit(WORD)).cast("long").alias("size"))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.col("size").alias("stop")))
    every = known.join(spans, "tid", "left").join(copies, "tid", "left").select(
        "doc_id", F.when(F.col("rows").isNotNull() & (F.col("size") >= LEAST), whole).otherwise(F.col("spans")).alias("spans"))
    words = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["begin"])
    return every.where("spans is not null").select("doc_id", F.size("spans").cast("long").alias("n_spans"), words.alias("n_words"), "spans")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
