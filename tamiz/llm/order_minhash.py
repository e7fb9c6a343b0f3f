"""Near-duplicate documents by order min-hash, verified by banded alignment.

A document is the sequence of its five-word shingles, each labelled with its occurrence number, so that no label
repeats. A sketch takes the three labels of least hash *in text order*; equal sketches therefore
favour texts that agree in content and in order. Similarity is S / (a + b - S), S being the longest common subsequence of
the labels inside the band that the wanted similarity allows. 1 minus it is a metric (the Steinhaus transform of insert-delete
distance), which lets whole groups be settled by comparing each member with one hub.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamiz.llm.common import body, components, plain_words, table, with_small_batches
from tamiz.session import settle

SHINGLE = 5
#: Sketches to a document, and labels to a sketch. Two texts of similarity 0.8 share one of them but once in 10^5 cases.
SKETCHES, LENGTH = 16, 3
#: Hubs that a group's members are compared with in turn; after that, open pairs are looked up by their rarest labels.
HUBS = 2
#: Texts that a text meets in one label in the first of these turns; each turn has this many times as many as the one before, or more
#: where all meetings together stay below ``MEETINGS`` squared times the texts that meet.
MEETINGS = 16
#: Largest table, in rows, that is sent to every task; a larger one is joined by shuffling.
BROADCAST_ROWS = 500_000


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def labelled(words: np.ndarray) -> np.ndarray:
    """Occurrence-labelled shingle hashes of word hashes, in order; fewer words than a shingle give none."""
    n = len(words) - SHINGLE + 1
    if n < 1:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = words[:n].copy()
        for k in range(1, SHINGLE):
            out = _mix(out * np.uint64(3) + words[k:k + n])
        order = np.argsort(out, kind="stable")
        ranked = out[order]
        again = np.flatnonzero(ranked[1:] == ranked[:-1]) + 1
        if len(again):
            nth = np.zeros(n, np.int64)
            begin = np.arange(n)
            begin[again] = 0
            begin = np.maximum.accumulate(begin)
            nth[order] = np.arange(n) - begin
            out = np.where(nth > 0, _mix(out + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), out)
    return out


def order_sketches(labels: np.ndarray) -> np.ndarray:
    """SKETCHES hashes, each of the LENGTH labels of least mixed hash in text order (all labels of a shorter text)."""
    out = np.empty(SKETCHES, np.uint64)
    take = min(LENGTH, len(labels))
    with np.errstate(over="ignore"):
        for j in range(SKETCHES):
            seed = np.uint64((0x9E3779B97F4A7C15 * (j + 1)) & 0xFFFFFFFFFFFFFFFF)
            mixed = (labels ^ seed) * (seed | np.uint64(1))  # the labels are mixed already
            least = np.sort(np.argpartition(mixed, take - 1)[:take])
            key = seed
            for label in labels[least]:
                key = _mix(key * np.uint64(31) + label)
            out[j] = key
    return out


def aligned(a: np.ndarray, b: np.ndarray, least: float) -> tuple[float, float]:
    """(similarity, upper bound) of two label sequences; a similarity below ``least`` may come out lower still."""
    total = len(a) + len(b)
    if not total:
        return 1.0, 1.0
    _, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    bound = len(at_a) / (total - len(at_a))
    band = int(total * (1 - least) / (1 + least)) + 1
    inside = np.abs(at_a - at_b) <= band
    chain = at_b[inside][np.argsort(at_a[inside])]
    if len(chain) < 2 or (chain[1:] > chain[:-1]).all():
        length = len(chain)
    else:
        tails: list[int] = []
        for x in chain.tolist():
            k = bisect_left(tails, x)
            tails[k:k + 1] = [x]
        length = len(tails)
    return length / (total - length), bound


def _word_lists(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    column = batch["words"]
    flat = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    ends = column.offsets.to_numpy()
    for begin, end in zip(ends[:-1], ends[1:]):
        yield flat[begin:end]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, keys = [], []
        for words in _word_lists(batch):
            labels = labelled(words)
            sizes.append(len(labels))
            keys.append(order_sketches(labels).view(np.int64) if len(labels) else None)
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["tid"], pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
            ["doc_id", "tid", "size", "keys"])


def _label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels = [labelled(words).tobytes() for words in _word_lists(batch)]
        yield pa.RecordBatch.from_arrays([batch["tid"], pa.array(labels, pa.binary())], ["tid", "labels"])


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for tid, labels in zip(batch["tid"], batch["labels"]):
            values = np.frombuffer(labels.as_py(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([tid.as_py()] * len(values), pa.binary()), pa.array(values)], ["tid", "label"])


def _compare(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [
            aligned(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), least)
            for x, y in zip(batch["a_labels"], batch["b_labels"])
        ]
        yield pa.RecordBatch.from_arrays(
            [batch["hub"], batch["tid"], pa.array([v[0] for v in values], pa.float64()), pa.array([v[1] for v in values], pa.float64())],
            ["hub", "tid", "similarity", "bound"])


def _tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, tid, words): tid is the digest of the normalised words, words their hashes."""
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), plain_words(body()).alias("w"))
    return words.select(
        "doc_id", F.unhex(F.md5(F.array_join("w", " "))).alias("tid"), F.transform("w", lambda x: F.xxhash64(x)).alias("words"))


def sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, tid, size, keys) for each row: the number of shingles and the sketches (null without shingles)."""
    with_small_batches(docs.sparkSession)
    return _tokens(docs).mapInArrow(_sketch, "doc_id long, tid binary, size long, keys array<long>")


def _verify(pairs: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """(hub, tid, similarity, bound) of pairs(hub, tid, hub_size, size); lengths alone decide many."""
    ratio = F.least("hub_size", "size") / F.greatest("hub_size", "size")
    pairs = pairs.withColumn("ratio", ratio)
    near = pairs.where(F.col("ratio") >= least)
    sides = near.select("hub", "tid").join(labels.select("tid", F.col("labels").alias("b_labels")), "tid").join(
        labels.select(F.col("tid").alias("hub"), F.col("labels").alias("a_labels")), "hub")
    compared = sides.select("hub", "tid", "a_labels", "b_labels").mapInArrow(
        lambda b: _compare(b, least), "hub binary, tid binary, similarity double, bound double")
    return compared.unionByName(pairs.where(F.col("ratio") < least).select("hub", "tid", F.lit(0.0).alias("similarity"), F.col("ratio").alias("bound")))


def _stars(members: DataFrame) -> DataFrame:
    """members(key, tid, size, root) of groups of more than one root, each but the hub with its hub, the least tid."""
    hubs = members.groupBy("key").agg(F.min(F.struct("tid", "size", "root")).alias("hub"), F.min("root").alias("a"), F.max("root").alias("b"))
    hubs = hubs.where("a <> b").select("key", F.col("hub.tid").alias("hub"), F.col("hub.size").alias("hub_size"), F.col("hub.root").alias("hub_root"))
    return members.join(hubs, "key").where("tid <> hub")


def _rooted(df: DataFrame, roots: DataFrame, tid: str, root: str) -> DataFrame:
    named = _few(roots.select(F.col("tid").alias(tid), F.col("root").alias("_root")))
    return df.join(named, tid, "left").withColumn(root, F.coalesce("_root", tid)).drop("_root")


def _rare_labels(rows: DataFrame, labels: DataFrame, similarity: float) -> DataFrame:
    """(label, tid, size, left): the labels that decide which of rows(tid, size) may reach the similarity.

    Of two texts that do, each holds one of the other's labels among the rarest part of its own, ``1 - similarity`` and one label more.
    Labels of one text only come first in that part and meet nothing. ``left`` labels of the text come after this one.
    """
    found = labels.join(rows.select("tid"), "tid", "left_semi").mapInArrow(_occurrences, "tid binary, label long")
    found = settle(found, "omh-occurrences")
    counts = settle(found.groupBy("label").agg(F.count("*").alias("n")).where("n > 1"), "omh-frequencies")
    text = Window.partitionBy("tid")
    shared = found.join(counts, "label").withColumns({
        "place": F.row_number().over(text.orderBy("n", "label")), "shared": F.count("*").over(text)})
    rank = F.col("place") + F.col("size") - F.col("shared")
    rare = shared.join(rows.select("tid", "size"), "tid").withColumn("left", F.col("size") - rank).where(
        F.col("left") >= F.ceil(F.lit(similarity) * F.col("size") - 1e-9) - 1).select("label", "tid", "size", "left")
    return settle(rare, "omh-rare")


def _open_labels(rare: DataFrame, roots: DataFrame) -> DataFrame:
    """``rare`` with each text's root, for labels of more than one; ``main`` is the root of most of a label's ``texts``."""
    rooted = _rooted(rare, roots, "tid", "root")
    sizes = rooted.groupBy("label", "root").agg(F.count("*").alias("n"))
    mains = sizes.groupBy("label").agg(
        F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("roots"), F.sum("n").alias("texts")).where("roots > 1")
    return settle(rooted.join(mains.drop("roots"), "label"), "omh-open")


def _crossed(found: DataFrame, similarity: float, width: int) -> DataFrame:
    """Distinct pairs (hub, tid, hub_size, size) of different roots that share a rare label and may reach the similarity.

    A label's texts are dealt to blocks of about ``width`` and meet those of their block only; with no more texts than ``width`` they all
    meet. Texts of the main root meet only others. A pair's first common label bounds how many may follow it.
    """
    blocks = F.ceil(F.col("texts") / width)
    dealt = found.withColumn("block", F.pmod(F.xxhash64("label", "tid", F.lit(width)), blocks))
    strays = dealt.where("root <> main").select("label", "block", *[F.col(c).alias(f"a_{c}") for c in ("tid", "size", "root", "left")])
    least = (F.col("a_size") + F.col("size")) * similarity / (1 + similarity) - 1e-9
    once = (F.col("root") == F.col("main")) | (F.col("a_tid") < F.col("tid"))
    met = strays.join(dealt, ["label", "block"]).where(once & (F.col("a_root") != F.col("root")) & (1 + F.least("a_left", "left") >= least))
    one, two = F.struct(F.col("a_tid").alias("tid"), F.col("a_size").alias("size")), F.struct("tid", "size")
    return met.select(F.least(one, two).alias("low"), F.greatest(one, two).alias("high")).select(
        F.col("low.tid").alias("hub"), F.col("high.tid").alias("tid"), F.col("low.size").alias("hub_size"), F.col("high.size").alias("size")).distinct()


def near_classes(texts: DataFrame, labels, similarity: float = 0.8) -> DataFrame:
    """(tid, root): the linked texts among texts(tid, size, keys) and the least tid of their component.

    Two texts of at least ``similarity`` are linked. Texts with an equal sketch form a group, and each member is compared with the
    group's hub first. A group is done once all its members have one root. What else may be
    linked goes on without the hub: members of another root than the hub, and those that by the triangle inequality may be similar to
    one of these. After ``HUBS`` hubs, or one that leaves more than half of the members, those of groups that still have several roots
    are paired by their rarest labels, in turns: a label's texts meet few others first, then ever more, at last all that are of another
    root still. A large cluster linked by chains so becomes one root before its pairs are written out. ``labels`` makes (tid, labels) of
    (tid) rows; it is called once.
    """
    spark = texts.sparkSession
    keys = F.posexplode("keys").alias("j", "sketch")
    members = texts.where("keys is not null").select("tid", "size", keys).select(
        F.xxhash64("j", "sketch").alias("key"), "tid", "size", F.col("tid").alias("root"))
    members = settle(_stars(members), "omh-group")
    involved = settle(members.select("tid").unionByName(members.select(F.col("hub").alias("tid"))).distinct(), "omh-involved")
    content = labels(involved)
    roots = spark.createDataFrame([], "tid binary, root binary")
    done, reach = None, 1 - similarity + 1e-9

    def compared(pairs: DataFrame, roots: DataFrame, done: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """Everything compared so far, and the roots with the new links."""
        if done is not None:
            pairs = pairs.join(done, ["hub", "tid"], "left_anti")
        fresh = settle(_verify(settle(pairs, "omh-pairs"), content, similarity), "omh-compared")
        links = fresh.where(F.col("similarity") >= similarity)
        links = _rooted(_rooted(links, roots, "hub", "a"), roots, "tid", "b").select("a", "b")
        joined = components(links, "omh").select(F.col("node").alias("at"), F.col("root").alias("to"))
        moved = roots.join(joined, F.col("root") == F.col("at"), "left").select("tid", F.coalesce("to", "root").alias("root"))
        added = joined.select(F.col("at").alias("tid"), F.col("to").alias("root"))
        roots = settle(moved.unionByName(added.join(roots.select("tid"), "tid", "left_anti")), "omh-roots")
        return fresh if done is None else done.unionByName(fresh), roots

    for _ in range(HUBS):
        done, roots = compared(members.select("hub", "tid", "hub_size", "size").distinct(), roots, done)
        judged = _rooted(_rooted(members.drop("root", "hub_root").join(done, ["hub", "tid"]), roots, "tid", "root"), roots, "hub", "hub_root")
        judged = judged.withColumns({"near": 1 - F.col("bound"), "far": 1 - F.col("similarity")})  # the distance to the hub lies between
        apart = F.col("root") != F.col("hub_root")
        closest = judged.where(apart).groupBy("key").agg(F.min("near").alias("closest"))
        active = judged.join(closest, "key").where(apart | (F.col("closest") - F.col("far") <= reach))
        before, members = members.count(), settle(_stars(active.select("key", "tid", "size", "root")), "omh-group")
        if not members.limit(1).count():
            return roots
        if 2 * members.count() > before:
            break
    rest = members.select("tid", "size").unionByName(members.select(F.col("hub").alias("tid"), F.col("hub_size").alias("size")))
    rare = _rare_labels(settle(rest.distinct(), "omh-rest"), content, similarity)
    width = MEETINGS
    while True:
        found = _open_labels(rare, roots)
        stray = F.when(F.col("root") != F.col("main"), F.col("texts"))
        most, meetings, texts = found.agg(F.coalesce(F.max("texts"), F.lit(0)), F.coalesce(F.sum(stray), F.lit(0)), F.count_distinct("tid")).first()
        if meetings <= MEETINGS * MEETINGS * texts:
            width = max(width, most)
        done, roots = compared(_crossed(found, similarity, width), roots, done)
        if width >= most:
            return roots
        width *= MEETINGS


def near_duplicates(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(doc_id, tid, root, class_id) for each row of docs(doc_id, text): class_id is the least doc_id of its near-duplicates.

    Words are lower-case runs of letters and digits. Equal word sequences are one text, whatever its number of copies; a text of
    fewer than five words, null and empty included, has no others beside its equals. Links are transitive. Repeated rows
    and equal or null doc_ids are allowed (a class of null ids only has a null class_id). Empty table: no rows. Other columns are ignored.
    """
    rows = settle(sketched(docs), "omh-rows")
    texts = settle(rows.groupBy("tid").agg(F.min("doc_id").alias("first"), F.max("size").alias("size"), F.first("keys").alias("keys")), "omh-texts")

    def labels(wanted: DataFrame) -> DataFrame:
        firsts = texts.join(wanted, "tid", "left_semi").select(
            F.col("tid").alias("want"), F.coalesce("first", F.lit(-(1 << 63))).alias("first"))
        ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        picked = ids.join(_few(settle(firsts.select("first").distinct(), "omh-firsts")), F.coalesce("doc_id", F.lit(-(1 << 63))) == F.col("first"), "left_semi")
        chosen = _tokens(picked).join(_few(settle(firsts.select("want").distinct(), "omh-wants")), F.col("tid") == F.col("want"), "left_semi")
        return settle(chosen.select("tid", "words").mapInArrow(_label, "tid binary, labels binary").dropDuplicates(["tid"]), "omh-labels")

    roots = near_classes(texts, labels, similarity)
    named = texts.select("tid", "first").join(roots, "tid", "left").withColumn("root", F.coalesce("root", "tid"))
    least = named.groupBy("root").agg(F.min("first").alias("class_id"))
    classes = settle(named.join(least, "root").select("tid", "root", "class_id"), "omh-classes")
    return rows.select("doc_id", "tid").join(classes, "tid")


def deduplicated(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """One row of ``docs`` for each class of near-duplicates, one with the least doc_id; all columns as they are.

    Where that doc_id has several rows, the one whose words have the least digest stays, and one of equal rows.
    """
    least = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    classes = settle(near_duplicates(docs, similarity).withColumn("id", least), "omh-members")
    kept = classes.groupBy("root").agg(F.min(F.struct("id", "tid")).alias("k")).select("k.id", "k.tid")
    counts = classes.groupBy("id").agg(F.count("*").alias("n"))
    kept = settle(kept.join(counts, "id"), "omh-kept").withColumnsRenamed({"id": "_omh_id", "tid": "_omh_tid", "n": "_omh_n"})
    single = docs.join(_few(kept.where("_omh_n = 1").select("_omh_id")), least == F.col("_omh_id"), "left_semi")
    repeated = docs.withColumn("_omh_row", F.unhex(F.md5(F.array_join(plain_words(body()), " ")))).join(
        _few(kept.where("_omh_n > 1")), (least == F.col("_omh_id")) & (F.col("_omh_row") == F.col("_omh_tid"))
    ).dropDuplicates(["_omh_id", "_omh_tid"])
    return single.unionByName(repeated.select(*docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")
