"""Toxicity by a classifier chain.

Categories are predicted one after the other by sparse linear models over hashed word and word-beginning features; each later model
also sees the probabilities of the earlier categories. It is trained on out-of-fold predictions of them, so that what it learns about an
earlier category has the errors that category will have on unseen text. The words that define a category are hidden from its own model
and the one beside it, which so learn what surrounds them; the last model sees every word.

The whole chain is fitted in one task to a bounded sample of the labelled documents; scoring reads all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.llm.common import body, table

#: Labelled documents used for training, about; chosen by hash where there are more.
MAX_LABELLED = 10_000
#: Width of the hashed features.
WIDTH = 1 << 17
FOLDS = 3
#: Documents to a step of the fit, passes over them, steps at least, and what a feature must gather before it counts, to the
#: square root of the positive documents.
BATCH, EPOCHS, STEPS, SPARSITY = 32, 3, 400, 0.5
#: Words that make a toxic document one of a category. Abuse of a person, and contempt.
CATEGORY_WORDS = {
    "insult": ["idiot", "moron", "loser", "clown", "stupid", "fool", "imbecile", "dumb", "dummkopf", "trottel", "idiota", "imbécil", "estúpido", "imbécile", "crétin"],
    "contempt": ["trash", "scum", "worthless", "pathetic", "disgusting", "vile", "filth", "garbage", "abschaum", "widerlich", "basura", "asqueroso", "ordure", "minable"],
}


def _words(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+")), lambda w: w != "")


def features(words: Column) -> Column:
    """Hashes of distinct words and of the first three to five letters of longer ones."""
    def hashed(mark: str, w: Column) -> Column:
        return F.pmod(F.hash(F.lit(mark), w), F.lit(WIDTH)).cast("int")

    def starts(n: int) -> Column:
        return F.transform(F.filter(words, lambda w: F.length(w) > n), lambda w: hashed("^", F.substring(w, 1, n)))

    return F.array_distinct(F.concat(F.transform(words, lambda w: hashed("", w)), starts(3), starts(4), starts(5)))


def labelled_categories(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, insult, contempt, toxic) of documents with a toxic label, at most about MAX_LABELLED.

    A toxic document belongs to a category if it holds one of its words. Labels that contradict each other count as toxic.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, MAX_LABELLED / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = docs.select("doc_id", body().alias("text")).join(F.broadcast(known), "doc_id")  # bounded by MAX_LABELLED
    words = _words(F.col("text"))
    marks = [
        F.when((F.col("toxic") > 0) & F.arrays_overlap(words, F.array(*map(F.lit, listed))), 1.0).otherwise(0.0).alias(name)
        for name, listed in CATEGORY_WORDS.items()
    ]
    return rows.select("doc_id", "text", *marks, (F.col("toxic") > 0).cast("double").alias("toxic"))


class Features:
    """Feature numbers of many documents, one after the other, and where each document begins."""

    def __init__(self, column: pa.Array):
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        self.ids = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.empty(0, np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])

    def __len__(self) -> int:
        return len(self.sizes)

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(feature numbers, place of their document in ``rows``)."""
        sizes = self.sizes[rows]
        within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return self.ids[np.repeat(self.starts[rows], sizes) + within], np.repeat(np.arange(len(rows)), sizes)


class Link:
    """One model of the chain: weights of the features, then of the earlier probabilities, then the bias."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def probability(self, found: Features, rows: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        ids, at = found.of(rows)
        z = np.bincount(at, self.weights[ids], len(rows)) + earlier @ self.weights[WIDTH:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_link(found: Features, rows: np.ndarray, y: np.ndarray, earlier: np.ndarray, hidden: np.ndarray) -> Link:
    """Logistic regression by FTRL steps: each weight has its own rate, and weights that gather little stay zero.

    ``y`` and ``earlier`` belong to all documents, ``rows`` are the ones to fit. With one class the probability is that class's.
    """
    width = WIDTH + earlier.shape[1] + 1
    weights, seen = np.zeros(width), y[rows]
    if not len(rows) or seen.min() == seen.max():
        weights[-1] = 30.0 if len(rows) and seen[0] else -30.0
        return Link(weights)
    heavy = ((seen == 0).sum() / (seen == 1).sum()) ** 0.5
    sums, squares, rng = np.zeros(width), np.zeros(width), np.random.default_rng(5)
    sparsity = np.full(width, SPARSITY * (seen == 1).sum() ** 0.5)
    sparsity[WIDTH:] = 0.0
    batches = max(1, len(rows) // BATCH)
    for _ in range(max(EPOCHS, -(-STEPS // batches))):
        for part in np.array_split(rng.permutation(rows), batches):
            ids, at = found.of(part)
            z = np.bincount(at, weights[ids], len(part)) + earlier[part] @ weights[WIDTH:-1] + weights[-1]
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) * np.where(y[part] > 0, heavy, 1.0)
            gradient = np.bincount(ids, error[at], width)
            gradient[hidden] = 0.0
            gradient[WIDTH:] = [*(error @ earlier[part]), error.sum()]
            moved = np.flatnonzero(gradient)
            step, old = gradient[moved], squares[moved]
            squares[moved] = old + step * step
            sums[moved] += step - (np.sqrt(squares[moved]) - np.sqrt(old)) / 0.1 * weights[moved]
            held = np.maximum(np.abs(sums[moved]) - sparsity[moved], 0.0)
            weights[moved] = -np.sign(sums[moved]) * held / ((1.0 + np.sqrt(squares[moved])) / 0.1)
    return Link(weights)


class Chain:
    """Fitted links by category, in order."""

    def __init__(self, links: list[tuple[str, Link]]):
        self.links = links

    def probabilities(self, found: Features) -> np.ndarray:
        """A column a category; documents without words get 0."""
        rows, out = np.arange(len(found)), np.zeros((len(found), 0))
        for _, link in self.links:
            out = np.column_stack([out, link.probability(found, rows, out)])
        out[found.sizes == 0] = 0.0
        return out

    def score(self, text: Column) -> Column:
        """A struct of p_<category> for a text."""
        names = [f"p_{name}" for name, _ in self.links]

        @F.arrow_udf(", ".join(f"{name} double" for name in names))
        def scored(ids: pa.Array) -> pa.Array:
            p = self.probabilities(Features(ids))
            return pa.StructArray.from_arrays([pa.array(p[:, k]) for k in range(len(names))], names=names)

        return scored(features(_words(text)))


def fit_chain(found: Features, labels: dict[str, np.ndarray], fold: np.ndarray, hidden: dict[str, np.ndarray]) -> Chain:
    """Fits the links in turn; a later link sees, of the earlier ones, what models of the other folds say about a document."""
    rows, earlier, links = np.arange(len(found)), np.zeros((len(found), 0)), []
    for k, (name, y) in enumerate(labels.items()):
        links.append((name, fit_link(found, rows, y, earlier, hidden[name])))
        if k < len(labels) - 1:
            unseen = np.zeros(len(found))
            for f in range(FOLDS):
                out = rows[fold == f]
                unseen[out] = fit_link(found, rows[fold != f], y, earlier, hidden[name]).probability(found, out, earlier[out])
            earlier = np.column_stack([earlier, unseen])
    return Chain(links)


def fitted(rows: DataFrame, categories: list[str]) -> Chain:
    """The chain for rows(doc_id, text, <categories> 0.0 or 1.0), a bounded table that one task fits. No rows: all probabilities are 0."""
    words = F.array(*[F.lit(w) for listed in CATEGORY_WORDS.values() for w in listed])
    sample = rows.select(
        F.lit(0).alias("one"), "doc_id", features(_words(F.col("text"))).alias("ids"), F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold"),
        features(words).alias("listed"), *categories)

    def fit(key: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by([("doc_id", "ascending"), *[(c, "ascending") for c in categories]])
        listed, none = np.unique(part["listed"][0].values.to_numpy(zero_copy_only=False)), np.empty(0, np.int64)
        labels = {c: part[c].to_numpy() for c in categories}
        chain = fit_chain(Features(part["ids"]), labels, part["fold"].to_numpy(), {c: listed if c in CATEGORY_WORDS else none for c in categories})
        kept = [np.flatnonzero(link.weights) for _, link in chain.links]
        return pa.table({
            "category": pa.array([n for n, _ in chain.links]), "width": pa.array([len(x.weights) for _, x in chain.links], pa.int32()),
            "places": pa.array([k for k in kept], pa.list_(pa.int64())),
            "weights": pa.array([x.weights[k] for (_, x), k in zip(chain.links, kept)], pa.list_(pa.float64()))})

    found = sample.groupBy("one").applyInArrow(fit, "category string, width int, places array<long>, weights array<double>")
    models = {r["category"]: r for r in found.collect()}  # weights that are not zero, WIDTH at most
    links = []
    for k, name in enumerate(categories):
        weights = np.zeros(WIDTH + k + 1)
        if name in models:
            weights[models[name]["places"]] = models[name]["weights"]
        else:
            weights[-1] = -np.inf
        links.append((name, Link(weights)))
    return Chain(links)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, p_insult, p_contempt, p_toxic, toxic) for each row of docs(doc_id, text); toxic: p_toxic >= threshold.

    labels(doc_id, toxic) covers some documents. Texts without words, null and empty included, get
    probability 0; very long texts are read whole. Without labels, or with one class only, probabilities are that class's. Repeated rows
    are scored alike; empty table: no rows; other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    chain = fitted(labelled_categories(docs, labels), [*CATEGORY_WORDS, "toxic"])
    return docs.select("doc_id", chain.score(body()).alias("p")).select(
        "doc_id", "p.*", (F.col("p.p_toxic") >= threshold).alias("toxic"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the chain does not find toxic; all columns as they are."""
    chain = fitted(labelled_categories(docs.select("doc_id", "text"), labels), [*CATEGORY_WORDS, "toxic"])
    packed = docs.select(F.struct(*docs.columns).alias("row"), chain.score(body()).alias("p"))
    return packed.where(F.col("p.p_toxic") < threshold).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
