"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document. Expectation-maximisation estimates each labeller's
accuracy without any truth, from the counts of vote patterns; the posterior of a pattern is the label of its documents. A linear
model over hashed word shapes learns these labels and scores all documents of ten words or more. Shorter texts keep their posterior
as score, and no labeller votes bad on them; a text without words scores 0.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.llm.common import SPACE, body, spaced_words, table
from tamiz.session import settle

#: Documents the scorer is fitted to, about; chosen by hash where there are more.
MAX_FITTED = 8000
#: Hash buckets of word shapes.
BUCKETS = 1 << 12


def _counts(docs: DataFrame) -> DataFrame:
    text = F.col("_text")
    lines = F.filter(F.split(text, "\n"), lambda line: line != "")

    def number(pattern: str) -> Column:
        return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))

    df = docs.withColumn("_text", body()).withColumn("_lines", lines).withColumn("_words", spaced_words(text))
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\p{Lu}+", "A"), r"\p{Ll}+", "a"), "[0-9]+", "0")
    next_word = F.slice("_words", F.lit(2), F.greatest(F.size("_words"), F.lit(1)))
    df = df.withColumn("_again", F.size(F.filter(F.zip_with("_words", next_word, lambda a, b: a == b), lambda same: same)))
    return df.select(
        *[c for c in docs.columns if c != "text"],
        F.size("_words").alias("n"), F.size(F.array_distinct("_words")).alias("other_words"), F.col("_again").alias("again"),
        number(r"[#*$%&|<>{}\\^~]+").alias("symbols"),
        number(r"\p{Lu}+").alias("capitals"), number(r"\p{L}+").alias("letters"), number("!+").alias("shouts"),
        F.regexp_count(text, F.lit(r"(?<!\S)\p{L}{1,3}(?!\S)")).alias("short"), F.regexp_count(text, F.lit(r"\p{L}[.,;:?](?!\S)")).alias("stops"),
        F.size("_lines").alias("lines"), F.size(F.array_distinct("_lines")).alias("other_lines"),
        # A repeated word is a shape of its own.
        F.concat(F.filter(F.split(shape, SPACE), lambda w: w != ""), F.array_repeat(F.lit("again"), F.col("_again"))).alias("shapes"),
    )


def _vote(good: Column, bad: Column) -> Column:
    """Short texts say too little to be found bad."""
    return F.when(bad & (F.col("n") >= 10), 2).when(good & (F.col("n") > 0), 1).otherwise(0)


def labellers() -> dict[str, Column]:
    """Each labeller's vote: 0 none, 1 good, 2 bad."""
    n, c = F.col("n"), F.col
    return {
        "symbols": _vote(c("symbols") * 50 <= n, c("symbols") * 5 > n),
        "capitals": _vote(c("capitals") * 6 <= c("letters"), c("capitals") * 2 > c("letters")),
        "shouting": _vote(c("shouts") * 50 <= n, c("shouts") * 5 > n),
        "short_words": _vote(c("short") * 6 >= n, c("short") * 20 < n),
        "word_length": _vote(c("letters").between(3 * n, 7 * n), (c("letters") > 9 * n) | (c("letters") < 2 * n)),
        "punctuation": _vote(c("stops").between(n / 50, n / 3), (n >= 20) & (c("stops") * 200 < n)),
        "repetition": _vote((c("lines") >= 3) & (c("lines") == c("other_lines")), (c("lines") - c("other_lines")) * 3 > c("lines")),
        "stutter": _vote(c("again") * 50 <= n, c("again") * 5 > n),
        "variety": _vote(c("other_words") * 5 >= n * 2, c("other_words") * 10 < n),
    }


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior good per pattern, tables[labeller, class, vote], prior good) by expectation-maximisation.

    A labeller's votes are independent given the class; a missing vote tells nothing. Starts from the majority.
    """
    good, bad = (patterns == 1).sum(1), (patterns == 2).sum(1)
    posterior = np.clip((good + 1.0) / (good + bad * 2 + 2.0), 0.05, 0.95)
    votes = (patterns[:, :, None] == np.arange(3)) & (np.arange(3) > 0)
    for _ in range(rounds):
        both = np.stack([posterior, 1 - posterior]) * counts
        tables = np.einsum("cp,plv->lcv", both, votes) + np.array([0.0, 1.0, 1.0])
        tables /= tables.sum(2, keepdims=True)
        prior = (both.sum(1) + 1.0) / (both.sum() + 2.0)
        logs = np.log(prior)[:, None] + np.einsum("plv,lcv->cp", votes, np.log(np.maximum(tables, 1e-12)))
        fresh = 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -500, 500)))
        moved = np.abs(fresh - posterior).max()
        posterior = fresh
        if moved < 1e-9:
            break
    return posterior, tables, float(prior[0])


def weak_labels(voted: DataFrame, names: list[str]) -> tuple[DataFrame, dict[str, float]]:
    """((pattern, posterior), accuracy per labeller) from rows with vote columns ``names`` and ``pattern``.

    There are 3 ** labellers patterns at most, whatever the number of documents: their counts go to the driver.
    """
    rows = voted.groupBy("pattern", *names).count().orderBy("pattern").collect()
    spark = voted.sparkSession
    if not rows:
        return spark.createDataFrame([], "pattern long, posterior double"), {}
    patterns = np.array([[r[n] for n in names] for r in rows])
    counts = np.array([r["count"] for r in rows], float)
    posterior, tables, prior = estimate(patterns, counts)
    right = prior * tables[:, 0, 1] + (1 - prior) * tables[:, 1, 2]
    wrong = prior * tables[:, 0, 2] + (1 - prior) * tables[:, 1, 1]
    labels = spark.createDataFrame([(r["pattern"], float(p)) for r, p in zip(rows, posterior)], "pattern long, posterior double")
    return labels, {n: float(a / (a + b)) for n, a, b in zip(names, right, wrong)}


def weak_quality(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, posterior, score, kept) for each row of docs(doc_id, text); kept: score >= threshold.

    posterior is the weak label, score the linear model's probability that the document is good. Null is the empty
    text; texts without words have no shapes and are not kept. If all weak labels fall on one side, the score is
    the posterior. Repeated rows are scored alike; empty table: no rows; other columns are ignored.
    """
    votes = labellers()
    code = sum((F.col(name) * 3 ** k for k, name in enumerate(votes)), F.lit(0)).cast("long")
    hashing = HashingTF(inputCol="shapes", outputCol="raw", numFeatures=BUCKETS)
    counted = _counts(docs.select("doc_id", "text")).select("doc_id", "n", "shapes", *[v.alias(k) for k, v in votes.items()])
    hashed = Normalizer(inputCol="raw", outputCol="features", p=2.0).transform(hashing.transform(counted))
    voted = settle(hashed.select("doc_id", "n", "features", *votes, code.alias("pattern")), "weak-votes")
    labels, _ = weak_labels(voted, list(votes))
    rows = voted.join(F.broadcast(labels), "pattern")  # 3 ** 9 rows at most
    share = min(1.0, MAX_FITTED / max(1, voted.count()))
    chosen = rows.where((F.col("n") > 0) & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))))
    sides = F.explode(F.array(
        F.struct(F.lit(1.0).alias("label"), F.col("posterior").alias("weight")),
        F.struct(F.lit(0.0).alias("label"), (1 - F.col("posterior")).alias("weight"))))
    sample = settle(chosen.select("features", sides.alias("s")).select("features", "s.*").where("weight > 1e-6").coalesce(4), "weak-sample")
    if sample.select("label").distinct().count() < 2:
        scored = rows.withColumn("score", F.col("posterior"))
    else:
        model = LogisticRegression(
            labelCol="label", weightCol="weight", regParam=1e-6, maxIter=80, standardization=False,
            probabilityCol="probability", rawPredictionCol="margin", predictionCol="class").fit(sample)
        scored = model.transform(rows).withColumn("score", vector_to_array("probability")[1])
    # Of few words only the weak label knows anything.
    score = F.when(F.col("n") == 0, 0.0).when(F.col("n") < 10, F.col("posterior")).otherwise(F.col("score"))
    return scored.select("doc_id", "posterior", score.alias("score"), (score >= threshold).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_quality(table(spark, sf_dir, "documents"))
