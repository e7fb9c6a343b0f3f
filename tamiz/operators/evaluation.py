"""Model comparison: preparation, scaling, stratified split, metrics, forest, ranking."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..session import settle
from .knn import knn_classify

MAX_FEATURES = 10_000


def prepare_training_table(history: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(id, y, vector): features MAP -> fixed-order vector, missing values 0.

    ``names`` is the feature list; without one it is every key seen, in alphabetical order.
    """
    names = feature_keys(history) if names is None else names
    value = [F.coalesce(F.try_element_at("features", F.lit(n)), F.lit(0.0)) for n in names]
    y = F.array_position(F.array(*[F.lit(x) for x in C.LABELS]), F.col("classification"))
    kept = [c for c in history.columns if c not in ("features", "classification")]
    return history.where(F.col("classification").isin(*C.LABELS)).select(
        *kept, (y - 1).cast("int").alias("y"),
        F.array(*value).cast("array<double>").alias("vector"))


def feature_keys(history: DataFrame) -> list[str]:
    """Distinct feature names, sorted; more than MAX_FEATURES are refused, for they are no features then."""
    keys = history.select(F.explode(F.map_keys("features")).alias("k")).distinct().limit(MAX_FEATURES + 1)
    names = sorted(r["k"] for r in keys.collect())
    if len(names) > MAX_FEATURES:
        raise ValueError(f"more than {MAX_FEATURES} feature names; pass the list")
    return names


def fit_scaler(table: DataFrame, width: int, vector: str = "vector") -> tuple[list, list]:
    """Mean and population deviation of each position, in one aggregation (0 becomes 1)."""
    stats = []
    for i in range(width):
        x = F.col(vector)[i].cast("double")
        stats += [F.avg(x), F.stddev_pop(x)]
    row = table.agg(*stats).first()
    means, devs = list(row[0::2]), list(row[1::2])
    return means, [d if d else 1.0 for d in devs]


def scale(vector: Column, fitted: tuple[list, list]) -> Column:
    """z-scored vector."""
    means, devs = fitted
    return F.array(*[(vector[i].cast("double") - F.lit(m)) / F.lit(d)
                     for i, (m, d) in enumerate(zip(means, devs))])


def stratified_split(table: DataFrame, id_col: str, y_col: str, test_share: float = 0.2,
                     seed: int = 42, digits: int = 4) -> DataFrame:
    """Add ``is_test``: the first ``test_share`` of every class in hash order of the id.

    Exact and reproducible.  A class is never ordered as a whole: counts of hash-prefix ranges say in
    which range its cut lies, and only that range's ids are numbered.  What the rows themselves are joined with is one cut
    (hash, id) per class, so their vectors are not shuffled.
    """
    hash_ = F.md5(F.concat_ws("-", F.col(id_col).cast("string"), F.lit(str(seed))))
    ids = table.select(F.col(y_col).alias("_y"), hash_.alias("_h"), F.col(id_col).alias("_id")).withColumn(
        "_p", F.substring("_h", 1, digits))
    ranges = ids.groupBy("_y", "_p").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("_y")
    earlier = whole.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select(
        "_y", "_p", "_n", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.round(F.sum("_n").over(whole) * test_share, 0).alias("_cut"))
    last = offsets.where("_before < _cut AND _before + _n >= _cut").select(
        "_y", "_p", (F.col("_cut") - F.col("_before")).alias("_left"))
    inside = Window.partitionBy("_y", "_p").orderBy("_h", "_id")
    numbered = ids.join(last, ["_y", "_p"]).withColumn("_rn", F.row_number().over(inside))
    cuts = settle(numbered.where("_rn = _left").select("_y", F.col("_h").alias("_cut_h"), F.col("_id").alias("_cut_id")), "cuts")
    upto = F.struct(hash_.alias("h"), F.col(id_col).alias("i")) <= F.struct(F.col("_cut_h").alias("h"), F.col("_cut_id").alias("i"))
    return table.join(cuts, F.col(y_col) == F.col("_y"), "left").withColumn(
        "is_test", F.coalesce(upto, F.lit(False))).drop("_y", "_cut_h", "_cut_id")


def confusion_counts(predictions: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """(y, pred, n) long form."""
    return predictions.groupBy(F.col(y).alias("y"), F.col(pred).alias("pred")).agg(
        F.count(F.lit(1)).alias("n"))


def confusion_matrix(predictions: DataFrame, classes: list, y: str = "y",
                     pred: str = "pred") -> DataFrame:
    """One row per true class, one column per predicted class."""
    return predictions.groupBy(F.col(y).alias("y")).pivot(pred, classes).count().na.fill(0)


def classification_metrics(predictions: DataFrame, y: str = "y",
                           pred: str = "pred") -> DataFrame:
    """One row: accuracy and support-weighted precision, recall, F1 (0 where undefined)."""
    cells = confusion_counts(predictions, y, pred)
    # Every cell counts once for its true and once for its predicted class.
    sides = F.array(
        F.struct(F.col("y").alias("c"), F.col("n").alias("support"),
                 F.lit(0).cast("long").alias("predicted"),
                 F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0).alias("hits")),
        F.struct(F.col("pred").alias("c"), F.lit(0).cast("long").alias("support"),
                 F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hits")))
    per_class = cells.select(F.inline(sides)).groupBy("c").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"),
        F.sum("hits").alias("hits"))
    zero = F.lit(0.0)
    precision = F.coalesce(F.try_divide(F.col("hits"), F.col("predicted")), zero)
    recall = F.coalesce(F.try_divide(F.col("hits"), F.col("support")), zero)
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), zero)

    def weighted(c):
        return F.sum(c * F.col("support")) / F.sum("support")

    return per_class.agg(
        (F.sum("hits") / F.sum("support")).alias("accuracy"),
        weighted(precision).alias("precision"), weighted(recall).alias("recall"),
        weighted(f1).alias("f1"))


def roc_auc_ovr(scored: DataFrame, n_classes: int, y: str = "y", proba: str = "proba",
                ranges: int = 1000) -> DataFrame:
    """One row: macro one-vs-rest area under the curve.

    Rows are first counted per class and distinct score.  Positions in the ranking come from
    range totals plus a running sum inside each score range, so no class is ranked in one task.
    """
    per_class = F.array(*[F.struct(
        F.lit(c).alias("c"), F.col(proba)[c].alias("s"),
        (F.col(y) == c).cast("int").alias("pos")) for c in range(n_classes)])
    counts = scored.select(F.inline(per_class)).groupBy("c", "s").agg(
        F.sum("pos").alias("p"), F.sum(1 - F.col("pos")).alias("n")
    ).withColumn("r", F.floor(F.col("s") * ranges))
    totals = counts.groupBy("c", "r").agg(F.sum("n").alias("rn"))
    below = Window.partitionBy("c").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("base", F.coalesce(F.sum("rn").over(below), F.lit(0)))
    inside = Window.partitionBy("c", "r").orderBy("s").rowsBetween(
        Window.unboundedPreceding, -1)
    placed = counts.withColumn("under", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(
        totals.drop("rn"), ["c", "r"])
    pairs = F.col("p") * (F.col("base") + F.col("under") + F.col("n") / 2)
    auc = placed.groupBy("c").agg(
        F.try_divide(F.sum(pairs), F.sum("p") * F.sum("n")).alias("auc"))
    return auc.agg(F.avg("auc").alias("roc_auc"))


def evaluate(name: str, predictions: DataFrame, n_classes: int) -> DataFrame:
    """(model, accuracy, precision, recall, f1, roc_auc) of rows (y, pred, proba)."""
    predictions = settle(predictions, "predictions")  # read twice below, computed once
    metrics = classification_metrics(predictions).withColumn("model", F.lit(name))
    auc = roc_auc_ovr(predictions, n_classes).withColumn("model", F.lit(name))
    return metrics.join(auc, "model").select(
        "model", "accuracy", "precision", "recall", "f1", "roc_auc")


def knn_uniform(split: DataFrame, id_col: str, n_classes: int, k: int = 5) -> DataFrame:
    """(id, y, pred, proba) of the test rows under uniform votes of the training rows."""
    train = split.where(~F.col("is_test")).select(
        F.col(id_col).alias("seq"), "vector", F.col("y").alias("label"))
    test = split.where("is_test").select(F.col(id_col).alias("id"), "vector", "y")
    voted = knn_classify(test, train, k, "uniform", n_classes)
    return voted.join(test.select("id", "y"), "id").select(
        "id", "y", F.col("label").alias("pred"), "proba")


def _on_all_cores(df: DataFrame) -> DataFrame:
    """Narrow rows are stored in few files; a fit passes over them once for every level of its trees, so no core may lack a share."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def random_forest(split: DataFrame, id_col: str, n_classes: int, trees: int = 100,
                  depth: int = 15, seed: int = 42):
    """(model, predictions) of a class-balanced forest; predictions as in ``knn_uniform``."""
    train = split.where(~F.col("is_test"))
    sizes = {r["y"]: r["count"] for r in train.groupBy("y").count().collect()}
    total = sum(sizes.values())
    weight = F.lit(0.0)
    for label, n in sizes.items():
        weight = F.when(F.col("y") == label, total / (len(sizes) * n)).otherwise(weight)
    learner = RandomForestClassifier(
        featuresCol="x", labelCol="label", weightCol="w", numTrees=trees, maxDepth=depth,
        seed=seed, featureSubsetStrategy="sqrt")
    labelled = train.select(array_to_vector("vector").alias("x"),
                            F.col("y").cast("double").alias("label"), weight.alias("w"))
    model = learner.fit(_on_all_cores(labelled))
    test = split.where("is_test").select(
        F.col(id_col).alias("id"), "y", array_to_vector("vector").alias("x"))
    predictions = model.transform(_on_all_cores(test)).select(
        "id", "y", F.col("prediction").cast("int").alias("pred"),
        vector_to_array("probability").alias("proba"))
    return model, predictions


def feature_importance(model, names: list[str], spark, top: int = 10) -> DataFrame:
    """(feature, importance), largest first."""
    rows = list(zip(names, [float(x) for x in model.featureImportances.toArray()]))
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature").limit(top)


def compare_models(results: list[DataFrame]) -> DataFrame:
    """Stacked metric rows with ``is_best`` for the highest F1."""
    stacked = results[0]
    for r in results[1:]:
        stacked = stacked.unionByName(r)
    best = F.max_by("model", "f1").over(Window.partitionBy(F.lit(1)))
    return stacked.withColumn("is_best", F.col("model") == best)


def class_distribution(history: DataFrame, label: str = "classification") -> DataFrame:
    """(classification, count), largest first."""
    return history.groupBy(F.col(label).alias("classification")).agg(
        F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "classification")
