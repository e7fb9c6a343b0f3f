"""Neighbour votes, model bookkeeping and model comparison on ``embeddings``, ``events``, ``labels``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamiz import constants as C
from tamiz.config import DEFAULT
from tamiz.operators import evaluation as EV
from tamiz.operators import knn, parsing
from tamiz.operators import training as TR
from tamiz.operators.metric_index import index_neighbours
from tamiz.plans import triage as TG
from tamiz.session import settle
from tamiz.sources import readers

from . import derived as D
from .closed_form import derived
from .registry import query
from .report_queries import whitelist

CLASSES, WIDTH = 10, 64


def embeddings(spark, sf) -> DataFrame:
    return D.table(spark, sf, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("vector"),
        F.col("label").cast("int").alias("y"))


def split(spark, sf) -> DataFrame:
    return settle(EV.stratified_split(embeddings(spark, sf), "vec_id", "y"), "split")


# The split, and the exact neighbours of every test row, in SQL.
_SPLIT = """
s0 AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, CAST(label AS INT) AS y,
  md5(CAST(vec_id AS VARCHAR) || '-42') AS h FROM embeddings),
s AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY h, vec_id)
    <= round(count(*) OVER (PARTITION BY y) * 0.2::DOUBLE, 0) AS is_test FROM s0)"""
_NEAR = _SPLIT + """,
n0 AS (SELECT q.vec_id AS id, q.y, t.vec_id AS seq, t.y AS label, list_distance(q.v, t.v) AS dist
  FROM s q JOIN s t ON q.is_test AND NOT t.is_test),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, seq) AS rank FROM n0) WHERE rank <= 5)"""
_UNIFORM = _NEAR + """,
u0 AS (SELECT id, y, label, count(*) AS votes FROM n GROUP BY ALL),
u AS (SELECT id, y, label AS pred FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY votes DESC, label) AS r FROM u0) WHERE r = 1)"""


@query("stratified_split", f"WITH {_SPLIT} SELECT vec_id, y, CAST(is_test AS INT) AS is_test FROM s")
def stratified_split(spark, sf):
    return EV.stratified_split(embeddings(spark, sf), "vec_id", "y").select(
        "vec_id", "y", F.col("is_test").cast("int").alias("is_test"))


def _sides(spark, sf):
    s = split(spark, sf)
    train = s.where("NOT is_test").select(
        F.col("vec_id").alias("seq"), "vector", F.col("y").alias("label"))
    return s.where("is_test").select(F.col("vec_id").alias("id"), "vector"), train


@query("knn_neighbours", f"WITH {_NEAR} SELECT id, seq, label, round(dist, 6) AS dist, CAST(rank AS INT) AS rank FROM n")
def knn_neighbours(spark, sf):
    """The block join: what is used when the training side cannot be broadcast."""
    test, train = _sides(spark, sf)
    return knn.knn_neighbours(test, train, block_rows=200).select(
        "id", "seq", "label", F.round("dist", 6).alias("dist"), "rank")


@query("knn_index_neighbours", f"WITH {_NEAR} SELECT id, seq, label, round(dist, 6) AS dist, CAST(rank AS INT) AS rank FROM n")
def knn_index_neighbours(spark, sf):
    """The same through the index of cells."""
    test, train = _sides(spark, sf)
    return index_neighbours(test, train, block_rows=200).select(
        "id", "seq", "label", F.round("dist", 6).alias("dist"), "rank")


_WEIGHTED = _NEAR + """,
w0 AS (SELECT id, label, CASE WHEN min(dist) OVER (PARTITION BY id) = 0 THEN (dist = 0)::INT::DOUBLE ELSE 1 / dist END AS w FROM n),
w1 AS (SELECT id, label, sum(w) / sum(sum(w)) OVER (PARTITION BY id) AS p FROM w0 GROUP BY id, label),
w2 AS (SELECT id, label, round(p, 4) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(p, 12) DESC, label) AS r FROM w1) WHERE r = 1)"""


@query("knn_classify", f"WITH {_WEIGHTED} SELECT id, CAST(label AS INT) AS label, confidence FROM w2")
def knn_classify(spark, sf):
    test, train = _sides(spark, sf)
    return knn.knn_classify(test, train, 5, "distance", CLASSES).select(
        "id", "label", F.round("confidence", 4).alias("confidence"))


@query("knn_block_vote", f"WITH {_WEIGHTED} SELECT id, CAST(label AS INT) AS label, confidence FROM w2")
def knn_block_vote(spark, sf):
    test, train = _sides(spark, sf)
    near = knn.knn_neighbours(test, train, block_rows=200)
    return knn.vote_neighbours(near, "distance", CLASSES).select(
        "id", "label", F.round("confidence", 4).alias("confidence"))


@query("knn_uniform", f"WITH {_UNIFORM} SELECT id, y, CAST(pred AS INT) AS pred FROM u")
def knn_uniform(spark, sf):
    return EV.knn_uniform(split(spark, sf), "vec_id", CLASSES).select("id", "y", "pred")


_METRICS = """
k AS (SELECT c, count(*) FILTER (WHERE y = c) AS sup, count(*) FILTER (WHERE pred = c) AS prd,
  count(*) FILTER (WHERE y = c AND pred = c) AS hit FROM u, (SELECT DISTINCT y AS c FROM u UNION SELECT DISTINCT pred FROM u) GROUP BY c),
k1 AS (SELECT *, CASE WHEN prd = 0 THEN 0.0 ELSE hit::DOUBLE / prd END AS p, CASE WHEN sup = 0 THEN 0.0 ELSE hit::DOUBLE / sup END AS r FROM k),
k2 AS (SELECT *, CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS f FROM k1),
m AS (SELECT round(sum(hit)::DOUBLE / sum(sup), 6) AS accuracy, round(sum(p * sup) / sum(sup), 6) AS "precision",
  round(sum(r * sup) / sum(sup), 6) AS recall, round(sum(f * sup) / sum(sup), 6) AS f1 FROM k2)"""


@query("classification_metrics", f"WITH {_UNIFORM},{_METRICS} SELECT * FROM m")
def classification_metrics(spark, sf):
    p = EV.knn_uniform(split(spark, sf), "vec_id", CLASSES)
    m = EV.classification_metrics(p)
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


_AUC = """
a0 AS (SELECT i.id, i.y, c.c, coalesce(v.votes, 0) / 5.0::DOUBLE AS s, (i.y = c.c)::INT AS pos
  FROM (SELECT DISTINCT id, y FROM n) i CROSS JOIN (SELECT unnest(range(10)) AS c) c LEFT JOIN u0 v ON v.id = i.id AND v.label = c.c),
a1 AS (SELECT *, rank() OVER (PARTITION BY c ORDER BY s) + (count(*) OVER (PARTITION BY c, s) - 1) / 2.0::DOUBLE AS rk FROM a0),
a2 AS (SELECT c, (sum(rk * pos) - sum(pos) * (sum(pos) + 1) / 2.0::DOUBLE) / (sum(pos) * (count(*) - sum(pos))) AS auc FROM a1 GROUP BY c),
auc AS (SELECT round(avg(auc), 6) AS roc_auc FROM a2)"""


@query("roc_auc", f"WITH {_UNIFORM},{_AUC} SELECT roc_auc FROM auc")
def roc_auc(spark, sf):
    p = EV.knn_uniform(split(spark, sf), "vec_id", CLASSES)
    return EV.roc_auc_ovr(p, CLASSES).select(F.round("roc_auc", 6).alias("roc_auc"))


@query("evaluate_knn", f"WITH {_UNIFORM},{_METRICS},{_AUC} SELECT 'KNN (k=5)' AS model, m.*, roc_auc FROM m, auc")
def evaluate_knn(spark, sf):
    rows = EV.evaluate("KNN (k=5)", EV.knn_uniform(split(spark, sf), "vec_id", CLASSES), CLASSES)
    return rows.select("model", *[F.round(c, 6).alias(c) for c in rows.columns if c != "model"])


@query("standard_scale", """
    WITH x AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(64)) AS j FROM embeddings),
    z AS (SELECT j, avg(x) AS m, stddev_pop(x) AS d FROM x GROUP BY j)
    SELECT vec_id, round(sum((x - m) / CASE WHEN d = 0 THEN 1 ELSE d END), 4) AS z_sum,
      round(max((x - m) / CASE WHEN d = 0 THEN 1 ELSE d END), 4) AS z_max FROM x JOIN z USING (j) GROUP BY vec_id""")
def standard_scale(spark, sf):
    e = embeddings(spark, sf)
    z = e.select("vec_id", EV.scale(F.col("vector"), EV.fit_scaler(e, WIDTH)).alias("z"))
    total = F.aggregate("z", F.lit(0.0), lambda a, x: a + x)
    return z.select("vec_id", F.round(total, 4).alias("z_sum"),
                    F.round(F.array_max("z"), 4).alias("z_max"))


def history(spark, sf) -> DataFrame:
    """Analysis records: a features MAP with gaps, a class, and gaps in the other fields."""
    e = D.table(spark, sf, "embeddings")
    x, label = F.col("embedding"), F.col("label")
    feats = F.when(label % 3 == 0, F.create_map(
        F.lit("a"), x[0].cast("double"), F.lit("b"), x[1].cast("double"))).when(
        label % 3 == 1, F.create_map(F.lit("b"), x[1].cast("double"),
                                     F.lit("c"), x[2].cast("double")))
    return e.select(
        "vec_id", feats.alias("features"),
        F.get(F.array(*[F.lit(n) for n in C.LABELS]), (label % 4).cast("int")).alias(
            "classification"),
        F.when(label % 2 == 0, F.lit(0.9)).alias("confidence"),
        F.when(label % 5 == 0, F.lit(70.0)).alias("risk_score"))


_HISTORY = """h AS (SELECT vec_id, CASE WHEN label % 3 = 0 THEN embedding[1]::DOUBLE ELSE 0.0 END AS a, embedding[2]::DOUBLE AS b,
  CASE WHEN label % 3 = 1 THEN embedding[3]::DOUBLE ELSE 0.0 END AS c, CAST(label % 4 AS INT) AS y,
  CASE WHEN label % 2 = 0 THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END AS confidence,
  CASE WHEN label % 5 = 0 THEN 70.0::DOUBLE ELSE 50.0::DOUBLE END AS risk_score,
  ['legitimo','spam','sospechoso'][label % 4 + 1] AS classification
  FROM embeddings WHERE label % 3 < 2 AND label % 4 < 3)"""


@query("usable_history", f"WITH {_HISTORY} SELECT vec_id, classification, confidence, risk_score FROM h")
def usable_history(spark, sf):
    return readers.usable_history(history(spark, sf)).select(
        "vec_id", "classification", "confidence", "risk_score")


@query("prepare_training_table", f"WITH {_HISTORY} SELECT vec_id, y, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c FROM h")
def prepare_training_table(spark, sf):
    t = EV.prepare_training_table(readers.usable_history(history(spark, sf)))
    return t.select("vec_id", "y", *[F.round(F.col("vector")[k], 6).alias(n)
                                     for k, n in enumerate("abc")])


@query("class_distribution", f"WITH {_HISTORY} SELECT classification, count(*) AS count FROM h GROUP BY 1")
def class_distribution(spark, sf):
    return EV.class_distribution(readers.usable_history(history(spark, sf)))


def _guesses(spark, sf):
    labels, docs = D.table(spark, sf, "labels"), D.table(spark, sf, "documents")
    return labels.join(docs.select("doc_id", "n_chars"), "doc_id").select(
        F.col("quality").cast("int").alias("y"),
        (F.col("n_chars") > 400).cast("int").alias("pred"))


_GUESS = "u AS (SELECT CAST(quality AS INT) AS y, CAST(n_chars > 400 AS INT) AS pred FROM labels JOIN documents USING (doc_id))"


@query("confusion_matrix", f"""WITH {_GUESS} SELECT y, count(*) FILTER (WHERE pred = 0) AS "0",
    count(*) FILTER (WHERE pred = 1) AS "1" FROM u GROUP BY y""")
def confusion_matrix(spark, sf):
    return EV.confusion_matrix(_guesses(spark, sf), [0, 1])


@query("weighted_f1_of_labels", f"WITH {_GUESS},{_METRICS} SELECT * FROM m")
def weighted_f1_of_labels(spark, sf):
    m = EV.classification_metrics(_guesses(spark, sf))
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


_LEARN = """n AS (SELECT i, CASE WHEN wl THEN 0 WHEN fb_class = 'spam' THEN 1 ELSE 2 END AS y, md5(CAST(i AS VARCHAR) || '-42') AS h FROM b5),
n1 AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY h, i) <= round(count(*) OVER (PARTITION BY y) * 0.2::DOUBLE, 0) AS is_test FROM n)"""


def learnable(spark, sf) -> DataFrame:
    """The 33 features of every derived report and the class its deep analysis gives it, split by class.

    The planner counts an array as one value, and coded as it is in the file; it would broadcast vectors of many times that size. So the
    two sides are sorted and merged.
    """
    signals = TG.stored_signals(D.reports(spark, sf), columns=["report_id", "classification"])
    features = parsing.feature_table(signals).select("report_id", "vector").hint("merge")
    classes = TG.deep_signals(signals, whitelist(spark)).select("report_id", "classification")
    rows = features.join(classes, "report_id").select("report_id", "vector", TG.label_id(F.col("classification")).alias("y"))
    return settle(EV.stratified_split(settle(rows, "learnable"), "report_id", "y"), "learnable-split")


@query("random_forest", derived("y, count(*) AS rows, count(*) AS whole_probabilities, true AS beats_largest_class, true AS beats_chance",
                                "GROUP BY y", _LEARN).replace("FROM b5 GROUP BY y", "FROM n1 WHERE is_test GROUP BY y"))
def random_forest(spark, sf):
    """100 trees of depth 15 on every test row.

    The stored answers must be right more often than the largest class is, by a tenth at least, and than answers of the same
    counts that have nothing to do with the rows; a constant or a random classifier fails.
    """
    p = settle(EV.random_forest(learnable(spark, sf), "report_id", 3)[1].select("id", "y", "pred", "proba"), "forest")
    total, rows = F.aggregate("proba", F.lit(0.0), lambda a, x: a + x), F.count(F.lit(1))
    y, guess = p.groupBy("y").agg(rows.alias("n")), p.groupBy(F.col("pred").alias("y")).agg(rows.alias("m"))
    by_class = y.join(guess, "y", "left").agg(
        (F.max("n") / F.sum("n")).alias("largest"), (F.sum(F.col("n") * F.coalesce("m", F.lit(0))) / F.pow(F.sum("n"), F.lit(2))).alias("chance")).first()
    hit = p.agg(F.avg((F.col("y") == F.col("pred")).cast("double"))).first()[0]
    return p.groupBy("y").agg(rows.alias("rows"), F.count_if((F.abs(total - 1) < 1e-9) & (F.size("proba") == 3)).alias("whole_probabilities")).select(
        "y", "rows", "whole_probabilities", F.lit(hit > 1.1 * by_class["largest"]).alias("beats_largest_class"), F.lit(hit > 1.3 * by_class["chance"]).alias("beats_chance"))


@query("feature_importance_top10", """SELECT CAST(10 AS BIGINT) AS features, CAST(10 AS BIGINT) AS names, true AS descending, true AS shares,
    true AS holds_what_decides, CAST(0 AS BIGINT) AS holds_constants""")
def feature_importance_top10(spark, sf):
    """The ten largest of 33 importances: distinct names, in order, shares of one.

    What decides the class, the Microsoft verdict, must be among them; features that are the same for every report must not.
    """
    rows = learnable(spark, sf)
    model, _ = EV.random_forest(rows, "report_id", 3)
    whole = abs(float(sum(model.featureImportances.toArray())) - 1) < 1e-9
    constant = rows.select(F.posexplode("vector").alias("at", "x")).groupBy("at").agg(F.min("x").alias("low"), F.max("x").alias("high")).where("low = high")
    constant = [C.FEATURE_NAMES[r["at"]] for r in constant.collect()]
    top = EV.feature_importance(model, list(C.FEATURE_NAMES), spark)
    values = F.collect_list("importance")
    return top.coalesce(1).agg(
        F.count(F.lit(1)).alias("features"), F.countDistinct("feature").alias("names"),
        (values == F.sort_array(values, False)).alias("descending"),
        ((F.sum("importance") <= 1) & (F.min("importance") >= 0) & F.lit(whole)).alias("shares"),
        F.bool_or(F.col("feature") == "ms_urls_detected").alias("holds_what_decides"),
        F.count_if(F.col("feature").isin(constant)).alias("holds_constants"))


def prepared_split(spark, sf) -> DataFrame:
    """History -> training table -> z-scores fitted on all rows -> stratified split."""
    table = settle(EV.prepare_training_table(readers.usable_history(history(spark, sf))), "prepared")
    scaled = table.select("vec_id", "y", EV.scale(F.col("vector"), EV.fit_scaler(table, 3)).alias("vector"))
    return settle(EV.stratified_split(scaled, "vec_id", "y"), "prepared-split")


@query("compare_models", f"""WITH {_HISTORY}, t0 AS (SELECT y, md5(CAST(vec_id AS VARCHAR) || '-42') AS h, vec_id FROM h),
    t AS (SELECT y, row_number() OVER (PARTITION BY y ORDER BY h, vec_id) <= round(count(*) OVER (PARTITION BY y) * 0.2::DOUBLE, 0) AS is_test FROM t0)
    SELECT model, count(*) AS test_rows, true AS scores_in_range, true AS best_has_largest_f1
    FROM t, (VALUES ('KNN (k=5)'), ('Random Forest')) v(model) WHERE is_test GROUP BY model""")
def compare_models(spark, sf):
    """The whole comparison from analysis history, with both models in full."""
    s = prepared_split(spark, sf)
    near = settle(EV.knn_uniform(s, "vec_id", 3), "compared")
    forest = settle(EV.random_forest(s, "vec_id", 3)[1].select("id", "y", "pred", "proba"), "compared")
    rows = EV.compare_models([EV.evaluate("KNN (k=5)", near, 3), EV.evaluate("Random Forest", forest, 3)])
    sizes = near.select(F.lit("KNN (k=5)").alias("model")).unionByName(
        forest.select(F.lit("Random Forest").alias("model"))).groupBy("model").agg(F.count(F.lit(1)).alias("test_rows"))
    largest = F.max("f1").over(Window.partitionBy(F.lit(1)))
    inside = F.lit(True)
    for c in ("accuracy", "precision", "recall", "f1", "roc_auc"):
        inside &= F.col(c).between(0, 1)
    return rows.join(sizes, "model").select(
        "model", "test_rows", inside.alias("scores_in_range"),
        (F.col("is_best") == (F.col("f1") == largest)).alias("best_has_largest_f1"))


# --- bookkeeping ---------------------------------------------------------------------------

def log(spark, sf) -> DataFrame:
    """A training log per event type, in event order."""
    return D.table(spark, sf, "events").select(
        F.col("event_type").alias("model"), F.col("event_id").alias("seq"),
        (F.col("user_id") % 3).cast("int").alias("label"),
        (F.col("value") > 10).alias("correct"))


_LOG = """l AS (SELECT event_type AS model, event_id AS seq, CAST(user_id % 3 AS INT) AS label, value > 10 AS correct FROM events)"""


@query("training_retention", f"""WITH {_LOG} SELECT model, seq, label FROM (
    SELECT *, row_number() OVER (PARTITION BY model ORDER BY seq DESC) AS rn FROM l) WHERE rn <= 1000""")
def training_retention(spark, sf):
    return TR.keep_last(log(spark, sf), DEFAULT.training_cap, by="model").select(
        "model", "seq", "label")


@query("feedback_retention", f"WITH {_LOG} SELECT seq, CAST(correct AS INT) AS correct FROM l ORDER BY seq DESC LIMIT 100")
def feedback_retention(spark, sf):
    return TR.keep_last(log(spark, sf), DEFAULT.feedback_cap).select(
        "seq", F.col("correct").cast("int").alias("correct"))


@query("record_feedback", f"""WITH {_LOG} SELECT seq, predicted, actual, CAST(predicted = actual AS INT) AS correct FROM (
    SELECT seq, 'spam' AS predicted, CASE label WHEN 0 THEN 'legitimo' WHEN 1 THEN 'spam' ELSE 'sospechoso' END AS actual FROM l)
    ORDER BY seq DESC LIMIT 100""")
def record_feedback(spark, sf):
    entries = log(spark, sf).select(
        "seq", F.lit("spam").alias("predicted"),
        F.get(F.array(*[F.lit(n) for n in C.LABELS]), F.col("label")).alias("actual"))
    empty = entries.withColumn("correct", F.lit(True)).limit(0)
    return TR.record_feedback(empty, entries).select(
        "seq", "predicted", "actual", F.col("correct").cast("int").alias("correct"))


@query("rolling_accuracy", f"""WITH {_LOG} SELECT model, seq, round(avg(correct::INT::DOUBLE) OVER (
    PARTITION BY model ORDER BY seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS accuracy FROM l""")
def rolling_accuracy(spark, sf):
    return TR.rolling_accuracy(log(spark, sf), by="model", bucket_rows=1000).select(
        "model", "seq", F.round("accuracy", 6).alias("accuracy"))


@query("recent_accuracy", f"WITH {_LOG} SELECT round(avg(correct::INT::DOUBLE), 6) AS accuracy, count(*) AS entries FROM (SELECT * FROM l ORDER BY seq DESC LIMIT 20)")
def recent_accuracy(spark, sf):
    return TR.recent_accuracy(log(spark, sf)).select(
        F.round("accuracy", 6).alias("accuracy"), "entries")


@query("confidence_threshold", f"""WITH {_LOG} SELECT model, count(*) AS training_size,
    CASE WHEN count(*) < 50 THEN 0.95::DOUBLE WHEN count(*) < 200 THEN 0.85::DOUBLE WHEN count(*) < 500 THEN 0.75::DOUBLE ELSE 0.65::DOUBLE END AS threshold
    FROM l GROUP BY model""")
def confidence_threshold(spark, sf):
    return TR.confidence_threshold(log(spark, sf), by="model")


_SIZES = _LOG + """,
z AS (SELECT model, seq, row_number() OVER (PARTITION BY model ORDER BY seq) AS added FROM l),
zz AS (SELECT *, least(added + 15, 1000) AS size FROM z)"""


@query("training_size_log", f"WITH {_SIZES} SELECT model, seq, added, CAST(size AS BIGINT) AS training_size FROM zz")
def training_size_log(spark, sf):
    return TR.training_size_log(log(spark, sf), by="model", seeds=15, bucket_rows=1000)


@query("threshold_log", f"""WITH {_SIZES},
    t AS (SELECT model, seq, size, CASE WHEN size < 50 THEN 0.95::DOUBLE WHEN size < 200 THEN 0.85::DOUBLE WHEN size < 500 THEN 0.75::DOUBLE ELSE 0.65::DOUBLE END AS "to"
      FROM zz WHERE added % 10 = 0),
    f AS (SELECT *, coalesce(lag("to") OVER (PARTITION BY model ORDER BY seq), 0.85::DOUBLE) AS "from" FROM t)
    SELECT model, seq, CAST(size AS BIGINT) AS training_size, "from", "to" FROM f WHERE "from" <> "to" """)
def threshold_log(spark, sf):
    return TR.threshold_log(log(spark, sf), by="model", seeds=15, bucket_rows=1000)


@query("training_summary", f"""WITH {_LOG} SELECT CAST(least(count(*), 1000) AS BIGINT) AS total_examples,
    count(*) FILTER (WHERE label = 0) AS legitimo, count(*) FILTER (WHERE label = 1) AS spam,
    count(*) FILTER (WHERE label = 2) AS sospechoso, count(*) - 15 AS training_count,
    0.65::DOUBLE AS current_threshold, 0.85::DOUBLE AS base_threshold, 100 AS feedback_count FROM l""")
def training_summary(spark, sf):
    rows = log(spark, sf)
    return TR.training_summary(rows, seeds=15, feedback=rows)


@query("append_training", f"""WITH {_LOG},
    n AS (SELECT 14 + row_number() OVER (ORDER BY seq) AS seq, label FROM l)
    SELECT seq, label FROM n ORDER BY seq DESC LIMIT 1000""")
def append_training(spark, sf):
    """Event rows as examples appended to the seeds; the newest 1000 rows stay."""
    examples = log(spark, sf).select(
        F.col("seq").alias("order"),
        F.array_repeat(F.lit(0.5), len(C.FEATURE_NAMES)).alias("vector"),
        F.get(F.array(*[F.lit(n) for n in C.LABELS]), F.col("label")).alias("classification"))
    return TR.append_training(TR.seed_training(spark), examples).select("seq", "label")
