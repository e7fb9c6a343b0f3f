import numpy as np
from pyspark.sql import functions as F

from tamiz.operators import evaluation as EV
from tamiz.operators import parsing


def table(spark, n=240, classes=3, dim=4, seed=2):
    rng = np.random.default_rng(seed)
    y = rng.choice(classes, n, p=[.6, .3, .1])
    x = rng.normal(0, .6, (n, dim)) + y[:, None]
    x[:, 3] = 1.5
    return x, y, spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(n)],
                                       "id bigint, vector array<double>, y int")


def test_scaler(spark):
    x, _, df = table(spark)
    fitted = EV.fit_scaler(df, 4)
    got = np.array([r["z"] for r in df.orderBy("id").select(EV.scale(F.col("vector"), fitted).alias("z")).collect()])
    sd = x.std(axis=0)
    assert np.allclose(got, (x - x.mean(axis=0)) / np.where(sd == 0, 1, sd), atol=1e-9)


def test_split_shares(spark):
    _, y, df = table(spark)
    split = EV.stratified_split(df, "id", "y")
    for c in range(3):
        assert split.where(f"y = {c} AND is_test").count() == round((y == c).sum() * .2)
    again = {r["id"] for r in EV.stratified_split(df.repartition(7), "id", "y", digits=2).where("is_test").collect()}
    assert again == {r["id"] for r in split.where("is_test").collect()}


def test_metrics_and_auc(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 400)
    proba = np.round(rng.dirichlet([1, 1, 1], 400), 2)
    proba[np.arange(400), y] += .3
    pred = proba.argmax(axis=1)
    pred[pred == 2] = 1  # a class that is never predicted
    df = spark.createDataFrame([(int(a), int(b), p.tolist()) for a, b, p in zip(y, pred, proba)],
                               "y int, pred int, proba array<double>")
    support = np.array([(y == c).sum() for c in range(3)])
    hit = np.array([((y == c) & (pred == c)).sum() for c in range(3)])
    said = np.array([(pred == c).sum() for c in range(3)])
    p = np.where(said > 0, hit / np.maximum(said, 1), 0)
    r = hit / support
    f = np.where(p + r > 0, 2 * p * r / np.maximum(p + r, 1e-12), 0)
    got = EV.classification_metrics(df).first()
    want = [hit.sum() / 400] + [(m * support).sum() / 400 for m in (p, r, f)]
    assert np.allclose(list(got), want)
    aucs = []
    for c in range(3):
        s, pos = proba[:, c], y == c
        wins = (s[pos][:, None] > s[~pos][None, :]).sum() + .5 * (s[pos][:, None] == s[~pos][None, :]).sum()
        aucs.append(wins / (pos.sum() * (~pos).sum()))
    assert abs(EV.roc_auc_ovr(df, 3, ranges=10).first()[0] - np.mean(aucs)) < 1e-9
    matrix = {row["y"]: row for row in EV.confusion_matrix(df, [0, 1, 2]).collect()}
    assert all(matrix[c]["2"] == 0 for c in range(3))


def test_models_are_compared(spark):
    _, _, df = table(spark)
    split = EV.stratified_split(df, "id", "y")
    near = EV.knn_uniform(split, "id", 3)
    model, forest = EV.random_forest(split, "id", 3, trees=5, depth=4)
    rows = EV.compare_models([EV.evaluate("KNN (k=5)", near, 3), EV.evaluate("Random Forest", forest, 3)]).collect()
    assert sum(r["is_best"] for r in rows) == 1 and all(.5 < r["f1"] <= 1 for r in rows)
    top = EV.feature_importance(model, list("abcd"), spark, 2).collect()
    assert len(top) == 2 and top[0]["importance"] >= top[1]["importance"]


def test_learning_parses_the_reports_once(spark, tmp_path, monkeypatch):
    from catalog import model_queries

    spark.range(40).selectExpr("id as doc_id", "concat('text ', id) as text", "'en' as lang", "'s' as source", "10 as n_chars").write.parquet(
        f"{tmp_path}/documents.parquet")
    parsed = []

    def counted(reports, plain=parsing.parse_reports):
        parsed.append(1)
        return plain(reports)

    monkeypatch.setattr(parsing, "parse_reports", counted)
    rows = model_queries.learnable(spark, str(tmp_path)).collect()
    assert len(parsed) == 1
    assert {r.report_id for r in rows} == set(range(40)) and all(len(r.vector) == 33 and r.y in (0, 1, 2) for r in rows)


def test_vectors_of_all_reports_are_never_broadcast(spark, tmp_path, monkeypatch):
    from catalog import model_queries

    spark.range(40).selectExpr("id as doc_id", "concat('text ', id) as text", "'en' as lang", "'s' as source", "10 as n_chars").write.parquet(
        f"{tmp_path}/documents.parquet")
    plans = {}

    def planned(df, name, plain=model_queries.settle):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return plain(df, name)

    monkeypatch.setattr(model_queries, "settle", planned)
    rows = model_queries.learnable(spark, str(tmp_path)).collect()
    by_report = [line for line in plans["learnable"].splitlines() if "Join [report_id" in line]
    assert len(by_report) == 1 and "SortMergeJoin" in by_report[0]
    assert sorted(r.report_id for r in rows) == list(range(40)) and all(len(r.vector) == 33 and r.y in (0, 1, 2) for r in rows)


def test_features_of_signal_rows_are_those_of_the_parsed_reports(spark):
    mails = spark.createDataFrame([(1, "Subject: a\n\nhttp://x.example/a"), (2, None), (3, "authentication-results: spf=fail\n\n")], "report_id long, content string")
    parsed = parsing.parse_reports(mails)
    want = parsing.feature_table(parsed)
    got = parsing.feature_table(parsing.extract_signals(parsed))
    assert got.columns == want.columns
    assert sorted(map(tuple, got.drop("vector").collect())) == sorted(map(tuple, want.drop("vector").na.fill(0.0).collect()))
    assert {r.report_id: r.vector for r in got.collect()} == {r.report_id: r.vector for r in want.collect()}


def test_a_forest_is_fitted_on_all_cores(spark, monkeypatch):
    shares = []

    class Counted(EV.RandomForestClassifier):
        def fit(self, rows, params=None):
            shares.append(rows.rdd.getNumPartitions())
            return super().fit(rows, params)

    monkeypatch.setattr(EV, "RandomForestClassifier", Counted)
    rows = spark.range(60).selectExpr("id", "int(id % 2) as y", "array(double(id % 2), 1.0D) as vector", "id % 5 = 0 as is_test").coalesce(1)
    model, answers = EV.random_forest(rows, "id", 2, trees=3, depth=2)
    assert shares == [spark.sparkContext.defaultParallelism] and shares[0] > 1
    assert {r.id for r in answers.collect()} == set(range(0, 60, 5)) and all(r.pred == r.y for r in answers.collect())
