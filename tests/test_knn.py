import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tamiz.operators import knn, metric_index
from tamiz.operators.training import seed_training

VECTOR = "id bigint, vector array<double>"


def brute(queries, train, labels, k, weights, n):
    out = []
    for q in queries:
        d = np.sqrt(((train - q) ** 2).sum(axis=1))
        near = np.lexsort((np.arange(len(d)), d))[:k]
        w = np.ones(len(near))
        if weights == "distance":
            zero = d[near] == 0
            w = zero.astype(float) if zero.any() else 1 / d[near]
        p = np.array([w[labels[near] == c].sum() for c in range(n)]) / w.sum()
        out.append((int(p.argmax()), p))
    return out


def make(spark, seed=0, n_train=300, n_query=60, dim=7, classes=4):
    rng = np.random.default_rng(seed)
    train, labels = rng.integers(0, 3, (n_train, dim)) / 2.0 + rng.normal(0, .01, (n_train, dim)), rng.integers(0, classes, n_train)
    queries = np.vstack([rng.normal(.5, .5, (n_query, dim)), train[:5]])
    t = spark.createDataFrame([(i, train[i].tolist(), int(labels[i])) for i in range(n_train)],
                              "seq bigint, vector array<double>, label int")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], VECTOR)
    return queries, train, labels, q, t


@pytest.mark.parametrize("weights", ["distance", "uniform"])
def test_both_forms_match_brute_force(spark, weights):
    queries, train, labels, q, t = make(spark)
    want = brute(queries, train, labels, 5, weights, 4)
    direct = {r["id"]: r for r in knn.knn_classify(q, t, 5, weights, 4).collect()}
    blocked = {r["id"]: r for r in knn.vote_neighbours(
        knn.knn_neighbours(q, t, 5, block_rows=40), weights, 4).collect()}
    for i, (label, proba) in enumerate(want):
        for got in (direct[i], blocked[i]):
            assert np.allclose(got["proba"], proba, atol=1e-9)
            assert got["label"] == label


def test_large_training_tables_take_the_block_join(spark, monkeypatch):
    _, _, _, q, t = make(spark, 1)
    want = {r["id"]: r["label"] for r in knn.knn_classify(q, t, 5, "distance", 4).collect()}
    monkeypatch.setattr(knn, "BROADCAST_ROWS", 100)
    with pytest.raises(ValueError):
        knn.knn_vote(F.col("vector"), t)
    assert {r["id"]: r["label"] for r in knn.knn_classify(q, t, 5, "distance", 4).collect()} == want


def test_seed_votes(spark):
    def query(**at):
        v = [0.0] * 33
        for k, x in at.items():
            v[int(k[1:])] = x
        return v

    rows = [(0, query(p12=1.0, p13=1 / 3, p17=1.0, p22=.1, p31=.4, p32=1.0)), (1, query(p12=1.0, p31=.2, p32=1.0)),
            (2, query(p12=1.0, p13=1 / 3, p22=.1, p31=.4, p32=1.0))]
    q = spark.createDataFrame(rows, VECTOR)
    got = {r["id"]: r for r in knn.knn_classify(q, seed_training(spark)).collect()}
    for i, p in enumerate([[.5896, .4104, 0], [.5842, .4158, 0], [.5863, .4137, 0]]):
        assert np.allclose(got[i]["proba"], p, atol=5e-5) and got[i]["label"] == 0


def test_fewer_rows_than_k_empty_table_and_wrong_width(spark):
    q = spark.createDataFrame([(0, [0.0, 0.0])], VECTOR)
    two = spark.createDataFrame([(0, [1.0, 0.0], 2), (1, [3.0, 0.0], 0)], "seq bigint, vector array<double>, label int")
    row = knn.knn_classify(q, two).first()
    assert row["label"] == 2 and abs(row["confidence"] - .75) < 1e-12
    empty = knn.knn_classify(q, two.limit(0)).first()
    assert (empty["label"], empty["confidence"]) == (1, 0.0)
    with pytest.raises(PySparkException):
        knn.knn_classify(spark.createDataFrame([(0, [0.0] * 24)], VECTOR), seed_training(spark)).collect()


def rows_of(df):
    return sorted((r["id"], r["rank"], r["seq"], round(r["dist"], 12)) for r in df.collect())


@pytest.mark.parametrize("dim,spread", [(2, .05), (7, .5), (33, 1.0)])
def test_index_equals_the_block_join(spark, dim, spread):
    rng = np.random.default_rng(dim)
    centres = rng.normal(0, 2, (12, dim))
    train = np.round(centres[rng.integers(0, 12, 900)] + rng.normal(0, spread, (900, dim)), 1)
    train[200:500] = train[200]  # a third of all rows are equal
    t = spark.createDataFrame([(i, v.tolist(), int(i % 3)) for i, v in enumerate(train)], "seq bigint, vector array<double>, label int").repartition(5)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.vstack([train[::50], rng.normal(0, 3, (40, dim))]))], VECTOR)
    want = rows_of(knn.knn_neighbours(q, t, 5, block_rows=100))
    assert rows_of(metric_index.index_neighbours(q, t, 5, max_pivots=20, block_rows=64)) == want
    assert rows_of(metric_index.index_neighbours(q, t, 5, max_pivots=1)) == want


def test_index_compares_far_fewer_than_all_pairs(spark):
    rng = np.random.default_rng(3)
    train = (rng.normal(0, 10, (40, 6))[:, None, :] + rng.normal(0, .2, (40, 100, 6))).reshape(-1, 6)
    t = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(train)], "seq bigint, vector array<double>, label int")
    q = spark.createDataFrame([(i, (v + .1).tolist()) for i, v in enumerate(train[::20])], VECTOR)
    index, cells = metric_index.build_index(metric_index.few_equals(t, 5))
    home, later, _ = metric_index.visits_of(q, index, cells, 5)
    pairs = metric_index.compared_pairs(home, cells) + metric_index.compared_pairs(later, cells)
    assert pairs < 0.1 * 200 * 4000
    assert cells.rows.sum() == 4000


def test_index_of_few_rows_and_of_none(spark):
    q = spark.createDataFrame([(0, [0.0, 0.0]), (1, [5.0, 0.0])], VECTOR)
    two = spark.createDataFrame([(7, [1.0, 0.0], 2), (9, [3.0, 0.0], 0)], "seq bigint, vector array<double>, label int")
    assert rows_of(metric_index.index_neighbours(q, two, 5)) == [(0, 1, 7, 1.0), (0, 2, 9, 3.0), (1, 1, 9, 2.0), (1, 2, 7, 4.0)]
    assert metric_index.index_neighbours(q, two.limit(0), 5).count() == 0 and metric_index.index_neighbours(q.limit(0), two, 5).count() == 0


def test_comparing_by_a_product_gives_the_distances_of_every_pair(monkeypatch):
    monkeypatch.setattr(metric_index, "AT_ONCE", (50, 30))
    rng = np.random.default_rng(8)
    train = np.round(rng.normal(0, 1, (400, 5)), 1) + 1e6  # ties, and a product that loses most digits
    ask = np.vstack([train[::7], np.round(rng.normal(0, 1, (40, 5)), 1) + 1e6])
    apart, cells = metric_index.distances(ask, train), rng.integers(0, 12, 400)
    visits = [np.sort(rng.choice(12, n % 13, replace=False)).astype("int32") for n in range(len(ask))]
    for limits in (np.full(len(ask), np.inf), rng.uniform(0, 2, len(ask))):
        for use in (False, True):
            rows, dist = metric_index.nearest(ask, train, 5, limits, *((cells, visits) if use else ()))
            for n in range(len(ask)):
                open_ = (apart[n] <= limits[n]) & (np.isin(cells, visits[n]) if use else True)
                want = [i for i in np.lexsort((np.arange(400), apart[n])) if open_[i]][:5]
                assert rows[n][rows[n] >= 0].tolist() == want
                assert dist[n][:len(want)].tolist() == apart[n][want].tolist()
    train[3, 2] = np.inf  # no product: every pair is measured
    rows, _ = metric_index.nearest(ask, train, 2)
    assert rows[0].tolist() == np.lexsort((np.arange(400), metric_index.distances(ask[:1], train)[0]))[:2].tolist()


def test_groups_are_no_more_than_memory_or_cores_ask_for(spark, monkeypatch):
    """Blocks of 200 rows would send each of 120,000 queries 2,400 times."""
    assert metric_index.turns_of(120_000, 15, 200, 12) == 4 and metric_index.turns_of(120_000, 1, 200, 12) == 24
    assert metric_index.turns_of(0, 1, 200, 12) == 1 and metric_index.turns_of(150, 1, 200, 12) == 1
    _, _, _, q, t = make(spark, 5)
    want = rows_of(knn.knn_neighbours(q, t, 5))
    for module in (knn, metric_index):
        monkeypatch.setattr(module, "GROUP_ROWS", 30)
    assert rows_of(knn.knn_neighbours(q, t, 5, block_rows=10)) == want
    assert rows_of(metric_index.index_neighbours(q, t, 5, max_pivots=20, block_rows=10)) == want
    monkeypatch.setattr(knn, "BROADCAST_ROWS", 100)
    votes = {r["id"]: tuple(r) for r in knn.knn_classify(q.unionByName(q.withColumn("id", F.col("id") + 1000)), t, 5, "distance", 4).collect()}
    assert len(votes) == 2 * q.count() and all(votes[i][1:] == votes[i + 1000][1:] for i in votes if i < 1000)


def test_null_and_uneven_vectors_are_refused():
    kind = pa.list_(pa.float64())
    assert metric_index.matrix(pa.table({"vector": pa.array([[1.0, 2.0], [3.0, None]], kind)})).shape == (2, 2)
    for odd in ([[1.0] * 4, None], [[1.0], [2.0, 3.0, 4.0]]):
        with pytest.raises(ValueError):
            metric_index.matrix(pa.table({"vector": pa.array(odd, kind)}))


def test_a_condition_on_the_vote_does_not_ask_it_twice(spark):
    rows = spark.createDataFrame([(i, [float(i % 2)] * 33) for i in range(20)], VECTOR)
    voted = knn.with_vote(rows, "v", seed_training(spark)).select("id", "v.label", "v.confidence")
    kept = voted.where("confidence > 0 AND label >= 0")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert sorted(kept.collect()) == sorted(voted.collect()) and kept.count() == 20
