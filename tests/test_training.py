import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tamiz import constants as C
from tamiz.functions.scoring import knn_threshold
from tamiz.operators import training as TR


def test_seed_shape(spark):
    rows = TR.seed_training(spark).collect()
    assert len(rows) == 15 and {len(r["vector"]) for r in rows} == {33}
    assert [sum(r["label"] == c for r in rows) for c in range(3)] == [5, 4, 6]


def test_threshold_steps(spark):
    sizes = [0, 49, 50, 199, 200, 499, 500, 1000]
    df = spark.createDataFrame([(n,) for n in sizes], "n int")
    got = [r[0] for r in df.select(knn_threshold(F.col("n"))).collect()]
    assert got == [.95, .95, .85, .85, .75, .75, .65, .65]
    assert [TR.threshold_after(n, 15) for n in (0, 9, 10, 39, 40, 185, 189, 190, 490)] == [
        .85, .85, .95, .95, .85, .85, .85, .75, .65]


def test_append_keeps_newest_and_refuses_wrong_width(spark):
    def examples(n, width=33):
        return spark.range(n).select(F.col("id").alias("order"), F.array_repeat(F.lit(1.0), width).alias("vector"),
                                     F.when(F.col("id") % 4 == 3, "??").otherwise("spam").alias("classification"))

    grown = TR.append_training(TR.seed_training(spark), examples(40))
    assert [r["seq"] for r in grown.orderBy("seq").collect()] == list(range(45))
    capped = TR.append_training(TR.seed_training(spark), examples(40), cap=20).orderBy("seq").collect()
    assert len(capped) == 20 and {r["label"] for r in capped} == {1}
    with pytest.raises(PySparkException):
        TR.append_training(TR.seed_training(spark), examples(1, 24)).collect()


def test_every_example_is_numbered(spark):
    examples = spark.range(3000).repartition(5).select(
        F.struct(F.col("id").alias("at")).alias("order"), F.array_repeat(F.col("id").cast("double"), 33).alias("vector"), F.lit("spam").alias("classification"))
    numbered = TR.number_examples(TR.seed_training(spark), examples)
    assert [(r["seq"], r["v"]) for r in numbered.select("seq", F.col("vector")[0].alias("v")).orderBy("seq").collect()] == [
        (15 + i, float(i)) for i in range(3000)]
    live = TR.append_training(TR.seed_training(spark), examples)
    assert sorted(r["seq"] for r in live.collect()) == list(range(2015, 3015))


def test_sizes_and_late_thresholds(spark):
    log = spark.range(1, 3001).select(F.col("id").alias("seq"), (F.col("id") % 2).alias("m"))
    sizes = TR.training_size_log(log, "m", seeds=15, bucket_rows=100).orderBy("m", "seq").collect()
    assert [(r["added"], r["training_size"]) for r in sizes] == [(i, min(i + 15, 1000)) for i in range(1, 1501)] * 2
    late = TR.threshold_log(log.drop("m"), seeds=15, every=300, bucket_rows=100).orderBy("seq").collect()
    assert [(r["seq"], r["from"], r["to"]) for r in late] == [(300, .85, .75), (600, .75, .65)]
    assert TR.threshold_after(0, 15, reloaded=0) == .95 and TR.threshold_after(5, 15, reloaded=3) == .95
    assert TR.threshold_after(47, 15, reloaded=45) == .85 and TR.threshold_after(190, 15, reloaded=3) == .75


def test_threshold_changes(spark):
    log = spark.range(15, 15 + 700).select(F.col("id").alias("seq"))
    got = [(r["training_size"], r["from"], r["to"]) for r in TR.threshold_log(log, seeds=15).orderBy("seq").collect()]
    assert got == [(25, .85, .95), (55, .95, .85), (205, .85, .75), (505, .75, .65)]


def test_rolling_accuracy_across_ranges(spark):
    rng = random.Random(5)
    rows, seq = [], 0
    for _ in range(900):
        seq += rng.choice([1, 1, 1, 30, 400])
        rows.append((rng.choice("aaab"), seq, rng.random() < .6))
    df = spark.createDataFrame(rows, "m string, seq bigint, correct boolean")
    got = {(r["m"], r["seq"]): r["accuracy"] for r in TR.rolling_accuracy(df, "m", bucket_rows=50).collect()}
    assert len(got) == len(rows)
    for m in "ab":
        mine = sorted((s, c) for k, s, c in rows if k == m)
        for i, (s, _) in enumerate(mine):
            last = [c for _, c in mine[max(0, i - 19):i + 1]]
            assert abs(got[m, s] - sum(last) / len(last)) < 1e-12
    single = TR.rolling_accuracy(df.where("m = 'b'").drop("m"), bucket_rows=50)
    assert single.count() == sum(k == "b" for k, *_ in rows)


def test_feedback(spark):
    log = spark.createDataFrame([(i, "spam", "spam" if i % 2 else "sospechoso") for i in range(150)],
                                "seq bigint, predicted string, actual string")
    empty = log.withColumn("correct", F.lit(True)).limit(0)
    kept = TR.record_feedback(empty, log)
    assert kept.count() == 100 and kept.agg(F.min("seq")).first()[0] == 50
    assert TR.recent_accuracy(kept).first()["accuracy"] == .5
    seeds = TR.seed_training(spark)
    s = TR.training_summary(seeds, 15, kept).first()
    assert (s["total_examples"], s["legitimo"], s["spam"], s["sospechoso"], s["training_count"],
            s["current_threshold"], s["feedback_count"]) == (15, 5, 4, 6, 0, .95, 100)
    assert len(C.LABELS) == 3


def test_seeds_are_read_without_python_workers(spark):
    seeds = TR.seed_training(spark)
    assert "ExistingRDD" not in seeds._jdf.queryExecution().executedPlan().toString()
    assert seeds.schema.simpleString() == "struct<seq:bigint,vector:array<double>,label:int>"
    assert [(r["seq"], r["vector"], r["label"]) for r in seeds.orderBy("seq").collect()] == [
        (i, [float(x) for x in v], label) for i, (v, label) in enumerate(C.SEED_TRAINING)]
