"""The model's bookkeeping as a stream, and the table functions."""

import numpy as np
import pytest

from tamiz.config import DEFAULT
from tamiz.functions.tables import register_table_functions
from tamiz.operators.training import threshold_after
from tamiz.streaming import models as MB

FEED = "model string, seq long, correct boolean"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def plain_books(batches):
    """Row by row, in order of seq inside a batch."""
    seen, out = {}, []
    for batch in batches:
        for model, seq, correct in sorted(batch, key=lambda r: r[1]):
            flags = seen.setdefault(model, [])
            flags.append(bool(correct))
            last = flags[-20:]
            out.append((model, seq, round(sum(last) / len(last), 9), min(15 + len(flags), 1000), threshold_after(len(flags), 15)))
    return sorted(out, key=str)


def run(spark, tmp_path, batches, initial=None, checkpoint="state", first=0):
    schema = spark.createDataFrame([], FEED).schema
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, FEED).repartition(3).write.mode("append").parquet(str(tmp_path / "feed"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "feed"))
        MB.write_books(stream, str(tmp_path / "out"), str(tmp_path / checkpoint), initial, availableNow=True).awaitTermination()
    return sorted(((r["model"], r["seq"], round(r["accuracy"], 9), r["training_size"], r["threshold"])
                   for r in spark.read.parquet(str(tmp_path / "out")).collect()), key=str)


def batches_of():
    rng = np.random.default_rng(1)
    rows = [(f"m{rng.integers(3) if k % 3 else 0}", k, bool(rng.integers(2))) for k in range(700)]
    rows[5] = ("m0", 5, None)
    rows += [("late", 1000, True), ("late", 1001, False)]
    # The last batch holds rows of smaller seq than what came before: arrival counts.
    return [rows[:3], rows[3:40], rows[40:690], rows[690:] + [("late", 7, True), ("m1", -4, False)]]


def test_stream_equals_the_plain_rules_over_restarts(spark, tmp_path):
    before = spark.conf.get(PROVIDER)
    batches = batches_of()
    assert run(spark, tmp_path, batches) == plain_books(batches)
    assert spark.conf.get(PROVIDER) == before
    state = {r["model"]: r for r in MB.read_books(spark, str(tmp_path / "state")).collect()}
    counts = {}
    for batch in batches:
        for model, _, _ in batch:
            counts[model] = counts.get(model, 0) + 1
    assert {m: r["added"] for m, r in state.items()} == counts
    assert all(len(r["recent"]) <= DEFAULT.accuracy_window for r in state.values()) and state["late"]["last_seq"] == 1001


def test_a_new_query_takes_over_the_state_of_another(spark, tmp_path):
    batches = batches_of()
    run(spark, tmp_path, batches[:2])
    books = MB.read_books(spark, str(tmp_path / "state"))
    (tmp_path / "next").mkdir()
    got = run(spark, tmp_path / "next", batches[2:3], initial=books)
    assert got == sorted(set(plain_books(batches[:3])) - set(plain_books(batches[:2])), key=str)


def test_table_functions(spark):
    register_table_functions(spark)
    register_table_functions(spark)
    rows = [(1, "see http://A.example:80/x and https://b.example?q=1, a.b@C.example"), (2, None), (3, ""), (4, "http://a.example/ http://a.example/ x@y.org x@y.org")]
    spark.createDataFrame(rows, "i int, body string").createOrReplaceTempView("texts")
    got = spark.sql("SELECT i, u.* FROM texts, LATERAL report_urls(body) u").collect()
    assert sorted(map(tuple, got)) == [
        (1, 1, "http://A.example:80/x", "a.example"), (1, 2, "https://b.example?q=1,", "b.example"),
        (4, 1, "http://a.example/", "a.example"), (4, 2, "http://a.example/", "a.example")]
    got = spark.sql("SELECT i, e.domain, count(*) AS n FROM texts, LATERAL report_emails(body) e GROUP BY ALL").collect()
    assert sorted(map(tuple, got)) == [(1, "c.example", 1), (4, "y.org", 2)]
    plan = spark.sql("SELECT i, u.host FROM texts, LATERAL report_urls(body) u")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("sizes,want", [([0, 49, 50, 199, 200, 499, 500, 5000], [.95, .95, .85, .85, .75, .75, .65, .65])])
def test_thresholds(sizes, want):
    assert MB.thresholds(np.array(sizes)).tolist() == want
