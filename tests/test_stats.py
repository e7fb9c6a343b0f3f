from datetime import datetime

from pyspark.sql import functions as F

from tamiz.operators import stats as ST

ELEVEN = (3 * [("legitimo", "whitelist", None)] + [
    ("spam", "knn", True), ("spam", "knn", True), ("spam", "knn", False), ("spam", "llm", None),
    ("sospechoso", "knn", True), ("sospechoso", "knn", False), ("sospechoso", "llm", None), ("sospechoso", "llm", None)])


def cases(spark):
    rows = [(datetime(2026, 6, 1 + i), *c) for i, c in enumerate(ELEVEN)]
    return spark.createDataFrame(rows, "ts timestamp, classification string, source string, knn_was_correct boolean")


def test_eleven_cases(spark):
    m = ST.month_summary(cases(spark), 2026, 6).first()
    assert [m[k] for k in ("total", "legitimo", "spam", "sospechoso", "whitelist", "knn", "llm")] == [11, 3, 4, 4, 3, 5, 3]
    assert [m[k + "_pct"] for k in ("legitimo", "spam", "sospechoso", "whitelist", "knn", "llm")] == [
        27.3, 36.4, 36.4, 27.3, 45.5, 27.3]
    assert (m["knn_correct"], m["knn_incorrect"], m["knn_accuracy_pct"]) == (3, 2, 60.0)
    y = ST.year_summary(cases(spark), 2026).first()
    assert y["total"] == 11 and y["by_month"][6]["sospechoso"] == 4 and y["knn_pct"] == 45.5
    report = {(r["section"], r["key"]): (r["count"], r["pct"]) for r in ST.stats_report(cases(spark), 2026, 6).collect()}
    assert report["month.source", "knn"] == (5, 45.5) and report["knn", "correct"] == (3, 60.0)
    assert report["history.06", "total"] == (11, None) and report["year", "total"] == (11, None)


def test_empty_periods_and_unknown_keys(spark):
    c = cases(spark)
    empty = ST.month_summary(c, 2025, 1).first()
    assert empty["total"] == 0 and empty["spam_pct"] == 0 and empty["knn_accuracy_pct"] == 0
    assert ST.year_summary(c, 2025).first()["total"] == 0
    assert ST.stats_report(c, 2025, 1).count() == 0
    odd = c.union(c.limit(1).select("ts", F.lit("otro"), F.lit("manual"), F.lit(None).cast("boolean")))
    long = {(r["kind"], r["key"]): r["count"] for r in ST.class_source_breakdown(odd).collect()}
    assert long["classification", "otro"] == 1 and long["source", "manual"] == 1


def test_history_is_newest_six(spark):
    rows = [(datetime(2026, m, 2), "spam", "llm", None) for m in range(1, 9)]
    c = spark.createDataFrame(rows, cases(spark).schema)
    assert [r["month"] for r in ST.monthly_history(c, 2026).collect()] == [8, 7, 6, 5, 4, 3]
    sections = {r["section"] for r in ST.stats_report(c, 2026, 8).collect() if r["section"].startswith("history")}
    assert sections == {f"history.{m:02d}" for m in range(3, 9)}
    now = ST.current_summary(c, datetime(2026, 8, 5)).collect()
    assert {r["period"]: r["total"] for r in now} == {"month": 1, "year": 8}


def test_period_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "cases")
    cases(spark).write.parquet(path)
    plan = ST.month_summary(spark.read.parquet(path), 2026, 6)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan
