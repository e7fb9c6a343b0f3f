"""Registered queries against their SQL on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry
from catalog import load

DATA = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
CHECKED = [
    "deep_analysis_summary", "deep_analysis", "parse_headers", "unescape_headers", "extract_emails", "feature_table",
    "allow_list_suffix_join", "edit_distance_join", "risk_score_with_reputation", "parse_response", "triage",
    "cross_validate", "quality_gate", "batch_evaluate_full", "quarantine_summary", "stratified_split",
    "knn_neighbours", "knn_classify", "classification_metrics", "evaluate_knn", "random_forest",
    "feature_importance_top10", "compare_models", "whitelist_match", "homograph_match", "knn_label_feedback", "train_summary",
    "stream_agent_tables", "training_size_log", "active_learning_step", "response_requests", "write_cases", "confidence_gate", "run_summary", "risk_score", "roc_auc", "standard_scale", "rolling_accuracy",
    "threshold_log", "append_training", "monthly_summary", "stats_report", "year_month_rollup",
    "stream_usage_counts", "stream_window_counts", "stream_deduplicated", "whitelist_entries", "quarantine_lines", "new_files",
    "stream_model_books", "model_book_state", "report_url_rows", "report_email_domains", "report_file_names", "report_file_stream",
    "delivered_messages", "delivered_payloads", "delivered_stream", "knn_index_neighbours", "routed_names", "fallback_ids", "compacted_log",
]
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="tables not present")


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9))
    return str(value)


def test_every_query_is_named_once_and_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    runs, oracles = load()
    assert set(runs) == set(oracles)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert {r["classification"] for r in rows} <= {"legitimo", "spam", "sospechoso"} and rows


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    cursor = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    want = [dict(zip(names, r)) for r in cursor.fetchall()]
    df = entry.queries()[name](spark, DATA)
    got = [r.asDict() for r in df.collect()]
    columns = sorted(df.columns)
    assert columns == sorted(names)
    assert sorted([plain(r[c]) for c in columns] for r in got) == sorted([plain(r[c]) for c in columns] for r in want)
