import pytest
from pyspark.sql import functions as F

from tamiz.plans.triage import triage
from tamiz.sources import readers
from tamiz.streaming import agent
from tamiz.streaming import stats as SS

from .test_decisions import mails


def drop_mails(spark, folder):
    folder.mkdir(exist_ok=True)
    (folder / "empty.txt").write_text("")
    for r in mails(spark).collect():
        (folder / f"{r['report_id']}.txt").write_text(r["content"])


def test_agent_equals_batch_and_reloads_the_list(spark, tmp_path):
    drop_mails(spark, tmp_path / "in")
    (tmp_path / "w.txt").write_text("known.example\n")
    paths = agent.AgentPaths(str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "w.txt"))
    agent.start_agent(spark, paths, available_now=True).awaitTermination()
    stored = spark.read.parquet(paths.table("analyses"))
    columns = ["report_id", "source", "classification", "confidence", "risk_score", "reporter_email", "reasons"]
    batch = triage(readers.read_reports(spark, paths.ingress), readers.read_whitelist(spark, paths.whitelist),
                   agent.live_training(spark, paths, 0))
    assert sorted(map(str, stored.select(columns).collect())) == sorted(map(str, batch.select(columns).collect()))
    assert spark.read.parquet(paths.table("cases")).count() == 3
    # An edited list counts for the next mail, without a restart of the stored state.
    (tmp_path / "w.txt").write_text("ads.example\n")
    (tmp_path / "in" / "later.txt").write_text(
        "From: <x@ads.example>\nTo: <r@corp.example>\nSubject: s\nMessage-ID: <z>\n\nbody\n")
    agent.start_agent(spark, paths, available_now=True).awaitTermination()
    later = spark.read.parquet(paths.table("analyses")).where("report_id = 'later'").collect()
    assert [(r["source"], r["classification"]) for r in later] == [("whitelist", "legitimo")]
    # The zero-byte file has its row once, though every batch sees it.
    rows = spark.read.parquet(paths.table("analyses"))
    assert rows.count() == 6 and [(r["source"], r["classification"]) for r in rows.where("report_id = 'empty'").collect()] == [("unreported", "spam")]
    assert rows.where("analysis_date IS NULL").count() == 0
    with pytest.raises(ValueError, match="another checkpoint"):
        agent.start_agent(spark, paths, checkpoint=str(tmp_path / "fresh"), available_now=True)


def test_agent_learns_between_batches_and_retries_are_harmless(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for n in range(3):
        (folder / f"m{n}.txt").write_text(
            "From: <x@ex4mple.com>\nTo: <r@corp.example>\nSubject: s\nMessage-ID: <z>\nX: y\n"
            f"authentication-results: spf=fail; dkim=fail; dmarc=fail\n\nbody {n}\n")
    (tmp_path / "w.txt").write_text("example.com\n")
    paths = agent.AgentPaths(str(folder), str(tmp_path / "out"), str(tmp_path / "w.txt"))
    agent.start_agent(spark, paths, max_files=1, available_now=True).awaitTermination()
    learned = spark.read.parquet(paths.table("training"))
    assert learned.select("batch").distinct().count() == 3
    assert sorted(r["seq"] for r in learned.collect()) == [15, 16, 17]
    before = spark.read.parquet(paths.table("analyses")).count()
    agent.process_batch(readers.read_reports(spark, str(folder / "m2.txt")), 2, paths)
    assert spark.read.parquet(paths.table("analyses")).count() == before
    assert spark.read.parquet(paths.table("training")).count() == 3


def test_window_counts_close_with_the_watermark(spark, tmp_path):
    rows = [("2026-01-01 00:10:00", "a"), ("2026-01-01 00:20:00", "a"), ("2026-01-01 01:05:00", "b")]
    for n, part in enumerate((rows, [("2026-01-01 03:00:00", "c")])):
        spark.createDataFrame(part, "ts string, k string").select(F.col("ts").cast("timestamp"), "k").coalesce(
            1).write.mode("append").parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema("ts timestamp, k string").option("maxFilesPerTrigger", 1).parquet(
        str(tmp_path / "ev"))
    q = SS.stream_window_counts(stream, ["k"]).writeStream.format("memory").queryName("closed").option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(str(r["window_start"]), r["k"]): r["n"] for r in spark.table("closed").collect()}
    assert got[("2026-01-01 00:00:00", "a")] == 2 and ("2026-01-01 03:00:00", "c") not in got


def test_late_facts_count(spark, tmp_path):
    days = ["2026-05-01", "2026-05-02", "2026-05-03", "2026-03-01", "2026-05-03"]
    for day in days:
        spark.createDataFrame([(f"{day} 10:00:00", "spam", "knn", True)], "t string, classification string, source string, knn_was_correct boolean").select(
            F.col("t").cast("timestamp").alias("ts"), "classification", "source", "knn_was_correct").coalesce(1).write.mode("append").parquet(str(tmp_path / "c"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "c")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "c"))
    SS.write_daily_counts(stream, str(tmp_path / "out"), str(tmp_path / "cp"), availableNow=True).awaitTermination()
    got = {str(r["day"]): r["n"] for r in SS.read_daily_counts(spark, str(tmp_path / "out")).collect()}
    assert got == {"2026-05-01": 1, "2026-05-02": 1, "2026-05-03": 2, "2026-03-01": 1}


def test_dedup(spark, tmp_path):
    df = spark.createDataFrame([("r1", "2026-01-01 00:00:00"), ("r1", "2026-01-01 00:05:00"), ("r2", "2026-01-01 00:00:00")],
                               "report_id string, t string").select(
        "report_id", F.col("t").cast("timestamp_ntz").alias("arrived_at"))
    df.write.parquet(str(tmp_path / "r"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "r"))
    SS.deduplicated(stream).writeStream.format("memory").queryName("once").option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("once").count() == 2
