"""Messages that leave the system: once each, whatever is repeated or fails on the way."""

import json
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tamiz.operators.training import seed_training
from tamiz.plans.triage import triage
from tamiz.sources import delivery

from .test_decisions import mails


def rows(spark, ids, payload="p"):
    return spark.createDataFrame([(f"m{i}", "alert", None, f"{payload}{i} \"é\"\n") for i in ids], delivery.MESSAGE).repartition(3)


def got(spark, box):
    return sorted((r["batch"], r["message_id"], r["payload"]) for r in delivery.delivered(spark, box).collect())


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    box = str(tmp_path / "box")
    delivery.deliver(rows(spark, range(5)), box, 0)
    once = got(spark, box)
    delivery.deliver(rows(spark, range(5), "again"), box, 0)
    delivery.deliver(rows(spark, range(3, 9)), box, 1)
    assert got(spark, box)[:5] == once and len(got(spark, box)) == 11
    named = {r["file"] for r in spark.read.json(f"{box}/commits").collect()}
    assert {f for f in os.listdir(f"{box}/data") if not f.startswith(".")} == named


def test_a_failed_job_leaves_nothing_and_its_repeat_counts_once(spark, tmp_path):
    box = str(tmp_path / "box")
    bad = rows(spark, range(40)).withColumn("payload", F.when(F.col("message_id") == "m33", F.raise_error(F.lit("lost"))).otherwise(F.col("payload")))
    with pytest.raises(Exception, match="lost"):
        delivery.deliver(bad, box, 7)
    assert got(spark, box) == []
    # What an attempt wrote before its executor was lost is named by no commit.
    delivery._Box(box).put([{"message_id": "ghost", "channel": "alert", "recipient": None, "payload": ""}])
    delivery.deliver(rows(spark, range(40)), box, 7)
    assert [m for _, m, _ in got(spark, box)] == sorted(f"m{i}" for i in range(40))


def test_empty_batches_and_large_ones(spark, tmp_path, monkeypatch):
    box = str(tmp_path / "box")
    delivery.deliver(rows(spark, []), box, "none")
    delivery.deliver(rows(spark, range(3)), box, "none")
    assert got(spark, box) == []
    many = spark.range(120_000).select(F.col("id").cast("string").alias("message_id"), F.lit("c").alias("channel"), F.lit("r").alias("recipient"), F.lit("{}").alias("payload"))
    delivery.deliver(many.coalesce(1), box, "many")
    assert delivery.delivered(spark, box).select("message_id").distinct().count() == 120_000
    assert spark.read.json(f"{box}/commits/many.json").agg(F.max("rows")).first()[0] == delivery.ROWS


def test_a_stream_files_each_batch_once(spark, tmp_path):
    box, feed = str(tmp_path / "box"), str(tmp_path / "feed")
    schema = rows(spark, []).schema
    for k in range(3):
        rows(spark, range(10 * k, 10 * k + 10)).write.mode("append").parquet(feed)
        delivery.deliver_stream(spark.readStream.schema(schema).parquet(feed), box, str(tmp_path / "cp"), availableNow=True).awaitTermination()
    assert sorted(m for _, m, _ in got(spark, box)) == sorted(f"m{i}" for i in range(30))
    # The last batch is asked for once more, as after a crash between commit and checkpoint.
    last = max(int(b) for b, _, _ in got(spark, box))
    writer = delivery.OutboxStreamWriter(delivery._Box(box))
    again = writer.write(iter([b for b in rows(spark, range(20, 30)).toArrow().to_batches()]))
    writer.commit([again, None], last)
    assert len(got(spark, box)) == 30


def test_messages_of_analyses(spark):
    done = triage(mails(spark), spark.createDataFrame([("known.example",)], "domain string"), seed_training(spark))
    counts = {r["channel"]: r["count"] for r in delivery.messages(done).groupBy("channel").count().collect()}
    classes = {r["classification"]: r["count"] for r in done.groupBy("classification").count().collect()}
    assert counts.get("alert", 0) == counts.get("case", 0) == classes.get("sospechoso", 0)
    assert counts.get("webhook-spam", 0) == classes.get("spam", 0) and counts.get("webhook-legitimo", 0) == classes.get("legitimo", 0)
    assert counts["notice"] == done.where("reporter_email <> ''").count()


def test_few_messages_are_held_as_text_at_a_time(tmp_path, monkeypatch):
    monkeypatch.setattr(delivery, "ROWS", 5)
    monkeypatch.setattr(delivery, "AT_ONCE", 2)
    box, held, lines = delivery._Box(str(tmp_path)), [], delivery._Box._lines
    box.prepare()
    monkeypatch.setattr(delivery._Box, "_lines", staticmethod(lambda rows: held.append(len(rows)) or lines(rows)))
    names = ["message_id", "channel", "recipient", "payload"]
    batches = [pa.RecordBatch.from_pydict({c: [f"{c}{i}é" for i in range(*part)] for c in names}) for part in ((0, 4), (4, 4), (4, 12))]
    written = box.file(iter(batches)).written
    assert [n for _, n in written] == [5, 5, 2] and max(held) <= 2
    read = [json.loads(x) for name, _ in written for x in (tmp_path / "data" / name).read_text(encoding="utf-8").splitlines()]
    assert [r["message_id"] for r in read] == [f"message_id{i}é" for i in range(12)]
    assert box.file(iter([])).written == []
