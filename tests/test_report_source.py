"""Report files as a data source: shares, arrival intervals, odd names, and what comes once."""

import os
import time

import pytest
from pyspark.sql import functions as F

from tamiz.sources import files, readers
from tamiz.sources.report_source import ReportReader, ReportStream, Share, _rows


def fill(folder):
    folder.mkdir()
    (folder / "plain.txt").write_bytes(b"a\r\nb\xff")
    (folder / "dos blancos.txt").write_text("x")
    (folder / "nada.txt").write_text("")
    (folder / "p+1%20ñ.txt").write_text("y")
    (folder / "other.eml").write_text("no")
    (folder / ".hidden.txt").write_text("no")
    (folder / "_tmp").mkdir()
    (folder / "_tmp" / "z.txt").write_text("no")
    for n in range(5):
        (folder / f"sub {n}" / "deep").mkdir(parents=True)
        (folder / f"sub {n}" / "deep" / f"m{n}.txt").write_text(str(n))
    return {"plain": "a\nb", "dos blancos": "x", "nada": "", "p+1%20ñ": "y"} | {f"m{n}": str(n) for n in range(5)}


@pytest.mark.parametrize("shares", [1, 2, 7])
def test_each_file_has_one_share_and_planning_looks_at_nothing(tmp_path, shares):
    want = fill(tmp_path / "in")
    found = [f.path for k in range(shares) for f in files.share_of(str(tmp_path / "in"), ".txt", k, shares)]
    assert sorted(os.path.basename(p)[:-4] for p in found) == sorted(want)
    assert ReportReader(str(tmp_path / "never made"), 3).partitions() == [Share(k, 3) for k in range(3)]


def test_read_reports_gives_every_file_once(spark, tmp_path):
    want = fill(tmp_path / "in")
    for place in (str(tmp_path / "in"), f"file:{tmp_path}/in", f"file://{tmp_path}/in/"):
        rows = readers.read_reports(spark, place).collect()
        assert sorted((r["report_id"], r["content"]) for r in rows) == sorted(want.items())
    assert all(r["arrived_at"] and r["path"].startswith("file:///") for r in rows)
    assert [r["content"] for r in readers.read_reports(spark, str(tmp_path / "in" / "dos blancos.txt")).collect()] == ["x"]
    assert readers.read_reports(spark, str(tmp_path / "in" / "_tmp")).count() == 1


def test_missing_folder_is_an_error_and_unknown_stores_are_left_to_spark(spark, tmp_path):
    with pytest.raises(Exception, match="No such file"):
        readers.read_reports(spark, str(tmp_path / "none")).collect()
    assert not files.reachable("viewfs://store/in") and files.reachable("/x") and files.reachable("file:///x")
    assert readers.lists_folder("viewfs://store/in") and readers.lists_folder("/x", max_files=1) and not readers.lists_folder("/x")


def test_written_files_appear_whole(spark, tmp_path):
    rows = [(f"a {k}", None if k == 3 else "é" * k) for k in range(20)]
    folder = str(tmp_path / "out")
    readers.write_reports(spark.createDataFrame(rows, "name string, content string").repartition(4), folder)
    assert {r["report_id"]: r["content"] for r in readers.read_reports(spark, folder).collect()} == {n: c or "" for n, c in rows}
    bad = spark.createDataFrame(rows, "name string, content string").withColumn(
        "content", F.when(F.col("name") == "a 7", F.raise_error(F.lit("broken"))).otherwise("new"))
    with pytest.raises(Exception, match="broken"):
        readers.write_reports(bad.repartition(3), folder)
    # A task that fails leaves whole files only, old or new, and a repeat puts all of them right.
    assert {r["content"] for r in readers.read_reports(spark, folder).collect()} <= {"é" * k for k in range(20)} | {"new"}
    readers.write_reports(bad.withColumn("content", F.lit("new")), folder)
    assert [r["content"] for r in readers.read_reports(spark, folder).collect()] == ["new"] * 20


def interval(folder, after, upto):
    return sorted(x for b in _rows(folder, Share(0, 1, after, upto)) for x in b.column("content").to_pylist())


def test_an_interval_holds_what_came_in_it(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("a")
    (tmp_path / "old.txt").write_text("moved")
    os.utime(tmp_path / "old.txt", (1, 1))
    time.sleep(0.05)
    first = ReportStream.now()
    time.sleep(0.05)
    os.rename(tmp_path / "old.txt", folder / "b.txt")
    time.sleep(0.05)
    second = ReportStream.now()
    assert interval(str(folder), 0, first) == ["a"] and interval(str(folder), first, second) == ["moved"]
    assert interval(str(folder), first, second) == ["moved"] and interval(str(folder), second, second + 1000) == []


def test_offsets_stand_still_while_nothing_happens(tmp_path):
    stream = ReportStream(str(tmp_path), 2, settle=0, refresh=10_000, quiet=0)
    time.sleep(0.05)
    first = stream.latestOffset()
    time.sleep(0.05)
    assert stream.latestOffset() == first
    (tmp_path / "a.txt").write_text("x")
    assert stream.latestOffset()["upto"] > first["upto"]
    restless = ReportStream(str(tmp_path), 2, settle=0, refresh=20, quiet=0)
    first = restless.latestOffset()
    time.sleep(0.05)
    assert restless.latestOffset()["upto"] > first["upto"] and restless.initialOffset() == {"upto": 0}
    assert ReportStream(str(tmp_path / "none"), 1, 0, 1, 1).latestOffset()["upto"] > 0


def test_a_stream_takes_each_file_once_over_restarts(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for n in range(3):
        (folder / f"correo {n}.txt").write_text(str(n))
        (folder / f"vacío {n}.txt").write_text("")
        readers.stream_reports(spark, str(folder)).writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(
            availableNow=True).start(str(tmp_path / "out"), format="parquet").awaitTermination()
    got = sorted(r["report_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [f"correo {n}" for n in range(3)] + [f"vacío {n}" for n in range(3)]
