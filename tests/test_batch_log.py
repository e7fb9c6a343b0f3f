"""Batch folders and their compaction: every batch exactly once, at any moment."""

import os

import pytest

from tamiz.sources import batch_log

SCHEMA = "id long"


def put(spark, path, batch, ids):
    spark.createDataFrame([(i,) for i in ids], SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def rows(spark, path, before=None):
    return sorted((r["batch"], r["id"]) for r in batch_log.read_log(spark, path, SCHEMA, before).collect())


def test_reading_before_and_after_compaction(spark, tmp_path):
    path, want = str(tmp_path / "t"), []
    for b in range(12):
        put(spark, path, b, range(10 * b, 10 * b + b % 3))
        want += [(b, 10 * b + k) for k in range(b % 3)]
        assert rows(spark, path) == want
        if b % 4 == 3:
            batch_log.compact(spark, path, SCHEMA, upto=b - 1)
            assert rows(spark, path) == want
            assert rows(spark, path, before=5) == [w for w in want if w[0] < 5]
    # A retried batch replaces its own folder, as long as no snapshot holds it.
    put(spark, path, 11, [7])
    assert rows(spark, path) == [w for w in want if w[0] != 11] + [(11, 7)]
    batch_log.clean(spark, path)
    assert rows(spark, path)[:-1] == [w for w in want if w[0] != 11]
    assert sum(n.startswith("batch=") for n in os.listdir(path)) == 1


def test_many_batches_leave_few_folders(spark, tmp_path):
    path = str(tmp_path / "t")
    for b in range(1000):  # as a stream leaves them, written here without a job each
        os.makedirs(f"{path}/batch={b}")
    put(spark, str(tmp_path / "one"), 0, [1, 2])
    part = next(n for n in os.listdir(tmp_path / "one" / "batch=0") if n.endswith(".parquet"))
    for b in range(1000):
        os.link(tmp_path / "one" / "batch=0" / part, f"{path}/batch={b}/{part}")
        if b % 250 == 249:
            batch_log.compact(spark, path, SCHEMA, upto=b)
    batch_log.clean(spark, path)
    assert batch_log.folders(spark, path) <= 4
    found = batch_log.read_log(spark, path, SCHEMA)
    assert found.count() == 2000 and found.select("batch").distinct().count() == 1000


def test_half_a_compaction_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "t")
    for b in range(4):
        put(spark, path, b, [b])
    want = rows(spark, path)
    # A snapshot without a manifest, and a manifest that was never renamed, as a lost driver leaves them.
    put(spark, f"{path}/snapshot-lost", 0, [99])
    batch_log.compact(spark, path, SCHEMA, upto=1)
    (tmp_path / "t" / "_log" / ".half").write_text("{")
    assert rows(spark, path) == want
    # A reader that began before a compaction still finds its files after it.
    early = batch_log.read_log(spark, path, SCHEMA)
    batch_log.compact(spark, path, SCHEMA, upto=3)
    assert early.count() == 4 and rows(spark, path) == want
    batch_log.clean(spark, path)
    assert rows(spark, path) == want and batch_log.folders(spark, path) <= 2


def test_of_two_compactions_one_counts(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    for b in range(3):
        put(spark, path, b, [b])
    store, real = batch_log._Store, batch_log._Store.put

    def late(self, name, text):
        monkeypatch.setattr(store, "put", real)
        batch_log.compact(spark, path, SCHEMA, upto=2)  # another one publishes first
        return real(self, name, text)

    monkeypatch.setattr(store, "put", late)
    batch_log.compact(spark, path, SCHEMA, upto=1)
    assert rows(spark, path) == [(0, 0), (1, 1), (2, 2)] and batch_log.newest(spark, path).version == 1


@pytest.mark.parametrize("upto", [-1, 5])
def test_empty_tables(spark, tmp_path, upto):
    path = str(tmp_path / "none")
    assert rows(spark, path) == [] and batch_log.compact(spark, path, SCHEMA, upto).parts == []
