import json

from pyspark.sql import functions as F

from tamiz.operators import evaluation as EV
from tamiz.operators.training import seed_training
from tamiz.plans import triage as TG
from tamiz.sources import readers, sinks

from .test_decisions import mails


def test_read_reports(spark, tmp_path):
    (tmp_path / "b.two.txt").write_bytes(b"Subject: caf\xc3\xa9\r\nX: \xff\xfebad\rlast\xe2\x82\n")
    (tmp_path / "a.txt").write_bytes("ok � kept\n".encode())
    (tmp_path / "skip.eml").write_text("no")
    (tmp_path / "mi correo ñ+1%20.txt").write_text("x")
    (tmp_path / "nada de nada.txt").write_text("")
    got = {r["report_id"]: r["content"] for r in readers.read_reports(spark, str(tmp_path)).collect()}
    assert got == {"b.two": "Subject: café\nX: bad\nlast\n", "a": "ok � kept\n", "mi correo ñ+1%20": "x", "nada de nada": ""}
    rows = readers.read_reports(spark, str(tmp_path)).where("report_id LIKE '% %'").collect()
    assert all(r["path"].endswith(f"{r['report_id']}.txt") and r["arrived_at"] for r in rows) and len(rows) == 2


def test_whitelist_file(spark, tmp_path):
    (tmp_path / "w.txt").write_text("# note\n\n Example.COM \nexample.com\n  #x\nbank.example.org\n")
    got = sorted(r["domain"] for r in readers.read_whitelist(spark, str(tmp_path / "w.txt")).collect())
    assert got == ["bank.example.org", "example.com"]


def test_history_files(spark, tmp_path):
    def put(name, value):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(value if isinstance(value, str) else json.dumps(value, indent=1))

    put("x/a.json", {"features": {"f1": 1, "f2": 2.5}, "classification": "spam", "confidence": .9, "risk_score": 10})
    put("x/b.json", {"features": {"f2": 1}, "classification": "sospechoso"})
    put("y/c.json", {"classification": "spam"})
    put("y/d.json", "{not json")
    got = readers.read_analyses(spark, str(tmp_path))
    assert sorted((r["classification"], r["confidence"], r["risk_score"]) for r in got.collect()) == [
        ("sospechoso", .5, 50.0), ("spam", .9, 10.0)]
    table = {r["y"]: r["vector"] for r in EV.prepare_training_table(got).collect()}
    assert table == {1: [1.0, 2.5], 2: [0.0, 1.0]}
    assert [tuple(r) for r in EV.class_distribution(got).collect()] == [("sospechoso", 1), ("spam", 1)]


def test_quarantine_round_trip(spark, tmp_path):
    allow = spark.createDataFrame([], "domain string")
    done = TG.triage(mails(spark), allow, seed_training(spark))
    gate = sinks.gated(done)
    path = str(tmp_path / "q")
    sinks.write_quarantine(gate, path)
    (tmp_path / "q" / "extra.json").write_text('{"file": "cut\nnot json\n\n[1]\n"x"\n{}\n {"classification": "spam"}\n')
    back = readers.read_quarantine(spark, path)
    assert back.count() == gate.where("quality.action = 'QUARANTINE'").count() + 2 > 2
    assert [tuple(r) for r in sinks.quarantine_summary(back.limit(0)).collect()] == [("total", 0)]
    summary = {r["reason"]: r["count"] for r in sinks.quarantine_summary(back).collect()}
    assert summary["total"] == back.count() and summary["RISK_MISALIGNED"] >= 1


def test_sinks_write_by_class(spark, tmp_path):
    allow = spark.createDataFrame([("known.example",)], "domain string")
    done = TG.triage(mails(spark), allow, seed_training(spark))
    for name, write in (("a", sinks.write_analyses), ("r", sinks.route_processed), ("c", sinks.write_cases),
                        ("m", sinks.write_manual_review)):
        write(done, str(tmp_path / name))
    assert {p.name for p in (tmp_path / "a").iterdir() if p.is_dir()} == {"classification=legitimo", "classification=spam"}
    assert spark.read.parquet(str(tmp_path / "c")).count() == 3
    assert spark.read.json(str(tmp_path / "m")).count() >= 1
    assert spark.read.json(str(tmp_path / "r")).count() == 5


def test_file_sets(spark, tmp_path):
    for n in ("a.txt", "b.txt"):
        (tmp_path / n).write_text("x")
    listing = readers.list_files(spark, str(tmp_path), "*.txt").withColumn(
        "path", F.element_at(F.split("path", "/"), -1))
    asked = spark.createDataFrame([("a.txt",), ("z.txt",)], "path string")
    assert [r["path"] for r in readers.existing_inputs(asked, listing).collect()] == ["a.txt"]
    assert [r["path"] for r in readers.missing_inputs(asked, listing).collect()] == ["z.txt"]
    assert [r["path"] for r in readers.new_files(listing, asked).collect()] == ["b.txt"]
    assert [r["path"] for r in readers.still_present(asked, listing).collect()] == ["a.txt"]


def test_prompts(spark):
    from tamiz.operators import parsing

    allow = spark.createDataFrame([("known.example",)], "domain string")
    scored = TG.score_signals(parsing.extract_signals(parsing.parse_reports(mails(spark))), allow)
    got = {r["report_id"]: r["prompt"] for r in sinks.response_requests(scored).collect()}
    assert "legit" not in got and "Indicadores: Ninguno" in got["spam"] and "Risk Score: 32/100" in got["phishing"]
