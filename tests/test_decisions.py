import itertools

import pytest
from pyspark.sql import functions as F

from tamiz.functions import checks as CK
from tamiz.functions import scoring as SC
from tamiz.functions import signals as S
from tamiz.plans import triage as TG
from tamiz.sources import sinks

AUTH = "struct<spf:string,dkim:string,dmarc:string>"


def test_risk_steps(spark):
    rows = [((s, k, m), r, u, v, a, h) for (s, k, m), r, u, v, a, h in itertools.product(
        [("fail", "fail", "fail"), ("softfail", "none", "none"), ("pass", "pass", "pass")], [0, 3, 4],
        [5, 6, 10, 11], ["None", "", "http://x"], [-1, 19, 20, 49, 50, 79, 80], [None, "w.example"])]
    df = spark.createDataFrame(rows, f"a {AUTH}, r int, u int, v string, ab int, h string")
    got = df.select("*", SC.risk_score(F.col("a"), F.col("r"), F.col("u"), F.col("v"), F.col("ab"), F.col("h")
                                       ).alias("risk")).collect()
    two, dm = {"fail": 25, "softfail": 15, "none": 10}, {"fail": 15, "none": 8}
    for x in got:
        want = two.get(x["a"]["spf"], 0) + two.get(x["a"]["dkim"], 0) + dm.get(x["a"]["dmarc"], 0)
        want += 35 * (x["v"] not in ("None", "")) + min(7 * x["r"], 25) + (10 if x["u"] > 10 else 5 if x["u"] > 5 else 0)
        want += 20 if x["ab"] >= 80 else 10 if x["ab"] >= 50 else 5 if x["ab"] >= 20 else 0
        want += 30 * (x["h"] is not None)
        assert x["risk"] == min(want, 100)


def test_fallback_order(spark):
    rows = [("p", "http://x", "w", 90, 10, "sospechoso", .85), ("p", "None", "w", 90, 10, "sospechoso", .9),
            ("p", "None", None, 80, 10, "sospechoso", .8), ("p", "None", None, 79, 60, "sospechoso", .7),
            ("p", "None", None, 79, 29, "spam", .75), ("p", "None", None, -1, 30, "spam", .5),
            ("f", "", None, -1, 0, "spam", .5)]
    df = spark.createDataFrame(
        [(("pass", "pass", "pass" if p == "p" else "none"), *rest) for p, *rest in rows],
        f"a {AUTH}, v string, h string, ab int, risk int, want string, conf double")
    for r in df.select("*", SC.fallback_classify(F.col("a"), F.col("v"), F.col("h"), F.col("ab"), F.col("risk")
                                                 ).alias("d")).collect():
        assert (r["d"]["classification"], r["d"]["confidence"]) == (r["want"], r["conf"])


@pytest.mark.parametrize("text,risk,want", [
    ('{"classification": "spam", "confidence": 0.9, "reasoning": "r"}', 0, ("spam", 0.9, "r")),
    ('```json\n{"classification": "SPAM"}\n```', 0, ("SPAM", 0.5, "")),
    ('ok: {"classification": "Phishing", "confidence": 1} end', 0, ("sospechoso", 1.0, "")),
    ("junk", 0, ("fb", 0.1, "f")), ("{broken} }", 0, ("fb", 0.1, "f")),
    ('{"classification": "other"}', 49, ("spam", 0.5, "")), ('{"classification": "other"}', 50, ("sospechoso", 0.5, "")),
    ('{"classification": ""}', 50, ("sospechoso", 0.5, "")), ('{"classification": "legit mail"}', 99, ("spam", 0.5, "")),
    ('{"confidence": 0.4}', 10, ("spam", 0.4, "")), ("[1]", 0, ("fb", 0.1, "f")), ('"spam"', 0, ("fb", 0.1, "f")),
    ('{"classification": null}', 0, ("fb", 0.1, "f")), ('{"classification": 3}', 0, ("fb", 0.1, "f")), ("{}", 70, ("sospechoso", 0.5, "")),
    ('{"classification": "suspicious marketing"}', 0, ("spam", 0.5, "")),
])
def test_parse_response(spark, text, risk, want):
    df = spark.createDataFrame([(text, risk)], "t string, risk int")
    fallback = SC.decision(F.lit("fb"), F.lit(0.1), F.lit("f"))
    d = df.select(SC.parse_response(F.col("t"), F.col("risk"), fallback).alias("d")).first()["d"]
    assert tuple(d) == want


def test_cross_validation_grid(spark):
    classes = ["legitimo", "spam", "sospechoso"]
    rows = [(h, c, conf, kn, risk) for h, c, conf, kn, risk in itertools.product(
        [0.0, 0.2, 0.3, 0.5, 0.3 + 0.3, 0.7], classes, [0.5, 0.69, 0.70, 1.0],
        [None, ("spam", 0.59), ("spam", 0.60), ("sospechoso", 0.9)], [None, 39.0, 40.0, 41.0, 64.0, 65.0, 75.0, 76.0])]
    df = spark.createDataFrame(
        rows, "h double, c string, conf double, k struct<classification:string,confidence:double>, risk double")
    got = df.select("*", CK.cross_validate(F.col("h"), F.col("c"), F.col("conf"), F.col("k"), F.col("risk")
                                           ).alias("v")).collect()
    for r in got:
        flags, total, c = [], 0.0, r["c"]
        if r["k"] is None:
            total += .125
        elif r["k"]["confidence"] < .6:
            total += .5 * .25
        elif r["k"]["classification"] == c:
            total += .25
        else:
            flags.append("knn_disagreement")
            total += .2 * .25
        guess = "sospechoso" if r["h"] > .6 else "spam" if r["h"] > .3 else "legitimo"
        if guess == c:
            total += .25
        elif {guess, c} == {"legitimo", "spam"}:
            total += .7 * .25
        else:
            flags.append("heuristic_mismatch")
            total += .3 * .25
        if r["risk"] is None:
            total += .125
        else:
            ok = r["risk"] >= 65 if c == "sospechoso" else 40 <= r["risk"] <= 75 if c == "spam" else r["risk"] <= 40
            total += (1.0 if ok else .3) * .25
            flags += [] if ok else ["risk_mismatch"]
        total += r["conf"] * .25
        errors = len(flags)
        flags += ["low_llm_confidence"] if r["conf"] < .7 else []
        rec = ("REVIEW" if errors >= 2 or (errors == 1 and total < .7) else "SAFE" if total > .85 else "REVIEW")
        assert r["v"]["flags"] == flags and abs(r["v"]["confidence"] - total) < 1e-12
        if abs(total - .85) > 1e-12 and abs(total - .7) > 1e-12:
            assert r["v"]["recommendation"] == rec
        assert r["v"]["is_valid"] and r["v"]["details"]["heuristic_match"] == ("heuristic_mismatch" not in flags)


def test_quality_gate_grid(spark):
    rows = list(itertools.product([4, 5], [True, False], ["legitimo", "spam", "sospechoso"], [.64, .65, .69, .70],
                                  [39.0, 40.0, 41.0, 64.0, 65.0, 75.0, 76.0]))
    df = spark.createDataFrame(rows, "n int, s boolean, c string, conf double, risk double")
    for r in df.select("*", CK.quality_gate(F.col("n"), F.col("s"), F.col("c"), F.col("conf"), F.col("risk")
                                            ).alias("q")).collect():
        c = r["c"]
        ok = r["risk"] >= 65 if c == "sospechoso" else 40 <= r["risk"] <= 75 if c == "spam" else r["risk"] <= 40
        warn = (["LOW_CONFIDENCE"] if r["conf"] < .65 else [])
        want = warn + ([] if ok else ["RISK_MISALIGNED"]) + (["SUSPICIOUS_HEADERS"] if r["s"] else []) + (
            ["INCOMPLETE_HEADERS"] if r["n"] < 5 else [])
        warnings = len(warn) + r["s"]
        action = ("QUARANTINE" if not ok or r["n"] < 5
                  else "MANUAL_REVIEW" if warnings > 1 or (warnings and r["conf"] < .7) else "ADD")
        assert [i["type"] for i in r["q"]["issues"]] == want and r["q"]["action"] == action
        assert r["q"]["is_safe"] == (action == "ADD")


def mails(spark):
    phishing = ("Received: from evil.example (203.0.113.9) by relay\nFrom: \"Banco\" <noreply@banco-x.example>\n"
                "To: \"Quien Reporta\" <reporter@corp.example>\nSubject: [URGENTE] Verifica tu cuenta\n"
                "Message-ID: <p1@evil.example>\nX-MS-Has-Attach: \nAuthentication-Results: spf=fail; dkim=fail\n"
                "received-spf: Fail (x)\n\nHaz clic ya:\n\nhttp://banc0.example/login?s=1\n")
    spam = ("Received: from ads.example (192.0.2.100) by relay\nFrom: \"Ofertas\" <promo@ads.example>\n"
            "To: <reporter@corp.example>\nSubject: 90% menos\nMessage-ID: <s1@ads.example>\n\nwww.ads.example/x\n---\n")
    legit = ("From: Dev <dev@known.example>\nTo: d@corp.example\nSubject: Hola equipo\nMessage-ID: <l1@known.example>\n"
             "received-spf: Pass (x)\n\nbody\n")
    orphan = "From: a@b.example\nSubject: x\n\nbody\n"
    rows = [("phishing", phishing), ("spam", spam), ("legit", legit), ("orphan", orphan), ("empty", "")]
    return spark.createDataFrame(rows, "report_id string, content string")


def test_cascade_on_small_mails(spark):
    from tamiz.operators.training import seed_training

    allow = spark.createDataFrame([("known.example",)], "domain string")
    rows = {r["report_id"]: r for r in TG.triage(mails(spark), allow, seed_training(spark)).collect()}
    assert {k: r["source"] for k, r in rows.items()} == {
        "phishing": "llm", "spam": "llm", "legit": "whitelist", "orphan": "unreported", "empty": "unreported"}
    assert rows["legit"]["classification"] == "legitimo" and rows["legit"]["risk_score"] == 0
    p = rows["phishing"]
    assert p["indicators"]["spf"] == "fail" and p["risk_score"] == 25 + 7
    assert p["reasons"][0].startswith("KNN: ") and "Keyword sospechosa: 'urgent'" in p["reasons"]
    assert p["classification"] == "spam" and p["confidence"] == 0.5
    assert rows["spam"]["risk_score"] == 0
    assert {rows[k]["classification"] for k in ("orphan", "empty")} == {"spam"}
    assert sinks.cases_of(TG.triage(mails(spark), allow, seed_training(spark))).count() == 3


def test_outboxes(spark):
    from tamiz.operators.training import seed_training
    import json

    allow = spark.createDataFrame([("banco-y.example",)], "domain string")
    done = TG.triage(mails(spark), allow, seed_training(spark))
    alerts = [json.loads(r["payload"]) for r in sinks.alerts_outbox(done).collect()]
    assert [(a["message_id"], a["alert_type"], len(a)) for a in alerts] == [("<p1@evil.example>", "phishing", 13)]
    case = json.loads(sinks.cases_outbox(done).first()["payload"])
    assert case["custom_attributes"]["reporter"] == "reporter@corp.example"
    assert "- SPF: fail" in case["case_description"]
    notices = {r["mensaje_id"]: r for r in sinks.reporter_notices(done).collect()}
    assert "SOSPECHOSO" in notices["<p1@evil.example>"]["subject"]
    assert {json.loads(r["payload"])["classification"] for r in sinks.webhook_payloads(done).collect()} == {"spam"}
    review = sinks.manual_review(done)
    assert review.columns == ["original_file", "from", "subject", "classification_llm", "confidence_llm",
                              "validation", "timestamp"]


def test_display_name_readings(spark):
    df = spark.createDataFrame([('"a@x.example" <b@y.example>',), ("a@x.example <a@x.example>",), ("<b@y.example>",),
                                ("Name <b@y.example>",), ("a@x.example <>",)], "f string")
    got = [tuple(r) for r in df.select(S.display_name_mismatch(F.col("f")), S.display_name_mismatch_feature(F.col("f"))
                                       ).collect()]
    assert got == [(True, True), (False, False), (False, False), (False, False), (False, False)]
