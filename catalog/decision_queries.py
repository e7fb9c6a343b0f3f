"""Decisions: deep analysis, votes, the cascade, validation, gating, outboxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz import constants as C
from tamiz.functions import checks as CK
from tamiz.functions import scoring as SC
from tamiz.operators import knn, parsing, training
from tamiz.plans import triage as TG
from tamiz.session import new_path, settle
from tamiz.sources import sinks

from . import derived as D
from .closed_form import derived, voted
from .registry import query
from .report_queries import parsed, scored, whitelist


def seeds(spark: SparkSession) -> DataFrame:
    return training.seed_training(spark)


def deep(spark, sf, **kw):
    return TG.deep_analysis(D.reports(spark, sf), whitelist(spark), **kw)


def triaged(spark, sf, **kw):
    return TG.triage(D.reports(spark, sf), whitelist(spark), seeds(spark), **kw)


_DEEP_CLASS = "CASE WHEN wl THEN 'legitimo' ELSE fb_class END"
_DEEP_CONF = "CASE WHEN wl THEN 1.0::DOUBLE ELSE fb_conf END"
_DEEP_RISK = "CASE WHEN wl THEN 0 ELSE risk END"


@query("deep_analysis_summary", derived(
    f"{_DEEP_CLASS} AS classification, count(*) AS reports, "
    f"round(avg({_DEEP_RISK}), 6) AS avg_risk, max({_DEEP_RISK}) AS max_risk", "GROUP BY 1"))
def deep_analysis_summary(spark, sf):
    return deep(spark, sf, columns=["classification", "risk_score"]).groupBy("classification").agg(
        F.count(F.lit(1)).alias("reports"), F.round(F.avg("risk_score"), 6).alias("avg_risk"),
        F.max("risk_score").alias("max_risk"))


@query("deep_analysis", derived(f"""i AS report_id, message_id AS mensaje_id,
    {_DEEP_CLASS} AS classification, {_DEEP_CONF} AS confidence, reporter AS reporter_email,
    subject AS original_subject, from_raw AS original_from, reply_to, ip AS sender_ip, spf, dkim, dmarc,
    ms AS microsoft_url_check, CAST(least(nurl, 10) AS INT) AS urls, CAST({_DEEP_RISK} AS INT) AS risk_score,
    CASE WHEN wl THEN '{C.WHITELIST_REASON}' ELSE concat_ws('; ', nullif(deep_reasons, ''), fb_text) END AS reasons"""))
def deep_analysis(spark, sf):
    return deep(spark, sf).select(
        "report_id", "mensaje_id", "classification", "confidence", "reporter_email",
        "original_subject", "original_from", "reply_to", "sender_ip", "indicators.spf",
        "indicators.dkim", "indicators.dmarc", "microsoft_url_check",
        F.size("urls_found").alias("urls"), "risk_score",
        F.array_join("reasons", "; ").alias("reasons"))


@query("whitelist_analysis", derived(
    f"i AS report_id, 1.0::DOUBLE AS confidence, 0 AS risk_score, '{C.WHITELIST_REASON}' AS reason, "
    "spf, CAST(least(nurl, 10) AS INT) AS urls", "WHERE wl"))
def whitelist_analysis(spark, sf):
    return deep(spark, sf).where("classification = 'legitimo'").select(
        "report_id", "confidence", "risk_score", F.col("reasons")[0].alias("reason"),
        "indicators.spf", F.size("urls_found").alias("urls"))


# --- model answers -------------------------------------------------------------------------

_ANSWERS = [
    '{"classification": "sospechoso", "confidence": 0.9, "reasoning": "r"}',
    '```json\n{"classification": "SPAM", "confidence": 0.8}\n```',
    'Respuesta: {"classification": "Phishing attempt", "confidence": 0.7, "reasoning": "x"} fin',
    "sin json", '{"classification": "other", "confidence": 0.6}', "[1, 2]",
    '{"classification": null}', '{"classification": ""}', '{"classification": "legit"}',
    '{"confidence": 0.55}', '{"classification": 7}',
]


def answers(spark, sf):
    texts = F.array(*[F.lit(a) for a in _ANSWERS])
    return D.table(spark, sf, "documents").select(
        F.col("doc_id").alias("report_id"),
        F.get(texts, (F.col("doc_id") % len(_ANSWERS)).cast("int")).alias("text"))


_BY_RISK = "CASE WHEN risk >= 50 THEN 'sospechoso' ELSE 'spam' END"
_ANSWER_CLASS = f"""CASE i % 11 WHEN 0 THEN 'sospechoso' WHEN 1 THEN 'SPAM' WHEN 2 THEN 'sospechoso'
  WHEN 4 THEN {_BY_RISK} WHEN 7 THEN {_BY_RISK} WHEN 8 THEN 'spam' WHEN 9 THEN {_BY_RISK} ELSE fb_class END"""
_ANSWER_CONF = """CASE i % 11 WHEN 0 THEN 0.9::DOUBLE WHEN 1 THEN 0.8::DOUBLE WHEN 2 THEN 0.7::DOUBLE WHEN 4 THEN 0.6::DOUBLE
  WHEN 7 THEN 0.5::DOUBLE WHEN 8 THEN 0.5::DOUBLE WHEN 9 THEN 0.55::DOUBLE ELSE fb_conf END"""


@query("parse_response", derived(f"""i AS report_id, {_ANSWER_CLASS} AS classification,
    {_ANSWER_CONF} AS confidence,
    CASE i % 11 WHEN 0 THEN 'r' WHEN 1 THEN '' WHEN 2 THEN 'x' WHEN 4 THEN '' WHEN 7 THEN '' WHEN 8 THEN ''
      WHEN 9 THEN '' ELSE fb_text END AS reasoning"""))
def parse_response(spark, sf):
    s = scored(spark, sf).withColumn("fb", SC.fallback_classify(
        F.col("indicators"), F.col("microsoft_urls"), F.col("homograph"),
        F.col("ip_reputation.abuse_score"), F.col("deep_risk")))
    joined = s.join(answers(spark, sf), "report_id")
    return joined.select("report_id", SC.parse_response(
        F.col("text"), F.col("deep_risk"), F.col("fb")).alias("d")).select("report_id", "d.*")


@query("deep_analysis_with_answers", derived(
    f"CASE WHEN wl THEN 'legitimo' ELSE {_ANSWER_CLASS} END AS classification, count(*) AS reports, "
    f"round(sum(CASE WHEN wl THEN 1.0::DOUBLE ELSE {_ANSWER_CONF} END), 4) AS confidence", "GROUP BY 1"))
def deep_analysis_with_answers(spark, sf):
    return deep(spark, sf, responses=answers(spark, sf)).groupBy("classification").agg(
        F.count(F.lit(1)).alias("reports"), F.round(F.sum("confidence"), 4).alias("confidence"))


@query("response_requests", derived("""i AS report_id,
    CAST(length('From: ' || from_raw || chr(10) || 'Reply-To: ' || reply_to || chr(10) || 'Subject: ' || subject) AS BIGINT) AS head_chars,
    spf, dkim, dmarc, ip, true AS five_rules, nurl AS urls, coalesce(homo, 'None') AS homograph, coalesce(nullif(deep_reasons, ''), 'Ninguno') AS indicators, risk""",
    "WHERE NOT wl"))
def response_requests(spark, sf):
    p = F.col("prompt")

    def line(label):
        return F.regexp_extract(p, rf"(?m)^{label}: (.*)$", 1)

    head = F.regexp_extract(p, r"(?s)(From: .*?)\nSPF:", 1)
    return sinks.response_requests(scored(spark, sf)).select(
        "report_id", F.length(head).cast("long").alias("head_chars"),
        *[F.regexp_extract(p, rf"{name}: (\w+)", 1).alias(name.lower()) for name in ("SPF", "DKIM", "DMARC")],
        F.regexp_extract(p, r"IP origen: (\S+) \(AbuseScore", 1).alias("ip"),
        F.regexp_like(p, F.lit(r"(?s)\n1\. .*\n2\. .*\n3\. .*\n4\. .*\n5\. ")).alias("five_rules"),
        line("URLs totales").cast("int").alias("urls"),
        line("Homógrafo detectado").alias("homograph"),
        F.regexp_replace(line("Indicadores"), ", ", "; ").alias("indicators"),
        F.regexp_extract(p, r"Risk Score: (\d+)/100", 1).cast("int").alias("risk"))


# --- votes and the cascade -----------------------------------------------------------------

@query("knn_classify_reports", voted("i AS report_id, vclass AS classification, vconf AS confidence"))
def knn_classify_reports(spark, sf):
    v = parsing.feature_table(parsed(spark, sf)).select("report_id", knn.knn_vote(
        F.col("vector"), seeds(spark)).alias("v"))
    return v.select("report_id", TG.label_name(F.col("v.label")).alias("classification"),
                    F.round("v.confidence", 4).alias("confidence"))


@query("confidence_gate", voted(
    "CAST(vconf >= 0.85 AS INT) AS is_confident, count(*) AS reports", "GROUP BY 1"))
def confidence_gate(spark, sf):
    return triaged(spark, sf, columns=["knn"]).groupBy(
        F.col("knn.is_confident").cast("int").alias("is_confident")).agg(
        F.count(F.lit(1)).alias("reports"))


@query("triage", voted("""i AS report_id, source, class AS classification, conf AS confidence,
    CAST(final_risk AS INT) AS risk_score, reporter AS reporter_email, vclass AS knn_class, vconf AS knn_confidence,
    CASE source WHEN 'knn' THEN 1 ELSE -1 END AS knn_was_correct"""))
def triage(spark, sf):
    return triaged(spark, sf).select(
        "report_id", "source", "classification", "confidence", "risk_score", "reporter_email",
        F.col("knn.classification").alias("knn_class"),
        F.col("knn.confidence").alias("knn_confidence"),
        F.coalesce(F.col("knn_was_correct").cast("int"), F.lit(-1)).alias("knn_was_correct"))


@query("knn_analysis", voted("""i AS report_id, vclass AS classification, CAST(vote_risk AS INT) AS risk_score,
    base_reasons AS reasons""", "WHERE source = 'knn'"))
def knn_analysis(spark, sf):
    """Vote-decided rows: reasons without the trailing list of active features."""
    r = F.col("reasons")
    return triaged(spark, sf).where("source = 'knn'").select(
        "report_id", "classification", "risk_score",
        F.array_join(F.slice(r, F.lit(1), F.size(r) - 1), "; ").alias("reasons"))


@query("escalated_reasons", voted("""i AS report_id,
    'KNN: ' || vclass || ' (' || CAST(round_even(vconf * 100, 0) AS INT) || '%) → LLM refinement' AS first_reason,
    fb_text AS last_reason, 2 + CAST(nreasons + (ms <> 'None')::INT AS INT) AS reasons""", "WHERE source = 'llm'"))
def escalated_reasons(spark, sf):
    r = F.col("reasons")
    return triaged(spark, sf).where("source = 'llm'").select(
        "report_id", r[0].alias("first_reason"), F.element_at(r, -1).alias("last_reason"),
        F.size(r).alias("reasons"))


@query("first_reasons", voted("""i AS report_id, CAST(least(5, n) AS INT) AS logged, CAST(least(10, n) AS INT) AS in_case,
    CAST(least(3, n) AS INT) AS in_test""", "", "(SELECT *, CASE source WHEN 'whitelist' THEN 1 WHEN 'knn' THEN nbase + 1 ELSE nreasons + 2 + (ms <> 'None')::INT END AS n FROM tr)"))
def first_reasons(spark, sf):
    r = F.col("reasons")
    return triaged(spark, sf).select("report_id", *[
        F.size(F.slice(r, 1, n)).alias(name)
        for n, name in ((5, "logged"), (10, "in_case"), (3, "in_test"))])


@query("run_summary", voted("kind, key, count, round(100.0::DOUBLE * count / sum(count) OVER (PARTITION BY kind), 1) AS pct",
    "", """(SELECT 'classification' AS kind, class AS key, count(*) AS count FROM tr GROUP BY class
      UNION ALL SELECT 'source', source, count(*) FROM tr GROUP BY source)"""))
def run_summary(spark, sf):
    return TG.run_summary(triaged(spark, sf, columns=["classification", "source"]))


@query("knn_label_feedback", voted(
    "i AS report_id, vclass AS predicted, class AS actual", "WHERE vclass <> class AND source <> 'whitelist'"))
def knn_label_feedback(spark, sf):
    t = settle(triaged(spark, sf, columns=["report_id", "knn", "classification", "source"]), "triaged")
    t = t.where("source <> 'whitelist'")  # no vote is handed on for allow-listed mail
    return training.label_feedback(
        t.select("report_id", F.col("knn.classification").alias("classification")),
        t.select("report_id", "classification")).select("report_id", "predicted", "actual")


@query("train_summary", voted("""CAST(15 AS BIGINT) AS examples_before, CAST(least(1000, 15 + (SELECT count(*) FROM tr)) AS BIGINT) AS examples_after,
    (SELECT count(*) FROM tr) AS added, CAST(0 AS BIGINT) AS failed""", "", "(SELECT 1)"))
def train_summary(spark, sf):
    """Mode train end to end: evaluated mail becomes training rows."""
    rows = TG.batch_evaluate(D.reports(spark, sf), whitelist(spark), seeds(spark), "train")
    return TG.train_on_evaluated(rows, seeds(spark))[1]


@query("batch_evaluate_quick", voted("vclass AS classification, count(*) AS n", "GROUP BY 1"))
def batch_evaluate_quick(spark, sf):
    return TG.batch_evaluate(D.reports(spark, sf), whitelist(spark), seeds(spark), "quick"
                             ).groupBy("classification").agg(F.count(F.lit(1)).alias("n"))


_FULL = """(SELECT *, CASE WHEN vconf >= 0.85 THEN 'knn' ELSE 'llm' END AS src,
  CASE WHEN vconf >= 0.85 THEN vclass WHEN wl THEN 'legitimo' ELSE fb_class END AS cls,
  CASE WHEN vconf >= 0.85 THEN 0 WHEN wl THEN 1 ELSE least(3, nreasons + 1 + (ms <> 'None')::INT) END AS shown FROM tr)"""


@query("batch_evaluate_full", voted(
    "i AS report_id, cls AS classification, src AS source, CAST(shown AS INT) AS reasons", "", _FULL))
def batch_evaluate_full(spark, sf):
    return TG.batch_evaluate(D.reports(spark, sf), whitelist(spark), seeds(spark), "full").select(
        "report_id", "classification", "source", F.size("reasons").alias("reasons"))


@query("batch_evaluate_train", voted(
    "cls AS classification, src AS source, count(*) AS n, CAST(sum(CASE cls WHEN 'spam' THEN 1 WHEN 'sospechoso' THEN 2 ELSE 0 END) AS BIGINT) AS labels",
    "GROUP BY 1, 2", _FULL))
def batch_evaluate_train(spark, sf):
    return TG.batch_evaluate(D.reports(spark, sf), whitelist(spark), seeds(spark), "train"
                             ).groupBy("classification", "source").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("labels"))


# --- validation and gating -----------------------------------------------------------------

_CHECKS = """
ck AS (SELECT *, least(conf, 1.0) AS own,
  CASE WHEN vconf < 0.6 THEN 0.5::DOUBLE WHEN vclass = class THEN 1.0::DOUBLE ELSE 0.2::DOUBLE END AS s1,
  vconf >= 0.6 AND vclass <> class AS f1,
  CASE WHEN heur > 0.6::DOUBLE THEN 'sospechoso' WHEN heur > 0.3::DOUBLE THEN 'spam' ELSE 'legitimo' END AS hclass,
  CASE class WHEN 'sospechoso' THEN final_risk >= 65 WHEN 'spam' THEN final_risk BETWEEN 40 AND 75 ELSE final_risk <= 40 END AS aligned
  FROM tr WHERE source = 'llm'),
ck2 AS (SELECT *,
  CASE WHEN hclass = class THEN 1.0::DOUBLE WHEN hclass IN ('legitimo', 'spam') AND class IN ('legitimo', 'spam') THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END AS s2
  FROM ck),
ck3 AS (SELECT *, s2 = 0.3::DOUBLE AS f2, NOT aligned AS f3, conf < 0.7 AS f4,
  s1 * 0.25 + s2 * 0.25 + (CASE WHEN aligned THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END) * 0.25 + own * 0.25 AS total FROM ck2),
ck4 AS (SELECT *, f1::INT + f2::INT + f3::INT AS errs FROM ck3),
ck5 AS (SELECT *, CASE WHEN errs >= 2 THEN 'REVIEW' WHEN errs = 1 AND total < 0.7 THEN 'REVIEW' WHEN total > 0.85 THEN 'SAFE' ELSE 'REVIEW' END AS rec,
  concat_ws(',', CASE WHEN f1 THEN 'knn_disagreement' END, CASE WHEN f2 THEN 'heuristic_mismatch' END,
    CASE WHEN f3 THEN 'risk_mismatch' END, CASE WHEN f4 THEN 'low_llm_confidence' END) AS flags FROM ck4)
"""


@query("cross_validate", voted(
    "i AS report_id, round(total, 6) AS confidence, flags, rec AS recommendation", "", "ck5", _CHECKS))
def cross_validate(spark, sf):
    v = sinks.validated(triaged(spark, sf))
    return v.select("report_id", F.round("validation.confidence", 6).alias("confidence"),
                    F.array_join("validation.flags", ",").alias("flags"),
                    "validation.recommendation")


@query("knn_agreement", voted("CAST(NOT f1 AS INT) AS ok, s1 AS score, count(*) AS n", "GROUP BY 1, 2", "ck5", _CHECKS))
def knn_agreement(spark, sf):
    t = triaged(spark, sf).where("source = 'llm'").select(
        CK.knn_agreement(F.col("knn"), F.col("classification")).alias("a"))
    return t.groupBy(F.col("a.ok").cast("int").alias("ok"), F.col("a.score").alias("score")).agg(
        F.count(F.lit(1)).alias("n"))


@query("heuristic_class", derived("""i AS report_id, CASE WHEN heur > 0.6::DOUBLE THEN 'sospechoso'
    WHEN heur > 0.3::DOUBLE THEN 'spam' ELSE 'legitimo' END AS heuristic"""))
def heuristic_class(spark, sf):
    from .report_queries import signals

    return signals(spark, sf).select(
        "report_id", CK.heuristic_class(F.col("heuristic_score")).alias("heuristic"))


@query("risk_aligned", derived(f"""i AS report_id, CAST(CASE {_DEEP_CLASS} WHEN 'sospechoso' THEN risk >= 65
    WHEN 'spam' THEN risk BETWEEN 40 AND 75 ELSE true END AS INT) AS aligned"""))
def risk_aligned(spark, sf):
    return deep(spark, sf).select("report_id", CK.risk_aligned(
        F.col("risk_score"), F.col("classification")).cast("int").alias("aligned"))


GATE = """
g0 AS (SELECT *, conf < 0.65 AS low, NOT (CASE class WHEN 'sospechoso' THEN final_risk >= 65 ELSE final_risk BETWEEN 40 AND 75 END) AS mis
  FROM tr WHERE class IN ('spam', 'sospechoso')),
g AS (SELECT *, CASE WHEN mis THEN 'QUARANTINE' WHEN low THEN 'MANUAL_REVIEW' ELSE 'ADD' END AS action,
  concat_ws(',', CASE WHEN low THEN 'LOW_CONFIDENCE' END, CASE WHEN mis THEN 'RISK_MISALIGNED' END) AS issues FROM g0)
"""


@query("quality_gate", voted("i AS report_id, action, issues", "", "g", GATE))
def quality_gate(spark, sf):
    return sinks.gated(triaged(spark, sf)).select(
        "report_id", "quality.action",
        F.array_join(F.transform("quality.issues", lambda x: x["type"]), ",").alias("issues"))


@query("quarantine_records", voted(
    "CAST(i AS VARCHAR) AS file, class AS classification, conf AS confidence, final_risk::DOUBLE AS risk_score, issues",
    "WHERE action = 'QUARANTINE'", "g", GATE))
def quarantine_records(spark, sf):
    q = sinks.quarantined(sinks.gated(triaged(spark, sf)))
    return q.select("file", "classification", "context.confidence", "context.risk_score",
                    F.array_join(F.transform("quarantine_reasons", lambda x: x["type"]), ","
                                 ).alias("issues"))


@query("quarantine_summary", voted("reason, count(*) AS count", "GROUP BY 1", """(
    SELECT unnest(string_split('total,' || issues, ',')) AS reason FROM g WHERE action = 'QUARANTINE')""", GATE))
def quarantine_summary(spark, sf):
    return sinks.quarantine_summary(sinks.quarantined(sinks.gated(triaged(spark, sf))))


@query("manual_review", voted("""CAST(i AS VARCHAR) AS original_file, from_raw AS "from", subject,
    class AS classification_llm, conf AS confidence_llm, flags""", "WHERE rec = 'REVIEW'", "ck5", _CHECKS))
def manual_review(spark, sf):
    return sinks.manual_review(triaged(spark, sf)).select(
        "original_file", "from", "subject", "classification_llm", "confidence_llm",
        F.array_join("validation.flags", ",").alias("flags"))


@query("active_learning_step", voted("""
    CAST(least(1000, 15 + (SELECT count(*) FROM g WHERE action <> 'QUARANTINE')) AS BIGINT) AS total_examples,
    (SELECT count(*) FROM g WHERE action = 'QUARANTINE') AS quarantined,
    (SELECT count(*) FROM g WHERE action = 'MANUAL_REVIEW') AS reviewed""", "", "(SELECT 1)", GATE))
def active_learning_step(spark, sf):
    from tamiz.streaming.agent import learned_examples

    gate = settle(sinks.gated(triaged(spark, sf)), "gated")
    grown = training.append_training(seeds(spark), learned_examples(gate))
    counts = gate.agg(F.count_if(F.col("quality.action") == "QUARANTINE").alias("quarantined"),
                      F.count_if(F.col("quality.action") == "MANUAL_REVIEW").alias("reviewed"))
    return grown.agg(F.count(F.lit(1)).alias("total_examples")).join(counts)


# --- outboxes ------------------------------------------------------------------------------

@query("alerts_outbox", voted("""message_id AS mensaje_id, '[Triage] ' || subject AS alert_title, from_raw AS source_email,
    reporter AS recipient_email, CAST(final_risk AS INT) AS risk_score, 'high' AS alert_severity, 13 AS fields""",
    "WHERE class = 'sospechoso'"))
def alerts_outbox(spark, sf):
    p = F.col("payload")

    def f(name):
        return F.get_json_object(p, f"$.{name}")

    return sinks.alerts_outbox(triaged(spark, sf)).select(
        "mensaje_id", f("alert_title").alias("alert_title"), f("source_email").alias("source_email"),
        f("recipient_email").alias("recipient_email"),
        f("risk_score").cast("int").alias("risk_score"),
        f("alert_severity").alias("alert_severity"),
        F.size(F.json_object_keys(p)).alias("fields"))


@query("cases_outbox", voted("""message_id AS mensaje_id, substr('Phishing: ' || subject, 1, 60) AS case_name,
    CAST(final_risk AS INT) AS risk_score, reporter, ip AS sender_ip, ms AS microsoft_url_check, spf""",
    "WHERE class = 'sospechoso'"))
def cases_outbox(spark, sf):
    p = F.col("payload")

    def f(name):
        return F.get_json_object(p, f"$.{name}")

    return sinks.cases_outbox(triaged(spark, sf)).select(
        "mensaje_id", f("case_name").alias("case_name"),
        f("custom_attributes.risk_score").cast("int").alias("risk_score"),
        f("custom_attributes.reporter").alias("reporter"),
        f("custom_attributes.sender_ip").alias("sender_ip"),
        f("custom_attributes.microsoft_url_check").alias("microsoft_url_check"),
        F.regexp_extract(f("case_description"), r"- SPF: (\w+)", 1).alias("spf"))


@query("reporter_notices", voted("""message_id AS mensaje_id, reporter AS recipient,
    '[Triage] Resultado de análisis: ' || upper(class) AS subject,
    CASE class WHEN 'sospechoso' THEN 'Score de riesgo: ' || CAST(final_risk AS INT) || '/100' ELSE '' END AS score_line"""))
def reporter_notices(spark, sf):
    return sinks.reporter_notices(triaged(spark, sf)).select(
        "mensaje_id", "recipient", "subject",
        F.regexp_extract("body", r"(Score de riesgo: \d+/100)", 1).alias("score_line"))


@query("webhook_payloads", voted("""message_id AS mensaje_id, class AS webhook, reporter AS reporter_email,
    CAST(final_risk AS INT) AS risk_score, 12 AS fields""", "WHERE class <> 'sospechoso'"))
def webhook_payloads(spark, sf):
    p = F.col("payload")
    return sinks.webhook_payloads(triaged(spark, sf)).select(
        "mensaje_id", "webhook", F.get_json_object(p, "$.reporter_email").alias("reporter_email"),
        F.get_json_object(p, "$.risk_score").cast("int").alias("risk_score"),
        F.size(F.json_object_keys(p)).alias("fields"))


def filed(spark, sf) -> DataFrame:
    """Derived reports with the path of a file, as the reader gives them."""
    return D.reports(spark, sf).withColumn("path", F.format_string("/in/correo %d.b.txt", "report_id"))


@query("routed_names", voted("i AS report_id, class AS classification, 'correo ' || i || '.b.txt' AS name, '/in/correo ' || i || '.b.txt' AS source_path, true AS stamped"))
def routed_names(spark, sf):
    """Where each processed file goes: its name after a stamp of the moment, in the folder of its class."""
    done = TG.triage(filed(spark, sf), whitelist(spark), seeds(spark))
    named = sinks.routed(done)
    return named.select(
        F.regexp_extract("source_path", r"(\d+)", 1).cast("long").alias("report_id"), "classification",
        F.regexp_extract("name", r"^\d{8}_\d{6}_(.*)$", 1).alias("name"), "source_path",
        F.try_to_timestamp(F.substring("name", 1, 15), F.lit("yyyyMMdd_HHmmss")).isNotNull().alias("stamped"))


@query("fallback_ids", """SELECT doc_id AS report_id, md5('/in/correo ' || doc_id || '.b.txt') AS mensaje_id FROM documents""")
def fallback_ids(spark, sf):
    """Mail without a Message-ID is known by the MD5 of its path."""
    bare = filed(spark, sf).withColumn("content", F.regexp_replace("content", r"Message-ID: [^\n]*\n", ""))
    return TG.deep_analysis(bare, whitelist(spark), columns=["report_id", "mensaje_id"])


@query("fallback_ids_after_votes", voted("i AS report_id, CASE source WHEN 'knn' THEN 'correo ' || i || '.b' ELSE md5('/in/correo ' || i || '.b.txt') END AS mensaje_id"))
def fallback_ids_after_votes(spark, sf):
    """The same in the cascade: where the vote decided, the file's name without its ending stands in."""
    bare = filed(spark, sf).withColumn("content", F.regexp_replace("content", r"Message-ID: [^\n]*\n", ""))
    return TG.triage(bare, whitelist(spark), seeds(spark), columns=["report_id", "mensaje_id"])


@query("route_processed", voted("class AS classification, count(*) AS files", "GROUP BY 1"))
def route_processed(spark, sf):
    return sinks.routed(triaged(spark, sf)).groupBy("classification").agg(
        F.count(F.lit(1)).alias("files"))


def _written(spark, sf):
    """Triage written through the sinks and read back from the partitioned folders."""
    path = new_path(spark, "analyses")
    sinks.write_analyses(triaged(spark, sf), path)
    return spark.read.json(path)


@query("write_analyses", voted(
    "class AS classification, count(*) AS rows, CAST(sum(final_risk) AS BIGINT) AS risk", "GROUP BY 1"))
def write_analyses(spark, sf):
    return _written(spark, sf).groupBy("classification").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("risk_score").cast("long").alias("risk"))


@query("write_cases", voted("class AS classification, source, count(*) AS cases, count(*) AS stamped", "GROUP BY 1, 2"))
def write_cases(spark, sf):
    path = new_path(spark, "cases")
    sinks.write_cases(triaged(spark, sf), path)
    return spark.read.parquet(path).groupBy("classification", "source").agg(
        F.count(F.lit(1)).alias("cases"), F.count("ts").alias("stamped"))

