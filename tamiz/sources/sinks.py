"""Outgoing tables.  Where a message would be sent, a row of an outbox table is produced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..config import DEFAULT, TriageConfig
from ..functions.checks import cross_validate, quality_gate
from ..operators.stats import cases_of
from ..plans.triage import ANALYSIS_COLUMNS


def save(df: DataFrame, path: str, partition: str | None = None, fmt: str = "json",
         mode: str = "append") -> None:
    writer = df.write.mode(mode)
    if partition:
        writer = writer.partitionBy(partition)
    writer.format(fmt).save(path)


# --- results -------------------------------------------------------------------------------

def write_analyses(analyses: DataFrame, path: str, fmt: str = "json") -> None:
    """Append analyses, one folder per class."""
    save(analyses.select(*ANALYSIS_COLUMNS), path, "classification", fmt)


def routed(analyses: DataFrame) -> DataFrame:
    """(classification, name, source_path): where each processed file goes."""
    stamp = F.date_format(F.coalesce("analysis_date", F.current_timestamp()),
                          "yyyyMMdd_HHmmss")
    name = F.element_at(F.split("path", "/"), -1)
    return analyses.select(
        "classification", F.concat_ws("_", stamp, name).alias("name"),
        F.col("path").alias("source_path"))


def route_processed(analyses: DataFrame, path: str, fmt: str = "json") -> None:
    save(routed(analyses), path, "classification", fmt)


def write_cases(analyses: DataFrame, path: str) -> None:
    save(cases_of(analyses), path, fmt="parquet")


# --- review and quarantine -----------------------------------------------------------------

def validated(analyses: DataFrame, cfg: TriageConfig = DEFAULT) -> DataFrame:
    """Deep-path analyses plus their ``validation`` STRUCT."""
    deep = analyses.where("source = 'llm'")
    return deep.withColumn("validation", cross_validate(
        F.col("heuristic_score"), F.col("classification"), F.col("confidence"),
        F.col("knn"), F.col("risk_score").cast("double"), cfg))


def manual_review(analyses: DataFrame, cfg: TriageConfig = DEFAULT) -> DataFrame:
    """The seven fields kept of every decision that needs a person."""
    return validated(analyses, cfg).where("validation.recommendation = 'REVIEW'").select(
        F.col("path").alias("original_file"),
        F.col("original_from").alias("from"),
        F.col("original_subject").alias("subject"),
        F.col("classification").alias("classification_llm"),
        F.col("confidence").alias("confidence_llm"),
        "validation",
        F.col("analysis_date").cast("string").alias("timestamp"))


def write_manual_review(analyses: DataFrame, path: str, cfg: TriageConfig = DEFAULT) -> None:
    save(manual_review(analyses, cfg), path)


def gated(analyses: DataFrame, cfg: TriageConfig = DEFAULT) -> DataFrame:
    """Learnable analyses (spam and sospechoso) plus their ``quality`` STRUCT."""
    learnable = analyses.where(
        "classification IN ('spam', 'sospechoso') AND source <> 'unreported'")
    return learnable.withColumn("quality", quality_gate(
        F.col("header_count"), F.col("suspicious_headers"), F.col("classification"),
        F.col("confidence"), F.col("risk_score").cast("double"), cfg))


def quarantined(gated_rows: DataFrame) -> DataFrame:
    """Quarantine records of gated rows."""
    return gated_rows.where("quality.action = 'QUARANTINE'").select(
        F.col("path").alias("file"), "classification",
        F.col("quality.issues").alias("quarantine_reasons"),
        F.struct("confidence", F.col("risk_score").cast("double").alias("risk_score")
                 ).alias("context"),
        F.col("analysis_date").cast("string").alias("timestamp"))


def write_quarantine(gated_rows: DataFrame, path: str) -> None:
    save(quarantined(gated_rows), path)


def quarantine_summary(records: DataFrame) -> DataFrame:
    """(reason, count) plus a row ``total`` with the number of records, 0 for none; one pass.

    Records without reasons count in the total only.
    """
    reasons = F.coalesce(F.transform("quarantine_reasons", lambda r: r["type"]), F.array().cast("array<string>"))
    keys = F.filter(F.concat(F.array(F.lit("total")), reasons), lambda r: r.isNotNull())
    counted = records.select(F.explode(keys).alias("reason"), F.lit(1).alias("n"))
    nothing = records.sparkSession.range(1).select(F.lit("total").alias("reason"), F.lit(0).alias("n"))
    return counted.unionByName(nothing).groupBy("reason").agg(F.sum("n").alias("count"))


# --- outboxes ------------------------------------------------------------------------------

def alerts_outbox(analyses: DataFrame, cfg: TriageConfig = DEFAULT) -> DataFrame:
    """(mensaje_id, payload): 13-field alert for every suspicious mail."""
    fields = F.struct(
        F.concat(F.lit(f"[{cfg.brand}] "), F.col("original_subject")).alias("alert_title"),
        F.format_string(
            "Phishing reportado por: %s\nRemitente: %s\nAsunto: %s\nScore de riesgo: %d/100",
            "reporter_email", "original_from", "original_subject", "risk_score"
        ).alias("alert_description"),
        F.lit(cfg.brand).alias("alert_source"),
        F.lit(cfg.alert_severity).alias("alert_severity"),
        F.lit("new").alias("alert_status"),
        F.lit(cfg.customer_id).alias("customer_id"),
        F.lit("phishing").alias("alert_type"),
        F.col("mensaje_id").alias("message_id"),
        F.col("original_from").alias("source_email"),
        F.col("reporter_email").alias("recipient_email"),
        F.col("risk_score"), F.col("classification"),
        F.col("analysis_date").cast("string").alias("analysis_date"))
    return analyses.where("classification = 'sospechoso'").select(
        "mensaje_id", F.to_json(fields, {"ignoreNullFields": "false"}).alias("payload"))


def _bullets(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda i: F.concat(F.lit("- "), i)), "\n")


def cases_outbox(analyses: DataFrame, cfg: TriageConfig = DEFAULT) -> DataFrame:
    """(mensaje_id, payload): investigation case with a readable description."""
    def or_na(name):
        return F.when(F.col(name) == "", F.lit("N/A")).otherwise(F.col(name))

    percent = F.bround(F.col("confidence") * 100, 0).cast("int").cast("string")
    description = F.concat(
        F.lit("**From:** "), F.col("original_from"),
        F.lit("\n**Reply-To:** "), or_na("reply_to"),
        F.lit("\n**Subject:** "), F.col("original_subject"),
        F.lit("\n**Reporter:** "), F.col("reporter_email"),
        F.lit("\n**Risk Score:** "), F.col("risk_score").cast("string"),
        F.lit("/100\n**Confidence:** "), percent,
        F.lit("%\n\n**IP Origen:** "), F.col("sender_ip"),
        F.lit(" (AbuseScore: "), F.col("ip_reputation.abuse_score").cast("string"),
        F.lit(")\n\n**Microsoft URL Check:** "), F.col("microsoft_url_check"),
        F.lit("\n\n**Indicadores:**\n- SPF: "), F.col("indicators.spf"),
        F.lit("\n- DKIM: "), F.col("indicators.dkim"),
        F.lit("\n- DMARC: "), F.col("indicators.dmarc"),
        F.lit("\n\n**Razones de sospecha:**\n"), _bullets(F.slice("reasons", 1, 10)),
        F.lit("\n\n**URLs encontradas:**\n"), _bullets(F.col("urls_found")))
    fields = F.struct(
        F.concat(F.lit("Phishing: "), F.substring("original_subject", 1, 50)
                 ).alias("case_name"),
        description.alias("case_description"),
        F.lit(cfg.customer_id).alias("case_customer"),
        F.lit(cfg.case_classification_id).alias("classification_id"),
        F.lit("").alias("case_soc_id"),
        F.lit("phishing,email-security,automated").alias("case_tags"),
        F.struct(
            F.col("risk_score"), F.col("reporter_email").alias("reporter"),
            F.col("sender_ip"),
            F.col("ip_reputation.abuse_score").alias("ip_abuse_score"),
            F.col("microsoft_url_check")).alias("custom_attributes"))
    return analyses.where("classification = 'sospechoso'").select(
        "mensaje_id", F.to_json(fields).alias("payload"))


def reporter_notices(analyses: DataFrame, cfg: TriageConfig = DEFAULT) -> DataFrame:
    """(mensaje_id, recipient, subject, body) for every analysis with a reporter."""
    sender, topic = F.col("original_from"), F.col("original_subject")
    body = (
        F.when(F.col("classification") == "legitimo",
               F.format_string(C.NOTICE_TEXT["legitimo"], sender, topic))
        .when(F.col("classification") == "spam",
              F.format_string(C.NOTICE_TEXT["spam"], sender, topic))
        .when(F.col("classification") == "sospechoso",
              F.format_string(C.NOTICE_TEXT["sospechoso"], sender, topic,
                              F.col("risk_score")))
        .otherwise(F.lit("Tu reporte fue procesado.")))
    return analyses.where("reporter_email <> ''").select(
        "mensaje_id", F.col("reporter_email").alias("recipient"),
        F.concat(F.lit(f"[{cfg.brand}] Resultado de análisis: "),
                 F.upper("classification")).alias("subject"),
        body.alias("body"))


WEBHOOK_FIELDS = [
    "reporter_email", "classification", "confidence", "original_subject", "original_from",
    "reply_to", "sender_ip", "ip_reputation", "risk_score", "reasons", "microsoft_url_check",
    "analysis_date",
]


def webhook_payloads(analyses: DataFrame) -> DataFrame:
    """(mensaje_id, webhook, payload) for spam and legitimo."""
    return analyses.where("classification IN ('spam', 'legitimo')").select(
        "mensaje_id", F.col("classification").alias("webhook"),
        F.to_json(F.struct(*WEBHOOK_FIELDS), {"ignoreNullFields": "false"}).alias("payload"))


PROMPT_INTRO = (
    "Clasifica el siguiente email reportado con una de dos etiquetas: \"spam\" (correo no deseado sin peligro) o "
    "\"sospechoso\" (posible phishing que una persona debe revisar). Criterios:\n"
    "1. Si SPF, DKIM y DMARC pasan y el riesgo es menor que 30, responde \"spam\".\n"
    "2. Si Microsoft no marca ninguna URL y el riesgo es menor que 30, responde \"spam\".\n"
    "3. Responde \"sospechoso\" solo ante pruebas claras: falla de autenticación, URL maliciosa, dominio "
    "homógrafo, Reply-To de otro dominio o IP con muchos reportes de abuso.\n"
    "4. Un boletín enviado con Mailchimp o SendGrid y bien autenticado es \"spam\".\n"
    "5. Si hay duda, responde \"spam\", para no dar falsas alarmas.")
PROMPT_ANSWER = ("Responde solo con JSON: {\"classification\": \"spam\", "
                 "\"confidence\": 0.85, \"reasoning\": \"breve\"}")


def response_requests(scored: DataFrame) -> DataFrame:
    """(report_id, prompt) for rows of ``score_signals`` that a model should judge."""
    reasons = F.array_join("deep_reasons", ", ")
    lines = F.concat(
        F.lit(PROMPT_INTRO), F.lit("\n\nFrom: "), F.col("from_raw"),
        F.lit("\nReply-To: "), F.col("reply_to"),
        F.lit("\nSubject: "), F.coalesce("subject_raw", F.lit("N/A")),
        F.lit("\nSPF: "), F.col("indicators.spf"), F.lit(" | DKIM: "),
        F.col("indicators.dkim"), F.lit(" | DMARC: "), F.col("indicators.dmarc"),
        F.lit("\nMicrosoft URLs sospechosas: "), F.col("microsoft_urls"),
        F.lit("\nURLs totales: "), F.col("url_count").cast("string"),
        F.lit("\nIP origen: "), F.col("sender_ip"), F.lit(" (AbuseScore: "),
        F.col("ip_reputation.abuse_score").cast("string"),
        F.lit(")\nHomógrafo detectado: "), F.coalesce("homograph", F.lit("None")),
        F.lit("\nIndicadores: "), F.when(reasons == "", F.lit("Ninguno")).otherwise(reasons),
        F.lit("\nRisk Score: "), F.col("deep_risk").cast("string"),
        F.lit("/100\n\n"), F.lit(PROMPT_ANSWER))
    return scored.where(~F.col("whitelisted")).select("report_id", lines.alias("prompt"))
