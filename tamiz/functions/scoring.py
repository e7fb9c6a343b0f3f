"""Risk score, deterministic classification and reading of model answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from .mail import has_verdict
from .text import strip


def _weight(value: Column, weights: dict[str, int]) -> Column:
    out = None
    for k, w in weights.items():
        out = F.when(value == k, F.lit(w)) if out is None else out.when(value == k, F.lit(w))
    return out.otherwise(F.lit(0))


def _steps(conditions) -> Column:
    out = None
    for condition, points in conditions:
        out = (F.when(condition, F.lit(points)) if out is None
               else out.when(condition, F.lit(points)))
    return out.otherwise(F.lit(0))


def risk_score(auth: Column, reason_count: Column, url_count: Column, microsoft_urls: Column,
               abuse_score: Column, homograph: Column) -> Column:
    """INT 0-100 from authentication, verdict, reasons, URLs, sender reputation, look-alikes."""
    score = (
        _weight(auth["spf"], C.RISK_SPF)
        + _weight(auth["dkim"], C.RISK_DKIM)
        + _weight(auth["dmarc"], C.RISK_DMARC)
        + F.when(has_verdict(microsoft_urls), F.lit(C.RISK_QUESTIONABLE_URL)).otherwise(0)
        + F.least(reason_count * C.RISK_PER_REASON, F.lit(C.RISK_REASON_CAP))
        + _steps([(url_count > n, p) for n, p in C.RISK_URL_STEPS])
        + _steps([(abuse_score >= n, p) for n, p in C.RISK_ABUSE_STEPS])
        + F.when(homograph.isNotNull(), F.lit(C.RISK_HOMOGRAPH)).otherwise(0)
    )
    return F.least(score, F.lit(C.RISK_CAP)).cast("int")


def homograph_reason(homograph: Column) -> Column:
    return F.when(homograph.isNotNull(),
                  F.concat(F.lit("Dominio homógrafo de '"), homograph, F.lit("' detectado")))


def verdict_reason(microsoft_urls: Column) -> Column:
    return F.when(has_verdict(microsoft_urls),
                  F.concat(F.lit("Microsoft detectó URLs sospechosas: "), microsoft_urls))


def prepend(first: Column, rest: Column) -> Column:
    """Array with a nullable element in front."""
    return F.concat(F.filter(F.array(first), lambda r: r.isNotNull()), rest)


def decision(classification, confidence, reasoning) -> Column:
    """STRUCT<classification, confidence, reasoning>."""
    return F.struct(classification.cast("string").alias("classification"),
                    confidence.cast("double").alias("confidence"),
                    reasoning.cast("string").alias("reasoning"))


def fallback_classify(auth: Column, microsoft_urls: Column, homograph: Column,
                      abuse_score: Column, risk: Column) -> Column:
    """Deterministic decision used when no model answer is available."""
    all_pass = ((auth["spf"] == "pass") & (auth["dkim"] == "pass")
                & (auth["dmarc"] == "pass"))
    return (
        F.when(has_verdict(microsoft_urls),
               decision(F.lit("sospechoso"), F.lit(0.85), verdict_reason(microsoft_urls)))
        .when(homograph.isNotNull(),
              decision(F.lit("sospechoso"), F.lit(0.9), homograph_reason(homograph)))
        .when(abuse_score >= 80,
              decision(F.lit("sospechoso"), F.lit(0.8), F.format_string(
                  "IP origen con AbuseIPDB score %d", abuse_score)))
        .when(risk >= 60,
              decision(F.lit("sospechoso"), F.lit(0.7), F.format_string(
                  "Risk score alto: %d/100", risk)))
        .when(all_pass & (risk < 30),
              decision(F.lit("spam"), F.lit(0.75),
                       F.lit("Autenticación completa y risk score bajo")))
        .otherwise(decision(F.lit("spam"), F.lit(0.5), F.format_string(
            "Sin indicadores claros de phishing (score: %d)", risk)))
    )


def parse_response(text: Column, risk: Column, fallback: Column) -> Column:
    """Decision in a model's answer text; the fallback where it holds no usable object.

    Fences are removed and the whole text read as JSON; failing that, the span from the first
    to the last brace.  Labels outside the two expected ones are remapped, or decided by risk.
    """
    clean = strip(F.regexp_replace(text, "```(?:json)?", ""))
    span = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    parsed = F.coalesce(F.try_parse_json(clean),
                        F.when(span != "", F.try_parse_json(span)))
    is_object = F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT"))
    label_value = F.try_variant_get(parsed, "$.classification", "variant")
    label_type = F.schema_of_variant(label_value)
    label = F.coalesce(F.try_variant_get(parsed, "$.classification", "string"), F.lit(""))
    lowered = F.lower(label)
    mapped = F.coalesce(*[
        F.when(F.contains(lowered, F.lit(k)), F.lit(v)) for k, v in C.RESPONSE_LABEL_MAP])
    classification = (
        F.when(lowered.isin(*C.RESPONSE_LABELS), label)
        .when(mapped.isNotNull(), mapped)
        .when(risk >= 50, F.lit("sospechoso"))
        .otherwise(F.lit("spam"))
    )
    confidence = F.coalesce(F.try_variant_get(parsed, "$.confidence", "double"), F.lit(0.5))
    reasoning = F.coalesce(F.try_variant_get(parsed, "$.reasoning", "string"), F.lit(""))
    usable = is_object & (label_value.isNull() | (label_type == "STRING"))
    return F.when(F.coalesce(usable, F.lit(False)),
                  decision(classification, confidence, reasoning)).otherwise(fallback)


def knn_threshold(training_size: Column) -> Column:
    """Confidence a vote must reach, by training-set size."""
    return F.coalesce(
        *[F.when(training_size < n, F.lit(t)) for n, t in C.THRESHOLD_STEPS],
        F.lit(C.THRESHOLD_FLOOR))
