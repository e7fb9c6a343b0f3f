"""Cross-validation of a decision and the gate in front of the training table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, TriageConfig


def risk_aligned(risk: Column, classification: Column) -> Column:
    """The score lies in the range expected of the class."""
    return (
        F.when(classification == "sospechoso", risk >= 65)
        .when(classification == "spam", risk.between(40, 75))
        .otherwise(risk <= 40)
    )


def knn_agreement(knn: Column, classification: Column, cfg: TriageConfig = DEFAULT) -> Column:
    """STRUCT<ok, score>; a hesitant vote neither confirms nor contradicts."""
    def result(ok, score):
        return F.struct(F.lit(ok).alias("ok"), F.lit(score).alias("score"))

    return (
        F.when(knn["confidence"] < cfg.knn_vote_floor, result(True, 0.5))
        .when(knn["classification"] == classification, result(True, 1.0))
        .otherwise(result(False, 0.2))
    )


def heuristic_class(score: Column) -> Column:
    """Class the content heuristics would give (bounds are strict, on binary doubles)."""
    return (
        F.when(score > 0.60, F.lit("sospechoso"))
        .when(score > 0.30, F.lit("spam"))
        .otherwise(F.lit("legitimo"))
    )


def heuristic_agreement(score: Column, classification: Column) -> Column:
    """STRUCT<ok, score>; mixing up spam and legitimo is a small difference."""
    guess = heuristic_class(score)
    close = (((guess == "legitimo") & (classification == "spam"))
             | ((guess == "spam") & (classification == "legitimo")))

    def result(ok, points):
        return F.struct(F.lit(ok).alias("ok"), F.lit(points).alias("score"))

    return (
        F.when(guess == classification, result(True, 1.0))
        .when(close, result(True, 0.7))
        .otherwise(result(False, 0.3))
    )


def cross_validate(heuristic_score: Column, classification: Column, confidence: Column,
                   knn: Column, risk: Column, cfg: TriageConfig = DEFAULT) -> Column:
    """STRUCT<is_valid, confidence, flags, recommendation, details> of a decision.

    ``knn`` (STRUCT<classification, confidence>) and ``risk`` may be NULL and then count half.
    """
    w = cfg.validator_weight
    has_knn, has_risk = knn.isNotNull(), risk.isNotNull()
    vote = knn_agreement(knn, classification, cfg)
    heur = heuristic_agreement(heuristic_score, classification)
    aligned = risk_aligned(risk, classification)
    knn_bad = has_knn & ~vote["ok"]
    heur_bad = ~heur["ok"]
    risk_bad = F.coalesce(has_risk & ~aligned, F.lit(False))
    own_low = confidence < cfg.validator_review
    total = (
        F.when(has_knn, vote["score"] * w).otherwise(F.lit(w / 2))
        + heur["score"] * w
        + F.when(has_risk, F.when(aligned, 1.0).otherwise(0.3) * w).otherwise(F.lit(w / 2))
        + F.least(confidence, F.lit(1.0)) * w
    )
    errors = knn_bad.cast("int") + heur_bad.cast("int") + risk_bad.cast("int")
    flags = F.filter(F.array(
        F.when(knn_bad, F.lit("knn_disagreement")),
        F.when(heur_bad, F.lit("heuristic_mismatch")),
        F.when(risk_bad, F.lit("risk_mismatch")),
        F.when(own_low, F.lit("low_llm_confidence")),
    ), lambda f: f.isNotNull())
    recommendation = (
        F.when(errors >= 2, F.lit("REVIEW"))
        .when((errors == 1) & (total < cfg.validator_review), F.lit("REVIEW"))
        .when(total > cfg.validator_safe, F.lit("SAFE"))
        .otherwise(F.lit("REVIEW"))
    )
    return F.struct(
        F.lit(True).alias("is_valid"),
        total.alias("confidence"),
        flags.alias("flags"),
        recommendation.alias("recommendation"),
        F.struct(
            (has_knn & ~knn_bad).alias("knn_agreement"),
            confidence.alias("llm_self_confidence"),
            (~heur_bad).alias("heuristic_match"),
            (~risk_bad).alias("risk_aligned"),
        ).alias("details"),
    )


ISSUE_FIELDS = ("type string, severity string, value double, threshold double, "
                "risk_score double, classification string, count int")


def _issue(kind: str, severity: str, **values: Column) -> Column:
    def field(name, dtype):
        return values.get(name, F.lit(None)).cast(dtype).alias(name)

    return F.struct(
        F.lit(kind).alias("type"), F.lit(severity).alias("severity"),
        field("value", "double"), field("threshold", "double"), field("risk_score", "double"),
        field("classification", "string"), field("count", "int"))


def quality_gate(header_count: Column, suspicious: Column, classification: Column,
                 confidence: Column, risk: Column, cfg: TriageConfig = DEFAULT) -> Column:
    """STRUCT<is_safe, issues, action> deciding whether an example may be learned from."""
    low = confidence < cfg.quality_min_confidence
    misaligned = ~risk_aligned(risk, classification)
    incomplete = header_count < cfg.quality_min_headers
    issues = F.filter(F.array(
        F.when(low, _issue("LOW_CONFIDENCE", "WARNING", value=confidence,
                           threshold=F.lit(cfg.quality_min_confidence))),
        F.when(misaligned, _issue("RISK_MISALIGNED", "ERROR", risk_score=risk,
                                  classification=classification)),
        F.when(suspicious, _issue("SUSPICIOUS_HEADERS", "WARNING")),
        F.when(incomplete, _issue("INCOMPLETE_HEADERS", "ERROR", count=header_count)),
    ), lambda i: i.isNotNull())
    warnings = low.cast("int") + suspicious.cast("int")
    action = (
        F.when(misaligned | incomplete, F.lit("QUARANTINE"))
        .when((warnings > 1)
              | ((warnings > 0) & (confidence < cfg.quality_review_confidence)),
              F.lit("MANUAL_REVIEW"))
        .otherwise(F.lit("ADD"))
    )
    return F.struct((action == "ADD").alias("is_safe"), issues.alias("issues"),
                    action.alias("action"))
