"""End-to-end plans: deep analysis, and the whitelist -> vote -> deep cascade."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..config import DEFAULT, TriageConfig
from ..functions import features as FX
from ..functions import scoring as SC
from ..operators import domains, knn, parsing
from ..operators import training as TR
from ..session import settle

ANALYSIS_COLUMNS = [
    "mensaje_id", "classification", "confidence", "reporter_email", "original_subject",
    "original_from", "reply_to", "sender_ip", "ip_reputation", "analysis_date", "indicators",
    "headers_raw", "body_preview", "urls_found", "microsoft_url_check", "risk_score", "reasons",
]


def label_name(class_id: Column) -> Column:
    """Class id -> label."""
    return F.get(F.array(*[F.lit(n) for n in C.LABELS]), class_id)


def label_id(label: Column) -> Column:
    """Label -> class id; NULL for an unknown label."""
    out = None
    for i, n in enumerate(C.LABELS):
        out = F.when(label == n, F.lit(i)) if out is None else out.when(label == n, F.lit(i))
    return out


@lru_cache
def _score_columns() -> tuple[Column, dict[str, Column]]:
    homograph, reasons = F.col("homograph"), F.col("_reasons")
    # The look-alike reason is in place before scoring and counts; the verdict reason is not.
    with_homograph = SC.prepend(SC.homograph_reason(homograph), F.col("pattern_reasons"))
    args = (F.col("url_count"), F.col("microsoft_urls"), F.col("ip_reputation.abuse_score"),
            homograph)
    return with_homograph, {
        "deep_risk": SC.risk_score(F.col("indicators"), F.size(reasons), *args),
        # The vote branch scores the look-alike but does not list it as a reason.
        "vote_risk": SC.risk_score(F.col("indicators"), F.size("pattern_reasons"), *args),
        "deep_reasons": SC.prepend(SC.verdict_reason(F.col("microsoft_urls")), reasons),
    }


def score_signals(signals: DataFrame, whitelist: DataFrame,
                  ip_reputation: DataFrame | None = None) -> DataFrame:
    """Signal rows plus whitelist / look-alike verdict, reputation, reasons and risk."""
    looked_up = domains.ip_reputation_join(
        domains.attach_sender_verdicts(signals, whitelist), ip_reputation)
    reasons, scores = _score_columns()
    return looked_up.withColumn("_reasons", reasons).withColumns(scores).drop("_reasons")


@lru_cache
def _deep_columns() -> tuple[Column, Column]:
    fallback = SC.fallback_classify(
        F.col("indicators"), F.col("microsoft_urls"), F.col("homograph"),
        F.col("ip_reputation.abuse_score"), F.col("deep_risk"))
    answered = SC.parse_response(F.col("_answer"), F.col("deep_risk"), F.col("_fallback"))
    return fallback, F.when(F.col("_answer").isNull(), F.col("_fallback")).otherwise(answered)


def _deep_decision(scored: DataFrame, responses: DataFrame | None) -> DataFrame:
    fallback, answered = _deep_columns()
    if responses is None:
        return scored.withColumn("deep", fallback)
    # Files of one name in two folders are two reports, so answers that carry the path are joined by it.
    key = "path" if "path" in responses.columns else "report_id"
    answers = responses.groupBy(key).agg(F.max("text").alias("_answer"))
    joined = scored.join(answers, key, "left").withColumn("_fallback", fallback)
    return joined.withColumn("deep", answered).drop("_answer", "_fallback")


def _as_analysis(df: DataFrame, classification, confidence, reporter, sender, risk,
                 reasons, message_default, extra: list[Column]) -> DataFrame:
    analysed_at = F.current_timestamp().cast("timestamp_ntz")
    arrived_at = (F.col("arrived_at") if "arrived_at" in df.columns
                  else F.lit(None).cast("timestamp_ntz").alias("arrived_at"))
    return df.select(
        "report_id", "path",
        F.coalesce("message_id", message_default).alias("mensaje_id"),
        classification.alias("classification"),
        confidence.alias("confidence"),
        reporter.alias("reporter_email"),
        F.coalesce("subject_raw", F.lit("N/A")).alias("original_subject"),
        sender.alias("original_from"),
        "reply_to", "sender_ip", "ip_reputation",
        analysed_at.alias("analysis_date"),
        "indicators", "headers_raw", "body_preview", "urls_found",
        F.col("microsoft_urls").alias("microsoft_url_check"),
        risk.cast("int").alias("risk_score"),
        reasons.alias("reasons"),
        *extra, arrived_at,
    )


def stored_signals(reports: DataFrame, cfg: TriageConfig = DEFAULT, columns: Sequence[str] | None = None, *unused: str) -> DataFrame:
    """Signal rows, written once: the lookups read the table several times, the mail only this time.

    What takes most room is left empty unless it is among the wanted result ``columns``.
    """
    signals = parsing.extract_signals(parsing.parse_reports(reports), cfg).drop(*unused)
    spare = [] if columns is None else [c for c in ("headers_raw", "body_preview", "urls_found") if c not in columns]
    return settle(signals.withColumns({c: F.lit(None).cast(signals.schema[c].dataType) for c in spare}), "signals")


def _wanted(analyses: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    return analyses if columns is None else analyses.select(*columns)


def deep_analysis(reports: DataFrame, whitelist: DataFrame,
                  ip_reputation: DataFrame | None = None, responses: DataFrame | None = None,
                  cfg: TriageConfig = DEFAULT, columns: Sequence[str] | None = None) -> DataFrame:
    """One analysis row per report: allow-listed, else answered, else decided by rule.

    With ``columns`` the result has only these, and less is written on the way.
    """
    return _wanted(deep_signals(stored_signals(reports, cfg, columns, "vector"), whitelist, ip_reputation, responses), columns)


def deep_signals(signals: DataFrame, whitelist: DataFrame,
                 ip_reputation: DataFrame | None = None, responses: DataFrame | None = None) -> DataFrame:
    """``deep_analysis`` of signal rows; those read from a file are not parsed again."""
    decided = _deep_decision(score_signals(signals, whitelist, ip_reputation), responses)
    listed = F.col("whitelisted")
    return _as_analysis(
        decided,
        F.when(listed, F.lit("legitimo")).otherwise(F.col("deep.classification")),
        F.when(listed, F.lit(1.0)).otherwise(F.col("deep.confidence")),
        F.col("reporter_content"), F.col("from_raw"),
        F.when(listed, F.lit(0)).otherwise(F.col("deep_risk")),
        F.when(listed, F.array(F.lit(C.WHITELIST_REASON))).otherwise(
            F.concat(F.col("deep_reasons"), F.array(F.col("deep.reasoning")))),
        F.md5(F.col("path")),
        [F.col("homograph"), F.col("url_count"), F.col("header_count"),
         F.col("suspicious_headers"), F.col("heuristic_score")],
    )


def file_stem(path: Column) -> Column:
    """File name without folder and last extension."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(F.regexp_like(name, F.lit(r".\.[^.]*\z")),
                  F.regexp_extract(name, r"\A(.+)\.[^.]*\z", 1)).otherwise(name)


def triage_signals(signals: DataFrame, whitelist: DataFrame, training: DataFrame,
                   ip_reputation: DataFrame | None = None, responses: DataFrame | None = None,
                   cfg: TriageConfig = DEFAULT, threshold: float | None = None,
                   vote_before_whitelist: bool = False) -> DataFrame:
    """The cascade over signal rows (see ``triage``)."""
    scored = _deep_decision(score_signals(signals, whitelist, ip_reputation), responses)
    scored = knn.with_vote(scored, "_vote", training, cfg.knn_k)
    bound = cfg.knn_threshold if threshold is None else threshold
    vote, source, analysis, extra = _cascade_columns(bound, vote_before_whitelist)
    return _as_analysis(scored.withColumn("knn", vote).withColumn("source", source),
                        *analysis, extra)


@lru_cache
def _cascade_columns(bound: float, vote_before_whitelist: bool):
    """Vote struct, decision source, and the analysis columns that depend on it."""
    score = F.round(F.col("_vote.confidence"), 4)
    vote = F.struct(label_name(F.col("_vote.label")).alias("classification"),
                    score.alias("confidence"), (score >= bound).alias("is_confident"))
    unreported = F.col("reporter_header") == ""
    listed, confident = F.col("whitelisted"), F.col("knn.is_confident")
    if vote_before_whitelist:
        source = F.when(confident, "knn").when(listed, "whitelist").otherwise("llm")
    else:
        source = (F.when(unreported, "unreported").when(listed, "whitelist")
                  .when(confident, "knn").otherwise("llm"))
    src = F.col("source")

    def pick(whitelist_value, knn_value, deep_value, unreported_value):
        return (F.when(src == "whitelist", whitelist_value).when(src == "knn", knn_value)
                .when(src == "llm", deep_value).otherwise(unreported_value))

    vote_text = F.format_string(
        "KNN: %s (%s%%) → LLM refinement", F.col("knn.classification"),
        F.bround(F.col("knn.confidence") * 100, 0).cast("int").cast("string"))
    active = F.concat(F.lit("KNN features activas: "), F.array_join(
        F.slice(FX.active_features(F.col("vector")), 1, 8), ", "))
    deep_reasons = F.concat(F.array(vote_text), F.col("deep_reasons"),
                            F.array(F.col("deep.reasoning")))
    analysis = (
        pick(F.lit("legitimo"), F.col("knn.classification"), F.col("deep.classification"),
             F.lit("spam")),
        pick(F.lit(1.0), F.col("knn.confidence"), F.col("deep.confidence"), F.lit(0.0)),
        F.when(src == "whitelist", F.col("reporter_content")).otherwise(
            F.col("reporter_header")),
        F.when(src == "knn", F.coalesce("from_header", F.lit("N/A"))).otherwise(
            F.col("from_raw")),
        pick(F.lit(0), F.col("vote_risk"), F.col("deep_risk"), F.lit(0)),
        pick(F.array(F.lit(C.WHITELIST_REASON)),
             F.concat(F.col("pattern_reasons"), F.array(active)), deep_reasons,
             F.array().cast("array<string>")),
        F.when(src == "knn", file_stem(F.col("path"))).otherwise(F.md5(F.col("path"))),
    )
    extra = [
        src, F.col("knn"),
        # Only tracked where the vote itself was the decision.
        F.when(src == "knn", F.lit(True)).alias("knn_was_correct"),
        F.col("homograph"), F.col("url_count"), F.col("header_count"),
        F.col("suspicious_headers"), F.col("heuristic_score"), F.col("vector"),
    ]
    return vote, source, analysis, extra


def triage(reports: DataFrame, whitelist: DataFrame, training: DataFrame,
           ip_reputation: DataFrame | None = None, responses: DataFrame | None = None,
           cfg: TriageConfig = DEFAULT, threshold: float | None = None,
           columns: Sequence[str] | None = None) -> DataFrame:
    """Analysis rows with their decision ``source``; with ``columns`` only these.

    Every report is parsed once into narrow signal rows, which are written out; all three
    branches are projections of the same row of that table.
    ``source`` is ``whitelist``, ``knn``, ``llm`` (deep analysis), or ``unreported`` for mail
    without a reporter, which goes to spam unanalysed.
    """
    signals = stored_signals(reports, cfg, columns)
    return _wanted(triage_signals(signals, whitelist, training, ip_reputation, responses, cfg, threshold), columns)


def batch_evaluate(reports: DataFrame, whitelist: DataFrame, training: DataFrame,
                   mode: str = "full", ip_reputation: DataFrame | None = None,
                   responses: DataFrame | None = None, cfg: TriageConfig = DEFAULT,
                   threshold: float | None = None) -> DataFrame:
    """Per-report evaluation rows for mode ``quick``, ``full`` or ``train``.

    ``quick`` takes every vote; the others vote first, and only hesitant mail goes on to the
    allow-list and deep analysis (both counted as ``llm``).  ``train`` rows carry the full
    vector and class id to append to the training table.
    """
    if mode not in ("quick", "full", "train"):
        raise ValueError(f"unknown mode {mode!r}")
    parsed = parsing.parse_reports(reports)
    if mode == "quick":
        feats = parsing.feature_table(parsed, cfg).select("report_id", "vector")
        vote = knn.with_vote(feats, "v", training, cfg.knn_k)
        return vote.select(
            "report_id", label_name(F.col("v.label")).alias("classification"),
            F.round("v.confidence", 4).alias("confidence"), F.lit("knn").alias("source"),
            F.lit(None).cast("int").alias("risk_score"),
            F.array().cast("array<string>").alias("reasons"))
    signals = settle(parsing.extract_signals(parsed, cfg), "signals")
    full = triage_signals(signals, whitelist, training,
                          ip_reputation, responses, cfg, threshold, vote_before_whitelist=True)
    deep = F.col("source") != "knn"
    columns = [
        F.col("report_id"), F.col("classification"), F.col("confidence"),
        F.when(deep, F.lit("llm")).otherwise(F.lit("knn")).alias("source"),
        F.when(deep, F.col("risk_score")).alias("risk_score"),
        # The deep path's own reasons: without the vote line in front.
        F.when(F.col("source") == "whitelist", F.slice("reasons", 1, 3))
        .when(deep, F.slice("reasons", 2, 3))
        .otherwise(F.array().cast("array<string>")).alias("reasons"),
    ]
    if mode == "train":
        columns += [F.col("vector"), label_id(F.col("classification")).alias("label")]
    return full.select(*columns)


def train_on_evaluated(rows: DataFrame, training: DataFrame, cfg: TriageConfig = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(live training rows, one-row summary) after appending the rows of ``batch_evaluate(.., "train")``.

    Summary: examples before and after, added ones, and mail that failed (no class or no vector).
    """
    rows = settle(rows.select("report_id", "vector", "classification"), "train-rows")
    usable = rows.where(F.col("vector").isNotNull() & F.col("classification").isin(*C.LABELS))
    examples = usable.select(F.col("report_id").alias("order"), "vector", "classification")
    live = settle(TR.append_training(training, examples, cfg.training_cap), "trained")
    good = F.col("vector").isNotNull() & F.coalesce(F.col("classification").isin(*C.LABELS), F.lit(False))
    counted = training.select(F.lit("examples_before").alias("k")).unionByName(
        live.select(F.lit("examples_after").alias("k"))).unionByName(
        rows.select(F.when(good, "added").otherwise("failed").alias("k")))
    return live, counted.agg(*[F.count_if(F.col("k") == k).alias(k) for k in ("examples_before", "examples_after", "added", "failed")])


def run_summary(analyses: DataFrame) -> DataFrame:
    """(kind, key, count, pct): counts per class and per source with their share."""
    pairs = F.array(
        F.struct(F.lit("classification").alias("kind"), F.col("classification").alias("key")),
        F.struct(F.lit("source").alias("kind"), F.col("source").alias("key")))
    counted = analyses.groupBy("classification", "source").agg(F.count(F.lit(1)).alias("n"))
    long = counted.select(F.inline(pairs), "n").groupBy("kind", "key").agg(
        F.sum("n").alias("count"))
    total = F.sum("count").over(Window.partitionBy("kind"))
    return long.withColumn("pct", F.round(F.col("count") / total * 100, 1))

