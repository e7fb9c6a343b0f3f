"""Reports -> parsed reports -> narrow signal rows.  Map-only: no shuffle, one pass per text."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..config import DEFAULT, TriageConfig
from ..functions import features as FX
from ..functions import mail as M
from ..functions import signals as S
from ..functions import text as T

# The expressions below only name columns, so each set is built once per configuration and used
# for every table; building them anew costs more than planning the query.


@lru_cache
def _parse_columns() -> tuple[dict[str, Column], dict[str, Column]]:
    clean = F.col("_clean")
    return {"_clean": M.normalize_content(F.col("content"))}, {
        "headers": M.parse_headers(clean), "microsoft_urls": M.ms_url_verdict(clean)}


def parse_reports(reports: DataFrame) -> DataFrame:
    """Add ``headers`` MAP<STRING,STRING> and ``microsoft_urls`` STRING to rows with ``content``."""
    reports.sparkSession.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    clean, parsed = _parse_columns()
    return reports.withColumns(clean).withColumns(parsed).drop("_clean")


@lru_cache
def _text_columns(cfg: TriageConfig) -> dict[str, Column]:
    """What several later expressions share; each is evaluated once per report."""
    content, headers = F.col("content"), F.col("headers")
    return {
        "_lower": F.lower(content),
        "_url_list": T.extract_url_list(content),
        "_feature_auth": M.auth_results_features(headers, cfg.header_case),
        "_forefront": M.forefront_fields(headers, cfg.header_case),
    }


@lru_cache
def _feature_columns(cfg: TriageConfig) -> dict[str, Column]:
    return FX.feature_columns(
        F.col("headers"), F.col("content"), F.col("microsoft_urls"), F.col("_url_list"),
        F.col("_feature_auth"), F.col("_forefront"), cfg, F.col("_lower"))


@lru_cache
def _signal_columns(cfg: TriageConfig) -> tuple[dict[str, Column], ...]:
    h, content = F.col("headers"), F.col("content")
    case = cfg.header_case
    first = _text_columns(cfg) | {
        "indicators": M.auth_results(h, case),
        "from_raw": M.header(h, "From"),
        "to_raw": M.header(h, "To"),
        "subject_raw": M.header_or_null(h, "Subject"),
    }
    second = {
        "_urls": F.array_distinct(F.col("_url_list")),
        "_any_word": T.any_word(F.col("_lower"), [*cfg.keywords, *cfg.heuristic_words]),
    }
    # Both word lists are looked for at once; only a text that holds one of them is searched for each list.
    searched = F.when(F.col("_any_word"), F.col("_lower")).otherwise(F.lit(""))
    third = {
        "_keyword": T.first_contained(
            cfg.keywords, F.lower(F.coalesce(F.col("subject_raw"), F.lit(""))), searched),
    }
    urls = F.col("_urls")
    kept = {
        "from_raw": F.col("from_raw"),
        "from_header": M.header_or_null(h, "From"),
        "subject_raw": F.col("subject_raw"),
        "message_id": M.header_or_null(h, "Message-ID"),
        "to_raw": F.col("to_raw"),
        "reply_to": M.extract_reply_to(h),
        "sender_ip": M.extract_sender_ip(h),
        "from_domain": M.sender_domain(F.col("from_raw"), cfg.address_only),
        "reporter_content": M.extract_reporter(content),
        "reporter_header": T.extract_address(F.col("to_raw")),
        "indicators": F.col("indicators"),
        "headers_raw": F.to_json(h),
        "header_count": F.size(h),
        "suspicious_headers": M.suspicious_headers(h),
        "body_preview": M.body_preview(content),
        "urls_found": F.slice(urls, 1, 10),
        "url_count": F.size(urls),
        "url_domains": T.distinct_url_domains(urls),
        "keyword": F.col("_keyword"),
        "pattern_reasons": S.pattern_reasons(
            F.col("_keyword"), F.col("from_raw"), S.reply_to_reason(h), urls),
        "heuristic_score": S.heuristic_score(
            content, F.col("_lower"), h, cfg.heuristic_words, case, searched),
        "vector": FX.features_to_vector(_feature_columns(cfg)),
    }
    return first, second, third, kept


def extract_signals(parsed: DataFrame, cfg: TriageConfig = DEFAULT) -> DataFrame:
    """Everything later stages need from a parsed report, without its full text.

    Joins and shuffles downstream move these narrow rows, never the mail bodies; columns a
    query does not use are pruned before they are computed.
    """
    first, second, third, kept = _signal_columns(cfg)
    path = F.col("path") if "path" in parsed.columns else F.col("report_id").cast("string")
    others = [c for c in parsed.columns if c not in ("headers", "content", "path")]
    return parsed.withColumns(first).withColumns(second).withColumns(third).select(
        *others, path.alias("path"), *[c.alias(n) for n, c in kept.items()])


def feature_table(parsed: DataFrame, cfg: TriageConfig = DEFAULT) -> DataFrame:
    """report_id plus one DOUBLE column per feature and the ``vector`` array.

    Of signal rows (``extract_signals``), which have the vector already, it takes its values (a missing one is 0); no text is read again.
    """
    if "vector" in parsed.columns:
        return parsed.select("report_id", *[F.col("vector")[i].alias(n) for i, n in enumerate(C.FEATURE_NAMES)], "vector")
    wide = parsed.withColumns(_text_columns(cfg)).select(
        "report_id", *[c.alias(n) for n, c in _feature_columns(cfg).items()])
    return wide.withColumn("vector", FX.features_to_vector(
        {n: F.col(n) for n in _feature_columns(cfg)}))


def parse_coverage(parsed: DataFrame) -> DataFrame:
    """How many reports yielded headers."""
    return parsed.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.size("headers") > 0).alias("with_headers"),
        F.count_if(F.size("headers") == 0).alias("without_headers"),
    )
