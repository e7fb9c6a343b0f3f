"""The 33 numeric features of a report and the vector built from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from ..config import DEFAULT, TriageConfig
from . import signals as S
from .mail import has_verdict, header
from .text import extract_domain, strip


def _flag(condition: Column) -> Column:
    return condition.cast("double")


def _capped(count: Column, full: float) -> Column:
    return F.least(count / F.lit(full), F.lit(1.0))


def feature_columns(headers: Column, content: Column, microsoft_urls: Column,
                    url_list: Column, auth: Column, forefront: Column,
                    cfg: TriageConfig = DEFAULT,
                    content_lower: Column | None = None) -> dict[str, Column]:
    """Feature name -> DOUBLE column, in vector order.

    ``auth`` and ``forefront`` are the structs of ``auth_results_features`` and
    ``forefront_fields``; ``url_list`` holds every URL occurrence.
    """
    case = cfg.header_case
    auth_text = F.lower(header(headers, "authentication-results", case))
    subject = F.lower(header(headers, "Subject"))
    from_domain = extract_domain(header(headers, "From"))
    charset = F.lower(header(headers, "X-Entity-ID"))
    received_keys = F.filter(F.map_keys(headers),
                             lambda k: F.startswith(F.lower(k), F.lit("received")))
    out = {
        "spf_fail": _flag(auth["spf"].isin("fail", "softfail")),
        "spf_softfail": _flag(auth["spf"] == "softfail"),
        "dkim_none": _flag(auth["dkim"].isin("none", "fail")),
        "dmarc_none": _flag(auth["dmarc"].isin("none", "fail")),
        "auth_all_pass": _flag((auth["spf"] == "pass") & (auth["dkim"] == "pass")
                               & (auth["dmarc"] == "pass")),
        "compauth_fail": _flag(F.contains(auth_text, F.lit("compauth=fail"))),
        "scl_high": _flag(forefront["scl"] >= 5),
        "scl_negative": _flag(forefront["scl"] == -1),
        "sfv_spam": _flag(forefront["sfv"].isin("SPM", "SKS")),
        "sfv_skip": _flag(forefront["sfv"] == "SKN"),
        "cat_spoof": _flag(forefront["cat"] == "SPOOF"),
        "cat_phish": _flag(forefront["cat"].isin("PHSH", "MALW")),
        "cat_none": _flag(forefront["cat"] == "NONE"),
        "subject_keywords": _capped(S.keyword_count(subject, cfg.subject_keywords), 3.0),
        "subject_very_short": _flag(F.length(strip(subject)) <= 6),
        "reply_to_mismatch": _flag(S.reply_to_mismatch(headers)),
        "high_risk_country": _flag(S.high_risk_country(forefront["ctry"])),
        "ipv_nli": _flag(forefront["ipv_nli"]),
        "return_path_mismatch": _flag(S.return_path_mismatch(headers)),
        "x_originating_ip_mismatch": _flag(S.originating_ip_mismatch(headers)),
        "sender_domain_suspicious": F.least(
            F.when(F.contains(from_domain, F.lit("_")), 0.3).otherwise(0.0)
            + F.when(F.contains(from_domain, F.lit("xn--")), 0.3).otherwise(0.0),
            F.lit(1.0)),
        "encoding_suspicious": _flag(
            (charset != "") & ~F.contains(charset, F.lit("utf"))
            & ~F.contains(charset, F.lit("iso"))),
        "url_count_norm": _capped(F.size(url_list), 10.0),
        "ms_urls_detected": _flag(has_verdict(microsoft_urls)),
        "short_urls": _capped(S.shortener_url_count(url_list), 2.0),
        "has_attachment": _flag(F.lower(strip(header(headers, "X-MS-Has-Attach"))) == "yes"),
        "thread_hijacking": _flag(S.thread_hijack(headers)),
        "display_name_mismatch": _flag(S.display_name_mismatch_feature(header(headers, "From"))),
        "form_in_email": _flag(S.html_form_present(content, content_lower)),
        "html_obfuscation": _capped(S.html_obfuscation_count(content, content_lower), 2.0),
        "multipart_suspicious": _flag(S.occurrences(content, "--") > 5),
        "received_hops": _capped(F.size(received_keys), 5.0),
        "x_mailer_suspicious": _flag(
            F.lower(strip(header(headers, "X-Mailer"))).isin(*C.SUSPICIOUS_MAILERS)),
    }
    return {name: out[name] for name in C.FEATURE_NAMES}


def features_to_vector(features: dict[str, Column]) -> Column:
    """ARRAY<DOUBLE> in the fixed order; a missing feature counts 0."""
    zero = F.lit(0.0)
    return F.array(*[F.coalesce(features[n], zero) if n in features else zero
                     for n in C.FEATURE_NAMES])


def feedback_vector(indicators: Column, microsoft_urls: Column, url_count: Column) -> Column:
    """Reduced vector used when a finished analysis is learned from; the rest is 0."""
    return features_to_vector({
        "spf_fail": _flag(indicators["spf"].isin("fail", "softfail")),
        "dkim_none": _flag(indicators["dkim"].isin("none", "fail")),
        "dmarc_none": _flag(indicators["dmarc"].isin("none", "fail")),
        "auth_all_pass": _flag((indicators["spf"] == "pass") & (indicators["dkim"] == "pass")
                               & (indicators["dmarc"] == "pass")),
        "ms_urls_detected": _flag(has_verdict(microsoft_urls)),
        "url_count_norm": _capped(url_count, 10.0),
    })


def active_features(vector: Column) -> Column:
    """Names of the non-zero features, in vector order."""
    names = F.array(*[F.lit(n) for n in C.FEATURE_NAMES])
    named = F.arrays_zip(names.alias("name"), vector.alias("value"))
    return F.transform(F.filter(named, lambda p: p["value"] > 0), lambda p: p["name"])
