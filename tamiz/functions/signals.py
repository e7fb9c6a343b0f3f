"""Spoofing, URL and content predicates over parsed reports, and the reason texts they yield."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from ..constants import WS
from .mail import header
from .text import (any_contains, any_word, count_contained, distinct_url_domains, extract_domain,
                   shortener_of, strip)


def domains_differ(a: Column, b: Column) -> Column:
    """Both domains known and not the same."""
    return (a != "") & (b != "") & (a != b)


def reply_to_mismatch(headers: Column) -> Column:
    return domains_differ(extract_domain(header(headers, "Reply-To")),
                          extract_domain(header(headers, "From")))


def reply_to_reason(headers: Column) -> Column:
    """Text naming both domains when Reply-To and From differ, else NULL."""
    reply, sender = (extract_domain(header(headers, h)) for h in ("Reply-To", "From"))
    return F.when(domains_differ(reply, sender),
                  F.format_string("Reply-To (%s) difiere de From (%s)", reply, sender))


def return_path_mismatch(headers: Column) -> Column:
    return domains_differ(extract_domain(header(headers, "Return-Path")),
                          extract_domain(header(headers, "From")))


def originating_ip_mismatch(headers: Column) -> Column:
    return domains_differ(extract_domain(strip(header(headers, "X-Originating-IP"))),
                          extract_domain(header(headers, "From")))


def thread_hijack(headers: Column) -> Column:
    return domains_differ(extract_domain(header(headers, "In-Reply-To")),
                          extract_domain(header(headers, "From")))


def display_name_mismatch(from_value: Column) -> Column:
    """Display part is itself an address and not the real one."""
    sender = F.lower(from_value)
    display = F.btrim(strip(F.regexp_extract(sender, r"^([^<]+)", 1)), F.lit('"'))
    bracketed = F.regexp_extract(sender, r"<([^>]+)>", 1)
    return (
        F.contains(sender, F.lit(">")) & (bracketed != "")
        & F.contains(display, F.lit("@")) & (display != strip(bracketed))
    )


def display_name_mismatch_feature(from_value: Column) -> Column:
    """The feature vector's stricter reading of the same idea."""
    sender = F.lower(from_value)
    display = strip(F.regexp_extract(sender, rf'^"?([^"<]+)"?[{WS}]*<', 1))
    bracketed = F.regexp_extract(sender, r"<([^>]+)>", 1)
    return ((bracketed != "") & F.contains(display, F.lit("@"))
            & (display != strip(bracketed)))


def shortener_hits(urls: Column) -> Column:
    """Shortening service of every URL that uses one."""
    return F.filter(F.transform(urls, lambda u: shortener_of(u, C.SHORTENER_HOSTS)),
                    lambda s: s.isNotNull())


def shortener_url_count(urls: Column) -> Column:
    """Number of URL occurrences that contain a shortening service's name."""
    return F.size(F.filter(urls, lambda u: any_contains(u, C.SHORTENER_SUBSTRINGS)))


def shortener_in_text(content: Column) -> Column:
    return any_word(content, C.HEURISTIC_SHORTENERS)


def high_risk_country(country: Column) -> Column:
    return country.isin(*C.HIGH_RISK_COUNTRIES)


def html_form_present(content: Column, content_lower: Column | None = None) -> Column:
    """An HTML form tag; the pattern only runs on texts that hold its opening."""
    lowered = F.lower(content) if content_lower is None else content_lower
    return F.contains(lowered, F.lit("<form")) & F.rlike(content, F.lit("(?i)<form[^>]*>"))


def html_obfuscation_count(content: Column, content_lower: Column | None = None) -> Column:
    """How many of the obfuscation patterns occur (0-4)."""
    lowered = F.lower(content) if content_lower is None else content_lower
    out = F.lit(0)
    for literal, pattern in C.OBFUSCATION_PATTERNS:
        hit = F.contains(lowered, F.lit(literal)) & F.rlike(content, F.lit(pattern))
        out = out + hit.cast("int")
    return out


def occurrences(content: Column, token: str) -> Column:
    """Non-overlapping occurrences of a token."""
    # In bytes, whose number is known; characters would have to be counted.
    removed = F.octet_length(content) - F.octet_length(F.replace(content, F.lit(token), F.lit("")))
    return (removed / len(token.encode())).cast("int")


def keyword_count(subject_lower: Column, words: Sequence[str]) -> Column:
    return count_contained(words, subject_lower)


def pattern_reasons(keyword: Column, from_value: Column, reply_to: Column,
                    urls: Column) -> Column:
    """Ordered reasons: keyword, display name, reply-to, one per shortener URL, many domains."""
    domains = distinct_url_domains(urls)
    single = F.array(
        F.when(keyword.isNotNull(),
               F.concat(F.lit("Keyword sospechosa: '"), keyword, F.lit("'"))),
        F.when(display_name_mismatch(from_value),
               F.lit("Display name no coincide con email real")),
        reply_to,
    )
    shorteners = F.transform(shortener_hits(urls),
                             lambda s: F.concat(F.lit("URL acortada: "), s))
    many = F.array(F.when(domains > 5, F.format_string(
        "Múltiples dominios distintos (%d)", domains)))
    return F.filter(F.concat(single, shorteners, many), lambda r: r.isNotNull())


def heuristic_score(content: Column, content_lower: Column, headers: Column,
                    words: Sequence[str], case: str = "exact", searched: Column | None = None) -> Column:
    """Independent 0-1.2 score; the order of additions is part of the definition.

    ``searched`` may stand in for ``content_lower`` where the words are looked for.
    """
    auth = F.lower(header(headers, "authentication-results", case))

    def points(condition, value):
        return F.when(condition, F.lit(value)).otherwise(F.lit(0.0))

    return (
        points(any_word(content_lower if searched is None else searched, words), 0.3)
        + points(shortener_in_text(content), 0.2)
        + points(html_form_present(content, content_lower), 0.3)
        + points(F.contains(auth, F.lit("spf=fail")), 0.2)
        + points(F.contains(auth, F.lit("dkim=fail")), 0.2)
    )
