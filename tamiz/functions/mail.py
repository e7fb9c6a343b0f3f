"""Column helpers for report text: header map, verdict line, reporter, sender, authentication."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from ..constants import WS, WS_CHARS, WS_INLINE
from .text import IPV4_PATTERN, extract_domain, html_unescape, let, strip

_KEYWORD = "(" + "|".join(C.LINE_STARTING_HEADERS) + ")"

# A known header name in the middle of a line moves to a line of its own.  The optional tail
# swallows an immediate repetition of the same name, which must keep its place.  The class is
# restricted to non-printables first, so ordinary characters fail on two range checks.
_SPACE = rf"[\x00-\x20\x7f-\uffff&&[{WS}]]"
_MID_LINE_HEADER = rf"{_SPACE}++(?=[FTSDMRCAXx]){_KEYWORD}({_SPACE}++\1)?"

# One header: its first line, then everything up to a blank line or the next header.  Comment
# lines and unindented lines without a colon neither belong to it nor end it.
_HEADER_BLOCK = (
    rf"(?dm)^(?:[^{WS}#:][^:\n]*+)?:[^\n]*+"
    rf"(?:\n(?:[{WS_INLINE}]*+#[^\n]*+"
    rf"|[^{WS}#:][^:\n]*+(?=\n|\z)"
    rf"|[{WS_INLINE}]++[^{WS}#][^\n]*+))*+"
)
_FOREIGN_LINE = rf"\n(?:[{WS_INLINE}]*+#|[^{WS}])[^\n]*"

FOREFRONT = "x-forefront-antispam-report"


def normalize_newlines(c: Column) -> Column:
    """Drop undecodable bytes and read CRLF / CR as LF, as a text-mode reader would."""
    valid = F.when(F.is_valid_utf8(c), c).otherwise(
        F.translate(F.make_valid_utf8(c), "\ufffd", ""))
    return F.when(F.contains(valid, F.lit("\r")),
                  F.regexp_replace(valid, r"\r\n?", "\n")).otherwise(valid)


def normalize_content(content: Column) -> Column:
    """Turn <br> tags into line ends and put every known header on its own line."""
    lines = content
    for tag in ("<br>", "<br/>", "<br />"):
        lines = F.replace(lines, F.lit(tag), F.lit("\n"))
    return let(F.when(F.contains(content, F.lit("<br")), lines).otherwise(content), _break_before_headers)


def _break_before_headers(lines: Column) -> Column:
    # White space that opens the text follows nothing, so it is never a place to break.
    rest = F.ltrim(lines, F.lit(WS_CHARS))
    opening = F.when(F.octet_length(lines) > F.octet_length(rest),
                     F.left(lines, F.length(lines) - F.length(rest))).otherwise(F.lit(""))
    return F.concat(opening, F.regexp_replace(rest, _MID_LINE_HEADER, "\n$1$2"))


def parse_headers(clean: Column) -> Column:
    """Header MAP of normalised text; the last duplicate wins (see ``session.configure``)."""
    def fold(value):
        joined = F.regexp_replace(
            F.regexp_replace(value, _FOREIGN_LINE, ""), rf"[{WS}]*\n[{WS}]*", " ")
        return strip(F.when(F.contains(value, F.lit("\n")), joined).otherwise(value))

    def entry(block):
        value = F.substr(block, F.locate(":", block) + 1)
        return F.struct(
            strip(F.substring_index(block, ":", 1)).alias("key"),
            html_unescape(let(value, fold)).alias("value"),
        )

    blocks = F.filter(
        F.regexp_extract_all(clean, F.lit(_HEADER_BLOCK), F.lit(0)),
        lambda b: ~F.startswith(b, F.lit(":")),
    )
    return F.map_from_entries(F.transform(blocks, entry))


def ms_url_verdict(clean: Column) -> Column:
    """What follows the questionable-URLs mark, or ``None`` (the word) without a mark."""
    raw = F.regexp_extract(
        clean, rf"{C.QUESTIONABLE_URLS_MARK}[{WS}]*\n?[{WS}]*([^\n]+?)(?:\n|\z)", 1)
    return F.when(raw == "", F.lit("None")).otherwise(strip(raw))


def has_verdict(microsoft_urls: Column) -> Column:
    """True if the verdict names URLs."""
    return ~microsoft_urls.isin("None", "")


def header(headers: Column, name: str, case: str = "exact") -> Column:
    """Header value, empty when missing."""
    if case == "insensitive":
        wanted = F.filter(F.map_entries(headers),
                          lambda e: F.lower(e["key"]) == F.lit(name.lower()))
        value = F.try_element_at(wanted, F.lit(-1))["value"]
    else:
        value = F.try_element_at(headers, F.lit(name))
    return F.coalesce(value, F.lit(""))


def header_or_null(headers: Column, name: str) -> Column:
    return F.try_element_at(headers, F.lit(name))


# --- who reported, who sent ----------------------------------------------------------------

def extract_reporter(content: Column) -> Column:
    """Address in the first line-initial ``To:`` of the raw text."""
    line = F.regexp_extract(content, rf"(?dm)^To:[{WS}]*([^\n]+)", 1)
    bracketed = F.regexp_extract(line, r"<([^>]+)>", 1)
    return (
        F.when(line == "", F.lit("unknown@example.com"))
        .when(bracketed != "", bracketed)
        .otherwise(strip(line))
    )


def extract_sender_ip(headers: Column) -> Column:
    """First IPv4-looking token of the surviving Received header."""
    return F.regexp_extract(header(headers, "Received"), IPV4_PATTERN, 1)


def extract_reply_to(headers: Column) -> Column:
    return strip(header(headers, "Reply-To"))


def body_preview(content: Column) -> Column:
    return F.substring(content, 1, 500)


def sender_domain(from_value: Column, address_only: bool = False) -> Column:
    """Domain the allow-list is checked against: the first @ unless ``address_only``."""
    if address_only:
        bracketed = F.regexp_extract(from_value, r"<([^<>]*)>[^<>]*\z", 1)
        from_value = F.when(bracketed != "", bracketed).otherwise(from_value)
    return extract_domain(from_value)


# --- verdicts written by the mail system ---------------------------------------------------

def _first_result(text: Column, prefix: str, results: list[str]) -> Column:
    found = F.filter(F.lit(results), lambda r: F.contains(text, F.concat(F.lit(prefix), r)))
    return F.coalesce(F.get(found, F.lit(0)), F.lit("unknown"))


def auth_results(headers: Column, case: str = "exact") -> Column:
    """STRUCT<spf, dkim, dmarc, suspicious> with the received-spf fallback."""
    auth = F.lower(header(headers, "authentication-results", case))
    received = F.lower(header(headers, "received-spf", case))
    spf = let(_first_result(auth, "spf=", C.AUTH_RESULTS), lambda r: F.when(
        r == "unknown", _first_result(received, "", C.RECEIVED_SPF_RESULTS)).otherwise(r))
    dkim = _first_result(auth, "dkim=", C.AUTH_RESULTS)
    dmarc = _first_result(auth, "dmarc=", C.AUTH_RESULTS)
    results = F.struct(spf.alias("spf"), dkim.alias("dkim"), dmarc.alias("dmarc"))
    failed = ("fail", "softfail")
    return let(results, lambda r: F.struct(
        r["spf"].alias("spf"), r["dkim"].alias("dkim"), r["dmarc"].alias("dmarc"),
        (r["spf"].isin(*failed) | r["dkim"].isin(*failed) | r["dmarc"].isin(*failed)
         ).alias("suspicious")))


def auth_results_features(headers: Column, case: str = "exact") -> Column:
    """STRUCT<spf, dkim, dmarc> as the feature vector reads it (no fallback)."""
    auth = F.lower(header(headers, "authentication-results", case))
    return F.struct(*[
        _first_result(auth, p + "=", C.FEATURE_AUTH_RESULTS).alias(p) for p in C.AUTH_PROTOCOLS
    ])


def forefront_fields(headers: Column, case: str = "exact") -> Column:
    """STRUCT<scl, sfv, cat, cip, ctry, ipv_nli> of the anti-spam report headers."""
    report = header(headers, FOREFRONT, case)
    word = r"([\p{L}\p{N}_]+)"
    scl = F.regexp_extract(
        header(headers, "X-MS-Exchange-Organization-SCL", case), r"SCL:(-?[0-9]+)", 1)
    cat = F.regexp_extract(report, "CAT:" + word, 1)
    return F.struct(
        F.coalesce(scl.try_cast("double"), F.lit(0.0)).alias("scl"),
        F.regexp_extract(report, "SFV:" + word, 1).alias("sfv"),
        F.when(cat == "", F.lit("NONE")).otherwise(cat).alias("cat"),
        F.regexp_extract(report, r"CIP:([\p{Nd}.]+)", 1).alias("cip"),
        F.regexp_extract(report, "CTRY:" + word, 1).alias("ctry"),
        F.contains(report, F.lit("IPV:NLI")).alias("ipv_nli"),
    )


# --- diagnostics ---------------------------------------------------------------------------

def header_pattern_scan(content: Column) -> Column:
    """STRUCT of what the first 2000 characters look like (header lines, tags, entities)."""
    sample = F.substring(content, 1, 2000)
    lines = F.regexp_extract_all(sample, F.lit(rf"(?dm)^[A-Za-z-]+:[{WS}]*[^\n]+"), F.lit(0))
    return F.struct(
        F.size(lines).alias("header_lines"),
        F.contains(sample, F.lit("<br>")).alias("has_br"),
        (F.contains(sample, F.lit("&lt;")) | F.contains(sample, F.lit("&gt;"))
         ).alias("has_entities"),
        F.contains(sample, F.lit("Received:")).alias("has_received"),
    )


def suspicious_headers(headers: Column) -> Column:
    """A critical header is missing or blank, or any header is blank."""
    missing = F.lit(False)
    for name in C.CRITICAL_HEADERS:
        missing = missing | (strip(header(headers, name)) == "")
    return missing | F.exists(F.map_values(headers), lambda v: strip(v) == "")
