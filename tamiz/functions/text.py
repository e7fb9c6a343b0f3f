"""Column helpers for text: trimming, entities, URLs, addresses, domains, edit distance."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Sequence
from functools import reduce
from html.entities import html5
from operator import or_

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import WS, WS_CHARS

URL_PATTERN = rf'https?://[^{WS}<>"{{}}|\\^`\[\]]+'
EMAIL_PATTERN = (
    r"(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_])[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}"
    r"(?:(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_])|(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_]))"
)
IPV4_PATTERN = (
    r"(?<![\p{L}\p{N}_])(\p{Nd}{1,3}(?:\.\p{Nd}{1,3}){3})(?![\p{L}\p{N}_])"
)


def strip(c: Column) -> Column:
    """Trim every whitespace character, not only U+0020."""
    return F.btrim(c, F.lit(WS_CHARS))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def any_contains(c: Column, words: Sequence[str]) -> Column:
    """True if any of the words occurs in ``c``."""
    return F.exists(F.lit(list(words)), lambda w: F.contains(c, w)) if words else F.lit(False)


def any_word(c: Column, words: Sequence[str]) -> Column:
    """Same as ``any_contains``, for long texts.

    They are searched as bytes: a pattern decodes the whole text once for every word. A word that holds another one
    of them is not looked for, because that one is found then, too.
    """
    shortest = [w for w in dict.fromkeys(words) if not any(o in w for o in words if o != w)]
    return reduce(or_, (F.contains(c, F.lit(w)) for w in shortest), F.lit(False))


def first_contained(words: Sequence[str], *texts: Column) -> Column:
    """The first word, in list order, found in any of the texts; NULL when none is.

    A fast search decides whether there is a hit at all; only then the words are tried in order.
    """
    if not words:
        return F.lit(None).cast("string")
    possible = reduce(or_, (any_word(t, words) for t in texts))
    hits = F.filter(F.lit(list(words)), lambda w: reduce(or_, (F.contains(t, w) for t in texts)))
    return F.when(possible, F.get(hits, F.lit(0)))


def count_contained(words: Sequence[str], c: Column) -> Column:
    """How many of the words occur in ``c``."""
    return F.size(F.filter(F.lit(list(words)), lambda w: F.contains(c, w)))


# --- entities ---------------------------------------------------------------------------

# HTML's rule for numeric references in 0x80-0x9F (read as windows-1252), NUL and CR.
_NUMERIC_OVERRIDES = {0x00: "\ufffd", 0x0D: "\r"} | {
    n: bytes([n]).decode("cp1252", errors="ignore") or chr(n) for n in range(0x80, 0xA0)
}
_BARE_NAMES = sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True)


def _literal_map(entries: dict) -> Column:
    return F.from_json(F.lit(json.dumps(entries)), "map<string,string>")


def html_unescape(c: Column) -> Column:
    """Resolve named and numeric character references the way HTML5 does.

    Text without an ampersand is passed through untouched, so the reference table is only
    consulted for the values that need it.
    """
    names = _literal_map(html5)
    overrides = _literal_map({str(k): v for k, v in _NUMERIC_OVERRIDES.items()})

    def numeric(head: Column) -> Column:
        is_hex = F.lower(F.substring(head, 2, 1)) == "x"
        hex_digits = F.regexp_extract(head, r"^#[xX]0*([0-9a-fA-F]*)", 1)
        dec_digits = F.regexp_extract(head, r"^#0*([0-9]*)", 1)
        too_long = F.when(is_hex, F.length(hex_digits) > 6).otherwise(F.length(dec_digits) > 7)
        code = F.coalesce(
            F.when(is_hex, F.conv(hex_digits, 16, 10)).otherwise(dec_digits).try_cast("int"),
            F.lit(0),
        )
        invalid = (
            code.between(0x1, 0x8) | (code == 0xB) | code.between(0xE, 0x1F)
            | code.between(0x7F, 0x9F) | code.between(0xFDD0, 0xFDEF)
            | F.pmod(code, F.lit(0x10000)).isin(0xFFFE, 0xFFFF)
        )
        return (
            F.when(too_long | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF), F.lit("\ufffd"))
            .when((code == 0) | (code == 0xD) | code.between(0x80, 0x9F),
                  F.try_element_at(overrides, code.cast("string")))
            .when(invalid, F.lit(""))
            .otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        )

    def named(head: Column) -> Column:
        bare = F.regexp_extract(head, "^(?:" + "|".join(_BARE_NAMES) + ")", 0)
        candidates = F.array(F.struct(head.alias("name"), F.lit("").alias("rest")), F.struct(
            bare.alias("name"),
            F.substring(head, F.length(bare) + 1, F.length(head)).alias("rest")))
        found = F.transform(candidates, lambda n: F.concat(
            F.try_element_at(names, n["name"]), n["rest"]))
        return F.coalesce(F.get(F.filter(found, lambda f: f.isNotNull()), F.lit(0)),
                          F.concat(F.lit("&"), head))

    def resolve_head(part: Column, head: Column) -> Column:
        tail = F.substring(part, F.length(head) + 1, F.length(part))
        return (
            F.when(head == "", F.concat(F.lit("&"), part))
            .when(F.startswith(head, F.lit("#")), F.concat(numeric(head), tail))
            .otherwise(F.concat(named(head), tail))
        )

    def resolve(part: Column) -> Column:
        head = F.regexp_extract(
            part, r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)", 1)
        return let(head, lambda h: resolve_head(part, h))

    def resolve_all(parts: Column) -> Column:
        references = F.slice(parts, F.lit(2), F.size(parts))
        return F.concat(F.get(parts, F.lit(0)),
                        F.array_join(F.transform(references, resolve), ""))

    return let(c, lambda v: F.when(
        F.contains(v, F.lit("&")), let(F.split(v, "&", -1), resolve_all)).otherwise(v))


# --- URLs -------------------------------------------------------------------------------

def extract_url_list(content: Column) -> Column:
    """Every URL occurrence, duplicates kept."""
    return F.regexp_extract_all(content, F.lit(URL_PATTERN), F.lit(0))


def extract_urls(content: Column) -> Column:
    """Distinct URLs in first-seen order."""
    return F.array_distinct(extract_url_list(content))


def url_host(url: Column) -> Column:
    """Host without port, lower-cased; empty when there is none."""
    return F.lower(F.regexp_extract(url, r"://([^/:?]+)", 1))


def url_host_port(url: Column) -> Column:
    """Everything between :// and the next slash, as written."""
    return F.regexp_extract(url, r"://([^/]+)", 1)


def distinct_url_domains(urls: Column) -> Column:
    """Number of distinct host-and-port parts in an array of URLs."""
    hosts = F.filter(F.transform(urls, url_host_port), lambda h: h != "")
    return F.size(F.array_distinct(hosts))


def shortener_of(url: Column, services: list[str]) -> Column:
    """The shortening service a URL's host belongs to, or NULL."""
    host = url_host(url)
    return F.coalesce(*[
        F.when((host == s) | F.endswith(host, F.lit("." + s)), F.lit(s)) for s in services
    ])


# --- addresses --------------------------------------------------------------------------

def extract_domain(address: Column) -> Column:
    """Domain after the first @, lower-cased; empty when there is none."""
    return F.regexp_extract(F.lower(address), r"@([a-zA-Z0-9.-]+)", 1)


def extract_emails(text: Column) -> Column:
    """Every e-mail address in a text."""
    return F.regexp_extract_all(text, F.lit(EMAIL_PATTERN), F.lit(0))


def extract_address(address: Column) -> Column:
    """Bare address of a ``Name <address>`` header value (entities resolved)."""
    def bare(a: Column) -> Column:
        opening, closing = F.locate("<", a), F.locate(">", a)
        # A closing bracket before the opening one leaves nothing between them.
        inside = F.when(
            closing > opening, F.substring(a, opening + 1, closing - opening - 1)
        ).otherwise(F.lit(""))
        tokens = F.filter(F.split(strip(a), rf"[{WS}]+"),
                          lambda t: F.contains(t, F.lit("@")))
        return (
            F.when((opening > 0) & (closing > 0), strip(inside))
            .otherwise(F.coalesce(F.try_element_at(tokens, F.lit(-1)), strip(a)))
        )

    return let(html_unescape(F.coalesce(address, F.lit(""))), bare)


def domain_suffixes(domain: Column) -> Column:
    """The domain itself plus every parent with at least two labels."""
    parts = F.split(domain, r"\.", -1)
    n = F.size(parts)
    parents = F.when(n > 2, F.transform(
        F.sequence(F.lit(2), n - 1), lambda i: F.array_join(F.slice(parts, i, n), ".")
    )).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(domain), parents)


def edit_distance(a: Column, b: Column) -> Column:
    """Unit-cost Levenshtein distance."""
    return F.levenshtein(a, b)


def normalize_homograph(domain: Column) -> Column:
    """NFKD-normalise and drop what is not ASCII (no built-in function does this)."""
    @F.arrow_udf("string")
    def nfkd_ascii(texts: pa.Array) -> pa.Array:
        plain = (None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore") for x in (t.as_py() for t in texts))
        return pa.array(plain, pa.binary()).cast(pa.string())

    # What is ASCII already stays as it is and is not sent to Python.
    return F.coalesce(nfkd_ascii(F.when(F.regexp_like(domain, F.lit(r"[^\x00-\x7F]")), domain)), domain)
