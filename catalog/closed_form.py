"""SQL that states, from ``doc_id`` alone, what the derived reports must yield.

Nothing here parses mail: every value follows from how ``derived.REPORTS_SQL`` builds the text.
Only properties of the appended document text itself are looked up in that text.
"""

from __future__ import annotations

from tamiz import constants as C

from .derived import WHITELIST


def _text_has(words, column="lower(text)"):
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


_SUBJECT = ("CASE i % 7 WHEN 0 THEN 'URGENT: verify account' WHEN 1 THEN 'Pago' "
            "ELSE 'Note ' || CAST(i AS VARCHAR) END")
_TEXT_KEYWORD = "CASE " + " ".join(
    f"WHEN {'i % 7 = 0 OR ' if w in ('urgent', 'verify') else ''}contains(lower(text), '{w}') "
    f"THEN '{w}'" for w in C.PHISHING_KEYWORDS) + " ELSE NULL END"

BASE = f"""
b0 AS (SELECT doc_id AS i, text,
  CASE doc_id % 8 WHEN 0 THEN 'example.com' WHEN 1 THEN 'mail.example.com' WHEN 2 THEN 'examp1e.com'
    WHEN 3 THEN 'offers.example.net' WHEN 4 THEN 'xn--bank.example.org' WHEN 5 THEN 'bank.example.org'
    WHEN 6 THEN 'bamk.example.org' ELSE 'news.test' END AS dom,
  CASE doc_id % 5 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' WHEN 2 THEN 'softfail' WHEN 3 THEN 'none' ELSE 'neutral' END AS spf,
  CASE doc_id % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' WHEN 2 THEN 'none' ELSE 'neutral' END AS dkim,
  CASE doc_id % 3 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' ELSE 'none' END AS dmarc
  FROM documents),
b1 AS (SELECT *,
  CASE WHEN i % 10 = 3 THEN 'example.com' ELSE dom END AS fd,
  '"' || CASE WHEN i % 10 = 3 THEN 'ceo@example.com' ELSE 'Sender' END || '" <user@' || dom || '>' AS from_raw,
  CASE i % 3 WHEN 1 THEN '<user@' || dom || '>' WHEN 2 THEN '<x@reply.example.net>' ELSE '' END AS reply_to,
  CASE i % 3 WHEN 1 THEN dom WHEN 2 THEN 'reply.example.net' ELSE '' END AS rd,
  {_SUBJECT} AS subject,
  '<m' || CAST(i AS VARCHAR) || '@' || dom || '>' AS message_id,
  'r' || CAST(i % 50 AS VARCHAR) || '@example.com' AS reporter,
  '203.0.113.' || CAST(i % 250 AS VARCHAR) AS ip,
  CASE WHEN i % 11 = 0 THEN 'http://bad.example.net/x' ELSE 'None' END AS ms,
  CAST(i % 13 + (i % 9 = 0)::INT + (i % 11 = 0)::INT AS INT) AS nurl,
  {_TEXT_KEYWORD} AS kw,
  7 + (i % 3 <> 0)::INT + (i % 11 = 0 OR i % 13 > 0)::INT + (i % 13 = 0 AND i % 9 = 0)::INT AS nheaders,
  (0.3::DOUBLE * (i % 7 = 0 OR {_text_has(C.HEURISTIC_WORDS)})::INT)
    + (0.2::DOUBLE * (i % 9 = 0 OR {_text_has(C.HEURISTIC_SHORTENERS, 'text')})::INT)
    + (0.3::DOUBLE * regexp_matches(text, '(?i)<form[^>]*>')::INT)
    + (0.2::DOUBLE * (spf = 'fail')::INT) + (0.2::DOUBLE * (dkim = 'fail')::INT) AS heur
  FROM b0),
b2 AS (SELECT *,
  fd IN ('example.com', 'mail.example.com', 'bank.example.org') AS wl,
  CASE fd WHEN 'examp1e.com' THEN 'example.com' WHEN 'bamk.example.org' THEN 'bank.example.org' END AS homo,
  i % 10 = 3 AS disp,
  rd <> '' AND rd <> fd AS rt
  FROM b1),
b3 AS (SELECT *,
  (kw IS NOT NULL)::INT + disp::INT + rt::INT + (i % 9 = 0)::INT + (nurl > 5)::INT AS nbase,
  concat_ws('; ',
    CASE WHEN kw IS NOT NULL THEN 'Keyword sospechosa: ''' || kw || '''' END,
    CASE WHEN disp THEN 'Display name no coincide con email real' END,
    CASE WHEN rt THEN 'Reply-To (' || rd || ') difiere de From (' || fd || ')' END,
    CASE WHEN i % 9 = 0 THEN 'URL acortada: bit.ly' END,
    CASE WHEN nurl > 5 THEN 'Múltiples dominios distintos (' || nurl || ')' END) AS base_reasons,
  CASE spf WHEN 'fail' THEN 25 WHEN 'softfail' THEN 15 WHEN 'none' THEN 10 ELSE 0 END
    + CASE dkim WHEN 'fail' THEN 25 WHEN 'softfail' THEN 15 WHEN 'none' THEN 10 ELSE 0 END
    + CASE dmarc WHEN 'fail' THEN 15 WHEN 'none' THEN 8 ELSE 0 END
    + CASE WHEN ms <> 'None' THEN 35 ELSE 0 END
    + CASE WHEN nurl > 10 THEN 10 WHEN nurl > 5 THEN 5 ELSE 0 END
    + CASE WHEN homo IS NOT NULL THEN 30 ELSE 0 END AS points
  FROM b2),
b4 AS (SELECT *,
  nbase + (homo IS NOT NULL)::INT AS nreasons,
  CAST(least(points + least((nbase + (homo IS NOT NULL)::INT) * 7, 25), 100) AS INT) AS risk,
  CAST(least(points + least(nbase * 7, 25), 100) AS INT) AS vote_risk
  FROM b3),
b5 AS (SELECT *,
  CASE WHEN ms <> 'None' THEN 'sospechoso' WHEN homo IS NOT NULL THEN 'sospechoso'
    WHEN risk >= 60 THEN 'sospechoso' ELSE 'spam' END AS fb_class,
  CASE WHEN ms <> 'None' THEN 0.85::DOUBLE WHEN homo IS NOT NULL THEN 0.9::DOUBLE WHEN risk >= 60 THEN 0.7::DOUBLE
    WHEN spf = 'pass' AND dkim = 'pass' AND dmarc = 'pass' AND risk < 30 THEN 0.75::DOUBLE ELSE 0.5::DOUBLE END AS fb_conf,
  CASE WHEN ms <> 'None' THEN 'Microsoft detectó URLs sospechosas: ' || ms
    WHEN homo IS NOT NULL THEN 'Dominio homógrafo de ''' || homo || ''' detectado'
    WHEN risk >= 60 THEN 'Risk score alto: ' || risk || '/100'
    WHEN spf = 'pass' AND dkim = 'pass' AND dmarc = 'pass' AND risk < 30 THEN 'Autenticación completa y risk score bajo'
    ELSE 'Sin indicadores claros de phishing (score: ' || risk || ')' END AS fb_text,
  concat_ws('; ',
    CASE WHEN ms <> 'None' THEN 'Microsoft detectó URLs sospechosas: ' || ms END,
    CASE WHEN homo IS NOT NULL THEN 'Dominio homógrafo de ''' || homo || ''' detectado' END,
    nullif(base_reasons, '')) AS deep_reasons
  FROM b4)
"""

_FEATURE = {
    "spf_fail": "spf IN ('fail', 'softfail')",
    "spf_softfail": "spf = 'softfail'",
    "dkim_none": "dkim IN ('none', 'fail')",
    "dmarc_none": "dmarc IN ('none', 'fail')",
    "auth_all_pass": "spf = 'pass' AND dkim = 'pass' AND dmarc = 'pass'",
    "cat_none": "true",
    "subject_very_short": "length(subject) <= 6",
    "reply_to_mismatch": "rt",
    "ms_urls_detected": "ms <> 'None'",
    "has_attachment": "i % 6 = 0",
    "display_name_mismatch": "disp",
    "form_in_email": "regexp_matches(text, '(?i)<form[^>]*>')",
    "multipart_suspicious":
        "(length(text) - length(replace(text, '--', ''))) / 2 "
        "+ CASE WHEN i % 8 = 4 THEN 2 + (i % 3 = 1)::INT ELSE 0 END > 5",
    "x_mailer_suspicious": "true",
}
_VALUE = {
    "subject_keywords": "CASE WHEN i % 7 < 2 THEN 1 / 3.0::DOUBLE ELSE 0.0 END",
    "sender_domain_suspicious": "CASE WHEN contains(fd, 'xn--') THEN 0.3::DOUBLE ELSE 0.0 END",
    "url_count_norm": "least(nurl / 10.0::DOUBLE, 1.0)",
    "short_urls": "CASE WHEN i % 9 = 0 THEN 0.5::DOUBLE ELSE 0.0 END",
    "html_obfuscation": "least((" + " + ".join(
        f"regexp_matches(text, '{p}')::INT" for p in (
            r"&#[0-9]+;", r"(?i)\\x[0-9a-f]{2}", r"(?i)btoa\(", r"(?i)eval\(")
    ) + ") / 2.0::DOUBLE, 1.0)",
    "received_hops": "0.2::DOUBLE",
}
FEATURE_SQL = {
    n: (f"CAST({_VALUE[n]} AS DOUBLE)" if n in _VALUE
        else f"CAST(({_FEATURE[n]}) AS INT)::DOUBLE" if n in _FEATURE else "0.0::DOUBLE")
    for n in C.FEATURE_NAMES
}


def derived(select: str, tail: str = "", extra: str = "") -> str:
    """A SELECT over the closed-form columns (see BASE) of every derived report."""
    return f"WITH {BASE}{',' + extra if extra else ''} SELECT {select} FROM b5 {tail}"


_SEEDS = ", ".join(
    f"({n}, [{', '.join(f'{float(x)}::DOUBLE' for x in v)}], {label})"
    for n, (v, label) in enumerate(C.SEED_TRAINING))

# Vote of the seed rows for every report, and the cascade's decision.
VOTE = f"""
seed AS (SELECT * FROM (VALUES {_SEEDS}) s(seq, sv, label)),
q AS (SELECT i, [{', '.join(FEATURE_SQL[n] for n in C.FEATURE_NAMES)}] AS v FROM b5),
d AS (SELECT i, seq, label, list_distance(v, sv) AS dist,
  row_number() OVER (PARTITION BY i ORDER BY round(list_distance(v, sv), 10), seq) AS rn FROM q, seed),
w AS (SELECT i, label, CASE WHEN min(dist) OVER (PARTITION BY i) = 0 THEN (dist = 0)::INT::DOUBLE ELSE 1 / dist END AS w
  FROM d WHERE rn <= 5),
p AS (SELECT i, sum(CASE WHEN label = 0 THEN w ELSE 0 END) / sum(w) AS p0,
  sum(CASE WHEN label = 1 THEN w ELSE 0 END) / sum(w) AS p1,
  sum(CASE WHEN label = 2 THEN w ELSE 0 END) / sum(w) AS p2 FROM w GROUP BY i),
v AS (SELECT i, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 'legitimo' WHEN p1 >= p2 THEN 'spam' ELSE 'sospechoso' END AS vclass,
  round(greatest(p0, p1, p2), 4) AS vconf FROM p),
t AS (SELECT b5.*, v.vclass, v.vconf,
  CASE WHEN wl THEN 'whitelist' WHEN vconf >= 0.85 THEN 'knn' ELSE 'llm' END AS source FROM b5 JOIN v USING (i)),
tr AS (SELECT *,
  CASE source WHEN 'whitelist' THEN 'legitimo' WHEN 'knn' THEN vclass ELSE fb_class END AS class,
  CASE source WHEN 'whitelist' THEN 1.0::DOUBLE WHEN 'knn' THEN vconf ELSE fb_conf END AS conf,
  CASE source WHEN 'whitelist' THEN 0 WHEN 'knn' THEN vote_risk ELSE risk END AS final_risk FROM t)
"""


def voted(select: str, tail: str = "", source: str = "tr", extra: str = "") -> str:
    """A SELECT over the cascade's closed-form result."""
    return f"WITH {BASE},{VOTE}{',' + extra if extra else ''} SELECT {select} FROM {source} {tail}"


assert WHITELIST == ["example.com", "bank.example.org"]
