"""Parsing, signals, scoring and features over the reports derived from ``documents``."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz import constants as C
from tamiz.functions import features as FX
from tamiz.functions import mail as M
from tamiz.functions import scoring as SC
from tamiz.functions import signals as S
from tamiz.functions import text as T
from tamiz.operators import domains, parsing
from tamiz.session import bounded_batches, settle

from . import derived as D
from .closed_form import FEATURE_SQL, derived
from .registry import query


def parsed(spark: SparkSession, sf: str) -> DataFrame:
    return parsing.parse_reports(D.reports(spark, sf))


def signals(spark: SparkSession, sf: str) -> DataFrame:
    return parsing.extract_signals(parsed(spark, sf))


def whitelist(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(pa.table({"domain": D.WHITELIST}), "domain string")


def reputation(spark: SparkSession, sf: str) -> DataFrame:
    """Reputation dimension: one row per sender address that occurs."""
    k = F.col("doc_id") % 250
    return D.table(spark, sf, "documents").select(k.alias("k")).distinct().select(
        F.concat(F.lit("203.0.113."), F.col("k").cast("string")).alias("ip"),
        (F.col("k") % 101).cast("int").alias("abuse_score"),
        F.lit("AR").alias("country"), F.lit("isp").alias("isp"))


def header_map() -> Column:
    return F.col("headers")


def content() -> Column:
    return F.col("content")


# --- parsing -------------------------------------------------------------------------------


@query("normalize_content", """
    SELECT doc_id AS report_id, CAST(length(t) - length(replace(t, chr(10), '')) AS BIGINT) AS line_breaks,
      CAST(length(t) AS BIGINT) AS chars
    FROM (SELECT page_id AS doc_id, replace(replace(replace(html, '<br>', chr(10)), '<br/>', chr(10)), '<br />', chr(10)) AS t FROM pages)""")
def normalize_content(spark, sf):
    t = M.normalize_content(F.col("html"))
    pages = D.spread(D.table(spark, sf, "pages")).select(
        F.col("page_id").alias("report_id"), t.alias("t"))
    return pages.select("report_id", S.occurrences(F.col("t"), "\n").cast("long").alias("line_breaks"),
                        F.length("t").cast("long").alias("chars"))


@query("parse_headers", derived("""i AS report_id, from_raw AS from_header, subject, message_id,
    nullif(reply_to, '') AS reply_to, 'Reporter <' || reporter || '>' AS to_header,
    'spf=' || spf || '; dkim=' || dkim || '; dmarc=' || dmarc AS auth_header,
    CASE WHEN i % 6 = 0 THEN 'yes' ELSE 'no' END AS attach, CAST(nheaders AS INT) AS header_count"""))
def parse_headers(spark, sf):
    def h(name):
        return M.header_or_null(header_map(), name)

    return parsed(spark, sf).select(
        "report_id", h("From").alias("from_header"), h("Subject").alias("subject"),
        h("Message-ID").alias("message_id"), h("Reply-To").alias("reply_to"),
        h("To").alias("to_header"), h("authentication-results").alias("auth_header"),
        h("X-MS-Has-Attach").alias("attach"), F.size(header_map()).alias("header_count"))


@query("ms_url_verdict", derived("i AS report_id, ms AS microsoft_urls"))
def ms_url_verdict(spark, sf):
    return parsed(spark, sf).select("report_id", "microsoft_urls")


@query("unescape_headers", """
    SELECT page_id, md5(regexp_replace(replace(replace(replace(html, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;?', '&', 'g')) AS text_md5
    FROM pages""")
def unescape_headers(spark, sf):
    """Entities of whole pages; the SQL names the four kinds that occur in the table."""
    return D.spread(D.table(spark, sf, "pages")).select(
        "page_id", F.md5(T.html_unescape(F.col("html"))).alias("text_md5"))


@query("extract_urls", derived("i AS report_id, nurl AS url_count"))
def extract_urls(spark, sf):
    return D.reports(spark, sf).select(
        "report_id", F.size(T.extract_urls(content())).alias("url_count"))


@query("extract_url_list", r"""
    SELECT page_id, CAST(len(regexp_extract_all(html, 'https?://[^\s<>"{}|\\^`\[\]]+')) AS INT) AS occurrences
    FROM pages""")
def extract_url_list(spark, sf):
    return D.spread(D.table(spark, sf, "pages")).select(
        "page_id", F.size(T.extract_url_list(F.col("html"))).alias("occurrences"))


@query("url_host", """
    SELECT page_id, lower(regexp_extract(url, '://([^/:?]+)', 1)) AS host,
      regexp_extract(url, '://([^/]+)', 1) AS host_port FROM pages""")
def url_host(spark, sf):
    return D.table(spark, sf, "pages").select(
        "page_id", T.url_host(F.col("url")).alias("host"),
        T.url_host_port(F.col("url")).alias("host_port"))


@query("extract_reporter", derived("i AS report_id, reporter"))
def extract_reporter(spark, sf):
    return D.reports(spark, sf).select("report_id", M.extract_reporter(content()).alias("reporter"))


@query("extract_address", derived("i AS report_id, reporter AS recipient, 'user@' || dom AS sender"))
def extract_address(spark, sf):
    return parsed(spark, sf).select(
        "report_id", T.extract_address(M.header(header_map(), "To")).alias("recipient"),
        T.extract_address(M.header(header_map(), "From")).alias("sender"))


@query("extract_emails", r"""
    SELECT doc_id, array_to_string(regexp_extract_all(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b'), ' ') AS emails
    FROM documents""")
def extract_emails(spark, sf):
    return D.spread(D.table(spark, sf, "documents")).select(
        "doc_id", F.array_join(T.extract_emails(F.col("text")), " ").alias("emails"))


@query("extract_domain", derived("i AS report_id, fd AS from_domain, rd AS reply_domain"))
def extract_domain(spark, sf):
    return parsed(spark, sf).select(
        "report_id", T.extract_domain(M.header(header_map(), "From")).alias("from_domain"),
        T.extract_domain(M.header(header_map(), "Reply-To")).alias("reply_domain"))


@query("extract_sender_ip", derived("i AS report_id, ip AS sender_ip"))
def extract_sender_ip(spark, sf):
    return parsed(spark, sf).select("report_id", M.extract_sender_ip(header_map()).alias("sender_ip"))


@query("extract_reply_to", derived("i AS report_id, reply_to"))
def extract_reply_to(spark, sf):
    return parsed(spark, sf).select("report_id", M.extract_reply_to(header_map()).alias("reply_to"))


def forefront_reports(spark, sf):
    """Header maps with anti-spam verdicts computed from ``documents``."""
    i = F.col("doc_id")

    def pick(values):
        return F.element_at(F.array(*[F.lit(v) for v in values]),
                            (i % len(values) + 1).cast("int"))

    report = F.concat(
        F.lit("CIP:198.51.100."), (i % 200).cast("string"), F.lit(";CTRY:"),
        pick(["RU", "AR", "CN", "US", "UA"]), F.lit(";SFV:"), pick(["SPM", "SKS", "SKN", "NSPM"]),
        F.lit(";CAT:"), pick(["SPOOF", "PHSH", "MALW", "NONE", "BULK", "HPHSH"]),
        F.lit(";IPV:"), pick(["NLI", "CAL"]))
    scl = F.concat(F.lit("SCL:"), (i % 11 - 1).cast("string"))
    return D.table(spark, sf, "documents").select(
        i.alias("report_id"), F.col("text").alias("content"),
        F.create_map(F.lit(M.FOREFRONT), report,
                     F.lit("X-MS-Exchange-Organization-SCL"), scl).alias("headers"),
        F.lit("None").alias("microsoft_urls"))


_FOREFRONT_CTE = """WITH f AS (SELECT doc_id AS i, doc_id % 11 - 1 AS scl,
  ['SPM','SKS','SKN','NSPM'][doc_id % 4 + 1] AS sfv,
  ['SPOOF','PHSH','MALW','NONE','BULK','HPHSH'][doc_id % 6 + 1] AS cat,
  '198.51.100.' || (doc_id % 200) AS cip, ['RU','AR','CN','US','UA'][doc_id % 5 + 1] AS ctry,
  doc_id % 2 = 0 AS nli FROM documents) """


@query("forefront_fields", _FOREFRONT_CTE + """
    SELECT i AS report_id, CAST(scl AS INT) AS scl, sfv, cat, cip, ctry, CAST(nli AS INT) AS ipv_nli FROM f""")
def forefront_fields(spark, sf):
    ff = forefront_reports(spark, sf).select("report_id", M.forefront_fields(header_map()).alias("f"))
    return ff.select("report_id", F.col("f.scl").cast("int").alias("scl"), "f.sfv", "f.cat",
                     "f.cip", "f.ctry", F.col("f.ipv_nli").cast("int").alias("ipv_nli"))


@query("feature_mail_system_flags", _FOREFRONT_CTE + """
    SELECT i AS report_id, (scl >= 5)::INT::DOUBLE AS scl_high, (scl = -1)::INT::DOUBLE AS scl_negative,
      (sfv IN ('SPM','SKS'))::INT::DOUBLE AS sfv_spam, (sfv = 'SKN')::INT::DOUBLE AS sfv_skip,
      (cat = 'SPOOF')::INT::DOUBLE AS cat_spoof, (cat IN ('PHSH','MALW'))::INT::DOUBLE AS cat_phish,
      (cat = 'NONE')::INT::DOUBLE AS cat_none, (ctry IN ('RU','CN','UA'))::INT::DOUBLE AS high_risk_country,
      nli::INT::DOUBLE AS ipv_nli FROM f""")
def feature_mail_system_flags(spark, sf):
    return parsing.feature_table(forefront_reports(spark, sf)).select(
        "report_id", "scl_high", "scl_negative", "sfv_spam", "sfv_skip", "cat_spoof",
        "cat_phish", "cat_none", "high_risk_country", "ipv_nli")


@query("body_preview", """
    SELECT doc_id, substr(text, 1, 500) AS preview FROM documents""")
def body_preview(spark, sf):
    return D.table(spark, sf, "documents").select(
        "doc_id", M.body_preview(F.col("text")).alias("preview"))


@query("header_pattern_scan", r"""
    SELECT page_id, CAST(contains(s, '<br>') AS INT) AS has_br,
      CAST(contains(s, '&lt;') OR contains(s, '&gt;') AS INT) AS has_entities,
      CAST(contains(s, 'Received:') AS INT) AS has_received,
      CAST(len(regexp_extract_all(s, '(?m)^[A-Za-z-]+:\s*.+$')) AS INT) AS header_lines
    FROM (SELECT page_id, substr(html, 1, 2000) AS s FROM pages)""")
def header_pattern_scan(spark, sf):
    scan = D.table(spark, sf, "pages").select(
        "page_id", M.header_pattern_scan(F.col("html")).alias("s"))
    return scan.select("page_id", F.col("s.has_br").cast("int").alias("has_br"),
                       F.col("s.has_entities").cast("int").alias("has_entities"),
                       F.col("s.has_received").cast("int").alias("has_received"),
                       F.col("s.header_lines").alias("header_lines"))


@query("parse_coverage", """
    SELECT count(*) AS total, count(*) AS with_headers, CAST(0 AS BIGINT) AS without_headers FROM documents""")
def parse_coverage(spark, sf):
    return parsing.parse_coverage(parsed(spark, sf))


# --- predicates ----------------------------------------------------------------------------

def _predicate(name, sql, fn):
    @query(name, derived(f"i AS report_id, CAST(({sql}) AS INT) AS hit"))
    def run(spark, sf):
        return parsed(spark, sf).select("report_id", fn().cast("int").alias("hit"))


_predicate("reply_to_mismatch", "rt", lambda: S.reply_to_mismatch(header_map()))
_predicate("display_name_mismatch", "disp", lambda: S.display_name_mismatch(M.header(header_map(), "From")))
_predicate("display_name_mismatch_strict", "disp",
           lambda: S.display_name_mismatch_feature(M.header(header_map(), "From")))
_predicate("shortener_in_text", "i % 9 = 0 OR " + " OR ".join(
    f"contains(text, '{w}')" for w in C.HEURISTIC_SHORTENERS),
    lambda: S.shortener_in_text(content()))


def crossed_headers(spark, sf):
    """Header maps whose four sender-related domains follow from ``doc_id``."""
    i = F.col("doc_id")

    def domain(n, step):
        return F.concat(F.lit("x@d"), (F.floor(i / step) % n).cast("string"), F.lit(".test"))

    return D.table(spark, sf, "documents").select(
        i.alias("report_id"), F.col("text").alias("content"), F.create_map(
            F.lit("From"), F.concat(F.lit("<"), domain(2, 1), F.lit(">")),
            F.lit("Return-Path"), domain(2, 2),
            F.lit("In-Reply-To"), F.when(i % 3 == 0, F.lit("<id>")).otherwise(domain(2, 3)),
            F.lit("X-Originating-IP"),
            F.when(i % 5 == 0, F.lit("[192.0.2.1]")).otherwise(domain(2, 5)),
            F.lit("X-Entity-ID"), F.element_at(F.array(
                F.lit("utf-8"), F.lit("koi8-r"), F.lit(""), F.lit("ISO-8859-1")),
                (i % 4 + 1).cast("int")),
            F.lit("X-Mailer"), F.element_at(F.array(F.lit("Outlook"), F.lit(" TEST ")),
                                            (i % 2 + 1).cast("int")),
            F.lit("Received"), F.lit("from a"), F.lit("received-spf"), F.lit("Fail"),
        ).alias("headers"), F.lit("None").alias("microsoft_urls"))


_CROSSED = """WITH x AS (SELECT doc_id AS i, doc_id % 2 AS f, (doc_id // 2) % 2 AS rp, (doc_id // 3) % 2 AS irt,
  (doc_id // 5) % 2 AS xo FROM documents) """


@query("return_path_mismatch", _CROSSED + "SELECT i AS report_id, (rp <> f)::INT AS hit FROM x")
def return_path_mismatch(spark, sf):
    return crossed_headers(spark, sf).select(
        "report_id", S.return_path_mismatch(header_map()).cast("int").alias("hit"))


@query("thread_hijack", _CROSSED
       + "SELECT i AS report_id, (i % 3 <> 0 AND irt <> f)::INT AS hit FROM x")
def thread_hijack(spark, sf):
    return crossed_headers(spark, sf).select(
        "report_id", S.thread_hijack(header_map()).cast("int").alias("hit"))


@query("originating_ip_mismatch", _CROSSED
       + "SELECT i AS report_id, (i % 5 <> 0 AND xo <> f)::INT AS hit FROM x")
def originating_ip_mismatch(spark, sf):
    return crossed_headers(spark, sf).select(
        "report_id", S.originating_ip_mismatch(header_map()).cast("int").alias("hit"))


@query("feature_sender_identity", _CROSSED + """
    SELECT i AS report_id, (rp <> f)::INT::DOUBLE AS return_path_mismatch,
      (i % 5 <> 0 AND xo <> f)::INT::DOUBLE AS x_originating_ip_mismatch,
      (i % 3 <> 0 AND irt <> f)::INT::DOUBLE AS thread_hijacking,
      (i % 4 = 1)::INT::DOUBLE AS encoding_suspicious, (i % 2 = 1)::INT::DOUBLE AS x_mailer_suspicious,
      0.4::DOUBLE AS received_hops FROM x""")
def feature_sender_identity(spark, sf):
    return parsing.feature_table(crossed_headers(spark, sf)).select(
        "report_id", "return_path_mismatch", "x_originating_ip_mismatch", "thread_hijacking",
        "encoding_suspicious", "x_mailer_suspicious", "received_hops")


@query("auth_received_spf_fallback", _CROSSED + "SELECT i AS report_id, 'fail' AS spf, 1 AS suspicious, 'unknown' AS feature_spf FROM x")
def auth_received_spf_fallback(spark, sf):
    rows = crossed_headers(spark, sf).select(
        "report_id", M.auth_results(header_map()).alias("a"), M.auth_results_features(header_map()).alias("f"))
    return rows.select("report_id", "a.spf", F.col("a.suspicious").cast("int").alias("suspicious"),
                       F.col("f.spf").alias("feature_spf"))


@query("shortener_match", """
    SELECT page_id, CASE WHEN host = 'example.net' OR host LIKE '%.example.net' THEN 'example.net'
      WHEN host = 'example.org' OR host LIKE '%.example.org' THEN 'example.org' ELSE '' END AS service
    FROM (SELECT page_id, lower(regexp_extract(url, '://([^/:?]+)', 1)) AS host FROM pages)""")
def shortener_match(spark, sf):
    """Host rule with services that occur in the pages table."""
    hit = T.shortener_of(F.col("url"), ["example.net", "example.org"])
    return D.table(spark, sf, "pages").select(
        "page_id", F.coalesce(hit, F.lit("")).alias("service"))


@query("shortener_reasons", derived("i AS report_id, CASE WHEN i % 9 = 0 THEN 'bit.ly' ELSE '' END AS services"))
def shortener_reasons(spark, sf):
    return D.reports(spark, sf).select("report_id", F.array_join(
        S.shortener_hits(T.extract_urls(content())), ",").alias("services"))


@query("shortener_url_count", derived("i AS report_id, CAST((i % 9 = 0) AS INT) AS n"))
def shortener_url_count(spark, sf):
    return D.reports(spark, sf).select(
        "report_id", S.shortener_url_count(T.extract_url_list(content())).alias("n"))


_WORDS = ["ting", "the", "que", "der", "with", "para"]


@query("keyword_match", "SELECT doc_id, CASE " + " ".join(
    f"WHEN contains(lower(text), '{w}') THEN '{w}'" for w in _WORDS)
    + " ELSE '' END AS keyword FROM documents")
def keyword_match(spark, sf):
    return D.spread(D.table(spark, sf, "documents")).select("doc_id", F.coalesce(
        T.first_contained(_WORDS, F.lower("text")), F.lit("")).alias("keyword"))


@query("keyword_count", "SELECT conv_id, turn, role, CAST(" + " + ".join(
    f"contains(lower(text), '{w}')::INT" for w in _WORDS) + " AS INT) AS hits FROM conversations")
def keyword_count(spark, sf):
    return D.table(spark, sf, "conversations").select(
        "conv_id", "turn", "role", T.count_contained(_WORDS, F.lower("text")).alias("hits"))


@query("keyword_any", "SELECT role, count(*) AS turns, count(*) FILTER (WHERE " + " OR ".join(
    f"contains(lower(text), '{w}')" for w in _WORDS[2:]) + ") AS hits FROM conversations GROUP BY role")
def keyword_any(spark, sf):
    return D.table(spark, sf, "conversations").groupBy("role").agg(
        F.count(F.lit(1)).alias("turns"),
        F.count_if(T.any_word(F.lower("text"), _WORDS[2:])).alias("hits"))


@query("high_risk_country", _FOREFRONT_CTE
       + "SELECT i AS report_id, (ctry IN ('RU','CN','UA'))::INT AS hit FROM f")
def high_risk_country(spark, sf):
    return forefront_reports(spark, sf).select("report_id", S.high_risk_country(
        M.forefront_fields(header_map())["ctry"]).cast("int").alias("hit"))


@query("html_form_present", """
    SELECT page_id, CAST(regexp_matches(html, '(?i)<form[^>]*>') AS INT) AS has_form FROM pages""")
def html_form_present(spark, sf):
    return D.spread(D.table(spark, sf, "pages")).select(
        "page_id", S.html_form_present(F.col("html")).cast("int").alias("has_form"))


@query("html_obfuscation", r"""
    SELECT page_id, CAST(regexp_matches(html, '&#[0-9]+;')::INT + regexp_matches(html, '(?i)\\x[0-9a-f]{2}')::INT
      + regexp_matches(html, '(?i)btoa\(')::INT + regexp_matches(html, '(?i)eval\(')::INT AS INT) AS patterns,
      CAST((length(html) - length(replace(html, '--', ''))) / 2 AS INT) AS dashes FROM pages""")
def html_obfuscation(spark, sf):
    return D.spread(D.table(spark, sf, "pages")).select(
        "page_id", S.html_obfuscation_count(F.col("html")).alias("patterns"),
        S.occurrences(F.col("html"), "--").alias("dashes"))


@query("distinct_url_domains", derived("i AS report_id, nurl AS domains"))
def distinct_url_domains(spark, sf):
    return D.reports(spark, sf).select(
        "report_id", T.distinct_url_domains(T.extract_urls(content())).alias("domains"))


@query("url_domain_table", r"""
    SELECT host, count(*) AS pages, count(DISTINCT url) AS urls FROM (
      SELECT url, regexp_extract(url, '://([^/]+)', 1) AS host FROM pages) GROUP BY host""")
def url_domain_table(spark, sf):
    return D.table(spark, sf, "pages").groupBy(T.url_host_port(F.col("url")).alias("host")).agg(
        F.count(F.lit(1)).alias("pages"), F.countDistinct("url").alias("urls"))


# --- lookups -------------------------------------------------------------------------------

@query("whitelist_match", derived("i AS report_id, fd AS from_domain", "WHERE wl"))
def whitelist_match(spark, sf):
    s = signals(spark, sf).select("report_id", "from_domain")
    return domains.whitelist_match(s, whitelist(spark)).select("report_id", "from_domain")


@query("whitelist_miss", derived("i AS report_id, fd AS from_domain", "WHERE NOT wl"))
def whitelist_miss(spark, sf):
    s = signals(spark, sf).select("report_id", "from_domain")
    return domains.whitelist_miss(s, whitelist(spark)).select("report_id", "from_domain")


@query("homograph_match", derived(
    "i AS report_id, fd AS from_domain, homo AS imitated, 1 AS distance", "WHERE homo IS NOT NULL"))
def homograph_match(spark, sf):
    s = signals(spark, sf).select("report_id", "from_domain")
    return domains.homograph_match(s, whitelist(spark)).select(
        "report_id", "from_domain", F.col("homograph_of").alias("imitated"),
        F.col("homograph_distance").alias("distance"))


_HOSTS = ("SELECT DISTINCT lower(regexp_extract(url, '://([^/:?]+)', 1)) AS host FROM pages")
_LIST = """SELECT DISTINCT CASE WHEN length(host) - length(replace(host, '.', '')) >= 3
  THEN substr(host, strpos(host, '.') + 1) ELSE host END AS entry FROM h WHERE host LIKE '%.example.com'"""


def host_lists(spark, sf):
    """Page hosts as sender domains, and an allow-list of the example.com sites among them."""
    host = T.url_host(F.col("url"))
    hosts = D.table(spark, sf, "pages").select(host.alias("from_domain"))
    site = F.when(F.size(F.split("from_domain", r"\.")) >= 4, F.substring(
        F.col("from_domain"), F.locate(".", F.col("from_domain")) + 1, F.length("from_domain"))
    ).otherwise(F.col("from_domain"))
    return hosts, hosts.where(F.endswith("from_domain", F.lit(".example.com"))).select(
        site.alias("domain")).distinct()


@query("allow_list_suffix_join", f"""
    WITH h AS ({_HOSTS}), w AS ({_LIST})
    SELECT host AS from_domain FROM h WHERE EXISTS (
      SELECT 1 FROM w WHERE h.host = w.entry OR h.host LIKE '%.' || w.entry)""")
def allow_list_suffix_join(spark, sf):
    hosts, listed = host_lists(spark, sf)
    return domains.sender_verdicts(hosts, listed).where("whitelisted").select("from_domain")


@query("edit_distance_join", f"""
    WITH h AS ({_HOSTS}), w AS ({_LIST}),
    c AS (SELECT host, entry, levenshtein(host, entry) AS d FROM h, w WHERE host <> entry AND levenshtein(host, entry) <= 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY d, entry) AS rn FROM c)
    SELECT host AS from_domain, entry AS imitated, CAST(d AS INT) AS distance FROM r WHERE rn = 1""")
def edit_distance_join(spark, sf):
    hosts, listed = host_lists(spark, sf)
    return domains.sender_verdicts(hosts, listed).where("homograph_of IS NOT NULL").select(
        "from_domain", F.col("homograph_of").alias("imitated"),
        F.col("homograph_distance").alias("distance"))


@query("edit_distance", """
    SELECT n_name, r_name, CAST(levenshtein(n_name, r_name) AS INT) AS distance
    FROM nation JOIN region ON n_regionkey = r_regionkey""")
def edit_distance(spark, sf):
    nation, region = (D.table(spark, sf, n) for n in ("nation", "region"))
    return nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(
        "n_name", "r_name",
        T.edit_distance(F.col("n_name"), F.col("r_name")).alias("distance"))


@query("normalize_homograph", """
    SELECT doc_id, CAST(length(regexp_replace(strip_accents(substr(text, 1)), '[^ -~\\n\\r\\t]', '', 'g')) AS BIGINT) AS chars
    FROM documents""")
def normalize_homograph(spark, sf):
    return D.spread(D.table(bounded_batches(spark), sf, "documents")).select(
        "doc_id", F.length(T.normalize_homograph(F.col("text"))).cast("long").alias("chars"))


@query("ip_reputation_join", derived("""i AS report_id, ip AS sender_ip,
    CAST(i % 250 % 101 AS INT) AS abuse_score, 1 AS checked"""))
def ip_reputation_join(spark, sf):
    s = signals(spark, sf).select("report_id", "sender_ip")
    joined = domains.ip_reputation_join(s, reputation(spark, sf))
    return joined.select("report_id", "sender_ip", "ip_reputation.abuse_score",
                         F.col("ip_reputation.checked").cast("int").alias("checked"))


# --- authentication and scoring ------------------------------------------------------------

@query("auth_results", derived("""i AS report_id, spf, dkim, dmarc,
    CAST(spf IN ('fail','softfail') OR dkim = 'fail' OR dmarc = 'fail' AS INT) AS suspicious"""))
def auth_results(spark, sf):
    a = parsed(spark, sf).select("report_id", M.auth_results(header_map()).alias("a"))
    return a.select("report_id", "a.spf", "a.dkim", "a.dmarc",
                    F.col("a.suspicious").cast("int").alias("suspicious"))


@query("auth_results_features", derived("i AS report_id, spf, dkim, dmarc"))
def auth_results_features(spark, sf):
    return parsed(spark, sf).select(
        "report_id", M.auth_results_features(header_map()).alias("a")).select("report_id", "a.*")


@query("suspicious_reasons", derived("i AS report_id, base_reasons AS reasons"))
def suspicious_reasons(spark, sf):
    return signals(spark, sf).select(
        "report_id", F.array_join("pattern_reasons", "; ").alias("reasons"))


def scored(spark, sf, ip=None):
    from tamiz.plans.triage import score_signals

    # Stored once, so that the lookups do not parse the mail again.
    return score_signals(settle(signals(spark, sf).drop("vector", "headers_raw", "body_preview"), "scored"), whitelist(spark), ip)


@query("risk_score", derived("i AS report_id, risk AS deep_risk, vote_risk"))
def risk_score(spark, sf):
    return scored(spark, sf).select("report_id", "deep_risk", "vote_risk")


@query("risk_score_with_reputation", derived("""i AS report_id, CAST(least(points + least(nreasons * 7, 25)
    + CASE WHEN i % 250 % 101 >= 80 THEN 20 WHEN i % 250 % 101 >= 50 THEN 10
      WHEN i % 250 % 101 >= 20 THEN 5 ELSE 0 END, 100) AS INT) AS risk"""))
def risk_score_with_reputation(spark, sf):
    return scored(spark, sf, reputation(spark, sf)).select(
        "report_id", F.col("deep_risk").alias("risk"))


@query("reason_ordering", derived("i AS report_id, deep_reasons AS reasons"))
def reason_ordering(spark, sf):
    return scored(spark, sf).select(
        "report_id", F.array_join("deep_reasons", "; ").alias("reasons"))


@query("fallback_classify", derived(
    "i AS report_id, fb_class AS classification, fb_conf AS confidence, fb_text AS reasoning"))
def fallback_classify(spark, sf):
    decided = scored(spark, sf).select("report_id", SC.fallback_classify(
        F.col("indicators"), F.col("microsoft_urls"), F.col("homograph"),
        F.col("ip_reputation.abuse_score"), F.col("deep_risk")).alias("d"))
    return decided.select("report_id", "d.*")


# --- features ------------------------------------------------------------------------------

_GROUPS = {
    "feature_auth_flags": ["spf_fail", "spf_softfail", "dkim_none", "dmarc_none", "auth_all_pass"],
    "feature_compauth": ["compauth_fail"],
    "feature_subject": ["subject_keywords", "subject_very_short"],
    "feature_reply_to": ["reply_to_mismatch"],
    "feature_sender_domain": ["sender_domain_suspicious"],
    "feature_urls": ["url_count_norm", "ms_urls_detected", "short_urls"],
    "feature_attachment": ["has_attachment"],
    "feature_display_name": ["display_name_mismatch"],
    "feature_html": ["form_in_email", "html_obfuscation"],
    "feature_multipart": ["multipart_suspicious"],
    "feature_received_hops": ["received_hops", "x_mailer_suspicious"],
    "feature_table": list(C.FEATURE_NAMES),
}


def _feature_query(name, names):
    @query(name, derived("i AS report_id, " + ", ".join(
        f"{FEATURE_SQL[n]} AS {n}" for n in names)))
    def run(spark, sf):
        return parsing.feature_table(parsed(spark, sf)).select("report_id", *names)


for _name, _names in _GROUPS.items():
    _feature_query(_name, _names)


@query("features_to_vector", derived("i AS report_id, " + ", ".join(
    f"{FEATURE_SQL[n]} AS v{k:02d}" for k, n in enumerate(C.FEATURE_NAMES))))
def features_to_vector(spark, sf):
    v = F.col("vector")
    return signals(spark, sf).select(
        "report_id", *[v[k].alias(f"v{k:02d}") for k in range(len(C.FEATURE_NAMES))])


_LEARNED = ["spf_fail", "dkim_none", "dmarc_none", "auth_all_pass", "ms_urls_detected"]


@query("feedback_vector", derived("i AS report_id, " + ", ".join(
    f"{FEATURE_SQL[n]} AS {n}" for n in _LEARNED) + """,
    least(least(nurl, 10) / 10.0::DOUBLE, 1.0) AS url_count_norm, 0.0::DOUBLE AS has_attachment"""))
def feedback_vector(spark, sf):
    s = signals(spark, sf).select("report_id", FX.feedback_vector(
        F.col("indicators"), F.col("microsoft_urls"), F.size("urls_found")).alias("v"))
    shown = _LEARNED + ["url_count_norm", "has_attachment"]
    return s.select("report_id", *[
        F.col("v")[C.FEATURE_NAMES.index(n)].alias(n) for n in shown])


@query("active_features", derived("i AS report_id, array_to_string(list_filter([" + ", ".join(
    f"CASE WHEN {FEATURE_SQL[n]} > 0 THEN '{n}' END" for n in C.FEATURE_NAMES)
    + "], lambda x: x IS NOT NULL)[1:8], ', ') AS active"))
def active_features(spark, sf):
    return signals(spark, sf).select("report_id", F.array_join(
        F.slice(FX.active_features(F.col("vector")), 1, 8), ", ").alias("active"))


@query("heuristic_score", derived("i AS report_id, round(heur, 6) AS score"))
def heuristic_score(spark, sf):
    return signals(spark, sf).select("report_id", F.round("heuristic_score", 6).alias("score"))


@query("suspicious_headers", derived("i AS report_id, 0 AS suspicious, CAST(nheaders AS INT) AS header_count"))
def suspicious_headers(spark, sf):
    return signals(spark, sf).select(
        "report_id", F.col("suspicious_headers").cast("int").alias("suspicious"), "header_count")


@query("first_ten_urls", derived("i AS report_id, CAST(least(nurl, 10) AS INT) AS kept, nurl AS found"))
def first_ten_urls(spark, sf):
    return signals(spark, sf).select(
        "report_id", F.size("urls_found").alias("kept"), F.col("url_count").alias("found"))
