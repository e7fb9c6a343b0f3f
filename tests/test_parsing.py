import random
import re

from pyspark.sql import functions as F

from tamiz import constants as C
from tamiz.functions import mail as M
from tamiz.functions import signals as S
from tamiz.operators import parsing

EXPORT = (
    "<html><body>\n<div># Questionable URLs detected in message: None Received: from a.example "
    "(192.0.2.1) by b Content-Type: text/plain From: Flat To: Flat Subject: flat</div>\n"
    "<div># Questionable URLs detected in message:<br>\nNone<br>\n<br>\n"
    "Received: from first.example (192.0.2.1) by x<br>\n"
    "Received: from last.example (198.51.100.7) by y;<br>\n Thu<br>\n"
    "From: &quot;poll@known.example&quot; &lt;no@sender.example&gt;<br>\n"
    "To: Ana &lt;ana@corp.example&gt;<br>\nSubject: Hola<br>\n"
    "Reply-To: &lt;other@known.example&gt;<br>\n</div></body></html>\n")


def plain_parse(text):
    """Line-by-line statement of the header rules, for comparison."""
    clean = text.replace("<br>", "\n").replace("<br/>", "\n").replace("<br />", "\n")
    for name in C.LINE_STARTING_HEADERS:
        clean = re.sub(r"(\S)\s+(" + re.escape(name) + ")", r"\1\n\2", clean)
    found, key, parts = {}, None, []

    def close():
        if key:
            found[key] = " ".join(parts).strip()

    for line in clean.split("\n"):
        bare = line.strip()
        if bare.startswith("#"):
            continue
        if not bare:
            close()
            key, parts = None, []
        elif not line[0].isspace() and ":" in line:
            close()
            head, rest = line.split(":", 1)
            key, parts = head.strip(), [rest.strip()]
        elif line[0].isspace() and key:
            parts.append(bare)
    close()
    return clean, found


def random_text(rng):
    tokens = ["From:", "To:", "To: To:", "Subject:", "X-MS-", "Reply-To:", "key:", "word", ":", "#", "# note",
              "\n", "\n", "\n ", "\n\t", " ", "  ", "\n\n", " ", "<br>", "<br />", "<br/>", "\x1c", "\r",
              "a:b", "é", " ", "Received:"]
    return "".join(rng.choices(tokens, k=rng.randint(1, 40)))


def test_header_rules_against_plain_statement(spark):
    rng = random.Random(11)
    texts = [random_text(rng) for _ in range(1500)] + [EXPORT, "", " From: x", "To: To: To: a", "x To: To: To: To: a"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, content string")
    rows = df.select("i", M.normalize_content(F.col("content")).alias("clean")).select(
        "i", "clean", M.parse_headers(F.col("clean")).alias("h")).collect()
    import html

    for r in rows:
        clean, found = plain_parse(texts[r["i"]])
        assert r["clean"] == clean, repr(texts[r["i"]])
        assert r["h"] == {k: html.unescape(v) for k, v in found.items()}, repr(texts[r["i"]])


def test_html_export(spark):
    df = spark.createDataFrame([("m", EXPORT)], "report_id string, content string")
    row = parsing.extract_signals(parsing.parse_reports(df)).first()
    assert row["microsoft_urls"] == "None"
    assert row["from_raw"] == '"poll@known.example" <no@sender.example>'
    assert row["reporter_header"] == "ana@corp.example"
    assert row["reporter_content"] == "br"  # first bracket of the raw line is the tag
    assert row["sender_ip"] == "198.51.100.7"
    assert row["from_domain"] == "known.example"
    assert row["pattern_reasons"] == ["Display name no coincide con email real"]


def test_verdict(column):
    mark = C.QUESTIONABLE_URLS_MARK
    values = ["no mark", f"{mark} None\nx", f"{mark}\n\n http://bad.example \nrest", f"{mark}\n\nnext line", f"{mark}  "]
    assert column(values, M.ms_url_verdict) == ["None", "None", "http://bad.example", "next line", ""]


def test_reporter(column):
    values = ["x\nTo: <a@b.example>\n", "To:  plain@x.example  \n", "to: no", "To:\nnext", " To: indented"]
    assert column(values, M.extract_reporter) == [
        "a@b.example", "plain@x.example", "unknown@example.com", "next", "unknown@example.com"]


def headers_of(spark, headers, content="x"):
    return spark.createDataFrame([("r", headers, content, "None")],
                                 "report_id string, headers map<string,string>, content string, microsoft_urls string")


def test_authentication(spark):
    def auth(headers, case="exact"):
        row = headers_of(spark, headers).select(M.auth_results(F.col("headers"), case).alias("a")).first()["a"]
        return row["spf"], row["dkim"], row["dmarc"], row["suspicious"]

    assert auth({"Authentication-Results": "spf=fail"}) == ("unknown", "unknown", "unknown", False)
    assert auth({"Authentication-Results": "spf=fail"}, "insensitive") == ("fail", "unknown", "unknown", True)
    assert auth({"authentication-results": "SPF=Pass; dkim=softfail; dmarc=none"}) == ("pass", "softfail", "none", True)
    # the fallback reads "softfail" as "fail"
    assert auth({"received-spf": "SoftFail (x)"}) == ("fail", "unknown", "unknown", True)


def test_suspicious_headers(spark):
    def check(headers):
        return headers_of(spark, headers).select(M.suspicious_headers(F.col("headers")).alias("s")).first()["s"]

    good = {"From": "a", "Subject": "b", "Message-ID": "c"}
    assert not check(good)
    assert check({**good, "X": "  "})
    assert check({"From": "a", "Subject": "b"})


def test_features_of_worked_example(spark):
    headers = {"From": "admin@vendor.example", "To": "u@corp.example", "Subject": "Verify your account urgently",
               "X-MS-Has-Attach": "no", "Authentication-Results": "spf=fail; dkim=none; dmarc=fail",
               "x-forefront-antispam-report": "CAT:PHSH;SCL:9"}
    df = headers_of(spark, headers, "Click here: http://fake.example/verify?x").withColumn(
        "microsoft_urls", F.lit("Detected"))
    row = parsing.feature_table(df).first().asDict()
    active = {k: v for k, v in row.items() if k in C.FEATURE_NAMES and v}
    assert active == {"cat_phish": 1.0, "subject_keywords": 1 / 3, "url_count_norm": 0.1, "ms_urls_detected": 1.0,
                      "x_mailer_suspicious": 1.0}
    assert len(row["vector"]) == 33


def test_diagnostics(spark):
    df = headers_of(spark, {"A": "b"}, "Received: x\n<br>&lt;\nTo: y\nbad line")
    row = df.select(M.header_pattern_scan(F.col("content")).alias("s")).first()["s"]
    assert (row["header_lines"], row["has_br"], row["has_entities"], row["has_received"]) == (2, True, True, True)
    cover = parsing.parse_coverage(df).first()
    assert (cover["total"], cover["with_headers"], cover["without_headers"]) == (1, 1, 0)


def test_either_word_list_is_found_and_searched_for_once(spark):
    bodies = ["nothing", "the Password is", "a PRIZE", "please Confirm", "SUSPENDED", "verificar", None, "", "bit.ly ñ -- --"]
    rows = [(i, None if b is None else f"Subject: {'winner' if i == 0 else 'x'}\n\n{b}") for i, b in enumerate(bodies)]
    df = spark.createDataFrame(rows, "report_id long, content string")
    signals = parsing.extract_signals(parsing.parse_reports(df))
    plan = signals._jdf.queryExecution().optimizedPlan().toString()
    # The words of both lists, without those that hold another one; each list only where one was found.
    assert re.search(r"CASE WHEN _any_word#\d+ THEN Contains", plan)
    got = {r["report_id"]: (r["keyword"], r["heuristic_score"]) for r in signals.collect()}
    assert got == {0: ("winner", 0.0), 1: (None, 0.3), 2: ("prize", 0.0), 3: (None, 0.3), 4: ("suspend", 0.3),
                   5: ("verificar", 0.0), 6: (None, 0.0), 7: (None, 0.0), 8: (None, 0.2)}


def test_occurrences_do_not_depend_on_the_width_of_characters(column):
    texts = ["", "--", "---", "ñ--é--", "€ -- – --", None, "----a"]
    assert column(texts, lambda c: S.occurrences(c, "--")) == [None if t is None else t.count("--") for t in texts]
    assert column(["ñañ", "a"], lambda c: S.occurrences(c, "ñ")) == [2, 0]


def test_breaks_and_opening_space_are_kept(column):
    texts = ["a<br>b", "a<br/>b<br />c", "a<br x", "   Subject: x From: y", "Subject: x To: ñ", " ", None]
    assert column(texts, M.normalize_content) == [
        "a\nb", "a\nb\nc", "a<br x", "   Subject: x\nFrom: y", "Subject: x\nTo: ñ", " ", None]
