import html
import random
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F

from tamiz.constants import WS_CHARS
from tamiz.functions import text as T
from tamiz.session import bounded_batches


def test_strip_matches_str_strip(column):
    values = ["", "  a ", " x ", "\x1ca b\x85\n", "﻿a", WS_CHARS]
    assert column(values, T.strip) == [v.strip() for v in values]


def test_html_unescape_matches_stdlib(column):
    rng = random.Random(7)
    pieces = ["&lt;", "&gt;", "&quot;", "&amp;", "&amp;lt;", "&nbsp", "&notit;", "&notin;", "&", "&&",
              "&#", "&#x", "&#65;", "&#x41", "&#0;", "&#13;", "&#128;", "&#x81;", "&#xD800;",
              "&#1114112;", "&#99999999999;", "&#x1F600;", "&#11;", "&#xFFFE;", "&#x7f;", "&bogus;",
              "&ampx", "&AElig", "&CounterClockwiseContourIntegral;", "a", " ", "<", ";", "ñ", "\n",
              "&gtquot;", "&para", "&parallel;", "&lang;", "&#0000065;", "&#x00041;"]
    values = pieces + ["".join(rng.choices(pieces, k=6)) for _ in range(300)]
    assert column(values, T.html_unescape) == [html.unescape(v) for v in values]


def test_extract_address(column):
    cases = {
        "Ana Lopez &lt;ana.lopez@corp.example&gt;": "ana.lopez@corp.example",
        "Ana Lopez <ana.lopez@corp.example>": "ana.lopez@corp.example",
        "user@example.com": "user@example.com",
        "&quot;Test User&quot; &lt;test@domain.example&gt;": "test@domain.example",
        "Name first@x.example last@y.example": "last@y.example",
        "> odd <": "", "Nobody": "Nobody", "": "", "< spaced@x.example >": "spaced@x.example",
    }
    assert column(list(cases), T.extract_address) == list(cases.values())


def test_urls_and_domains(column):
    text = "see http://A.example:80/x?y=1 and https://b.example/<z> http://A.example:80/x?y=1 www.c.example"
    assert column([text], T.extract_url_list)[0] == [
        "http://A.example:80/x?y=1", "https://b.example/", "http://A.example:80/x?y=1"]
    assert column([text], T.extract_urls)[0] == ["http://A.example:80/x?y=1", "https://b.example/"]
    assert column(["http://A.Example:80/x"], T.url_host) == ["a.example"]
    assert column(["http://A.Example:80/x"], T.url_host_port) == ["A.Example:80"]
    assert column(['"x@Real.example" <y@fake.example>', "none"], T.extract_domain) == ["real.example", ""]
    assert column(["a.b.c.d", "b.c", "c", "a..b"], T.domain_suffixes) == [
        ["a.b.c.d", "b.c.d", "c.d"], ["b.c"], ["c"], ["a..b", ".b"]]
    services = lambda c: T.shortener_of(c, ["t.co", "bit.ly"])
    assert column(["http://bit.ly/x", "http://a.t.co/", "http://bit.co/", "http://xt.co"], services) == [
        "bit.ly", "t.co", None, None]


def test_emails_match_python_pattern(column):
    pattern = re.compile(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b")
    values = ["a@b.co", "ña@b.co x", "(m.n+o@p-q.example).", "a@b.c", "x@y.example_z", "-a@b.com, %c@d.org|"]
    assert column(values, T.extract_emails) == [pattern.findall(v) for v in values]


def test_words(column):
    words = ["beta", "alpha", "a.b"]
    values = ["alpha beta", "alpha", "axb", "a.b", ""]
    assert column(values, lambda c: T.first_contained(words, c)) == ["beta", "alpha", None, "a.b", None]
    assert column(values, lambda c: T.count_contained(words, c)) == [2, 1, 0, 1, 0]
    assert column(values, lambda c: T.any_word(c, words)) == [True, True, False, True, False]
    assert column(values, lambda c: T.any_contains(c, words)) == [True, True, False, True, False]


def test_normalize_homograph(column):
    values = ["exámple.com", "ｅｘample.com", "раypal.com", "plain"]
    expected = [unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode() for v in values]
    assert column(values, T.normalize_homograph) == expected


def test_texts_go_to_python_in_batches_of_few_bytes(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.nbytes], pa.int64())})

    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        texts = bounded_batches(spark, 1 << 20).range(0, 300, 1, 1).select(F.repeat(F.lit("é"), 20_000).alias("text"))
        assert texts.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] < 2 << 20  # 12 MB in all
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)


def test_normalize_homograph_is_sent_only_what_is_not_ascii(spark, column):
    values = ["plain\x00 \x7f", "", None, "½ﬁ", "e\u0301\u0323", "가x", "\U0001d400"]
    assert column(values, T.normalize_homograph) == ["plain\x00 \x7f", "", None, "12fi", "e", "x", "A"]
    plan = spark.createDataFrame([("a",)], "t string").select(T.normalize_homograph(F.col("t")))._jdf.queryExecution().toString()
    assert "RLIKE" in plan.upper() or "REGEXP" in plan.upper()


def test_words_are_searched_as_bytes_and_each_stem_once(spark, column):
    words = ["urgent", "urgente", "a.b", "c*", "actúa", "urgent"]
    texts = ["", "muy urgente", "axb", "a.b", "cc", "c*", "ACTÚA", "actúa ya", None, "urgen"]
    assert column(texts, lambda c: T.any_word(c, words)) == [
        None if t is None else any(w in t for w in words) for t in texts]
    assert column(["x"], lambda c: T.any_word(c, [])) == [False]
    df = spark.createDataFrame([("x",)], "v string").where(T.any_word(F.col("v"), words))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan.upper() and plan.count("Contains(") == 4
