"""Personal data, quality rules, licenses, toxicity and weak labels."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from tamiz.llm import adaptive_rules, disclosure, license_scan, toxicity_chain, weak_quality
from tests.llm.helpers import DATA, HAVE_DATA, documents, plain

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base(text):
    out = {}
    for kind, pattern in KINDS.items():
        out[kind] = []
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out[kind].append(f"{kind}:{m.start()}:{m.end()}")
    return out


HARD = [
    None, "", "no data", "a@b.c", "a@b", "x@y.z@w.v", "one@a.b%two@c.d.e f", "@a.b", "é a.b+c@dé.fr ü@ü.de 1@2.3", "a@b.c.d.", "..a@b.c",
    "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1 001.02.3.0255 1.1.1.1000", "9.9.9.999 1.2.3", "12345678901234567890.1.1.1",
    "4111 1111 1111 1111", "4111-1111-1111-1111 4111  1111", "😀 4111111111111111x", "4111111111111112", "0000 0000 0000 0000 000", "1" * 40,
    "+1 (234) 555-0100", "+1", "+12345678", "+1234567", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "++44 20 7946 0958.", "+4 (((((  ", "é+1 234 567 89\n+1 234 567 89",
    "a@1.2.3.4 +1.2.3.4 4111 1111 1111 1111 +41 11 11 11", "a" * 3000 + "@b.c", "1 " * 3000, "+" * 500, "\x00\t1.2.3.4\r\n" * 3,
]


def test_base_spans_equal_plain_patterns(spark):
    got = {r.doc_id: r for r in disclosure.personal_data(documents(spark, HARD).selectExpr("*", "1 as spans")).collect()}
    assert len(got) == len(HARD)
    for d, text in enumerate(HARD):
        want = base(text)
        flat = ",".join(s for kind in KINDS for s in want[kind])
        assert [got[d][f"n_{k}"] for k in KINDS] == [len(want[k]) for k in KINDS], text
        assert got[d].base_sha256 == hashlib.sha256(flat.encode()).hexdigest(), text
        assert got[d].spans == flat


@pytest.mark.skipif(not HAVE_DATA, reason="tables not present")
def test_base_spans_of_the_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for r in disclosure.personal_data(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        assert r.base_sha256 == hashlib.sha256(",".join(s for k in base(r.text).values() for s in k).encode()).hexdigest()


def test_terms_that_reveal_an_entity_are_generalised_or_removed(spark):
    filler = ["alpha beta gamma delta epsilon zeta eta theta"] * 40
    told = [f"note {k} from the Quartermaster of the north john@x.org wrote {w} today" for k, w in enumerate(["ant", "bee", "cow", "dog"])]
    others = [f"the north of the {w} today" for w in "one two three four five six".split()] + ["a Quartermaster alone", "again the quartermaster, Quartermaster"]
    texts = [f"{t} {k}" for k, t in enumerate(filler)] + told + others
    found = {r.doc_id: r for r in disclosure.find_disclosures(documents(spark, texts), threshold=0.75).collect()}
    terms = {d: [texts[d][s.start:s.stop] for s in r._terms] for d, r in found.items() if r._terms}
    assert terms == {40 + k: ["Quartermaster", "wrote"] for k in range(4)} | {50: ["Quartermaster"], 51: ["quartermaster", "Quartermaster"]}
    clean = {r.doc_id: r.text for r in disclosure.sanitised(documents(spark, texts), threshold=0.75).collect()}
    assert clean[40] == "note 0 from the [TERM] of the north [EMAIL]  ant today"
    assert clean[51] == "again the [TERM], [TERM]" and clean[0] == texts[0]


def levels(kind, value):
    number = re.sub("[^0-9]", "", value)
    if kind == "email":
        value = value.lower()
        return [f"email:{value}", "email:@" + value.split("@")[-1], "email"]
    if kind == "ip":
        return [f"ip:{value}", "ip:" + ".".join(value.split(".")[:3]) + ".*", "ip"]
    return [f"{kind}:{number}", f"{kind}:{number[:6 if kind == 'card' else 4]}*", kind]


def revealing(texts, threshold, support):
    """Terms and their disclosure, from the definition of the score."""
    texts = sorted(set(t or "" for t in texts))
    words = [set(plain(t)) for t in texts]
    held, contexts = {}, {}
    for d, text in enumerate(texts):
        for kind, spans in base(text).items():
            for span in spans:
                start, stop = map(int, span.split(":")[1:])
                b, a = plain(text[max(0, start - 80):start])[-5:], plain(text[stop:stop + 80])[:5]
                for entity in levels(kind, text[start:stop]):
                    held.setdefault(entity, set()).add(d)
                    for w in {*a, *b}:
                        if re.fullmatch(r"[^\W\d_]{3,}", w):
                            contexts.setdefault((entity, w), set()).add((tuple(b), tuple(a), d))
    out = {}
    for (entity, w), seen in contexts.items():
        if len({c[:2] for c in seen}) < support or len(held[entity]) == len(texts):
            continue
        both, of_term = len({c[2] for c in seen}), sum(w in ws for ws in words)
        share = math.log2(len(texts) * both / (len(held[entity]) * of_term)) / math.log2(len(texts) / len(held[entity]))
        out[w] = max(out.get(w, -9), share)
    return {w: s for w, s in out.items() if s >= threshold}


def test_terms_equal_the_definition(spark):
    """Values that never return, but whose domain, block, prefix or kind does."""
    rng = random.Random(3)
    pool = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)]
    texts = [" ".join(rng.choices(pool, k=30)) for _ in range(120)]
    cue = {"ledger": lambda k: f"u{k}@mail{k % 2}.example.org", "gateway": lambda k: f"10.0.{k % 2}.{k}", "hotline": lambda k: f"+1 234 555 01{k:02d}"}
    for w, value in cue.items():
        texts += [" ".join(rng.choices(pool, k=8) + [w, value(k)] + rng.choices(pool, k=8)) for k in range(12)]
    texts += [f"the gateway {rng.choice(pool)}" for _ in range(3)] + [None, "", texts[-1]]
    want = revealing(texts, 0.8, 3)
    found = disclosure.find_disclosures(documents(spark, texts), threshold=0.8).collect()
    got = {texts[r.doc_id][s.start:s.stop] for r in found for s in r._terms}
    assert got == set(want) and {"ledger", "hotline"} <= got
    alone = ["mail a@b.c now", "mail d@b.c then", "mail e@b.c here"]
    assert not any(r._terms for r in disclosure.find_disclosures(documents(spark, alone)).collect())


def test_sanitised_takes_columns_of_any_name(spark):
    df = documents(spark, ["mail a@b.c", None]).selectExpr("*", "1 as tid", "2 as _text", "3 as _terms", "4 as _row", "5 as _email", "6 as term")
    got = disclosure.sanitised(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id, r.text, r.tid, r._text, r._terms, r._row, r._email, r.term) for r in got.collect()) == [
        (0, "mail [EMAIL]", 1, 2, 3, 4, 5, 6), (1, None, 1, 2, 3, 4, 5, 6)]


def test_sanitised_keeps_columns_rows_and_nulls(spark):
    df = documents(spark, ["mail a@b.c or +12345678, a@b.c", None, "", "a@1.2.3.4"]).selectExpr("*", "7 as spans", "8 as entity")
    df = df.unionByName(df.limit(1))
    got = disclosure.sanitised(df)
    assert got.columns == df.columns
    rows = sorted(((r.doc_id, r.text, r.n_chars) for r in got.collect()), key=str)
    assert rows == sorted([(0, "mail [EMAIL] or [PHONE], [EMAIL]", 32)] * 2 + [(1, None, None), (2, "", 0), (3, "[EMAIL]", 7)], key=str)
    assert disclosure.sanitised(df.limit(0)).count() == 0


def repeat_words(words):
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i:i + 8]), []).append(i)
    cover = {p for places in seen.values() if len(places) > 1 for i in places for p in range(i, i + 8)}
    return len(cover)


def test_statistics_equal_plain_python(spark):
    texts = [None, "", " \n\t", "one", "a b c d e f g h", " ".join(["again"] * 30), "x y z " * 20, "l1 a\nl1 a\n\nl1 a\n ", "ÉÀ # $% <b>|&*\x0b\x0cß\xa0x 😀",
             "p q r s t u v w 1 p q r s t u v w 2 q r s t u v w 1 p"]
    got = {r.doc_id: r for r in adaptive_rules.text_statistics(documents(spark, texts)).collect()}
    for d, text in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
        want = (len(words), len("".join(words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), repeat_words(words))
        assert (got[d].n_words, got[d].word_chars, got[d].n_symbols, got[d].n_dup_lines, got[d].n_repeat_words) == want, text
        assert got[d].base_failed == (len(words) < 20 or 100 * want[4] > 30 * len(words))


def test_buckets_order_values_and_bound_the_error(spark):
    df = spark.range(5000).selectExpr("id as v")
    rows = df.select("v", adaptive_rules.bucket(df.v).alias("b")).select("v", "b", adaptive_rules.bucket_top(adaptive_rules.F.col("b")).alias("top")).orderBy("v").collect()
    assert all(r.v <= r.top <= r.v + max(0, r.v // 32) for r in rows)
    assert all(x.b <= y.b for x, y in zip(rows, rows[1:]))


def test_sketches_merge_exactly_and_groups_have_their_own_fences(spark):
    good = [" ".join(f"word{k}" for k in range(i, i + 30)) for i in range(20)]
    junk = " ".join(f"## ** {k}" for k in range(30))
    df = documents(spark, [*good, junk, None])
    measured = adaptive_rules._measured(adaptive_rules.text_statistics(df))
    first, second = measured.where("doc_id % 2 = 0"), measured.where("doc_id % 2 = 1")
    merged = adaptive_rules.merge_sketches(adaptive_rules.sketch(first), adaptive_rules.sketch(second))
    assert sorted(merged.collect()) == sorted(adaptive_rules.sketch(measured).collect())
    kept = {r.doc_id: r.kept for r in adaptive_rules.adaptive_rules(df.selectExpr("*", "1 as kept", "2 as n")).collect()}
    assert kept == {**{i: True for i in range(20)}, 20: False, 21: False}
    assert adaptive_rules.adaptive_rules(df.limit(0)).count() == 0


def test_licenses_and_their_exact_differences(spark):
    mit = license_scan.TEMPLATES["MIT"]
    texts = [None, "", "no notice", "Some prose.\nReleased under the MIT License.\nMore prose.", "Licensed under CC BY-NC 4.0.", "Licensed under CC BY 4.0.",
             f"Copyright 2020 Someone\n{mit}\nint main()", mit.replace("sublicense", "rent").upper(), "A licensed electrician has permission to enter.",
             "words " * 3000 + license_scan.TEMPLATES["GPL-3.0 notice"] + " words" * 3000, "Licensed under the Apache License, Version 2.0.\nThis work is licensed under the GNU General Public License, version 3."]
    rows = license_scan.license_scan(documents(spark, texts).selectExpr("*", "1 as license")).collect()
    got = sorted((r.doc_id, r.license, r.differences) for r in rows)
    assert got == [(3, "MIT notice", 0), (4, "CC-BY-NC-4.0 notice", 0), (5, "CC-BY-4.0 notice", 0), (6, "MIT", 0), (7, "MIT", 1), (9, "GPL-3.0 notice", 0),
                   (10, "Apache-2.0 notice", 0), (10, "GPL-3.0 notice", 0)]
    changed = next(r for r in rows if r.doc_id == 7)
    assert (changed.missing, changed.added) == (["sublicense"], ["rent"])
    assert license_scan.license_scan(documents(spark, [])).count() == 0


def test_chain_learns_and_handles_missing_labels(spark):
    clean = [f"plain words number{k} about nothing at all" for k in range(60)]
    toxic = [f"plain words number{k} you idiot and scum" for k in range(30)]
    docs = documents(spark, [*clean, *toxic, None, ""]).selectExpr("*", "1 as toxic", "2 as p_toxic")
    labels = spark.createDataFrame([(k, int(k >= 60), 1) for k in range(90) if k % 3] + [(None, 1, 1), (5, None, 0)], "doc_id long, toxic int, quality int")
    got = {r.doc_id: r for r in toxicity_chain.toxicity(docs, labels).collect()}
    assert {d for d, r in got.items() if r.toxic} == set(range(60, 90))
    assert all(got[d].p_insult > 0.5 for d in range(60, 90))
    left = toxicity_chain.without_toxic(docs, labels)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == set(range(60)) | {90, 91}
    assert toxicity_chain.without_toxic(docs, labels.limit(0)).count() == 92
    assert toxicity_chain.toxicity(docs.limit(0), labels).count() == 0


def test_estimate_recovers_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.8
    right = [0.95, 0.9, 0.8, 0.65]
    votes = np.stack([np.where(rng.random(len(truth)) < 0.3, 0, np.where((rng.random(len(truth)) < a) == truth, 1, 2)) for a in right], 1)
    patterns, at, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior, tables, prior = weak_quality.estimate(patterns, counts.astype(float))
    found = [prior * t[0, 1] + (1 - prior) * t[1, 2] for t in tables]
    assert np.allclose(found, right, atol=0.03) and abs(prior - 0.8) < 0.03
    assert ((posterior[at.ravel()] > 0.5) == truth).mean() > 0.9


@pytest.mark.skipif(not HAVE_DATA, reason="tables not present")
def test_weak_scores_agree_with_held_back_labels(spark):
    folder = DATA.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = weak_quality.weak_quality(docs.selectExpr("*", "1 as score")).join(labels, "doc_id").collect()
    good, bad = [r for r in rows if r.quality], [r for r in rows if not r.quality]
    assert sum(r.kept for r in good) > 0.98 * len(good) and sum(not r.kept for r in bad) > 0.85 * len(bad)


def test_weak_scores_of_odd_texts(spark):
    docs = documents(spark, [None, "", "word", "plain words are here. " * 20])
    got = {r.doc_id: r.kept for r in weak_quality.weak_quality(docs).collect()}
    assert got[0] is False and got[1] is False and got[3] is True
    assert weak_quality.weak_quality(docs.limit(0)).count() == 0
