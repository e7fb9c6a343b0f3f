"""Near duplicates, repeated passages and benchmark leaks against brute force."""

import random
import re
from itertools import combinations

import numpy as np
import pytest

from tamiz.llm import order_minhash, sparse_suffixes, spaced_seeds
from tests.llm.helpers import DATA, HAVE_DATA, classes, documents, plain, shingles, similarity

WORDS = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(1)
    texts = []
    for _ in range(12):
        base = prose(rng, rng.randint(30, 120))
        texts.append(" ".join(base))
        for edits in (0, 1, 2, 5, 25):
            copy = list(base)
            for _ in range(edits):
                at = rng.randrange(len(copy))
                rng.choice([lambda: copy.__setitem__(at, rng.choice(WORDS)), lambda: copy.insert(at, rng.choice(WORDS)), lambda: copy.pop(at)])()
            texts.append(" ".join(copy))
    moved = prose(rng, 60)
    texts += [" ".join(moved), " ".join(moved[30:] + moved[:30]), None, "", "two words", "Two, words", "x", "a b c d e", "a b c d e f"]
    links = [(i, j) for i in range(len(texts)) for j in range(i)
             if similarity(texts[i], texts[j]) >= 0.8 or plain(texts[i]) == plain(texts[j])]
    want = classes(links, range(len(texts)))
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(documents(spark, texts)).collect()}
    assert got == want


def test_alignment_is_order_sensitive_and_counts_occurrences():
    a = order_minhash.labelled(np.arange(1, 41, dtype=np.uint64))
    swapped = order_minhash.labelled(np.r_[np.arange(21, 41), np.arange(1, 21)].astype(np.uint64))
    assert order_minhash.aligned(a, a, 0.8) == (1.0, 1.0)
    assert order_minhash.aligned(a, swapped, 0.5)[0] < 0.5 < order_minhash.aligned(a, swapped, 0.5)[1]
    repeated = order_minhash.labelled(np.full(20, 7, np.uint64))
    assert len(set(repeated.tolist())) == len(repeated) == 16
    assert len(order_minhash.labelled(np.arange(4, dtype=np.uint64))) == 0


@pytest.mark.parametrize("hubs", [0, 1, 3])
def test_members_that_differ_from_the_hub_are_still_linked(spark, monkeypatch, hubs):
    """All texts in one group: every link has to come from the rounds after the first."""
    rng = random.Random(5)
    texts = []
    for _ in range(5):
        base = prose(rng, 80)
        texts += [" ".join(base), " ".join(base[:40] + ["other"] + base[41:])]
    monkeypatch.setattr(order_minhash, "HUBS", hubs)
    monkeypatch.setattr(order_minhash, "SKETCHES", 1)
    rows = order_minhash.sketched(documents(spark, texts)).selectExpr("doc_id", "tid", "size", "array(1L) as keys")
    texts_df = rows.selectExpr("tid", "size", "keys")
    labels = {r.tid: np.array(r.words, np.int64).view(np.uint64) for r in order_minhash._tokens(documents(spark, texts)).collect()}
    known = spark.createDataFrame([(t, order_minhash.labelled(w).tobytes()) for t, w in labels.items()], "tid binary, labels binary")
    roots = order_minhash.near_classes(texts_df, lambda wanted: known.join(wanted, "tid", "left_semi"))
    ids = {bytes(r.tid): r.doc_id for r in rows.collect()}
    got = {}
    for r in roots.collect():
        got.setdefault(bytes(r.root), set()).add(ids[bytes(r.tid)])
    assert sorted(map(sorted, got.values())) == [[i, i + 1] for i in range(0, 10, 2)]


def test_pairs_with_two_equal_sketches_are_linked_in_a_large_group(spark):
    """Far more texts than hubs that are not linked share two sketches and nothing else."""
    rng = random.Random(6)
    texts = []
    for _ in range(35):
        base = prose(rng, 80)
        texts += [" ".join(base), " ".join(base[:40] + ["other"] + base[41:])]
    rows = order_minhash.sketched(documents(spark, texts)).selectExpr(
        "doc_id", "tid", "size", "array(1L, 2L) || transform(sequence(1, 14), j -> xxhash64(doc_id, j)) as keys")
    labels = {r.tid: np.array(r.words, np.int64).view(np.uint64) for r in order_minhash._tokens(documents(spark, texts)).collect()}
    known = spark.createDataFrame([(t, order_minhash.labelled(w).tobytes()) for t, w in labels.items()], "tid binary, labels binary")
    roots = order_minhash.near_classes(rows.selectExpr("tid", "size", "keys"), lambda wanted: known.join(wanted, "tid", "left_semi"))
    ids = {bytes(r.tid): r.doc_id for r in rows.collect()}
    got = {}
    for r in roots.collect():
        got.setdefault(bytes(r.root), set()).add(ids[bytes(r.tid)])
    assert len(texts) > order_minhash.HUBS + 20
    assert sorted(map(sorted, got.values())) == [[i, i + 1] for i in range(0, len(texts), 2)]


def test_a_family_just_below_the_threshold_equals_brute_force(spark, monkeypatch):
    """One group of texts that are all about 0.7 alike, some pairs of them more than 0.8, some by a chain."""
    rng = random.Random(8)
    base = prose(rng, 90)
    texts = []
    for k in range(45):
        words = list(base)
        for at in rng.sample(range(90), 2):
            words[at] = f"own{k}x{at}"
        texts.append(words)
    for k in range(0, 20, 2):
        words = list(texts[k])
        words[rng.randrange(90)] = f"again{k}"
        texts.append(words)
    texts = [" ".join(t) for t in texts]
    links = [(a, b) for a, b in combinations(range(len(texts)), 2) if similarity(texts[a], texts[b]) >= 0.8]
    want = classes(links, range(len(texts)))
    assert 10 < len(set(want.values())) < len(texts) - 9
    monkeypatch.setattr(order_minhash, "sketched", lambda docs, plain=order_minhash.sketched: plain(docs).selectExpr("doc_id", "tid", "size", "array(1L) as keys"))
    assert {r.doc_id: r.class_id for r in order_minhash.near_duplicates(documents(spark, texts)).collect()} == want


def test_a_large_cluster_linked_by_chains_is_not_compared_pair_by_pair(spark, monkeypatch):
    """One group of texts that are about 0.77 alike and become one class by the few pairs of more than 0.8."""
    rng = random.Random(9)
    texts = []
    for k in range(240):
        words = [f"base{i}" for i in range(150)]
        for at in rng.sample(range(5, 145), 2):
            words[at] = f"own{k}x{at}"
        texts.append(words)
    whole = np.array([[hash(tuple(t[i:i + 5])) for i in range(146)] for t in texts])  # equal shingles stand at equal places
    same = (whole[:, None] == whole[None]).sum(axis=2)
    near = same / (2 * 146 - same) >= 0.8
    want = classes([(a, b) for a, b in combinations(range(len(texts)), 2) if near[a, b]], range(len(texts)))
    assert near.mean() < 0.15 and len(set(want.values())) < 10
    compared = []

    def counted(pairs, labels, least, plain=order_minhash._verify):
        out = plain(pairs, labels, least).localCheckpoint()
        compared.append(out.count())
        return out

    monkeypatch.setattr(order_minhash, "_verify", counted)
    monkeypatch.setattr(order_minhash, "MEETINGS", 2, raising=False)
    monkeypatch.setattr(order_minhash, "sketched", lambda docs, plain=order_minhash.sketched: plain(docs).selectExpr("doc_id", "tid", "size", "array(1L) as keys"))
    docs = documents(spark, [" ".join(t) for t in texts])
    assert {r.doc_id: r.class_id for r in order_minhash.near_duplicates(docs).collect()} == want
    assert sum(compared) < 240 * 239 / 2 / 3


def test_a_hub_that_settles_little_is_the_last_one(spark, monkeypatch):
    """Pairs of near texts that share one group only: the hub settles one of them, so the rest is not compared with a second hub."""
    rng = random.Random(6)
    texts = []
    for _ in range(12):
        base = prose(rng, 80)
        texts += [" ".join(base), " ".join(base[:40] + ["other"] + base[41:])]
    compared = []

    def counted(pairs, labels, least, plain=order_minhash._verify):
        pairs = pairs.localCheckpoint()
        compared.append(pairs.count())
        return plain(pairs, labels, least)

    monkeypatch.setattr(order_minhash, "_verify", counted)
    monkeypatch.setattr(order_minhash, "sketched", lambda docs, plain=order_minhash.sketched: plain(docs).selectExpr("doc_id", "tid", "size", "array(1L) as keys"))
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(documents(spark, texts)).collect()}
    assert got == {n: n - n % 2 for n in range(len(texts))}
    assert compared == [23, 11]


def test_one_row_of_each_class_stays(spark):
    texts = ["one two three four five six", "one two three four five six", "another text of some six words", None, ""]
    df = documents(spark, texts).unionByName(documents(spark, texts[:1])).unionByName(documents(spark, ["same id, not the same words here"]))
    df = df.selectExpr("*", "'x' as words", "'y' as root")
    got = order_minhash.deduplicated(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [
        (0, "one two three four five six"), (0, "same id, not the same words here"), (2, "another text of some six words"), (3, None)]
    assert order_minhash.deduplicated(df.limit(0)).count() == 0


def brute_repeats(texts):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    held = {}
    for text, w in zip(texts, words):
        for i in range(len(w) - 49):
            held.setdefault(tuple(w[i:i + 50]), set()).add(text)
    out = {}
    for d, (text, w) in enumerate(zip(texts, words)):
        cover = set()
        for i in range(len(w) - 49):
            if len(held[tuple(w[i:i + 50])]) > 1 or texts.count(text) > 1:
                cover.update(range(i, i + 50))
        if cover:
            out[d] = cover
    return out


def test_repeated_passages_equal_brute_force(spark):
    rng = random.Random(2)
    shared = [prose(rng, n) for n in (49, 50, 51, 90, 300)]
    texts = [None, "", "short", " ".join(["again"] * 200)]
    for k in range(60):
        text = prose(rng, rng.randint(0, 80))
        for passage in rng.sample(shared, rng.randint(0, 2)):
            text += passage + prose(rng, rng.randint(0, 30))
        texts.append((" " if k % 2 else "\n").join(text))
    texts += texts[10:13] + [texts[10]]
    got = {r.doc_id: {p for s in r.spans for p in range(s.begin, s.stop)} for r in sparse_suffixes.repeated_passages(documents(spark, texts)).collect()}
    assert got == brute_repeats(texts)
    assert sparse_suffixes.repeated_passages(documents(spark, texts[:3])).count() == 0
    assert sparse_suffixes.repeated_passages(documents(spark, []).selectExpr("*", "1 as tid")).count() == 0


def spans_of(spark, texts):
    return {r.doc_id: {p for s in r.spans for p in range(s.begin, s.stop)} for r in sparse_suffixes.repeated_passages(documents(spark, texts)).collect()}


def test_suffix_tasks_do_not_change_the_result(spark, monkeypatch):
    rng = random.Random(3)
    passage = prose(rng, 120)
    texts = [" ".join(prose(rng, 20) + passage + prose(rng, 20)) for _ in range(40)]
    want = {d: c for d, c in brute_repeats(texts).items()}
    assert spans_of(spark, texts) == want
    for rows, group in ((7, 10_000), (7, 5), (4000, 1)):
        monkeypatch.setattr(sparse_suffixes, "ROWS", rows)
        monkeypatch.setattr(sparse_suffixes, "GROUP", group)
        assert spans_of(spark, texts) == want


def suffix_rows(texts):
    """Contexts of all minimisers of some texts, sorted by seed and the words to the right."""
    rows, lexicon = [], {}
    for t, text in enumerate(texts):
        words = np.array([lexicon.setdefault(w, len(lexicon) + 1) * 0x9E3779B97F4A7C15 % (1 << 64) for w in text], np.uint64)
        for place, seed, low, high, right, left in sparse_suffixes.contexts(words, sparse_suffixes.minimisers(words)[0]):
            rows += [(int(a.view(np.int64)), tuple(e), tuple(f), t, int(p), int(c), int(d))
                     for p, a, c, d, e, f in zip(place, seed, low, high, right, left)]
    rows.sort()
    seed, right, left, text, place, low, high = (np.array(column) for column in zip(*rows))
    return seed, text, place, low, high, right.astype(np.uint32), left.astype(np.uint32)


def test_neighbours_in_both_orders_bound_what_texts_share():
    rng = random.Random(17)
    passage = prose(rng, 90)
    texts = [prose(rng, 60) + passage[rng.randint(0, 30):rng.randint(60, 90)] + prose(rng, 60) for _ in range(12)]
    seed, text, place, low, high, right, left = suffix_rows(texts)
    first, last, gap = sparse_suffixes.bounds(seed, text, low, high, right, left)
    settled = 0
    for k in range(len(seed)):
        shared = set()
        for d in range(low[k], high[k] + 1):
            own = texts[text[k]][place[k] - d:place[k] - d + 50]
            if any(t != text[k] and any(w[i:i + 50] == own for i in range(len(w) - 49)) for t, w in enumerate(texts)):
                shared.add(d)
        bound = set(range(first[k], last[k] + 1))
        assert shared <= bound and (gap[k] or shared == bound)
        settled += bool(shared) and not gap[k]
    assert settled > 10


def test_left_and_right_of_different_partners(spark):
    """The longest match to the left and that to the right belong to different texts; a third text fills the gap, or none does."""
    rng = random.Random(29)
    texts = []
    for _ in range(15):
        core, before, after = prose(rng, 20), prose(rng, 40), prose(rng, 40)
        texts += [prose(rng, 20) + before[40 - a:] + core + after[:b] + prose(rng, 20) for a, b in ((40, 40), (40, 2), (2, 40), (16, 16), (15, 14), (14, 16))]
    seed, text, place, low, high, right, left = suffix_rows(texts)
    assert sparse_suffixes.bounds(seed, text, low, high, right, left)[2].any()
    texts = [" ".join(t) for t in texts]
    want = brute_repeats(texts)
    assert want and spans_of(spark, texts) == want


def test_passages_before_a_line_that_all_texts_hold_are_found(spark):
    """Pairs share 30 words of their own and then a footer of all texts: nothing to the right tells whose partner is near."""
    rng = random.Random(11)
    footer = prose(rng, 30)
    texts = []
    for _ in range(60):
        own = prose(rng, 30)
        texts += [" ".join(prose(rng, 20) + own + footer + prose(rng, rng.randint(0, 20))) for _ in range(2)]
    want = brute_repeats(texts)
    got = {r.doc_id: {p for s in r.spans for p in range(s.begin, s.stop)} for r in sparse_suffixes.repeated_passages(documents(spark, texts)).collect()}
    assert len(want) == len(texts) and got == want


def test_leaks_with_substitutions_are_found(spark):
    rng = random.Random(4)
    items = [prose(rng, n) for n in (15, 20, 40, 13, 5)]
    tests = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)] + [(9, None), (10, "")], "item_id long, text string")

    def with_passage(words):
        return " ".join(prose(rng, 30) + words + prose(rng, 30))

    changed = [list(items[0]), list(items[1]), list(items[2])]
    changed[0][7] = "changed"
    changed[1][4] = changed[1][14] = "changed"
    for at in (1, 3, 5, 7, 9, 11, 13, 15, 17, 19, 21, 23, 25, 27, 29, 31, 33, 35, 37, 39):
        changed[2][at] = "changed"
    texts = [with_passage(items[0]), with_passage(changed[0]), with_passage(changed[1]), with_passage(changed[2]),
             with_passage(items[2][10:30]), with_passage(items[3]), with_passage(items[4]), with_passage([]), None, "",
             " ".join(items[1]).upper().replace(" ", ", ")]
    docs = documents(spark, texts).selectExpr("*", "1 as item_id", "2 as key")
    got = {(r.doc_id, r.item_id): r.matched for r in spaced_seeds.contaminated(docs, tests.selectExpr("*", "0 as extra")).collect()}
    assert got == {(0, 0): 13, (1, 0): 12, (2, 1): 12, (4, 2): 13, (5, 3): 13, (6, 4): 5, (10, 1): 13}
    left = spaced_seeds.decontaminated(docs, tests)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [3, 7, 8, 9]
    assert spaced_seeds.contaminated(docs.limit(0), tests).count() == 0
    assert spaced_seeds.decontaminated(docs, tests.limit(0)).count() == len(texts)


def test_masks_survive_every_allowed_substitution():
    for n in range(1, 14):
        wrong = spaced_seeds.allowed(n, 80)
        family = spaced_seeds.masks(n, wrong)
        for faults in combinations(range(n), wrong):
            assert any(not {k + o for o in mask} & set(faults) for mask in family for k in range(n - mask[-1])), (n, faults)


def test_leaks_equal_the_rule_without_masks(spark):
    """Every placement of two substitutions in 13 tokens, items of all lengths, and a document of 50,000 words."""
    rng = random.Random(11)
    items = [prose(rng, n) for n in (1, 2, 4, 6, 9, 10, 12, 13, 15, 22)]
    items += [["same"] * 13, []]
    texts = []
    for faults in combinations(range(13), 2):
        words = list(items[7])
        for at in faults:
            words[at] = "changed"
        texts.append(prose(rng, 3) + words + prose(rng, 3))
    for item in items:
        for part in (0.1, 0.2, 0.3):
            texts.append(prose(rng, 5) + [w if rng.random() > part else "changed" for w in item] + prose(rng, 5))
    texts += [["same"] * 40, prose(rng, 25_000) + items[8] + prose(rng, 25_000), [], texts[3]]

    def best(words, item):
        n = min(13, len(item))
        return max((sum(x == y for x, y in zip(words[i:i + n], item[j:j + n]))
                    for i in range(len(words) - n + 1) for j in range(len(item) - n + 1)), default=0)

    long = len(texts) - 3
    want = {(d, i): m for d, words in enumerate(texts) if d != long for i, item in enumerate(items) if item
            for m in [best(words, item)] if m and m * 100 >= 80 * min(13, len(item))}
    tests = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    rows = spaced_seeds.contaminated(documents(spark, [" ".join(t) for t in texts]), tests).collect()
    got = {(r.doc_id, r.item_id): r.matched for r in rows}
    assert len(got) == len(rows) and got[long, 8] == 13
    assert {k: v for k, v in got.items() if k[0] != long} == want and sum(i == 7 for _, i in want) >= 78


@pytest.mark.skipif(not HAVE_DATA, reason="tables not present")
def test_classes_of_the_smallest_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    sets = {r.doc_id: set(shingles(plain(r.text))) for r in rows}
    texts = {r.doc_id: r.text for r in rows}
    near = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    links = [(a, b) for a, b in near if plain(texts[a]) == plain(texts[b]) or similarity(texts[a], texts[b]) >= 0.8]
    want = classes(links, sets)
    assert {r.doc_id: r.class_id for r in order_minhash.near_duplicates(docs).collect()} == want
