"""Manifest, nearest neighbours and spelling variants against plain statements of the same rules."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tamiz.llm import learned_partitions, merkle_veb, trie_pairs


# --- Merkle manifest -----------------------------------------------------------------------

def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        row = levels[-1]
        levels.append([sha("".join(row[k:k + 16])) for k in range(0, len(row), 16)])
    return levels


def others_of(levels, at):
    out = []
    for row in levels[:-1]:
        run = at - at % 16
        out.append((at % 16, row[run:at] + row[at + 1:run + 16]))
        at //= 16
    return out


def plain_audit(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    def leaf(row, text):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))

    by_source = {}
    for row in rows:
        text = row[4]
        if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and text is not None:
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        by_source.setdefault(row[1], []).append((row[0], leaf(row, row[4]), leaf(row, text)))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by_source[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = levels_of([x[1] for x in by_source[s]])
    top = levels_of([trees[s][-1][0] for s in sources])
    out = []
    for at_source, s in enumerate(sources):
        for at, (doc, own, changed) in enumerate(by_source[s]):
            steps = others_of(trees[s], at) + others_of(top, at_source)
            folded = changed
            for k, others in steps:
                folded = sha("".join(others[:k]) + folded + "".join(others[k:]))
            proof = sha("".join(x for _, others in steps for x in others))
            out.append((doc, own, trees[s][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return out


@pytest.mark.parametrize("height", [1, 2, 3, 4, 5])
def test_every_node_has_its_own_place(height):
    for n in (1, 2, 15, 16, 17, 255, 256, 257, 300, 4097):
        if n > 16 ** height:
            continue
        seen = np.concatenate([merkle_veb.places(height, n, level, np.arange(merkle_veb.width(n, level))) for level in range(height)])
        assert sorted(seen) == list(range(merkle_veb.size(height, n)))


def test_subtrees_below_the_half_lie_together():
    # Four levels over 65,536 leaves: the upper two come first, then 256 subtrees of 272 nodes, one after the other.
    for tree in (0, 1, 255):
        leaves = merkle_veb.places(4, 65536, 0, np.arange(tree * 256, tree * 256 + 256))
        parents = merkle_veb.places(4, 65536, 1, np.arange(tree * 16, tree * 16 + 16))
        start = 272 + tree * 272
        assert sorted([*leaves, *parents]) == list(range(start, start + 272))


def odd_documents():
    rows = [(k, f"s{k % 3}", "en", 5, f"Text Number {k}") for k in range(700)]
    rows += [(k, "big", None, None, None if k % 7 == 0 else "ÄB é " * (k % 4)) for k in range(1000, 1300)]
    rows += [(None, "s1", "de", 1, "No Id"), (5, None, "fr", 0, ""), (6, None, None, None, None), (9, "lone", "en", 3, "One")]
    rows += [(20, "s2", "en", 5, "Same Id"), (20, "s2", "en", 5, "Same Id"), (20, "s2", "en", 5, "Other Text")]
    return rows + [(2000 + k, f"host{k:03d}", "en", 1, "X" * k) for k in range(40)] + [(3000, "", "en", 1, "A" * 200_000)]


@pytest.mark.parametrize("height", [1, 2, 3])
def test_audit_equals_the_plain_statement(spark, height):
    rows = odd_documents()
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, text string").selectExpr(
        "*", "1 as key", "2 as pos", "'x' as leaf", "3 as part").repartition(5)
    got = merkle_veb.audit(docs, height)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, plain_audit(rows)))


def test_blocks_hold_each_node_once_and_verify_without_the_documents(spark):
    rows = odd_documents()
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, text string")
    manifest = merkle_veb.build_manifest(docs, height=2)
    stored = manifest.blocks().collect()
    assert all(len(b["layout"]) == 32 * merkle_veb.size(b["height"], b["n"]) for b in stored)
    assert {b["tier"] for b in stored if b["tree"] == "documents"} == {0, 1}
    levels = {b["key"]: b for b in stored if b["tree"] == "documents" and b["total"] <= 256}
    assert bytes(levels["slone"]["root"]).hex() == sha("1:94:lone2:en1:33:One") and levels["slone"]["height"] == 0


def test_manifest_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars int, text string")
    assert merkle_veb.build_manifest(docs).root is None and merkle_veb.audit(docs).count() == 0


# --- spelling variants ---------------------------------------------------------------------

def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def plain_variants(counts, times):
    forms, out = {}, {}
    for w, n in counts.items():
        others = [(-counts[o], o) for o in counts if near(w, o)]
        best = min(others, default=None)
        forms[w] = best[1] if best and -best[0] >= times * n else None
        out[w] = (n, len(others), -best[0] if forms[w] else None)
    rows = []
    for w in counts:
        root = w
        while forms[root]:
            root = forms[root]
        rows.append((w, forms[w], root, *out[w]))
    return sorted(rows, key=str)


def as_rows(df):
    return sorted(((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()), key=str)


def test_variants_equal_brute_force(spark):
    rng = random.Random(3)
    words = {"".join(rng.choice("aabé") for _ in range(rng.randint(1, 7))) for _ in range(400)} | {"aaaaaaa", "aaaaaaaa", "ab", "ba", "÷x", "ÿ"}
    counts = {w: rng.choice([1, 1, 2, 3, 30, 400, 5000]) for w in words}
    df = spark.createDataFrame([(w, n) for w, n in counts.items()], "word string, n long").repartition(7)
    assert as_rows(trie_pairs.spelling_variants(df)) == plain_variants(counts, 10)
    assert as_rows(trie_pairs.spelling_variants(df, times=2)) == plain_variants(counts, 2)


def test_very_long_words_and_one_hot_neighbourhood(spark):
    long = "ab" * 20_000
    counts = {long: 2, long + "c": 300, "x" * 5000: 7}
    counts |= {"hot" + chr(c) + "word": c for c in range(ord("a"), ord("z") + 1)} | {"hotword": 100_000}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r["word"]: r for r in trie_pairs.spelling_variants(df).collect()}
    assert got[long]["form"] == long + "c" and got["x" * 5000]["n_near"] == 0
    assert got["hotword"]["n_near"] == 26 and got["hotaword"]["n_near"] == 26 and got["hotaword"]["root"] == "hotword"


def test_node_numbers_are_equal_where_beginnings_are():
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 6))) for _ in range(200)})
    for cuts in ([10, 11, 12, 60], [1, 2, 3, 4, 5], [100]):
        parts = [p for p in (words[a:b] for a, b in zip([0, *cuts], [*cuts, len(words)])) if p]
        borders = trie_pairs.Borders([(3 * k, p[0], p[-1]) for k, p in enumerate(parts)])
        found = {}
        for k, part in enumerate(parts):
            for word, path in zip(part, trie_pairs.node_paths(borders, iter([(3 * k, w) for w in part]))):
                assert len(path) == len(word) + 1
                for d, node in enumerate(path):
                    found.setdefault(node, set()).add(word[:d])
        assert all(len(x) == 1 for x in found.values())
        assert len(found) == len({w[:d] for w in words for d in range(len(w) + 1)})


def test_words_of_documents(spark):
    texts = ["Straßen straßen STRASSEN überall überall, Überall", None, "", "short words only", "abcdefg " * 40, "a" * 30_000 + " " + "a" * 30_000]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(None, "nobodys nobodys"), (4, "abcdefg " * 40)], "doc_id long, text string").selectExpr(
        "*", "1 as word", "2 as n", "3 as id")
    counts = {}
    for doc, text in [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]:
        run = ""
        for c in (text or "") + " ":
            if ("A" <= c <= "Z") or ("a" <= c <= "z") or ("À" <= c <= "ÿ"):
                run += c.lower() if "A" <= c <= "Z" else c
                continue
            if run:
                h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
                if h % 31 == 0:
                    run = run[:h % len(run)] + run[h % len(run) + 1:]
                if len(run) >= 7:
                    counts[run] = counts.get(run, 0) + 1
            run = ""
    counts = {w: n for w, n in counts.items() if n >= 2}
    assert as_rows(trie_pairs.group_variants(docs)) == plain_variants(counts, 10) and counts
    assert trie_pairs.group_variants(docs.limit(0)).count() == 0


# --- nearest neighbours --------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>"


def brute(rows, queries, k):
    out = {}
    for q, e in queries:
        scored = sorted(((-sum(float(a) * float(b) for a, b in zip(e, f)), i) for i, f in rows if i != q))
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_small_tables_are_exact_with_ties_repeats_and_bad_rows(spark):
    rng = np.random.default_rng(2)
    good = [(k, [float(x) for x in rng.integers(-3, 4, 4)]) for k in range(1, 200)]
    good = [(k, e) for k, e in good if any(e)] + [(k, [1.0, 2.0, 0.0, 1.0]) for k in range(300, 420)]
    bad = [(500, None), (501, []), (502, [0.0] * 4), (503, [1.0, None, 1.0, 1.0]), (504, [float("nan"), 1.0, 1.0, 1.0]),
           (505, [float("inf"), 1.0, 1.0, 1.0]), (506, [1.0, 2.0]), (None, [1.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(good + bad, VECTORS).selectExpr("*", "1 as query", "2 as part", "3 as mark").repartition(3)
    got = {}
    for r in learned_partitions.nearest_neighbours(df, df.where("vec_id % 20 = 0"), nearest=7).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    want = brute(good, [(k, e) for k, e in good if k % 20 == 0], 7)
    assert {q: [f[k] for k in sorted(f)] for q, f in got.items()} == want and all(sorted(f) == list(range(1, 8)) for f in got.values())


def test_repeated_ids_few_rows_and_no_rows(spark):
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [3.0, 0.0]), (1, [1.0, 1.0]), (2, [0.5, 0.0])]
    df = spark.createDataFrame(rows, VECTORS)
    got = sorted(tuple(r) for r in learned_partitions.nearest_neighbours(df, df.where("vec_id = 20")).collect())
    assert got == [(20, 1, 1, 3.0), (20, 2, 2, 0.5)]
    assert learned_partitions.nearest_neighbours(df.limit(0), df.limit(0)).count() == 0
    assert learned_partitions.nearest_neighbours(df, df.limit(0)).count() == 0


def test_recall_with_many_parts(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 16))
    rows = np.concatenate([centres[k % 40] + 0.4 * rng.standard_normal(16) for k in range(6000)]).reshape(-1, 16)
    rows[1000:3000] = rows[1000]  # a third of all rows are one vector
    df = spark.createDataFrame([(k, [float(x) for x in r]) for k, r in enumerate(rows)], VECTORS)
    got = {}
    for r in learned_partitions.nearest_neighbours(df, df.where("vec_id % 20 = 0"), part_rows=128).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    rows = rows.astype(np.float32).astype(float)
    hits = total = 0
    for q in range(0, 6000, 20):
        scores = rows @ rows[q]
        scores[q] = -np.inf
        best = np.lexsort((np.arange(6000), -scores.round(9)))[:20]
        hits, total = hits + len(got[q] & set(best.tolist())), total + 20
        assert len(got[q]) == 20
    assert hits / total >= 0.9


def test_parts_are_balanced_and_cut_few_edges():
    rng = np.random.default_rng(8)
    rows = np.concatenate([rng.standard_normal(8) * 0.2 + 3 * np.eye(8)[k % 8] for k in range(1600)]).reshape(-1, 8)
    graph = learned_partitions.nearest_in(rows, 8)
    label = learned_partitions.balanced_parts(rows, graph, 8)
    assert np.bincount(label, minlength=8).max() <= 220
    assert (label[graph] == label[:, None]).mean() > 0.85
