"""Plain-Python statements of what the corpus operators compute."""

import os
import re

DATA = "/root/testdata/sf0.001"
HAVE_DATA = os.path.isdir(DATA)
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, first=0):
    rows = [(first + i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def plain(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def shingles(words, n=5):
    seen, out = {}, []
    for i in range(len(words) - n + 1):
        key = tuple(words[i:i + n])
        seen[key] = seen.get(key, 0) + 1
        out.append((key, seen[key]))
    return out


def lcs(a, b):
    """Longest common subsequence of two sequences without repeats."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            keep = row[j + 1]
            row[j + 1] = last + 1 if x == y else max(row[j + 1], row[j])
            last = keep
    return row[-1]


def similarity(a, b):
    a, b = shingles(plain(a)), shingles(plain(b))
    same = lcs(a, b)
    return same / (len(a) + len(b) - same) if a and b else 0.0


def classes(links, nodes):
    """Least node of each connected part."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
