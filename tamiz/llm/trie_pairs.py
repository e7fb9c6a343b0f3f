"""Spelling variants by a dictionary of trie-node pairs.

The nodes of a trie of all words and of one of all reversed words are numbered. A word cut at place i is the pair (node of what is
left, node of what is right): a *split* if nothing is missing between, a *skip* if one letter is. Equal pairs mean equal letters, so
neighbours are found by joining integers, without a comparison of strings:

* two skips with one pair differ by the letter in the gap: a replaced letter;
* a skip with the pair of another word's split lacks that word's missing letter: an inserted or deleted letter. Deleting any
  letter of a run of equal ones gives the same word, so only the first of a run is joined, and every pair of words meets once.

At most one word has a given split and as many have a given skip as there are letters, so the groups are small whatever the corpus.
Nothing is enumerated in pairs: a group tells each member how many others it holds and which of them is the most frequent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.llm.common import body, table
from tamiz.session import settle

#: Code points of a word at least, occurrences at least, and how much more frequent a word's form must be.
LEAST_LETTERS, LEAST_COUNT, TIMES = 7, 2, 10
#: Of the (document, run) pairs, one in so many loses a letter.
NOISE = 31
#: Pairs to an Arrow batch that a task hands back.
ROWS = 50_000
SPLIT, SKIP_FIRST, SKIP_MORE = 0, 1, 2
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Node numbers: the partition above, a count of its nodes or, with the mark, a depth below.
_SHIFT, _MARK = 40, 1 << 62


# --- words ---------------------------------------------------------------------------------

def noisy(run: Column, doc: Column) -> Column:
    """``run`` lower-cased (A-Z only); if NOISE divides the CRC-32 of ``<doc>:<run>``, without the letter it points at."""
    low = F.translate(run, _UPPER, _LOWER)
    crc = F.crc32(F.concat(F.coalesce(doc.cast("string"), F.lit("")), F.lit(":"), low).cast("binary"))
    at = (crc % F.length(low)).cast("int")
    cut = F.concat(F.substr(low, F.lit(1), at), F.substr(low, at + 2))
    return F.when(crc % NOISE == 0, cut).otherwise(low)


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of the words of docs(doc_id, text) that are long and frequent enough."""
    # A shorter run cannot give a word, so the pattern leaves it out.
    runs = F.regexp_extract_all(body(), F.lit(f"[A-Za-zÀ-ÿ]{{{LEAST_LETTERS},}}"), F.lit(0))
    found = docs.select("doc_id", F.explode(runs).alias("run")).select(noisy(F.col("run"), F.col("doc_id")).alias("word"))
    return found.where(F.length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


# --- trie nodes ----------------------------------------------------------------------------

def common(a: str, b: str) -> int:
    """Letters that two words begin with alike."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while n - low > 1:  # the prefixes of length ``low`` are equal, those of length ``n`` are not
        middle = (low + n) // 2
        low, n = (middle, n) if a[low:middle] == b[low:middle] else (low, middle)
    return low


class Borders:
    """Numbers of the nodes that words of several partitions share.

    Words are sorted over the partitions, so what two neighbours share are the beginnings of the one's last and the other's first
    word. Such a node belongs to the first partition that has it and is numbered by that partition and its depth. Holds, to
    each partition, the shared letters only: one entry a partition, whatever the number of words.
    """

    def __init__(self, ends: list[tuple[int, str, str]]):
        self.head: dict[int, tuple[str, list[int]]] = {}
        self.tail: dict[int, str] = {}
        owners: list[int] = []  # of the beginnings, by depth, that the last word so far shares with the next partition
        for k, (part, first, last) in enumerate(ends):
            shared = common(ends[k - 1][2], first) if k else 0
            self.head[part] = (first[:shared], [0] + [self.node(o, d + 1) for d, o in enumerate(owners[:shared])])
            onward = common(last, ends[k + 1][1]) if k + 1 < len(ends) else 0
            self.tail[part] = last[:onward]
            through = min(common(first, last), shared)
            owners = [owners[d] if d < through else part for d in range(onward)]

    @staticmethod
    def node(part: int, depth: int) -> int:
        return _MARK | part << _SHIFT | depth


def node_paths(borders: Borders, words: Iterator[tuple[int, str]]) -> Iterator[list[int]]:
    """To each (partition, word), sorted, the nodes of its beginnings of 0, 1, ... letters. The root is node 0."""
    part, word, path, count = None, "", [0], 0
    for here, now in words:
        if here != part:
            part, count = here, 0
            word, path = borders.head[part][0], list(borders.head[part][1])
            tail, base = borders.tail[part], part << _SHIFT
        same = common(word, now)
        path = path[:same + 1]
        bound = common(tail, now) if tail else 0
        path.extend(borders.node(part, d) for d in range(same + 1, bound + 1))
        fresh = len(now) + 1 - len(path)
        path.extend(range(base + count + 1, base + count + 1 + fresh))
        count, word = count + fresh, now
        yield path


def _sorted_words(words: DataFrame, key: Column, name: str) -> tuple[DataFrame, Borders]:
    """``words`` with a ``key``, dealt out by ranges of it and sorted, and what the ranges share."""
    ranged = settle(words.withColumn("key", key).repartitionByRange("key").withColumn("part", F.spark_partition_id()), name)
    ends = ranged.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last")).orderBy("part").collect()  # a row a partition
    borders = Borders([(r["part"], r["first"], r["last"]) for r in ends])
    return ranged.repartition("part").sortWithinPartitions("part", "key"), borders


def _streamed(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], seen: list[tuple]) -> Iterator[tuple[int, str]]:
    """(part, key) row by row; the row itself is left in ``seen``."""
    for batch in batches:
        rows = [batch[c].to_pylist() for c in columns]
        for k, (part, key) in enumerate(zip(batch["part"].to_pylist(), batch["key"].to_pylist())):
            seen[:] = [tuple(r[k] for r in rows)]
            yield part, key


def with_prefix_nodes(words: DataFrame) -> DataFrame:
    """(id, word, n, nodes): ids ascend with the words; ``nodes`` are those of the forward trie on the word's path."""
    ordered, borders = _sorted_words(words.select("word", "n"), F.col("word"), "trie-forward")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[tuple] = []
        rows, letters, part, nth = [], 0, None, 0
        source = _streamed(batches, ("word", "n", "part"), seen)
        for path in node_paths(borders, source):
            word, n, here = seen[0]
            part, nth = here, 0 if here != part else nth + 1
            rows.append((here << _SHIFT | nth, word, n, path))
            letters += len(path)
            if letters >= ROWS:
                yield _batch(rows, "id", "word", "n", "nodes")
                rows, letters = [], 0
        if rows:
            yield _batch(rows, "id", "word", "n", "nodes")

    return ordered.mapInArrow(number, "id long, word string, n long, nodes array<long>")


_KINDS = {"id": pa.int64(), "word": pa.string(), "n": pa.int64(), "nodes": pa.list_(pa.int64())}


def _batch(rows: list[tuple], *names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, _KINDS[name]) for name, column in zip(names, zip(*rows))], names=list(names))


def node_pairs(words: DataFrame) -> DataFrame:
    """(prefix, suffix, n, id, kind): every split and every skip of words(id, word, n, nodes)."""
    ordered, borders = _sorted_words(words, F.reverse("word"), "trie-backward")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[tuple] = []
        prefix, suffix, kind, counts, owners = [], [], [], [], []

        def flush() -> pa.RecordBatch:
            times = np.array(counts)
            ids, ns = (np.repeat(np.array(x, np.int64), times) for x in zip(*owners))
            out = [pa.array(x, pa.int64()) for x in (prefix, suffix)] + [pa.array(ns), pa.array(ids), pa.array(kind, pa.int8())]
            for x in (prefix, suffix, kind, counts, owners):
                x.clear()
            return pa.RecordBatch.from_arrays(out, names=["prefix", "suffix", "n", "id", "kind"])

        source = _streamed(batches, ("id", "n", "word", "nodes"), seen)
        for ends in node_paths(borders, source):
            number, n, word, starts = seen[0]
            ends.reverse()  # now by place: what is right of it
            prefix += starts
            suffix += ends
            kind += [SPLIT] * len(starts)
            prefix += starts[:-1]
            suffix += ends[1:]
            kind += [SKIP_FIRST if k == 0 or word[k] != word[k - 1] else SKIP_MORE for k in range(len(word))]
            counts.append(2 * len(word) + 1)
            owners.append((number, n))
            ends.reverse()
            if len(prefix) >= ROWS:
                yield flush()
        if counts:
            yield flush()

    return ordered.mapInArrow(cut, "prefix long, suffix long, n long, id long, kind byte")


# --- neighbours ----------------------------------------------------------------------------

def group_neighbours(prefix: np.ndarray, suffix: np.ndarray, n: np.ndarray, ids: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, ...]:
    """(id, near, best n, best id) for rows sorted by prefix, suffix, falling n and id; whole groups only.

    A skip is near the group's other skips and, if it is the first of its run, the split; a split is near those first skips.
    """
    rows = len(prefix)
    fresh = np.ones(rows, bool)
    fresh[1:] = (prefix[1:] != prefix[:-1]) | (suffix[1:] != suffix[:-1])
    lone = fresh & np.append(fresh[1:], True)
    keep = np.flatnonzero(~lone)
    if not len(keep):
        return tuple(np.empty(0, np.int64) for _ in range(4))
    n, ids, kind, fresh = n[keep], ids[keep], kind[keep], fresh[keep]
    starts, group, at, none = np.flatnonzero(fresh), np.cumsum(fresh) - 1, np.arange(len(keep)), len(keep)
    skip, first, split = kind != SPLIT, kind == SKIP_FIRST, kind == SPLIT

    def least(chosen: np.ndarray) -> np.ndarray:  # place of a group's most frequent chosen row
        return np.minimum.reduceat(np.where(chosen, at, none), starts)[group]

    skips, firsts = np.add.reduceat(skip.astype(np.int64), starts)[group], np.add.reduceat(first.astype(np.int64), starts)[group]
    top, top_first, whole = least(skip), least(first), least(split)
    second = least(skip & (at != top))
    joined = first & (whole < none)
    near = np.where(skip, skips - 1 + joined, firsts)
    best = np.where(skip, np.where(at == top, second, top), top_first)
    best = np.where(joined, np.minimum(best, whole), best)
    found = np.flatnonzero(near > 0)
    return ids[found], near[found], n[best[found]], ids[best[found]]


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams sorted pairs; the last group of a batch waits for the next batch."""
    names, held = ["prefix", "suffix", "n", "id", "kind"], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch[c].to_numpy(zero_copy_only=False) for c in names]
        if held is not None:
            columns = [np.concatenate(x) for x in zip(held, columns)]
        open_ = (columns[0] == columns[0][-1]) & (columns[1] == columns[1][-1])
        cut = int(np.argmax(open_))
        held = [c[cut:] for c in columns]
        if cut:
            yield _found(*[c[:cut] for c in columns])
    if held is not None:
        yield _found(*held)


def _found(*columns: np.ndarray) -> pa.RecordBatch:
    out = group_neighbours(*columns)
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["id", "near", "best_n", "best_id"])


def neighbours(pairs: DataFrame) -> DataFrame:
    """(id, n_near, best_n, best_id): how many near words a word has and which of them is the most frequent."""
    dealt = pairs.repartition("prefix", "suffix").sortWithinPartitions("prefix", "suffix", F.desc("n"), "id")
    found = dealt.mapInArrow(_neighbours, "id long, near long, best_n long, best_id long")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best_id").alias("id")))
    return found.groupBy("id").agg(F.sum("near").alias("n_near"), best.alias("best")).select(
        "id", "n_near", (-F.col("best.n")).alias("best_n"), F.col("best.id").alias("best_id"))


def roots(forms: DataFrame) -> DataFrame:
    """(id, root): the end of each chain of forms(id, form).

    Each step follows two links at once; a form is ``TIMES`` as frequent as its word, so chains are short and have no rings.
    """
    state = settle(forms.select("id", F.col("form").alias("root")), "trie-roots")
    while True:
        onward = state.select(F.col("id").alias("root"), F.col("root").alias("next"))
        moved = settle(state.join(onward, "root", "left").select(
            "id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went")), "trie-roots")
        if not moved.where("went").limit(1).count():
            return moved.select("id", "root")
        state = moved.select("id", "root")


def spelling_variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each row of words(word, n), words distinct and not null.

    Two words are near if one inserted, deleted or replaced code point makes the one the other. The form is the near word of largest
    n (ties: the smallest in code-point order) if that is ``times`` the word's n or more, else null; root is where following forms
    ends, the word itself if it has none. Words of any length cost work in proportion to it. An empty table
    gives no rows.
    """
    numbered = settle(with_prefix_nodes(words), "trie-words")
    found = settle(neighbours(node_pairs(numbered)), "trie-near")
    names = numbered.select("id", "word", "n")
    rated = settle(names.join(found, "id", "left").withColumn(
        "form", F.when(F.col("best_n") >= times * F.col("n"), F.col("best_id"))), "trie-forms")
    ends = roots(rated.where("form IS NOT NULL"))
    named = rated.join(ends, "id", "left")
    for column in ("form", "root"):
        named = named.join(names.select(F.col("id").alias(column), F.col("word").alias(f"{column}_word")), column, "left")
    return named.select(
        "word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("form").isNotNull(), F.col("best_n")).alias("form_n"))


def group_variants(docs: DataFrame) -> DataFrame:
    """``spelling_variants`` of the words of docs(doc_id, text).

    Whole texts are read; a null text has no words, a null doc_id counts as the empty text in the noise rule, repeated rows count
    again, other columns are ignored.
    """
    return spelling_variants(settle(vocabulary(docs.select("doc_id", "text")), "trie-vocabulary"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE t AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))) ORDER BY i) AS crc FROM range(256) r(i)),
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
low AS (
  SELECT coalesce(doc_id::VARCHAR, '') || ':' || translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k,
    translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS c FROM runs WHERE length(run) >= 7 GROUP BY 1, 2),
hashed AS (
  SELECT w, c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, 2 * strlen(k), 2), lambda i: ('0x' || substr(hex(encode(k)), i + 1, 2))::BIGINT)),
    lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM low, t),
noisy AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, c FROM hashed),
words AS (SELECT word, sum(c)::BIGINT AS n FROM noisy WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
gaps AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT x.word, y.word AS other, y.n AS m FROM gaps x JOIN gaps y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM gaps x JOIN words y ON x.a || x.b = y.word
  UNION SELECT y.word, x.word, x.n FROM gaps x JOIN words y ON x.a || x.b = y.word),
best AS (SELECT word, count(*) AS n_near, max(m) AS m FROM near GROUP BY word),
forms AS (SELECT b.word, b.m, min(r.other) AS form FROM best b JOIN words w USING (word) JOIN near r ON r.word = b.word AND r.m = b.m WHERE b.m >= 10 * w.n GROUP BY b.word, b.m),
climb AS (SELECT word, form AS root, 1 AS step FROM forms UNION ALL SELECT c.word, f.form, c.step + 1 FROM climb c JOIN forms f ON f.word = c.root),
ends AS (SELECT word, arg_max(root, step) AS root FROM climb GROUP BY word)
SELECT w.word, f.form, coalesce(e.root, w.word) AS root, w.n, coalesce(b.n_near, 0) AS n_near, f.m AS form_n
FROM words w LEFT JOIN best b USING (word) LEFT JOIN forms f USING (word) LEFT JOIN ends e USING (word)
"""
