"""Benchmark decontamination by spaced seeds.

DataFrame functions only. A mask keeps some tokens of a window and ignores the rest, so a passage with substituted words
still shares the seeds on which the masks ignore them. The masks are chosen so that whatever tokens the rule allows to differ, one
mask fits somewhere between them. Seeds of the test items and of the documents are joined by hash; each
hit fixes a diagonal (document place minus item place), on which the tokens are then compared one by one.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.llm.common import body, plain_words, table
from tamiz.session import settle

WINDOW, PERCENT = 13, 80
#: Masks to a window at most, and the longest window and most substitutions for which masks with gaps are searched.
MOST, LONGEST, WRONG = 4, 13, 2
#: Largest table, in rows, that is sent to every task; a larger one is joined by shuffling.
BROADCAST_ROWS = 1_000_000


def allowed(n: int, percent: int) -> int:
    """Tokens of n that may differ."""
    return n - -(-n * percent // 100)


@cache
def masks(n: int, wrong: int) -> tuple[tuple[int, ...], ...]:
    """Token offsets of the masks that find n tokens whichever ``wrong`` of them differ.

    The heaviest masks of which ``MOST`` do, chosen greedily by the substitutions they survive at some place. A window that
    allows more than ``WRONG`` is found by the run of equal tokens it must hold.
    """
    if wrong == 0 or wrong > WRONG or n > LONGEST:
        return (tuple(range(-(-(n - wrong) // (wrong + 1)))),)
    faults = [frozenset(c) for c in combinations(range(n), wrong)]
    for weight in range(n - wrong, 0, -1):
        survived = {}
        for rest in combinations(range(1, n), weight - 1):
            mask = (0, *rest)
            places = [frozenset(k + o for o in mask) for k in range(n - mask[-1])]
            survived[mask] = {f for f in faults if any(not f & place for place in places)}
        left, chosen = set(faults), []
        while left and len(chosen) < MOST:
            chosen.append(max(survived, key=lambda m: (len(survived[m] & left), m)))
            left -= survived[chosen[-1]]
        if not left:
            return tuple(chosen)
    raise ValueError(f"no masks for {wrong} of {n}")


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _seeds(tokens: DataFrame, family: list[tuple[int, ...]]) -> DataFrame:
    """(key, at, seed): every place of every mask that fits in rows (key, tokens)."""
    hashes = tokens.select("key", F.transform("tokens", lambda t: F.xxhash64(t)).alias("h"))
    places = hashes.select("key", "h", F.posexplode("h").alias("at", "_"))
    seeds = F.array(*[
        F.when(F.col("at") + mask[-1] < F.size("h"), F.xxhash64(F.lit(m), *[F.get("h", F.col("at") + o) for o in mask]))
        for m, mask in enumerate(family)
    ])
    return places.select("key", "at", F.explode(seeds).alias("seed")).where("seed is not null")


def seed_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, percent: int = PERCENT) -> DataFrame:
    """Distinct (key, item_key, diagonal) of equal seeds of docs(key, tokens) and items(key, tokens).

    Items shorter than ``window`` have masks of their own length; there are at most ``window`` lengths.
    """
    lengths = items.select(F.least(F.size("tokens"), F.lit(window)).alias("n")).where("n > 0").distinct().collect()
    family = sorted({mask for r in lengths for mask in masks(r.n, allowed(r.n, percent))}) or [(0,)]
    theirs = settle(_seeds(items, family).withColumnsRenamed({"key": "item_key", "at": "item_at"}), "leak-seeds")
    joined = _seeds(docs, family).join(_few(theirs), "seed")
    return joined.select("key", "item_key", (F.col("at") - F.col("item_at")).alias("diagonal")).distinct()


def verified(hits: DataFrame, docs: DataFrame, items: DataFrame, window: int, percent: int) -> DataFrame:
    """(key, item_key, compared, matched): the best ``window`` tokens on any diagonal, if enough of them agree."""
    start = F.greatest(-F.col("diagonal"), F.lit(0))
    n_item = F.size("item_tokens")
    lines = (
        hits.join(items.select(F.col("key").alias("item_key"), F.col("tokens").alias("item_tokens")), "item_key")
        .join(docs, "key").select(
            "key", "item_key", F.least(F.lit(window), n_item).alias("compared"),
            F.slice("tokens", start + F.col("diagonal") + 1, n_item).alias("a"), F.slice("item_tokens", start + 1, n_item).alias("b"),
        )
    )
    same = F.zip_with("a", "b", lambda x, y: F.when(x == y, 1).otherwise(0))
    lines = lines.select("key", "item_key", "compared", F.slice(same, F.lit(1), F.least(F.size("a"), F.size("b"))).alias("same"))
    lines = lines.where(F.size("same") >= F.col("compared"))
    sums = F.transform(
        F.sequence(F.lit(0), F.size("same") - F.col("compared")),
        lambda k: F.aggregate(F.slice("same", k + 1, F.col("compared")), F.lit(0), lambda s, x: s + x),
    )
    best = lines.select("key", "item_key", "compared", F.array_max(sums).alias("matched"))
    return best.where(F.col("matched") * 100 >= F.col("compared") * percent).groupBy("key", "item_key").agg(
        F.max("compared").cast("long").alias("compared"), F.max("matched").cast("long").alias("matched"))


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, percent: int = PERCENT) -> DataFrame:
    """(key, doc_id, item_id, compared, matched) of each distinct document and test item that share a passage.

    docs(doc_id, text) and items(item_id, text) share a passage if ``window`` tokens in a row (or a whole shorter item) of the
    item agree in ``percent`` of 100 places with tokens of the document in a row. Tokens are lower-case runs of letters and
    digits. Nothing else is asked: the masks find every such passage. Null and empty texts hold nothing; very long texts are compared
    whole; repeated rows are reported once; empty tables give no rows; further columns are ignored. key is the text's digest.
    """
    docs = docs.select("doc_id", F.md5(body()).alias("key"), body().alias("text"))
    tokens = docs.select("key", plain_words(F.col("text")).alias("tokens"))
    tests = items.select("item_id", F.md5(body()).alias("item_key"), plain_words(body()).alias("tokens"))
    tests = settle(tests.distinct(), "leak-items")
    by_text = tests.select(F.col("item_key").alias("key"), "tokens").dropDuplicates(["key"])
    hits = _few(settle(seed_hits(tokens, by_text, window, percent), "leak-hits"))
    texts = docs.join(hits.select("key").distinct(), "key", "left_semi").select("key", plain_words(F.col("text")).alias("tokens"))
    found = verified(hits, texts.dropDuplicates(["key"]), by_text, window, percent)
    found = _few(settle(found, "leak-found"))
    ids = docs.select("key", "doc_id").join(found, "key")
    return ids.join(tests.select("item_id", "item_key"), "item_key").select("key", "doc_id", "item_id", "compared", "matched").distinct()


def decontaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose text shares no passage with a test item; all columns, repeated rows included."""
    leaks = settle(contaminated(docs, items, **options).select("key").distinct(), "leak-keys")
    return docs.join(_few(leaks), F.md5(body(docs["text"])) == leaks["key"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")


#: The rule without masks: 13 tokens of which at most two differ hold a run of four equal ones; shorter items a run of as many as
#: ``run`` says. Every pair of equal runs is followed along its diagonal.
_TOKENS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t"
SQL = f"""
WITH d AS (SELECT doc_id, {_TOKENS} FROM documents), b0 AS (SELECT item_id, {_TOKENS} FROM benchmark),
b AS (SELECT *, least({WINDOW}, len(t)) AS n, least({WINDOW}, len(t)) * {100 - PERCENT} // 100 AS wrong FROM b0 WHERE len(t) > 0),
sizes AS (SELECT DISTINCT CAST(ceil((n - wrong) / (wrong + 1)) AS BIGINT) AS run FROM b),
dw AS (SELECT DISTINCT doc_id, run, i, array_to_string(t[i:i + run - 1], ' ') AS words
  FROM (SELECT doc_id, t, run, unnest(range(1, len(t) - run + 2)) AS i FROM d, sizes)),
bw AS (SELECT DISTINCT item_id, run, i, array_to_string(t[i:i + run - 1], ' ') AS words
  FROM (SELECT item_id, t, CAST(ceil((n - wrong) / (wrong + 1)) AS BIGINT) AS run, unnest(range(1, len(t) - CAST(ceil((n - wrong) / (wrong + 1)) AS BIGINT) + 2)) AS i FROM b)),
hits AS (SELECT DISTINCT doc_id, item_id, dw.i - bw.i AS g FROM dw JOIN bw USING (run, words)),
pairs AS (SELECT doc_id, item_id, n AS compared,
  list_transform(range(1 + greatest(0, -g), 1 + least(len(b.t), len(d.t) - g)), lambda p: CASE WHEN b.t[p] = d.t[p + g] THEN 1 ELSE 0 END) AS same
  FROM hits JOIN d USING (doc_id) JOIN b USING (item_id)),
best AS (SELECT doc_id, item_id, compared, list_max(list_transform(range(1, len(same) - compared + 2), lambda k: list_sum(same[k:k + compared - 1]))) AS matched
  FROM pairs WHERE len(same) >= compared)
SELECT doc_id, item_id, CAST(max(compared) AS BIGINT) AS compared, CAST(max(matched) AS BIGINT) AS matched
FROM best WHERE matched * 100 >= compared * {PERCENT} GROUP BY doc_id, item_id
"""
