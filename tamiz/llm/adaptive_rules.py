"""Quality rules whose cut-offs come from mergeable quantile sketches per language and source.

DataFrame functions only. A sketch is a set of rows (group, measure, bucket, n): values below 64 have a bucket
each, larger ones share their top six bits, so a quantile is off by at most one part in 32. Two
sketches merge by adding n, exactly and in any order; that is what the grouped count does from task to task, and
``merge_sketches`` across runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamiz.llm.common import body, spaced_words, table
from tamiz.session import settle

#: measure -> (slack above the upper fence, slack below the lower fence or None); per mille, word length in hundredths.
MEASURES: dict[str, tuple[int, int | None]] = {
    "symbols": (20, None), "capitals": (150, None), "word_length": (200, 200), "dup_lines": (300, None), "repeats": (100, None),
}
_KEYS = ["lang_key", "source_key"]


def _repeat_words(n_words: Column) -> list[dict[str, Column]]:
    """Steps, each a set of columns, that end in n_repeat_words.

    Hashes of eight words come from pairs of pairs of pairs. Only texts with a repeated window are sorted: equal
    neighbours in the order (hash, place) are the repeated windows, and each covers the words up to
    the next repeated one, eight at most.
    """
    def pairs(name: str, step: int) -> Column:
        return F.zip_with(name, F.slice(name, F.lit(step + 1), F.greatest(F.size(name), F.lit(1))), lambda x, y: F.xxhash64(x, y))

    windows = F.slice("_h8", F.lit(1), F.greatest(n_words - 7, F.lit(0)))
    repeated = F.size("_win") > F.size(F.array_distinct("_win"))
    ordered = F.array_sort(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    here = F.col("_ord")
    equal = F.filter(here, lambda e, i: (F.get(here, i - 1)["h"] == e["h"]) | (F.get(here, i + 1)["h"] == e["h"]))
    places = F.array_sort(F.transform("_eq", lambda e: e["i"]))
    gaps = F.zip_with("_at", F.slice("_at", F.lit(2), F.greatest(F.size("_at"), F.lit(1))), lambda x, y: F.least(F.lit(8), y - x))
    return [
        {"_h2": pairs("_h1", 1)}, {"_h4": pairs("_h2", 2)}, {"_h8": pairs("_h4", 4)}, {"_win": windows},
        {"_ord": F.when(repeated, ordered)}, {"_eq": equal}, {"_at": places}, {"_gap": gaps},
        {"n_repeat_words": F.coalesce(F.aggregate("_gap", F.lit(0).cast("long"), lambda a, g: a + g), F.lit(0)).cast("long")},
    ]


def text_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source) and the counts the rules use, one row per row of docs(doc_id, text, lang, source)."""
    lines = F.filter(F.split(F.col("_text"), "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.select("doc_id", "lang", "source", body().alias("_text"))
    df = df.select("*", spaced_words(F.col("_text")).alias("_words"), lines.alias("_lines"))
    df = df.select(
        "doc_id", "lang", "source",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.length(F.regexp_replace("_text", r"\P{Lu}+", "")).cast("long").alias("n_capitals"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_h1"),
    )
    for step in _repeat_words(F.col("n_words").cast("int")):
        df = df.select("*", *[column.alias(name) for name, column in step.items()])
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return df.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), "n_lines", "n_capitals",
    )


def _measured(stats: DataFrame) -> DataFrame:
    def share(part: str, whole: str, scale: int) -> Column:
        return F.when(F.col(whole) > 0, F.expr(f"{scale} * {part} div {whole}")).otherwise(0).cast("long")

    return stats.select(
        "*", F.coalesce(F.concat(F.lit("l"), "lang"), F.lit("")).alias("lang_key"),
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("source_key"),
        share("n_symbols", "word_chars", 1000).alias("symbols"), share("n_capitals", "word_chars", 1000).alias("capitals"),
        share("word_chars", "n_words", 100).alias("word_length"), share("n_dup_lines", "n_lines", 1000).alias("dup_lines"),
        share("n_repeat_words", "n_words", 1000).alias("repeats"),
    )


def bucket(value: Column) -> Column:
    bits = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return (bits * 32 + F.call_function("shiftright", value, bits)).cast("int")


def bucket_top(index: Column) -> Column:
    """The largest value of a bucket."""
    bits = F.greatest(F.floor(index / 32).cast("int") - 1, F.lit(0))
    return (F.call_function("shiftleft", index.cast("long") - 32 * bits + 1, bits) - 1).cast("long")


def sketch(measured: DataFrame) -> DataFrame:
    """(lang_key, source_key, measure, index, n) of the documents that pass the base rules."""
    cells = F.array(*[F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("index")) for m in MEASURES])
    return (
        measured.where("not base_failed").select(*_KEYS, F.explode(cells).alias("c")).select(*_KEYS, "c.*")
        .groupBy(*_KEYS, "measure", "index").agg(F.count("*").alias("n"))
    )


def merge_sketches(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.unionByName(second).groupBy(*_KEYS, "measure", "index").agg(F.sum("n").alias("n"))


def thresholds(sketches: DataFrame) -> DataFrame:
    """(lang_key, source_key, {measure}_high, word_length_low): quartiles and fences three spreads away, plus slack."""
    group = Window.partitionBy(*_KEYS, "measure")
    running = F.sum("n").over(group.orderBy("index").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = sketches.select("*", running.alias("upto"), F.sum("n").over(group).alias("of"), bucket_top(F.col("index")).alias("top"))
    quartile = {q: F.min(F.when(F.col("upto") * 4 >= F.col("of") * q, F.col("top"))) for q in (1, 3)}
    columns = []
    fences = ranked.groupBy(*_KEYS, "measure").agg(quartile[1].alias("q1"), quartile[3].alias("q3"))
    for name, (above, below) in MEASURES.items():
        mine, spread = F.col("measure") == name, 3 * (F.col("q3") - F.col("q1"))
        columns.append(F.max(F.when(mine, F.col("q3") + spread + above)).alias(f"{name}_high"))
        if below is not None:
            columns.append(F.max(F.when(mine, F.col("q1") - spread - below)).alias(f"{name}_low"))
    return fences.groupBy(*_KEYS).agg(*columns)


def adaptive_rules(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text, lang, source) with its counts, fences, base_failed and kept.

    Null and empty texts have no words and fail the base rules. Null language or source is a group of its own. A
    group's fences come from its own documents that pass the base rules; a single document is always
    inside its own. Repeated rows count as often as they occur. Empty table: no rows. Other columns are ignored.
    The counts are written once and read twice: for the sketches and for the join with the fences.
    """
    measured = settle(_measured(text_statistics(docs)), "rules-counts")
    fences = thresholds(sketch(measured))
    inside = ~F.col("base_failed")
    for name, (_, below) in MEASURES.items():
        inside &= F.col(name) <= F.col(f"{name}_high")
        if below is not None:
            inside &= F.col(name) >= F.col(f"{name}_low")
    return measured.join(fences, _KEYS, "left").select(
        *measured.columns, *[c for c in fences.columns if c not in _KEYS],
        F.coalesce(inside, F.lit(False)).alias("kept"),
    ).drop(*_KEYS)


_COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adaptive_rules(table(spark, sf_dir, "documents")).select(*_COLUMNS)


def _fence_sql() -> str:
    parts = []
    for name, (above, below) in MEASURES.items():
        parts.append(f"max(CASE WHEN measure = '{name}' THEN q3 + 3 * (q3 - q1) + {above} END) AS {name}_high")
        if below is not None:
            parts.append(f"max(CASE WHEN measure = '{name}' THEN q1 - 3 * (q3 - q1) - {below} END) AS {name}_low")
    return ", ".join(parts)


SQL = rf"""
WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (SELECT doc_id, i, array_to_string(words[i:i + 7], chr(1)) AS k FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM g) WHERE c > 1),
v AS (SELECT doc_id, sum(least(8, coalesce(after - i, 8))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM r) GROUP BY doc_id),
s AS (
  SELECT w.doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(v.n, 0) AS BIGINT) AS n_repeat_words,
    len(lines) AS n_lines, length(regexp_replace(t, '\P{{Lu}}', '', 'g')) AS n_capitals
  FROM w LEFT JOIN v ON w.doc_id = v.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  CASE WHEN word_chars > 0 THEN 1000 * n_symbols // word_chars ELSE 0 END AS symbols,
  CASE WHEN word_chars > 0 THEN 1000 * n_capitals // word_chars ELSE 0 END AS capitals,
  CASE WHEN n_words > 0 THEN 100 * word_chars // n_words ELSE 0 END AS word_length,
  CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END AS dup_lines,
  CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END AS repeats FROM s),
m AS (SELECT lang, source, measure, CAST(x AS BIGINT) AS x, CAST(greatest(length(bin(CAST(x AS BIGINT))) - 6, 0) AS INT) AS e FROM (
  {" UNION ALL ".join(f"SELECT lang, source, '{name}' AS measure, {name} AS x FROM b WHERE NOT base_failed" for name in MEASURES)})),
c AS (SELECT lang, source, measure, (((x >> e) + 1) << e) - 1 AS top, count(*) AS n FROM m GROUP BY ALL),
u AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, measure ORDER BY top) AS upto, sum(n) OVER (PARTITION BY lang, source, measure) AS total FROM c),
q AS (SELECT lang, source, measure, min(CASE WHEN upto * 4 >= total THEN top END) AS q1, min(CASE WHEN upto * 4 >= total * 3 THEN top END) AS q3 FROM u GROUP BY ALL),
f AS (SELECT lang, source, {_fence_sql()} FROM q GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  coalesce(NOT base_failed AND {" AND ".join(f"{n} <= {n}_high" + (f" AND {n} >= {n}_low" if low is not None else "") for n, (_, low) in MEASURES.items())}, false) AS kept
FROM b LEFT JOIN f ON b.lang IS NOT DISTINCT FROM f.lang AND b.source IS NOT DISTINCT FROM f.source
"""
