"""Personal data, and terms that give it away: information-theoretic sanitisation.

DataFrame functions only. Patterns find e-mail addresses, IP addresses, card and phone numbers in one pass over each text. The values
found are the protected entities, and so are what they share: mail domain, address block, card issuer, dialling prefix, and the
kind itself. Single values hardly ever return, these do, so that their contexts add up. A term that occurs beside an entity discloses
``log2(N * df(e, t) / (df(e) * df(t))) / log2(N / df(e))`` of it, the share of the entity's information content that the
term reveals (document frequencies over N distinct texts). Terms above a threshold are generalised,
those that reveal all of it are removed, wherever they occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.llm.common import body, plain_words, table
from tamiz.session import settle

#: Base kinds in reporting order. The possessive and look-behind forms accept exactly what the plain patterns
#: accept (no class overlaps what follows it) without their backtracking and restarts inside a run.
_PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Texts without such a part hold no match; checked first because it is cheap.
_PART = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?+[0-9]){15}", "phone": r"\+[0-9]"}
_TERM = r"[\p{L}\p{N}]+"
_SPANS = "array<struct<start:int,stop:int,value:string>>"
#: Largest table, in rows, that is sent to every task; a larger one is joined by shuffling.
BROADCAST_ROWS = 200_000


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$")
    if kind == "card":
        return F.length(_digits(value)).between(16, 19) & F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _located(text: Column, pattern: str, keep) -> Column:
    """Code-point spans (end exclusive) of the matches that ``keep`` accepts, in order.

    What lies between the matches and the matches themselves are zipped; one fold adds up their lengths.
    """
    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    none = F.struct(F.lit(0).alias("at"), F.from_json(F.lit("[]"), _SPANS).alias("spans"))

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + F.length(part["gap"])
        stop = start + F.coalesce(F.length(part["hit"]), F.lit(0))
        span = F.struct(start.alias("start"), stop.alias("stop"), part["hit"].alias("value"))
        wanted = part["hit"].isNotNull() & keep(part["hit"])
        return F.struct(
            F.coalesce(stop, state["at"]).alias("at"),
            F.when(wanted, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"),
        )

    return F.aggregate(both, none, step, lambda state: state["spans"])


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds _email, _ip, _card and _phone, arrays of (start, stop, value), to rows of ``docs``."""
    content = body(text)
    empty = F.from_json(F.lit("[]"), _SPANS)
    return docs.select("*", *[
        F.when(content.rlike(_PART[kind]), _located(content, pattern, lambda v, kind=kind: _valid(kind, v))).otherwise(empty)
        .alias(f"_{kind}") for kind, pattern in _PATTERNS.items()
    ])


def _entity(kind: Column, value: Column) -> Column:
    number = F.regexp_replace(value, "[^0-9]+", "")
    return F.concat(kind, F.lit(":"), F.when(kind == "email", F.lower(value)).when(kind == "ip", value).otherwise(number))


def _levels(entity: Column) -> Column:
    """The entity itself and the broader ones it belongs to."""
    kind, value = F.substring_index(entity, ":", 1), F.substring_index(entity, ":", -1)
    broad = (
        F.when(kind == "email", F.concat(F.lit("@"), F.substring_index(value, "@", -1)))
        .when(kind == "ip", F.concat(F.substring_index(value, ".", 3), F.lit(".*")))
        .when(kind == "card", F.concat(F.left(value, F.lit(6)), F.lit("*")))
        .otherwise(F.concat(F.left(value, F.lit(4)), F.lit("*")))
    )
    return F.array(entity, F.concat(kind, F.lit(":"), broad), kind)


def neighbours(found: DataFrame, window: int = 5, reach: int = 80) -> DataFrame:
    """(entity, tid, context, term): the words, at most ``window`` of each side, beside every protected value.

    A value with no word beside it has one row with a null term. context identifies the surrounding words, so that copies of one passage count once.
    """
    def named(kind: str) -> Column:
        return F.transform(f"_{kind}", lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["value"].alias("value")))

    kinds = [named(kind) for kind in _PATTERNS]
    spans = found.where(" or ".join(f"size(_{k}) > 0" for k in _PATTERNS)).select("tid", "_text", F.explode(F.concat(*kinds)).alias("s"))
    begin = F.greatest(F.col("s.start") - reach, F.lit(0))
    before = plain_words(F.substring("_text", begin + 1, F.col("s.start") - begin))
    after = plain_words(F.substring("_text", F.col("s.stop") + 1, F.lit(reach)))
    sides = spans.select("tid", _entity(F.col("s.kind"), F.col("s.value")).alias("entity"), before.alias("b"), after.alias("a"))
    near = sides.select(
        "tid", "entity",
        F.slice("b", -F.least(F.size("b"), F.lit(window)), F.lit(window)).alias("b"), F.slice("a", F.lit(1), F.lit(window)).alias("a"),
        (F.size("b") > 0).alias("some"),
    ).select("tid", "entity", F.when(F.col("some"), F.col("b")).otherwise(F.array().cast("array<string>")).alias("b"), "a")
    terms = F.filter(F.array_distinct(F.concat("b", "a")), lambda w: w.rlike(r"^\p{L}{3,}$"))
    return near.select(
        "entity", "tid", F.xxhash64(F.array_join("b", " "), F.array_join("a", " ")).alias("context"), F.explode_outer(terms).alias("term"),
    ).distinct()


def _bounded(df: DataFrame) -> DataFrame:
    """Marked for broadcast only where its rows are few."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def disclosing_terms(
    found: DataFrame, near: DataFrame, threshold: float, support: int
) -> tuple[DataFrame, DataFrame]:
    """((term, disclosure), (tid, term)): terms that reveal an entity, and the texts that hold them.

    A pair needs ``support`` distinct contexts: with fewer, every rare word beside an entity would seem to reveal it. An entity that all
    texts hold is no information and nothing reveals it.
    """
    near = near.withColumn("entity", F.explode(_levels(F.col("entity"))))
    n = F.lit(float(max(1, found.select("tid").distinct().count())))

    def share(of_term: str) -> Column:
        joint = F.log2(n * F.col("both") / (F.col("of_entity") * F.col(of_term)))
        return F.round(F.try_divide(joint, F.log2(n / F.col("of_entity"))), 9)

    pairs = near.where("term is not null").groupBy("entity", "term").agg(
        F.countDistinct("context").alias("contexts"), F.countDistinct("tid").alias("both")
    ).where(F.col("contexts") >= support)
    held = near.select("entity", "tid").distinct().groupBy("entity").agg(F.count("*").alias("of_entity"))
    # A term is in at least as many texts as it is beside entities, which already rules out most words.
    beside = near.where("term is not null").select("term", "tid").distinct().groupBy("term").agg(F.count("*").alias("beside"))
    pairs = pairs.join(held, "entity").join(beside, "term")
    pairs = settle(pairs.where(share("beside") >= threshold).drop("beside"), "pii-pairs")
    terms = settle(pairs.select("term").distinct(), "pii-terms")
    words = found.select("tid", F.explode(F.array_distinct(plain_words(F.col("_text")))).alias("term"))
    places = settle(words.join(_bounded(terms), "term", "left_semi").distinct(), "pii-places")
    of_term = places.groupBy("term").agg(F.count("*").alias("of_term"))
    scored = pairs.join(of_term, "term").select("term", share("of_term").alias("disclosure"))
    revealing = scored.groupBy("term").agg(F.max("disclosure").alias("disclosure")).where(F.col("disclosure") >= threshold)
    return settle(revealing, "pii-revealing"), places


_OWN = (*(f"_{k}" for k in _PATTERNS), "_terms", "_gone")


def find_disclosures(docs: DataFrame, **options) -> DataFrame:
    """Adds _email, _ip, _card, _phone, _terms (spans) and _gone (removed terms) to rows of docs(text, ...).

    Options are those of ``_marked``. Null text is the empty text. Repeated rows give repeated rows; co-occurrence counts distinct texts.
    A text without matches has empty arrays, an empty table no rows. Other columns pass through, unless they have the name of an
    added one.
    """
    kept = [F.col("_row")[c].alias(c) for c in docs.columns if c.lower() not in _OWN]
    return _marked(docs, **options).select(*kept, *_OWN)


def _marked(docs: DataFrame, threshold: float = 0.9, removal: float = 0.999, support: int = 3) -> DataFrame:
    """(_row, tid, _text and the columns of ``_OWN``): each row of ``docs`` as one struct, so that no column name can clash."""
    found = base_spans(docs.select(F.struct("*").alias("_row"), body().alias("_text"), F.md5(body()).alias("tid")), "_text")
    near = settle(neighbours(found), "pii-near")
    revealing, places = disclosing_terms(found, near, threshold, support)
    here = places.join(_bounded(revealing), "term").groupBy("tid").agg(
        F.sort_array(F.collect_set("term")).alias("_all"),
        F.sort_array(F.collect_set(F.when(F.col("disclosure") >= removal, F.col("term")))).alias("_gone"),
    )
    marked = found.join(_bounded(settle(here, "pii-here")), "tid", "left")
    all_terms = F.col("_all")
    spots = F.when(all_terms.isNotNull(), _located(F.col("_text"), _TERM, lambda v: F.array_contains(all_terms, F.lower(v))))
    marked = marked.withColumn("_terms", spots)
    base = F.concat(*[f"_{k}" for k in _PATTERNS])
    marked = marked.withColumn("_base", base)
    own = F.filter("_terms", lambda t: ~F.exists("_base", lambda b: (b["start"] < t["stop"]) & (t["start"] < b["stop"])))
    return marked.withColumn("_terms", F.coalesce(own, F.from_json(F.lit("[]"), _SPANS))).withColumn(
        "_gone", F.coalesce("_gone", F.array().cast("array<string>"))).drop("_all", "_base")


def _listed(kinds: dict[str, str]) -> Column:
    """kind:start:end of all spans, comma-joined, by kind as listed, then by start."""
    def named(kind: str, column: str) -> Column:
        return F.transform(column, lambda s: F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["stop"].cast("string")))

    return F.array_join(F.concat(*[named(kind, column) for kind, column in kinds.items()]), ",")


def personal_data(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for each row of docs(doc_id, text)."""
    base = {k: f"_{k}" for k in _PATTERNS}
    found = find_disclosures(docs.select("doc_id", "text"), **options)
    return found.select(
        "doc_id", *[F.size(c).cast("long").alias(f"n_{k}") for k, c in base.items()],
        F.sha2(_listed(base), 256).alias("base_sha256"), _listed(base | {"term": "_terms"}).alias("spans"),
    )


def sanitised(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with personal data replaced by its kind, revealing terms by [TERM] and fully revealing ones removed.

    Where spans overlap, the one that begins first is replaced and the rest is cut. n_chars, if there, follows.
    Null text stays null; columns may have any name.
    """
    def labelled(kind: str, label) -> Column:
        return F.transform(f"_{kind}", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), label(s).alias("label")))

    found = _marked(docs, **options)
    parts = [labelled(k, lambda s, k=k: F.lit(f"[{k.upper()}]")) for k in _PATTERNS]
    gone = F.col("_gone")
    parts.append(labelled("terms", lambda s: F.when(F.array_contains(gone, F.lower(s["value"])), F.lit("")).otherwise(F.lit("[TERM]"))))
    found = found.withColumn("_cuts", F.array_sort(F.concat(*parts)))
    text = F.col("_text")

    def step(state: Column, cut: Column) -> Column:
        fresh = cut["start"] >= state["at"]
        added = F.concat(state["out"], F.substring(text, state["at"] + 1, cut["start"] - state["at"]), cut["label"])
        return F.struct(F.greatest(state["at"], cut["stop"]).alias("at"), F.when(fresh, added).otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate("_cuts", start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    found = found.withColumn("_clean", F.when(F.size("_cuts") > 0, clean).otherwise(F.col("_row")["text"]))
    columns = [F.col("_clean").alias("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns]
    if "n_chars" in docs.columns:
        size = F.when(F.size("_cuts") > 0, F.length("_clean")).otherwise(F.col("_row")["n_chars"])
        columns[docs.columns.index("n_chars")] = size.cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return found.select(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
