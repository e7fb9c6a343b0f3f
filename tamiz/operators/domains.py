"""Sender-domain lookups: allow-list suffix match, look-alike match, reputation join.

Both domain lookups run on the *distinct* sender domains (map-side combined before the shuffle),
as one equi-join: a suffix key for the allow-list, and for look-alikes the hashes of everything that
is left of a string after deleting at most two characters.  Two strings within edit distance 2 share
such a rest, and strings that share one are close, so few candidates have to be verified: no key
gathers unrelated names, as the top-level domain would.  Entries longer than ``LONG`` are looked up by
their thirds, one of which two edits leave whole, so the work for a name is in proportion to its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import domain_suffixes
from ..session import settle

MAX_DISTANCE = 2
#: Entries longer than this are looked up by their thirds instead of by deletions, whose number grows with the square of the length.
LONG = 30


def _key(kind: str, key: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), key.alias("key"))


def _shortened(text: Column) -> Column:
    """All strings with one character of ``text`` deleted; none for an empty one."""
    n = F.length(text)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(
        F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, n)))
    return F.when(n > 0, cut).otherwise(F.array().cast("array<string>"))


def _near_keys(text: Column) -> Column:
    """Hashes of what is left after deleting at most MAX_DISTANCE characters."""
    rests = [F.array(text)]
    for _ in range(MAX_DISTANCE):
        rests.append(F.array_distinct(F.flatten(F.transform(rests[-1], _shortened))))
    return F.transform(F.array_distinct(F.concat(*rests)), lambda rest: _key("near", F.xxhash64(rest).cast("string")))


def _third(text: Column, n: Column, s: int, shift: Column) -> Column:
    """Key of what ``text`` holds where the third ``s`` of an entry of length ``n`` lies, moved by ``shift``."""
    begin, end = F.floor(n * s / 3).cast("int"), F.floor(n * (s + 1) / 3).cast("int")
    found = F.xxhash64(F.lit(s), n, F.substr(text, begin + shift + 1, end - begin))
    return F.when(begin + shift >= 0, _key("near", F.concat(F.lit("third"), found.cast("string"))))


def _entry_keys(entry: Column) -> Column:
    """Keys of a list entry: what is left after deletions or, of a long one, its three thirds."""
    n = F.length(entry)
    return F.when(n <= LONG, _near_keys(entry)).otherwise(F.array(*[_third(entry, n, s, F.lit(0)) for s in range(3)]))


def _probe_keys(domain: Column) -> Column:
    """Keys a domain shares with every entry within MAX_DISTANCE.

    Two edits leave one third of a long entry as it is, moved by two characters at most. So a long name has 75 keys, however long it
    is; only a short one has a key to each pair of its characters.
    """
    n, around = F.length(domain), range(-MAX_DISTANCE, MAX_DISTANCE + 1)
    thirds = F.array(*[F.when(n + more > LONG, _third(domain, n + more, s, F.lit(shift))) for more in around for s in range(3) for shift in around])
    short = F.when(n <= LONG + MAX_DISTANCE, _near_keys(domain)).otherwise(F.array().cast("array<struct<kind:string,key:string>>"))
    long = F.when(n > LONG - MAX_DISTANCE, F.array_distinct(F.filter(thirds, lambda k: k.isNotNull())))
    return F.concat(short, F.coalesce(long, F.array().cast("array<struct<kind:string,key:string>>")))


def whitelist_index(whitelist: DataFrame) -> DataFrame:
    """(kind, key, entry): one suffix key and the near keys of each allow-list entry."""
    entries = whitelist.select(F.lower(F.col("domain")).alias("entry")).distinct()
    keys = F.concat(F.array(_key("suffix", F.col("entry"))), _entry_keys(F.col("entry")))
    return entries.select("entry", F.inline(keys))


def _domain_keys(longest: int) -> Column:
    """Suffix and near keys of ``from_domain``; none for an empty one. No suffix is longer than the longest entry."""
    domain = F.col("from_domain")
    # What follows the first dot of the last ``longest`` + 1 characters; the whole name if it is no longer than that.
    tail = F.right(domain, F.lit(longest + 1))
    parents = F.when(F.contains(tail, F.lit(".")), domain_suffixes(F.regexp_replace(tail, r"^[^.]*\.", "")))
    suffixes = F.when(F.length(domain) <= longest, domain_suffixes(domain)).otherwise(
        F.filter(F.coalesce(parents, F.array().cast("array<string>")), lambda s: F.contains(s, F.lit("."))))
    # Not a filter: that would be pushed below, and repeat, the parsing of the column.
    return F.when(domain != "", F.concat(F.transform(suffixes, lambda s: _key("suffix", s)), _probe_keys(domain)))


def sender_verdicts(domains: DataFrame, whitelist: DataFrame) -> DataFrame:
    """(from_domain, whitelisted, homograph_of, homograph_distance) for domains that match.

    ``homograph_of`` is the closest entry (ties: alphabetically first) within distance 2 that is
    not the domain itself.
    """
    distinct = domains.select("from_domain").distinct()
    longest = whitelist.agg(F.max(F.length("domain"))).first()[0] or 0
    probes = distinct.select("from_domain", F.inline(_domain_keys(longest)))
    index = whitelist_index(whitelist)
    distance = F.levenshtein(F.col("from_domain"), F.col("entry"), MAX_DISTANCE)
    is_suffix = F.col("kind") == "suffix"
    hits = probes.alias("p").join(
        index.alias("i"),
        (F.col("p.kind") == F.col("i.kind")) & (F.col("p.key") == F.col("i.key"))
        & ((F.col("p.kind") == "suffix")
           | ((F.col("from_domain") != F.col("entry")) & (distance >= 0))),
    ).select("from_domain", "entry", F.col("p.kind").alias("kind"))
    best = F.min(F.when(~is_suffix, F.struct(distance.alias("distance"), F.col("entry"))))
    return hits.groupBy("from_domain").agg(
        F.bool_or(is_suffix).alias("whitelisted"),
        best["entry"].alias("homograph_of"),
        best["distance"].alias("homograph_distance"),
    )


def attach_sender_verdicts(signals: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Add ``whitelisted`` BOOLEAN and ``homograph`` STRING to signal rows.

    The verdict table is written out first, so its true size decides between a broadcast and a
    shuffled join (where hot domains are split by adaptive skew handling).
    """
    verdicts = settle(sender_verdicts(signals.select("from_domain"), whitelist),
                      "sender-verdicts")
    return (
        signals.join(verdicts, "from_domain", "left")
        .withColumn("whitelisted", F.coalesce("whitelisted", F.lit(False)))
        .withColumnRenamed("homograph_of", "homograph")
        .drop("homograph_distance")
    )


def whitelist_match(reports: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Rows whose sender domain, or a parent of it, is on the list."""
    reports = settle(reports, "senders")  # read twice below, parsed once
    hits = sender_verdicts(reports, whitelist).where("whitelisted").select("from_domain")
    return reports.join(hits, "from_domain", "left_semi")


def whitelist_miss(reports: DataFrame, whitelist: DataFrame) -> DataFrame:
    """The complement of ``whitelist_match``."""
    reports = settle(reports, "senders")  # read twice below, parsed once
    hits = sender_verdicts(reports, whitelist).where("whitelisted").select("from_domain")
    return reports.join(hits, "from_domain", "left_anti")


def homograph_match(reports: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Rows whose sender domain imitates an entry, with the entry and its distance."""
    reports = settle(reports, "senders")  # read twice below, parsed once
    hits = sender_verdicts(reports, whitelist).where("homograph_of IS NOT NULL")
    return reports.join(hits.drop("whitelisted"), "from_domain")


def ip_reputation_join(signals: DataFrame, reputation: DataFrame | None) -> DataFrame:
    """Add ``ip_reputation`` STRUCT; unknown senders get score -1 and ``checked`` false."""
    ip = F.col("sender_ip")

    def found(score, country, isp, checked):
        return F.struct(ip.alias("ip"), score.cast("int").alias("abuse_score"),
                        country.alias("country"), isp.alias("isp"), checked.alias("checked"))

    none = F.lit(None).cast("string")
    if reputation is None:
        return signals.withColumn(
            "ip_reputation", found(F.lit(-1), F.lit(""), none, F.lit(False)))
    known = reputation.groupBy(F.col("ip").alias("sender_ip")).agg(
        F.max(F.struct("abuse_score", "country", "isp")).alias("_rep"))
    rep = F.col("_rep")
    return signals.join(known, "sender_ip", "left").withColumn(
        "ip_reputation",
        F.when((ip != "") & rep.isNotNull(), found(
            F.coalesce(rep["abuse_score"], F.lit(0)), F.coalesce(rep["country"], F.lit("")),
            F.coalesce(rep["isp"], F.lit("")), F.lit(True)))
        .otherwise(found(F.lit(-1), F.lit(""), none, F.lit(False))),
    ).drop("_rep")
