"""Usage statistics over the fact table ``cases(ts, classification, source, knn_was_correct)``.

Counters are not maintained, they are read: every summary is one grouped count with map-side
combine over the facts, and everything after it works on a handful of rows.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C


def _pct(part, whole) -> Column:
    return F.coalesce(F.round(F.try_divide(part * 100.0, whole), 1), F.lit(0.0))


def in_period(cases: DataFrame, year: int, month: int | None = None) -> DataFrame:
    """Facts of one year or month, as a range on ``ts`` that reaches the scan."""
    start = datetime(year, month or 1, 1)
    end = (datetime(year + 1, 1, 1) if month in (None, 12)
           else datetime(year, month + 1, 1))
    kind = cases.schema["ts"].dataType.simpleString()
    return cases.where((F.col("ts") >= F.lit(str(start)).cast(kind))
                       & (F.col("ts") < F.lit(str(end)).cast(kind)))


def _measures() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("classification") == c).alias(c) for c in C.LABELS],
        *[F.count_if(F.col("source") == s).alias(s) for s in C.SOURCES],
        F.count_if(F.col("knn_was_correct")).alias("knn_correct"),
        F.count_if(~F.col("knn_was_correct")).alias("knn_incorrect"),
    ]


def _with_shares(counted: DataFrame) -> DataFrame:
    shares = {f"{k}_pct": _pct(F.col(k), F.col("total")) for k in C.LABELS + C.SOURCES}
    shares["knn_accuracy_pct"] = _pct(
        F.col("knn_correct"), F.col("knn_correct") + F.col("knn_incorrect"))
    return counted.withColumns(shares)


def monthly_summary(cases: DataFrame) -> DataFrame:
    """One row per (year, month) with counts, shares and vote accuracy."""
    return _with_shares(cases.groupBy(
        F.year("ts").alias("year"), F.month("ts").alias("month")).agg(*_measures()))


def month_summary(cases: DataFrame, year: int, month: int) -> DataFrame:
    """Exactly one row for the month; zeros when it is empty."""
    counted = in_period(cases, year, month).agg(*_measures())
    return _with_shares(counted.select(
        F.lit(year).alias("year"), F.lit(month).alias("month"), "*"))


def year_summary(cases: DataFrame, year: int) -> DataFrame:
    """One row: the year's totals and ``by_month`` MAP<INT, STRUCT> in month order."""
    names = ["total"] + C.LABELS + C.SOURCES
    months = in_period(cases, year).groupBy(F.month("ts").alias("month")).agg(*_measures())
    rolled = months.agg(
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n)
          for n in names + ["knn_correct", "knn_incorrect"]],
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(
            F.col("month").alias("key"), F.struct(*names).alias("value"))))).alias("by_month"))
    return _with_shares(rolled.select(F.lit(year).alias("year"), "*"))


def year_month_rollup(cases: DataFrame) -> DataFrame:
    """Counts per month, per year and overall (NULL keys mark the totals)."""
    return cases.groupBy(
        F.year("ts").alias("year"), F.month("ts").alias("month"), "classification", "source",
    ).agg(F.count(F.lit(1)).alias("n")).rollup("year", "month").agg(
        F.sum("n").alias("total"),
        *[F.sum(F.when(F.col("classification") == c, F.col("n")).otherwise(0)).alias(c)
          for c in C.LABELS],
        *[F.sum(F.when(F.col("source") == s, F.col("n")).otherwise(0)).alias(s)
          for s in C.SOURCES])


def class_source_breakdown(cases: DataFrame) -> DataFrame:
    """(year, month, kind, key, count, pct) in long form; unknown keys keep their own rows."""
    counted = cases.groupBy(
        F.year("ts").alias("year"), F.month("ts").alias("month"), "classification", "source",
    ).agg(F.count(F.lit(1)).alias("n"))
    pairs = F.array(
        F.struct(F.lit("classification").alias("kind"), F.col("classification").alias("key")),
        F.struct(F.lit("source").alias("kind"), F.col("source").alias("key")))
    long = counted.select("year", "month", F.inline(pairs), "n").groupBy(
        "year", "month", "kind", "key").agg(F.sum("n").alias("count"))
    total = F.sum("count").over(Window.partitionBy("year", "month", "kind"))
    return long.withColumn("pct", _pct(F.col("count"), total))


def knn_accuracy(cases: DataFrame) -> DataFrame:
    """(year, month, correct, incorrect, accuracy_pct); NULL outcomes do not count."""
    judged = cases.where("knn_was_correct IS NOT NULL").groupBy(
        F.year("ts").alias("year"), F.month("ts").alias("month")).agg(
        F.count_if("knn_was_correct").alias("correct"),
        F.count_if(~F.col("knn_was_correct")).alias("incorrect"))
    return judged.withColumn(
        "accuracy_pct", _pct(F.col("correct"), F.col("correct") + F.col("incorrect")))


def monthly_history(cases: DataFrame, year: int, n: int = 6) -> DataFrame:
    """The year's latest ``n`` months, newest first, one column per class and source."""
    months = in_period(cases, year).groupBy(F.month("ts").alias("month")).agg(*_measures())
    return months.select("month", "total", *C.LABELS, *C.SOURCES).orderBy(
        F.desc("month")).limit(n)


def stats_report(cases: DataFrame, year: int, month: int, history: int = 6) -> DataFrame:
    """(section, key, count, pct): year, month, vote accuracy and history in one table.

    The facts are read once: counts per month, class, source and outcome (a few hundred rows)
    are fanned out into the report's cells.
    """
    facts = in_period(cases, year).groupBy(
        F.month("ts").alias("m"), "classification", "source", "knn_was_correct",
    ).agg(F.count(F.lit(1)).alias("n"))

    def cell(section, key, when=None):
        c = F.struct(section.alias("section"), key.alias("key"))
        return c if when is None else F.when(when, c)

    this_month = F.col("m") == month
    judged = this_month & F.col("knn_was_correct").isNotNull()
    name = F.date_format(F.make_date(F.lit(year), F.col("m"), F.lit(1)), "MM")
    cells = F.filter(F.array(
        cell(F.lit("year"), F.lit("total")),
        cell(F.lit("year.classification"), F.col("classification")),
        cell(F.lit("year.source"), F.col("source")),
        cell(F.lit("month"), F.lit("total"), this_month),
        cell(F.lit("month.classification"), F.col("classification"), this_month),
        cell(F.lit("month.source"), F.col("source"), this_month),
        cell(F.lit("knn"), F.when(F.col("knn_was_correct"), "correct").otherwise("incorrect"),
             judged),
        cell(F.concat(F.lit("history."), name), F.lit("total")),
        cell(F.concat(F.lit("history."), name), F.col("classification")),
        cell(F.concat(F.lit("history."), name), F.col("source")),
    ), lambda c: c.isNotNull())
    counted = facts.select("m", F.inline(cells), "n").groupBy("section", "key").agg(
        F.sum("n").alias("count"), F.max("m").alias("m"))
    shown = F.when(
        F.startswith("section", F.lit("history.")),
        F.dense_rank().over(Window.partitionBy(
            F.startswith("section", F.lit("history."))).orderBy(F.desc("m"))) <= history,
    ).otherwise(F.lit(True))
    whole = F.sum("count").over(Window.partitionBy("section"))
    ratio = F.col("section").isin(
        "year.classification", "year.source", "month.classification", "month.source", "knn")
    return counted.withColumn("_shown", shown).where("_shown").select(
        "section", "key", "count",
        F.when(ratio, _pct(F.col("count"), whole)).alias("pct"))


def current_summary(cases: DataFrame, now: datetime | None = None) -> DataFrame:
    """(period, counts and shares) of the current month and year."""
    now = now or datetime.now()
    month = month_summary(cases, now.year, now.month).withColumn("period", F.lit("month"))
    year = year_summary(cases, now.year).drop("by_month").withColumns(
        {"period": F.lit("year"), "month": F.lit(None).cast("int")})
    return month.unionByName(year)


def cases_of(analyses: DataFrame) -> DataFrame:
    """Facts to record for analysed reports (unreported mail is not counted)."""
    return analyses.where("source <> 'unreported'").select(
        F.col("analysis_date").alias("ts"), "classification", "source", "knn_was_correct")
