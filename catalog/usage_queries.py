"""Usage statistics on ``orders`` as facts, streams over ``events``, files and set operations."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.functions.text import url_host
from tamiz.operators import parsing
from tamiz.operators import stats as ST
from tamiz.session import new_path
from tamiz.sources import delivery, readers
from tamiz.streaming import agent
from tamiz.streaming import stats as SS

from . import derived as D
from .closed_form import derived, voted
from .decision_queries import GATE
from .registry import query
from .report_queries import whitelist

YEAR, MONTH = 1997, 5


def cases(spark, sf) -> DataFrame:
    """Facts: status as class, priority as source, an outcome for vote decisions."""
    p = F.substring("o_orderpriority", 1, 1)
    source = F.when(p == "1", "whitelist").when(p.isin("2", "3"), "knn").otherwise("llm")
    return D.table(spark, sf, "orders").select(
        F.col("o_orderdate").alias("ts"),
        F.when(F.col("o_orderstatus") == "O", "legitimo").when(
            F.col("o_orderstatus") == "F", "spam").otherwise("sospechoso").alias(
            "classification"),
        source.alias("source"),
        F.when(source == "knn", F.col("o_totalprice") > 100000).alias("knn_was_correct"))


_CASES = """c AS (SELECT o_orderdate AS ts, CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month,
  CASE o_orderstatus WHEN 'O' THEN 'legitimo' WHEN 'F' THEN 'spam' ELSE 'sospechoso' END AS classification,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'whitelist' WHEN '2' THEN 'knn' WHEN '3' THEN 'knn' ELSE 'llm' END AS source,
  CASE WHEN substr(o_orderpriority, 1, 1) IN ('2', '3') THEN o_totalprice > 100000 END AS ok FROM orders)"""
_KEYS = ["legitimo", "spam", "sospechoso", "whitelist", "knn", "llm"]
_COUNTS = "count(*) AS total, " + ", ".join(
    f"count(*) FILTER (WHERE {'classification' if k in _KEYS[:3] else 'source'} = '{k}') AS {k}"
    for k in _KEYS) + (", count(*) FILTER (WHERE ok) AS knn_correct, "
                       "count(*) FILTER (WHERE NOT ok) AS knn_incorrect")


def _shares(table: str) -> str:
    pct = ", ".join(
        f"coalesce(round({k} * 100.0::DOUBLE / nullif(total, 0), 1), 0) AS {k}_pct" for k in _KEYS)
    return (f"SELECT *, {pct}, coalesce(round(knn_correct * 100.0::DOUBLE / "
            f"nullif(knn_correct + knn_incorrect, 0), 1), 0) AS knn_accuracy_pct FROM {table}")


@query("monthly_summary", f"WITH {_CASES}, m AS (SELECT year, month, {_COUNTS} FROM c GROUP BY 1, 2) " + _shares("m"))
def monthly_summary(spark, sf):
    return ST.monthly_summary(cases(spark, sf))


@query("month_summary", f"WITH {_CASES}, m AS (SELECT {YEAR} AS year, {MONTH} AS month, {_COUNTS} FROM c WHERE year = {YEAR} AND month = {MONTH}) " + _shares("m"))
def month_summary(spark, sf):
    return ST.month_summary(cases(spark, sf), YEAR, MONTH)


@query("empty_month_summary", f"WITH {_CASES}, m AS (SELECT 1890 AS year, 1 AS month, {_COUNTS} FROM c WHERE year = 1890) " + _shares("m"))
def empty_month_summary(spark, sf):
    return ST.month_summary(cases(spark, sf), 1890, 1)


@query("year_summary", f"WITH {_CASES}, m AS (SELECT {YEAR} AS year, {_COUNTS} FROM c WHERE year = {YEAR}) " + _shares("m"))
def year_summary(spark, sf):
    return ST.year_summary(cases(spark, sf), YEAR).drop("by_month")


@query("year_summary_by_month", f"WITH {_CASES} SELECT month, count(*) AS total, count(*) FILTER (WHERE source = 'knn') AS knn FROM c WHERE year = {YEAR} GROUP BY month")
def year_summary_by_month(spark, sf):
    y = ST.year_summary(cases(spark, sf), YEAR)
    return y.select(F.explode("by_month").alias("month", "v")).select("month", "v.total", "v.knn")


@query("year_month_rollup", f"""WITH {_CASES} SELECT coalesce(year, 0) AS year, coalesce(month, 0) AS month, count(*) AS total, """
       + ", ".join(f"count(*) FILTER (WHERE {'classification' if k in _KEYS[:3] else 'source'} = '{k}') AS {k}" for k in _KEYS)
       + " FROM c GROUP BY ROLLUP (year, month)")
def year_month_rollup(spark, sf):
    return ST.year_month_rollup(cases(spark, sf)).na.fill(0, ["year", "month"])


@query("class_source_breakdown", f"""WITH {_CASES}, l AS (
    SELECT year, month, 'classification' AS kind, classification AS key, count(*) AS count FROM c GROUP BY 1, 2, 4
    UNION ALL SELECT year, month, 'source', source, count(*) FROM c GROUP BY 1, 2, 4)
    SELECT *, round(count * 100.0::DOUBLE / sum(count) OVER (PARTITION BY year, month, kind), 1) AS pct FROM l""")
def class_source_breakdown(spark, sf):
    return ST.class_source_breakdown(cases(spark, sf))


@query("knn_accuracy", f"""WITH {_CASES} SELECT year, month, count(*) FILTER (WHERE ok) AS correct,
    count(*) FILTER (WHERE NOT ok) AS incorrect,
    round(count(*) FILTER (WHERE ok) * 100.0::DOUBLE / count(*), 1) AS accuracy_pct FROM c WHERE ok IS NOT NULL GROUP BY 1, 2""")
def knn_accuracy(spark, sf):
    return ST.knn_accuracy(cases(spark, sf))


@query("monthly_history", f"WITH {_CASES}, m AS (SELECT month, {_COUNTS} FROM c WHERE year = {YEAR} GROUP BY month) "
       f"SELECT month, total, {', '.join(_KEYS)} FROM m ORDER BY month DESC LIMIT 6")
def monthly_history(spark, sf):
    return ST.monthly_history(cases(spark, sf), YEAR)


@query("stats_report", f"""WITH {_CASES}, y AS (SELECT * FROM c WHERE year = {YEAR}), m AS (SELECT * FROM y WHERE month = {MONTH}),
    h AS (SELECT * FROM y WHERE month IN (SELECT month FROM y GROUP BY month ORDER BY month DESC LIMIT 6)),
    r AS (SELECT 'year' AS section, 'total' AS key, count(*) AS count FROM y
      UNION ALL SELECT 'year.classification', classification, count(*) FROM y GROUP BY 2
      UNION ALL SELECT 'year.source', source, count(*) FROM y GROUP BY 2
      UNION ALL SELECT 'month', 'total', count(*) FROM m
      UNION ALL SELECT 'month.classification', classification, count(*) FROM m GROUP BY 2
      UNION ALL SELECT 'month.source', source, count(*) FROM m GROUP BY 2
      UNION ALL SELECT 'knn', CASE WHEN ok THEN 'correct' ELSE 'incorrect' END, count(*) FROM m WHERE ok IS NOT NULL GROUP BY 2
      UNION ALL SELECT 'history.' || lpad(CAST(month AS VARCHAR), 2, '0'), 'total', count(*) FROM h GROUP BY 1
      UNION ALL SELECT 'history.' || lpad(CAST(month AS VARCHAR), 2, '0'), classification, count(*) FROM h GROUP BY 1, 2
      UNION ALL SELECT 'history.' || lpad(CAST(month AS VARCHAR), 2, '0'), source, count(*) FROM h GROUP BY 1, 2)
    SELECT section, key, count, coalesce(CASE WHEN section LIKE '%.classification' OR section LIKE '%.source' OR section = 'knn'
      THEN round(count * 100.0::DOUBLE / sum(count) OVER (PARTITION BY section), 1) END, -1) AS pct FROM r""")
def stats_report(spark, sf):
    return ST.stats_report(cases(spark, sf), YEAR, MONTH).withColumn(
        "pct", F.coalesce("pct", F.lit(-1.0)))


@query("current_summary", f"""WITH {_CASES}, m AS (
    SELECT 'month' AS period, {YEAR} AS year, {MONTH} AS month, {_COUNTS} FROM c WHERE year = {YEAR} AND month = {MONTH}
    UNION ALL SELECT 'year', {YEAR}, 0, {_COUNTS} FROM c WHERE year = {YEAR}) """ + _shares("m"))
def current_summary(spark, sf):
    """As it would read on a day of that month."""
    return ST.current_summary(cases(spark, sf), datetime(YEAR, MONTH, 20)).na.fill(0, ["month"])


# --- streams -------------------------------------------------------------------------------

def event_cases(spark, sf) -> DataFrame:
    events = D.table(spark, sf, "events")
    stream = spark.readStream.schema(events.schema).option(
        "pathGlobFilter", "events.parquet").parquet(sf)
    return stream.select(
        "ts", F.when(F.col("event_type") == "view", "legitimo").when(
            F.col("event_type").isin("click", "signup"), "spam").otherwise(
            "sospechoso").alias("classification"),
        F.when(F.col("user_id") % 2 == 0, "knn").otherwise("llm").alias("source"),
        (F.col("value") > 10).alias("knn_was_correct"))


def _daily(spark, sf) -> DataFrame:
    out = new_path(spark, "stream")
    SS.write_daily_counts(event_cases(spark, sf), out, new_path(spark, "stream-state"), availableNow=True).awaitTermination()
    return SS.read_daily_counts(spark, out)


_EVENT_CASES = """e AS (SELECT ts, CASE event_type WHEN 'view' THEN 'legitimo' WHEN 'click' THEN 'spam' WHEN 'signup' THEN 'spam' ELSE 'sospechoso' END AS classification,
  CASE WHEN user_id % 2 = 0 THEN 'knn' ELSE 'llm' END AS source, value > 10 AS ok FROM events)"""


@query("stream_usage_counts", f"""WITH {_EVENT_CASES} SELECT strftime(ts, '%Y-%m-%d') AS day, classification, source, count(*) AS n,
    count(*) FILTER (WHERE ok) AS knn_correct, count(*) FILTER (WHERE NOT ok) AS knn_incorrect FROM e GROUP BY 1, 2, 3""")
def stream_usage_counts(spark, sf):
    return _daily(spark, sf).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("stream_monthly_totals", f"""WITH {_EVENT_CASES} SELECT CAST(year(ts) AS INT) AS year, CAST(month(ts) AS INT) AS month, count(*) AS total,
    count(*) FILTER (WHERE classification = 'legitimo') AS legitimo, count(*) FILTER (WHERE classification = 'spam') AS spam,
    count(*) FILTER (WHERE classification = 'sospechoso') AS sospechoso, CAST(0 AS BIGINT) AS whitelist,
    count(*) FILTER (WHERE source = 'knn') AS knn, count(*) FILTER (WHERE source = 'llm') AS llm FROM e GROUP BY 1, 2""")
def stream_monthly_totals(spark, sf):
    return SS.monthly(_daily(spark, sf))


def _appended(stream: DataFrame, spark) -> DataFrame:
    """Everything an append-mode stream gives for the files that are there now."""
    out = new_path(spark, "stream")
    stream.writeStream.outputMode("append").option("checkpointLocation", new_path(spark, "stream-state")).trigger(
        availableNow=True).start(out, format="parquet").awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _event_stream(spark, sf) -> DataFrame:
    events = D.table(spark, sf, "events")
    return spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf)


@query("stream_window_counts", """WITH w AS (SELECT date_trunc('hour', ts) AS h, event_type, count(*) AS n FROM events GROUP BY 1, 2),
    m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM events)
    SELECT strftime(h, '%Y-%m-%d %H:%M') AS window_start, event_type, n FROM w, m WHERE h + INTERVAL 1 HOUR <= mark""")
def stream_window_counts(spark, sf):
    """The windows the watermark has closed."""
    closed = _appended(SS.stream_window_counts(_event_stream(spark, sf), ["event_type"]), spark)
    return closed.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm"))


@query("stream_deduplicated", "SELECT DISTINCT CAST(user_id AS BIGINT) AS report_id FROM events")
def stream_deduplicated(spark, sf):
    """Each id once; the whole table is one batch, inside one watermark."""
    reports = _event_stream(spark, sf).select(F.col("user_id").alias("report_id"), F.col("ts").alias("arrived_at"))
    return _appended(SS.deduplicated(reports), spark).select("report_id")


def report_folder(spark, sf) -> str:
    """The derived reports as files, one per mail, the way they arrive; beside every tenth an empty one."""
    folder = new_path(spark, "ingress")
    mails = D.reports(spark, sf)
    empty = mails.where("report_id % 10 = 0").select(F.format_string("vacío %d", "report_id").alias("name"), F.lit("").alias("content"))
    readers.write_reports(mails.select(F.format_string("correo %d", "report_id").alias("name"), "content").unionByName(empty), folder)
    return folder


@query("report_files", derived("i AS report_id, CAST(length(subject) AS INT) AS subject_chars, spf, nurl AS url_count, ip AS sender_ip"))
def report_files(spark, sf):
    """Signals of the mails that were read from files; empty files have none."""
    read = readers.read_reports(spark, report_folder(spark, sf)).where("content <> ''").withColumn(
        "report_id", F.regexp_extract("path", r"correo (\d+)\.txt", 1).cast("long"))
    return parsing.extract_signals(parsing.parse_reports(read)).select(
        "report_id", F.length("subject_raw").alias("subject_chars"), "indicators.spf",
        "url_count", "sender_ip")


def run_agent(spark, sf) -> agent.AgentPaths:
    root = new_path(spark, "agent")
    whitelist(spark).write.text(f"{root}/whitelist")
    paths = agent.AgentPaths(report_folder(spark, sf), root, f"{root}/whitelist")
    agent.start_agent(spark, paths, available_now=True).awaitTermination()
    return paths


@query("stream_agent", voted("class AS classification, source, count(*) AS n, CAST(sum(final_risk) AS BIGINT) AS risk", """GROUP BY 1, 2
    UNION ALL SELECT 'spam', 'unreported', count(*), 0 FROM documents WHERE doc_id % 10 = 0"""))
def stream_agent(spark, sf):
    """Report files through the streaming agent, empty ones among them; its stored analyses."""
    paths = run_agent(spark, sf)
    return spark.read.parquet(paths.table("analyses")).groupBy("classification", "source").agg(
        F.count(F.lit(1)).alias("n"), F.sum("risk_score").cast("long").alias("risk"))


@query("stream_agent_tables", voted("""(SELECT count(*) FROM tr) AS cases, (SELECT count(*) FROM g WHERE action = 'QUARANTINE') AS quarantine,
    (SELECT count(*) FROM g WHERE action <> 'QUARANTINE') AS training,
    (SELECT count(*) FROM tr WHERE class = 'sospechoso') AS alerts, (SELECT count(*) FROM tr) AS notices,
    (SELECT count(*) FROM tr WHERE class <> 'sospechoso') AS webhooks,
    (SELECT count(*) FROM tr WHERE source = 'llm' AND vclass <> class) AS feedback""", "", "(SELECT 1)", GATE))
def stream_agent_tables(spark, sf):
    """Row counts of everything else the agent wrote."""
    paths = run_agent(spark, sf)
    sent = delivery.delivered(spark, paths.table("outbox")).select(F.split("channel", "-")[0].alias("t"))
    stacked = sent
    for n in ("cases", "quarantine", "training", "feedback"):
        stacked = stacked.unionByName(spark.read.parquet(paths.table(n)).select(F.lit(n).alias("t")))
    return stacked.agg(*[F.count_if(F.col("t") == n).alias(n) for n in ("cases", "quarantine", "training", "feedback")],
                       *[F.count_if(F.col("t") == n).alias(f"{n}s") for n in ("alert", "notice", "webhook")])


# --- lists, logs and sets ------------------------------------------------------------------

@query("whitelist_entries", """SELECT DISTINCT lower(regexp_extract(url, '://([^/:?]+)', 1)) AS domain FROM pages""")
def whitelist_entries(spark, sf):
    """Page hosts written the untidy way people write lists: case, blanks, comments, repeats."""
    host = url_host(F.col("url"))
    lines = D.table(spark, sf, "pages").select(F.explode(F.array(
        F.concat(F.lit("  "), F.upper(host), F.lit("\t")), F.concat(F.lit("# "), host),
        F.lit(""), host)).alias("value"))
    return readers.whitelist_entries(lines)


@query("quarantine_lines", """SELECT CAST(doc_id AS VARCHAR) AS file, CASE WHEN n_chars > 400 THEN 'spam' ELSE 'sospechoso' END AS classification,
    CASE WHEN n_chars > 400 THEN 'RISK_MISALIGNED' ELSE 'LOW_CONFIDENCE,RISK_MISALIGNED' END AS reasons FROM documents WHERE lang <> 'fr'""")
def quarantine_lines(spark, sf):
    """JSON lines, a quarter of them cut off in the middle."""
    def reason(kind):
        return F.struct(F.lit(kind).alias("type"), F.lit("ERROR").alias("severity"))

    long = F.col("n_chars") > 400
    record = F.to_json(F.struct(
        F.col("doc_id").cast("string").alias("file"),
        F.when(long, "spam").otherwise("sospechoso").alias("classification"),
        F.when(long, F.array(reason("RISK_MISALIGNED"))).otherwise(
            F.array(reason("LOW_CONFIDENCE"), reason("RISK_MISALIGNED"))
        ).alias("quarantine_reasons")))
    lines = D.table(spark, sf, "documents").select(
        F.when(F.col("lang") == "fr", F.substring(record, 1, 20)).otherwise(record).alias("value"))
    return readers.parse_quarantine_lines(lines).select(
        "file", "classification",
        F.array_join(F.transform("quarantine_reasons", lambda r: r["type"]), ",").alias("reasons"))


def _paths(spark, sf, where=None):
    pages = D.table(spark, sf, "pages")
    return (pages.where(where) if where else pages).select(F.col("url").alias("path"))


@query("new_files", "SELECT url AS path FROM pages EXCEPT ALL SELECT url FROM pages WHERE url LIKE 'https%'")
def new_files(spark, sf):
    return readers.new_files(_paths(spark, sf), _paths(spark, sf, "url LIKE 'https%'"))


@query("still_present", "SELECT url AS path FROM pages WHERE url LIKE '%example.com%' INTERSECT SELECT url FROM pages WHERE url LIKE 'https%'")
def still_present(spark, sf):
    return readers.still_present(_paths(spark, sf, "url LIKE '%example.com%'"),
                                 _paths(spark, sf, "url LIKE 'https%'"))


@query("existing_inputs", "SELECT url AS path FROM pages WHERE url IN (SELECT url FROM pages WHERE url LIKE 'https%')")
def existing_inputs(spark, sf):
    return readers.existing_inputs(_paths(spark, sf), _paths(spark, sf, "url LIKE 'https%'"))


@query("missing_inputs", "SELECT url AS path FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE url LIKE 'https%')")
def missing_inputs(spark, sf):
    return readers.missing_inputs(_paths(spark, sf), _paths(spark, sf, "url LIKE 'https%'"))


@query("distinct_urls", "SELECT DISTINCT url FROM pages")
def distinct_urls(spark, sf):
    return D.table(spark, sf, "pages").select("url").distinct()


@query("ordered_inputs", "SELECT url AS path, page_id FROM pages ORDER BY url")
def ordered_inputs(spark, sf):
    return readers.ordered_inputs(D.table(spark, sf, "pages").select(
        F.col("url").alias("path"), "page_id"))
