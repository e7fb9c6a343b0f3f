"""What runs beside triage: model bookkeeping as a stream, table functions, report files and delivered messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.functions.tables import register_table_functions
from tamiz.session import new_path, settle
from tamiz.sources import batch_log, delivery, readers
from tamiz.streaming import models as MB

from . import derived as D
from .closed_form import voted
from .decision_queries import triaged
from .model_queries import _LOG, log
from .registry import query

# --- model bookkeeping as a stream ----------------------------------------------------------

_BOOKS = f"""WITH {_LOG}, a AS (SELECT model, seq, correct, row_number() OVER (PARTITION BY model ORDER BY seq) AS added FROM l),
z AS (SELECT *, added // 10 * 10 AS looked, least(15 + added // 10 * 10, 1000) AS size,
  avg(correct::INT::DOUBLE) OVER (PARTITION BY model ORDER BY seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS accuracy FROM a),
b AS (SELECT model, seq, added, round(accuracy, 6) AS accuracy, least(15 + added, 1000)::BIGINT AS training_size,
  CASE WHEN looked = 0 THEN 0.85 WHEN size < 50 THEN 0.95 WHEN size < 200 THEN 0.85 WHEN size < 500 THEN 0.75 ELSE 0.65 END::DOUBLE AS threshold FROM z)"""


def _books(spark, sf) -> tuple[DataFrame, str]:
    """The feedback log fed in four slices; after each the query is started anew on the same checkpoint."""
    rows = log(spark, sf).select("model", "seq", "correct")
    feed, out, state = (new_path(spark, n) for n in ("feedback", "books", "books-state"))
    ends = rows.agg(F.min("seq"), F.max("seq")).first()
    first, last = (0, 0) if ends[0] is None else (ends[0], ends[1] + 1)
    for k in range(4):
        low, high = (first + (last - first) * x // 4 for x in (k, k + 1))
        rows.where((F.col("seq") >= low) & (F.col("seq") < high)).write.mode("append").parquet(feed)
        stream = spark.readStream.schema(rows.schema).parquet(feed)
        MB.write_books(stream, out, state, availableNow=True).awaitTermination()
    return spark.read.schema(MB.OUTPUT).parquet(out), state


@query("stream_model_books", _BOOKS + " SELECT model, seq, accuracy, training_size, threshold FROM b")
def stream_model_books(spark, sf):
    """Accuracy, size and threshold of each model after each feedback, over four batches and three restarts."""
    return _books(spark, sf)[0].select("model", "seq", F.round("accuracy", 6).alias("accuracy"), "training_size", "threshold")


@query("model_book_state", _BOOKS + """ SELECT model, max(added) AS added, arg_max(threshold, seq) AS threshold, arg_max(accuracy, seq) AS accuracy,
    max(seq) AS last_seq FROM b GROUP BY model""")
def model_book_state(spark, sf):
    """The same models' state, read from the stream's checkpoint."""
    return MB.read_books(spark, _books(spark, sf)[1]).select("model", "added", "threshold", F.round("accuracy", 6).alias("accuracy"), "last_seq")


@query("stream_threshold_changes", _BOOKS + """ SELECT model, seq, training_size, "from", "to" FROM (
    SELECT model, seq, training_size, lag(threshold, 1, 0.85) OVER (PARTITION BY model ORDER BY seq) AS "from", threshold AS "to" FROM b) WHERE "from" <> "to" """)
def stream_threshold_changes(spark, sf):
    """The feedbacks at which a model's threshold changed, as the stream saw them."""
    return _books(spark, sf)[0].where("threshold <> threshold_before").select(
        "model", "seq", "training_size", F.col("threshold_before").alias("from"), F.col("threshold").alias("to"))


# --- table functions ------------------------------------------------------------------------

@query("report_url_rows", r"""SELECT page_id, CAST(position AS INT) AS position, url, lower(regexp_extract(url, '://([^/:?]+)', 1)) AS host FROM (
    SELECT page_id, unnest(range(1, len(l) + 1)) AS position, unnest(l) AS url FROM (
      SELECT page_id, regexp_extract_all(concat_ws(' ', url, html), 'https?://[^\s<>"{}|\\^`\[\]]+') AS l FROM pages))""")
def report_url_rows(spark, sf):
    """Every URL of every page's address and text through the table function."""
    register_table_functions(spark)
    D.table(spark, sf, "pages").createOrReplaceTempView("tamiz_pages")
    return spark.sql("SELECT p.page_id, u.position, u.url, u.host FROM tamiz_pages p, LATERAL report_urls(concat_ws(' ', p.url, p.html)) u")


@query("report_email_domains", r"""SELECT domain, count(*) AS addresses, min(position) AS first_position FROM (
    SELECT unnest(range(1, len(l) + 1))::INT AS position, regexp_extract(lower(unnest(l)), '@([a-z0-9.-]+)', 1) AS domain FROM (
      SELECT regexp_extract_all(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b') AS l FROM documents)) GROUP BY domain""")
def report_email_domains(spark, sf):
    """Addresses per domain over all documents, grouped in the same SQL."""
    register_table_functions(spark)
    D.table(spark, sf, "documents").createOrReplaceTempView("tamiz_documents")
    return spark.sql("SELECT e.domain, count(*) AS addresses, min(e.position) AS first_position FROM tamiz_documents d, LATERAL report_emails(d.text) e GROUP BY e.domain")


# --- report files ---------------------------------------------------------------------------

def report_files_of(spark, sf) -> DataFrame:
    """(report_id, name, content): every derived report, and beside every tenth an empty file; the names hold blanks and more."""
    mails = D.reports(spark, sf)
    empty = mails.where("report_id % 10 = 0").select(
        "report_id", F.format_string("vacío + %d%%20", "report_id").alias("name"), F.lit("").alias("content"))
    return mails.select("report_id", F.format_string("correo nº %d", "report_id").alias("name"), "content").unionByName(empty)


_FILES = f"""SELECT name, CAST(length(content) AS INT) AS chars FROM (
    SELECT 'correo nº ' || report_id AS name, content FROM ({D.REPORTS_SQL})
    UNION ALL SELECT 'vacío + ' || doc_id || '%20', '' FROM documents WHERE doc_id % 10 = 0)"""


@query("report_file_names", _FILES)
def report_file_names(spark, sf):
    """Every file of a folder by the data source, empty ones included."""
    folder = new_path(spark, "ingress")
    readers.write_reports(report_files_of(spark, sf), folder)
    return readers.read_reports(spark, folder).select(F.col("report_id").alias("name"), F.length("content").alias("chars"))


@query("report_file_stream", _FILES)
def report_file_stream(spark, sf):
    """The same as a stream that is stopped and started again while the folder fills; each file comes once."""
    rows, folder, out, state = settle(report_files_of(spark, sf), "mails"), *(new_path(spark, n) for n in ("ingress", "arrived", "arrived-state"))
    for k in range(3):
        readers.write_reports(rows.where(F.pmod("report_id", F.lit(3)) == k), folder)
        stream = readers.stream_reports(spark, folder).select(F.col("report_id").alias("name"), F.length("content").alias("chars"))
        stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).start(out, format="parquet").awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


# --- delivered messages ---------------------------------------------------------------------

@query("delivered_messages", voted("""CAST(i % 2 AS VARCHAR) AS batch, channel, message_id, CASE channel WHEN 'notice' THEN reporter END AS recipient""", "",
    """(SELECT i, message_id, reporter, unnest(CASE WHEN class = 'sospechoso' THEN ['alert', 'case', 'notice'] ELSE ['notice', 'webhook-' || class] END) AS channel FROM tr)"""))
def delivered_messages(spark, sf):
    """Alerts, cases, notices and webhooks of two batches, the first filed twice: each message is there once."""
    done, box = settle(triaged(spark, sf), "decided"), new_path(spark, "outbox")
    for half in (0, 0, 1):
        delivery.deliver(delivery.messages(done.where(F.col("report_id") % 2 == half)), box, half)
    return delivery.delivered(spark, box).select("batch", "channel", "message_id", "recipient")


@query("delivered_payloads", voted("""channel, count(*) AS messages, CAST(sum(final_risk) AS BIGINT) AS risk, min(subject) AS first_subject""", "GROUP BY channel",
    """(SELECT final_risk, subject, unnest(CASE WHEN class = 'sospechoso' THEN ['alert'] ELSE ['webhook-' || class] END) AS channel FROM tr)"""))
def delivered_payloads(spark, sf):
    """What the filed payloads say, read back."""
    done, box = settle(triaged(spark, sf), "decided"), new_path(spark, "outbox")
    delivery.deliver(delivery.messages(done), box, "all")
    rows = delivery.delivered(spark, box).where("channel = 'alert' OR channel LIKE 'webhook-%'")
    subject = F.coalesce(F.get_json_object("payload", "$.original_subject"), F.substring_index(F.get_json_object("payload", "$.alert_title"), "] ", -1))
    return rows.groupBy("channel").agg(
        F.count(F.lit(1)).alias("messages"), F.sum(F.get_json_object("payload", "$.risk_score").cast("long")).alias("risk"), F.min(subject).alias("first_subject"))


@query("delivered_stream", """SELECT event_type AS channel, CAST(event_id AS VARCHAR) AS message_id, 'u' || user_id AS recipient FROM events""")
def delivered_stream(spark, sf):
    """Events filed as messages by a stream that is started three times on one checkpoint."""
    events, feed, box, state = D.table(spark, sf, "events"), *(new_path(spark, n) for n in ("feed", "outbox", "outbox-state"))
    rows = events.select(F.col("event_id").cast("string").alias("message_id"), F.col("event_type").alias("channel"),
                         F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("recipient"), F.col("props").alias("payload"))
    for k in range(3):
        rows.where(F.pmod("message_id", F.lit(3)) == k).write.mode("append").parquet(feed)
        delivery.deliver_stream(spark.readStream.schema(rows.schema).parquet(feed), box, state, availableNow=True).awaitTermination()
    return delivery.delivered(spark, box).select("channel", "message_id", "recipient")


# --- compacted batch folders ----------------------------------------------------------------

@query("compacted_log", """SELECT CAST(event_id % 12 AS BIGINT) AS batch, event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1, 2""")
def compacted_log(spark, sf):
    """Twelve batches, compacted after every fourth while the newest stays open; each row is read once."""
    rows, path, schema = D.table(spark, sf, "events").select("event_id", "event_type"), new_path(spark, "log"), "event_id long, event_type string"
    for batch in range(12):
        rows.where(F.pmod("event_id", F.lit(12)) == batch).write.parquet(f"{path}/batch={batch}")
        if batch % 4 == 3:
            batch_log.compact(spark, path, schema, upto=batch - 1)
    return batch_log.read_log(spark, path, schema).groupBy("batch", "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))
