"""WARC archives: write, read back, resolve equal payloads to revisit records, rewrite.

Records are written by Spark's text writer (record separator = two line ends, gzip), so the write commits per
task, survives lost executors and needs nothing but the shared folder. Readers split a file by
``Content-Length``, never by searching for separators, because payloads may contain anything.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.llm.common import table, with_small_batches
from tamiz.session import new_path, settle

END = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records to a file. A file is read whole by one task, so this bounds a task's memory.
RECORDS_PER_FILE = 500
_RECORD = (
    "path string, ordinal long, page_id long, url string, record_type string, refers_to long, "
    "claimed string, payload_bytes long, payload_digest string"
)


def payload_digest(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: eight groups of twenty bits, each written as four base-32 digits."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _lines(record_type: str, date: str) -> list[Column]:
    """The header lines common to both record types, from page_id, url and digest."""
    uri = F.regexp_replace("url", r"[\x00-\x20\x7F]", "")
    return [
        F.lit(f"WARC/1.1{END}WARC-Type: {record_type}{END}WARC-Date: {date}{END}WARC-Record-ID: <urn:page:"),
        F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(f">{END}"),
        F.when(uri.isNotNull(), F.concat(F.lit("WARC-Target-URI: "), uri, F.lit(END))).otherwise(""),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit(END),
    ]


def _block(size: Column) -> Column:
    return F.concat(
        F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "),
        size.cast("string"), F.lit(END + END),
    )


def response_records(pages: DataFrame, date: str) -> DataFrame:
    """One response record per row of pages(page_id, url, html)."""
    html = F.coalesce("html", F.lit(""))
    pages = pages.select("page_id", "url", html.alias("html"), payload_digest(html).alias("digest"))
    head = _block(F.octet_length("html"))
    return pages.select(F.concat(
        *_lines("response", date), F.lit(f"Content-Type: application/http;msgtype=response{END}Content-Length: "),
        (F.octet_length(head) + F.octet_length("html")).cast("string"), F.lit(END + END), head, F.col("html"),
    ).alias("value"))


def revisit_records(rows: DataFrame, date: str) -> DataFrame:
    """One revisit record, without payload, per row of (page_id, url, digest, refers_to, refers_url)."""
    head = _block(F.col("payload_bytes"))
    uri = F.regexp_replace("refers_url", r"[\x00-\x20\x7F]", "")
    return rows.select(F.concat(
        *_lines("revisit", date), F.lit(f"WARC-Profile: {PROFILE}{END}WARC-Refers-To: <urn:page:"),
        F.coalesce(F.col("refers_to").cast("string"), F.lit("")), F.lit(f">{END}"),
        F.when(uri.isNotNull(), F.concat(F.lit("WARC-Refers-To-Target-URI: "), uri, F.lit(END))).otherwise(""),
        F.lit(f"Content-Type: application/http;msgtype=response{END}Content-Length: "),
        F.octet_length(head).cast("string"), F.lit(END + END), head,
    ).alias("value"))


def write_archive(records: DataFrame, path: str) -> str:
    (records.write.option("lineSep", END + END).option("compression", "gzip")
     .option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path))
    return path


def _records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of one archive file."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)))
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers = {}
        while line := stream.readline().rstrip(b"\r\n"):
            name, _, value = line.partition(b":")
            headers[name.decode().lower()] = value.strip().decode()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) != size or stream.read(4) != b"\r\n\r\n":
            raise ValueError("truncated WARC record")
        yield headers, block


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").rstrip(">")
    return int(number) if number else None


def _parse(batches: Iterator[pa.RecordBatch], keep_payload: bool) -> Iterator[pa.RecordBatch]:
    """Rows of the records of whole files; of those at ``wanted`` only, where the batch has that column."""
    names = ["path", "ordinal", "page_id", "url", "record_type", "refers_to", "claimed", "payload_bytes", "payload_digest"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    if keep_payload:
        names, kinds = [*names, "payload"], [*kinds, pa.string()]
    for batch in batches:
        chosen = batch["wanted"].to_pylist() if "wanted" in batch.schema.names else [None] * batch.num_rows
        for path, content, wanted in zip(batch["path"], batch["content"], chosen):
            rows = []
            only = None if wanted is None else set(wanted)
            for ordinal, (headers, block) in enumerate(_records(content.as_py())):
                if only is not None and ordinal not in only:
                    continue
                payload = block.partition(b"\r\n\r\n")[2]
                whole = headers["warc-type"] == "response"
                rows.append((
                    path.as_py(), ordinal, _page(headers["warc-record-id"]), headers.get("warc-target-uri"),
                    headers["warc-type"], _page(headers.get("warc-refers-to")),
                    headers["warc-payload-digest"].removeprefix("sha1:"), len(payload) if whole else None,
                    base64.b32encode(hashlib.sha1(payload).digest()).decode() if whole else None,
                    *([payload.decode()] if keep_payload else []),
                ))
            columns = zip(*rows) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)


def read_archive(spark: SparkSession, path: str, payloads: bool = False, wanted: DataFrame | None = None) -> DataFrame:
    """One row per record, in file order (path, ordinal); payload columns are null for revisits.

    ``wanted(path, ordinal)`` restricts the records. Its ordinals, RECORDS_PER_FILE a file at most, go to the files, so that
    compressed files are shuffled at most, and no payloads.
    """
    with_small_batches(spark, 1)  # one file at a time
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    if wanted is not None:
        files = files.join(wanted.groupBy("path").agg(F.collect_list("ordinal").alias("wanted")), "path")
    return files.mapInArrow(lambda b: _parse(b, payloads), _RECORD + (", payload string" if payloads else ""))


def resolve_revisits(heads: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds is_response, refers_to and refers_url to (path, ordinal, page_id, url, payload_digest, payload_bytes).

    Of equal payloads of at least ``min_bytes``, the record with the largest page_id is the response
    (null ids last; ties go to the later file position); smaller payloads are all responses. The shuffle by digest carries one
    pre-aggregated row per digest and task; the join back is one AQE may split for a hot digest.
    """
    heads = heads.drop("refers_to")
    latest = (
        heads.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", "payload_bytes")
        .agg(F.max(F.struct("page_id", "path", "ordinal", "url")).alias("kept"))
    )
    own = (F.col("path") == F.col("kept.path")) & (F.col("ordinal") == F.col("kept.ordinal"))
    response = F.col("kept").isNull() | own
    return heads.join(latest, ["payload_digest", "payload_bytes"], "left").select(
        *heads.columns, response.alias("is_response"),
        F.when(~response, F.col("kept.page_id")).alias("refers_to"),
        F.when(~response, F.col("kept.url")).alias("refers_url"),
    )


def rewrite_deduplicated(spark: SparkSession, source: str, target: str, date: str, min_bytes: int = 0) -> str:
    """Reads the archive at ``source`` and writes it to ``target`` with fresh headers and revisit records."""
    heads = settle(read_archive(spark, source), "warc-heads")
    decided = settle(resolve_revisits(heads, min_bytes), "warc-decided")
    kept = decided.where("is_response").select("path", "ordinal")
    responses = read_archive(spark, source, payloads=True, wanted=kept)
    revisits = decided.where("not is_response").withColumn("digest", F.col("payload_digest"))
    return write_archive(
        response_records(responses.select("page_id", "url", F.col("payload").alias("html")), date)
        .unionByName(revisit_records(revisits, date)),
        target,
    )


def resolved_records(spark: SparkSession, path: str, min_bytes: int = 0) -> DataFrame:
    """Every record of a deduplicated archive with its full payload's size and digest, revisits looked up."""
    records = settle(read_archive(spark, path), "warc-records")
    originals = records.where("record_type = 'response'").where(F.col("payload_bytes") >= min_bytes).select(
        F.col("payload_digest").alias("claimed"), F.col("payload_bytes").alias("there_bytes"),
        F.col("payload_digest").alias("there"),
    )
    revisits = records.where("record_type = 'revisit'").join(originals, "claimed", "left").select(
        "page_id", "url", F.col("there_bytes").alias("payload_bytes"), F.col("there").alias("payload_digest"),
        "record_type", "refers_to",
    )
    return records.where("record_type = 'response'").select(
        "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"
    ).unionByName(revisits)


def warc_revisits(
    pages: DataFrame, date: str = "2020-01-01T00:00:00Z", rewritten: str = "2020-01-02T00:00:00Z", min_bytes: int = 0
) -> DataFrame:
    """Archive ``pages(page_id, url, html)``, deduplicate the archive and read it back.

    Null html is the empty payload, null url leaves the target line out, a null page_id is kept as null and
    never preferred as response. Repeated rows are records of their own. Line ends and control characters are removed from urls.
    An empty table gives an empty archive and no rows. Further columns are ignored.
    """
    spark = pages.sparkSession
    raw = write_archive(response_records(pages, date), new_path(spark, "warc-raw"))
    final = rewrite_deduplicated(spark, raw, new_path(spark, "warc-final"), rewritten, min_bytes)
    return resolved_records(spark, final, min_bytes)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_revisits(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT page_id, payload_bytes, list_aggregate(list_transform(range(0, 32), lambda i: substr(
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(h, 1 + 5 * CAST(i // 4 AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT), 1)), 'string_agg', '') AS payload_digest
  FROM p),
k AS (SELECT payload_digest, max(page_id) AS kept FROM d GROUP BY 1)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = kept THEN NULL ELSE kept END AS refers_to
FROM d JOIN k USING (payload_digest)
"""
