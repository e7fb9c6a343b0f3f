"""Reports derived from the ``documents`` table; the SQL text runs in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

WHITELIST = ["example.com", "bank.example.org"]

_URLS = "".join(f"http://h{n:02d}.example.net/a " for n in range(1, 13))

REPORTS_SQL = f"""
SELECT doc_id AS report_id,
  'Received: from mx.example.net (203.0.113.' || CAST(doc_id % 250 AS STRING) || ') by in.example.com' || chr(10)
  || 'From: "' || CASE WHEN doc_id % 10 = 3 THEN 'ceo@example.com' ELSE 'Sender' END || '" <user@' || dom || '>' || chr(10)
  || 'To: Reporter <r' || CAST(doc_id % 50 AS STRING) || '@example.com>' || chr(10)
  || 'Subject: ' || CASE doc_id % 7 WHEN 0 THEN 'URGENT: verify account' WHEN 1 THEN 'Pago' ELSE 'Note ' || CAST(doc_id AS STRING) END || chr(10)
  || 'Message-ID: <m' || CAST(doc_id AS STRING) || '@' || dom || '>' || chr(10)
  || CASE doc_id % 3 WHEN 1 THEN 'Reply-To: <user@' || dom || '>' || chr(10) WHEN 2 THEN 'Reply-To: <x@reply.example.net>' || chr(10) ELSE '' END
  || 'authentication-results: spf=' || spf || '; dkim=' || dkim || '; dmarc=' || dmarc || chr(10)
  || 'X-MS-Has-Attach: ' || CASE WHEN doc_id % 6 = 0 THEN 'yes' ELSE 'no' END || chr(10)
  || '# Questionable URLs detected in message:' || chr(10)
  || CASE WHEN doc_id % 11 = 0 THEN 'http://bad.example.net/x' ELSE 'None' END || chr(10) || chr(10)
  || substr('{_URLS}', 1, CAST(25 * (doc_id % 13) AS INT))
  || CASE WHEN doc_id % 9 = 0 THEN 'https://bit.ly/x' ELSE '' END || chr(10)
  || text AS content
FROM (SELECT doc_id, text,
  CASE doc_id % 8 WHEN 0 THEN 'example.com' WHEN 1 THEN 'mail.example.com' WHEN 2 THEN 'examp1e.com' WHEN 3 THEN 'offers.example.net'
    WHEN 4 THEN 'xn--bank.example.org' WHEN 5 THEN 'bank.example.org' WHEN 6 THEN 'bamk.example.org' ELSE 'news.test' END AS dom,
  CASE doc_id % 5 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' WHEN 2 THEN 'softfail' WHEN 3 THEN 'none' ELSE 'neutral' END AS spf,
  CASE doc_id % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' WHEN 2 THEN 'none' ELSE 'neutral' END AS dkim,
  CASE doc_id % 3 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' ELSE 'none' END AS dmarc
  FROM documents) d
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for a scan with fewer partitions than cores.

    Only the small test files come as one partition; an input that already fills the cluster is
    left alone, so no shuffle is added there.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(report_id, content) for every document."""
    spread(table(spark, sf_dir, "documents")).createOrReplaceTempView("documents")
    return spark.sql(REPORTS_SQL)
