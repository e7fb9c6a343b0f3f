"""Readers: report files, allow-list, analysis history, quarantine log, file listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.mail import normalize_newlines
from ..functions.text import strip
from ..plans.triage import file_stem
from . import report_source
from .files import reachable

QUARANTINE_SCHEMA = (
    "file string, classification string, quarantine_reasons array<struct<type:string,"
    "severity:string,value:double,threshold:double,risk_score:double,classification:string,"
    "count:int>>, context struct<confidence:double,risk_score:double>, timestamp string")
HISTORY_SCHEMA = ("features map<string,double>, classification string, confidence double, "
                  "risk_score double")


def _plain_path(uri: Column) -> Column:
    """Spark names files by URI; names are wanted as they are on disk (a plus sign is no blank there)."""
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def _as_reports(files: DataFrame) -> DataFrame:
    path = _plain_path(F.col("_metadata.file_path"))
    return files.select(
        file_stem(path).alias("report_id"),
        path.alias("path"),
        F.col("_metadata.file_modification_time").cast("timestamp_ntz").alias("arrived_at"),
        normalize_newlines(F.col("value")).alias("content"),
    )


def _from_source(rows: DataFrame) -> DataFrame:
    path = F.col("path")
    return rows.select(
        file_stem(path).alias("report_id"), path, F.col("arrived_at").cast("timestamp_ntz").alias("arrived_at"),
        normalize_newlines(F.col("content")).alias("content"))


def read_reports(spark: SparkSession, folder: str) -> DataFrame:
    """(report_id, path, arrived_at, content): one row per ``*.txt`` file, empty ones included.

    Listed and read by the tasks of ``report_source``; a store that only Spark opens is read by Spark's text source.
    """
    if reachable(folder):
        report_source.register(spark)
        return _from_source(spark.read.format("tamiz_reports").option("shares", spark.sparkContext.defaultParallelism).load(folder))
    files = spark.read.format("text").option("wholetext", True).option(
        "pathGlobFilter", "*.txt").load(folder)
    return _as_reports(files).unionByName(empty_reports(spark, folder))


def write_reports(reports: DataFrame, folder: str) -> None:
    """Writes rows (name, content) as files ``<name>.txt``, each of which appears whole."""
    report_source.register(reports.sparkSession)
    reports.select("name", "content").write.format("tamiz_reports").mode("append").save(folder)


def empty_reports(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of ``*.txt`` files without a byte, which Spark's file sources skip.

    They come from the folder's listing, names and times only, as Spark's own planning does it.
    """
    glob = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/*.txt")
    found = glob.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(glob) or []
    rows = [(f.getPath().toUri().toString(), f.getModificationTime()) for f in found if f.isFile() and not f.getLen()]
    path = _plain_path(F.col("uri"))
    return spark.createDataFrame(rows, "uri string, at bigint").select(
        file_stem(path).alias("report_id"), path.alias("path"),
        F.timestamp_millis("at").cast("timestamp_ntz").alias("arrived_at"), F.lit("").alias("content"))


def lists_folder(folder: str, max_files: int | None = None, archive: str | None = None) -> bool:
    """Whether ``stream_reports`` must leave the listing to Spark's file source."""
    return bool(max_files or archive) or not reachable(folder)


def stream_reports(spark: SparkSession, folder: str, max_files: int | None = None,
                   archive: str | None = None) -> DataFrame:
    """The same as a stream of new files; the driver lists nothing.

    ``max_files`` (oldest first) and ``archive`` (moves what was read) need Spark's own file source, and so does a store that only Spark
    opens: there the driver lists the folder, and empty files start a batch but have no row in it; the agent adds them.
    """
    if not lists_folder(folder, max_files, archive):
        report_source.register(spark)
        return _from_source(spark.readStream.format("tamiz_reports").option("shares", spark.sparkContext.defaultParallelism).load(folder))
    reader = spark.readStream.format("text").schema("value string").option(
        "wholetext", True).option("pathGlobFilter", "*.txt").option("latestFirst", False)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return _as_reports(reader.load(folder))


def whitelist_entries(lines: DataFrame, column: str = "value") -> DataFrame:
    """(domain): stripped, lower-cased lines without blanks and comments, once each."""
    line = strip(F.col(column))
    return lines.select(line.alias("domain")).where(
        (F.col("domain") != "") & ~F.startswith(F.col("domain"), F.lit("#"))
    ).select(F.lower("domain").alias("domain")).distinct()


def read_whitelist(spark: SparkSession, path: str) -> DataFrame:
    return whitelist_entries(spark.read.text(path))


def usable_history(records: DataFrame) -> DataFrame:
    """Analysis records with features and a class; confidence and risk default to .5 and 50."""
    return records.where("features IS NOT NULL AND classification IS NOT NULL").withColumns({
        "confidence": F.coalesce("confidence", F.lit(0.5)),
        "risk_score": F.coalesce("risk_score", F.lit(50.0)),
    })


def read_analyses(spark: SparkSession, folder: str) -> DataFrame:
    """(features, classification, confidence, risk_score) of a folder tree of JSON files."""
    raw = spark.read.schema(HISTORY_SCHEMA + ", _bad string").option(
        "recursiveFileLookup", True).option("pathGlobFilter", "*.json").option(
        "multiLine", True).option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", "_bad").json(folder)
    return usable_history(raw.where("_bad IS NULL").drop("_bad"))


def parse_quarantine_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Quarantine records of JSON lines: every object, whatever it lacks; other lines are dropped."""
    record = F.from_json(F.col(column), QUARANTINE_SCHEMA + ", _bad string",
                         {"columnNameOfCorruptRecord": "_bad"})
    return lines.where(F.startswith(F.ltrim(column), F.lit("{"))).select(record.alias("r")).where(
        "r IS NOT NULL AND r._bad IS NULL").select("r.*").drop("_bad")


def read_quarantine(spark: SparkSession, path: str) -> DataFrame:
    return parse_quarantine_lines(spark.read.text(path))


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path) of the files in a folder; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(
        folder).select("path")


def new_files(current: DataFrame, seen: DataFrame) -> DataFrame:
    """Paths present now and not seen before."""
    return current.select("path").exceptAll(seen.select("path"))


def still_present(seen: DataFrame, current: DataFrame) -> DataFrame:
    """Seen paths that still exist."""
    return seen.select("path").intersect(current.select("path"))


def existing_inputs(requested: DataFrame, listing: DataFrame) -> DataFrame:
    return requested.join(listing.select("path"), "path", "left_semi")


def missing_inputs(requested: DataFrame, listing: DataFrame) -> DataFrame:
    return requested.join(listing.select("path"), "path", "left_anti")


def ordered_inputs(reports: DataFrame) -> DataFrame:
    """Reports in file-name order."""
    return reports.orderBy("path")


