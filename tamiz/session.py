"""Session settings the operators rely on, and the shared folder for intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Set the SQL options that results depend on (header maps keep the last duplicate)."""
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def bounded_batches(spark: SparkSession, size: int = 8 << 20) -> SparkSession:
    """Limit what a Python worker is sent at once by bytes, for columns of whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``.

    Without one, a single-process master (``local``, ``local[n]``) uses a folder below ``/tmp``;
    any other master is refused, because its executors would not see each other's files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"/tmp/tamiz-{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def session_dir(spark: SparkSession) -> str:
    """Where this application keeps its intermediate tables; ``release`` deletes it."""
    return f"{shared_dir(spark)}/tamiz/{spark.conf.get('spark.app.id')}"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder of this application below the shared one."""
    return f"{session_dir(spark)}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; results that read them must be written before."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(session_dir(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts lineage in a way that survives lost executors, and the file size then tells the
    planner whether the table is small enough to broadcast; no hint is given. The files belong
    to the application: ``release`` deletes them, also those a lost driver would leave behind.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
