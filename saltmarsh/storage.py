"""Written intermediates: tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; only where that is unset, as in tests, a local one."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        at = "file://" + tempfile.mkdtemp(prefix="saltmarsh-")
        sc.setCheckpointDir(at)
        at = sc.getCheckpointDir()
    return at.rstrip("/")


def _path(spark: SparkSession, path: str):
    """(Hadoop file system, path)."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in this application's part of the shared folder, which is deleted when the application ends."""
    folder = f"{shared_dir(spark)}/saltmarsh/{spark.sparkContext.applicationId}"
    system, at = _path(spark, folder)
    if not system.exists(at):
        system.mkdirs(at)
        system.deleteOnExit(at)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df as a Parquet table in the shared folder: cuts lineage and survives the loss of any executor."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more; the rest go when the application ends."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            system, at = _path(df.sparkSession, file.rpartition("/")[0])
            if f"/saltmarsh/{df.sparkSession.sparkContext.applicationId}/" in at.toString() + "/":
                system.delete(at, True)
