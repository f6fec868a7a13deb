"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    A local master without the setting (tests) gets a temporary folder; on a
    cluster its absence is an error, as one machine's folder isn't seen by others.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not hasattr(shared_folder, "own"):
        shared_folder.own = "file://" + tempfile.mkdtemp(prefix="pathflow-")
    return shared_folder.own


def drop(spark: SparkSession, *paths: str | None) -> None:
    """Delete files or folders that are not needed any more."""
    for path in filter(None, paths):
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def stored(df: DataFrame, path: str | None = None) -> tuple[DataFrame, str]:
    """``df`` as a Parquet table that is read back, and its path: a lost executor costs a re-read."""
    path = path or f"{shared_folder(df.sparkSession)}/pathflow-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path

