"""Tables that steps hand to each other, in the folder that all machines of a cluster share.

They are deleted when the JVM ends, or before by `discard` once nothing reads them any more.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, else the context's checkpoint folder. Where neither is set, as in
    tests, a single machine takes a temporary folder of its own; a cluster has none, which is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and (set_ := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        path = set_.get()
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="triplespark-")
        shared_dir.own = path
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _located(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def temporary(spark: SparkSession, path: str) -> None:
    """Have what is at a path, a folder if nothing is there yet, deleted when the JVM ends."""
    fs, found = _located(spark, path)
    fs.mkdirs(found)
    fs.deleteOnExit(found)


def delete(spark: SparkSession, path: str) -> None:
    fs, found = _located(spark, path)
    fs.delete(found, True)


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    temporary(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that `stored` made and nothing will read again."""
    for t in tables:
        delete(t.sparkSession, t.stored_at)
