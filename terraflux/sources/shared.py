"""The folder that driver and executors share, and tables that are written there once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Only a session that runs in one process gets a
    temporary folder where none is set; on a cluster executors would not see it, so that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = found.get() if found.isDefined() else None
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="terraflux-shared-")
        spark.sparkContext.setCheckpointDir(where)
        where = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return where.rstrip("/")


def filesystem(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and a function that makes its paths."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later passes neither
    recompute it nor depend on the executors that made it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table of a materialised DataFrame that nothing reads any more."""
    path = getattr(df, "written_at", None)
    if path:
        fs, make = filesystem(df.sparkSession, path)
        fs.delete(make(path), True)
