"""Tables in the folder that the cluster shares (spark.checkpoint.dir): they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The shared folder; a temporary one only for a local master that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = own.get() if own.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tracelake-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession) -> str:
    return f"{folder(spark)}/kept-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """The table, written and read back."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Deletes the files of a kept table."""
    files = df.inputFiles()
    if files:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        if at.getName().startswith("kept-"):
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
