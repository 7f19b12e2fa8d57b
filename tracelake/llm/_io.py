"""Tables, shared intermediate results and size-checked joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only for a local master without it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_before.isDefined():
        return set_before.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="tracelake-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def materialize(df: DataFrame) -> DataFrame:
    """Write a table into the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete materialized tables that no later plan reads."""
    for df in tables:
        path = df.__dict__.pop("_table_path", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def byte_size(df: DataFrame) -> int:
    """An upper estimate of a table's bytes in memory: fixed columns as 16, others by their lengths."""
    width = F.lit(16)
    for field in df.schema.fields:
        kind, c = field.dataType.typeName(), F.col(f"`{field.name}`")
        if kind in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(c), F.lit(0)) + 16
        elif kind == "array":
            width = width + F.greatest(F.size(c), F.lit(0)) * 64 + 16
        else:
            width = width + 16
    return df.agg(F.coalesce(F.sum(width.cast("long")), F.lit(0))).first()[0]


def join_checked(left: DataFrame, right: DataFrame, on, how: str = "inner", most: int = 24 << 20) -> DataFrame:
    """Broadcast a materialized ``right`` if it has at most ``most`` bytes, else shuffle: the same rows either way."""
    return left.join(F.broadcast(right) if byte_size(right) <= most else right, on, how)
