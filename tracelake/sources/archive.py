"""Lossless rewriting of binary files as tables of coded blocks, verified before they take a place.

A file is cut into blocks; each block is predicted (16-bit samples minus their predecessor, or bytes as they are) and
deflated by the better way of the two. The new archive is written beside the current one, read back, decoded and held
against the files by length and SHA-256, and only then named as current. Files are read and coded in tasks of their own.
Empty files are skipped by Spark's reader and so have no blocks.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 1 << 20
BLOCKS = "path string, block int, way string, length int, data binary"


class NotIdentical(ValueError):
    """Files whose decoded blocks are not what was read."""


def encode(raw: bytes) -> tuple[str, bytes]:
    """The shorter of deflated bytes and deflated differences of little-endian 16-bit samples (high bytes after low ones)."""
    plain = zlib.compress(raw, 6)
    if len(raw) % 2 or not raw:
        return "bytes", plain
    x = np.frombuffer(raw, "<u2")
    steps = np.diff(x, prepend=x.dtype.type(0)).astype("<u2")
    parts = steps.view(np.uint8).reshape(-1, 2).T
    moved = zlib.compress(parts.tobytes(), 6)
    return ("steps16", moved) if len(moved) < len(plain) else ("bytes", plain)


def decode(way: str, data: bytes) -> bytes:
    raw = zlib.decompress(data)
    if way == "bytes":
        return raw
    steps = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(2, -1).T).view("<u2").ravel()
    return np.cumsum(steps, dtype=np.uint16).astype("<u2").tobytes()


def blocks(files: DataFrame, size: int = BLOCK) -> DataFrame:
    """binaryFile rows (path, content) to coded blocks. ``size`` is even."""

    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                for i, at in enumerate(range(0, max(1, len(content)), size)):
                    part = content[at : at + size]
                    way, data = encode(part)
                    yield pd.DataFrame({"path": [path], "block": [i], "way": [way], "length": [len(part)], "data": [data]})

    return files.select("path", "content").mapInPandas(run, BLOCKS)


def decoded(archive: DataFrame) -> DataFrame:
    """(path, length, sha256, error) of each archived file, from its blocks in order; damage gives a message and no sum."""

    def run(pdf):
        pdf = pdf.sort_values("block")
        total, digest, error = 0, hashlib.sha256(), None
        if pdf["block"].tolist() != list(range(len(pdf))):
            error = "blocks are missing or double"
        for way, length, data in zip(pdf["way"], pdf["length"], pdf["data"], strict=True):
            try:
                raw = decode(way, data)
            except (zlib.error, ValueError) as gone:
                error = str(gone)[:200]
                break
            if len(raw) != length:
                error = "a block of another length"
            digest.update(raw)
            total += len(raw)
        return pd.DataFrame({"path": [pdf["path"].iloc[0]], "length": [total], "sha256": [None if error else digest.hexdigest()], "error": [error]})

    return archive.groupBy("path").applyInPandas(run, "path string, length long, sha256 string, error string")


def differences(archive: DataFrame, files: DataFrame) -> DataFrame:
    """(path, verdict) of all files: identical, damaged, different, missing, unknown (only in the archive)."""
    own = files.select("path", F.col("length").alias("_l"), F.sha2("content", 256).alias("_s"))
    j = decoded(archive).join(own, "path", "full")
    verdict = F.when(F.col("_l").isNull(), "unknown").when(F.col("length").isNull(), "missing").when(F.col("error").isNotNull(), "damaged")
    return j.select("path", verdict.when((F.col("length") == F.col("_l")) & (F.col("sha256") == F.col("_s")), "identical").otherwise("different").alias("verdict"))


def current(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/{spark.read.text(f'{out}/CURRENT').first()[0]}")


def rewrite(spark: SparkSession, source: str, out: str, size: int = BLOCK, pattern: str = "*") -> DataFrame:
    """Archives the files below ``source``; (path, verdict) where all are identical, else NotIdentical and no change of place."""
    from tracelake.sources.commits import swap

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(source)
    name = f"archive-{uuid.uuid4().hex}"
    blocks(files, size).write.parquet(f"{out}/{name}")
    place(spark, out, name, files, swap)
    return differences(current(spark, out), files)


def place(spark: SparkSession, out: str, name: str, files: DataFrame, swap) -> None:
    """Names a written archive as current if every file decodes to what it was; deletes it otherwise."""
    bad = differences(spark.read.parquet(f"{out}/{name}"), files).where("verdict != 'identical'")
    first = [f"{r.path}: {r.verdict}" for r in bad.orderBy("path").limit(5).collect()]
    if first:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/{name}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        raise NotIdentical("; ".join(first))
    swap(spark, f"{out}/CURRENT", name.encode(), overwrite=True)
