"""Metadata of recordings as numbered versions: a write names the version it started from, and only one can follow it.

A version is a file ``v<number>.json`` below a recording's folder. It is written under a name of its own and renamed
without overwriting, so that of two writers that start from the same version one gets a Conflict; readers see whole
versions only. Updates merge deeply into what they read and try again after a conflict.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Seconds after which a claim without a version is its dead writer's.
STALE_S = 120


class Conflict(RuntimeError):
    """Another writer's version came first."""


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _claimed(spark: SparkSession, fs, at) -> bool:
    """Creates an empty file, unless it is there: one caller alone gets True."""
    if fs.getUri().getScheme() == "file":  # Hadoop's local create looks first and writes then
        return spark._jvm.java.io.File(at.toUri().getPath()).createNewFile()
    try:
        fs.create(at, False).close()
    except Py4JJavaError as gone:
        if fs.exists(at):
            return False
        raise gone
    return True


def swap(spark: SparkSession, path: str, content: bytes, overwrite: bool = False) -> None:
    """A file that appears whole: written beside its place, renamed into it. Without ``overwrite`` an existing one is a Conflict."""
    fs, at = _at(spark, path)
    temp = spark._jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{at.getName()}-{uuid.uuid4().hex}")
    fs.mkdirs(at.getParent())
    out = fs.create(temp, False)
    out.write(bytearray(content))
    out.close()
    kind = spark._jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE if overwrite else kind.NONE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration())
    claim = spark._jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{at.getName()}.claim")
    if not overwrite and not _claimed(spark, fs, claim):
        fs.delete(temp, False)
        if not fs.exists(at) and fs.exists(claim) and time.time() - fs.getFileStatus(claim).getModificationTime() / 1000 > STALE_S:
            fs.delete(claim, False)  # its writer died before the rename
        raise Conflict(path)
    context.rename(fs.makeQualified(temp), fs.makeQualified(at), how)


def latest(spark: SparkSession, folder: str) -> tuple[int, dict]:
    """Number and content of the last whole version; (0, {}) without one."""
    fs, at = _at(spark, folder)
    if not fs.exists(at):
        return 0, {}
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    numbers = [int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json") and n[1:-5].isdigit()]
    if not numbers:
        return 0, {}
    text = spark.read.option("wholetext", True).text(f"{folder}/v{max(numbers)}.json").first()[0]
    return max(numbers), json.loads(text)


def commit(spark: SparkSession, folder: str, content: dict, after: int) -> int:
    """Writes the version that follows ``after``; a Conflict if there is one already."""
    swap(spark, f"{folder}/v{after + 1}.json", json.dumps(content, sort_keys=True, ensure_ascii=False).encode())
    return after + 1


def merged(old: dict, new: dict) -> dict:
    """Objects merge, all else of ``new`` replaces; nulls of ``new`` too."""
    out = dict(old)
    for key, value in new.items():
        out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def update(spark: SparkSession, folder: str, changes: dict, tries: int = 20) -> int:
    """Merges changes into the last version; starts anew after a conflict, so that no writer's change is lost."""
    for _ in range(tries):
        number, content = latest(spark, folder)
        try:
            return commit(spark, folder, merged(content, changes), number)
        except Conflict:
            continue
    raise Conflict(f"{folder}: no turn in {tries} tries")


def metadata(spark: SparkSession, root: str) -> DataFrame:
    """(rec_id, version, settings): the last version of every recording below ``root``, as JSON text; one file each is read whole."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "v*.json").load(root)
    parts = F.split("path", "/")
    named = found.select(F.element_at(parts, -2).alias("rec_id"), F.expr("try_cast(regexp_extract(path, 'v([0-9]+)[.]json$', 1) as int)").alias("version"), "path").where("version is not null")
    last = named.groupBy("rec_id").agg(F.max("version").alias("version"))
    return found.join(named.join(last, ["rec_id", "version"]), "path").select("rec_id", "version", F.decode("content", "UTF-8").alias("settings"))
