"""Files of recordings: raw float32 matrices, .npy arrays, folder inventories, queues, notes, sheets."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelake.functions import scalars


# Path patterns of the files that mark a finished stage; all of a stage's patterns must be met.
STAGE_FILES = {
    "has_preprocess": (r"/qc\.gif$", r"/mean\.npy$"),
    "has_detection": (r"/plane0/F\.npy$", r"/plane0/stat\.npy$"),
    "has_lowpass": (r"/plane0/r0p7_filtered_dff_lowpass\.memmap\.float32$", r"/plane0/r0p7_filtered_dff_dt\.memmap\.float32$"),
    "has_clusters": (r"/plane0/[^/]*cluster_results/(.*/)?linkage\.npy$",),
    "has_xcorr": (r"/plane0/[^/]*cluster_results/(.*/)?cross_correlation_[^/]*(/.*)?$",),
}


def listing(spark: SparkSession, root: str, pattern: str = "*", depth: int | None = None) -> DataFrame:
    """(path, level, length, modified) of files below ``root``, contents unread; order by level and lower(path)."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    inner = F.substring_index("path", root.split("://")[-1].rstrip("/") + "/", -1)
    out = found.select("path", (F.size(F.split(inner, "/")) - 1).alias("level"), "length", F.col("modificationTime").alias("modified"))
    return out if depth is None else out.where(F.col("level") <= depth)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def raw_matrix(spark: SparkSession, path: str, columns: int, rec: str | None = None) -> DataFrame:
    """Headerless float32 (frames, units) files as (rec_id, roi_id, x array<float>); one task a file, which must be whole rows."""

    def run(batches):
        for pdf in batches:
            for rec_id, content in zip(pdf["rec_id"], pdf["content"], strict=True):
                x = np.frombuffer(content, np.float32)
                if len(x) % columns:
                    raise ValueError(f"{rec_id}: {len(x)} values are not rows of {columns}")
                x = x.reshape(-1, columns)
                yield pd.DataFrame({"rec_id": rec_id, "roi_id": np.arange(columns, dtype=np.int32), "x": list(x.T)})

    name = F.lit(rec) if rec else F.coalesce(scalars.recording_of("path"), F.col("path"))
    return spark.read.format("binaryFile").load(path).select(name.alias("rec_id"), "content").mapInPandas(run, "rec_id string, roi_id int, x array<float>")


def npy_matrix(spark: SparkSession, path: str, highest_id: int | None = None) -> DataFrame:
    """Two-axis .npy files of units x frames as (rec_id, roi_id, x array<float>).

    With ``highest_id``, a file whose first axis cannot hold that id while its second can is read transposed.
    """

    def run(batches):
        for pdf in batches:
            for rec_id, content in zip(pdf["rec_id"], pdf["content"], strict=True):
                x = np.load(io.BytesIO(content), allow_pickle=False)
                if x.ndim != 2:
                    raise ValueError(f"{rec_id}: an array of {x.ndim} axes")
                if highest_id is not None and x.shape[0] <= highest_id < x.shape[1]:
                    x = x.T
                yield pd.DataFrame({"rec_id": rec_id, "roi_id": np.arange(len(x), dtype=np.int32), "x": list(x.astype(np.float32))})

    name = F.coalesce(scalars.recording_of("path"), F.col("path")).alias("rec_id")
    return spark.read.format("binaryFile").load(path).select(name, "content").mapInPandas(run, "rec_id string, roi_id int, x array<float>")


def inventory(files: DataFrame) -> DataFrame:
    """Which stages each recording's folder holds, from a listing's paths; a low-pass needs a detection too."""
    has = lambda pattern: F.coalesce(F.bool_or(F.col("path").rlike(pattern)), F.lit(False))
    by = files.withColumn("rec_id", scalars.recording_of("path")).where("rec_id is not null").groupBy("rec_id")
    out = by.agg(*(F.forall(F.array(*map(has, patterns)), lambda x: x).alias(name) for name, patterns in STAGE_FILES.items()))
    return out.withColumn("has_lowpass", F.expr("has_detection and has_lowpass"))


def read_queue(spark: SparkSession, path: str) -> DataFrame:
    """Queue rows (identifier, tiffs, params map, bad_params) of a CSV with headers; wholly empty rows go.

    Files are split at semicolons and trimmed; params that are no JSON object become empty and are marked.
    """
    rows = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    if "tiffs" not in rows.columns:
        raise ValueError("the queue has no column 'tiffs'")
    have = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) if c in rows.columns else F.lit("")
    one = rows.select(have("identifier").alias("identifier"), have("tiffs").alias("t"), have("params").alias("p")).where("identifier != '' or t != ''")
    parsed = F.when(F.col("p").startswith("{"), F.try_parse_json("p"))
    as_map = F.from_json(F.when(parsed.isNotNull(), F.col("p")), "map<string,string>")
    files = F.filter(F.transform(F.split("t", ";"), lambda x: F.trim(x)), lambda x: x != "")
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    return one.select("identifier", files.alias("tiffs"), F.coalesce(as_map, empty).alias("params"), ((F.col("p") != "") & parsed.isNull()).alias("bad_params"))


def write_queue(queue: DataFrame, path: str) -> None:
    flat = queue.select("identifier", F.concat_ws("; ", "tiffs").alias("tiffs"), F.to_json("params").alias("params"))
    flat.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def frame_rates(recordings: DataFrame, notes: DataFrame, default: float = 15.07) -> DataFrame:
    """fps of each recording from notes (filename, rate): 'date-serial' first, else '-serial' or the serial alone, else the default.

    Both look-ups are equi-joins: a note's serial is what follows its last hyphen. Of several notes the first by name counts.
    """
    n = notes.select(F.trim("filename").alias("f"), F.col("rate").cast("double").alias("rate")).where("f is not null")
    exact = n.groupBy(F.col("f").alias("target")).agg(F.count("*").alias("n_exact"), F.min_by("rate", F.col("rate")).alias("r_exact"))
    loose = n.groupBy(F.substring_index("f", "-", -1).alias("serial")).agg(F.min_by("rate", "f").alias("r_loose"))
    r = recordings.withColumn("serial", F.regexp_extract("rec_id", r"^[^_]*_(.*)$", 1)).withColumn("target", F.concat(F.substring_index("rec_id", "_", 1), F.lit("-"), "serial"))
    r = r.join(exact, "target", "left").join(loose, "serial", "left")
    fps = F.when(F.col("n_exact") > 0, F.col("r_exact")).otherwise(F.col("r_loose"))
    return r.withColumn("fps", F.coalesce(fps, F.lit(default))).drop("serial", "target", "n_exact", "r_exact", "r_loose")


def json_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(rec_id, path, text) of JSON files below ``root``; a recording is its innermost named folder, else the file's folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    folder = F.element_at(F.split("path", "/"), -2)
    return found.select(F.coalesce(scalars.recording_of("path"), folder).alias("rec_id"), "path", F.decode("content", "UTF-8").alias("text"))


def read_manifests(spark: SparkSession, root: str, pattern: str = "manifest.json") -> DataFrame:
    """(rec_id, path, params, tau, fs, bad) of recordings' manifests: params as text by name, numbers null where they are none.

    A manifest that is no JSON object is marked ``bad`` and has no params; params that are no object are empty.
    """
    rows = json_files(spark, root, pattern).withColumn("_v", F.try_parse_json("text"))
    top = F.expr("try_variant_get(_v, '$', 'map<string,variant>')")
    rows = rows.withColumns({"_m": top}).withColumns({"_p": F.expr("try_variant_get(_v, '$.params', 'map<string,variant>')")})
    bare = lambda k, v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v))
    params = F.coalesce(F.transform_values("_p", bare), F.expr("cast(map() as map<string,string>)"))
    number = lambda n: F.expr(f"try_variant_get(_v, '$.{n}', 'double')").alias(n)
    return rows.select("rec_id", "path", params.alias("params"), number("tau"), number("fs"), F.col("_m").isNull().alias("bad"))


def write_sidecar(spark: SparkSession, folder: str, raw_paths: list[str], name: str = "raw_paths.json") -> None:
    """Names the raw files that a recording's folder was made from, in a file that appears whole."""
    import json

    from tracelake.sources.commits import swap

    swap(spark, f"{folder}/{name}", json.dumps({"raw_paths": raw_paths}, indent=2).encode(), overwrite=True)


def read_sidecars(spark: SparkSession, root: str, pattern: str = "*raw_paths.json") -> DataFrame:
    """(rec_id, raw_paths): empty where the file is no JSON or names none."""
    rows = json_files(spark, root, pattern)
    paths = F.expr("try_variant_get(try_parse_json(text), '$.raw_paths', 'array<string>')")
    return rows.select("rec_id", F.coalesce(paths, F.array().cast("array<string>")).alias("raw_paths"))


def finished_preprocess(files: DataFrame, sidecars: DataFrame | None = None) -> DataFrame:
    """What each recording's folder holds of a finished preprocess, from a listing's paths.

    (rec_id, shifted, mean, animation, raw, state): shifted stacks by trailing number; ``state`` is 'complete' with a
    stack, a mean image and an animation, 'archived' where the stacks are gone and raw files are named, else 'partial'.
    Recordings with none of the files have no row.
    """
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select(scalars.recording_of("path").alias("rec_id"), "path", name.alias("_n")).where("rec_id is not null")
    stack = F.col("_n").contains("shifted_") & F.lower("_n").rlike(r"\.tiff?$")
    by = rows.groupBy("rec_id").agg(
        F.transform(F.array_sort(F.collect_list(F.when(stack, F.struct(scalars.trailing_index("path").alias("i"), "path")))), lambda x: x["path"]).alias("shifted"),
        F.min(F.when(F.col("_n") == "mean.npy", F.col("path"))).alias("mean"), F.min(F.when(F.col("_n") == "qc.gif", F.col("path"))).alias("animation"),
    )
    by = by.where("size(shifted) > 0 or mean is not null or animation is not null")
    none = F.array().cast("array<string>")
    by = by.join(sidecars, "rec_id", "left").withColumn("raw", F.coalesce("raw_paths", none)).drop("raw_paths") if sidecars is not None else by.withColumn("raw", none)
    viewed = F.col("mean").isNotNull() & F.col("animation").isNotNull()
    state = F.when(viewed & (F.size("shifted") > 0), "complete").when(viewed & (F.size("raw") > 0), "archived").otherwise("partial")
    return by.withColumn("state", state)


def merge_manifests(old: DataFrame, new: DataFrame) -> DataFrame:
    """(rec_id, params map, tau, fs): params of both, the newer winning; zero or missing tau and fs never replace a value."""
    o = old.select("rec_id", F.col("params").alias("p0"), F.col("tau").alias("t0"), F.col("fs").alias("f0"))
    n = new.select("rec_id", F.col("params").alias("p1"), F.col("tau").alias("t1"), F.col("fs").alias("f1"))
    empty = F.expr("cast(map() as map<string,string>)")
    before, after = F.coalesce("p0", empty), F.coalesce("p1", empty)
    params = F.map_concat(F.map_filter(before, lambda k, v: ~F.map_contains_key(after, k)), after)
    newest = lambda a, b: F.coalesce(F.when(F.col(a) > 0, F.col(a)), F.col(b))
    return o.join(n, "rec_id", "full").select("rec_id", params.alias("params"), newest("t1", "t0").alias("tau"), newest("f1", "f0").alias("fs"))


def write_sheet(df: DataFrame, workbook: str, sheet: str, key: str = "rec_id") -> None:
    """Replace a sheet's rows of the recordings in ``df``: one Parquet table a sheet, partitioned by recording."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(f"{workbook}/{sheet}")


def read_sheet(spark: SparkSession, workbook: str, sheet: str) -> DataFrame:
    return spark.read.parquet(f"{workbook}/{sheet}")


def event_windows(sheet: DataFrame, start: str = "start_s", end: str = "end_s") -> DataFrame:
    """Rows whose bounds are numbers, as windows numbered by start within a recording; all others are left out."""
    w = sheet.select("rec_id", F.expr(f"try_cast(`{start}` as double)").alias("start_s"), F.expr(f"try_cast(`{end}` as double)").alias("end_s")).where("start_s is not null and end_s is not null")
    return w.withColumn("event_id", F.row_number().over(Window.partitionBy("rec_id").orderBy("start_s", "end_s")) - 1)


def wide(traces: DataFrame, units: list[int], frame: str = "frame", unit: str = "roi_id", value: str = "value") -> DataFrame:
    """Long rows of one recording as one column a unit, for a wide CSV."""
    return traces.groupBy(frame).pivot(unit, units).agg(F.first(value))


def write_pairs_csv(pairs: DataFrame, path: str) -> None:
    """Pair summaries with six significant digits."""
    six = [F.format_string("%.6g", c).alias(c) if t == "double" else F.col(c) for c, t in pairs.dtypes]
    pairs.select(*six).write.mode("overwrite").option("header", True).csv(path)
