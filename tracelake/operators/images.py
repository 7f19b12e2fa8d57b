"""Image reducers on long pixel rows (frame, y, x, v): built-in functions, partial sums before every shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shift_to_uint16(pixels: DataFrame, group: list[str]) -> DataFrame:
    """Each group of files raised so that its least value is at least 0; an error above 65535. (…, v) to (…, v int)."""
    low = pixels.groupBy(*group).agg(F.greatest(-F.min("v"), F.lit(0)).alias("shift"))
    raised = F.col("v") + F.col("shift")
    value = F.when(raised > 65535, F.raise_error(F.lit("a shifted value exceeds 65535"))).otherwise(raised)
    return pixels.join(low, group).withColumn("v", value.cast("int")).drop("shift")


def global_frames(files: DataFrame, group: str = "rec_id") -> DataFrame:
    """(rec_id, path, n_frames) to each file's first frame in its group, by trailing number."""
    from tracelake.functions.scalars import trailing_index

    w = Window.partitionBy(group).orderBy(trailing_index("path"), "path").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("first_frame", F.coalesce(F.sum("n_frames").over(w), F.lit(0)))


def mean_image(pixels: DataFrame, keys: tuple[str, ...] = ("rec_id",)) -> DataFrame:
    return pixels.groupBy(*keys, "y", "x").agg(F.avg("v").alias("mean"))


def preview(pixels: DataFrame, every: int = 4, low: float = 0.01, high: float = 0.995, keys: tuple[str, ...] = ()) -> DataFrame:
    """Every n-th frame in 8 bits between two percentiles of the chosen frames of each recording (``keys``); a flat window is 0."""
    some = pixels.where(F.col("frame") % every == 0)
    # Percentiles from counts of values: shifted pixels are 16-bit, so that few rows are left of a recording.
    counts = some.groupBy(*keys, "v").agg(F.count("*").alias("_n"))
    ends = counts.groupBy(*keys).agg(F.percentile("v", F.lit(low), F.col("_n")).alias("a"), F.percentile("v", F.lit(high), F.col("_n")).alias("b"))
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("v") - F.col("a")) / F.nullif(F.col("b") - F.col("a"), F.lit(0.0))))
    both = some.join(ends, list(keys)) if keys else some.crossJoin(F.broadcast(ends))
    return both.select(*keys, "frame", "y", "x", F.coalesce(F.floor(scaled * 255 + 0.5), F.lit(0)).cast("int").alias("grey"))


def heat_rows(rows: DataFrame, keys: list[str], value: str, low: float = 0.01, high: float = 0.995) -> DataFrame:
    """Rows to 0..255 between their own percentiles; 0 where these do not differ."""
    ends = rows.groupBy(*keys).agg(F.percentile(value, F.lit(low)).alias("_a"), F.percentile(value, F.lit(high)).alias("_b"))
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(value) - F.col("_a")) / (F.col("_b") - F.col("_a"))))
    return rows.join(ends, keys).withColumn("heat", F.when(F.col("_b") > F.col("_a"), F.floor(part * 255 + 0.5)).otherwise(0).cast("int")).drop("_a", "_b")


def footprints(rois: DataFrame, height: int, width: int) -> DataFrame:
    """(rec_id, roi_id, ypix, xpix, lam) to in-bounds pixel rows (…, y, x, w)."""
    px = rois.select("rec_id", "roi_id", F.explode(F.arrays_zip("ypix", "xpix", "lam")).alias("p")).select("rec_id", "roi_id", F.col("p.ypix").alias("y"), F.col("p.xpix").alias("x"), F.col("p.lam").alias("w"))
    return px.where((F.col("y") >= 0) & (F.col("y") < height) & (F.col("x") >= 0) & (F.col("x") < width))


def unit_rows(pixels: DataFrame) -> DataFrame:
    """Median place, area and radius of each unit."""
    return pixels.groupBy("rec_id", "roi_id").agg(F.median("y").alias("y"), F.median("x").alias("x"), F.count("*").alias("npix")).withColumn("radius", F.sqrt(F.col("npix") / F.pi()))


def label_image(pixels: DataFrame) -> DataFrame:
    """The last unit on each pixel."""
    return pixels.groupBy("rec_id", "y", "x").agg(F.max("roi_id").alias("roi_id"))


def merge_passes(primary: DataFrame, extras: list[tuple[str, DataFrame]], limit: float = 0.3, cap: int = 60_000, first: str = "primary", keep: bool = False) -> DataFrame:
    """Units of detectors in order, numbered through per recording; extra passes are held against the primary alone.

    Pixel rows (rec_id, roi_id, y, x). An extra unit stays if less than ``limit`` of its pixels are covered. An error
    where a recording ends with more than ``cap`` units.
    """
    seen = primary.select("rec_id", "y", "x").distinct().withColumn("hit", F.lit(1.0))
    out = primary.withColumns({"pass": F.lit(0), "source": F.lit(first)})
    for i, (name, extra) in enumerate(extras, 1):
        share = extra.join(seen, ["rec_id", "y", "x"], "left").groupBy("rec_id", "roi_id").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("covered"))
        out = out.unionByName(extra.join(share.where(F.col("covered") < limit), ["rec_id", "roi_id"], "left_semi").withColumns({"pass": F.lit(i), "source": F.lit(name)}))
    units = out.select("rec_id", "pass", "roi_id").distinct().withColumn("unit", F.row_number().over(Window.partitionBy("rec_id").orderBy("pass", "roi_id")) - 1)
    units = units.withColumn("unit", F.when(F.col("unit") >= cap, F.raise_error(F.lit("more units than the cap"))).otherwise(F.col("unit")))
    old = [F.col("roi_id").alias("_old")] if keep else []
    return out.join(units, ["rec_id", "pass", "roi_id"]).select("rec_id", F.col("unit").alias("roi_id"), "source", "y", "x", *old)


def ingest(recordings: DataFrame, passes: list[tuple[str, DataFrame]], limit: float = 0.3, cap: int = 60_000) -> dict[str, DataFrame]:
    """Results of detectors as one set of units: what a detection leaves for all later steps.

    ``recordings``: (rec_id, height, width); ``passes``: the primary detector's units first, then the others in order, each
    (rec_id, roi_id, ypix, xpix, lam). Pixels outside their recording's image go, units without pixels with them; extra
    passes are held against the primary; units are numbered through. pixels (rec_id, roi_id, source, y, x, w), units
    (rec_id, roi_id, source, y, x, npix, radius), labels (rec_id, y, x, roi_id), counts (rec_id, source, n_found, n_kept).
    """

    def inside(rois: DataFrame) -> DataFrame:
        p = F.explode(F.arrays_zip("ypix", "xpix", "lam")).alias("p")
        flat = rois.select("rec_id", "roi_id", p).select("rec_id", "roi_id", F.col("p.ypix").alias("y"), F.col("p.xpix").alias("x"), F.col("p.lam").alias("w"))
        return flat.join(recordings, "rec_id").where("y >= 0 and y < height and x >= 0 and x < width").drop("height", "width")

    flat = [(name, inside(rois)) for name, rois in passes]
    merged = merge_passes(flat[0][1].select("rec_id", "roi_id", "y", "x"), [(n, df.select("rec_id", "roi_id", "y", "x")) for n, df in flat[1:]], limit, cap, first=flat[0][0], keep=True)
    weights = None
    for name, df in flat:
        part = df.select("rec_id", F.col("roi_id").alias("_old"), F.lit(name).alias("source"), "y", "x", "w")
        weights = part if weights is None else weights.unionByName(part)
    pixels = merged.join(weights, ["rec_id", "_old", "source", "y", "x"]).drop("_old")
    units = unit_rows(pixels).join(pixels.select("rec_id", "roi_id", "source").distinct(), ["rec_id", "roi_id"])
    found = None
    for name, rois in passes:
        part = rois.groupBy("rec_id").agg(F.count("*").alias("n_found")).withColumn("source", F.lit(name))
        found = part if found is None else found.unionByName(part)
    kept = units.groupBy("rec_id", "source").agg(F.count("*").alias("n_kept"))
    return {"pixels": pixels, "units": units, "labels": label_image(pixels), "counts": found.join(kept, ["rec_id", "source"], "left").fillna(0, ["n_kept"])}


def resampling(n: int, m: int) -> list[tuple[int, int, float]]:
    """(target, source, weight) of n samples drawn to m by area: the share of a target cell that a source cell covers."""
    out = []
    for t in range(m):
        a, b = t * n / m, (t + 1) * n / m
        out += [(t, s, (min(b, s + 1) - max(a, s)) * m / n) for s in range(int(a), min(n, int(-(-b // 1)))) if min(b, s + 1) - max(a, s) > 1e-12]
    return out


def resize(pixels: DataFrame, size: tuple[int, int], to: tuple[int, int], keys: tuple[str, ...] = ("rec_id", "frame")) -> DataFrame:
    """Frames (keys, y, x, v) of ``size`` drawn to ``to`` (height, width), each new pixel the area-weighted mean of what it covers.

    Rows first, then columns: two joins with weight tables, whose rows are at most the sum of both lengths, and two sums.
    """
    spark = pixels.sparkSession
    for axis, other, n, m in (("y", "x", size[0], to[0]), ("x", "y", size[1], to[1])):
        weights = spark.createDataFrame(resampling(n, m), f"_t int, {axis} int, _w double")
        drawn = pixels.join(F.broadcast(weights), axis).groupBy(*keys, other, "_t").agg(F.sum(F.col("v") * F.col("_w")).alias("v"))
        pixels = drawn.withColumnRenamed("_t", axis)
    return pixels.select(*keys, "y", "x", "v")


SUMS = ("t", "sx", "sy", "sxy", "sxx", "syy")


def add_to_sums(state: str, files: DataFrame, read: Callable[[DataFrame], DataFrame]) -> list[str]:
    """Adds the files that a state table of neighbour sums lacks, and returns their paths; known ones are not read.

    ``files``: (rec_id, path, sha256); ``read`` gives (rec_id, path, frame, y, x, v) for a table of files. A file is known by
    its recording, its content and which of equal files it is. Sums are appended in one job, which either adds all or nothing.
    """
    from tracelake.operators.tables import neighbour_sums

    spark = files.sparkSession
    nth = F.row_number().over(Window.partitionBy("rec_id", "sha256").orderBy("path"))
    wanted = files.select("rec_id", "path", "sha256").withColumn("nth", nth)
    known = known_sums(spark, state)
    if known is not None:
        wanted = wanted.join(known.select("rec_id", "sha256", "nth").distinct(), ["rec_id", "sha256", "nth"], "left_anti")
    new = [(r.rec_id, r.path, r.sha256, r.nth) for r in wanted.collect()]  # one row a new file
    if new:
        fresh = spark.createDataFrame(new, wanted.select("rec_id", "path", "sha256", "nth").schema)
        sums = neighbour_sums(read(fresh), ("rec_id", "path"))
        sums.join(F.broadcast(fresh), ["rec_id", "path"]).select("rec_id", "sha256", "nth", "y", "x", *SUMS).write.mode("append").parquet(state)
    return sorted(r[1] for r in new)


def known_sums(spark, state: str) -> DataFrame | None:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{state}/_SUCCESS")
    return spark.read.parquet(state) if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else None


def corr_of_state(spark, state: str, files: DataFrame) -> DataFrame:
    """The correlation image of each recording from the state table, over the files that are there now."""
    from tracelake.operators.tables import corr_of_sums

    nth = F.row_number().over(Window.partitionBy("rec_id", "sha256").orderBy("path"))
    now = files.select("rec_id", "path", "sha256").withColumn("nth", nth).drop("path")
    return corr_of_sums(known_sums(spark, state).join(now, ["rec_id", "sha256", "nth"], "left_semi"))
