"""A recording's footprints, traces and intervals as one bundle of linked tables.

Ragged columns are stored flat beside an index vector, the running end of each row's stretch: ``units.pixels_end`` over
``pixels``, ``intervals.units_end`` over ``interval_units``. Traces and interval entries name a unit by its row in the
recording. A bundle is written to a folder of its own, checked there, and named as the current one by its last step; a
bundle with broken links is refused and leaves what was current.

    units           rec_id, row, roi_id, pixels_end
    pixels          rec_id, at, y, x, w
    traces          rec_id, name, unit, x
    intervals       rec_id, row, event_id, start_s, end_s, units_end
    interval_units  rec_id, at, unit
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelake.sources.commits import swap

TABLES = ("units", "pixels", "traces", "intervals", "interval_units")


class BrokenBundle(ValueError):
    """Links of a bundle that lead nowhere; the message counts them by kind."""


def _rows(df: DataFrame, order: list[str]) -> DataFrame:
    return df.withColumn("row", (F.row_number().over(Window.partitionBy("rec_id").orderBy(*order)) - 1).cast("int"))


def _ends(df: DataFrame, size, name: str) -> DataFrame:
    return df.withColumn(name, F.sum(size).over(Window.partitionBy("rec_id").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)).cast("long"))


def tables(units: DataFrame, traces: DataFrame, intervals: DataFrame) -> dict[str, DataFrame]:
    """units (rec_id, roi_id, ypix, xpix, lam), traces (rec_id, roi_id, name, x), intervals (rec_id, event_id, start_s, end_s, roi_ids).

    Null lists count as empty. A trace or interval of a unit that is not there keeps a null link, for the check to find.
    """
    n = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    u = _ends(_rows(units, ["roi_id"]), n("ypix"), "pixels_end")
    flat = u.select("rec_id", "pixels_end", n("ypix").alias("_n"), F.posexplode(F.arrays_zip("ypix", "xpix", "lam")).alias("_i", "_p"))
    names = u.select("rec_id", "roi_id", F.col("row").alias("unit"))
    t = traces.join(names, ["rec_id", "roi_id"], "left").select("rec_id", "name", "unit", "x")
    v = _ends(_rows(intervals, ["start_s", "event_id"]), n("roi_ids"), "units_end")
    inner = v.select("rec_id", (F.col("units_end") - n("roi_ids")).alias("_s"), F.posexplode("roi_ids").alias("_i", "roi_id"))
    return {
        "units": u.select("rec_id", "row", "roi_id", "pixels_end"),
        "pixels": flat.select("rec_id", (F.col("pixels_end") - F.col("_n") + F.col("_i")).alias("at"), F.col("_p.ypix").alias("y"), F.col("_p.xpix").alias("x"), F.col("_p.lam").alias("w")),
        "traces": t,
        "intervals": v.select("rec_id", "row", "event_id", "start_s", "end_s", "units_end"),
        "interval_units": inner.join(names, ["rec_id", "roi_id"], "left").select("rec_id", (F.col("_s") + F.col("_i")).alias("at"), "unit"),
    }


def violations(parts: dict[str, DataFrame]) -> DataFrame:
    """(kind, n) of broken links: links to no unit, rows out of their count, index vectors that fall or end elsewhere, bounds in the wrong order."""
    size = parts["units"].groupBy("rec_id").agg(F.count("*").alias("_n"), F.max("row").alias("_last"), F.count_distinct("row").alias("_d"))

    def links(name: str) -> DataFrame:
        j = parts[name].join(size, "rec_id", "left")
        return j.where("unit is null or _n is null or unit < 0 or unit >= _n").select(F.lit(f"{name}.unit").alias("kind"))

    def index(rows: str, end: str, flat: str) -> DataFrame:
        before = F.coalesce(F.lag(end).over(Window.partitionBy("rec_id").orderBy("row")), F.lit(0))
        falls = parts[rows].withColumn("_b", before).where(f"{end} is null or {end} < _b").select(F.lit(f"{rows}.{end}").alias("kind"))
        ends = parts[rows].groupBy("rec_id").agg(F.max(end).alias("_e"))
        have = parts[flat].groupBy("rec_id").agg(F.count("*").alias("_n"), F.count_distinct("at").alias("_d"), F.min("at").alias("_a"), F.max("at").alias("_z"))
        other = ends.join(have, "rec_id", "full").where("coalesce(_e, 0) != coalesce(_n, 0) or (_n > 0 and (_d != _n or _a != 0 or _z != _n - 1))")
        return falls.unionByName(other.select(F.lit(f"{flat}.at").alias("kind")))

    found = links("traces").unionByName(links("interval_units")).unionByName(index("units", "pixels_end", "pixels")).unionByName(index("intervals", "units_end", "interval_units"))
    found = found.unionByName(size.where("_d != _n or _last != _n - 1").select(F.lit("units.row").alias("kind")))
    found = found.unionByName(parts["intervals"].where("start_s is null or end_s is null or end_s < start_s").select(F.lit("intervals.bounds").alias("kind")))
    return found.groupBy("kind").agg(F.count("*").alias("n"))


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the current bundle below ``path``."""
    name = spark.read.text(f"{path}/CURRENT").first()[0]
    return {t: spark.read.parquet(f"{path}/{name}/{t}") for t in TABLES}


def write(path: str, units: DataFrame, traces: DataFrame, intervals: DataFrame) -> None:
    """Writes, checks and then names the bundle; BrokenBundle leaves the current one as it is."""
    spark, name = units.sparkSession, f"bundle-{uuid.uuid4().hex}"
    for t, df in tables(units, traces, intervals).items():
        df.write.parquet(f"{path}/{name}/{t}")
    bad = violations({t: spark.read.parquet(f"{path}/{name}/{t}") for t in TABLES}).collect()
    fs, at = _files(spark, f"{path}/{name}")
    if bad:
        fs.delete(at, True)
        raise BrokenBundle(", ".join(sorted(f"{r.kind}: {r.n}" for r in bad)))
    swap(spark, f"{path}/CURRENT", name.encode(), overwrite=True)


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """units, traces and intervals of the current bundle, as they were given; links are followed by joins on rows."""
    return assemble(load(spark, path))


def assemble(p: dict[str, DataFrame]) -> dict[str, DataFrame]:
    def stretches(rows: str, end: str, flat: str, keep) -> DataFrame:
        """(rec_id, row, values): the flat rows of each index stretch, by a join on the stretch's own cells."""
        w = Window.partitionBy("rec_id").orderBy("row")
        own = p[rows].select("rec_id", "row", F.coalesce(F.lag(end).over(w), F.lit(0)).alias("_s"), F.col(end).alias("_e")).where("_e > _s")
        own = own.withColumn("_c", F.explode(F.expr("sequence(_s div 1024, (_e - 1) div 1024)")))
        at = p[flat].withColumn("_c", F.expr("at div 1024")).join(own, ["rec_id", "_c"]).where("at >= _s and at < _e")
        return at.groupBy("rec_id", "row").agg(F.array_sort(F.collect_list(F.struct("at", *keep))).alias("_v"))

    names = p["units"].select("rec_id", F.col("row").alias("unit"), "roi_id")
    part = lambda c, kind: F.coalesce(F.transform("_v", lambda v: v[c]), F.array().cast(f"array<{kind}>"))
    pixels = stretches("units", "pixels_end", "pixels", ["y", "x", "w"])
    units = p["units"].join(pixels, ["rec_id", "row"], "left").select("rec_id", "roi_id", part("y", "int").alias("ypix"), part("x", "int").alias("xpix"), part("w", "double").alias("lam"))
    traces = p["traces"].join(names, ["rec_id", "unit"]).select("rec_id", "roi_id", "name", "x")
    p = p | {"interval_units": p["interval_units"].join(names, ["rec_id", "unit"])}
    inner = stretches("intervals", "units_end", "interval_units", ["roi_id"])
    ids = part("roi_id", "int").alias("roi_ids")
    intervals = p["intervals"].join(inner, ["rec_id", "row"], "left").select("rec_id", "event_id", "start_s", "end_s", ids)
    return {"units": units, "traces": traces, "intervals": intervals}
