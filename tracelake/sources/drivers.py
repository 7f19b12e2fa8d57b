"""Adapters from the benchmark tables to units, traces and pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Onsets (unit, t, value): events in seconds since 2024-01-01."""
    t = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts) / 1e6D")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("unit"), t.alias("t"), "value", "event_id")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily price sums by return flag as traces (unit, frame, value)."""
    day = read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("unit"), F.to_date("l_shipdate").alias("day")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("value"))
    return day.select("unit", (F.row_number().over(Window.partitionBy("unit").orderBy("day")) - 1).alias("frame"), "value")


def windows(spark: SparkSession, days: int = 30) -> DataFrame:
    """The first two hours of each day as windows."""
    return spark.range(days).select(F.col("id").cast("int").alias("event_id"), (F.col("id") * 86400.0).alias("start_s"), (F.col("id") * 86400.0 + 7200.0).alias("end_s"))


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily prices of each flag (rec_id) and line number (roi_id) as equally long arrays (x), days without sales 0."""
    day = F.datediff(F.to_date("l_shipdate"), F.lit("1995-01-01").cast("date"))
    li = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("rec_id"), F.col("l_linenumber").alias("roi_id"), day.alias("day"), F.col("l_extendedprice").cast("decimal(18,2)").alias("v"))
    sums = li.groupBy("rec_id", "roi_id", "day").agg(F.sum("v").cast("double").alias("v"))
    ends = sums.groupBy("rec_id").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    maps = sums.groupBy("rec_id", "roi_id").agg(F.map_from_entries(F.collect_list(F.struct("day", "v"))).alias("m"))
    return maps.join(ends, "rec_id").select("rec_id", "roi_id", F.expr("transform(sequence(a, b), i -> coalesce(m[i], 0D))").alias("x"))
