"""What the query modules share: rounding, pixels of the embeddings, and the CTEs of the check SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.sources import drivers as src

SIX = 6
#: CTEs shared by the check SQL.
UNITS = "units AS (SELECT user_id AS unit, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 AS t, value, event_id FROM events)"
SERIES = "series AS (SELECT l_returnflag AS unit, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate::DATE) - 1 AS frame, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS value FROM lineitem GROUP BY l_returnflag, l_shipdate::DATE)"
WINDOWS = "w AS (SELECT i::INTEGER AS event_id, i * 86400.0 AS start_s, i * 86400.0 + 7200.0 AS end_s FROM range(30) r(i))"
ROBUST = "med AS (SELECT unit, median(value) AS m FROM series GROUP BY unit), mad AS (SELECT s.unit, any_value(m) AS m, median(abs(value - m)) AS d FROM series s JOIN med USING (unit) GROUP BY s.unit), rz AS (SELECT s.unit, frame, (value - m) / (1.4826 * (d + 1e-12)) AS z FROM series s JOIN mad USING (unit))"
PIXELS = "px AS (SELECT vec_id AS frame, i // 8 AS y, i % 8 AS x, embedding[i + 1]::DOUBLE AS v, vec_id % 3 AS rec_id FROM embeddings, range(64) r(i))"


def r6(column: Column | str, name: str | None = None) -> Column:
    return F.round(column, SIX).alias(name or column)


def z6(column: Column | str, name: str | None = None, digits: int = SIX) -> Column:
    """Rounded, and never a negative zero."""
    return (F.round(column, digits) + F.lit(0.0)).alias(name or column)


def pixels(spark, d) -> DataFrame:
    e = src.read(spark, d, "embeddings").select(F.col("vec_id").alias("frame"), F.posexplode("embedding").alias("i", "v"))
    return e.select("frame", F.expr("cast(i div 8 as int)").alias("y"), F.expr("i % 8").alias("x"), F.col("v").cast("double").alias("v"), (F.col("frame") % 3).alias("rec_id"))
