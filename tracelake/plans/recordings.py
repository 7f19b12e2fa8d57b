"""Queries of the correlation, spatial, image and event operators, and the SQL that checks those it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions import scalars
from tracelake.operators import events, images, tables, traces
from tracelake.plans.chain import processed
from tracelake.plans.common import PIXELS, SERIES, UNITS, WINDOWS, pixels, r6
from tracelake.sources import drivers as src
from tracelake.sources import files

FPS = 15.07


def equal_traces(spark, d) -> tuple[DataFrame, int]:
    """Daily sums of each flag as arrays (unit, x), cut to the shortest one, and its length."""
    n = src.series(spark, d).groupBy("unit").count().agg(F.min("count")).first()[0]
    rows = src.series(spark, d).where(F.col("frame") < n)
    x = F.transform(F.array_sort(F.collect_list(F.struct("frame", "value"))), lambda p: p["value"])
    return rows.groupBy("unit").agg(x.alias("x")), n


def xcorr_zero_lag(spark, d):
    return events.pair_curves(equal_traces(spark, d)[0], 0).where("unit_a < unit_b").select("unit_a", "unit_b", r6("c", "corr"))


def xcorr_pair_curve(spark, d):
    return events.pair_curves(equal_traces(spark, d)[0], 30).where("unit_a < unit_b").select("unit_a", "unit_b", "k", r6("c", "corr"))


def xcorr_per_event(spark, d):
    x, n = equal_traces(spark, d)
    x = x.select("unit", F.explode(F.sequence(F.lit(0), F.lit(n // 100 - 1))).alias("event_id"), "x").withColumn("x", F.expr("slice(x, event_id * 100 + 1, 100)"))
    out = tables.best_lags(events.pair_curves(x, 10, ("event_id",)), 1.0, ("event_id",))
    return out.where("unit_a < unit_b").select("event_id", "unit_a", "unit_b", r6("best_lag_sec"), r6("max_corr"))


def _place(spark, d):
    e = src.read(spark, d, "embeddings")
    return e.select("vec_id", "label", *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyt")))


def group_centroids(spark, d):
    p = _place(spark, d).select(F.lit("all").alias("rec_id"), (F.col("vec_id") % 20).cast("int").alias("event_id"), F.col("vec_id").cast("int").alias("roi_id"), "x", "y", F.col("label").cast("double").alias("first_time_s"))
    g = events.activation_groups(p.drop("x", "y"), p.select("rec_id", "roi_id", "x", "y"), 1.0)
    return g.select("event_id", "frame", "n", "rank", r6("cx"), r6("cy"), r6("rms"))


def zscore_flat(spark, d):
    e = _place(spark, d).withColumn("x", F.when(F.col("label") % 2 == 0, F.lit(3.0)).otherwise(F.col("x")))
    return tables.zscore(e, ["label"], "x").select("vec_id", r6("z"))


def cluster_cut_counts(spark, d):
    h = _place(spark, d).withColumn("h", F.abs("x"))
    return tables.cut_counts(h, ["label"], "h").select("label", r6("fraction"), "n", "chosen")


def spearman_angle(spark, d):
    return tables.angle_sweep(_place(spark, d), ["label"]).select("label", r6("angle"), (F.round("rho", 6) + 0.0).alias("rho"))


def pc_steps(spark, d):
    return tables.jumps(src.series(spark, d), ["unit"], "frame", "value", 2.0, 5).select("unit", "frame")


def heatmap_scale(spark, d):
    return images.heat_rows(pixels(spark, d), ["frame"], "v").groupBy("frame").agg(F.sum(F.when(F.col("heat") == 255, 1).otherwise(0)).alias("n_high"), F.sum(F.when(F.col("heat") == 0, 1).otherwise(0)).alias("n_low"))


def qc_frame_stride(spark, d):
    return images.preview(pixels(spark, d), 4).groupBy("frame").agg(F.count("*").alias("n"), F.sum(F.when(F.col("grey") == 255, 1).otherwise(0)).alias("n_high"))


def shift_nonneg(spark, d):
    p = pixels(spark, d).select((F.col("frame") % 5).alias("file"), "frame", "y", "x", F.floor(F.col("v") * 1000).cast("int").alias("v"))
    return images.shift_to_uint16(p, ["file"]).groupBy("file").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("v").alias("total"))


def scale_bar(spark, d):
    return src.read(spark, d, "part").select("p_partkey", r6(scalars.bar_length("p_retailprice"), "bar"))


def indicator_tau(spark, d):
    label = F.concat(F.lit("jGCaMP"), (F.col("p_size") % 4 + 5).cast("string"), F.substring(F.lit("fms"), F.col("p_size") % 3 + 1, F.lit(1)), F.lit(" (old)"))
    return src.read(spark, d, "part").select("p_partkey", r6(scalars.tau(label), "tau"))


def fps_from_notes(spark, d):
    s = src.read(spark, d, "supplier").select("s_suppkey")
    key = F.col("s_suppkey").cast("string")
    recs = s.select(F.concat(F.lit("2024-01-01_"), key).alias("rec_id"))
    notes = s.where("s_suppkey % 3 < 2").select(F.concat(F.when(F.col("s_suppkey") % 3 == 0, "2024-01-01-").otherwise("x-"), key).alias("filename"), F.when(F.col("s_suppkey") % 3 == 0, 30.0).otherwise(20.0).alias("rate"))
    return files.frame_rates(recs, notes).select("rec_id", "fps")


def rate_activation(spark, d):
    rates = src.traces(spark, d).withColumnRenamed("x", "spks")
    w = src.windows(spark).select(F.explode(F.array(*map(F.lit, "ANR"))).alias("rec_id"), "event_id", (F.col("event_id") * 10.0).alias("start_s"), (F.col("event_id") * 10.0 + 4.5).alias("end_s"))
    return events.rate_activation(rates, w, 2.0, 1000.0).select("rec_id", "event_id", "roi_id", r6("first_time_s"))


def order_map(spark, d):
    ranked = tables.activation_rank(tables.activation(src.units(spark, d), src.windows(spark)))
    px = src.units(spark, d).select("unit", (F.col("event_id") % 8).alias("y"), (F.col("event_id") % 4).alias("x")).distinct().withColumn("w", F.col("y") + 1.0)
    return events.order_map(ranked, px).select("event_id", "y", "x", r6("image"))


# Without SQL: recurrences, dense algebra, permutations. Tests hold their kernels against slow loops and planted truth.


def detect_events(spark, d):
    """Events of ten recordings of users, hours as seconds; the duration is that of the data."""
    u = src.units(spark, d).select((F.col("unit") % 10).cast("string").alias("rec_id"), F.col("unit").cast("int").alias("roi_id"), (F.col("t") / 3600.0).alias("onset_s"))
    recs = u.groupBy("rec_id").agg(F.ceil(F.max("onset_s")).cast("double").alias("duration_s"), F.count_distinct("roi_id").cast("int").alias("n_rois"))
    return events.detect_events(u, recs, events.kernel.GUI)


def cluster_correlation(spark, d):
    t = processed(spark, d)
    return events.cluster_correlation(t, traces.clusters(t), FPS, 1.0)


def sign_flip(spark, d):
    p = events.partial_correlation(processed(spark, d)).where("roi_a < roi_b")
    return events.marked(events.sign_flip(p, ["rec_id"], "partial_corr"))


def spread_direction(spark, d):
    from tracelake.plans.units import _spread

    return events.spread(*_spread(spark, d), 100.0)


Z = "n AS (SELECT min(c) AS n FROM (SELECT count(*) AS c FROM series GROUP BY unit)), s AS (SELECT *, frame // 100 AS event_id FROM series WHERE frame < (SELECT n FROM n))"
PLACE = "pl AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS t FROM embeddings)"
ACTIVE = "a AS (SELECT w.event_id, unit, min(t) AS f FROM units JOIN w ON t BETWEEN start_s AND end_s GROUP BY 1, 2), rk AS (SELECT event_id, unit, row_number() OVER (PARTITION BY event_id ORDER BY f, unit) AS rank FROM a)"

ORACLE = {
    "xcorr_zero_lag": f"WITH {SERIES}, {Z}, z AS (SELECT unit, frame, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS z FROM s WINDOW w AS (PARTITION BY unit)) SELECT a.unit AS unit_a, b.unit AS unit_b, round(sum(a.z * b.z) / (SELECT n FROM n), 6) AS corr FROM z a JOIN z b ON a.frame = b.frame AND a.unit < b.unit GROUP BY 1, 2",
    "xcorr_pair_curve": f"WITH {SERIES}, {Z}, z AS (SELECT unit, frame, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS z FROM s WINDOW w AS (PARTITION BY unit)) SELECT a.unit AS unit_a, b.unit AS unit_b, k::INTEGER AS k, round(sum(a.z * b.z) / (SELECT n FROM n), 6) AS corr FROM z b CROSS JOIN range(-30, 31) r(k) JOIN z a ON a.frame = b.frame + k WHERE a.unit < b.unit GROUP BY 1, 2, 3",
    "xcorr_per_event": f"WITH {SERIES}, {Z}, z AS (SELECT unit, event_id, frame, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS z FROM s WHERE event_id < (SELECT n // 100 FROM n) WINDOW w AS (PARTITION BY unit, event_id)), c AS (SELECT a.event_id, a.unit AS unit_a, b.unit AS unit_b, k, sum(a.z * b.z) / 100 AS c FROM z b CROSS JOIN range(-10, 11) r(k) JOIN z a ON a.frame = b.frame + k AND a.event_id = b.event_id AND a.unit < b.unit GROUP BY 1, 2, 3, 4) SELECT event_id, unit_a, unit_b, arg_max(k, (round(c, 9), -k))::DOUBLE AS best_lag_sec, round(max(c), 6) AS max_corr FROM c GROUP BY 1, 2, 3",
    "group_centroids": f"WITH {PLACE}, g AS (SELECT (vec_id % 20)::INTEGER AS event_id, label AS frame, count(*) AS n, avg(x) AS cx, avg(y) AS cy, sqrt(var_pop(x) + var_pop(y)) AS rms FROM pl GROUP BY 1, 2) SELECT event_id, frame, n, dense_rank() OVER (PARTITION BY event_id ORDER BY frame)::INTEGER AS rank, round(cx, 6) AS cx, round(cy, 6) AS cy, round(rms, 6) AS rms FROM g",
    "zscore_flat": f"WITH {PLACE}, v AS (SELECT vec_id, label, CASE WHEN label % 2 = 0 THEN 3.0::DOUBLE ELSE x END AS x FROM pl) SELECT vec_id, round(CASE WHEN stddev_pop(x) OVER w > 0 THEN (x - avg(x) OVER w) / stddev_pop(x) OVER w ELSE 0 END, 6) AS z FROM v WINDOW w AS (PARTITION BY label)",
    "cluster_cut_counts": f"WITH {PLACE}, m AS (SELECT label, abs(x) AS h, max(abs(x)) OVER (PARTITION BY label) AS top FROM pl), c AS (SELECT label, i / 100.0::DOUBLE AS fraction, count(*) FILTER (h > i / 100.0::DOUBLE * top) + 1 AS n FROM m CROSS JOIN range(5, 91) r(i) GROUP BY label, i) SELECT label, fraction, n, fraction = coalesce(max(fraction) FILTER (n IN (4, 5)) OVER (PARTITION BY label), 0.9) AS chosen FROM c",
    "spearman_angle": f"WITH {PLACE}, s AS (SELECT label, a * 1.0::DOUBLE AS angle, t, round(x * cos(radians(a * 1.0::DOUBLE)) + y * sin(radians(a * 1.0::DOUBLE)), 9) AS s FROM pl CROSS JOIN range(360) r(a)), k AS (SELECT label, angle, rank() OVER (PARTITION BY label, angle ORDER BY s) + (count(*) OVER (PARTITION BY label, angle, s) - 1) / 2.0::DOUBLE AS rs, rank() OVER (PARTITION BY label, angle ORDER BY t) + (count(*) OVER (PARTITION BY label, angle, t) - 1) / 2.0::DOUBLE AS rt FROM s) SELECT label, angle, round(corr(rs, rt), 6) + 0.0 AS rho FROM k GROUP BY 1, 2",
    "pc_steps": f"WITH RECURSIVE {SERIES}, d AS (SELECT unit, frame, abs(value - lag(value) OVER (PARTITION BY unit ORDER BY frame)) AS d FROM series), m AS (SELECT unit, median(d) AS m FROM d GROUP BY unit), q AS (SELECT d.unit, any_value(m) AS m, median(abs(d - m)) AS a FROM d JOIN m USING (unit) GROUP BY d.unit), h AS (SELECT d.unit, frame FROM d JOIN q USING (unit) WHERE d > m + 2 * 1.4826 * a), k AS (SELECT unit, min(frame) AS frame FROM h GROUP BY unit UNION ALL SELECT k.unit, (SELECT min(h.frame) FROM h WHERE h.unit = k.unit AND h.frame - k.frame > 5) FROM k WHERE k.frame IS NOT NULL) SELECT unit, frame FROM k WHERE frame IS NOT NULL",
    "heatmap_scale": f"WITH {PIXELS}, e AS (SELECT frame, quantile_cont(v, 0.01) AS a, quantile_cont(v, 0.995) AS b FROM px GROUP BY frame), h AS (SELECT frame, CASE WHEN b > a THEN floor(greatest(0, least(1, (v - a) / (b - a))) * 255 + 0.5) ELSE 0 END AS heat FROM px JOIN e USING (frame)) SELECT frame, count(*) FILTER (heat = 255) AS n_high, count(*) FILTER (heat = 0) AS n_low FROM h GROUP BY frame",
    "qc_frame_stride": f"WITH {PIXELS}, s AS (SELECT * FROM px WHERE frame % 4 = 0), e AS (SELECT quantile_cont(v, 0.01) AS a, quantile_cont(v, 0.995) AS b FROM s) SELECT frame, count(*) AS n, count(*) FILTER (floor(greatest(0, least(1, (v - a) / (b - a))) * 255 + 0.5) = 255) AS n_high FROM s CROSS JOIN e GROUP BY frame",
    "shift_nonneg": f"WITH {PIXELS}, v AS (SELECT frame % 5 AS file, floor(v * 1000)::INTEGER AS v FROM px), s AS (SELECT file, greatest(-min(v), 0) AS s FROM v GROUP BY file) SELECT file, min(v + s) AS low, max(v + s) AS high, sum(v + s)::BIGINT AS total FROM v JOIN s USING (file) GROUP BY file",
    "scale_bar": "WITH r AS (SELECT p_partkey, p_retailprice * 0.2::DOUBLE AS r FROM part WHERE p_retailprice > 0), p AS (SELECT *, pow(10.0::DOUBLE, floor(log10(r))) AS p FROM r) SELECT p_partkey, round(p * CASE WHEN r / p < 1.5 THEN 1 WHEN r / p < 3.5 THEN 2 WHEN r / p < 7.5 THEN 5 ELSE 10 END, 6) AS bar FROM p",
    "indicator_tau": "WITH c AS (SELECT p_partkey, (p_size % 4 + 5)::VARCHAR || substr('fms', p_size % 3 + 1, 1) AS c FROM part) SELECT p_partkey, CASE c WHEN '6f' THEN 0.7 WHEN '6m' THEN 1.0 WHEN '6s' THEN 1.5 WHEN '7f' THEN 0.7 WHEN '8f' THEN 0.15 WHEN '8s' THEN 0.5 ELSE 0.25 END::DOUBLE AS tau FROM c",
    "fps_from_notes": "SELECT '2024-01-01_' || s_suppkey AS rec_id, CASE s_suppkey % 3 WHEN 0 THEN 30.0 WHEN 1 THEN 20.0 ELSE 15.07 END::DOUBLE AS fps FROM supplier",
    "rate_activation": "WITH s AS (SELECT l_returnflag AS rec_id, l_linenumber AS roi_id, l_shipdate::DATE - DATE '1995-01-01' AS day, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS v FROM lineitem GROUP BY 1, 2, 3), e AS (SELECT rec_id, min(day) AS a FROM s GROUP BY 1), f AS (SELECT s.rec_id, roi_id, day - a AS frame, v FROM s JOIN e USING (rec_id)) SELECT rec_id, i::INTEGER AS event_id, roi_id, round(min(frame) / 2.0::DOUBLE, 6) AS first_time_s FROM f JOIN range(30) r(i) ON frame >= i * 20 AND frame < i * 20 + 9 WHERE v > 1000 GROUP BY 1, 2, 3",
    "order_map": f"WITH {UNITS}, {WINDOWS}, {ACTIVE}, s AS (SELECT event_id, unit, CASE WHEN max(rank) OVER (PARTITION BY event_id) > 1 THEN (rank - 1) / (max(rank) OVER (PARTITION BY event_id) - 1)::DOUBLE ELSE 0 END AS v FROM rk), p AS (SELECT DISTINCT unit, event_id % 8 AS y, event_id % 4 AS x FROM units) SELECT s.event_id, y, x, round(sum(v * (y + 1.0::DOUBLE)) / sum(y + 1.0::DOUBLE), 6) AS image FROM s JOIN p USING (unit) GROUP BY 1, 2, 3",
}

ROWS_ONLY = ("detect_events", "cluster_correlation", "sign_flip", "spread_direction")
