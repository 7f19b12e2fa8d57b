"""Registered queries over the benchmark tables, and the SQL that checks each of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import scalars
from tracelake.operators import cells, events, images
from tracelake.operators import records as rec
from tracelake.operators import tables as ops
from tracelake.operators import traces
from tracelake.plans import chain, recordings, records, units
from tracelake.plans.common import PIXELS, ROBUST, SERIES, SIX, UNITS, WINDOWS
from tracelake.plans.common import pixels as _pixels
from tracelake.plans.common import r6 as _r
from tracelake.sources import drivers as src
from tracelake.sources import files


def onset_density(spark, d):
    u = src.units(spark, d)
    n = src.read(spark, d, "events").select("user_id").distinct().count()
    return ops.density(u, n, 3600.0).select("bin", "n", _r("rate"))


def density_smooth(spark, d):
    u = src.units(spark, d)
    return ops.smooth(ops.density(u, 1, 3600.0), 1.5).select("bin", _r("smooth"))


def _array(rows, order, value):
    return F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda p: p[value]).alias("x")


def density_rolling_pct(spark, d):
    """Rolling percentile of an hourly density with the defaults of event detection: 5 %, 201 bins, mirrored at the ends."""
    bins = ops.density(src.units(spark, d), 1, 3600.0)
    got = traces.rolling_percentile(bins.agg(F.min("bin").alias("first"), _array(bins, "bin", "rate")), 201, 5)
    return got.select("first", F.posexplode("base").alias("i", "base")).select((F.col("first") + F.col("i")).alias("bin"), _r("base"))


def density_noise(spark, d):
    return ops.quiet_noise(ops.density(src.units(spark, d), 1, 3600.0), "rate", ()).select(_r("noise"))


def activation_first_time(spark, d):
    return ops.activation(src.units(spark, d), src.windows(spark)).select("event_id", "unit", _r("first_time_s"))


def event_onsets_long(spark, d):
    j = ops.interval_join(src.units(spark, d).withColumnRenamed("event_id", "onset_id"), src.windows(spark))
    return j.select("event_id", "unit", "onset_id", _r(F.col("t") - F.col("start_s"), "rel_s"))


def activation_rank(spark, d):
    return ops.activation_rank(ops.activation(src.units(spark, d), src.windows(spark))).select("event_id", "unit", "rank")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Active units of each daily window and the first of them."""
    a = ops.activation(src.units(spark, d), src.windows(spark))
    return a.groupBy("event_id").agg(F.count("*").alias("n_active"), F.min_by("unit", F.struct("first_time_s", "unit")).alias("first_unit"))


def roi_event_times_wide(spark, d):
    r = ops.activation_rank(ops.activation(src.units(spark, d), src.windows(spark)))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "unit"))), lambda x: x["unit"].cast("string"))
    return r.groupBy("event_id").agg(F.count("*").alias("n"), F.array_join(ordered, ",").alias("units"))


def zscore_pop(spark, d):
    return ops.zscore(src.series(spark, d), ["unit"], "value").select("unit", "frame", _r("z"))


def robust_z(spark, d):
    return ops.robust_z(src.series(spark, d), ["unit"], "value").select("unit", "frame", _r("z"))


def hysteresis_onsets(spark, d):
    z = ops.robust_z(src.series(spark, d), ["unit"], "value").select("unit", "frame", "z")
    return ops.hysteresis(z, ["unit"], "frame", "z", 1.0, 0.0).select("unit", "frame")


def min_separation(spark, d):
    return ops.min_separation(src.units(spark, d), ["unit"], "t", 86400.0).select("unit", _r("t"))


def dff_first_n(spark, d):
    return ops.dff_first_n(src.series(spark, d), ["unit"], "frame", "value", 120).select("unit", "frame", _r("dff"))


def dff_rolling(spark, d):
    """dF/F of daily sums with the defaults: tenth percentile of 45 s at 15.07 frames a second, 679 frames."""
    rows = src.series(spark, d)
    got = traces.rolling_dff(rows.groupBy("unit").agg(_array(rows, "frame", "value")), 15.07)
    return got.select("unit", F.posexplode("dff").alias("frame", "dff")).select("unit", "frame", _r("dff"))


def neuropil_subtract(spark, d):
    return ops.subtract_neuropil(src.read(spark, d, "lineitem"), "l_extendedprice", "l_tax").select("l_orderkey", "l_linenumber", _r("f"))


def sg_derivative_interior(spark, d):
    return ops.savgol_interior(src.series(spark, d), ["unit"], "frame", "value", 2, 15.0).where("dt is not null").select("unit", "frame", _r("dt"))


def nan_interp(spark, d):
    gap = F.when(F.col("frame") % 7 != 3, F.col("value"))
    return ops.fill_missing(src.series(spark, d).withColumn("value", gap), ["unit"], "frame", "value").select("unit", "frame", _r("filled"))


def block_downsample(spark, d):
    return ops.downsample(src.series(spark, d), ["unit"], "frame", "value", 8).select("unit", "block", _r("mean"))


def minmax_rows(spark, d):
    e = src.read(spark, d, "embeddings").select("vec_id", F.expr("transform(embedding, x -> cast(x as double))").alias("e"))
    return rec.scale_rows(e, "e").select("vec_id", F.posexplode("e").alias("i", "s")).select("vec_id", "i", _r("s", "scaled"))


def derivative_raster(spark, d):
    """Steps of daily traces by line number that reach the default of 4."""
    t = src.traces(spark, d).select("rec_id", "roi_id", F.posexplode("x").alias("frame", "value"))
    return ops.spike_raster(t, ["rec_id", "roi_id"], "frame", "value")


def xcorr_best_lag(spark, d):
    x, n = recordings.equal_traces(spark, d)
    out = ops.best_lags(events.pair_curves(x, 10), 1.0)
    return out.select("unit_a", "unit_b", _r("best_lag_sec"), _r("max_corr"), _r("zero_lag_corr"), "leader")


def pair_enumeration(spark, d):
    n = src.read(spark, d, "nation").select(F.col("n_regionkey").alias("rec_id"), F.col("n_nationkey").alias("cluster_id"))
    return events.cluster_pairs(n).select(F.col("rec_id").alias("n_regionkey"), F.col("cluster_a").alias("a"), F.col("cluster_b").alias("b"), "is_self")


def bh_fdr(spark, d):
    p = src.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("g"), (F.expr("(o_orderkey * 7919) % 10007") / 10007.0).alias("p"))
    return ops.bh_fdr(p, "p", ["g"]).select("id", _r("q"))


def auroc(spark, d):
    j = src.read(spark, d, "labels").join(src.read(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return ops.auroc(j, "quality", "n_chars", grain=0.25).select(_r("auroc"))


def splat_weighted(spark, d):
    li = src.read(spark, d, "lineitem").select(F.col("l_returnflag").alias("rec_id"), (F.col("l_partkey") % 16).alias("y"), (F.col("l_suppkey") % 16).alias("x"), F.col("l_quantity").alias("v"), (F.col("l_discount") + 0.01).alias("w"))
    return ops.splat(li, "v", "w").select("rec_id", "y", "x", _r("image"))


def overlap_filter(spark, d):
    li = src.read(spark, d, "lineitem").select("l_returnflag", F.col("l_linenumber").alias("rec_id"), F.col("l_suppkey").alias("unit"), (F.col("l_partkey") % 50).alias("y"), (F.col("l_partkey") % 41).alias("x")).distinct()
    return ops.drop_overlapping(li.where("l_returnflag = 'A'"), li.where("l_returnflag = 'R' and y < 12"), 0.3).select("rec_id", "unit", _r("covered"))


def label_mask_to_rois(spark, d):
    li = src.read(spark, d, "lineitem").select(F.lit(0).alias("rec_id"), F.col("l_suppkey").alias("roi_id"), (F.col("l_partkey") % 64).alias("y"), (F.col("l_orderkey") % 64).alias("x"))
    return images.unit_rows(li).select(F.col("roi_id").alias("label"), "npix", F.col("y").alias("y_med"), F.col("x").alias("x_med"), _r("radius"))


def neighbour_corr(spark, d):
    return ops.neighbour_corr(_pixels(spark, d)).select("rec_id", "y", "x", _r("corr"))


def mean_image(spark, d):
    return images.mean_image(_pixels(spark, d)).select("rec_id", "y", "x", _r("mean"))


def median_trace(spark, d):
    return rec.group_trace(src.series(spark, d), "median").select("frame", _r("median"))


def mean_trace(spark, d):
    return rec.group_trace(src.series(spark, d), "mean").select("frame", _r("mean"))


def best_trace(spark, d):
    return rec.best_unit(src.read(spark, d, "customer"), ["c_nationkey"], "c_acctbal", "c_custkey")


def keep_mask(spark, d):
    j = src.read(spark, d, "documents").select("doc_id").join(src.read(spark, d, "labels"), "doc_id", "left")
    j = j.select("doc_id", F.when(F.col("toxic") == 1, F.lit(False)).alias("persisted"), (F.col("quality") == 1).alias("predicted"), F.lit(None).cast("double").alias("flag"))
    return ops.keep_mask(j, "persisted", "predicted", "flag").select("doc_id", "keep")


def semi_anti(spark, d):
    both = rec.against_mask(src.read(spark, d, "documents").select("doc_id", "source"), src.read(spark, d, "labels"), "doc_id")
    return both.groupBy("source").agg(F.count_if("known").alias("n_known"), F.count("*").alias("n"))


def dedup_last(spark, d):
    return ops.last_wins(src.read(spark, d, "conversations"), ["conv_id", "role"], "turn").select("conv_id", "role", "turn")


def roi_runs(spark, d):
    return ops.runs(src.read(spark, d, "orders").select("o_custkey", F.expr("o_orderkey % 40").alias("id")), "o_custkey", "id")


def roi_spec_parse(spark, d):
    n = src.read(spark, d, "nation").select("n_nationkey", F.expr("concat(n_nationkey + 3, '-', n_nationkey, ', ', n_nationkey * 2)").alias("spec"))
    return ops.parse_spec(n, "spec").select("n_nationkey", F.array_join("ids", ",").alias("ids"))


def euclid_pairs(spark, d):
    return traces.mean_distances(src.read(spark, d, "embeddings"), "label", "vec_id", "embedding").select("label", "n", F.round("mean_dist", 4).alias("mean_dist"))


def params_merge(spark, d):
    e = src.read(spark, d, "events").select(F.col("event_id").alias("rec_id"), F.get_json_object("props", "$.k").cast("double").alias("tau"))
    side = lambda tau: e.select("rec_id", F.expr("cast(map() as map<string,string>)").alias("params"), tau.alias("tau"), F.lit(1.0).alias("fs"))
    merged = files.merge_manifests(side(F.lit(-1.0)), side(F.col("tau")))
    return merged.select(F.col("rec_id").alias("event_id"), F.col("tau").cast("long").alias("merged"))


def report_pivot(spark, d):
    return rec.status_report(src.read(spark, d, "events"), "user_id", "event_type", ["click", "purchase", "view"])


def split_by_group(spark, d):
    docs = src.read(spark, d, "documents").select("source", "doc_id")
    return cells.split_recordings(docs, "source").select("source", "doc_id", "validation")


def um_per_px(spark, d):
    p = src.read(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 40, F.col("p_size") / 100.0).alias("direct"), (F.col("p_size") % 5).alias("zoom"))
    return p.select("p_partkey", _r(scalars.um_per_px("direct", "zoom", F.lit(512), F.lit(1.0)), "um"))


ORACLE = {
    "flagship": f"WITH {UNITS}, {WINDOWS}, a AS (SELECT w.event_id, unit, min(t) AS f FROM units JOIN w ON t BETWEEN start_s AND end_s GROUP BY 1, 2) SELECT event_id, count(*) AS n_active, arg_min(unit, (f, unit)) AS first_unit FROM a GROUP BY event_id",
    "onset_density": f"WITH {UNITS}, c AS (SELECT floor(t / 3600)::BIGINT AS bin, count(*) AS n FROM units GROUP BY 1), b AS (SELECT unnest(range((SELECT min(bin) FROM c), (SELECT max(bin) FROM c) + 1)) AS bin) SELECT b.bin, coalesce(n, 0) AS n, round(coalesce(n, 0) / (SELECT count(DISTINCT unit) FROM units)::DOUBLE, 6) AS rate FROM b LEFT JOIN c ON b.bin = c.bin",
    "density_smooth": f"WITH {UNITS}, c AS (SELECT floor(t / 3600)::BIGINT AS bin, count(*) AS n FROM units GROUP BY 1), e AS (SELECT min(bin) AS a, max(bin) AS z FROM c), b AS (SELECT unnest(range(a, z + 1)) AS bin FROM e), v AS (SELECT b.bin, coalesce(n, 0) AS n FROM b LEFT JOIN c ON b.bin = c.bin), k AS (SELECT j, exp(-0.5 * (j / 1.5) ** 2) AS g FROM range(-6, 7) r(j)) SELECT v.bin, round(sum(u.n * g) / (SELECT sum(g) FROM k), 6) AS smooth FROM v CROSS JOIN k CROSS JOIN e JOIN v u ON u.bin = least(greatest(v.bin + j, a), z) GROUP BY v.bin",
    "density_rolling_pct": f"WITH {UNITS}, c AS (SELECT floor(t / 3600)::BIGINT AS bin, count(*) AS n FROM units GROUP BY 1), e AS (SELECT min(bin) AS a, max(bin) AS z FROM c), b AS (SELECT unnest(range(a, z + 1)) AS bin FROM e), v AS (SELECT b.bin, coalesce(n, 0)::DOUBLE AS n FROM b LEFT JOIN c ON b.bin = c.bin), p AS (SELECT bin, n FROM v UNION ALL SELECT 2 * a - 1 - bin, n FROM v, e WHERE bin < a + 100 UNION ALL SELECT 2 * z + 1 - bin, n FROM v, e WHERE bin > z - 100), s AS (SELECT bin, list_sort(list(n) OVER (ORDER BY bin ROWS BETWEEN 100 PRECEDING AND 100 FOLLOWING))[11] AS base FROM p) SELECT bin, base FROM s, e WHERE bin BETWEEN a AND z",
    "density_noise": f"WITH {UNITS}, c AS (SELECT floor(t / 3600)::BIGINT AS bin, count(*) AS n FROM units GROUP BY 1), b AS (SELECT unnest(range((SELECT min(bin) FROM c), (SELECT max(bin) FROM c) + 1)) AS bin), v AS (SELECT coalesce(n, 0)::DOUBLE AS n FROM b LEFT JOIN c ON b.bin = c.bin), q AS (SELECT n FROM v WHERE n <= (SELECT quantile_cont(n, 0.4) FROM v)) SELECT round(median(abs(n - (SELECT median(n) FROM q))) * 1.4826, 6) AS noise FROM q",
    "activation_first_time": f"WITH {UNITS}, {WINDOWS} SELECT w.event_id, unit, round(min(t), 6) AS first_time_s FROM units JOIN w ON t BETWEEN start_s AND end_s GROUP BY 1, 2",
    "event_onsets_long": f"WITH {UNITS}, {WINDOWS} SELECT w.event_id, unit, units.event_id AS onset_id, round(t - start_s, 6) AS rel_s FROM units JOIN w ON t BETWEEN start_s AND end_s",
    "activation_rank": f"WITH {UNITS}, {WINDOWS}, a AS (SELECT w.event_id, unit, min(t) AS f FROM units JOIN w ON t BETWEEN start_s AND end_s GROUP BY 1, 2) SELECT event_id, unit, row_number() OVER (PARTITION BY event_id ORDER BY f, unit)::INTEGER AS rank FROM a",
    "roi_event_times_wide": f"WITH {UNITS}, {WINDOWS}, a AS (SELECT w.event_id, unit, min(t) AS f FROM units JOIN w ON t BETWEEN start_s AND end_s GROUP BY 1, 2) SELECT event_id, count(*) AS n, string_agg(unit::VARCHAR, ',' ORDER BY f, unit) AS units FROM a GROUP BY event_id",
    "zscore_pop": f"WITH {SERIES} SELECT unit, frame, round((value - avg(value) OVER w) / stddev_pop(value) OVER w, 6) AS z FROM series WINDOW w AS (PARTITION BY unit)",
    "robust_z": f"WITH {SERIES}, {ROBUST} SELECT unit, frame, round(z, 6) AS z FROM rz",
    "hysteresis_onsets": f"WITH {SERIES}, {ROBUST}, s AS (SELECT *, coalesce(last_value(CASE WHEN z >= 1 THEN 1 WHEN z <= 0 THEN 0 END IGNORE NULLS) OVER (PARTITION BY unit ORDER BY frame ROWS UNBOUNDED PRECEDING), 0) AS o FROM rz), l AS (SELECT *, coalesce(lag(o) OVER (PARTITION BY unit ORDER BY frame), 0) AS b FROM s) SELECT unit, frame FROM l WHERE o = 1 AND b = 0",
    "min_separation": f"WITH RECURSIVE {UNITS}, k AS (SELECT unit, min(t) AS t FROM units GROUP BY unit UNION ALL SELECT k.unit, (SELECT min(u.t) FROM units u WHERE u.unit = k.unit AND u.t - k.t >= 86400) FROM k WHERE k.t IS NOT NULL) SELECT unit, round(t, 6) AS t FROM k WHERE t IS NOT NULL",
    "dff_first_n": f"WITH {SERIES}, b AS (SELECT *, avg(value) FILTER (frame < 120) OVER (PARTITION BY unit) AS m FROM series) SELECT unit, frame, round((value - m) / greatest(m, 1e-9), 6) AS dff FROM b",
    "dff_rolling": f"WITH {SERIES}, n AS (SELECT unit, max(frame) AS z FROM series GROUP BY unit), p AS (SELECT unit, frame, value FROM series UNION ALL SELECT unit, -i, value FROM series, range(1, 340) r(i) WHERE frame = 0 UNION ALL SELECT s.unit, z + i, value FROM series s JOIN n ON n.unit = s.unit AND s.frame = z, range(1, 340) r(i)), b AS (SELECT unit, frame, value, list_sort(list(value) OVER (PARTITION BY unit ORDER BY frame ROWS BETWEEN 339 PRECEDING AND 339 FOLLOWING))[68] AS base FROM p), k AS (SELECT b.* FROM b JOIN n ON n.unit = b.unit AND frame BETWEEN 0 AND z), q AS (SELECT unit, quantile_cont(base, 0.01) AS q FROM k GROUP BY unit) SELECT unit, frame::INTEGER AS frame, round((value - base) / greatest(base, CASE WHEN q > 0 THEN q ELSE 1e-9 END), 6) AS dff FROM k JOIN q USING (unit)",
    "neuropil_subtract": "SELECT l_orderkey, l_linenumber, round(l_extendedprice - 0.7::DOUBLE * l_tax, 6) AS f FROM lineitem",
    "sg_derivative_interior": f"WITH {SERIES}, s AS (SELECT unit, frame, ((lead(value, 1) OVER w - lag(value, 1) OVER w) * 1 + (lead(value, 2) OVER w - lag(value, 2) OVER w) * 2) * (15.0 / 10) AS dt FROM series WINDOW w AS (PARTITION BY unit ORDER BY frame)) SELECT unit, frame, round(dt, 6) AS dt FROM s WHERE dt IS NOT NULL",
    "nan_interp": f"WITH {SERIES}, g AS (SELECT unit, frame, CASE WHEN frame % 7 <> 3 THEN value END AS v FROM series), k AS (SELECT * FROM g WHERE v IS NOT NULL), j AS (SELECT g.unit, g.frame, g.v, a.frame AS f0, a.v AS v0, b.frame AS f1, b.v AS v1 FROM g ASOF LEFT JOIN k a ON a.unit = g.unit AND a.frame <= g.frame ASOF LEFT JOIN k b ON b.unit = g.unit AND b.frame >= g.frame) SELECT unit, frame, round(CASE WHEN f0 IS NULL THEN v1 WHEN f1 IS NULL OR f0 = f1 THEN v0 ELSE v0 + (v1 - v0) * (frame - f0) / (f1 - f0) END, 6) AS filled FROM j",
    "block_downsample": f"WITH {SERIES} SELECT unit, frame // 8 AS block, round(avg(value), 6) AS mean FROM series GROUP BY 1, 2 HAVING count(*) = 8",
    "minmax_rows": "SELECT vec_id, i, round(CASE WHEN list_max(e) > list_min(e) THEN (e[i + 1] - list_min(e)) / (list_max(e) - list_min(e)) ELSE 0 END, 6) AS scaled FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), range(64) r(i)",
    "derivative_raster": f"WITH {chain.TRACES}, d AS (SELECT rec_id, roi_id, frame, x - lag(x) OVER (PARTITION BY rec_id, roi_id ORDER BY frame) AS v FROM tr), e AS (SELECT * FROM d WHERE v IS NOT NULL), m AS (SELECT rec_id, roi_id, median(v) AS m FROM e GROUP BY 1, 2), a AS (SELECT e.rec_id, e.roi_id, any_value(m) AS m, median(abs(v - m)) AS d FROM e JOIN m USING (rec_id, roi_id) GROUP BY 1, 2) SELECT e.rec_id, e.roi_id, frame::INTEGER AS frame FROM e JOIN a USING (rec_id, roi_id) WHERE (v - m) / (1.4826 * (d + 1e-12)) >= 4",
    "xcorr_best_lag": f"WITH {SERIES}, n AS (SELECT min(c) AS n FROM (SELECT count(*) AS c FROM series GROUP BY unit)), s AS (SELECT * FROM series WHERE frame < (SELECT n FROM n)), z AS (SELECT unit, frame, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS z FROM s WINDOW w AS (PARTITION BY unit)), c AS (SELECT a.unit AS unit_a, b.unit AS unit_b, k, sum(a.z * b.z) / (SELECT n FROM n) AS c FROM z b CROSS JOIN range(-10, 11) r(k) JOIN z a ON a.frame = b.frame + k GROUP BY 1, 2, 3), m AS (SELECT unit_a, unit_b, arg_max(k, (round(c, 9), -k)) AS k, max(c) AS m, max(c) FILTER (k = 0) AS z FROM c GROUP BY 1, 2) SELECT unit_a, unit_b, k::DOUBLE AS best_lag_sec, round(m, 6) AS max_corr, round(z, 6) AS zero_lag_corr, CASE WHEN k < 0 THEN 'A' WHEN k > 0 THEN 'B' ELSE 'none' END AS leader FROM m",
    "pair_enumeration": "SELECT a.n_regionkey, a.n_nationkey AS a, b.n_nationkey AS b, a.n_nationkey = b.n_nationkey AS is_self FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <= b.n_nationkey",
    "bh_fdr": "WITH p AS (SELECT o_orderkey AS id, o_orderstatus AS g, ((o_orderkey * 7919) % 10007) / 10007.0::DOUBLE AS p FROM orders), r AS (SELECT *, p * count(*) OVER (PARTITION BY g) / row_number() OVER (PARTITION BY g ORDER BY p, id) AS q FROM p) SELECT id, round(least(1.0, min(q) OVER (PARTITION BY g ORDER BY p, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM r",
    "auroc": "WITH j AS (SELECT quality, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0::DOUBLE AS r FROM labels JOIN documents USING (doc_id)), s AS (SELECT sum(r) FILTER (quality = 1) AS r, count(*) FILTER (quality = 1) AS p, count(*) AS n FROM j) SELECT round((r - p * (p + 1) / 2.0::DOUBLE) / (p * (n - p)), 6) AS auroc FROM s",
    "splat_weighted": "SELECT l_returnflag AS rec_id, l_partkey % 16 AS y, l_suppkey % 16 AS x, round(sum(l_quantity * (l_discount + 0.01::DOUBLE)) / sum(l_discount + 0.01::DOUBLE), 6) AS image FROM lineitem GROUP BY 1, 2, 3",
    "overlap_filter": "WITH l AS (SELECT DISTINCT l_returnflag AS f, l_linenumber AS rec_id, l_suppkey AS unit, l_partkey % 50 AS y, l_partkey % 41 AS x FROM lineitem), p AS (SELECT DISTINCT rec_id, y, x FROM l WHERE f = 'R' AND y < 12) SELECT l.rec_id, unit, round(avg(CASE WHEN p.y IS NULL THEN 0.0 ELSE 1.0 END), 6) AS covered FROM l LEFT JOIN p ON p.rec_id = l.rec_id AND p.y = l.y AND p.x = l.x WHERE f = 'A' GROUP BY 1, 2 HAVING avg(CASE WHEN p.y IS NULL THEN 0.0 ELSE 1.0 END) < 0.3",
    "label_mask_to_rois": "SELECT l_suppkey AS label, count(*) AS npix, median(l_partkey % 64) AS y_med, median(l_orderkey % 64) AS x_med, round(sqrt(count(*) / 3.141592653589793::DOUBLE), 6) AS radius FROM lineitem GROUP BY 1",
    "neighbour_corr": f"WITH {PIXELS}, w AS (SELECT p.frame, p.y, p.x, any_value(p.v) AS v, avg(q.v) AS w, any_value(p.rec_id) AS rec_id FROM px p JOIN px q ON p.frame = q.frame AND abs(p.y - q.y) + abs(p.x - q.x) = 1 GROUP BY 1, 2, 3) SELECT rec_id, y, x, round(corr(v, w), 6) AS corr FROM w GROUP BY rec_id, y, x",
    "mean_image": f"WITH {PIXELS} SELECT rec_id, y, x, round(avg(v), 6) AS mean FROM px GROUP BY rec_id, y, x",
    "median_trace": f"WITH {SERIES} SELECT frame, round(median(value), 6) AS median FROM series GROUP BY frame",
    "mean_trace": f"WITH {SERIES} SELECT frame, round(avg(value), 6) AS mean FROM series GROUP BY frame",
    "best_trace": "SELECT c_nationkey, arg_max(c_custkey, (c_acctbal, c_custkey)) AS best FROM customer GROUP BY 1",
    "keep_mask": "SELECT d.doc_id, coalesce(CASE WHEN toxic = 1 THEN false END, quality = 1, true) AS keep FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
    "semi_anti": "SELECT source, count(l.doc_id) AS n_known, count(*) AS n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY source",
    "dedup_last": "SELECT conv_id, role, max(turn) AS turn FROM conversations GROUP BY 1, 2",
    "roi_runs": "WITH g AS (SELECT DISTINCT o_custkey, o_orderkey % 40 AS id FROM orders), i AS (SELECT *, id - row_number() OVER (PARTITION BY o_custkey ORDER BY id) AS g FROM g), e AS (SELECT o_custkey, min(id) AS a, max(id) AS b FROM i GROUP BY o_custkey, g) SELECT o_custkey, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ',' ORDER BY a) AS runs FROM e GROUP BY o_custkey",
    "roi_spec_parse": "SELECT n_nationkey, array_to_string(list_sort(list_distinct(list_concat(range(n_nationkey, n_nationkey + 4), [n_nationkey * 2]))), ',') AS ids FROM nation",
    "euclid_pairs": "WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings) SELECT a.label, count(*) AS n, round(avg(list_distance(a.e, b.e)), 4) AS mean_dist FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1",
    "params_merge": "SELECT event_id, coalesce(nullif((props::JSON->>'k')::BIGINT, 0), -1) AS merged FROM events",
    "report_pivot": "SELECT user_id, count(*) FILTER (event_type = 'click') AS n_click, count(*) FILTER (event_type = 'purchase') AS n_purchase, count(*) FILTER (event_type = 'view') AS n_view FROM events GROUP BY 1",
    "split_by_group": "WITH g AS (SELECT source, row_number() OVER (ORDER BY md5('0:' || source), source) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents)) SELECT source, doc_id, r <= greatest(1, round_even(n * 0.2, 0)) AS validation FROM documents JOIN g USING (source)",
    "um_per_px": "SELECT p_partkey, round(coalesce(CASE WHEN p_size > 40 THEN p_size / 100.0::DOUBLE END, 3080.90169::DOUBLE / nullif(p_size % 5, 0) / 512.0::DOUBLE, 1.0), 6) AS um FROM part",
}


def queries() -> dict:
    own = {name: globals()[name] for name in ORACLE}
    own |= {name: getattr(module, name) for module in (chain, records, units) for name in (*module.ORACLE, *getattr(module, "ROWS_ONLY", ()))}
    return own | {name: getattr(recordings, name) for name in (*recordings.ORACLE, *recordings.ROWS_ONLY)}


def oracle_sql() -> dict:
    return ORACLE | recordings.ORACLE | records.ORACLE | chain.ORACLE | units.ORACLE
