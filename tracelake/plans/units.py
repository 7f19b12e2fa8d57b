"""Queries of statistics over units, images and bundles, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.kernels import network
from tracelake.operators import cells, events, images, tables
from tracelake.operators import records as rec
from tracelake.plans.chain import TRACES
from tracelake.plans.common import PIXELS, SERIES, pixels, r6
from tracelake.sources import bundle, shared
from tracelake.sources import drivers as src


def price_histogram(spark, d):
    """Prices from 0 to 100 000 in 40 closed bins by status; what lies outside is left out."""
    return tables.histogram(src.read(spark, d, "orders"), "o_totalprice", 0.0, 100_000.0, 40, ("o_orderstatus",))


def sign_flip_exact(spark, d):
    """Balances of ten customers each against all their sign patterns."""
    c = src.read(spark, d, "customer").select(F.expr("c_custkey div 10").alias("g"), (F.col("c_acctbal") - 4000).alias("v"))
    return events.marked(events.sign_flip(c, ["g"], "v", None)).select("g", "n", r6("mean"), r6("p_value"), "marker")


def _spread(spark, d):
    """Vectors as units on a plane: recordings by label, events by id."""
    e = src.read(spark, d, "embeddings")
    p = e.select((F.col("label") % 3).cast("string").alias("rec_id"), (F.col("vec_id") % 12).cast("int").alias("event_id"), F.col("vec_id").cast("int").alias("roi_id"), *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyt")))
    return p.select("rec_id", "event_id", "roi_id", F.abs("t").alias("first_time_s")), p.select("rec_id", "roi_id", "x", "y")


def spread_angle(spark, d):
    """Direction of spread of every event and its rank correlation, times in frames of 10 ms; no shuffles."""
    active, feet = _spread(spark, d)
    got = events.spread(active, feet, 100.0, shuffles=0)
    return got.select("rec_id", "event_id", F.round(F.degrees("theta"), 6).alias("theta_deg"), r6("rho"))


def sheet_monotonicity(spark, d):
    active, feet = _spread(spark, d)
    windows = active.select("rec_id", "event_id").distinct().select("rec_id", "event_id", F.col("event_id").cast("double").alias("start_s"), (F.col("event_id") + 0.5).alias("end_s"))
    windows = windows.unionByName(windows.where("event_id = 0").withColumns({"event_id": F.lit(99), "start_s": F.lit(99.0), "end_s": F.lit(100.0)}))
    onsets = active.select("rec_id", "roi_id", (F.col("event_id") + F.least("first_time_s", F.lit(0.5))).alias("t"))
    units = active.select("rec_id", "roi_id").distinct().withColumn("keep", F.lit(True))
    clusters = units.select("rec_id", "roi_id", F.lit(1).alias("cluster_id"))
    sheets = rec.recording_sheets(units.select("rec_id").distinct().withColumn("fps", F.lit(100.0)), units, windows, onsets, clusters, events.spread(active, feet, 100.0, shuffles=0))
    return sheets["EventMonotonicity"].select("rec_id", "event_id", "n_active", r6("theta_deg"), r6("rho"))


def trace_manual_set(spark, d):
    """Mean over a set of units named by hand: line numbers of each flag."""
    t = src.traces(spark, d).select("rec_id", "roi_id", F.posexplode("x").alias("frame", "value"))
    chosen = spark.createDataFrame([("A", 1), ("A", 3), ("N", 2), ("R", 9)], "rec_id string, roi_id int")
    return rec.group_trace(t, "mean", ("rec_id",), units=chosen).select("rec_id", "frame", r6("mean"))


def pair_curve_event_crop(spark, d):
    """Curves of all pairs of units within windows of 40 days, 60 apart, lags up to 9 days."""
    t = src.traces(spark, d).withColumnRenamed("roi_id", "unit")
    w = t.select("rec_id").distinct().select("rec_id", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("event_id"))
    w = w.select("rec_id", "event_id", (F.col("event_id") * 60.0).alias("start_s"), (F.col("event_id") * 60.0 + 40.0).alias("end_s"))
    got = events.pair_curves(events.crop(t, w, 1.0), 9, ("rec_id", "event_id"), block=3)
    return got.select("rec_id", "event_id", "unit_a", "unit_b", "k", (F.round("c", 6) + 0.0).alias("corr"))


def trace_source(spark, d):
    """Samples of the chosen trace: rates of each unit."""
    t = src.traces(spark, d).withColumnRenamed("x", "spks").withColumn("f", F.lit(None))
    return events.trace_source(t, "rates").select("rec_id", "roi_id", F.posexplode("x").alias("frame", "x")).where("x > 0")


def mask_difference(spark, d):
    """Customers without an urgent order: ids of one mask that another lacks."""
    c = src.read(spark, d, "customer").select("c_nationkey", F.col("c_custkey").alias("roi_id"))
    return tables.difference(c, src.read(spark, d, "orders").where("o_orderpriority like '1%'").select(F.col("o_custkey").alias("roi_id")), ["roi_id"])


def neighbour_corr_kept(spark, d):
    """The correlation image from kept sums: files come in two goes, and the second reads only what is new."""
    px = pixels(spark, d).withColumn("path", F.concat(F.lit("part-"), (F.col("frame") % 4).cast("string")))
    files = px.select("rec_id", "path").distinct().withColumn("sha256", F.sha2(F.concat("rec_id", "path"), 256))
    state = shared.new_path(spark)
    read = lambda some: px.join(F.broadcast(some.select("rec_id", "path")), ["rec_id", "path"], "left_semi")
    images.add_to_sums(state, files.where("path != 'part-3'"), read)
    images.add_to_sums(state, files, read)
    return images.corr_of_state(spark, state, files).select("rec_id", "y", "x", r6("corr"))


def frame_resize(spark, d):
    """Frames of 8 x 8 drawn to 3 x 5 by area."""
    return images.resize(pixels(spark, d), (8, 8), (3, 5)).select("rec_id", "frame", "y", "x", r6("v"))


def _bundle(spark, d):
    li = src.read(spark, d, "lineitem")
    px = F.array_sort(F.collect_list(F.struct(F.col("l_orderkey"), F.col("l_linenumber"), (F.col("l_partkey") % 64).cast("int").alias("y"), (F.col("l_orderkey") % 64).cast("int").alias("x"), F.col("l_quantity").alias("w"))))
    units = li.groupBy(F.col("l_returnflag").alias("rec_id"), F.col("l_suppkey").cast("int").alias("roi_id")).agg(px.alias("_p"))
    units = units.select("rec_id", "roi_id", *(F.transform("_p", part).alias(n) for n, part in (("ypix", lambda p: p["y"]), ("xpix", lambda p: p["x"]), ("lam", lambda p: p["w"]))))
    traces = units.select("rec_id", "roi_id", F.lit("lam").alias("name"), F.col("lam").alias("x"))
    o = li.select(F.col("l_returnflag").alias("rec_id"), (F.col("l_orderkey") % 500).cast("int").alias("event_id"), F.col("l_suppkey").cast("int").alias("roi_id"))
    intervals = o.groupBy("rec_id", "event_id").agg(F.array_sort(F.collect_set("roi_id")).alias("roi_ids"))
    intervals = intervals.select("rec_id", "event_id", F.col("event_id").cast("double").alias("start_s"), (F.col("event_id") + 1.0).alias("end_s"), "roi_ids")
    path = shared.new_path(spark)
    bundle.write(path, units, traces, intervals)
    return bundle.read(spark, path)


def bundle_footprints(spark, d):
    """Footprints of units, written as a bundle and read back."""
    u = _bundle(spark, d)["units"].select("rec_id", "roi_id", F.posexplode(F.arrays_zip("ypix", "xpix", "lam")).alias("i", "p"))
    return u.select("rec_id", "roi_id", "i", F.col("p.ypix").alias("y"), F.col("p.xpix").alias("x"), F.col("p.lam").alias("w"))


def bundle_intervals(spark, d):
    """Intervals and their units, written as a bundle and read back."""
    return _bundle(spark, d)["intervals"].select("rec_id", "event_id", "start_s", "end_s", F.array_join("roi_ids", ",").alias("roi_ids"))


def detection_ingest(spark, d):
    """Units of two detectors as one set: counts and places of what is kept."""
    li = src.read(spark, d, "lineitem").select(F.col("l_returnflag").alias("rec_id"), F.col("l_suppkey").cast("int").alias("roi_id"), (F.col("l_partkey") % 40 - 4).cast("int").alias("y"), (F.col("l_orderkey") % 40 - 4).cast("int").alias("x"), F.col("l_quantity").alias("w"))
    px = li.groupBy("rec_id", "roi_id", "y", "x").agg(F.max("w").alias("w"))
    rois = px.groupBy("rec_id", "roi_id").agg(F.collect_list(F.struct("y", "x", "w")).alias("_p")).select("rec_id", "roi_id", *(F.transform("_p", f).alias(n) for n, f in (("ypix", lambda p: p["y"]), ("xpix", lambda p: p["x"]), ("lam", lambda p: p["w"]))))
    recs = px.select("rec_id").distinct().select("rec_id", F.lit(32).alias("height"), F.lit(30).alias("width"))
    got = images.ingest(recs, [("wide", rois.where("roi_id % 3 = 0")), ("soma", rois.where("roi_id % 3 = 1")), ("rest", rois.where("roi_id % 3 = 2"))], 0.5)
    weight = got["pixels"].groupBy("rec_id", "roi_id").agg(F.sum("w").alias("weight"))
    return got["units"].join(weight, ["rec_id", "roi_id"]).select("rec_id", "roi_id", "source", "npix", r6("y"), r6("x"), r6("radius"), r6("weight"))


def cell_network(spark, d):
    """Scores by a network of two branches, image 8 x 8 and trace: cells are vectors with a bright middle; and the area under the curve of the quarter that is held out."""
    e = src.read(spark, d, "embeddings").select(F.col("label").cast("string").alias("rec_id"), F.col("vec_id").cast("int").alias("roi_id"), F.transform("embedding", lambda v: v.cast("double") * 8).alias("patch"))
    e = e.withColumn("label", F.expr("cast(patch[27] + patch[28] + patch[35] + patch[36] > 0 as int)"))
    rows = e.withColumns({"trace": F.col("patch"), "validation": F.col("roi_id") % 4 == 0})
    shape = network.Shape(channels=1, size=8, spatial=(8, 16), temporal=(8, 16), width=5, embed=16, dense=16)
    model = cells.fit_network(rows, shape, epochs=12, rate=5e-3)
    scored = cells.score(rows, model).join(rows.select("roi_id", "label", "validation"), "roi_id")
    area = tables.auroc(scored.where("validation"), "label", "p_cell")
    return scored.crossJoin(F.broadcast(area)).select("rec_id", "roi_id", "label", "validation", r6("p_cell"), "keep", r6("auroc"))


_SPREAD = "pl AS (SELECT (label % 3)::VARCHAR AS rec_id, (vec_id % 12)::INTEGER AS event_id, vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, round_even(abs(embedding[3]::DOUBLE) * 100, 0) AS t, abs(embedding[3]::DOUBLE) AS s FROM embeddings), sa AS (SELECT rec_id, event_id, a, t, round(x * cos(a * 2 * pi() / 360) + y * sin(a * 2 * pi() / 360), 9) AS s FROM pl CROSS JOIN range(360) r(a)), sr AS (SELECT rec_id, event_id, a, rank() OVER (PARTITION BY rec_id, event_id, a ORDER BY s) + (count(*) OVER (PARTITION BY rec_id, event_id, a, s) - 1) / 2.0::DOUBLE AS rs, rank() OVER (PARTITION BY rec_id, event_id, a ORDER BY t) + (count(*) OVER (PARTITION BY rec_id, event_id, a, t) - 1) / 2.0::DOUBLE AS rt FROM sa), sc AS (SELECT rec_id, event_id, a, corr(rs, rt) AS rho FROM sr GROUP BY 1, 2, 3), sb AS (SELECT rec_id, event_id, arg_max(a, (round(rho, 12), -a)) AS a, max(rho) AS rho FROM sc GROUP BY 1, 2)"
_CORR = f"WITH {PIXELS}, w AS (SELECT p.frame, p.y, p.x, any_value(p.v) AS v, avg(q.v) AS w, any_value(p.rec_id) AS rec_id FROM px p JOIN px q ON p.frame = q.frame AND abs(p.y - q.y) + abs(p.x - q.x) = 1 GROUP BY 1, 2, 3) SELECT rec_id, y, x, round(corr(v, w), 6) AS corr FROM w GROUP BY rec_id, y, x"

ORACLE = {
    "price_histogram": "WITH h AS (SELECT o_orderstatus, least(39, floor((o_totalprice - 0) / 2500.0::DOUBLE))::INTEGER AS bin, count(*) AS n FROM orders WHERE o_totalprice BETWEEN 0 AND 100000 GROUP BY 1, 2) SELECT s.o_orderstatus, b.bin::INTEGER AS bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT o_orderstatus FROM orders) s CROSS JOIN range(40) b(bin) LEFT JOIN h ON h.o_orderstatus = s.o_orderstatus AND h.bin = b.bin",
    "sign_flip_exact": "WITH c AS (SELECT c_custkey // 10 AS g, list(c_acctbal - 4000 ORDER BY c_custkey) AS v FROM customer GROUP BY 1), s AS (SELECT g, v, list_sum(list_transform(v, lambda x, i: CASE WHEN (k >> (i - 1)) & 1 = 1 THEN -x ELSE x END)) AS s FROM c CROSS JOIN LATERAL (SELECT unnest(range((1 << len(v))::BIGINT)) AS k)), p AS (SELECT g, any_value(len(v)) AS n, any_value(list_avg(v)) AS m, avg((abs(s) >= abs(list_sum(v)) * (1 - 1e-12))::INTEGER) AS p FROM s GROUP BY g) SELECT g, n::BIGINT AS n, round(m, 6) AS mean, round(p, 6) AS p_value, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'n.s.' END AS marker FROM p",
    "spread_angle": f"WITH {_SPREAD} SELECT rec_id, event_id, a::DOUBLE AS theta_deg, round(rho, 6) AS rho FROM sb",
    "sheet_monotonicity": f"WITH {_SPREAD}, ac AS (SELECT rec_id, event_id, count(DISTINCT vec_id) AS n FROM pl GROUP BY 1, 2) SELECT ac.rec_id, ac.event_id, n AS n_active, a::DOUBLE AS theta_deg, round(rho, 6) AS rho FROM ac JOIN sb ON sb.rec_id = ac.rec_id AND sb.event_id = ac.event_id UNION ALL SELECT DISTINCT rec_id, 99, 0, NULL, NULL FROM pl WHERE event_id = 0",
    "trace_manual_set": f"WITH {TRACES} SELECT rec_id, frame::INTEGER AS frame, round(avg(x), 6) AS mean FROM tr WHERE (rec_id, roi_id) IN (('A', 1), ('A', 3), ('N', 2)) GROUP BY 1, 2",
    "pair_curve_event_crop": f"WITH {TRACES}, ev AS (SELECT rec_id, roi_id, i::INTEGER AS event_id, frame, x FROM tr JOIN range(40) r(i) ON frame >= i * 60 AND frame < i * 60 + 40), zl AS (SELECT rec_id, roi_id, event_id, count(*) AS n, list(CASE WHEN s > 0 THEN (x - m) / s ELSE 0 END ORDER BY frame) AS z FROM (SELECT *, avg(x) OVER w AS m, stddev_pop(x) OVER w AS s FROM ev WINDOW w AS (PARTITION BY rec_id, roi_id, event_id)) GROUP BY 1, 2, 3) SELECT a.rec_id, a.event_id, a.roi_id AS unit_a, b.roi_id AS unit_b, k::INTEGER AS k, round(list_inner_product(a.z[1 + greatest(k, 0) : a.n + least(k, 0)], b.z[1 + greatest(-k, 0) : a.n - greatest(k, 0)]) / a.n, 6) + 0.0 AS corr FROM zl a JOIN zl b ON a.rec_id = b.rec_id AND a.event_id = b.event_id CROSS JOIN range(-9, 10) r(k)",
    "trace_source": f"WITH {TRACES} SELECT rec_id, roi_id, frame::INTEGER AS frame, x FROM tr WHERE x > 0",
    "mask_difference": "SELECT c_nationkey, c_custkey AS roi_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')",
    "neighbour_corr_kept": _CORR,
    "frame_resize": f"WITH {PIXELS}, yw AS (SELECT t, s, (least((t + 1) * 8 / 3.0::DOUBLE, s + 1) - greatest(t * 8 / 3.0::DOUBLE, s)) * 3 / 8.0::DOUBLE AS w FROM range(3) a(t), range(8) b(s)), xw AS (SELECT t, s, (least((t + 1) * 8 / 5.0::DOUBLE, s + 1) - greatest(t * 8 / 5.0::DOUBLE, s)) * 5 / 8.0::DOUBLE AS w FROM range(5) a(t), range(8) b(s)) SELECT rec_id, frame, yw.t::INTEGER AS y, xw.t::INTEGER AS x, round(sum(v * yw.w * xw.w), 6) AS v FROM px JOIN yw ON yw.s = px.y AND yw.w > 1e-12 JOIN xw ON xw.s = px.x AND xw.w > 1e-12 GROUP BY 1, 2, 3, 4",
    "bundle_footprints": "SELECT l_returnflag AS rec_id, l_suppkey::INTEGER AS roi_id, (row_number() OVER (PARTITION BY l_returnflag, l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey % 64, l_quantity) - 1)::INTEGER AS i, (l_partkey % 64)::INTEGER AS y, (l_orderkey % 64)::INTEGER AS x, l_quantity AS w FROM lineitem",
    "bundle_intervals": "WITH e AS (SELECT l_returnflag AS rec_id, (l_orderkey % 500)::INTEGER AS event_id, array_to_string(list_sort(list(DISTINCT l_suppkey)), ',') AS roi_ids FROM lineitem GROUP BY 1, 2) SELECT rec_id, event_id, event_id::DOUBLE AS start_s, event_id + 1.0::DOUBLE AS end_s, roi_ids FROM e",
    "detection_ingest": "WITH px AS (SELECT l_returnflag AS rec_id, l_suppkey::INTEGER AS roi_id, l_partkey % 40 - 4 AS y, l_orderkey % 40 - 4 AS x, max(l_quantity) AS w FROM lineitem GROUP BY 1, 2, 3, 4), ok AS (SELECT *, roi_id % 3 AS pass FROM px WHERE y BETWEEN 0 AND 31 AND x BETWEEN 0 AND 29), hit AS (SELECT DISTINCT rec_id, y, x FROM ok WHERE pass = 0), sh AS (SELECT ok.rec_id, ok.roi_id FROM ok LEFT JOIN hit ON hit.rec_id = ok.rec_id AND hit.y = ok.y AND hit.x = ok.x WHERE pass > 0 GROUP BY 1, 2 HAVING avg((hit.y IS NOT NULL)::INTEGER) < 0.5), k AS (SELECT * FROM ok WHERE pass = 0 OR (rec_id, roi_id) IN (SELECT (rec_id, roi_id) FROM sh)), u AS (SELECT rec_id, pass, roi_id, count(*) AS npix, median(y) AS y, median(x) AS x, sum(w) AS weight FROM k GROUP BY 1, 2, 3) SELECT rec_id, (row_number() OVER (PARTITION BY rec_id ORDER BY pass, roi_id) - 1)::INTEGER AS roi_id, ['wide', 'soma', 'rest'][pass + 1] AS source, npix, round(y, 6) AS y, round(x, 6) AS x, round(sqrt(npix / pi()), 6) AS radius, round(weight, 6) AS weight FROM u",
}

ROWS_ONLY = ("cell_network",)
