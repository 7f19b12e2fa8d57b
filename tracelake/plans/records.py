"""Queries of the records around a recording (settings, sheets, picks, edits) and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelake.functions import scalars
from tracelake.operators import cells, images
from tracelake.operators import records as ops
from tracelake.operators import settings as st
from tracelake.plans.common import PIXELS, SERIES, pixels, r6
from tracelake.sources import drivers as src
from tracelake.sources import files


def _settings(spark, d):
    """Settings of each part as JSON text: four levels, with every kind of value, and some parts without any."""
    text = F.format_string('{"detection":{"threshold":%d,"deep":{"level":%d,"inner":{"on":%s,"list":[%d,"x",{"y":null}],"none":null,"gain":%d.5}}},"fs":"%s","empty":{}}', "p_size", F.col("p_size") % 7, (F.col("p_size") % 2 == 0).cast("string"), "p_size", F.col("p_size") - 25, "p_brand")
    text = F.when(F.col("p_size") % 11 == 0, F.when(F.col("p_size") % 2 == 0, "no {json").otherwise(F.lit(None))).otherwise(text)
    # A table of few bytes a row is few tasks' input, while its texts are much work.
    parts = src.read(spark, d, "part").select("p_partkey", "p_size", "p_brand").repartition("p_partkey")
    return parts.select(F.col("p_partkey").alias("rec"), text.alias("settings"), "p_size")


def settings_flatten(spark, d):
    return st.as_text(st.flatten(_settings(spark, d), ["rec"], "settings")).select("rec", "path", "value", F.col("group").alias("grp"))


OVERLAY = {0: '{"detection":{"deep":5},"extra":[1,{"a":2}]}', 1: '{"fs":{"unit":{"name":"Hz"}},"empty":{"now":true}}', 2: '{"detection":{"deep":{"inner":{"gain":7,"list":{"first":1}},"level":{}}},"empty":{}}'}


def settings_merge(spark, d):
    base = _settings(spark, d)
    over = base.where("settings like '{%'").withColumn("settings", F.element_at(F.array(*map(F.lit, OVERLAY.values())), (F.col("rec") % 3 + 1).cast("int")))
    merged = st.merge(st.flatten(base, ["rec"], "settings"), st.flatten(over, ["rec"], "settings"), ["rec"])
    return st.as_text(merged).select("rec", "path", "value")


def settings_changed(spark, d):
    base = st.flatten(_settings(spark, d), ["rec"], "settings")
    rows = _settings(spark, d).where("settings like '{%'")
    pick = lambda *texts: F.element_at(F.array(*map(F.lit, texts)), (F.col("rec") % len(texts) + 1).cast("int"))
    edit = F.concat(F.lit('{"detection":{"threshold":'), pick('"7.9"', '"nan"', "1e30", '"-2.5"', "null"), F.lit(',"deep":{"inner":{"gain":'), pick('"x"', '"3"', "2.5"), F.lit(',"none":'), pick('"none"', '"[1, 2]"', "4"), F.lit('}}},"fs":"new"}'))
    edited = st.flatten(rows.withColumn("settings", edit), ["rec"], "settings")
    return st.as_text(st.changed(edited, base, ["rec"])).select("rec", "path", "value")


def settings_nest(spark, d):
    return st.nest(st.flatten(_settings(spark, d), ["rec"], "settings"), ["rec"])


def plane_view(spark, d):
    p = src.read(spark, d, "part")
    leaf = lambda part, path, value: F.struct(F.lit(part).alias("part"), F.lit(path).alias("path"), value.cast("string").alias("value"))
    leaves = F.array(leaf("db", "fs", F.lit(1)), leaf("settings", "detection.fs", F.col("p_size")), leaf("ops", "old", F.lit(9)))
    parts = p.select(F.col("p_partkey").alias("rec_id"), "p_size", F.inline(leaves))
    parts = parts.where("p_size % 2 = 0 or part = 'ops'")
    stamps = p.select(F.col("p_partkey").alias("rec_id"), (F.col("p_size") - 25.0).alias("pix_to_um"))
    return ops.plane_view(parts, stamps)


def pass_cache_key(spark, d):
    rows = _settings(spark, d)
    flat = st.as_text(st.flatten(rows, ["rec"], "settings"))
    return ops.settings_key(flat, ["detection.threshold", "fs", "absent"], ["rec"], rows)


def calibration(spark, d):
    recs = src.read(spark, d, "supplier").select(F.col("s_suppkey").alias("rec_id"), F.lit(1.0).alias("pix_to_um"))
    stamps = src.read(spark, d, "lineitem").select(F.col("l_suppkey").alias("rec_id"), F.col("l_discount").alias("pix_to_um"), F.col("l_shipdate").alias("at"))
    return ops.calibrate(recs, stamps)


def pair_filter(spark, d):
    n = src.read(spark, d, "nation").select(F.format_string("C%dxC%d", "n_regionkey", "n_nationkey").alias("pair"))
    return ops.choose_pairs(n, [0, 1, 2, 10, 11, 17])


def representative_event(spark, d):
    li = src.read(spark, d, "lineitem").select(F.col("l_returnflag").alias("rec_id"), F.col("l_linenumber").alias("event_id"), F.col("l_suppkey").alias("pair"))
    return ops.representative_event(li)


def _by_customer(spark, d):
    units = src.read(spark, d, "customer").select(F.col("c_nationkey").alias("rec_id"), F.col("c_custkey").alias("roi_id"))
    return units, src.read(spark, d, "orders").select(F.col("o_custkey").alias("roi_id"), F.col("o_orderkey").alias("frame")).join(units, "roi_id")


def onset_order(spark, d):
    units, onsets = _by_customer(spark, d)
    return ops.onset_order(onsets, units)


def onset_raster(spark, d):
    return ops.raster(_by_customer(spark, d)[1].withColumn("frame", F.col("frame") % 1000), 990, 7)


def onset_source_rates(spark, d):
    rates = src.series(spark, d).select(F.lit(0).alias("rec_id"), F.col("unit").alias("roi_id"), "frame", F.col("value").alias("rate"))
    return ops.onset_source(rates, rates, "rates", 30000.0).select("roi_id", "frame")


def _footprints(spark, d):
    return src.read(spark, d, "lineitem").select(F.col("l_returnflag").alias("rec_id"), F.col("l_suppkey").alias("roi_id"), (F.col("l_partkey") % 16).alias("y"), (F.col("l_orderkey") % 16).alias("x"), (F.col("l_quantity") + 1).alias("w"))


def score_image(spark, d):
    px = _footprints(spark, d)
    units = px.select("rec_id", "roi_id").distinct().select("rec_id", "roi_id", (F.expr("roi_id * 37 % 101") / 101.0).alias("p_cell"), (F.col("roi_id") % 2 == 0).alias("keep"))
    return ops.score_image(px, units).select("rec_id", "y", "x", r6("score"))


def splat_rgb(spark, d):
    rec = F.explode(F.array(*map(F.lit, "ANR"))).alias("rec_id")
    colours = src.read(spark, d, "supplier").select(rec, F.col("s_suppkey").alias("roi_id"), (F.col("s_suppkey") % 3 / 2.0).alias("r"), (F.col("s_suppkey") % 5 / 4.0).alias("g"), (F.col("s_nationkey") / 25.0).alias("b"))
    return ops.splat_rgb(_footprints(spark, d), colours).select("rec_id", "y", "x", r6("r"), r6("g"), r6("b"))


def click_to_roi(spark, d):
    clicks = src.read(spark, d, "events").select("event_id", F.lit("A").alias("rec_id"), (F.col("event_id") % 37 / 2.0).alias("cy"), (F.col("user_id") % 41 / 2.0).alias("cx"))
    return ops.clicked(clicks, images.label_image(_footprints(spark, d))).select("event_id", "roi_id")


def promote_curation(spark, d):
    mask = src.read(spark, d, "part").select(F.lit(0).alias("rec_id"), F.col("p_partkey").alias("roi_id"), F.when(F.col("p_size") % 3 > 0, F.col("p_size") % 3 == 1).alias("predicted"), (F.col("p_size") % 2).alias("flag"))
    flips = src.read(spark, d, "lineitem").where("l_linenumber = 1").select(F.lit(0).alias("rec_id"), F.col("l_partkey").alias("roi_id"), (F.col("l_quantity") > 25).alias("keep"), F.col("l_orderkey").alias("at"))
    return ops.promote(mask, flips).select("roi_id", "keep")


def prominence_range(spark, d):
    return ops.slider_range(src.read(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", 20000.0).select("l_returnflag", r6("low"), r6("high"))


def queue_merge(spark, d):
    k = F.col("s_suppkey")
    name = lambda n: F.format_string("/raw/rec_%03d.tif", n)
    q = src.read(spark, d, "supplier").select(k.alias("place"), F.format_string("row%d", k).alias("identifier"), F.array(name(k * 7 % 13), name(k)).alias("tiffs"), F.col("s_name").alias("params"), (k % 4 == 1).alias("chosen"))
    return ops.merge_rows(q).select("place", "identifier", F.array_join("tiffs", ";").alias("tiffs"), "params")


def pad_projection(spark, d):
    px = pixels(spark, d).drop("rec_id").withColumnRenamed("frame", "rec_id")
    frame = src.read(spark, d, "embeddings").select(F.col("vec_id").alias("rec_id"), F.lit(2).alias("y0"), F.lit(3).alias("x0"), F.lit(12).alias("height"), F.lit(13).alias("width"))
    return ops.pad_projection(px, frame).select("rec_id", "y", "x", r6("v"))


def cluster_summary(spark, d):
    c = src.read(spark, d, "customer").select(F.col("c_mktsegment").alias("rec_id"), (F.col("c_nationkey") % 7).alias("cluster_id"))
    return ops.cluster_summary(c, ops.palette(["red", "green", "blue", "cyan", "black"], 3)).select("rec_id", "cluster_id", "n_units", r6("share"), "colour")


def leaf_check(spark, d):
    c = src.read(spark, d, "customer").select(F.col("c_nationkey").alias("rec_id"), F.col("c_custkey").alias("roi_id"))
    w = F.row_number().over(Window.partitionBy("rec_id").orderBy("roi_id"))
    merges = c.withColumn("_n", w).where("_n > 1 and rec_id % 3 != 0 and not (rec_id % 3 = 1 and _n = 2)")
    return ops.leaf_check(merges, c).select("rec_id", "units", "verdict")


def distinct_counts(spark, d):
    return ops.distinct_counts(src.read(spark, d, "documents"), ["lang", "text"], ("source",))


def ragged_columns(spark, d):
    return ops.ragged(src.series(spark, d), ["A", "N", "R"], "unit", "frame").select("frame", r6("A", "a"), r6("N", "n"), r6("R", "r"))


def _sheets(spark, d):
    e = src.units(spark, d).select((F.col("unit") % 5).alias("rec_id"), F.col("unit").alias("roi_id"), "t")
    units = e.select("rec_id", "roi_id").distinct().withColumn("keep", F.col("roi_id") % 3 != 0)
    windows = src.windows(spark).crossJoin(spark.range(5).select(F.col("id").alias("rec_id")))
    clusters = units.select("rec_id", "roi_id", (F.col("roi_id") % 4).alias("cluster_id"))
    return ops.recording_sheets(spark.range(5).select(F.col("id").alias("rec_id"), F.lit(15.07).alias("fps")), units, windows, e, clusters)


def sheet_recording(spark, d):
    return _sheets(spark, d)["Recording"]


def sheet_rois(spark, d):
    return _sheets(spark, d)["ROIs"]


def sheet_events(spark, d):
    return _sheets(spark, d)["Events"].select("rec_id", "event_id", "n_active", r6("first_s"))


def sheet_event_onsets(spark, d):
    return _sheets(spark, d)["EventOnsets"].select("rec_id", "event_id", "roi_id", "kept_pos", r6("rel_s"))


def sheet_event_times(spark, d):
    s = _sheets(spark, d)["RoiEventTimes"]
    return s.select("rec_id", "event_id", "roi_id", "kept_pos", F.posexplode("times_s").alias("i", "t")).select("rec_id", "event_id", "roi_id", "kept_pos", "i", r6("t"))


def sheet_clusters(spark, d):
    return _sheets(spark, d)["Clusters"].select("rec_id", "roi_id", "kept_pos", "cluster_id")


def merge_passes(spark, d):
    px = _footprints(spark, d).select("rec_id", "roi_id", "y", "x").distinct()
    primary = px.where("roi_id % 2 = 0 and y < 5")
    out = images.merge_passes(primary, [("soma", px.where("roi_id % 2 = 1 and x < 9"))], 0.35)
    return out.groupBy("rec_id", "roi_id", "source").agg(F.count("*").alias("npix"))


def label_image(spark, d):
    return images.label_image(_footprints(spark, d))


def inbounds_pixels(spark, d):
    rois = src.read(spark, d, "orders").select(F.col("o_orderstatus").alias("rec_id"), F.col("o_orderkey").alias("roi_id"), F.array((F.col("o_custkey") % 30 - 5), F.col("o_custkey") % 7).alias("ypix"), F.array((F.col("o_orderkey") % 25 - 3), F.col("o_orderkey") % 9).alias("xpix"), F.array(F.lit(1.0), F.lit(2.0)).alias("lam"))
    return images.footprints(rois, 20, 18)


def zscore_pixels(spark, d):
    px = pixels(spark, d).drop("rec_id").withColumnRenamed("frame", "rec_id")
    return cells.zscore_pixels(px, "v").select("rec_id", "y", "x", r6("v", "z"))


def label_upsert(spark, d):
    old = src.read(spark, d, "part").select(F.col("p_brand").alias("path"), F.col("p_partkey").alias("roi_id"), F.lit(0).alias("label"))
    new = src.read(spark, d, "part").where("p_size % 4 = 1").select(F.col("p_brand").alias("path"), F.col("p_partkey").alias("roi_id"), F.lit(1).alias("label"))
    return cells.upsert_labels(old, new)


def label_cleaning(spark, d):
    text = F.when(F.col("l_quantity") > 40, "yes").otherwise((F.col("l_quantity") - 20).cast("string"))
    rows = src.read(spark, d, "lineitem").select(F.col("l_returnflag").alias("path"), F.col("l_suppkey").cast("string").alias("roi_id"), text.alias("label"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    return cells.clean_labels(rows, "at").select("path", "roi_id", "label")


def global_frames(spark, d):
    f = src.read(spark, d, "orders").select(F.col("o_orderstatus").alias("rec_id"), F.format_string("/raw/a_%d.tif", "o_orderkey").alias("path"), (F.col("o_custkey") % 9).alias("n_frames"))
    return images.global_frames(f).select("path", "first_frame")


def sheet_windows(spark, d):
    e = src.read(spark, d, "events").select((F.col("user_id") % 7).alias("rec_id"), F.when(F.col("event_id") % 5 == 0, "start").otherwise(F.col("event_id").cast("string")).alias("start_s"), F.format_string("%d.5", "event_id").alias("end_s"))
    return files.event_windows(e)


def manifest_merge(spark, d):
    part = src.read(spark, d, "part")
    side = lambda shift, a, b: part.select(F.col("p_partkey").alias("rec_id"), F.create_map(F.lit(a), (F.col("p_size") + shift).cast("string"), F.lit(b), F.lit(str(shift))).alias("params"), ((F.col("p_size") + shift) % 3).cast("double").alias("tau"), F.lit(15.0).alias("fs"))
    m = files.merge_manifests(side(0, "x", "y"), side(1, "y", "z").where("rec_id % 2 = 0"))
    return m.select("rec_id", F.col("params")["x"].alias("x"), F.col("params")["y"].alias("y"), F.try_element_at("params", F.lit("z")).alias("z"), "tau", "fs")


def path_scalars(spark, d):
    path = F.format_string("/d/2024-01-%02d_%d/rec_%d.x.tif", F.col("p_size") % 28 + 1, "p_partkey", "p_size")
    p = src.read(spark, d, "part").select("p_partkey", "p_size", path.alias("path"))
    return p.select("p_partkey", scalars.recording_of("path").alias("rec"), scalars.trailing_index("path").alias("i"), scalars.is_filtered(F.when(F.col("p_size") % 2 == 0, "r0p7_filtered_x").otherwise("r0p7_")).alias("filtered"), scalars.event_label(F.col("p_size").cast("double"), F.col("p_size") + 0.25).alias("label"))


def scratch_verdict(spark, d):
    s = src.read(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 5 > 0, F.col("p_size") * 1.0).alias("free"), (F.col("p_partkey") % 50).alias("needed"), (F.col("p_partkey") % 2).alias("pending"))
    return s.select("p_partkey", scalars.scratch_verdict("free", "needed", "pending", 5.0).alias("verdict"))


def memory_errors(spark, d):
    said = F.element_at(F.array(*map(F.lit, ("std::bad_alloc", "CUDA_ERROR_OUT_OF_MEMORY", "no such file", "Unable to allocate 3 GiB", "cublas_status_alloc_failed", "timeout"))), F.col("p_size") % 6 + 1)
    return src.read(spark, d, "part").select("p_partkey", scalars.out_of_memory(said).alias("memory"))


def wide_frames(spark, d):
    t = src.series(spark, d).select("frame", F.expr("ascii(unit)").alias("roi_id"), "value")
    return files.wide(t, [65, 78, 82]).select("frame", r6("65", "u65"), r6("78", "u78"), r6("82", "u82"))


FEET = "fp AS (SELECT l_returnflag AS rec_id, l_suppkey AS roi_id, l_partkey % 16 AS y, l_orderkey % 16 AS x, l_quantity + 1 AS w FROM lineitem)"
SETTINGS = """se AS (SELECT p_partkey AS rec, p_size, p_brand, printf('{"detection":{"threshold":%d,"deep":{"level":%d,"inner":{"on":%s,"list":[%d,"x",{"y":null}],"none":null,"gain":%d.5}}},"fs":"%s","empty":{}}', p_size, p_size % 7, (p_size % 2 = 0)::VARCHAR, p_size, p_size - 25, p_brand) AS s FROM part WHERE p_size % 11 <> 0)"""


def _leaves(table: str) -> str:
    """Leaves by the engine's own walk over JSON: what is no object, or an empty one, and lies in no list."""
    return f"SELECT rec, replace(substr(fullkey, 3), '\"', '') AS path, CASE WHEN t.type = 'VARCHAR' THEN t.value->>'$' ELSE t.value::VARCHAR END AS value FROM {table}, json_tree({table}.s) t WHERE fullkey <> '$' AND NOT contains(fullkey, '[') AND (t.type <> 'OBJECT' OR t.value::VARCHAR = '{{}}')"


SHEETS = "e AS (SELECT user_id % 5 AS rec_id, user_id AS roi_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 AS t FROM events), un AS (SELECT DISTINCT rec_id, roi_id, roi_id % 3 <> 0 AS keep FROM e), kept AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY roi_id) - 1 AS kept_pos FROM un WHERE keep), w AS (SELECT i::INTEGER AS event_id, i * 86400.0 AS start_s, r AS rec_id FROM range(30) a(i), range(5) b(r)), h AS (SELECT e.*, event_id, start_s, kept_pos FROM e JOIN w ON e.rec_id = w.rec_id AND t BETWEEN start_s AND start_s + 7200 JOIN kept k ON k.rec_id = e.rec_id AND k.roi_id = e.roi_id)"

ORACLE = {
    "settings_flatten": f"WITH {SETTINGS}, l AS ({_leaves('se')}) SELECT *, CASE WHEN contains(path, '.') THEN split_part(path, '.', 1) ELSE 'Top-level' END AS grp FROM l",
    "settings_merge": f"WITH {SETTINGS}, mp AS (SELECT rec, json_merge_patch(s, CASE rec % 3 WHEN 0 THEN '{OVERLAY[0]}' WHEN 1 THEN '{OVERLAY[1]}' ELSE '{OVERLAY[2]}' END) AS s FROM se) {_leaves('mp')}",
    "settings_changed": f"WITH {SETTINGS}, c AS (SELECT rec, unnest(['detection.threshold', 'detection.deep.inner.gain', 'detection.deep.inner.none', 'fs']) AS path, unnest([p_size::VARCHAR, (p_size - 25) || '.5', 'null', p_brand]) AS base, unnest([['7', p_size::VARCHAR, '1000000000000000000000000000000', '-2', p_size::VARCHAR][rec % 5 + 1], [(p_size - 25) || '.5', '3.0', '2.5'][rec % 3 + 1], ['null', '[1,2]', '4'][rec % 3 + 1], 'new']) AS value FROM se) SELECT rec, path, value FROM c WHERE value <> base",
    "settings_nest": f"""WITH {SETTINGS} SELECT rec, printf('{{"detection":{{"deep":{{"inner":{{"gain":%d.5,"list":[%d,"x",{{"y":null}}],"none":null,"on":%s}},"level":%d}},"threshold":%d}},"empty":{{}},"fs":"%s"}}', p_size - 25, p_size, (p_size % 2 = 0)::VARCHAR, p_size % 7, p_size, p_brand) AS settings FROM se""",
    "plane_view": "SELECT p_partkey AS rec_id, 'fs' AS name, p_size::VARCHAR AS value FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, 'old', '9' FROM part WHERE p_size % 2 = 1 UNION ALL SELECT p_partkey, 'pix_to_um', (p_size - 25)::VARCHAR || '.0' FROM part WHERE p_size > 25",
    "pass_cache_key": "SELECT p_partkey AS rec, sha256(CASE WHEN p_size % 11 = 0 THEN 'absent=null,detection.threshold=null,fs=null' ELSE 'absent=null,detection.threshold=' || p_size || ',fs=' || p_brand END) AS cache_key FROM part",
    "calibration": "SELECT s_suppkey AS rec_id, coalesce(arg_max(l_discount, (l_shipdate, l_discount)) FILTER (l_discount > 0), 1.0) AS pix_to_um FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1",
    "pair_filter": "SELECT 'C' || n_regionkey || 'xC' || n_nationkey AS pair, n_regionkey AS pair_a, n_nationkey AS pair_b FROM nation WHERE n_regionkey IN (0, 1, 2, 10, 11, 17) AND n_nationkey IN (0, 1, 2, 10, 11, 17)",
    "representative_event": "WITH p AS (SELECT l_returnflag AS rec_id, l_linenumber AS event_id, count(DISTINCT l_suppkey) AS n_pairs, count(*) AS n_rows FROM lineitem GROUP BY 1, 2) SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY n_pairs DESC, n_rows DESC, event_id) = 1",
    "onset_order": "WITH n AS (SELECT c_nationkey AS rec_id, c_custkey AS roi_id, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY n DESC, roi_id) - 1 AS place FROM n",
    "onset_raster": "SELECT DISTINCT c_nationkey AS rec_id, c_custkey AS roi_id, least(140, o_orderkey % 1000 // 7)::INTEGER AS bin FROM orders JOIN customer ON o_custkey = c_custkey",
    "onset_source_rates": f"WITH {SERIES}, l AS (SELECT *, coalesce(lag(value) OVER (PARTITION BY unit ORDER BY frame), 30000) AS b FROM series) SELECT unit AS roi_id, frame FROM l WHERE value > 30000 AND b <= 30000",
    "score_image": f"WITH {FEET} SELECT rec_id, y, x, round((max(roi_id) * 37 % 101) / 101.0::DOUBLE, 6) AS score FROM fp WHERE roi_id % 2 = 0 GROUP BY 1, 2, 3",
    "splat_rgb": f"WITH {FEET} SELECT rec_id, y, x, round(sum(w * (s_suppkey % 3) / 2) / sum(w), 6) AS r, round(sum(w * (s_suppkey % 5) / 4) / sum(w), 6) AS g, round(sum(w * s_nationkey / 25) / sum(w), 6) AS b FROM fp JOIN supplier ON s_suppkey = roi_id GROUP BY 1, 2, 3",
    "click_to_roi": f"WITH {FEET}, l AS (SELECT y, x, max(roi_id) AS roi_id FROM fp WHERE rec_id = 'A' GROUP BY 1, 2) SELECT event_id, roi_id FROM events LEFT JOIN l ON y = round_even((event_id % 37) / 2.0, 0) AND x = round_even((user_id % 41) / 2.0, 0)",
    "promote_curation": "WITH f AS (SELECT l_partkey AS k, arg_max(l_quantity > 25, l_orderkey) AS keep FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) SELECT p_partkey AS roi_id, coalesce(keep, CASE p_size % 3 WHEN 1 THEN true WHEN 2 THEN false END, p_size % 2 = 1) AS keep FROM part LEFT JOIN f ON k = p_partkey",
    "prominence_range": "SELECT l_returnflag, round(least(min(l_extendedprice), 0.0), 6) AS low, round(greatest(max(l_extendedprice), 20000.0) * 1.05::DOUBLE, 6) AS high FROM lineitem GROUP BY 1",
    "queue_merge": "WITH q AS (SELECT s_suppkey AS place, s_name AS params, s_suppkey % 4 = 1 AS c, [s_suppkey * 7 % 13, s_suppkey] AS f FROM supplier), u AS (SELECT DISTINCT unnest(f) AS n FROM q WHERE c), t AS (SELECT n, printf('rec_%03d', n) AS s FROM u) SELECT place, 'row' || place AS identifier, printf('/raw/rec_%03d.tif;/raw/rec_%03d.tif', f[1], f[2]) AS tiffs, params FROM q WHERE NOT c UNION ALL SELECT (SELECT min(place) FROM q WHERE c), string_agg(s, '+' ORDER BY n), string_agg('/raw/' || s || '.tif', ';' ORDER BY n), (SELECT arg_min(params, place) FROM q WHERE c) FROM t",
    "pad_projection": f"WITH {PIXELS} SELECT vec_id AS rec_id, a.y, b.x, round(coalesce(v, 0), 6) AS v FROM embeddings CROSS JOIN range(12) a(y) CROSS JOIN range(13) b(x) LEFT JOIN px ON px.frame = vec_id AND px.y = a.y - 2 AND px.x = b.x - 3",
    "cluster_summary": "WITH n AS (SELECT c_mktsegment AS rec_id, c_nationkey % 7 AS cluster_id, count(*) AS n_units FROM customer GROUP BY 1, 2) SELECT *, round(n_units / sum(n_units) OVER (PARTITION BY rec_id)::DOUBLE, 6) AS share, ['red', 'blue', 'black'][(row_number() OVER (PARTITION BY rec_id ORDER BY cluster_id) - 1) % 3 + 1] AS colour FROM n",
    "leaf_check": "SELECT c_nationkey AS rec_id, count(*) AS units, CASE WHEN c_nationkey % 3 = 0 OR count(*) = 1 OR (count(*) = 2 AND c_nationkey % 3 = 1) THEN 'missing' WHEN c_nationkey % 3 = 1 THEN 'stale' ELSE 'fits' END AS verdict FROM customer GROUP BY 1",
    "distinct_counts": "SELECT source, count(*) AS n, count(DISTINCT lang) AS n_lang, count(DISTINCT text) AS n_text FROM documents GROUP BY 1",
    "ragged_columns": f"WITH {SERIES} SELECT frame, round(max(value) FILTER (unit = 'A'), 6) AS a, round(max(value) FILTER (unit = 'N'), 6) AS n, round(max(value) FILTER (unit = 'R'), 6) AS r FROM series GROUP BY frame",
    "sheet_recording": f"WITH {SHEETS} SELECT r AS rec_id, 15.07 AS fps, count(roi_id) AS n_units, count(roi_id) FILTER (keep) AS n_kept FROM range(5) a(r) LEFT JOIN un ON rec_id = r GROUP BY 1",
    "sheet_rois": f"WITH {SHEETS} SELECT un.rec_id, un.roi_id, un.keep, kept_pos FROM un LEFT JOIN kept k ON k.roi_id = un.roi_id",
    "sheet_events": f"WITH {SHEETS} SELECT w.rec_id, w.event_id, count(DISTINCT roi_id) AS n_active, round(min(t), 6) AS first_s FROM w LEFT JOIN h ON h.rec_id = w.rec_id AND h.event_id = w.event_id GROUP BY 1, 2",
    "sheet_event_onsets": f"WITH {SHEETS} SELECT rec_id, event_id, roi_id, kept_pos, round(t - start_s, 6) AS rel_s FROM h",
    "sheet_event_times": f"WITH {SHEETS} SELECT rec_id, event_id, roi_id, kept_pos, (row_number() OVER (PARTITION BY rec_id, event_id, roi_id ORDER BY t) - 1)::INTEGER AS i, round(t, 6) AS t FROM h",
    "sheet_clusters": f"WITH {SHEETS} SELECT rec_id, roi_id, kept_pos, roi_id % 4 AS cluster_id FROM kept",
    "merge_passes": f"WITH {FEET}, px AS (SELECT DISTINCT rec_id, roi_id, y, x FROM fp), p AS (SELECT *, 0 AS pass FROM px WHERE roi_id % 2 = 0 AND y < 5), x AS (SELECT *, 1 AS pass FROM px WHERE roi_id % 2 = 1 AND x < 9), s AS (SELECT x.rec_id, x.roi_id FROM x LEFT JOIN (SELECT DISTINCT rec_id, y, x, 1 AS hit FROM p) c ON c.rec_id = x.rec_id AND c.y = x.y AND c.x = x.x GROUP BY 1, 2 HAVING avg(coalesce(hit, 0)) < 0.35), u AS (SELECT * FROM p UNION ALL SELECT x.* FROM x JOIN s ON s.rec_id = x.rec_id AND s.roi_id = x.roi_id) SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY pass, roi_id) - 1 AS roi_id, CASE pass WHEN 0 THEN 'primary' ELSE 'soma' END AS source, count(*) AS npix FROM u GROUP BY rec_id, pass, u.roi_id",
    "label_image": f"WITH {FEET} SELECT rec_id, y, x, max(roi_id) AS roi_id FROM fp GROUP BY 1, 2, 3",
    "inbounds_pixels": "WITH p AS (SELECT o_orderstatus AS rec_id, o_orderkey AS roi_id, unnest([o_custkey % 30 - 5, o_custkey % 7]) AS y, unnest([o_orderkey % 25 - 3, o_orderkey % 9]) AS x, unnest([1.0, 2.0]) AS w FROM orders) SELECT * FROM p WHERE y BETWEEN 0 AND 19 AND x BETWEEN 0 AND 17",
    "zscore_pixels": f"WITH {PIXELS} SELECT frame AS rec_id, y, x, round((v - avg(v) OVER f) / greatest(stddev_pop(v) OVER f, 1e-6), 6) AS z FROM px WINDOW f AS (PARTITION BY frame)",
    "label_upsert": "SELECT p_brand AS path, p_partkey AS roi_id, (p_size % 4 = 1)::INTEGER AS label FROM part",
    "label_cleaning": "SELECT l_returnflag AS path, l_suppkey AS roi_id, arg_max((l_quantity > 20)::INTEGER, l_orderkey * 10 + l_linenumber) AS label FROM lineitem WHERE l_quantity <= 40 GROUP BY 1, 2",
    "global_frames": "SELECT '/raw/a_' || o_orderkey || '.tif' AS path, coalesce(sum(o_custkey % 9) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_frame FROM orders",
    "sheet_windows": "SELECT user_id % 7 AS rec_id, event_id::DOUBLE AS start_s, event_id + 0.5::DOUBLE AS end_s, row_number() OVER (PARTITION BY user_id % 7 ORDER BY event_id) - 1 AS event_id FROM events e WHERE e.event_id % 5 <> 0",
    "manifest_merge": "SELECT p_partkey AS rec_id, p_size::VARCHAR AS x, CASE WHEN p_partkey % 2 = 0 THEN (p_size + 1)::VARCHAR ELSE '0' END AS y, CASE WHEN p_partkey % 2 = 0 THEN '1' END AS z, CASE WHEN p_partkey % 2 = 0 AND (p_size + 1) % 3 > 0 THEN (p_size + 1) % 3 ELSE p_size % 3 END::DOUBLE AS tau, 15.0 AS fs FROM part",
    "path_scalars": "SELECT p_partkey, printf('2024-01-%02d_%d', p_size % 28 + 1, p_partkey) AS rec, p_size AS i, p_size % 2 = 0 AS filtered, p_size || 'p00-' || p_size || 'p25s' AS label FROM part",
    "scratch_verdict": "SELECT p_partkey, CASE WHEN p_size % 5 = 0 OR p_size >= p_partkey % 50 + 5 THEN 'ok' WHEN p_partkey % 2 = 1 THEN 'wait' ELSE 'fail' END AS verdict FROM part",
    "memory_errors": "SELECT p_partkey, p_size % 6 IN (0, 1, 3, 4) AS memory FROM part",
    "wide_frames": f"WITH {SERIES} SELECT frame, round(max(value) FILTER (unit = 'A'), 6) AS u65, round(max(value) FILTER (unit = 'N'), 6) AS u78, round(max(value) FILTER (unit = 'R'), 6) AS u82 FROM series GROUP BY frame",
}
