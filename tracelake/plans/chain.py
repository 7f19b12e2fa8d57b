"""Queries of the processing chain over daily traces: filters, onsets, merge trees, spectra, stages; and their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.kernels import signal
from tracelake.kernels.events import DEFAULT
from tracelake.operators import events, traces, trees
from tracelake.plans import stages
from tracelake.plans.common import r6, z6
from tracelake.sources import drivers as src
from tracelake.sources import shared

FPS = 15.07
#: Days without sales are many: a pedestal keeps the baselines positive, and its ratios off round numbers.
PEDESTAL = 100_003.7


def processed(spark, d) -> DataFrame:
    t = src.traces(spark, d).select("rec_id", "roi_id", F.transform("x", lambda v: v + PEDESTAL).alias("f"), F.transform("x", lambda v: v * 0.0).alias("fneu"))
    return traces.process_traces(t, FPS)


def trace_processing(spark, d):
    """Every sample of dF/F with its default window of 679 frames, of the causal low-pass and of the derivative."""
    t = processed(spark, d).select("rec_id", "roi_id", F.posexplode(F.arrays_zip("dff", "lp", "dt")).alias("frame", "_v"))
    return t.select("rec_id", "roi_id", "frame", z6("_v.dff", "dff"), z6("_v.lp", "lp"), z6("_v.dt", "dt", 5))


def onset_frames(spark, d):
    return events.onset_frames(processed(spark, d), FPS).select("rec_id", "roi_id", "onset_frame", r6("onset_s"))


def power_spectrum(spark, d):
    got = events.power_spectrum(processed(spark, d), FPS)
    rows = got.select("rec_id", "roi_id", F.posexplode(F.arrays_zip("freq", "power")).alias("k", "_v"))
    return rows.select("rec_id", "roi_id", "k", r6("_v.freq", "freq"), F.round("_v.power", 3).alias("power"))


def partial_correlation(spark, d):
    return events.partial_correlation(processed(spark, d)).select("rec_id", "roi_a", "roi_b", z6("partial_corr"))


def ward_clusters(spark, d):
    got = traces.clusters(processed(spark, d))
    return got.select("rec_id", "roi_id", "cluster_id", r6("threshold"))


def cluster_lags(spark, d):
    """All unit pairs of all cluster pairs: best lag, its correlation and the zero-lag one, without a null."""
    t = processed(spark, d)
    got = events.cluster_correlation(t, traces.clusters(t), FPS, 1.0, shuffles=0)
    return got.select("rec_id", "cluster_a", "cluster_b", "roi_a", "roi_b", z6("best_lag_sec"), z6("max_corr"), z6("zero_lag_corr"), "leader", "is_diagonal")


def _vectors(spark, d) -> DataFrame:
    e = src.read(spark, d, "embeddings")
    return e.select(F.col("label").cast("string").alias("rec_id"), F.col("vec_id").cast("int").alias("roi_id"), F.col("embedding").cast("array<double>").alias("lp"))


def ward_linkage(spark, d):
    merges, _ = traces.linkage(_vectors(spark, d))
    return merges.select("rec_id", "step", "a", "b", r6("height"), "size")


def _order(spark, d) -> DataFrame:
    merges, leaves = traces.linkage(_vectors(spark, d))
    return shared.kept(trees.leaf_order(shared.kept(merges), leaves))


def merge_tree_order(spark, d):
    return _order(spark, d).select("rec_id", "roi_id", "place", r6("gap"))


def merge_tree_cut(spark, d):
    order = _order(spark, d)
    return trees.cut(order, trees.auto_heights(order)).select("rec_id", "roi_id", "cluster_id")


def merge_tree_branch(spark, d):
    order = _order(spark, d)
    return trees.branch(order, trees.cut(order, trees.auto_heights(order)), [1, 2]).select("rec_id", "roi_id", "cluster_id", "sub_id")


STEPS = (700, 1500)


def drift_steps(spark, d):
    """Two steps common to a recording's units, at known frames, over noise of every unit's own and a share of its daily sums."""
    step = "transform(x, (v, i) -> pmod(xxhash64(roi_id, i), 1000) / 1000D + v % 100 / 1000D + if(i >= {0}, 9D, 0D) + if(i >= {1}, 9D, 0D))".format(*STEPS)
    return traces.drift(src.traces(spark, d).withColumn("x", F.expr(step)), "x")


def stage_chain(spark, d):
    """The whole chain over daily traces, and over copies of them that cannot go all the way."""
    t = src.traces(spark, d).select("rec_id", "roi_id", F.transform("x", lambda v: v + PEDESTAL).alias("f"))
    kinds = {"": FPS, "-slow": 1e-9, "-none": FPS, "-uneven": FPS, "-rate": 0.0, "-one": FPS}
    kind = F.explode(F.array(*map(F.lit, kinds)))
    units = t.select(kind.alias("_kind"), "rec_id", "roi_id", "f").where("_kind != '-one' or roi_id = 3")
    short = F.when((F.col("_kind") == "-uneven") & (F.col("roi_id") == 2), F.slice("f", 1, 9)).otherwise(F.col("f"))
    units = units.select(F.concat("rec_id", "_kind").alias("rec_id"), "roi_id", short.alias("f"), (F.col("_kind") != "-none").alias("keep"))
    units = units.withColumn("fneu", F.transform("f", lambda v: v * 0.0))
    rates = F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))
    recs = units.select("rec_id").distinct().withColumn("fps", rates[F.regexp_extract("rec_id", r"^[^-]*(.*)$", 1)])
    params = replace(DEFAULT, shuffles=0, bin_s=0.1, min_prominence=0.01)
    got = stages.run(recs, units, shared.new_path(spark), params, shuffles=20)
    return got.select("rec_id", "n_frames", "n_rois", "status", "n_failed", F.coalesce(F.substring_index("messages", ":", 1), F.lit("")).alias("failed"))


_B, _A = (c.tolist() for c in signal.butterworth2(FPS, 1.0))
TRACES = "sd AS (SELECT l_returnflag AS rec_id, l_linenumber AS roi_id, l_shipdate::DATE - DATE '1995-01-01' AS day, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS v FROM lineitem GROUP BY 1, 2, 3), se AS (SELECT rec_id, min(day) AS a, max(day) AS b FROM sd GROUP BY 1), su AS (SELECT DISTINCT rec_id, roi_id FROM sd), tr AS MATERIALIZED (SELECT su.rec_id, su.roi_id, t - a AS frame, b - a + 1 AS n, coalesce(v, 0) AS x FROM su JOIN se USING (rec_id) CROSS JOIN LATERAL (SELECT unnest(range(a, b + 1)) AS t) LEFT JOIN sd ON sd.rec_id = su.rec_id AND sd.roi_id = su.roi_id AND sd.day = t)"
PROCESSED = f"""{TRACES},
pd AS (SELECT rec_id, roi_id, frame, x + {PEDESTAL} AS f FROM tr UNION ALL SELECT rec_id, roi_id, -i, x + {PEDESTAL} FROM tr, range(1, 340) r(i) WHERE frame = 0 UNION ALL SELECT rec_id, roi_id, frame + i, x + {PEDESTAL} FROM tr, range(1, 340) r(i) WHERE frame = n - 1),
bs AS (SELECT rec_id, roi_id, frame, f, quantile_disc(f, 0.1) OVER (PARTITION BY rec_id, roi_id ORDER BY frame ROWS BETWEEN 339 PRECEDING AND 339 FOLLOWING) AS base FROM pd),
fl AS (SELECT tr.rec_id, tr.roi_id, tr.frame, tr.n, f, base FROM bs JOIN tr ON tr.rec_id = bs.rec_id AND tr.roi_id = bs.roi_id AND tr.frame = bs.frame),
fq AS (SELECT rec_id, roi_id, quantile_cont(base, 0.01) AS q FROM fl GROUP BY 1, 2),
df AS MATERIALIZED (SELECT rec_id, roi_id, frame, n, (f - base) / greatest(base, CASE WHEN q > 0 THEN q ELSE 1e-9 END) AS dff FROM fl JOIN fq USING (rec_id, roi_id)),
rf AS (
  SELECT rec_id, roi_id, 0::BIGINT AS frame, {_B[0]!r} * dff + dff AS lp, {_B[1]!r} * dff - {_A[1]!r} * ({_B[0]!r} * dff + dff) + dff AS z0, {_B[2]!r} * dff - {_A[2]!r} * ({_B[0]!r} * dff + dff) AS z1 FROM df WHERE frame = 0
  UNION ALL
  SELECT r.rec_id, r.roi_id, r.frame + 1, {_B[0]!r} * dff + z0, {_B[1]!r} * dff - {_A[1]!r} * ({_B[0]!r} * dff + z0) + z1, {_B[2]!r} * dff - {_A[2]!r} * ({_B[0]!r} * dff + z0) FROM rf r JOIN df ON df.rec_id = r.rec_id AND df.roi_id = r.roi_id AND df.frame = r.frame + 1),
lw AS MATERIALIZED (SELECT rf.rec_id, rf.roi_id, rf.frame, n, dff, lp FROM rf JOIN df ON df.rec_id = rf.rec_id AND df.roi_id = rf.roi_id AND df.frame = rf.frame)"""
# A window of five frames: the slope is (sum of k * x) / 10, the curvature's coefficient (sum of (k * k - 2) * x) / 14.
DERIVED = f"""{PROCESSED},
wi AS (SELECT *, (2 * (lead(lp, 2) OVER w - lag(lp, 2) OVER w) + lead(lp, 1) OVER w - lag(lp, 1) OVER w) / 10 AS c1, (2 * (lead(lp, 2) OVER w + lag(lp, 2) OVER w) - lead(lp, 1) OVER w - lag(lp, 1) OVER w - 2 * lp) / 14 AS c2 FROM lw WINDOW w AS (PARTITION BY rec_id, roi_id ORDER BY frame)),
dt AS MATERIALIZED (SELECT l.rec_id, l.roi_id, l.frame, l.n, l.dff, l.lp, (m.c1 + 2 * m.c2 * (l.frame - m.frame)) * {FPS} AS dt FROM wi l JOIN wi m ON m.rec_id = l.rec_id AND m.roi_id = l.roi_id AND m.frame = greatest(2, least(l.n - 3, l.frame)))"""


def _ward(units: str) -> str:
    """Linkage of (rec_id, leaf, z): one row a recording and step, whose list holds the clusters that are left."""
    return f"""wd AS (
  SELECT rec_id, -1::BIGINT AS step, 0::BIGINT AS a, 0::BIGINT AS b, 0::DOUBLE AS height, 0::BIGINT AS size, count(*) AS n0, list({{'id': leaf::BIGINT, 'n': 1::BIGINT, 'c': z}} ORDER BY leaf) AS cl FROM {units} GROUP BY rec_id
  UNION ALL
  SELECT rec_id, step + 1, m.i, m.j, sqrt(m.d), x.n + y.n, n0, list_append(list_filter(cl, lambda c: c.id <> m.i AND c.id <> m.j), {{'id': n0 + step + 1, 'n': x.n + y.n, 'c': list_transform(list_zip(x.c, y.c), lambda p: (x.n * p[1] + y.n * p[2]) / (x.n + y.n))}})
  FROM (SELECT *, list_filter(cl, lambda c: c.id = m.i)[1] AS x, list_filter(cl, lambda c: c.id = m.j)[1] AS y FROM (SELECT *, list_min(flatten(list_transform(cl, lambda p: list_transform(list_filter(cl, lambda q: q.id > p.id), lambda q: {{'d': 2.0 * p.n * q.n / (p.n + q.n) * list_distance(p.c, q.c) ** 2, 'i': p.id, 'j': q.id}})))) AS m FROM wd WHERE len(cl) > 1))),
mg AS MATERIALIZED (SELECT rec_id, step, a, b, height, size, n0 FROM wd WHERE step >= 0)"""


ORDER = """nd AS (SELECT rec_id, n0 + step AS node, a, b, height, n0 FROM mg), sz AS (SELECT rec_id, n0 + step AS node, size FROM mg),
ps AS (SELECT rec_id, node, 0::BIGINT AS start, NULL::DOUBLE AS gap FROM nd WHERE node = 2 * n0 - 2
  UNION ALL SELECT p.rec_id, unnest([nd.a, nd.b]), p.start + unnest([0, coalesce(sz.size, 1)]), CASE unnest([1, 2]) WHEN 1 THEN p.gap ELSE nd.height END FROM ps p JOIN nd ON nd.rec_id = p.rec_id AND nd.node = p.node LEFT JOIN sz ON sz.rec_id = nd.rec_id AND sz.node = nd.a),
od AS MATERIALIZED (SELECT ul.rec_id, ul.roi_id, start AS place, gap FROM ul JOIN ps ON ps.rec_id = ul.rec_id AND ps.node = ul.leaf)"""
_VALUES = "ul AS MATERIALIZED (SELECT label::VARCHAR AS rec_id, vec_id::INTEGER AS roi_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS leaf, list_transform(embedding::DOUBLE[], lambda v: (v - list_avg(embedding::DOUBLE[])) / (list_stddev_pop(embedding::DOUBLE[]) + 1e-8)) AS z FROM embeddings)"
_UNITS = "ul AS MATERIALIZED (SELECT rec_id, roi_id, row_number() OVER (PARTITION BY rec_id ORDER BY roi_id) - 1 AS leaf, z FROM (SELECT rec_id, roi_id, list((lp - m) / (s + 1e-8) ORDER BY frame) AS z FROM (SELECT *, avg(lp) OVER w AS m, stddev_pop(lp) OVER w AS s FROM lw WINDOW w AS (PARTITION BY rec_id, roi_id)) GROUP BY 1, 2))"


def _cut(order: str, out: str, keys: str = "rec_id") -> str:
    """The automatic height of each group, and the running count of gaps above it."""
    return f"""{out}_t AS (SELECT {keys}, max(gap) AS top FROM {order} GROUP BY {keys}), {out}_f AS (SELECT {keys}, i / 100.0::DOUBLE AS f, count(*) FILTER (gap > i / 100.0::DOUBLE * top) + 1 AS n FROM {order} JOIN {out}_t USING ({keys}) CROSS JOIN range(5, 91) r(i) GROUP BY {keys}, i), {out}_h AS (SELECT {keys}, coalesce(max(f) FILTER (n IN (4, 5)), 0.9) AS f FROM {out}_f GROUP BY {keys}),
{out} AS MATERIALIZED (SELECT o.*, f * top AS height, (count(*) FILTER (gap > f * top) OVER (PARTITION BY {keys} ORDER BY place) + 1)::INTEGER AS cluster_id FROM {order} o JOIN {out}_t USING ({keys}) JOIN {out}_h USING ({keys}))"""


_TREE = f"WITH RECURSIVE {_VALUES}, {_ward('ul')}, {ORDER}"
_CLUSTERS = f"WITH RECURSIVE {PROCESSED}, {_UNITS}, {_ward('ul')}, {ORDER}, {_cut('od', 'ct')}"
_N = 7  # units of a recording: line numbers
_STATUS = "CASE WHEN kind IN ('', '-one') THEN 'done' WHEN kind = '-slow' THEN 'partial' WHEN kind = '-none' THEN 'no_rois' ELSE 'failed' END"

ORACLE = {
    "trace_processing": f"WITH RECURSIVE {DERIVED} SELECT rec_id, roi_id, frame::INTEGER AS frame, round(dff, 6) + 0.0 AS dff, round(lp, 6) + 0.0 AS lp, round(dt, 5) + 0.0 AS dt FROM dt",
    "onset_frames": f"""WITH RECURSIVE {DERIVED},
md AS (SELECT rec_id, roi_id, median(dt) AS m FROM dt GROUP BY 1, 2), ma AS (SELECT dt.rec_id, dt.roi_id, any_value(m) AS m, median(abs(dt - m)) AS a FROM dt JOIN md USING (rec_id, roi_id) GROUP BY 1, 2),
st AS (SELECT dt.*, (dt - m) / (1.4826 * (a + 1e-12)) AS z FROM dt JOIN ma USING (rec_id, roi_id)),
so AS (SELECT *, coalesce(last_value(CASE WHEN z >= 3.5 THEN 1 WHEN z <= 1.5 THEN 0 END IGNORE NULLS) OVER (PARTITION BY rec_id, roi_id ORDER BY frame ROWS UNBOUNDED PRECEDING), 0) AS o FROM st),
up AS (SELECT rec_id, roi_id, frame, lp FROM (SELECT *, coalesce(lag(o) OVER (PARTITION BY rec_id, roi_id ORDER BY frame), 0) AS b FROM so) WHERE o = 1 AND b = 0),
fr AS (SELECT u.rec_id, u.roi_id, u.frame, coalesce(max(d.frame) FILTER (d.lp >= u.lp) + 1, greatest(0, u.frame - 12)) AS first FROM up u LEFT JOIN dt d ON d.rec_id = u.rec_id AND d.roi_id = u.roi_id AND d.frame BETWEEN u.frame - 12 AND u.frame - 1 GROUP BY 1, 2, 3)
SELECT DISTINCT rec_id, roi_id, foot::INTEGER AS onset_frame, round(foot / {FPS}, 6) AS onset_s FROM (SELECT f.rec_id, f.roi_id, arg_min(d.frame, (d.lp, d.frame)) AS foot FROM fr f JOIN dt d ON d.rec_id = f.rec_id AND d.roi_id = f.roi_id AND d.frame BETWEEN f.first AND f.frame GROUP BY f.rec_id, f.roi_id, f.frame)""",
    "power_spectrum": f"WITH RECURSIVE {PROCESSED}, sp AS (SELECT rec_id, roi_id, k, n, sum(dff * cos(2 * pi() * ((k * frame) % n) / n)) AS re, sum(dff * sin(2 * pi() * ((k * frame) % n) / n)) AS im FROM df CROSS JOIN LATERAL (SELECT unnest(range(n // 2 + 1)) AS k) GROUP BY 1, 2, 3, 4) SELECT rec_id, roi_id, k::INTEGER AS k, round(k * {FPS} / n, 6) AS freq, round(re * re + im * im, 3) AS power FROM sp",
    "partial_correlation": f"""WITH RECURSIVE {PROCESSED}, zz AS (SELECT rec_id, roi_id, frame, n, (lp - avg(lp) OVER w) / stddev_pop(lp) OVER w AS z FROM lw WINDOW w AS (PARTITION BY rec_id, roi_id)),
cr AS (SELECT a.rec_id, a.roi_id AS i, b.roi_id AS j, sum(a.z * b.z) / any_value(a.n) + CASE WHEN a.roi_id = b.roi_id THEN 1e-6 ELSE 0 END AS c FROM zz a JOIN zz b ON a.rec_id = b.rec_id AND a.frame = b.frame GROUP BY 1, 2, 3),
mx AS (SELECT rec_id, list(r ORDER BY i) AS m FROM (SELECT rec_id, i, list_concat(list(c ORDER BY j), list_transform(range(1, {_N + 1}), lambda t: CASE WHEN t = i THEN 1.0::DOUBLE ELSE 0 END)) AS r FROM cr GROUP BY 1, 2) GROUP BY 1),
gj AS (SELECT rec_id, 1 AS k, m FROM mx UNION ALL SELECT rec_id, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda v: v / m[k][k]) ELSE list_transform(r, lambda v, j: v - r[k] / m[k][k] * m[k][j]) END) FROM gj WHERE k <= {_N}),
iv AS (SELECT rec_id, m FROM gj WHERE k = {_N + 1})
SELECT rec_id, i::INTEGER AS roi_a, j::INTEGER AS roi_b, round(CASE WHEN i = j THEN 1 ELSE -m[i][{_N} + j] / sqrt(m[i][{_N} + i] * m[j][{_N} + j]) END, 6) + 0.0 AS partial_corr FROM iv, range(1, {_N + 1}) a(i), range(1, {_N + 1}) b(j)""",
    "ward_clusters": f"{_CLUSTERS} SELECT rec_id, roi_id, cluster_id, round(height, 6) AS threshold FROM ct",
    "cluster_lags": f"""{_CLUSTERS}, zz AS (SELECT rec_id, roi_id, any_value(n) AS n, list(z ORDER BY frame) AS z FROM (SELECT *, (lp - avg(lp) OVER w) / stddev_pop(lp) OVER w AS z FROM lw WINDOW w AS (PARTITION BY rec_id, roi_id)) GROUP BY 1, 2),
cc AS (SELECT a.rec_id, a.roi_id AS roi_a, b.roi_id AS roi_b, k, list_inner_product(a.z[1 + greatest(k, 0) : a.n + least(k, 0)], b.z[1 + greatest(-k, 0) : a.n - greatest(k, 0)]) / a.n AS c FROM zz a JOIN zz b ON a.rec_id = b.rec_id CROSS JOIN range(-15, 16) r(k)),
cb AS (SELECT rec_id, roi_a, roi_b, arg_max(k, (round(c, 12), -k)) AS k, max(c) AS m, max(c) FILTER (k = 0) AS z FROM cc GROUP BY 1, 2, 3)
SELECT cb.rec_id, p.cluster_id AS cluster_a, q.cluster_id AS cluster_b, roi_a, roi_b, round(k / {FPS}, 6) + 0.0 AS best_lag_sec, round(m, 6) + 0.0 AS max_corr, round(z, 6) + 0.0 AS zero_lag_corr, CASE WHEN k < 0 THEN 'A' WHEN k > 0 THEN 'B' ELSE 'none' END AS leader, roi_a = roi_b AS is_diagonal FROM cb JOIN ct p ON p.rec_id = cb.rec_id AND p.roi_id = roi_a JOIN ct q ON q.rec_id = cb.rec_id AND q.roi_id = roi_b WHERE p.cluster_id <= q.cluster_id""",
    "ward_linkage": f"WITH RECURSIVE {_VALUES}, {_ward('ul')} SELECT rec_id, step::INTEGER AS step, a::INTEGER AS a, b::INTEGER AS b, round(height, 6) AS height, size::INTEGER AS size FROM mg",
    "merge_tree_order": f"{_TREE} SELECT rec_id, roi_id, place::INTEGER AS place, round(gap, 6) AS gap FROM od",
    "merge_tree_cut": f"{_TREE}, {_cut('od', 'ct')} SELECT rec_id, roi_id, cluster_id FROM ct",
    "merge_tree_branch": f"{_TREE}, {_cut('od', 'ct')}, br AS (SELECT rec_id || '/' || cluster_id AS g, rec_id, roi_id, place, cluster_id AS own, CASE WHEN place > min(place) OVER (PARTITION BY rec_id, cluster_id) THEN gap END AS gap FROM ct WHERE cluster_id IN (1, 2)), {_cut('br', 'sb', 'g')} SELECT rec_id, roi_id, own AS cluster_id, cluster_id AS sub_id FROM sb",
    "drift_steps": f"SELECT DISTINCT l_returnflag AS rec_id, unnest([{STEPS[0]}, {STEPS[1]}])::INTEGER AS frame FROM lineitem",
    "stage_chain": f"WITH {TRACES}, kd AS (SELECT unnest(['', '-slow', '-none', '-uneven', '-rate', '-one']) AS kind), rc AS (SELECT rec_id, any_value(n) AS n, count(DISTINCT roi_id) AS u FROM tr GROUP BY 1) SELECT rec_id || kind AS rec_id, CASE WHEN kind = '-none' THEN 0 ELSE n END::INTEGER AS n_frames, CASE kind WHEN '-none' THEN 0 WHEN '-one' THEN 1 ELSE u END AS n_rois, {_STATUS} AS status, (kind = '-slow')::INTEGER::BIGINT AS n_failed, CASE WHEN kind = '-slow' THEN 'events' ELSE '' END AS failed FROM rc CROSS JOIN kd",
}
