"""Trace operators on small planted recordings."""

import numpy as np

from tracelake.operators import traces as ops


def recording(spark):
    r = np.random.default_rng(0)
    latent = r.standard_normal((2, 400)).cumsum(1)
    rows = [("rec", i, (100 + latent[i // 3] + 0.1 * r.standard_normal(400)).tolist(), [0.0] * 400) for i in range(6)]
    rows[5][2][10] = float("nan")
    return spark.createDataFrame(rows, "rec_id string, roi_id int, f array<double>, fneu array<double>")


def test_chain(spark):
    t = ops.process_traces(recording(spark), 15.07)
    rows = t.collect()
    assert len(rows) == 6 and all(np.isfinite(r.lp).all() for r in rows)
    got = {r.roi_id: r.cluster_id for r in ops.clusters(t, target=(2, 2)).collect()}
    assert len({got[i] for i in (0, 1, 2)}) == 1 and len({got[i] for i in (3, 4, 5)}) == 1 and got[0] != got[3]
    assert ops.drift(recording(spark)).columns == ["rec_id", "frame"]


def test_one_unit_gives_no_clusters(spark):
    t = ops.process_traces(recording(spark).where("roi_id = 0"), 15.07)
    assert ops.clusters(t).count() == 0


def test_drift_from_blocks(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((9, 300)).cumsum(1) * 0.05 + r.standard_normal((9, 300)) * 0.1
    x[:, 100:] += 4
    x[:, 200:] += 3
    x[4, 17] = np.nan
    t = spark.createDataFrame([("rec", i, v.tolist()) for i, v in enumerate(x)] + [("one", 0, x[0].tolist()), ("short", 0, [1.0]), ("short", 1, [2.0])], "rec_id string, roi_id int, f array<double>")
    from tracelake.kernels import signal, stats

    want = stats.steps(stats.first_component(np.stack([signal.interpolate(v) for v in x], 1))).tolist()
    assert want == [100, 200]
    for block in (256, 2, 4):
        got = ops.drift(t, block=block).collect()
        assert sorted(g.frame for g in got) == want and {g.rec_id for g in got} == {"rec"}


def test_merge_tree_tables_cut_as_the_kernel(spark):
    from tracelake.kernels import stats
    from tracelake.operators import trees
    from pyspark.sql import functions as F

    r = np.random.default_rng(5)
    sets = {"a": r.standard_normal((23, 12)), "b": np.repeat(r.standard_normal((4, 12)), 3, 0) + 0.01 * r.standard_normal((12, 12)), "two": r.standard_normal((2, 12)), "one": r.standard_normal((1, 12))}
    t = spark.createDataFrame([(k, i * 10, v.tolist()) for k, x in sets.items() for i, v in enumerate(x)], "rec_id string, roi_id int, lp array<double>")
    merges, leaves = ops.linkage(t)
    order = trees.leaf_order(merges, leaves).cache()
    trees_of = {k: stats.ward(ops._standard(x.T).T) for k, x in sets.items() if len(x) > 1}
    for share in (0.0, 0.3, 0.6, 1.0):
        heights = spark.createDataFrame([(k, float(z[:, 2].max() * share)) for k, z in trees_of.items()], "rec_id string, height double")
        got = {(g.rec_id, g.roi_id // 10): g.cluster_id for g in trees.cut(order, heights).collect()}
        assert got == {(k, i): int(c) for k, z in trees_of.items() for i, c in enumerate(stats.cut(z, z[:, 2].max() * share))}
    own = {g.roi_id: g.cluster_id for g in ops.clusters(t.where("rec_id = 'a'")).collect()}
    cut = trees.cut(order, trees.auto_heights(order))
    assert {g.roi_id: g.cluster_id for g in cut.where("rec_id = 'a'").collect()} == own
    big = max(set(own.values()), key=list(own.values()).count)
    sub = trees.branch(order, cut.where("rec_id = 'a'"), [big]).collect()
    assert {s.roi_id for s in sub} == {k for k, c in own.items() if c == big} and {s.cluster_id for s in sub} == {big}
    inner = order.where((F.col("rec_id") == "a") & F.col("roi_id").isin([s.roi_id for s in sub])).orderBy("place").collect()
    gaps = [g.gap for g in inner[1:]]
    top = stats.auto_threshold(np.array(gaps)) * max(gaps)
    ids = np.cumsum([1] + [g > top for g in gaps])
    assert {s.roi_id: s.sub_id for s in sub} == {g.roi_id: int(c) for g, c in zip(inner, ids)}
    assert order.where("rec_id = 'one'").collect()[0].place == 0
