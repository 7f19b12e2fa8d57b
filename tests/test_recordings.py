"""Event, pair and spatial operators on small recordings, and the streaming filter against the batch one."""

from dataclasses import replace

import numpy as np
import pytest

from test_events import bursts
from tracelake.kernels import events as kernel
from tracelake.kernels import signal, stats
from tracelake.operators import events as ops
from tracelake.streaming.lowpass import online_lowpass

FPS = 15.0


@pytest.fixture(scope="module")
def traces(spark):
    r = np.random.default_rng(0)
    latent = r.standard_normal((2, 300))
    rows = [("rec", i, (latent[i // 2] + 0.3 * r.standard_normal(300)).tolist()) for i in range(4)]
    return spark.createDataFrame(rows, "rec_id string, roi_id int, lp array<double>")


@pytest.fixture(scope="module")
def clusters(spark):
    return spark.createDataFrame([("rec", i, i // 2 + 1) for i in range(4)], "rec_id string, roi_id int, cluster_id int")


def test_detect_events(spark):
    at, trains = bursts()
    onsets = spark.createDataFrame([("rec", i, float(t)) for i, x in enumerate(trains) for t in x], "rec_id string, roi_id int, onset_s double")
    recs = spark.createDataFrame([("rec", 597.2, 60), ("silent", 10.0, 3)], "rec_id string, duration_s double, n_rois int")
    found = ops.detect_events(onsets, recs, replace(kernel.DEFAULT, shuffles=10)).orderBy("event_id").collect()
    assert len(found) == 12 and np.allclose([e.peak_s for e in found], at, atol=0.1)
    assert ops.detect_events(onsets.where("false"), recs).count() == 0


def test_cluster_correlation(spark, traces, clusters):
    x = {r.roi_id: np.array(r.lp) for r in traces.collect()}
    got = ops.cluster_correlation(traces, clusters, FPS, 0.5, shuffles=20).collect()
    assert len(got) == 12 and sum(r.is_diagonal for r in got) == 4
    for r in got:
        lag, best, zero = stats.lagged(x[r.roi_a][:, None], x[r.roi_b][:, None], FPS, 0.5)
        assert (r.best_lag_sec, r.max_corr, r.zero_lag_corr) == pytest.approx((lag[0, 0], best[0, 0], zero[0, 0]))
        assert r.event_id is None and 0 < r.p_value <= r.p_value_fdr <= 1
    windows = spark.createDataFrame([("rec", 0, 1.0, 3.0), ("rec", 1, 4.0, 4.2)], "rec_id string, event_id int, start_s double, end_s double")
    some = ops.cluster_correlation(traces, clusters, FPS, 5.0, windows=windows).collect()
    assert len(some) == 12 and {r.event_id for r in some} == {0} and all(r.p_value is None for r in some)
    r = next(r for r in some if r.roi_a == 0 and r.roi_b == 3)
    assert r.max_corr == pytest.approx(stats.lagged(x[0][15:45, None], x[3][15:45, None], FPS, 5.0)[1][0, 0])


def test_partial_and_signs(spark, traces):
    got = ops.partial_correlation(traces).collect()
    assert len(got) == 16 and all(r.partial_corr == 1 for r in got if r.roi_a == r.roi_b)
    p = ops.sign_flip(spark.createDataFrame([("a", 1.0)] * 20 + [("a", None)], "g string, v double"), ["g"], "v", 500).first()
    assert p.n == 20 and p.mean == 1 and p.p_value < 0.01
    assert [r.marker for r in ops.marked(spark.createDataFrame([(0.0005,), (0.2,)], "p_value double")).collect()] == ["***", "n.s."]


def test_space(spark):
    a = np.radians(30)
    r = np.random.default_rng(1)
    xy = r.uniform(0, 100, (25, 2))
    active = spark.createDataFrame([("rec", 0, i, float(x * np.cos(a) + y * np.sin(a)) / 10) for i, (x, y) in enumerate(xy)], "rec_id string, event_id int, roi_id int, first_time_s double")
    feet = spark.createDataFrame([("rec", i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "rec_id string, roi_id int, x double, y double")
    row = ops.spread(active, feet, 100.0, shuffles=200).first()
    assert abs(np.degrees(row.theta) - 30) < 4 and row.q < 0.05
    g = ops.activation_groups(active, feet, 1.0).collect()
    assert sum(x.n for x in g) == 25 and {x["rank"] for x in g} == set(range(1, len(g) + 1))
    ranked = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (1, 1, 1)], "event_id int, unit int, rank int")
    px = spark.createDataFrame([(1, 0, 0, 1.0), (2, 0, 0, 3.0), (2, 0, 1, 1.0)], "unit int, y int, x int, w double")
    assert {(r.event_id, r.y, r.x): r.image for r in ops.order_map(ranked, px).collect()} == {(0, 0, 0): 0.75, (0, 0, 1): 1.0, (1, 0, 0): 0.0}


def test_rates(spark):
    rates = spark.createDataFrame([("rec", 0, [1.0, 0.0, 0.0, 2.0, 3.0]), ("rec", 1, [0.0] * 5)], "rec_id string, roi_id int, spks array<double>")
    w = spark.createDataFrame([("rec", 7, 0.15, 0.35)], "rec_id string, event_id int, start_s double, end_s double")
    assert [tuple(r) for r in ops.rate_activation(rates, w, 10.0).collect()] == [("rec", 7, 0, 0.3)]


def test_onsets_spectrum_and_display(spark, traces):
    t = traces.selectExpr("*", "lp as dt", "lp as dff")
    assert all(r.onset_frame >= 0 for r in ops.onset_frames(t, FPS, 2.0, 0.5).collect())
    assert len(ops.power_spectrum(t, FPS).first().power) == 151
    assert len(ops.display_lowpass(t, FPS).first().smooth) == 300


def test_recluster(traces, clusters):
    got = ops.recluster(traces, clusters, [1], target=(2, 2)).collect()
    assert {r.roi_id for r in got} == {0, 1}


def test_stream_equals_batch(spark, tmp_path):
    x = np.random.default_rng(2).standard_normal(90)
    schema = "rec_id string, roi_id int, start long, values array<double>"
    for at in ([(0, 40), (40, 60)], [(50, 90)]):  # ten frames come twice
        spark.createDataFrame([("rec", 0, i, x[i:j].tolist()) for i, j in at] + [("rec", 1, 0, None)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    q = online_lowpass(stream, FPS).writeStream.format("memory").queryName("lp").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.frame: r.lp for r in spark.table("lp").collect()}
    assert np.allclose([got[i] for i in range(90)], signal.lowpass(x, FPS)) and spark.table("lp").count() == 90


def test_registered_queries_keep_the_operators_defaults(spark, monkeypatch):
    import inspect

    from tracelake.operators import events
    from tracelake.plans import recordings

    seen = {}
    for name, query in (("cluster_correlation", recordings.cluster_correlation), ("sign_flip", recordings.sign_flip), ("spread", recordings.spread_direction)):
        own = inspect.signature(getattr(events, name))

        def noted(*a, own=own, name=name, **k):
            seen[name] = own.bind(*a, **k).arguments
            raise InterruptedError

        monkeypatch.setattr(events, name, noted)
        with pytest.raises(InterruptedError):
            query(spark, "/root/testdata/sf0.001")
    assert {*seen} == {"cluster_correlation", "sign_flip", "spread"}
    assert not {"shuffles", "n", "draws", "permutations", "flips"} & {k for x in seen.values() for k in x}
