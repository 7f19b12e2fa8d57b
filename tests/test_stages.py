"""The stage chain, and cell scores with their labels and splits."""

import numpy as np
from pyspark.sql import functions as F

from tracelake.kernels.events import DEFAULT
from tracelake.operators import cells
from tracelake.plans import stages


def test_chain(spark, tmp_path):
    r = np.random.default_rng(0)
    rows = []
    for rec, n in (("two", 4), ("one", 1)):
        for i in range(n):
            f = 100 + r.standard_normal(600)
            for t in (150, 400):
                f[t : t + 60] += 80 * np.exp(-np.arange(60) / 15)
            rows.append((rec, i, f.tolist(), [0.0] * 600, True))
    rows += [("none", 0, [1.0] * 9, [0.0] * 9, False), ("uneven", 0, [1.0] * 9, [0.0] * 9, True), ("uneven", 1, [1.0] * 8, [0.0] * 8, True)]
    rois = spark.createDataFrame(rows, "rec_id string, roi_id int, f array<double>, fneu array<double>, keep boolean")
    recs = spark.createDataFrame([("two", 15.0), ("one", 10.0), ("none", 15.0), ("uneven", 15.0), ("bad", 0.0)], "rec_id string, fps double")
    from dataclasses import replace

    params = replace(DEFAULT, shuffles=0, bin_s=0.1, min_prominence=0.1)
    found = stages.run(recs, rois, str(tmp_path), params, shuffles=5)
    assert {x.rec_id: x.status for x in found.collect()} == {"two": "done", "one": "done", "none": "no_rois", "uneven": "failed", "bad": "no_rois"}
    read = lambda n: spark.read.parquet(str(tmp_path / n))
    assert read("traces").count() == 5 and {x.rec_id for x in read("clusters").collect()} == {"two"} == {x.rec_id for x in read("xcorr").collect()}
    e = read("events").where("rec_id = 'two'").collect()
    assert any(abs(x.peak_s - 10) < 1 for x in e) and any(abs(x.peak_s - 400 / 15) < 1 for x in e)
    a = read("activation")
    assert a.where("rec_id = 'two'").select("roi_id").distinct().count() == 4 and read("stages").where("status = 'failed'").count() == 0
    state = {(x.rec_id, x.stage): x.status for x in read("stages").collect()}
    assert state["two", "xcorr"] == "ok" and state["one", "clusters"] == "skipped" and state["one", "events"] == "ok" and state["none", "traces"] == "skipped" and len(state) == 30


def test_a_recording_that_fails_leaves_the_others(spark, tmp_path):
    from dataclasses import replace

    r = np.random.default_rng(0)
    trace = lambda: (100 + r.standard_normal(200) + 50 * (np.arange(200) % 90 == 5)).tolist()
    rows = [(rec, i, trace(), [0.0] * 200, [float(t % 50 == 3) for t in range(200)], True) for rec in ("a", "b", "slow", "lost") for i in range(3)]
    rois = spark.createDataFrame(rows, "rec_id string, roi_id int, f array<double>, fneu array<double>, spks array<double>, keep boolean")
    # A recording of years has too many bins for its events; one of an endless rate has no window for its baseline.
    recs = spark.createDataFrame([("a", 10.0), ("b", 12.5), ("slow", 1e-9), ("lost", float("inf"))], "rec_id string, fps double")
    params = replace(DEFAULT, shuffles=0, bin_s=0.1)
    for source in ("derivative", "rates"):
        out = str(tmp_path / source)
        got = {x.rec_id: x for x in stages.run(recs, rois, out, params, shuffles=3, source=source).collect()}
        state = {(x.rec_id, x.stage): x for x in spark.read.parquet(f"{out}/stages").collect()}
        assert {k: x.status for k, x in got.items()} == {"a": "done", "b": "done", "slow": "partial", "lost": "partial"}
        assert state["slow", "events"].status == "failed" and state["slow", "events"].message and state["slow", "activation"].status == "skipped" and state["slow", "clusters"].status == "ok"
        assert state["lost", "traces"].status == "failed" and {state["lost", s].status for s in list(stages.NEEDS)[1:]} == {"skipped"}
        assert "events: " in got["slow"].messages and got["slow"].n_failed == 1
        assert {x.rec_id for x in spark.read.parquet(f"{out}/xcorr").collect()} == {"a", "b", "slow"}
    on = spark.read.parquet(f"{out}/onsets").where("rec_id = 'b'").collect()
    assert {x.onset_frame for x in on} == {3, 53, 103, 153} and all(abs(x.onset_s - x.onset_frame / 12.5) < 1e-9 for x in on)
    import pytest

    with pytest.raises(ValueError, match="no onset source"):
        stages.run(recs, rois, out, source="other")


def test_patches(spark):
    img = spark.createDataFrame([("a", y, x, float(10 * y + x), 1.0) for y in range(6) for x in range(6)], "rec_id string, y int, x int, mean double, peak double")
    feet = spark.createDataFrame([("a", 0, 0, 0), ("a", 0, 0, 1), ("a", 1, 3, 3)], "rec_id string, roi_id int, y int, x int")
    got = {r.roi_id: r for r in cells.patches(feet, img, 4).collect()}
    assert np.array(got[1].mean).reshape(4, 4)[0].tolist() == [11, 12, 13, 14] and sum(got[1].mask) == 1 and got[1].mask[10] == 1
    corner = np.array(got[0].mean).reshape(4, 4)
    assert corner[:2].sum() == 0 and corner[2, 2] == 0 and corner[3, 3] == 11 and np.array(got[0].mask).reshape(4, 4)[2].tolist() == [0, 0, 1, 1]
    z = cells.zscore_pixels(img, "mean").agg(F.avg("mean"), F.stddev_pop("mean")).first()
    assert abs(z[0]) < 1e-9 and abs(z[1] - 1) < 1e-9
    assert cells.zscore_pixels(img, "peak").where("peak != 0").count() == 0
    s = cells.score(spark.createDataFrame([("a", i, float(i)) for i in range(5)], "rec_id string, roi_id int, v double"), lambda d: d["v"] / 4, batch=2).collect()
    assert {r.roi_id: r.keep for r in s} == {0: False, 1: False, 2: True, 3: True, 4: True}


def test_baseline_and_labels(spark):
    r = np.random.default_rng(1)
    rows = [(float(x), float(r.standard_normal()), int(x + 0.1 * r.standard_normal() > 0.8)) for x in r.standard_normal(300)]
    df = spark.createDataFrame(rows, "a double, b double, label int")
    out = cells.fit_baseline(df, ["a", "b"]).transform(df)
    assert out.where("label = prediction").count() > 270
    raw = spark.createDataFrame([("p", "1", "1", 0), ("p", "1", "0", 1), ("p", "x", "1", 2), (None, "1", "1", 3), ("q", "2", "1.0", 4)], "path string, roi_id string, label string, n int")
    clean = cells.clean_labels(raw, "n")
    assert {(x.path, x.roi_id): x.label for x in clean.collect()} == {("p", 1): 0, ("q", 2): 1}
    new = spark.createDataFrame([("q", 2, 0, 9)], "path string, roi_id int, label int, n int")
    assert {(x.path, x.roi_id): x.label for x in cells.upsert_labels(clean, new).collect()} == {("p", 1): 0, ("q", 2): 0}


def test_splits(spark):
    df = spark.createDataFrame([(f"r{i % 10}", i, int(i % 7 == 0)) for i in range(100)], "rec string, i int, label int")
    g = cells.split_recordings(df, "rec").groupBy("rec").agg(F.countDistinct("validation").alias("n"), F.max("validation").alias("v")).collect()
    assert all(r.n == 1 for r in g) and sum(r.v for r in g) == 2
    s = {r.label: r.n for r in cells.split_stratified(df, "label", ["i"]).where("validation").groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert s == {0: 17, 1: 3}
    assert cells.split_stratified(df.limit(1), "label", ["i"]).where("validation").count() == 0
