"""Files, scalars and images on planted inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.functions import scalars
from tracelake.operators import images
from tracelake.sources import files


def one(spark, expr):
    return spark.range(1).select(expr).first()[0]


def test_scalars(spark):
    lit = F.lit
    assert one(spark, scalars.recording_of(lit("/a/2024-07-01_00018/x/plane0/F.npy"))) == "2024-07-01_00018"
    assert one(spark, scalars.recording_of(lit("/a/2024-07-01_1+2024-07-01_2/F.npy"))) == "2024-07-01_1+2024-07-01_2"
    assert one(spark, scalars.recording_of(lit("/a/b"))) is None
    assert [one(spark, scalars.trailing_index(lit(p))) for p in ("/a1/rec_012.tif", "rec", "a3b.tif")] == [12, -1, 3]
    assert one(spark, scalars.is_filtered(lit("r0p7_filtered_"))) and not one(spark, scalars.is_filtered(lit("r0p7_unfiltered")))
    assert [one(spark, scalars.tau(lit(x))) for x in ("GCaMP6s", "jGCaMP 8F (old)", "2026-06-08m", None)] == [1.5, 0.15, 0.25, 0.25]
    assert one(spark, scalars.um_per_px(lit(0.0), lit(2.0), lit(512), lit(9.0))) == pytest.approx(3080.90169 / 1024)
    assert one(spark, scalars.um_per_px(lit(-1.0), lit(None), lit(512), lit(9.0))) == 9
    assert [one(spark, scalars.bar_length(lit(float(x)))) for x in (3081, 120, 9.9, 40, 0)] == [500, 20, 2, 10, None]
    assert one(spark, scalars.event_label(lit(1.5), lit(2.0))) == "1p50-2p00s"
    assert [one(spark, scalars.scratch_verdict(lit(f), lit(10), lit(p), 5.0)) for f, p in ((20, 0), (12, 1), (12, 0))] == ["ok", "wait", "fail"]
    assert one(spark, scalars.out_of_memory(lit("CUDA out of memory")))


def test_matrices_and_listing(spark, tmp_path):
    d = tmp_path / "2024-01-02_3" / "detection" / "plane0"
    d.mkdir(parents=True)
    x = np.arange(12, dtype=np.float32).reshape(4, 3)
    (d / "m.float32").write_bytes(x.tobytes())
    np.save(d / "F.npy", x.T)
    np.save(d / "stat.npy", np.zeros(3))
    rows = {r.roi_id: r.x for r in files.raw_matrix(spark, str(d / "m.float32"), 3).collect()}
    assert rows == {i: x[:, i].tolist() for i in range(3)}
    got = files.npy_matrix(spark, str(d / "F.npy")).orderBy("roi_id").collect()
    assert got[0].rec_id == "2024-01-02_3" and [r.x for r in got] == x.T.tolist()
    assert files.npy_matrix(spark, str(d / "F.npy"), highest_id=3).count() == 4
    with pytest.raises(Exception, match="not rows of 5"):
        files.raw_matrix(spark, str(d / "m.float32"), 5).collect()
    every = files.listing(spark, str(tmp_path))
    assert {r.level for r in every.collect()} == {3} and files.listing(spark, str(tmp_path), depth=2).count() == 0
    have = files.inventory(every).first()
    assert have.has_detection and not have.has_lowpass and not have.has_preprocess
    assert len(files.checksums(spark, str(d / "F.npy")).first().sha256) == 64


def test_queue_and_notes(spark, tmp_path):
    (tmp_path / "q.csv").write_text('identifier,tiffs,params\na,x.tif; y.tif ,"{""fps"": 3}"\nb,z.tif,[1]\n,,\nc,w.tif,{bad\nd,v.tif,\n')
    q = files.read_queue(spark, str(tmp_path / "q.csv")).orderBy("identifier")
    assert [(r.identifier, r.tiffs, r.params, r.bad_params) for r in q.collect()] == [("a", ["x.tif", "y.tif"], {"fps": "3"}, False), ("b", ["z.tif"], {}, True), ("c", ["w.tif"], {}, True), ("d", ["v.tif"], {}, False)]
    files.write_queue(q, str(tmp_path / "out"))
    assert files.read_queue(spark, str(tmp_path / "out")).where("identifier = 'a' and params['fps'] = '3'").count() == 1
    recs = spark.createDataFrame([("2024-01-01_5",), ("2024-01-01_6",), ("2024-01-01_7",)], "rec_id string")
    notes = spark.createDataFrame([(" 2024-01-01-5 ", 30.0), ("x-6", 20.0), ("2024-09-09-5", 1.0)], "filename string, rate double")
    assert [r.fps for r in files.frame_rates(recs, notes).orderBy("rec_id").collect()] == [30.0, 20.0, 15.07]


def test_manifests_and_sheets(spark, tmp_path):
    schema = "rec_id string, params map<string,string>, tau double, fs double"
    old = spark.createDataFrame([("a", {"x": "1", "y": "2"}, 0.7, 15.0), ("b", None, None, None)], schema)
    new = spark.createDataFrame([("a", {"y": "3"}, 0.0, 30.0)], schema)
    got = {r.rec_id: r for r in files.merge_manifests(old, new).collect()}
    assert (got["a"].params, got["a"].tau, got["a"].fs) == ({"x": "1", "y": "3"}, 0.7, 30.0) and got["b"].params == {}
    book = str(tmp_path / "book")
    s = "start_s string, end_s string, rec_id string"
    files.write_sheet(spark.createDataFrame([("1", "2", "a"), ("5", "6", "b")], s), book, "Events")
    files.write_sheet(spark.createDataFrame([("3", "4", "a"), ("bad", "4", "a"), ("0", "1", "a")], s), book, "Events")
    w = files.event_windows(files.read_sheet(spark, book, "Events")).orderBy("rec_id", "event_id").collect()
    assert [(r.rec_id, r.event_id, r.start_s) for r in w] == [("a", 0, 0.0), ("a", 1, 3.0), ("b", 0, 5.0)]
    files.write_pairs_csv(spark.createDataFrame([(1, 1 / 3)], "a int, r double"), str(tmp_path / "pairs"))
    assert spark.read.option("header", True).csv(str(tmp_path / "pairs")).first().r == "0.333333"
    t = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.6), (1, 1, 0.7)], "frame int, roi_id int, value double")
    assert [tuple(r) for r in files.wide(t, [1, 2]).orderBy("frame").collect()] == [(0, 0.5, 0.6), (1, 0.7, None)]


def test_images(spark):
    px = spark.createDataFrame([("a", f, 0, x, f * 10 + x - 5) for f in range(6) for x in range(2)], "rec_id string, frame int, y int, x int, v int")
    assert images.shift_to_uint16(px, ["rec_id"]).agg(F.min("v"), F.max("v")).first() == (0, 51)
    with pytest.raises(Exception, match="65535"):
        images.shift_to_uint16(px.withColumn("v", F.col("v") * 10000), ["rec_id"]).collect()
    assert {r.grey for r in images.preview(px, 5).collect()} <= set(range(256))
    assert images.heat_rows(px, ["rec_id"], "v").where("heat = 255").count() >= 1
    assert images.mean_image(px, ()).orderBy("x").first().mean == 20
    f = spark.createDataFrame([("a", "r_10.tif", 3), ("a", "r_2.tif", 4)], "rec_id string, path string, n_frames int")
    assert {r.path: r.first_frame for r in images.global_frames(f).collect()} == {"r_2.tif": 0, "r_10.tif": 4}
    rois = spark.createDataFrame([("a", 0, [0, 1, 9], [0, 1, 0], [1.0, 1.0, 1.0])], "rec_id string, roi_id int, ypix array<int>, xpix array<int>, lam array<double>")
    feet = images.footprints(rois, 4, 4)
    assert feet.count() == 2 and images.unit_rows(feet).first().npix == 2 and images.label_image(feet).count() == 2
    extra = spark.createDataFrame([("a", 0, 0, 0), ("a", 1, 3, 3)], "rec_id string, roi_id int, y int, x int")
    merged = images.merge_passes(feet.drop("w"), [("extra", extra)]).select("roi_id", "source").distinct().orderBy("roi_id").collect()
    assert [tuple(r) for r in merged] == [(0, "primary"), (1, "extra")]
