"""Small operators at their edges, and the files that lie beside recordings."""

import json

import numpy as np
import pytest

from tracelake.operators import events, records, tables, traces
from tracelake.sources import files


def test_specs_outside_their_range(spark):
    df = spark.createDataFrame([("1-3, 0", 5), ("4", 5), ("", 5)], "s string, n int")
    assert [r.ids for r in tables.parse_spec(df, "s", "n").collect()] == [[0, 1, 2, 3], [4], []]
    for bad in ("5", "2-9", "x"):
        with pytest.raises(Exception, match="names units outside 0 to 4"):
            tables.parse_spec(spark.createDataFrame([(bad, 5)], "s string, n int"), "s", "n").collect()


def test_histogram_edges(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.999, 1.0, 2.0, 2.0001, -0.1, float("nan"), None)], "v double")
    assert {r.bin: r.n for r in tables.histogram(df, "v", 0.0, 2.0, 2).collect()} == {0: 2, 1: 2}


def test_quiet_noise_is_the_kernels(spark):
    from tracelake.kernels.events import DEFAULT, quiet_noise

    x = np.random.default_rng(0).standard_normal(300).round(2)
    few = x[:20]
    df = spark.createDataFrame([("a", float(v)) for v in x] + [("b", float(v)) for v in few], "rec_id string, v double")
    got = {r.rec_id: r.noise for r in tables.quiet_noise(df, "v").collect()}
    for k, v in (("a", x), ("b", few)):
        assert abs(got[k] - quiet_noise(v, np.zeros(len(v)), DEFAULT)) < 1e-9


def test_difference_with_nulls(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y"), (2, None)], "k int, t string")
    assert [r.k for r in tables.difference(a, a.where("k is null or k = 1"), ["k", "t"]).collect()] == [2]


def test_curves_in_blocks(spark):
    from tracelake.kernels import stats

    x = np.random.default_rng(1).standard_normal((7, 50))
    t = spark.createDataFrame([("r", i, v.tolist()) for i, v in enumerate(x)], "rec_id string, unit int, x array<double>")
    want = stats.curves(x.T, x.T, 4)
    for block in (64, 2, 3):
        got = events.pair_curves(t, 4, ("rec_id",), block).collect()
        assert len(got) == want.size and all(abs(want[g.k + 4, g.unit_a, g.unit_b] - g.c) < 1e-9 for g in got)


def test_sources_of_traces(spark):
    t = spark.createDataFrame([("a", 1, [1.0], [2.0])], "rec_id string, roi_id int, dff array<double>, lp array<double>")
    assert events.trace_source(t, "lowpass").first().x == [2.0]
    for name in ("rates", "other"):
        with pytest.raises(ValueError, match="no trace"):
            events.trace_source(t, name)


def test_gradient_and_manual_set(spark):
    assert records.gradient([(0.0, "#000000"), (0.5, "#ff0000"), (1.0, "#ffffff")], 5) == ["#000000", "#800000", "#ff0000", "#ff8080", "#ffffff"]
    assert records.gradient([(0.0, "#000000"), (1.0, "#00ff00")], 1) == ["#008000"] and records.gradient([(0.0, "#010203")], 2) == ["#010203"] * 2
    t = spark.createDataFrame([(1, 0, 2.0), (2, 0, 4.0), (3, 0, 100.0)], "roi_id int, frame int, value double")
    assert records.group_trace(t, "mean", units=t.where("roi_id < 3")).first()["mean"] == 3


def test_files_beside_recordings(spark, tmp_path):
    for rec, text in (("2024-01-01_1", json.dumps({"rec_id": "x", "params": {"a": 1, "s": "t", "n": {"m": [1]}}, "tau": 0.7, "fs": "no"})), ("2024-01-01_2", "{broken"), ("2024-01-01_3", '{"params": 5}')):
        (tmp_path / rec / "figures").mkdir(parents=True)
        (tmp_path / rec / "figures" / "manifest.json").write_text(text)
    got = {r.rec_id: (r.params, r.tau, r.fs, r.bad) for r in files.read_manifests(spark, str(tmp_path)).collect()}
    assert got == {"2024-01-01_1": ({"a": "1", "s": "t", "n": '{"m":[1]}'}, 0.7, None, False), "2024-01-01_2": ({}, None, None, True), "2024-01-01_3": ({}, None, None, False)}
    files.write_sidecar(spark, str(tmp_path / "2024-01-01_1"), ["/raw/b.tif", "/raw/a.tif"])
    files.write_sidecar(spark, str(tmp_path / "2024-01-01_1"), ["/raw/a.tif"])
    (tmp_path / "2024-01-01_2" / "raw_paths.json").write_text("no")
    side = files.read_sidecars(spark, str(tmp_path))
    assert {r.rec_id: r.raw_paths for r in side.collect()} == {"2024-01-01_1": ["/raw/a.tif"], "2024-01-01_2": []}
    names = {"2024-01-01_1": ("mean.npy", "qc.gif"), "2024-01-01_2": ("mean.npy", "qc.gif", "010_shifted_x_10.tif", "002_shifted_x_2.TIFF"), "2024-01-01_3": ("mean.npy",), "2024-01-01_4": ("other",)}
    listing = spark.createDataFrame([(f"/d/{rec}/{n}",) for rec, all_ in names.items() for n in all_], "path string")
    state = {r.rec_id: (r.state, [p[-4:] for p in r.shifted], r.raw) for r in files.finished_preprocess(listing, side).collect()}
    assert state == {"2024-01-01_1": ("archived", [], ["/raw/a.tif"]), "2024-01-01_2": ("complete", ["TIFF", ".tif"], []), "2024-01-01_3": ("partial", [], [])}


def test_mean_distances_of_blocks_are_those_of_all_pairs(spark):
    from pyspark.sql import functions as F

    r = np.random.default_rng(8)
    rows = [(g, i, v.tolist()) for g, n in (("a", 40), ("b", 7), ("one", 1)) for i, v in enumerate(r.standard_normal((n, 5)) + 1e4)]
    rows += [("a", 40 + i, rows[3][2]) for i in range(9)] + [("a", 3, rows[5][2]), ("b", 20, None), ("b", 21, [1.0, None, 2.0, 3.0, 4.0]), ("b", 22, [1.0, 2.0]), ("b", 23, [0.0] * 5), (None, 1, [1.0] * 5), ("b", None, [1.0] * 5), ("inf", 1, [float("inf")]), ("inf", 2, [0.0]), ("none", 1, None), ("none", 2, [1.0])]
    t = spark.createDataFrame(rows, "g string, id int, e array<double>")
    a, b = (t.select("g", F.col("id").alias(f"id_{k}"), F.col("e").alias(f"e_{k}")) for k in "ab")
    dist = F.sqrt(F.expr("aggregate(zip_with(e_a, e_b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)"))
    want = {r.g: (r.n, r.m) for r in a.join(b, "g").where("id_a < id_b").groupBy("g").agg(F.count("*").alias("n"), F.avg(dist).alias("m")).collect()}
    assert want["none"] == (1, None) and "one" not in want
    for block in (8192, 16, 3):
        got = {r.g: (r.n, r.mean_dist) for r in traces.mean_distances(t, "g", "id", "e", block).collect()}
        assert got == {k: (n, m if m is None else pytest.approx(m, rel=1e-12)) for k, (n, m) in want.items()}
