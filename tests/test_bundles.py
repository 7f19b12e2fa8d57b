"""Bundles, archives, metadata versions, kept sums, resized frames and watched folders."""

import hashlib
import json
import os
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.operators import images, tables
from tracelake.sources import archive, bundle, commits
from tracelake.streaming import folders


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_bundle_round_trip_and_broken_links(spark, tmp_path):
    units = spark.createDataFrame([("a", 7, [1, 2], [3, 4], [0.5, 1.0]), ("a", 3, [], [], []), ("b", 1, list(range(3000)), list(range(3000)), [1.0] * 3000), ("b", 2, [5], [6], [0.1])], "rec_id string, roi_id int, ypix array<int>, xpix array<int>, lam array<double>")
    traces = spark.createDataFrame([("a", 7, "dff", [1.0, 2.0]), ("b", 2, "dff", [3.0]), ("b", 2, "lp", [])], "rec_id string, roi_id int, name string, x array<double>")
    intervals = spark.createDataFrame([("a", 0, 0.5, 1.5, [7, 3]), ("a", 1, 0.1, 0.2, []), ("b", 0, 1.0, 1.0, [1])], "rec_id string, event_id int, start_s double, end_s double, roi_ids array<int>")
    at = str(tmp_path / "bundle")
    bundle.write(at, units, traces, intervals)
    got = bundle.read(spark, at)
    assert rows(got["units"]) == rows(units) and rows(got["traces"]) == rows(traces) and rows(got["intervals"]) == rows(intervals)
    lost = traces.unionByName(spark.createDataFrame([("a", 99, "dff", [0.0])], traces.schema))
    backwards = intervals.withColumn("end_s", F.lit(0.0))
    for args, kind in (((units, lost, intervals), "traces.unit: 1"), ((units, traces, backwards), "intervals.bounds: 3"), ((units.where("rec_id = 'b'"), traces, intervals), "interval_units.unit: 2")):
        with pytest.raises(bundle.BrokenBundle, match=kind):
            bundle.write(at, *args)
    assert rows(bundle.read(spark, at)["units"]) == rows(units)
    parts = bundle.load(spark, at)
    for name, bad in (("units", parts["units"].withColumn("pixels_end", F.col("pixels_end") + 1)), ("pixels", parts["pixels"].where("at != 1")), ("units", parts["units"].where("row != 0"))):
        assert bundle.violations(parts | {name: bad}).count()
    assert bundle.violations(parts).count() == 0


def test_archive_is_identical_or_refused(spark, tmp_path):
    r = np.random.default_rng(0)
    src, out = tmp_path / "raw", str(tmp_path / "out")
    src.mkdir()
    movie = (1000 + r.standard_normal((50, 64, 64)).cumsum(0)).astype("<u2")
    content = {"movie.bin": movie.tobytes(), "odd.bin": b"abc", "none.bin": b"", "noise.bin": r.bytes(5001), "flat.bin": b"\1\0" * 9000}
    for name, raw in content.items():
        (src / name).write_bytes(raw)
        assert archive.decode(*archive.encode(raw)) == raw
    got = archive.rewrite(spark, str(src), out, size=4096)
    assert {(os.path.basename(x.path), x.verdict) for x in got.collect()} == {(n, "identical") for n in content if n != "none.bin"}
    blocks = archive.current(spark, out)
    stored = blocks.where("path like '%movie.bin'").agg(F.sum(F.length("data"))).first()[0]
    assert stored < 0.6 * len(content["movie.bin"])
    files = spark.read.format("binaryFile").load(str(src))
    flip = F.when(F.col("path").like("%noise.bin") & (F.col("block") == 1), F.expr("unhex(concat(substr(hex(data), 1, 40), if(substr(hex(data), 41, 1) = '0', '1', '0'), substr(hex(data), 42)))")).otherwise(F.col("data"))
    bad = blocks.withColumn("data", flip)
    assert {os.path.basename(x.path) for x in archive.differences(bad, files).where("verdict != 'identical'").collect()} == {"noise.bin"}
    assert {x.verdict for x in archive.differences(blocks.where("not (path like '%movie.bin' and block = 3)"), files).where("path like '%movie.bin'").collect()} == {"damaged"}
    bad.write.parquet(f"{out}/archive-bad")
    with pytest.raises(archive.NotIdentical, match="noise.bin"):
        archive.place(spark, out, "archive-bad", files, commits.swap)
    assert not os.path.exists(f"{out}/archive-bad") and archive.current(spark, out).count() == blocks.count()


def test_one_of_two_writers_wins(spark, tmp_path):
    at = str(tmp_path / "rec1")
    assert commits.latest(spark, at) == (0, {})
    assert commits.commit(spark, at, {"a": {"x": 1}}, 0) == 1
    with pytest.raises(commits.Conflict):
        commits.commit(spark, at, {"a": 2}, 0)
    assert commits.latest(spark, at) == (1, {"a": {"x": 1}})
    failed = []

    def work(i):
        try:
            commits.update(spark, at, {"a": {f"k{i}": i}, "n": None}, tries=200)
        except Exception as gone:  # noqa: BLE001
            failed.append(gone)

    threads = [threading.Thread(target=work, args=(i,)) for i in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    number, content = commits.latest(spark, at)
    assert not failed and number == 7 and content == {"a": {"x": 1, **{f"k{i}": i for i in range(6)}}, "n": None}
    commits.update(spark, str(tmp_path / "rec2"), {"fs": 30})
    got = {r.rec_id: (r.version, json.loads(r.settings)) for r in commits.metadata(spark, str(tmp_path)).collect()}
    assert got == {"rec1": (7, content), "rec2": (1, {"fs": 30})}


def test_sums_are_kept_and_only_new_files_are_read(spark, tmp_path):
    r = np.random.default_rng(1)
    movie = r.standard_normal((12, 4, 5))
    px = spark.createDataFrame([(rec, f"f{t // 4}", t, y, x, float(movie[t, y, x] * (1 if rec == "a" else t))) for rec in "ab" for t in range(12) for y in range(4) for x in range(5)], "rec_id string, path string, frame int, y int, x int, v double")
    files = [(rec, f"f{i}", hashlib.sha256(f"{rec}{i}".encode()).hexdigest()) for rec in "ab" for i in range(3)]
    table = lambda some: spark.createDataFrame(some, "rec_id string, path string, sha256 string")
    asked = []

    def read(some):
        asked.append(sorted((x.rec_id, x.path) for x in some.collect()))
        return px.join(F.broadcast(some), ["rec_id", "path"], "left_semi")

    state = str(tmp_path / "sums")
    assert images.add_to_sums(state, table(files[:2]), read) == ["f0", "f1"]
    assert images.add_to_sums(state, table(files), read) == ["f0", "f1", "f2", "f2"]
    assert images.add_to_sums(state, table(files), read) == [] and asked == [[("a", "f0"), ("a", "f1")], [("a", "f2"), ("b", "f0"), ("b", "f1"), ("b", "f2")]]
    key = lambda df: {(x.rec_id, x.y, x.x): round(x["corr"], 9) for x in df.collect()}
    assert key(images.corr_of_state(spark, state, table(files))) == key(tables.neighbour_corr(px))
    assert key(images.corr_of_state(spark, state, table(files[:2]))) == key(tables.neighbour_corr(px.where("rec_id = 'a' and path != 'f2'")))


def test_resize_by_area(spark):
    r = np.random.default_rng(2)
    for (h, w), (m, n) in (((6, 8), (3, 4)), ((5, 7), (3, 2)), ((3, 4), (5, 4)), ((4, 4), (1, 1))):
        v = r.standard_normal((2, h, w))
        px = spark.createDataFrame([("a", t, y, x, float(v[t, y, x])) for t in range(2) for y in range(h) for x in range(w)], "rec_id string, frame int, y int, x int, v double")
        got = {(g.frame, g.y, g.x): g.v for g in images.resize(px, (h, w), (m, n)).collect()}
        fine = np.repeat(np.repeat(v, m, 1), n, 2).reshape(2, m, h, n, w).mean((2, 4))
        assert len(got) == 2 * m * n and all(abs(fine[k] - x) < 1e-9 for k, x in got.items())


def test_files_are_passed_on_once_after_a_quiet_second(spark, tmp_path):
    src, done, check = (str(tmp_path / n) for n in ("looks", "out", "check"))
    os.makedirs(src)

    def batch(i, looks):
        with open(f"{src}/{i}.json", "w") as f:
            f.writelines(json.dumps(dict(zip(("path", "length", "modified", "seen"), x))) + "\n" for x in looks)
        seen = spark.readStream.schema(folders.LOOK).json(src)  # a new query each time: the state comes from its checkpoint
        q = folders.stable_files(seen).writeStream.option("checkpointLocation", check).format("json").option("path", done).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return sorted((r.path, r.length, r.stable) for r in spark.read.schema(folders.STABLE).json(done).collect())

    assert batch(0, [("a", 10, 1.0, 100.0), ("b", 5, 1.0, 100.0), (None, 1, 1.0, 100.0)]) == []
    assert batch(1, [("a", 20, 1.5, 101.0), ("b", 5, 1.0, 100.9)]) == []
    assert batch(2, [("a", 20, 1.5, 101.9), ("b", 5, 1.0, 101.0)]) == [("b", 5, 101.0)]
    assert batch(3, [("a", 20, 1.5, 102.0), ("b", 5, 1.0, 105.0), ("b", 9, 9.0, 109.0), ("b", 9, 9.0, 120.0)]) == [("a", 20, 102.0), ("b", 5, 101.0)]


def test_a_watched_folder(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    (root / "x.tif").write_bytes(b"12345")
    (root / "y.txt").write_bytes(b"1")
    q = folders.stable_files(folders.looks(spark, str(root), ".tif"), 0.5).writeStream.option("checkpointLocation", str(tmp_path / "c")).format("memory").queryName("watched").outputMode("append").trigger(processingTime="300 milliseconds").start()
    try:
        for _ in range(120):
            got = spark.table("watched").collect()
            if got:
                break
            time.sleep(0.5)
    finally:
        q.stop()
    assert [(os.path.basename(g.path), g.length) for g in got] == [("x.tif", 5)]
