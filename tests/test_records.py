"""Records around a recording: cases that the check SQL does not reach."""

import pytest

from tracelake.operators import records as ops


def test_keys_of_recordings_without_settings(spark):
    leaves = spark.createDataFrame([(1, "a", "x"), (2, "other", "y")], "rec int, path string, value string")
    got = {r.rec: r.cache_key for r in ops.settings_key(leaves, ["a"], ["rec"], spark.createDataFrame([(i,) for i in (1, 2, 3)], "rec int")).collect()}
    assert len(got) == 3 and got[2] == got[3] != got[1]


def test_numbers_beyond_their_types(spark):
    from tracelake.functions import scalars

    df = spark.createDataFrame([("C12345678901xC2", "rec_12345678901234567890.tif"), ("C1xC2", "rec_7.tif"), ("x", "none")], "pair string, path string")
    got = df.select(ops.pair_clusters("pair").alias("p"), scalars.trailing_index("path").alias("i")).collect()
    assert [(g.p.a, g.p.b, g.i) for g in got] == [(0, 2, None), (1, 2, 7), (0, 0, -1)]


def test_recordings_do_not_mix(spark):
    from tracelake.operators import images, tables

    px = spark.createDataFrame([("a", 1, 0, 0, 1.0), ("b", 1, 0, 0, 1.0), ("b", 2, 0, 0, 3.0)], "rec_id string, roi_id int, y int, x int, w double")
    colours = spark.createDataFrame([("a", 1, 1.0, 0.0, 0.0), ("b", 1, 0.0, 1.0, 0.0), ("b", 2, 0.0, 0.0, 1.0)], "rec_id string, roi_id int, r double, g double, b double")
    assert {r.rec_id: (r.r, r.g, r.b) for r in ops.splat_rgb(px, colours).collect()} == {"a": (1, 0, 0), "b": (0, 0.25, 0.75)}
    assert {r.rec_id: r.image for r in tables.splat(px, "roi_id", "w").collect()} == {"a": 1, "b": 1.75}
    extra = px.select("rec_id", px["roi_id"].alias("unit"), "y", "x")
    assert [r.rec_id for r in tables.drop_overlapping(extra, extra.where("rec_id = 'b'")).collect()] == ["a"]
    movie = spark.createDataFrame([(rec, t, 0, x, float(v)) for rec, vs in (("a", [(1, 1), (2, 2), (3, 3)]), ("b", [(1, 3), (2, 2), (3, 1)])) for t, v2 in enumerate(vs) for x, v in enumerate(v2)], "rec_id string, frame int, y int, x int, v double")
    assert {(r.rec_id, r.x): round(r["corr"], 9) for r in tables.neighbour_corr(movie).collect()} == {("a", 0): 1, ("a", 1): 1, ("b", 0): -1, ("b", 1): -1}
    assert images.mean_image(movie).count() == 4


def test_cached_table_is_made_once(spark, tmp_path):
    made = []
    make = lambda: made.append(1) or spark.range(3)
    for size in (1, 1, 2):
        assert ops.cached(spark, str(tmp_path), {"size": size, "x": None}, make).count() == 3
    assert len(made) == 2


def test_palette_spreads_over_the_list():
    five = list("abcde")
    assert [ops.palette(five, n) for n in (0, 1, 2, 3, 9)] == [five, ["a"], ["a", "e"], ["a", "c", "e"], five]


def test_onset_source(spark):
    rates = spark.createDataFrame([(1, 1, f, v) for f, v in enumerate([0.0, 2.0, 3.0, 0.0, 1.0])], "rec_id int, roi_id int, frame int, rate double")
    assert sorted(r.frame for r in ops.onset_source(rates, rates, "rates").collect()) == [1, 4]
    assert ops.onset_source(rates, rates, "derivative").count() == 5
    with pytest.raises(ValueError, match="no onset source"):
        ops.onset_source(rates, rates, "other")


def test_merge_rows_without_a_choice(spark):
    q = spark.createDataFrame([(0, "a", ["/x/a_2.tif"], "p", False), (1, "b", ["/x/a_1.tif"], "q", None)], "place int, identifier string, tiffs array<string>, params string, chosen boolean")
    assert ops.merge_rows(q).count() == 2
