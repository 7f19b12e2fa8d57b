"""Records around a recording: chosen settings, sheets, picks and edits by a user. Built-in functions only.

Settings are long rows of leaves (keys, path, value as text), as ``settings.as_text`` gives them.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def plane_view(parts: DataFrame, calibration: DataFrame | None = None) -> DataFrame:
    """Leaves (rec_id, part, path, value) of db, settings, reg and detect as one view (rec_id, name, value).

    The later part wins by the leaf's last step; 'ops' counts only for recordings with none of the four. A positive
    calibration (rec_id, pix_to_um) lies above all.
    """
    place = F.array_position(F.array(*map(F.lit, ("ops", "db", "settings", "reg", "detect"))), F.col("part"))
    named = parts.select("rec_id", F.substring_index("path", ".", -1).alias("name"), "value", place.cast("int").alias("_o"))
    known = named.where("_o > 0")
    canonical = known.where("_o > 1").select("rec_id").distinct().withColumn("_c", F.lit(True))
    used = known.join(canonical, "rec_id", "left").where("_o > 1 or _c is null")
    if calibration is not None:
        used = used.select("rec_id", "name", "value", "_o").unionByName(calibration.where("pix_to_um > 0").select("rec_id", F.lit("pix_to_um").alias("name"), F.col("pix_to_um").cast("string").alias("value"), F.lit(9).alias("_o")))
    return used.groupBy("rec_id", "name").agg(F.max_by("value", F.struct("_o", "value")).alias("value"))


def settings_key(settings: DataFrame, names: list[str], keys: list[str], recordings: DataFrame | None = None) -> DataFrame:
    """A cache key of each recording: SHA-256 of its chosen settings (keys, path, value), a missing one as null.

    Recordings with other settings alone have a key too, and so have those of ``recordings`` (keys) with none at all.
    """
    chosen = F.collect_list(F.when(F.col("path").isin(names), F.struct("path", "value")))
    found = settings.groupBy(*keys).agg(F.map_from_entries(F.array_sort(chosen)).alias("_m"))
    if recordings is not None:
        found = recordings.select(*keys).distinct().join(found, keys, "left")
    text = F.concat_ws(",", *(F.concat(F.lit(f"{n}="), F.coalesce(F.try_element_at("_m", F.lit(n)), F.lit("null"))) for n in sorted(names)))
    return found.select(*keys, F.sha2(text, 256).alias("cache_key"))


def cached(spark, path: str, settings: dict, make) -> DataFrame:
    """``make()`` kept as a table under ``path`` by a digest of the settings; the table is read where it is complete."""
    at = f"{path}/{hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()[:32]}"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def calibrate(recordings: DataFrame, stamps: DataFrame) -> DataFrame:
    """(rec_id, …, pix_to_um) with the newest positive stamp (rec_id, pix_to_um, at); others keep their value."""
    new = stamps.where("pix_to_um > 0").groupBy("rec_id").agg(F.max_by("pix_to_um", F.struct("at", "pix_to_um")).alias("_new"))
    return recordings.join(new, "rec_id", "left").withColumn("pix_to_um", F.coalesce("_new", "pix_to_um")).drop("_new")


def pair_clusters(pair: Column | str) -> Column:
    """The two cluster numbers of a pair's name such as 'C2xC10': its first two runs of digits, 0 for one that is missing or no integer."""
    found = F.regexp_extract_all(F.col(pair) if isinstance(pair, str) else pair, F.lit(r"(\d+)"), F.lit(1))
    number = lambda i: F.coalesce(F.try_element_at(found, F.lit(i)).try_cast("int"), F.lit(0))
    return F.struct(number(1).alias("a"), number(2).alias("b"))


def choose_pairs(pairs: DataFrame, included: list[int], name: str = "pair") -> DataFrame:
    """Pairs of which both clusters are included, with the numbers they sort by (pair_a, pair_b)."""
    p = pairs.withColumn("_p", pair_clusters(name)).withColumns({"pair_a": F.col("_p.a"), "pair_b": F.col("_p.b")}).drop("_p")
    return p.where(F.col("pair_a").isin(included) & F.col("pair_b").isin(included))


def representative_event(pairs: DataFrame, keys: tuple[str, ...] = ("rec_id",)) -> DataFrame:
    """The event with the most cluster pairs of each recording, then with the most rows, then the first."""
    per = pairs.groupBy(*keys, "event_id").agg(F.count_distinct("pair").alias("n_pairs"), F.count("*").alias("n_rows"))
    best = F.max_by(F.struct("event_id", "n_pairs", "n_rows"), F.struct("n_pairs", "n_rows", -F.col("event_id"))).alias("_b")
    return per.groupBy(*keys).agg(best).select(*keys, "_b.*")


def onset_order(onsets: DataFrame, units: DataFrame, keys: tuple[str, ...] = ("rec_id",), unit: str = "roi_id") -> DataFrame:
    """Onsets of each unit, silent ones too, and its place by falling count, then by unit."""
    n = onsets.groupBy(*keys, unit).agg(F.count("*").alias("n"))
    both = units.select(*keys, unit).join(n, [*keys, unit], "left").fillna(0, ["n"])
    return both.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), unit)) - 1)


def raster(onsets: DataFrame, frames: int, block: int, unit: str = "roi_id") -> DataFrame:
    """(…, unit, frame) to distinct bins; frames past the last full block count to the last bin."""
    bins = max(frames // block, 1)
    bin_ = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.col("frame") / block)))
    return onsets.withColumn("bin", bin_.cast("int")).drop("frame").distinct()


def onset_source(derivative: DataFrame, rates: DataFrame, source: str, threshold: float = 0.0) -> DataFrame:
    """Onset frames (rec_id, roi_id, frame): those of the derivative, or frames where a rate (…, frame, rate) rises above the threshold."""
    if source == "derivative":
        return derivative.select("rec_id", "roi_id", "frame")
    if source != "rates":
        raise ValueError(f"no onset source {source!r}")
    w = Window.partitionBy("rec_id", "roi_id").orderBy("frame")
    before = F.coalesce(F.lag("rate").over(w), F.lit(threshold))
    rises = rates.withColumn("_up", (F.col("rate") > threshold) & (before <= threshold))
    return rises.where("_up").select("rec_id", "roi_id", "frame")


def score_image(pixels: DataFrame, units: DataFrame) -> DataFrame:
    """The score p_cell of the last kept unit on each pixel: pixels (rec_id, roi_id, y, x), units (rec_id, roi_id, p_cell, keep)."""
    kept = units.where("keep").select("rec_id", "roi_id", "p_cell")
    return pixels.join(kept, ["rec_id", "roi_id"]).groupBy("rec_id", "y", "x").agg(F.max_by("p_cell", "roi_id").alias("score"))


def splat_rgb(pixels: DataFrame, colours: DataFrame, keys: tuple[str, ...] = ("rec_id",)) -> DataFrame:
    """Weighted mean colour on each pixel of a recording: pixels (rec_id, roi_id, y, x, w), colours (rec_id, roi_id, r, g, b); uncovered pixels have no row."""
    j = pixels.join(colours, [*keys, "roi_id"])
    mean = lambda c: (F.sum(F.col(c) * F.col("w")) / F.sum("w")).alias(c)
    return j.groupBy(*keys, "y", "x").agg(mean("r"), mean("g"), mean("b"), F.sum("w").alias("weight")).where("weight > 0").drop("weight")


def clicked(clicks: DataFrame, labels: DataFrame) -> DataFrame:
    """Clicks (…, rec_id, cy, cx) with the unit on their rounded pixel, NULL on the background."""
    at = clicks.withColumns({"y": F.rint("cy").cast("int"), "x": F.rint("cx").cast("int")})
    return at.join(labels.select("rec_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "roi_id"), ["rec_id", "y", "x"], "left")


def promote(mask: DataFrame, flips: DataFrame) -> DataFrame:
    """Keep flags (rec_id, roi_id, predicted, flag) with a user's last edits (rec_id, roi_id, keep, at) laid over them."""
    last = flips.groupBy("rec_id", "roi_id").agg(F.max_by("keep", "at").alias("_k"))
    base = F.coalesce(F.col("predicted"), F.col("flag") > 0, F.lit(False))
    return mask.join(last, ["rec_id", "roi_id"], "left").withColumn("keep", F.coalesce("_k", base)).drop("_k")


def slider_range(prominences: DataFrame, keys: list[str], value: str, current: float) -> DataFrame:
    """Ends of a slider that hold all prominences of a group, 0 and the current value, with five per cent above."""
    ends = prominences.groupBy(*keys).agg(F.least(F.min(value), F.lit(min(current, 0.0))).alias("low"), (F.greatest(F.max(value), F.lit(current)) * 1.05).alias("high"))
    return ends.withColumn("high", F.when(F.col("high") <= F.col("low"), F.col("low") + 1.0).otherwise(F.col("high")))


def merge_rows(queue: DataFrame, chosen: str = "chosen") -> DataFrame:
    """Chosen rows (place, tiffs, params, chosen) as one, at the first one's place and with its params; others stay.

    Files are taken once, by trailing number, then by path; the identifier joins their stems with '+'.
    """
    from tracelake.functions.scalars import trailing_index

    files = queue.where(F.col(chosen)).select("place", F.explode("tiffs").alias("f")).groupBy("f").agg(F.min("place").alias("_p"))
    one = files.agg(F.array_sort(F.collect_list(F.struct(trailing_index("f").alias("i"), "f"))).alias("_f"))
    stem = lambda e: F.regexp_replace(F.regexp_extract(e["f"], r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")
    first = queue.where(F.col(chosen)).agg(F.min("place").alias("place"), F.min_by("params", "place").alias("params")).where("place is not null")
    merged = first.crossJoin(one).select("place", F.array_join(F.transform("_f", stem), "+").alias("identifier"), F.transform("_f", lambda e: e["f"]).alias("tiffs"), "params")
    return queue.where(~F.coalesce(F.col(chosen), F.lit(False))).select("place", "identifier", "tiffs", "params").unionByName(merged)


def pad_projection(projection: DataFrame, frame: DataFrame) -> DataFrame:
    """A cropped projection (rec_id, y, x, v) at its place (rec_id, y0, x0, height, width) in the full image, 0 around it."""
    cell = F.explode(F.expr("sequence(0, height * width - 1)")).alias("_i")
    full = frame.select("rec_id", "width", cell).select("rec_id", F.expr("cast(_i div width as int)").alias("y"), F.expr("cast(_i % width as int)").alias("x"))
    placed = projection.join(frame, "rec_id").select("rec_id", (F.col("y") + F.col("y0")).cast("int").alias("y"), (F.col("x") + F.col("x0")).cast("int").alias("x"), "v")
    return full.join(placed, ["rec_id", "y", "x"], "left").fillna(0.0, ["v"])


def palette(colours: list[str], n: int) -> list[str]:
    """``n`` colours spread over a list from its first to its last; the whole list where it is shorter, or n is 0."""
    if n <= 0 or n > len(colours):
        return list(colours)
    if n == 1:
        return [colours[0]]
    return [colours[round(i * (len(colours) - 1) / (n - 1))] for i in range(n)]


def gradient(anchors: list[tuple[float, str]], n: int) -> list[str]:
    """``n`` colours '#rrggbb' evenly along a continuous map, given by colours at rising places from 0 to 1; one colour is the middle's."""
    parts = [(at, tuple(int(c[i : i + 2], 16) for i in (1, 3, 5))) for at, c in anchors]
    out = []
    for i in range(n):
        t = i / (n - 1) if n > 1 else 0.5
        high = next((k for k, (at, _) in enumerate(parts) if at >= t), len(parts) - 1)
        (a, low), (b, up) = parts[max(0, high - 1)], parts[high]
        share = (t - a) / (b - a) if b > a else 0.0
        out.append("#" + "".join(f"{int(x + (y - x) * share + 0.5):02x}" for x, y in zip(low, up, strict=True)))
    return out


def cluster_summary(clusters: DataFrame, colours: list[str]) -> DataFrame:
    """Each cluster's size, share of its recording's units and colour; colours start anew after the last."""
    n = clusters.groupBy("rec_id", "cluster_id").agg(F.count("*").alias("n_units"))
    share = F.col("n_units") / F.sum("n_units").over(Window.partitionBy("rec_id"))
    place = F.row_number().over(Window.partitionBy("rec_id").orderBy("cluster_id")) - 1
    colour = F.element_at(F.array(*map(F.lit, colours)), (place % len(colours) + 1).cast("int"))
    return n.withColumns({"share": share, "colour": colour})


def leaf_check(merges: DataFrame, units: DataFrame) -> DataFrame:
    """Stored linkages against the units of now: a linkage of n - 1 merges fits n units; 'stale' otherwise."""
    m = merges.groupBy("rec_id").agg((F.count("*") + 1).alias("leaves"))
    u = units.groupBy("rec_id").agg(F.count("*").alias("units"))
    return u.join(m, "rec_id", "left").withColumn("verdict", F.when(F.col("leaves").isNull(), "missing").when(F.col("leaves") == F.col("units"), "fits").otherwise("stale"))


def distinct_counts(df: DataFrame, columns: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *(F.count_distinct(c).alias(f"n_{c}") for c in columns))


def ragged(columns: DataFrame, names: list[str], name: str = "name", ordinal: str = "i", value: str = "value") -> DataFrame:
    """Named columns of unlike lengths (name, ordinal, value) side by side; shorter ones end in NULL, blank in a CSV."""
    return columns.groupBy(ordinal).pivot(name, names).agg(F.first(value))


def recording_sheets(recordings: DataFrame, units: DataFrame, windows: DataFrame, onsets: DataFrame, clusters: DataFrame, spread: DataFrame | None = None) -> dict[str, DataFrame]:
    """The result sheets by name; every unit is named by roi_id and its place among the kept ones (kept_pos).

    recordings (rec_id, fps, …), units (rec_id, roi_id, keep, …), windows (rec_id, event_id, start_s, end_s), onsets
    (rec_id, roi_id, t), clusters (rec_id, roi_id, cluster_id). ``RoiEventTimes`` holds all onsets of a unit in an event.
    With ``spread`` (rec_id, event_id, theta, rho, p_value, q), ``EventMonotonicity`` has a row for each window: the angle
    in degrees from 0 to 360, and nulls where an event has no direction.
    """
    place = F.row_number().over(Window.partitionBy("rec_id").orderBy("roi_id")) - 1
    kept = units.where("keep").withColumn("kept_pos", place)
    n = units.groupBy("rec_id").agg(F.count("*").alias("n_units"), F.count_if("keep").alias("n_kept"))
    hits = in_windows(onsets, windows).join(kept.select("rec_id", "roi_id", "kept_pos"), ["rec_id", "roi_id"])
    active = hits.groupBy("rec_id", "event_id").agg(F.count_distinct("roi_id").alias("n_active"), F.min("t").alias("first_s"))
    times = hits.groupBy("rec_id", "event_id", "roi_id", "kept_pos").agg(F.array_sort(F.collect_list("t")).alias("times_s"))
    sheets = {}
    if spread is not None:
        degrees = F.pmod(F.degrees("theta"), F.lit(360.0)).alias("theta_deg")
        found = spread.select("rec_id", "event_id", degrees, "rho", "p_value", "q")
        sheets["EventMonotonicity"] = windows.join(active.select("rec_id", "event_id", "n_active"), ["rec_id", "event_id"], "left").fillna(0, ["n_active"]).join(found, ["rec_id", "event_id"], "left")
    return sheets | {
        "Recording": recordings.join(n, "rec_id", "left").fillna(0, ["n_units", "n_kept"]),
        "ROIs": units.join(kept.select("rec_id", "roi_id", "kept_pos"), ["rec_id", "roi_id"], "left"),
        "Events": windows.join(active, ["rec_id", "event_id"], "left").fillna(0, ["n_active"]),
        "EventOnsets": hits.select("rec_id", "event_id", "roi_id", "kept_pos", (F.col("t") - F.col("start_s")).alias("rel_s")),
        "RoiEventTimes": times,
        "Clusters": clusters.join(kept.select("rec_id", "roi_id", "kept_pos"), ["rec_id", "roi_id"]),
    }


def in_windows(onsets: DataFrame, windows: DataFrame, cell: float = 300.0) -> DataFrame:
    cells = windows.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("start_s") / cell), F.floor(F.col("end_s") / cell))))
    at = onsets.withColumn("_cell", F.floor(F.col("t") / cell))
    return at.join(cells, ["rec_id", "_cell"]).where("t between start_s and end_s").drop("_cell")


def group_trace(traces: DataFrame, how: str, keys: tuple[str, ...] = (), frame: str = "frame", value: str = "value", units: DataFrame | None = None, unit: str = "roi_id") -> DataFrame:
    """Mean or median over the units of each frame; with ``units`` (keys, unit), a set named by hand, over these alone."""
    of = {"mean": F.avg, "median": F.median}[how]
    if units is not None:
        traces = traces.join(units.select(*keys, unit).distinct(), [*keys, unit], "left_semi")
    return traces.groupBy(*keys, frame).agg(of(value).alias(how))


def best_unit(units: DataFrame, keys: list[str], score: str, unit: str) -> DataFrame:
    """The unit of the highest score in each group; of equal scores the last unit."""
    return units.groupBy(*keys).agg(F.max_by(unit, F.struct(score, unit)).alias("best"))


def against_mask(wanted: DataFrame, mask: DataFrame, key: str) -> DataFrame:
    """Wanted ids with ``known``: whether the mask holds them. The unknown ones are those to report and leave out."""
    there = mask.select(key).distinct().withColumn("_there", F.lit(True))
    return wanted.join(there, key, "left").withColumn("known", F.coalesce("_there", F.lit(False))).drop("_there")


def scale_rows(df: DataFrame, column: str) -> DataFrame:
    """Each array to 0..1 between its own ends; 0 where these are equal."""
    low, high = F.array_min(column), F.array_max(column)
    return df.withColumn(column, F.transform(column, lambda x: F.when(high > low, (x - low) / (high - low)).otherwise(F.lit(0.0))))


def status_report(rows: DataFrame, key: str, kind: str, kinds: list[str]) -> DataFrame:
    """One row a key with the count of each kind, 0 where there is none."""
    wide = rows.groupBy(key).pivot(kind, kinds).count()
    return wide.select(key, *(F.coalesce(c, F.lit(0)).alias(f"n_{c}") for c in kinds))
