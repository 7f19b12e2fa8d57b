"""Table operators over units, traces, onsets and windows: DataFrame in, DataFrame out, built-in functions only.

Keys are column names; traces are long rows (key, frame, value). Windows are partitioned by keys: a recording or a unit
is the unit of skew, as in the data model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _by(keys: list[str]) -> Window:
    return Window.partitionBy(*keys)


def density(onsets: DataFrame, units: int, bin_s: float, time: str = "t") -> DataFrame:
    """Onsets per bin and unit with zero bins; units counts silent ones too."""
    counts = onsets.groupBy(F.floor(F.col(time) / bin_s).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    ends = counts.agg(F.min("bin").alias("a"), F.max("bin").alias("b")).where("a is not null")
    bins = ends.select(F.explode(F.sequence("a", "b")).alias("bin"))
    n = F.coalesce("n", F.lit(0))
    return bins.join(counts, "bin", "left").select("bin", n.alias("n"), (n / F.lit(float(units))).alias("rate"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, bin, n) of equal bins from ``low`` to ``high``, empty ones too; the last one is closed, values outside and NaN are left out."""
    inside = df.where((F.col(value) >= low) & (F.col(value) <= high) & ~F.isnan(F.col(value).cast("double")))
    at = F.least(F.floor((F.col(value) - low) / F.lit((high - low) / bins)), F.lit(bins - 1)).cast("int")
    counts = inside.groupBy(*keys, at.alias("bin")).agg(F.count("*").alias("n"))
    every = F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    groups = df.select(*keys).distinct().select(*keys, every) if keys else df.sparkSession.range(1).select(every)
    return groups.join(counts, [*keys, "bin"], "left").fillna(0, ["n"])


def quiet_noise(df: DataFrame, value: str, keys: tuple[str, ...] = ("rec_id",), percent: float = 40, factor: float = 1.4826, least: int = 32) -> DataFrame:
    """(keys, noise): scaled MAD of the values up to a percentile; of all of them if that leaves fewer than ``least``.

    Medians come from counts of values, of which rounded densities have few.
    """
    if not keys:
        return quiet_noise(df.withColumn("_g", F.lit(0)), value, ("_g",), percent, factor, least).drop("_g")
    per = df.groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    cut = per.groupBy(*keys).agg(F.percentile("_v", F.lit(percent / 100), F.col("_n")).alias("_c"))
    marked = per.join(cut, list(keys)).withColumn("_q", F.col("_v") <= F.col("_c"))
    enough = marked.groupBy(*keys).agg((F.sum(F.when(F.col("_q"), F.col("_n")).otherwise(0)) >= least).alias("_e"))
    used = marked.join(enough, list(keys)).where("_q or not _e").select(*keys, "_v", "_n")
    middle = used.groupBy(*keys).agg(F.percentile("_v", F.lit(0.5), F.col("_n")).alias("_m"))
    away = used.join(middle, list(keys)).select(*keys, F.abs(F.col("_v") - F.col("_m")).alias("_d"), "_n")
    return away.groupBy(*keys).agg((factor * (F.percentile("_d", F.lit(0.5), F.col("_n")) + F.lit(1e-12))).alias("noise"))


def subtract_neuropil(df: DataFrame, trace: str, neuropil: str, r: float = 0.7) -> DataFrame:
    """``trace`` less ``r`` times its neuropil; where the latter is missing the trace stays."""
    return df.withColumn("f", F.col(trace) - F.lit(r) * F.coalesce(F.col(neuropil), F.lit(0.0)))


def spike_raster(df: DataFrame, keys: list[str], frame: str, value: str, z: float = 4.0) -> DataFrame:
    """(keys, frame) where a trace's step from the frame before has a robust z of at least ``z``."""
    step = F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(frame))
    steps = df.withColumn("_d", step).where("_d is not null")
    return robust_z(steps, keys, "_d").where(F.col("z") >= z).select(*keys, frame)


def difference(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys the other table lacks; null keys are equal to null keys."""
    known = other.select(*(F.col(k).alias(f"_o{i}") for i, k in enumerate(keys))).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_o{i}")) for i, k in enumerate(keys)]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return df.join(known, on, "left_anti")


def smooth(bins: DataFrame, sigma: float, order: str = "bin", value: str = "rate", keys: tuple[str, ...] = ()) -> DataFrame:
    """Gaussian FIR with held ends; the kernel's radius is int(4 sigma + 0.5)."""
    from math import exp

    r = int(4 * sigma + 0.5)
    k = [exp(-0.5 * (j / sigma) ** 2) for j in range(-r, r + 1)]
    w = Window.partitionBy(*keys).orderBy(order)
    whole = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first(value).over(whole), F.last(value).over(whole)
    parts = [(F.coalesce(F.lag(value, -j).over(w), last if j > 0 else first) if j else F.col(value)) * F.lit(c / sum(k)) for j, c in zip(range(-r, r + 1), k, strict=True)]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return bins.withColumn("smooth", total)


def interval_join(points: DataFrame, windows: DataFrame, time: str = "t", start: str = "start_s", end: str = "end_s", cell: float = 300.0) -> DataFrame:
    """Points in closed windows by an equi-join on time cells; each window is dealt to the cells it touches."""
    cells = windows.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(start) / cell), F.floor(F.col(end) / cell))))
    at = points.withColumn("_cell", F.floor(F.col(time) / cell))
    return at.join(cells, "_cell").where((F.col(time) >= F.col(start)) & (F.col(time) <= F.col(end))).drop("_cell")


def activation(onsets: DataFrame, windows: DataFrame, unit: str = "unit", cell: float = 300.0) -> DataFrame:
    """First onset of each unit in each window; no row stands for an inactive unit."""
    return interval_join(onsets.select(unit, "t"), windows, cell=cell).groupBy("event_id", unit).agg(F.min("t").alias("first_time_s"))


def activation_rank(active: DataFrame, unit: str = "unit") -> DataFrame:
    return active.withColumn("rank", F.row_number().over(Window.partitionBy("event_id").orderBy("first_time_s", unit)))


def zscore(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Population z-score; flat groups become 0."""
    m, s = F.avg(value).over(_by(keys)), F.stddev_pop(value).over(_by(keys))
    return df.withColumn("z", F.when(s > 0, (F.col(value) - m) / s).otherwise(F.lit(0.0)))


def robust_z(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    med = df.groupBy(*keys).agg(F.median(value).alias("med"))
    both = df.join(med, keys)
    mad = both.groupBy(*keys).agg(F.median(F.abs(F.col(value) - F.col("med"))).alias("mad"))
    return both.join(mad, keys).withColumn("z", (F.col(value) - F.col("med")) / (F.lit(1.4826) * (F.col("mad") + F.lit(1e-12))))


def hysteresis(df: DataFrame, keys: list[str], frame: str, z: str, high: float, low: float) -> DataFrame:
    """Rows where an idle trace reaches ``high``; it is idle again at ``low`` (low < high)."""
    w = Window.partitionBy(*keys).orderBy(frame)
    state = F.last(F.when(F.col(z) >= high, 1).when(F.col(z) <= low, 0), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    on = df.withColumn("_on", F.coalesce(state, F.lit(0)))
    return on.withColumn("_before", F.coalesce(F.lag("_on").over(w), F.lit(0))).where("_on = 1 and _before = 0").drop("_on", "_before")


def min_separation(df: DataFrame, keys: list[str], time: str, gap: float, strict: bool = False) -> DataFrame:
    """Greedy spacing against the last kept time, one fold over each unit's sorted times."""
    sign = ">" if strict else ">="
    fold = f"aggregate(ts, cast(array() as array<double>), (a, x) -> if(size(a) = 0 or x - element_at(a, -1) {sign} {gap!r}D, array_append(a, x), a))"
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.col(time).cast("double"))).alias("ts")).select(*keys, F.explode(F.expr(fold)).alias(time))


def dff_first_n(df: DataFrame, keys: list[str], frame: str, value: str, n: int) -> DataFrame:
    base = F.avg(F.when(F.col(frame) < n, F.col(value))).over(_by(keys))
    return df.withColumn("dff", (F.col(value) - base) / F.greatest(base, F.lit(1e-9)))


def fill_missing(df: DataFrame, keys: list[str], frame: str, value: str) -> DataFrame:
    """Linear interpolation over NULLs, ends held. Both windows run, the second one backwards: linear in a unit's rows."""
    back = Window.partitionBy(*keys).orderBy(frame).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(F.desc(frame)).rowsBetween(Window.unboundedPreceding, 0)
    known = F.when(F.col(value).isNotNull(), F.col(frame))
    out = df.select("*", F.last(value, True).over(back).alias("_v0"), F.last(known, True).over(back).alias("_f0"), F.last(value, True).over(ahead).alias("_v1"), F.last(known, True).over(ahead).alias("_f1"))
    line = F.expr(f"case when _f0 is null then _v1 when _f1 is null then _v0 when _f1 = _f0 then _v0 else _v0 + (_v1 - _v0) * ({frame} - _f0) / (_f1 - _f0) end")
    return out.withColumn("filled", line).drop("_v0", "_f0", "_v1", "_f1")


def savgol_interior(df: DataFrame, keys: list[str], frame: str, value: str, half: int, fps: float) -> DataFrame:
    """First derivative of order-2 windows; NULL at the ends."""
    w = Window.partitionBy(*keys).orderBy(frame)
    total = sum((F.lead(value, k).over(w) - F.lag(value, k).over(w)) * k for k in range(1, half + 1))
    return df.withColumn("dt", total * F.lit(fps / (2 * sum(k * k for k in range(1, half + 1)))))


def downsample(df: DataFrame, keys: list[str], frame: str, value: str, block: int) -> DataFrame:
    """Means of full blocks; a shorter last one is left out."""
    out = df.groupBy(*keys, F.floor(F.col(frame) / block).alias("block")).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    return out.where(F.col("n") == block).drop("n")


def best_lags(curves: DataFrame, fps: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Best lag of each curve (keys, unit_a, unit_b, k, c), its correlation and the zero-lag one; ties go to the earliest lag."""
    best = F.max_by("k", F.struct(F.round("c", 9), -F.col("k")))
    out = curves.groupBy(*keys, "unit_a", "unit_b").agg(best.alias("k"), F.max("c").alias("max_corr"), F.max(F.when(F.col("k") == 0, F.col("c"))).alias("zero_lag_corr"))
    leader = F.when(F.col("k") < 0, "A").when(F.col("k") > 0, "B").otherwise("none")
    return out.select(*keys, "unit_a", "unit_b", (F.col("k") / fps).alias("best_lag_sec"), "max_corr", "zero_lag_corr", leader.alias("leader"))


def cut_counts(heights: DataFrame, keys: list[str], height: str, target: tuple[int, int] = (4, 5)) -> DataFrame:
    """Clusters of a merge tree cut at 0.90, 0.89, ... 0.05 of its greatest height, and whether the cut is the wanted one.

    Wanted is the first with a number in ``target``, or 0.90 if there is none.
    """
    top = heights.select(*keys, F.col(height).alias("h")).withColumn("top", F.max("h").over(_by(keys)))
    at = F.explode(F.transform(F.sequence(F.lit(90), F.lit(5), F.lit(-1)), lambda i: i / 100.0)).alias("fraction")
    n = top.select(*keys, "h", "top", at).groupBy(*keys, "fraction").agg((F.sum((F.col("h") > F.col("fraction") * F.col("top")).cast("long")) + 1).alias("n"))
    first = F.coalesce(F.max(F.when(F.col("n").between(*target), F.col("fraction"))).over(_by(keys)), F.lit(0.9))
    return n.withColumn("chosen", F.col("fraction") == first)


def average_rank(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Ranks from 1 inside keys, ties at their mean."""
    w = Window.partitionBy(*keys).orderBy(value)
    return df.withColumn(name, F.rank().over(w) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2.0)


def angle_sweep(points: DataFrame, keys: list[str], angles: int = 360) -> DataFrame:
    """Rank correlation of time with place along each direction: (keys, x, y, t) to (keys, angle in degrees, rho)."""
    ranked = average_rank(points, keys, "t", "rt")
    deg = F.explode(F.transform(F.sequence(F.lit(0), F.lit(angles - 1)), lambda i: i * (360.0 / angles))).alias("angle")
    at = ranked.select(*keys, "x", "y", "rt", deg)
    along = F.round(F.col("x") * F.cos(F.radians("angle")) + F.col("y") * F.sin(F.radians("angle")), 9)
    return average_rank(at.withColumn("s", along), [*keys, "angle"], "s", "rs").groupBy(*keys, "angle").agg(F.corr("rs", "rt").alias("rho"))


def jumps(df: DataFrame, keys: list[str], frame: str, value: str, k: float = 6.0, gap: int = 5) -> DataFrame:
    """Frames after absolute differences above median + k * 1.4826 * MAD, more than ``gap`` apart by greedy spacing."""
    w = Window.partitionBy(*keys).orderBy(frame)
    d = df.withColumn("d", F.abs(F.col(value) - F.lag(value).over(w))).where("d is not null")
    both = d.join(d.groupBy(*keys).agg(F.median("d").alias("m")), keys)
    mad = both.groupBy(*keys).agg(F.median(F.abs(F.col("d") - F.col("m"))).alias("a"))
    high = both.join(mad, keys).where(F.col("d") > F.col("m") + F.lit(k * 1.4826) * F.col("a"))
    return min_separation(high, keys, frame, float(gap), strict=True).withColumn(frame, F.col(frame).cast("long"))


def bh_fdr(df: DataFrame, p: str, keys: list[str] = (), cells: int = 1024) -> DataFrame:
    """Benjamini-Hochberg q values inside keys; a null p has none and does not count.

    Equal p values have one q, so that ranks are those of the values with their counts. Values are dealt to ``cells`` cells of
    the range from 0 to 1: windows run inside a cell, and over the cells of a key alone.
    """
    keys = list(keys)
    if not keys:
        return bh_fdr(df.withColumn("_g", F.lit(0)), p, ["_g"], cells).drop("_g")
    per = df.where(F.col(p).isNotNull()).groupBy(*keys, F.col(p).alias("_p")).agg(F.count("*").alias("_n"))
    per = per.withColumn("_cell", F.greatest(F.lit(0), F.least(F.lit(cells - 1), F.floor(F.col("_p") * cells))))
    sums = per.groupBy(*keys, "_cell").agg(F.sum("_n").alias("_c"))
    up = Window.partitionBy(*keys).orderBy("_cell")
    sums = sums.select(*keys, "_cell", (F.sum("_c").over(up) - F.col("_c")).alias("_before"), F.sum("_c").over(Window.partitionBy(*keys)).alias("_all"))
    inside = Window.partitionBy(*keys, "_cell")
    ranked = per.join(sums, [*keys, "_cell"]).withColumn("_rank", F.col("_before") + F.sum("_n").over(inside.orderBy("_p")))
    ranked = ranked.withColumn("_q", F.col("_p") * F.col("_all") / F.col("_rank"))
    least = ranked.groupBy(*keys, "_cell").agg(F.min("_q").alias("_m"))
    later = F.min("_m").over(Window.partitionBy(*keys).orderBy(F.desc("_cell")).rowsBetween(Window.unboundedPreceding, -1))
    own = F.min("_q").over(inside.orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, 0))
    q = ranked.withColumn("_own", own).join(least.select(*keys, "_cell", later.alias("_later")), [*keys, "_cell"])
    q = q.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_p", F.least(F.lit(1.0), "_own", F.coalesce("_later", F.lit(1.0))).alias("q"))
    on = F.col(p) == F.col("_p")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return df.join(q, on, "left").drop("_p", *(f"_k{i}" for i in range(len(keys))))


def auroc(df: DataFrame, label: str, score: str, grain: float = 4096.0) -> DataFrame:
    """Rank-sum area with average ranks on ties, from counts of each score.

    Scores are dealt to cells of width 1 / ``grain``: windows run inside cells, and one over the cells' counts alone.
    """
    cell = F.floor(F.col(score) * grain)
    per = df.groupBy(score).agg(F.sum(F.col(label)).alias("pos"), F.count("*").alias("n")).withColumn("_cell", cell)
    cells = per.groupBy("_cell").agg(F.sum("n").alias("_n"))
    cells = cells.select("_cell", (F.sum("_n").over(Window.orderBy("_cell")) - F.col("_n")).alias("_before"))
    per = per.join(cells, "_cell")
    below = F.col("_before") + F.sum("n").over(Window.partitionBy("_cell").orderBy(score)) - F.col("n")
    total = per.withColumn("rank", below + (F.col("n") + 1) / 2).agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    return total.select(((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * (F.col("n") - F.col("p")))).alias("auroc"))


def splat(pixels: DataFrame, value: str, weight: str, keys: tuple[str, ...] = ("rec_id",)) -> DataFrame:
    """Weighted mean of unit values on each (y, x) of a recording; uncovered pixels have no row."""
    return pixels.groupBy(*keys, "y", "x").agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("image"))


def drop_overlapping(extra: DataFrame, primary: DataFrame, limit: float = 0.3, keys: tuple[str, ...] = ("rec_id",)) -> DataFrame:
    """Units of ``extra`` (rec_id, unit, y, x) whose share of pixels covered by ``primary`` in the same recording is below ``limit``."""
    seen = primary.select(*keys, "y", "x").distinct().withColumn("hit", F.lit(1.0))
    share = extra.join(seen, [*keys, "y", "x"], "left").groupBy(*keys, "unit").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("covered"))
    return share.where(F.col("covered") < limit)


def keep_mask(df: DataFrame, persisted: str, predicted: str, flag: str) -> DataFrame:
    return df.withColumn("keep", F.coalesce(F.col(persisted), F.col(predicted), F.col(flag) > 0, F.lit(True)))


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def parse_spec(df: DataFrame, spec: str, count: str | None = None) -> DataFrame:
    """'1-3,7' to sorted distinct ids; reversed ranges count. With a column ``count``, ids not below it, or no numbers, are an error."""
    part = f"transform(filter(split({spec}, ','), x -> trim(x) != ''), x -> transform(split(trim(x), '-'), y -> try_cast(trim(y) as int)))"
    out = df.withColumn("ids", F.expr(f"array_sort(array_distinct(flatten(transform({part}, r -> if(r[0] is null or element_at(r, -1) is null, array(cast(null as int)), sequence(least(r[0], element_at(r, -1)), greatest(r[0], element_at(r, -1))))))))"))
    if count is None:
        return out
    bad = F.exists("ids", lambda i: i.isNull() | (i < 0) | (i >= F.col(count)))
    told = F.raise_error(F.format_string("'%s' names units outside 0 to %d", F.col(spec), F.col(count) - 1)).cast("array<int>")
    return out.withColumn("ids", F.when(bad, told).otherwise(F.col("ids")))


def runs(df: DataFrame, key: str, value: str) -> DataFrame:
    """Ids to compact runs 'a-b,c' by gaps and islands."""
    g = df.select(key, value).distinct().withColumn("g", F.col(value) - F.row_number().over(Window.partitionBy(key).orderBy(value)))
    ends = g.groupBy(key, "g").agg(F.min(value).alias("a"), F.max(value).alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    return ends.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("a", text.alias("s")))), lambda x: x["s"]), ",").alias("runs"))


def neighbour_sums(pixels: DataFrame, keys: tuple[str, ...] = ("rec_id",)) -> DataFrame:
    """Sums over frames of a pixel v and the mean w of its four neighbours: (keys, y, x, t, sx, sy, sxy, sxx, syy).

    Pixels (keys, frame, y, x, v). Sums of parts of a recording add up to those of the whole.
    """
    moves = F.explode(F.expr("array(struct(1 as dy, 0 as dx), struct(-1 as dy, 0 as dx), struct(0 as dy, 1 as dx), struct(0 as dy, -1 as dx))"))
    near = pixels.select(*keys, "frame", "y", "x", "v", moves.alias("m")).select(*keys, "frame", (F.col("y") + F.col("m.dy")).alias("y"), (F.col("x") + F.col("m.dx")).alias("x"), F.col("v").alias("w"))
    mean = near.groupBy(*keys, "frame", "y", "x").agg(F.avg("w").alias("w"))
    both = pixels.join(mean, [*keys, "frame", "y", "x"])
    return both.groupBy(*keys, "y", "x").agg(F.count("*").alias("t"), F.sum("v").alias("sx"), F.sum("w").alias("sy"), F.sum(F.col("v") * F.col("w")).alias("sxy"), F.sum(F.col("v") * F.col("v")).alias("sxx"), F.sum(F.col("w") * F.col("w")).alias("syy"))


def corr_of_sums(sums: DataFrame, keys: tuple[str, ...] = ("rec_id",)) -> DataFrame:
    """Pearson of each pixel from sums, added up over all rows of the pixel; flat pixels are 0."""
    s = sums.groupBy(*keys, "y", "x").agg(*(F.sum(c).alias(c) for c in ("t", "sx", "sy", "sxy", "sxx", "syy")))
    d = F.expr("(t * sxx - sx * sx) * (t * syy - sy * sy)")
    return s.select(*keys, "y", "x", F.when(d > 1e-9, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.expr("t * sxy - sx * sy") / F.sqrt(d)))).otherwise(F.lit(0.0)).alias("corr"))


def neighbour_corr(pixels: DataFrame, keys: tuple[str, ...] = ("rec_id",)) -> DataFrame:
    """Pearson of a pixel with the mean of its four neighbours over frames, in each recording."""
    return corr_of_sums(neighbour_sums(pixels, keys), keys)
