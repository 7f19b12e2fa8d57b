"""Population events, per-event statistics and cluster pairs of recordings.

Dense kernels run on one recording (or one event of it) over Arrow; all else is built-in functions. A recording is the
unit of size: its traces are one group, as in the data model, and recordings are spread over the cluster.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelake.kernels import events as kernel
from tracelake.kernels import signal, stats
from tracelake.operators import tables
from tracelake.operators.guard import guarded, names, with_error

EVENTS = "rec_id string, event_id int, start_s double, peak_s double, end_s double, height double, prominence double, mu_s double, sigma_s double, source_left string, source_right string, floor double, noise double"
PAIRS = "rec_id string, event_id int, cluster_a int, cluster_b int, roi_a int, roi_b int, best_lag_sec double, max_corr double, zero_lag_corr double, p_value double, p_value_fdr double"


def detect_events(onsets: DataFrame, recordings: DataFrame, params: kernel.EventParams = kernel.DEFAULT, guard: bool = False) -> DataFrame:
    """Event windows of each recording.

    ``onsets``: (rec_id, roi_id, onset_s); ``recordings``: (rec_id, duration_s, n_rois), silent units counted. A recording
    without onsets has no events.
    """
    trains = onsets.where("onset_s is not null").groupBy("rec_id", "roi_id").agg(F.sort_array(F.collect_list("onset_s")).alias("train"))
    both = trains.join(recordings.select("rec_id", "duration_s", "n_rois"), "rec_id")

    def run(pdf):
        pdf = pdf.sort_values("roi_id")
        found = [np.asarray(t, float) for t in pdf["train"]]
        found += [np.zeros(0)] * (int(pdf["n_rois"].iloc[0]) - len(found))
        rows = kernel.detect(found, float(pdf["duration_s"].iloc[0]), params)
        return pd.DataFrame([{"rec_id": pdf["rec_id"].iloc[0], **r} for r in rows], columns=names(EVENTS))

    return both.groupBy("rec_id").applyInPandas(guarded(run, EVENTS, ["rec_id"], guard), with_error(EVENTS, guard))


ONSETS = "rec_id string, roi_id int, onset_frame int, onset_s double"


def onset_frames(traces: DataFrame, fps: float | str, high: float = 3.5, low: float = 1.5, gap_s: float = 0.1, tau_s: float | None = None, min_rise: float = 0.0, guard: bool = False) -> DataFrame:
    """(rec_id, roi_id, dt, lp) to onsets at the feet of their rises; one map, no shuffle. ``fps``: a number or a column."""
    own = isinstance(fps, str)

    def of(pdf):
        rows = []
        for rec, roi, dt, lp, rate in zip(pdf["rec_id"], pdf["roi_id"], pdf["dt"], pdf["lp"], pdf[fps] if own else [fps] * len(pdf), strict=True):
            if dt is not None and lp is not None and len(dt):
                at = signal.hysteresis(signal.robust_z(dt), high, low, int(gap_s * rate))
                rows += [(rec, roi, int(k), k / rate) for k in kernel.backtrack(at, lp, kernel.backtrack_window(rate, tau_s), min_rise)]
        return pd.DataFrame(rows, columns=names(ONSETS))

    def run(batches):
        one = guarded(of, ONSETS, ["rec_id", "roi_id"], guard)
        for pdf in batches:
            if not guard:
                yield of(pdf)
            else:
                yield from (one(pdf.iloc[i : i + 1]) for i in range(len(pdf)))

    return traces.select("rec_id", "roi_id", "dt", "lp", *([fps] if own else [])).mapInPandas(run, with_error(ONSETS, guard))


def _members(traces: DataFrame, clusters: DataFrame, column: str, *more: str) -> DataFrame:
    ids = clusters.select("rec_id", "roi_id", "cluster_id").distinct()
    return traces.select("rec_id", "roi_id", F.col(column).alias("x"), *more).join(ids, ["rec_id", "roi_id"])


def cluster_pairs(clusters: DataFrame) -> DataFrame:
    """Pairs of clusters of each recording, a <= b, self pairs included; clusters are few, units stay out of it."""
    one = clusters.select("rec_id", "cluster_id").distinct()
    a, b = one.withColumnRenamed("cluster_id", "cluster_a"), one.withColumnRenamed("cluster_id", "cluster_b")
    return a.join(b, "rec_id").where("cluster_a <= cluster_b").withColumn("is_self", F.expr("cluster_a = cluster_b"))


def cluster_correlation(traces: DataFrame, clusters: DataFrame, fps: float | str, max_lag: float = 2.0, shuffles: int = 500, seed: int = 0, column: str = "lp", windows: DataFrame | None = None, min_frames: int = 8, guard: bool = False) -> DataFrame:
    """All unit pairs of every cluster pair, one task a cluster pair (and event); q values inside each of them.

    With ``windows`` (rec_id, event_id, start_s, end_s), traces are cropped to [rint(start * fps), rint(end * fps)), shorter
    crops than ``min_frames`` are left out, lags reach one frame less than the crop, and there is no null.
    Pair number within a recording is added to the seed. ``fps``: a number or a column of the traces.
    """
    rate = F.col(fps) if isinstance(fps, str) else F.lit(float(fps))
    pairs = cluster_pairs(clusters)
    pairs = pairs.withColumn("number", F.row_number().over(Window.partitionBy("rec_id").orderBy("cluster_a", "cluster_b")) - 1)
    member = _members(traces.withColumn("_fps", rate), clusters, column, "_fps")
    left = pairs.join(member.withColumnRenamed("cluster_id", "cluster_a"), ["rec_id", "cluster_a"]).withColumn("side", F.lit(0))
    right = pairs.join(member.withColumnRenamed("cluster_id", "cluster_b"), ["rec_id", "cluster_b"]).withColumn("side", F.lit(1))
    both = left.unionByName(right).withColumn("event_id", F.lit(None).cast("int"))
    if windows is not None:
        crop = windows.select("rec_id", F.col("event_id").cast("int").alias("event_id"), "start_s", "end_s")
        both = both.drop("event_id").join(crop, "rec_id").withColumns({"i": F.greatest(F.rint(F.col("start_s") * F.col("_fps")).cast("int"), F.lit(0)), "j": F.rint(F.col("end_s") * F.col("_fps")).cast("int")})
        both = both.withColumn("x", F.expr("slice(x, i + 1, greatest(j - i, 0))")).where(F.size("x") >= min_frames).drop("i", "j", "start_s", "end_s")
    per_event = windows is not None

    def run(pdf):
        pdf = pdf.sort_values(["side", "roi_id"])
        a, b = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        if a.empty or b.empty:
            return pd.DataFrame(columns=names(PAIRS))
        fps = float(pdf["_fps"].iloc[0])
        xa, xb = (np.stack([np.asarray(v, float) for v in s["x"]], 1) for s in (a, b))
        lag, best, zero = stats.lagged(xa, xb, fps, max_lag)
        p = np.full(lag.shape, np.nan) if per_event else stats.shift_null(xa, xb, fps, max_lag, shuffles, seed + int(pdf["number"].iloc[0]))
        i, j = (k.ravel() for k in np.indices(lag.shape))
        first = pdf.iloc[0]
        out = {"rec_id": first["rec_id"], "event_id": first["event_id"], "cluster_a": first["cluster_a"], "cluster_b": first["cluster_b"], "roi_a": a["roi_id"].to_numpy()[i], "roi_b": b["roi_id"].to_numpy()[j]}
        out |= {"best_lag_sec": lag.ravel(), "max_corr": best.ravel(), "zero_lag_corr": zero.ravel(), "p_value": p.ravel(), "p_value_fdr": p.ravel() if per_event else stats.fdr(p.ravel())}
        return pd.DataFrame(out)

    found = both.groupBy("rec_id", "event_id", "cluster_a", "cluster_b").applyInPandas(guarded(run, PAIRS, ["rec_id"], guard), with_error(PAIRS, guard))
    leader = F.expr("case when best_lag_sec < 0 then 'A' when best_lag_sec > 0 then 'B' else 'none' end")
    found = found.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("p_value", "p_value_fdr")})
    return found.withColumns({"leader": leader, "is_diagonal": F.col("roi_a") == F.col("roi_b")})


def crop(traces: DataFrame, windows: DataFrame, fps: float, column: str = "x", least: int = 1) -> DataFrame:
    """(rec_id, unit, x) to (rec_id, event_id, unit, x) cut to [rint(start * fps), rint(end * fps)); shorter ones than ``least`` go."""
    w = windows.select("rec_id", "event_id", F.greatest(F.rint(F.col("start_s") * fps).cast("int"), F.lit(0)).alias("_i"), F.rint(F.col("end_s") * fps).cast("int").alias("_j"))
    cut = F.slice(F.col(column), F.col("_i") + 1, F.greatest(F.col("_j") - F.col("_i"), F.lit(0)))
    return traces.join(w, "rec_id").select("rec_id", "event_id", "unit", cut.alias("x")).where(F.size("x") >= least)


def pair_curves(traces: DataFrame, limit: int, keys: tuple[str, ...] = (), block: int = 64) -> DataFrame:
    """Correlation of all pairs of units at lags from -limit to limit: (keys, unit, x) to (keys, unit_a, unit_b, k, c).

    Traces of a group are of one length and z-scored here; c is the sum over the frames where both lie, over all frames.
    Units are dealt to blocks of ``block``, and each pair of blocks is one task, so that a group spreads over the
    cluster and a trace is sent once a block. Pairs come in both directions.
    """
    kind = {f.name: f.dataType.simpleString() for f in traces.schema.fields}
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("unit")) - 1
    rows = traces.select(*keys, "unit").withColumn("_b", (place / block).cast("int"))
    last = rows.groupBy(*keys).agg(F.max("_b").alias("_last")) if keys else rows.agg(F.max("_b").alias("_last"))
    rows = rows.join(last, list(keys)) if keys else rows.crossJoin(F.broadcast(last))
    both = F.explode(F.expr("transform(sequence(0, _last), o -> struct(least(_b, o) as p, greatest(_b, o) as q))"))
    at = traces.select(*keys, "unit", "x").join(rows.select(*keys, "unit", "_b", both.alias("_p")), [*keys, "unit"]).select(*keys, "unit", "x", "_b", "_p.p", "_p.q")
    schema = ", ".join([*(f"`{c}` {kind[c]}" for c in keys), f"unit_a {kind['unit']}", f"unit_b {kind['unit']}", "k int", "c double"])

    def run(pdf):
        pdf = pdf.sort_values("unit")
        p, q = pdf["p"].iloc[0], pdf["q"].iloc[0]
        a, b = pdf[pdf["_b"] == p], pdf[pdf["_b"] == q]
        c = stats.curves(*(np.stack([np.asarray(x, float) for x in s["x"]], 1) for s in (a, b)), limit)
        lags = np.arange(c.shape[0]) - (c.shape[0] - 1) // 2
        k, i, j = (v.ravel() for v in np.indices(c.shape))
        out = [pd.DataFrame({"unit_a": a["unit"].to_numpy()[i], "unit_b": b["unit"].to_numpy()[j], "k": lags[k], "c": c.ravel()})]
        if p != q:  # the other direction: lags change their sign
            out.append(pd.DataFrame({"unit_a": b["unit"].to_numpy()[j], "unit_b": a["unit"].to_numpy()[i], "k": -lags[k], "c": c.ravel()}))
        found = pd.concat(out)
        for n, c in enumerate(keys):
            found.insert(n, c, pdf[c].iloc[0])
        return found

    return at.groupBy(*keys, "p", "q").applyInPandas(run, schema)


def partial_correlation(traces: DataFrame, column: str = "lp", ridge: float = 1e-6) -> DataFrame:
    """Partial correlations of all units of a recording; no rows where units reach half the frames."""
    schema = "rec_id string, roi_a int, roi_b int, partial_corr double"

    def run(pdf):
        pdf = pdf.sort_values("roi_id")
        ids, x = pdf["roi_id"].to_numpy(), np.stack([np.asarray(v, float) for v in pdf[column]], 1)
        got = stats.partial(x, ridge)
        if got is None:
            return pd.DataFrame(columns=["rec_id", "roi_a", "roi_b", "partial_corr"])
        i, j = (k.ravel() for k in np.indices(got.shape))
        return pd.DataFrame({"rec_id": pdf["rec_id"].iloc[0], "roi_a": ids[i], "roi_b": ids[j], "partial_corr": got.ravel()})

    return traces.select("rec_id", "roi_id", column).groupBy("rec_id").applyInPandas(run, schema)


def sign_flip(pairs: DataFrame, keys: list[str], value: str, permutations: int | None = 10_000, seed: int = 0) -> DataFrame:
    """Mean and two-sided sign-flip p of each group's non-null values.

    Without ``permutations``, groups of up to 20 values are held against all their sign patterns, and larger ones are an error.
    """
    kind = pairs.select(*keys, F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kind.schema.fields[:-1]), "n long, mean double, p_value double"])

    def run(pdf):
        x = np.sort(pdf["v"].to_numpy())
        p = stats.sign_flip_exact(x) if permutations is None else stats.sign_flip(x, permutations, seed)
        return pdf.head(1)[keys].assign(n=len(x), mean=x.mean(), p_value=p)

    return kind.groupBy(*keys).applyInPandas(run, schema)


def marked(df: DataFrame, p: str = "p_value") -> DataFrame:
    """Stars of a p value."""
    return df.withColumn("marker", F.when(F.col(p) < 0.001, "***").when(F.col(p) < 0.01, "**").when(F.col(p) < 0.05, "*").otherwise("n.s."))


def spread(active: DataFrame, footprints: DataFrame, fps: float, um_per_px: float = 1.0, shuffles: int = 10_000, seed: int = 0) -> DataFrame:
    """Direction of spread of each event with q values over a recording's events.

    ``active``: (rec_id, event_id, roi_id, first_time_s); ``footprints``: (rec_id, roi_id, x, y) in pixels. Times count in
    whole frames (rint).
    """
    from tracelake.operators.traces import monotonicity

    at = active.join(footprints.select("rec_id", "roi_id", (F.col("x") * um_per_px).alias("x"), (F.col("y") * um_per_px).alias("y")), ["rec_id", "roi_id"])
    got = monotonicity(at.select("rec_id", "event_id", "x", "y", F.rint(F.col("first_time_s") * fps).alias("first_time_s")), shuffles, seed)
    return tables.bh_fdr(got.withColumn("p_value", F.nanvl("p_value", F.lit(None).cast("double"))), "p_value", ["rec_id"])


def activation_groups(active: DataFrame, footprints: DataFrame, fps: float) -> DataFrame:
    """Units that start in the same frame of an event: centroid, population deviations, root mean square spread, rank."""
    at = active.join(footprints.select("rec_id", "roi_id", "x", "y"), ["rec_id", "roi_id"]).withColumn("frame", F.rint(F.col("first_time_s") * fps).cast("int"))
    g = at.groupBy("rec_id", "event_id", "frame").agg(F.count("*").alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    return g.withColumn("rms", F.sqrt(F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy"))).withColumn("rank", F.dense_rank().over(Window.partitionBy("rec_id", "event_id").orderBy("frame")))


def order_map(ranked: DataFrame, pixels: DataFrame) -> DataFrame:
    """Normalised order of activation, 0 to 1, splatted on pixels: (event_id, unit, rank) and (unit, y, x, w)."""
    top = F.max("rank").over(Window.partitionBy("event_id"))
    scaled = ranked.withColumn("v", F.when(top > 1, (F.col("rank") - 1) / (top - 1)).otherwise(F.lit(0.0)))
    return scaled.join(pixels, "unit").groupBy("event_id", "y", "x").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("image"))


def rate_activation(rates: DataFrame, windows: DataFrame, fps: float, threshold: float = 0.0) -> DataFrame:
    """First frame of [floor(start * fps), ceil(end * fps)) where a unit's rate is above ``threshold``: (rec_id, roi_id, spks)."""
    w = windows.select("rec_id", "event_id", F.greatest(F.floor(F.col("start_s") * fps).cast("int"), F.lit(0)).alias("i"), F.ceil(F.col("end_s") * fps).cast("int").alias("j"))
    at = rates.select("rec_id", "roi_id", "spks").join(w, "rec_id")
    first = F.expr(f"array_position(transform(slice(spks, i + 1, greatest(j - i, 0)), v -> v > {float(threshold)!r}D), true)").cast("int")
    out = at.select("rec_id", "event_id", "roi_id", "i", first.alias("k")).where("k > 0")
    return out.select("rec_id", "event_id", "roi_id", ((F.col("i") + F.col("k") - 1) / fps).alias("first_time_s"))


#: Traces that a user may look at, and the columns that hold them.
SOURCES = {"raw": "f", "dff": "dff", "lowpass": "lp", "derivative": "dt", "rates": "spks"}


def trace_source(traces: DataFrame, source: str) -> DataFrame:
    """(rec_id, roi_id, x) of the chosen kind of trace; an error for an unknown kind or one that the table lacks."""
    column = SOURCES.get(source)
    if column is None or column not in traces.columns:
        raise ValueError(f"no trace {source!r}")
    return traces.select("rec_id", "roi_id", F.col(column).cast("array<double>").alias("x"))


def power_spectrum(traces: DataFrame, fps: float, column: str = "dff") -> DataFrame:
    def run(batches):
        for pdf in batches:
            got = [signal.power(np.asarray(x, float), fps) if x is not None and len(x) else (np.zeros(0), np.zeros(0)) for x in pdf[column]]
            yield pd.DataFrame({"rec_id": pdf["rec_id"], "roi_id": pdf["roi_id"], "freq": [g[0] for g in got], "power": [g[1] for g in got]})

    return traces.select("rec_id", "roi_id", column).mapInPandas(run, "rec_id string, roi_id int, freq array<double>, power array<double>")


def display_lowpass(traces: DataFrame, fps: float, cutoff: float = 1.0, column: str = "dff") -> DataFrame:
    """Zero-phase filter for display."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"rec_id": pdf["rec_id"], "roi_id": pdf["roi_id"], "smooth": [signal.zero_phase(np.asarray(x if x is not None else [], float), fps, cutoff) for x in pdf[column]]})

    return traces.select("rec_id", "roi_id", column).mapInPandas(run, "rec_id string, roi_id int, smooth array<double>")


def recluster(traces: DataFrame, clusters: DataFrame, branches: list[int], column: str = "lp", target: tuple[int, int] = (4, 5)) -> DataFrame:
    """A tree of its own for the units of some clusters."""
    from tracelake.operators import traces as ops

    chosen = clusters.where(F.col("cluster_id").isin(branches)).select("rec_id", "roi_id")
    return ops.clusters(traces.join(chosen, ["rec_id", "roi_id"], "left_semi"), column, target)
