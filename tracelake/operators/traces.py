"""Operators that need a recurrence or dense algebra: NumPy kernels per trace row or per recording, over Arrow."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelake.kernels import signal, stats
from tracelake.operators.guard import guarded, with_error

BLOCK_SAMPLES = 4_000_000
TRACES = "rec_id string, roi_id int, dff array<double>, lp array<double>, dt array<double>, low_baseline boolean"


def process_traces(traces: DataFrame, fps: float | str, r: float = 0.7, method: str = "rolling", cutoff: float = 1.0, guard: bool = False) -> DataFrame:
    """(rec_id, roi_id, f, fneu) to dF/F, low-pass and derivative: one map, no shuffle. ``f`` and ``fneu`` are of one length; null traces give no row.

    ``fps`` is a number or the column that holds each recording's. With ``guard``, units that fail leave a row with a message.
    """
    own = isinstance(fps, str)

    def block(some: pd.DataFrame, n: int, rate: float) -> pd.DataFrame:
        x = np.stack([signal.interpolate(np.asarray(f, float) - r * np.asarray(neu, float)) for f, neu in zip(some["f"], some["fneu"], strict=True)])
        dff = x if not n else signal.dff_rolling(x, rate) if method == "rolling" else np.stack([signal.dff_first(v, rate) for v in x])
        lp = signal.lowpass(dff, rate, cutoff)
        low = [bool(n and np.percentile(v, 10) < 1e-6) for v in x]
        return pd.DataFrame({"rec_id": some["rec_id"].to_numpy(), "roi_id": some["roi_id"].to_numpy(), "dff": list(dff), "lp": list(lp), "dt": [signal.savgol_derivative(v, rate) for v in lp], "low_baseline": low})

    def run(batches):
        for pdf in batches:
            # Traces of equal length and rate are filtered as one matrix; blocks bound its size.
            pdf = pdf.assign(n=pdf["f"].map(len), rate=pdf[fps] if own else fps)
            for (n, rate), same in pdf.groupby(["n", "rate"], sort=False):
                step = max(1, BLOCK_SAMPLES // max(1, n))
                for i in range(0, len(same), step):
                    some = same.iloc[i : i + step]
                    if not guard:
                        yield block(some, n, rate)
                        continue
                    try:
                        yield block(some, n, rate).assign(error=None)
                    except Exception:  # noqa: BLE001 - units of a failed block are tried one by one
                        one = guarded(lambda x, n=n, rate=rate: block(x, n, rate), TRACES, ["rec_id", "roi_id"], True)
                        for j in range(len(some)):
                            yield one(some.iloc[j : j + 1])

    rows = traces.where("f is not null and fneu is not null").select("rec_id", "roi_id", "f", "fneu", *([fps] if own else []))
    return rows.mapInPandas(run, with_error(TRACES, guard))


def _by_length(traces: DataFrame, column: str, out: str, kernel) -> DataFrame:
    """``out``: what a kernel makes of a trace column, for all equally long traces of a batch as one matrix."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in traces.schema.fields), f"{out} array<double>"])

    def run(batches):
        for pdf in batches:
            for n, same in pdf.groupby(pdf[column].map(len), sort=False):
                step = max(1, BLOCK_SAMPLES // max(1, n))
                for i in range(0, len(same), step):
                    some = same.iloc[i : i + step]
                    x = np.stack([np.asarray(v, float) for v in some[column]])
                    yield some.assign(**{out: list(kernel(x) if n else x)})

    return traces.where(F.col(column).isNotNull()).mapInPandas(run, schema)


def rolling_percentile(traces: DataFrame, window: int, percent: float, edge: str = "symmetric", column: str = "x") -> DataFrame:
    """``base``: the order statistic of a window of odd length around each sample, no longer than the trace.

    ``edge``: 'symmetric' mirrors the trace at its ends, 'edge' repeats the end samples.
    """

    def kernel(x):
        n = x.shape[1]
        return signal.rolling_ranks(x, max(1, min(window | 1, n if n % 2 else n - 1)), percent, edge)

    return _by_length(traces, column, "base", kernel)


def rolling_dff(traces: DataFrame, fps: float, window_s: float = 45, percent: float = 10, column: str = "x") -> DataFrame:
    """``dff``: dF/F against a rolling percentile."""
    return _by_length(traces, column, "dff", lambda x: signal.dff_rolling(x, fps, window_s, percent))


def _matrix(pdf: pd.DataFrame, column: str) -> tuple[list, np.ndarray]:
    pdf = pdf.sort_values("roi_id")
    return pdf["roi_id"].tolist(), np.stack([np.asarray(x, float) for x in pdf[column]], 1)


CLUSTERS = "rec_id string, roi_id int, cluster_id int, threshold double"


def clusters(traces: DataFrame, column: str = "lp", target: tuple[int, int] = (4, 5), guard: bool = False) -> DataFrame:
    """Ward clusters of each recording's traces; recordings with fewer than two units give none."""

    def run(pdf):
        ids, x = _matrix(pdf, column)
        if len(ids) < 2:
            return pd.DataFrame(columns=["rec_id", "roi_id", "cluster_id", "threshold"])
        z = stats.ward(_standard(x).T)
        t = stats.auto_threshold(z[:, 2], target) * z[-1, 2]
        return pd.DataFrame({"rec_id": pdf["rec_id"].iloc[0], "roi_id": ids, "cluster_id": stats.cut(z, t), "threshold": t})

    return traces.groupBy("rec_id").applyInPandas(guarded(run, CLUSTERS, ["rec_id"], guard), with_error(CLUSTERS, guard))


def _standard(x: np.ndarray) -> np.ndarray:
    return (x - x.mean(0)) / (x.std(0) + 1e-8)


LINKAGE = "rec_id string, step int, a int, b int, height double, size int"


def linkage(traces: DataFrame, column: str = "lp", guard: bool = False) -> tuple[DataFrame, DataFrame]:
    """The Ward merge trees of recordings as tables that are kept and cut without a refit.

    merges (rec_id, step, a, b, height, size): steps from 0 by rising height; nodes below the number of units are leaves, the
    step's own node is units + step. leaves (rec_id, leaf, roi_id): units numbered by roi_id. One task a recording.
    """

    def run(pdf):
        ids, x = _matrix(pdf, column)
        if len(ids) < 2:
            return pd.DataFrame(columns=[c.split()[0] for c in LINKAGE.split(", ")])
        z = stats.ward(_standard(x).T)
        return pd.DataFrame({"rec_id": pdf["rec_id"].iloc[0], "step": np.arange(len(z)), "a": z[:, 0].astype(int), "b": z[:, 1].astype(int), "height": z[:, 2], "size": z[:, 3].astype(int)})

    merges = traces.groupBy("rec_id").applyInPandas(guarded(run, LINKAGE, ["rec_id"], guard), with_error(LINKAGE, guard))
    place = F.row_number().over(Window.partitionBy("rec_id").orderBy("roi_id")) - 1
    return merges, traces.select("rec_id", "roi_id").distinct().select("rec_id", place.alias("leaf"), "roi_id")


BLOCK_ROWS = 8192


def mean_distances(vectors: DataFrame, group: str, unit: str, vector: str, block: int = BLOCK_ROWS) -> DataFrame:
    """(group, n, mean_dist): pairs of a group's vectors whose units differ, and their mean Euclidean distance.

    Units are dealt to blocks of about ``block`` rows by a hash, and each pair of blocks is a task's work, in tiles; what a
    task holds does not grow with the group. Pairs with a missing vector or component, or of unequal lengths, count in n, but have no distance.
    Rows without a group or unit are in no pair, groups without a pair have no row.
    """
    rows = vectors.where(F.col(group).isNotNull() & F.col(unit).isNotNull()).select(group, F.col(unit).alias("_u"), F.when(~F.exists(vector, lambda v: v.isNull()), F.col(vector)).alias("x"))
    blocks = rows.groupBy(group).agg(F.ceil(F.count("*") / block).cast("int").alias("_k"))
    dealt = rows.join(blocks, group).withColumn("b", F.pmod(F.xxhash64("_u"), "_k").cast("int"))
    both = F.expr("transform(sequence(0, _k - 1), o -> struct(least(b, o) as p, greatest(b, o) as q))")
    pairs = dealt.withColumn("_p", F.explode(both)).select(F.col(group).alias("g"), "_u", "b", "x", "_p.p", "_p.q")

    def run(pdf):
        p, q = pdf["p"].iloc[0], pdf["q"].iloc[0]
        sides = [pdf[pdf["b"] == c] for c in ((p,) if p == q else (p, q))]
        sums, same = [], pdf["_u"].value_counts().to_numpy()
        n = (len(pdf) ** 2 - int((same**2).sum())) // 2 if p == q else len(sides[0]) * len(sides[1])
        by = [side.groupby(side["x"].map(lambda v: -1 if v is None else len(v))) for side in sides]
        for size, own in by[0]:
            if size >= 0 and (p == q or size in by[1].groups):
                x = np.stack(own["x"].to_list()).astype(float)
                sums.append(stats.distance_sum(x, ids=own["_u"].to_numpy()) if p == q else stats.distance_sum(x, np.stack(by[1].get_group(size)["x"].to_list()).astype(float)))
        return pd.DataFrame({"g": pdf["g"].iloc[:1].to_numpy(), "n": [n], "m": [sum(m for m, _ in sums)], "s": [sum((s for _, s in sums), 0.0)]})

    kind = vectors.schema[group].dataType.simpleString()
    sums = pairs.groupBy("g", "p", "q").applyInPandas(run, f"g {kind}, n long, m long, s double")
    mean = F.when(F.sum("m") > 0, F.sum("s") / F.sum("m"))
    return sums.groupBy(F.col("g").alias(group)).agg(F.sum("n").alias("n"), mean.alias("mean_dist")).where("n > 0")


UNITS_OF_STEPS = 2048


def drift(traces: DataFrame, column: str = "f", most: int = UNITS_OF_STEPS, block: int = 256) -> DataFrame:
    """Frames of common steps in the first principal component of z-scored traces.

    The component's loadings come from the Gram matrix of units, by blocks: units are dealt to blocks of ``block``, pairs of
    blocks give their products in tasks of their own, and what meets in one task is the matrix of at most ``most`` units, the
    first by a checksum of their ids (fewer units take part as they are). Recordings with fewer than two units or ten frames
    have no steps.
    """
    keyed = traces.select("rec_id", "roi_id", F.col(column).alias("x")).where("x is not null")
    pick = F.row_number().over(Window.partitionBy("rec_id").orderBy(F.crc32(F.col("roi_id").cast("string").cast("binary")), "roi_id"))
    chosen = keyed.select("rec_id", "roi_id").withColumn("_k", pick).where(F.col("_k") <= most)
    chosen = chosen.withColumn("b", ((F.col("_k") - 1) / block).cast("int")).drop("_k")
    units = keyed.join(chosen, ["rec_id", "roi_id"])
    ends = units.groupBy("rec_id").agg(F.max("b").alias("last"), F.count("*").alias("n"), F.min(F.size("x")).alias("t")).where("n >= 2 and t >= 10")
    units = units.join(ends, "rec_id")
    # Each block meets every other one once: a unit goes to all pairs (p, q), p <= q, of its block.
    both = F.expr("transform(sequence(0, last), o -> struct(least(b, o) as p, greatest(b, o) as q))")
    pairs = units.withColumn("_p", F.explode(both)).select("rec_id", "roi_id", "b", "t", F.slice("x", F.lit(1), F.col("t")).alias("x"), "_p.p", "_p.q")

    def product(pdf):
        pdf = pdf.sort_values(["b", "roi_id"])
        p, q = int(pdf["p"].iloc[0]), int(pdf["q"].iloc[0])
        z = stats.zscore(np.stack([signal.interpolate(x) for x in pdf["x"]], 1))
        left, right = (pdf["b"].to_numpy() == c for c in (p, q))
        part = z[:, left].T @ z[:, right]
        return pd.DataFrame({"rec_id": [pdf["rec_id"].iloc[0]], "p": [p], "q": [q], "rows": [part.shape[0]], "g": [part.ravel()]})

    parts = pairs.groupBy("rec_id", "p", "q").applyInPandas(product, "rec_id string, p int, q int, rows int, g array<double>")

    def loadings(pdf):
        k = int(pdf["q"].max()) + 1
        cell = {(r.p, r.q): np.asarray(r.g).reshape(r.rows, -1) for r in pdf.itertuples()}
        gram = np.block([[cell[i, j] if i <= j else cell[j, i].T for j in range(k)] for i in range(k)])
        v = stats.leading_vector(gram)
        v = v if v[np.abs(v).argmax()] > 0 else -v
        at = np.repeat(np.arange(k), [cell[i, i].shape[0] for i in range(k)])
        return pd.DataFrame({"rec_id": pdf["rec_id"].iloc[0], "b": at, "i": np.concatenate([np.arange((at == i).sum()) for i in range(k)]), "w": v})

    weights = parts.groupBy("rec_id").applyInPandas(loadings, "rec_id string, b int, i int, w double")
    placed = units.withColumn("i", F.row_number().over(Window.partitionBy("rec_id", "b").orderBy("roi_id")) - 1)
    scored = placed.join(weights, ["rec_id", "b", "i"])

    def partial(batches):
        # Weighted sums of z-scored traces: one row for each recording of a batch.
        for pdf in batches:
            for rec, same in pdf.groupby("rec_id", sort=False):
                z = stats.zscore(np.stack([signal.interpolate(x[:t]) for x, t in zip(same["x"], same["t"], strict=True)], 1))
                yield pd.DataFrame({"rec_id": [rec], "s": [z @ same["w"].to_numpy()]})

    sums = scored.select("rec_id", "x", "t", "w").mapInPandas(partial, "rec_id string, s array<double>")

    def steps(pdf):
        at = stats.steps(np.sum([np.asarray(s) for s in pdf["s"]], axis=0))
        return pd.DataFrame({"rec_id": pdf["rec_id"].iloc[0], "frame": np.asarray(at, int)})

    return sums.groupBy("rec_id").applyInPandas(steps, "rec_id string, frame int")


def monotonicity(active: DataFrame, shuffles: int = 10_000, seed: int = 0) -> DataFrame:
    """(rec_id, event_id, x, y, first_time_s) to the direction of spread of each event."""

    def run(pdf):
        got = stats.monotonicity(pdf["x"], pdf["y"], pdf["first_time_s"], shuffles=shuffles, seed=seed)
        rows = [(pdf["rec_id"].iloc[0], int(pdf["event_id"].iloc[0]), *got)] if got else []
        return pd.DataFrame(rows, columns=["rec_id", "event_id", "theta", "rho", "p_value"])

    return active.groupBy("rec_id", "event_id").applyInPandas(run, "rec_id string, event_id int, theta double, rho double, p_value double")
