"""Cell scores of units: patches, a pluggable scorer, a network and a baseline to train, labels and splits.

No trained network ships with the engine: ``score`` takes any batch function, ``fit_network`` trains one of two branches
(patch and trace), ``fit_baseline`` a logistic model.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelake.kernels import network
from tracelake.operators import tables
from tracelake.sources import shared


def zscore_pixels(image: DataFrame, value: str, eps: float = 1e-6) -> DataFrame:
    """Whole images (rec_id, y, x, value) to mean 0 and deviation 1, the deviation held above ``eps``."""
    s = image.groupBy("rec_id").agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return image.join(s, "rec_id").withColumn(value, (F.col(value) - F.col("_m")) / F.greatest("_s", F.lit(eps))).drop("_m", "_s")


def patches(footprints: DataFrame, images: DataFrame, size: int = 32) -> DataFrame:
    """Patches (rec_id, roi_id, mean, peak, mask: arrays of size * size, row by row), zero outside the image.

    ``footprints``: (rec_id, roi_id, y, x); ``images``: z-scored (rec_id, y, x, mean, peak). A patch lies around the rounded
    mean place (half to even). Each unit meets only its own cells of the image.
    """
    centre = footprints.groupBy("rec_id", "roi_id").agg((F.rint(F.avg("y")).cast("int") - size // 2).alias("y0"), (F.rint(F.avg("x")).cast("int") - size // 2).alias("x0"))
    cell = F.explode(F.sequence(F.lit(0), F.lit(size * size - 1))).alias("i")
    grid = centre.select("rec_id", "roi_id", "y0", "x0", cell).select("rec_id", "roi_id", "i", F.expr(f"y0 + i div {size}").cast("int").alias("y"), F.expr(f"x0 + i % {size}").cast("int").alias("x"))
    own = footprints.select("rec_id", "roi_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.lit(1.0).alias("mask")).distinct()
    place = ["rec_id", "y", "x"]
    full = grid.join(images.select(*place, "mean", "peak"), place, "left").join(own, ["rec_id", "roi_id", "y", "x"], "left")
    one = F.array_sort(F.collect_list(F.struct("i", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("mean", "peak", "mask")))))
    out = full.groupBy("rec_id", "roi_id").agg(one.alias("p"))
    return out.select("rec_id", "roi_id", *(F.col(f"p.{c}").alias(c) for c in ("mean", "peak", "mask")))


def score(units: DataFrame, model: Callable[[pd.DataFrame], np.ndarray], threshold: float = 0.5, batch: int = 256) -> DataFrame:
    """(rec_id, roi_id, …) to p_cell and keep = p_cell >= threshold; the model sees at most ``batch`` rows at once."""

    def run(batches):
        for pdf in batches:
            for i in range(0, len(pdf), batch):
                some = pdf.iloc[i : i + batch]
                yield pd.DataFrame({"rec_id": some["rec_id"], "roi_id": some["roi_id"], "p_cell": np.asarray(model(some), float)})

    return units.mapInPandas(run, "rec_id string, roi_id int, p_cell double").withColumn("keep", F.col("p_cell") >= threshold)


def fit_baseline(features: DataFrame, columns: list[str], label: str = "label"):
    """A logistic model on feature columns; positives weigh max(1, negatives / positives)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    n = features.agg(F.sum(F.col(label)).alias("p"), F.count("*").alias("n")).first()
    weight = max(1.0, (n.n - (n.p or 0)) / max(1, n.p or 0))
    rows = features.withColumn("_w", F.when(F.col(label) == 1, F.lit(weight)).otherwise(F.lit(1.0)))
    steps = [VectorAssembler(inputCols=columns, outputCol="_v"), StandardScaler(inputCol="_v", outputCol="_x", withMean=True), LogisticRegression(featuresCol="_x", labelCol=label, weightCol="_w", regParam=0.01)]
    return Pipeline(stages=steps).fit(rows)


def upsert_labels(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("path", "roi_id")) -> DataFrame:
    """New rows replace old ones of equal keys; old rows with a null key pass through."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def clean_labels(labels: DataFrame, order: str) -> DataFrame:
    """(path, roi_id, label as text, order) to 0/1 labels: what is no number goes, the last of a (path, roi_id) counts."""
    typed = labels.withColumns({"roi_id": F.expr("try_cast(roi_id as int)"), "label": F.expr("cast(try_cast(label as double) > 0 as int)")})
    w = Window.partitionBy("path", "roi_id").orderBy(F.desc(order))
    return typed.where("path is not null and roi_id is not null and label is not null").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def split_recordings(df: DataFrame, group: str, share: float = 0.2, seed: int = 0) -> DataFrame:
    """Whole groups to validation: the first max(1, round(groups * share)) in an order drawn from the seed.

    Groups are recordings, far fewer than rows; only their names meet in one task.
    """
    named = df.select(group).distinct().withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(group).cast("string")).cast("binary")))
    n = named.agg(F.greatest(F.lit(1), F.rint(F.count("*") * share)).alias("_n"))
    ranked = named.withColumn("_r", F.row_number().over(Window.orderBy("_h", group))).crossJoin(F.broadcast(n))
    return df.join(ranked.select(group, (F.col("_r") <= F.col("_n")).alias("validation")), group)


def split_stratified(df: DataFrame, label: str, keys: list[str], share: float = 0.2, seed: int = 0) -> DataFrame:
    """Rows to validation by label: max(1, round(rows * share)) of each label with two rows or more, none otherwise."""
    w = Window.partitionBy(label).orderBy(F.xxhash64(F.lit(seed), *keys), *keys)
    n = F.count("*").over(Window.partitionBy(label))
    many = F.when(n > 1, F.greatest(F.lit(1), F.rint(n * share))).otherwise(0)
    return df.withColumn("validation", F.row_number().over(w) <= many)


class Network:
    """A trained two-branch network: a batch function for ``score``, and the history of its epochs."""

    def __init__(self, shape: network.Shape, weights: dict, history: list[tuple[int, float, float]]):
        self.shape, self.weights, self.history = shape, weights, history

    def __call__(self, pdf: pd.DataFrame) -> np.ndarray:
        patches, traces = _arrays(pdf, self.shape)
        logit, _ = network.forward(self.weights, patches, traces)
        return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))


def _arrays(pdf: pd.DataFrame, shape: network.Shape) -> tuple[np.ndarray, np.ndarray]:
    patches = np.stack([np.asarray(x, float) for x in pdf["patch"]]).reshape(len(pdf), shape.channels, shape.size, shape.size)
    return patches, np.stack([np.asarray(x, float) for x in pdf["trace"]])


PIECE = 4096


def fit_network(rows: DataFrame, shape: network.Shape = network.Shape(), epochs: int = 60, patience: int = 8, batch: int = 32, rate: float = 1e-3, trainers: int = 4, seed: int = 0) -> Network:
    """Trains on rows (rec_id, roi_id, patch, trace, label, validation); traces are of one length, patches channels * size * size.

    An epoch is one job: rows are dealt to ``trainers`` tasks by a checksum of their ids, each runs over its stream of rows in
    batches from the epoch's weights, and the weights that come back are averaged by rows, in pieces of ``PIECE`` numbers, by
    Spark. Positives weigh negatives / positives, at least 1. Training ends ``patience`` epochs after the best area under
    the curve on validation rows, and the best epoch's weights are what is returned. Without validation rows, or with
    one label alone there, all epochs run and the last one counts.
    """
    part = F.pmod(F.crc32(F.concat_ws(":", "rec_id", "roi_id").cast("binary")), F.lit(trainers)).cast("int")
    kept = shared.kept(rows.select("rec_id", "roi_id", "patch", "trace", F.col("label").cast("int").alias("label"), "validation", part.alias("_part")))
    train, held = kept.where("not validation").repartition(trainers, "_part").sortWithinPartitions("rec_id", "roi_id"), kept.where("validation")
    train = shared.kept(train)
    n = train.agg(F.count_if(F.col("label") == 1).alias("p"), F.count("*").alias("n")).first()
    weight = max(1.0, (n.n - n.p) / max(1, n.p))
    weights, best, history = network.start(shape, seed), None, []
    for epoch in range(epochs):
        loss, weights = _epoch(train, shape, weights, weight, batch, rate)
        scored = score(held.select("rec_id", "roi_id", "patch", "trace"), Network(shape, weights, []))
        got = tables.auroc(scored.join(held.select("rec_id", "roi_id", "label"), ["rec_id", "roi_id"]), "label", "p_cell").first().auroc
        area = float("nan") if got is None else float(got)
        history.append((epoch, loss, area))
        if best is None or not area <= best[0]:
            best = (area, epoch, weights)
        elif epoch - best[1] >= patience:
            break
    shared.drop(train)
    shared.drop(kept)
    return Network(shape, best[2], history)


def _epoch(train: DataFrame, shape: network.Shape, weights: dict, weight: float, batch: int, rate: float) -> tuple[float, dict]:
    """Loss of an epoch and the averaged weights of its tasks."""

    def run(batches):
        p, adam, n, total = dict(weights), network.Adam(rate), 0, 0.0
        for pdf in batches:
            for i in range(0, len(pdf), batch):
                some = pdf.iloc[i : i + batch]
                loss, grads = network.gradients(p, *_arrays(some, shape), some["label"].to_numpy(float), weight)
                adam.step(p, grads)
                n, total = n + len(some), total + loss * len(some)
        if n:
            x = network.flat(p) * n
            pieces = [x[i : i + PIECE] for i in range(0, len(x), PIECE)]
            yield pd.DataFrame({"i": range(len(pieces)), "n": n, "loss": total, "x": pieces})

    parts = train.mapInPandas(run, "i int, n long, loss double, x array<double>").select("i", "n", "loss", F.posexplode("x").alias("j", "x"))
    sums = parts.groupBy("i", "j").agg(F.sum("x").alias("x"), F.sum("n").alias("n"), F.sum("loss").alias("loss"))
    found = sums.orderBy("i", "j").toPandas()  # one row a weight
    if found.empty:
        raise ValueError("no rows to train on")
    return float(found["loss"][0] / found["n"][0]), network.shaped((found["x"] / found["n"]).to_numpy(), weights)
