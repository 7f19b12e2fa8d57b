"""Merge trees as tables: an order of leaves that any later cut reads, without a refit.

A tree of n leaves is n - 1 merges (rec_id, step, a, b, height, size), as ``traces.linkage`` gives them. Where a node's
leaves start, counted from the left, is the sum of the left siblings' sizes on its way to the root; those sums come from
pointer jumping, a number of joins that grows with the logarithm of the tree's depth. Each merge then stands between two
neighbouring leaves: its height is the gap before the first leaf of its right child. A cut at any height is a running
count of larger gaps, a branch is a stretch of leaves, and cutting it again needs its own gaps alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelake.sources import shared


def leaf_order(merges: DataFrame, leaves: DataFrame) -> DataFrame:
    """(rec_id, roi_id, place, gap): leaves from the left; ``gap`` is the height that joins one to its left neighbour, null for the first."""
    n = leaves.groupBy("rec_id").agg(F.count("*").alias("n"))
    nodes = merges.join(n, "rec_id").select("rec_id", (F.col("n") + F.col("step")).alias("parent"), "a", "b", "height", "size")
    size_of = nodes.select("rec_id", F.col("parent").alias("a"), F.col("size").alias("a_size"))
    nodes = nodes.join(size_of, ["rec_id", "a"], "left").withColumn("a_size", F.coalesce("a_size", F.lit(1)).cast("long"))
    child = F.explode(F.array(F.struct(F.col("a").cast("long").alias("node"), F.lit(0).cast("long").alias("before")), F.struct(F.col("b").cast("long").alias("node"), F.col("a_size").alias("before"))))
    # (node, up, before): ``before`` leaves lie left of the node below its ancestor ``up``; the root has no row.
    at = shared.kept(nodes.select("rec_id", F.col("parent").cast("long").alias("up"), "height", child.alias("_c")).select("rec_id", "up", F.col("_c.node").alias("node"), F.col("_c.before").alias("before"), F.when(F.col("_c.before") > 0, F.col("height")).alias("gap")))
    while True:
        higher = at.select("rec_id", F.col("node").alias("up"), F.col("up").alias("_up"), F.col("before").alias("_before"))
        jumped = at.join(higher, ["rec_id", "up"], "left")
        new = shared.kept(jumped.select("rec_id", F.coalesce("_up", "up").alias("up"), "node", (F.col("before") + F.coalesce("_before", F.lit(0))).alias("before"), "gap", F.col("_up").isNotNull().alias("moved")))
        shared.drop(at)
        at = new
        if at.where("moved").isEmpty():
            break
    starts = at.where("gap is not null").select("rec_id", F.col("before").alias("place"), "gap")
    placed = leaves.select("rec_id", F.col("leaf").cast("long").alias("node"), "roi_id").join(at.select("rec_id", "node", F.col("before").alias("place")), ["rec_id", "node"], "left")
    placed = placed.withColumn("place", F.coalesce("place", F.lit(0)))
    return placed.join(starts, ["rec_id", "place"], "left").select("rec_id", "roi_id", F.col("place").cast("int").alias("place"), "gap")


def cut(order: DataFrame, heights: DataFrame, keys: tuple[str, ...] = ("rec_id",)) -> DataFrame:
    """Cluster numbers from 1, left to right, of leaves whose merges reach up to ``height`` (rec_id, height); no recording without one."""
    larger = F.when(F.col("gap") > F.col("height"), 1).otherwise(0)
    number = F.sum(larger).over(Window.partitionBy(*keys).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)) + 1
    return order.join(heights, "rec_id").withColumn("cluster_id", number.cast("int")).drop("height")


def auto_heights(order: DataFrame, target: tuple[int, int] = (4, 5)) -> DataFrame:
    """(rec_id, height): the first of 0.90, 0.89, ... 0.05 of the greatest height that gives a wanted number of clusters, else 0.90 of it."""
    from tracelake.operators.tables import cut_counts

    counts = cut_counts(order.where("gap is not null"), ["rec_id"], "gap", target)
    top = order.groupBy("rec_id").agg(F.max("gap").alias("top"))
    return counts.where("chosen").join(top, "rec_id").select("rec_id", (F.col("fraction") * F.col("top")).alias("height"))


def branch(order: DataFrame, clusters: DataFrame, chosen: list[int], target: tuple[int, int] = (4, 5)) -> DataFrame:
    """The chosen clusters' leaves with clusters of their own: each branch is cut anew by the same rule, from its gaps.

    (rec_id, cluster_id, roi_id, place, sub_id); the gap at a branch's left end lies outside it.
    """
    own = clusters.where(F.col("cluster_id").isin(chosen)).select("rec_id", "roi_id", "cluster_id")
    at = order.join(own, ["rec_id", "roi_id"])
    left = F.min("place").over(Window.partitionBy("rec_id", "cluster_id"))
    at = at.withColumn("gap", F.when(F.col("place") > left, F.col("gap")))
    named = at.withColumn("rec_id", F.struct("rec_id", "cluster_id"))
    out = cut(named, auto_heights(named, target).unionByName(named.groupBy("rec_id").agg(F.max("gap").alias("height")).where("height is null")))
    return out.select("rec_id.rec_id", "rec_id.cluster_id", "roi_id", "place", F.col("cluster_id").alias("sub_id"))
