"""Centroid clustering of vectors by kd-tree filtering, in whole numbers.

Vectors become integers floor(scale * x). Every partition packs its vectors into kd-trees of at most ``TREE_ROWS`` rows
whose nodes hold a count, integer sums and a box; trees are written once and read by every round. A round walks each
tree from its root with the set of centroids that may own a point of the node's box: a centroid is dropped if it is
strictly farther than the one nearest to the box's middle from every point of the box (tested at one corner, in whole
numbers), a node with a single centroid left is assigned as a whole by its sums, and leaves are resolved by distances to
what is left. Ties are never dropped, so the smaller number wins them exactly. What leaves a task of a round is one sum
for each centroid and component; the driver holds the centroids alone.

Defined cases: a vector that is null, has another length, or holds a null or a non-finite component is left out; a null
vec_id takes part and counts as the empty string in the seeding hash; rows with one vec_id are separate rows (equal
hashes are ordered by their vectors); fewer vectors than centroids give as many centroids as vectors; an empty table gives
no rows; components are held to +-2**26 after scaling, so that distances fit a long; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm._io import materialize, release

TREE_ROWS, LEAF, LIMIT = 8192, 48, 1 << 26
#: Numbers that one step of a walk holds at most: boxes x centroids x components.
STEP = 2 << 20
TREES = "ids array<long>, points binary, lo binary, hi binary, sums binary, shape binary"


class Tree:
    """Points in tree order, and per node: box, sums, ``start``, ``end``, and children (0 for leaves)."""

    __slots__ = ("points", "lo", "hi", "sums", "shape")

    def __init__(self, points, lo, hi, sums, shape):
        self.points, self.lo, self.hi, self.sums, self.shape = points, lo, hi, sums, shape


def build(points: np.ndarray) -> tuple[np.ndarray, Tree]:
    """A tree over rows of whole numbers, split at the median of the widest component; also the order of the rows."""
    order, shape, lo, hi, sums = np.arange(len(points)), [[0, len(points), 0, 0]], [], [], []
    at = 0
    while at < len(shape):
        start, end = shape[at][:2]
        own = points[order[start:end]]
        lo.append(own.min(0))
        hi.append(own.max(0))
        sums.append(own.sum(0, dtype=np.int64))
        width = hi[-1] - lo[-1]
        axis = int(width.argmax())
        if end - start > LEAF and width[axis] > 0:
            half = (end - start) // 2
            order[start:end] = order[start:end][np.argpartition(own[:, axis], half, kind="introselect")]
            shape[at][2:] = len(shape), len(shape) + 1
            shape += [[start, start + half, 0, 0], [start + half, end, 0, 0]]
        at += 1
    return order, Tree(points[order], np.array(lo), np.array(hi), np.array(sums), np.array(shape))


def walk(tree: Tree, centroids: np.ndarray) -> Iterator[tuple[int | None, int, int, np.ndarray]]:
    """Assigned pieces: (node or None for a resolved leaf, start, end, cluster of the node or clusters of the rows)."""
    k, dim = centroids.shape
    squares = (centroids * centroids).sum(1)
    todo = [(np.zeros(1, np.int64), np.ones((1, k), bool))]
    most = max(1, STEP // (k * dim))
    while todo:
        nodes, may = todo.pop()
        if len(nodes) > most:
            todo += [(nodes[i : i + most], may[i : i + most]) for i in range(0, len(nodes), most)]
            continue
        lo, hi = tree.lo[nodes].astype(np.int64), tree.hi[nodes].astype(np.int64)
        off = 2 * centroids[None] - (lo + hi)[:, None]
        far = np.where(may, (off * off).sum(2), np.iinfo(np.int64).max)
        best = far.argmin(1)
        # The most by which `best` can be farther than another centroid over the box, reached at a corner.
        step = centroids[None] - centroids[best][:, None]
        corner = np.where(step > 0, hi[:, None], lo[:, None])
        may &= squares[best][:, None] - squares[None] + 2 * (corner * step).sum(2) >= 0
        shape, alone = tree.shape[nodes], may.sum(1) == 1
        for i in np.flatnonzero(alone):
            yield int(nodes[i]), int(shape[i, 0]), int(shape[i, 1]), best[i]
        leaf = ~alone & (shape[:, 2] == 0)
        for i in np.flatnonzero(leaf):
            a, b = int(shape[i, 0]), int(shape[i, 1])
            left = np.flatnonzero(may[i])
            near = max(1, STEP // (len(left) * dim))
            for at in range(a, b, near):
                gap = tree.points[at : min(b, at + near), None].astype(np.int64) - centroids[left][None]
                yield None, at, min(b, at + near), left[(gap * gap).sum(2).argmin(1)]
        down = ~alone & ~leaf
        if down.any():
            todo.append((shape[down, 2:].reshape(-1), np.repeat(may[down], 2, axis=0)))


def totals(tree: Tree, centroids: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> None:
    """Adds what each centroid gains from a tree."""
    for node, a, b, own in walk(tree, centroids):
        if node is None:
            np.add.at(counts, own, 1)
            np.add.at(sums, own, tree.points[a:b].astype(np.int64))
        else:
            counts[own] += b - a
            sums[own] += tree.sums[node]


def labels(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and squared distance of every point, in tree order."""
    own = np.empty(len(tree.points), np.int64)
    for _, a, b, found in walk(tree, centroids):
        own[a:b] = found
    gap = tree.points.astype(np.int64) - centroids[own]
    return own, (gap * gap).sum(1)


def _pack(batches, dim: int):
    """Batches of (vec_id, v) to rows of TREES."""
    kept: list[pa.RecordBatch] = []

    def row(table: pa.Table) -> pa.RecordBatch:
        flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int32)
        order, tree = build(flat.reshape(-1, dim))
        ids = table.column("vec_id").combine_chunks().take(pa.array(order))
        cells = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)]
        for part, kind in ((tree.points, np.int32), (tree.lo, np.int32), (tree.hi, np.int32), (tree.sums, np.int64), (tree.shape, np.int32)):
            cells.append(pa.array([np.ascontiguousarray(part, kind).tobytes()], pa.binary()))
        return pa.record_batch(cells, ["ids", "points", "lo", "hi", "sums", "shape"])

    held = 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, TREE_ROWS - held)
            kept.append(part)
            held += part.num_rows
            batch = batch.slice(part.num_rows)
            if held == TREE_ROWS:
                yield row(pa.Table.from_batches(kept))
                kept, held = [], 0
    if held:
        yield row(pa.Table.from_batches(kept))


def _trees(batches, dim: int) -> Iterator[tuple[pa.Array, Tree]]:
    for batch in batches:
        for i in range(batch.num_rows):
            points, lo, hi, sums, shape = (np.frombuffer(batch.column(j)[i].as_buffer(), kind) for j, kind in ((1, np.int32), (2, np.int32), (3, np.int32), (4, np.int64), (5, np.int32)))
            yield batch.column(0)[i].values, Tree(points.reshape(-1, dim), lo.reshape(-1, dim), hi.reshape(-1, dim), sums.reshape(-1, dim), shape.reshape(-1, 4))


def vectors(df: DataFrame, dim: int = 64, scale: int = 256) -> DataFrame:
    """(vec_id, v) of the vectors that take part, v as whole numbers."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    whole = F.transform(x, lambda c: F.greatest(F.least(F.floor(F.least(F.greatest(c * scale, F.lit(-2.0**40)), F.lit(2.0**40))), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int"))
    return df.where(F.coalesce((F.size(x) == dim) & ~bad, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def cluster(df: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, dim: int = 64, scale: int = 256) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of all vectors that take part, and the centroids, after ``rounds`` rounds."""
    spark, kept = df.sparkSession, vectors(df, dim, scale)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = kept.select("v", key.alias("key")).orderBy("key", "v").limit(k).collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), np.zeros((0, dim), np.int64)
    centroids = np.array([r.v for r in first], np.int64)
    trees = materialize(kept.mapInArrow(lambda batches: _pack(batches, dim), TREES))

    def gains(at: np.ndarray):
        def task(batches):
            counts, sums = np.zeros(len(at), np.int64), np.zeros((len(at), dim), np.int64)
            for _, tree in _trees(batches, dim):
                totals(tree, at, counts, sums)
            own = np.flatnonzero(counts)
            part = np.concatenate([counts[own, None], sums[own]], axis=1)
            yield pa.record_batch([pa.array(np.repeat(own, dim + 1).astype(np.int32)), pa.array(np.tile(np.arange(dim + 1, dtype=np.int32), len(own))), pa.array(part.reshape(-1))], ["cluster", "place", "s"])

        return task

    for _ in range(rounds):
        parts = trees.mapInArrow(gains(centroids), "cluster int, place int, s long")
        found = np.zeros((len(centroids), dim + 1), np.int64)
        for r in parts.groupBy("cluster", "place").agg(F.sum("s").alias("s")).collect():  # at most k * (dim + 1) sums
            found[r.cluster, r.place] = r.s
        some = found[:, 0] > 0
        centroids[some] = found[some, 1:] // found[some, :1]

    def settle(batches, at=centroids):
        for ids, tree in _trees(batches, dim):
            own, far = labels(tree, at)
            yield pa.record_batch([ids, pa.array(own.astype(np.int32)), pa.array(far)], ["vec_id", "cluster", "distance"])

    out = materialize(trees.mapInArrow(settle, "vec_id long, cluster int, distance long"))
    release(trees)
    return out, centroids


def query(spark, sf_dir: str) -> DataFrame:
    import hashlib

    from tracelake.llm._io import table

    found, centroids = cluster(table(spark, sf_dir, "embeddings"))
    sums = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    every = [(i, sums.get(i, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    each = spark.createDataFrame(every, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = 40, rounds: int = 5) -> str:
    near = "SELECT vec_id, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.vec_id, z.c, sum((v.x - z.x) * (v.x - z.x))::BIGINT AS d FROM v JOIN z{0} z USING (j) GROUP BY ALL) GROUP BY vec_id"
    steps = ""
    for i in range(rounds):
        steps += f",\na{i} AS MATERIALIZED ({near.format(i)}),\nm{i} AS (SELECT a.c, v.j, sum(v.x)::BIGINT AS s, count(*) AS n FROM v JOIN a{i} a USING (vec_id) GROUP BY ALL)"
        steps += f",\nz{i + 1} AS MATERIALIZED (SELECT z.c, z.j, CASE WHEN n IS NULL THEN z.x ELSE (s - ((s % n) + n) % n) // n END AS x FROM z{i} z LEFT JOIN m{i} m USING (c, j))"
    return f"""
WITH e AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda t: t IS NOT NULL AND isfinite(t))) = 64),
v AS MATERIALIZED (SELECT vec_id, j, floor(256 * embedding[j]::DOUBLE)::BIGINT AS x FROM e, range(1, 65) r(j)),
s AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c FROM e QUALIFY c < {k}),
z0 AS MATERIALIZED (SELECT c::INTEGER AS c, j, x FROM s JOIN v USING (vec_id)){steps},
a AS MATERIALIZED ({near.format(rounds)}),
h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY j)) AS centroid_sha256 FROM z{rounds} GROUP BY c)
SELECT vec_id, c AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256 FROM a JOIN h USING (c)
"""


SQL = _sql()
