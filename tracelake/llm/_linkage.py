"""Candidates from bands, verification, and distributed union-find, for items with sets of 64-bit hashes.

Band keys go through one exchange. Each map task sorts its band rows and lets only one row a key into the range of
that key; its other rows of the key go, with that row, to ranges of their own ids. A key held by a third of all items
thus brings one row a task and flush to its range. What comes out is the membership of shared buckets alone.

No step emits all pairs of a bucket, and none needs to: the components are the result, so a pair inside one
component needs no check.

1. Stars: every item meets the centers of its buckets that it shares most bands with. A bucket's center is the
   member with most bucket mates in all, so that the original of edited copies comes before the copies.
2. Large mixed buckets: where more than MANY rows stand outside a bucket's largest component, its rows are dealt anew by
   an exact prefix filter. Shingles are ordered by their number of rows in the bucket, the rarest first; two linked sets
   share one of the first ``n - ceil(t * n) + 1``. Unlike rows seldom share one.
3. Forest: buckets that still hold several components are compared between components, in blocks of
   signatures. Of the pairs that a Bayesian bound cannot exclude, each block keeps a spanning forest, the most
   similar first; its edges are verified on full sets.
4. Rest: in buckets that are still mixed, rows with any pair left are dealt to the same blocks with their full sets,
   and all pairs left between components are verified there. Only links leave the task.

A pair is compared in the bucket of its first shared band only. Every pair that shares a band thus ends inside a
component, excluded by the bound, or verified. Ids are 64-bit hashes of the items: with n different items, n * n / 2**65
pairs are expected to share one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelake.llm import _words as W
from tracelake.llm._io import join_checked, materialize, release

BLOCK = 256
STEP = 16
SIGNATURE = 256
CENTERS = 2
MANY = 4 * BLOCK
PART_ROWS = 1 << 20
HOLD = 1 << 21
PAIRS = 1 << 14
FEW = BLOCK


@lru_cache(4)
def factors(n: int) -> np.ndarray:
    """Odd factors: x -> factor * x permutes the 32-bit hashes."""
    return (W._mix(np.arange(1, n + 1, dtype=W.U) * W.U(0x9E3779B97F4A7C15)) >> W.U(32)).astype(np.uint32) | np.uint32(1)


def minhash(x: np.ndarray, n: int) -> np.ndarray:
    """Signature of n minima over hashes of 32 bits that are drawn from those of 64."""
    a = factors(n)[:, None]
    x = (x >> W.U(32)).astype(np.uint32)
    out = np.full(n, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(out, (a * x[None, i : i + 1024]).min(1), out=out)
    return out


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key of every band; signature: (..., bands * rows)."""
    s = signature.astype(W.U).reshape(*signature.shape[:-1], -1, rows)
    key = np.zeros(s.shape[:-1], W.U) + np.arange(1, s.shape[-2] + 1, dtype=W.U)
    for j in range(rows):
        key = W._mix(key * W.U(0x9E3779B97F4A7C15) + s[..., j])
    return key.view(np.int64)


HEAD = np.dtype([("key", "<u4"), ("id", "<i8")])


def short_keys(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Range of each band key, and 32 bits of it: 27 of its own, which need only tell apart keys of one range, and the band."""
    x = keys.view(W.U)
    part = ((x >> W.U(32)) % W.U(parts)).astype(np.int64)
    return part, ((W._mix(x) >> W.U(32)).astype(np.uint32) & np.uint32(0xFFFFFFE0)) | np.arange(keys.shape[1], dtype=np.uint32)


def packed(found: Iterable[tuple[np.ndarray, np.ndarray]], parts: int) -> Iterator[pa.RecordBatch]:
    """Band rows of (ids, keys by band) as blobs (part, star, data): one (key, id) a key, and (key, that id, id, rows of the key) of the others."""
    held, size = [], 0

    def blobs(part, rows, star):
        order = np.argsort(part, kind="stable")
        part, rows = part[order], rows[order]
        cut = np.append(0, np.append(np.flatnonzero(np.diff(part)) + 1, len(part)))
        ends = pa.array((cut * (rows.nbytes // len(rows))).astype(np.int32))
        data = pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, ends.buffers()[1], pa.py_buffer(rows.tobytes())])
        return pa.RecordBatch.from_arrays([pa.array(part[cut[:-1]]), pa.array(np.full(len(cut) - 1, star)), data], ["part", "star", "data"])

    def flush():
        ids, part, short = (np.concatenate(x) for x in zip(*held, strict=True))
        ids, keys = np.repeat(ids, short.shape[1]), (part << 32 | short).reshape(-1)
        order = np.argsort(keys, kind="stable")
        ids, keys = ids[order], keys[order]
        head = np.append(True, keys[1:] != keys[:-1])
        rows = np.empty(int(head.sum()), HEAD)
        rows["key"], rows["id"] = keys[head] & 0xFFFFFFFF, ids[head]
        yield blobs(keys[head] >> 32, rows, False)
        rep = ids[head][np.cumsum(head) - 1]
        other = ~head & (ids != rep)
        if other.any():
            part = (W._mix(ids[other].view(W.U)) % W.U(parts)).astype(np.int64)
            n = np.diff(np.append(np.flatnonzero(head), len(head)))[np.cumsum(head) - 1]
            yield blobs(part, np.stack([keys[other], rep[other], ids[other], n[other]], 1), True)

    for ids, keys in found:
        if len(ids):
            held.append((ids, *short_keys(keys, parts)))
            size += keys.size
        if size >= HOLD:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


BLOBS = "part long, star boolean, data binary"


def shared_buckets(blobs: DataFrame) -> DataFrame:
    """Membership (key, id, n) of the buckets with several ids; n is a count of mates that the task saw, a lower bound.

    The low 5 bits of a key are its band.
    """

    def members(part, heads, stars):
        out = []
        if heads:
            x = np.frombuffer(b"".join(heads), HEAD)
            x = x[np.argsort(x["key"], kind="stable")]
            first = np.append(True, x["key"][1:] != x["key"][:-1])
            n = np.diff(np.append(np.flatnonzero(first), len(x)))[np.cumsum(first) - 1]
            x, n = x[n > 1], n[n > 1]
            out.append(np.stack([x["key"].astype(np.int64) | part << 32, x["id"], n], 1))
        if stars:
            x = np.frombuffer(b"".join(stars), np.int64).reshape(-1, 4)
            out += [x[:, [0, 1, 3]], x[:, [0, 2, 3]]]
        x = np.concatenate(out)
        return pa.RecordBatch.from_arrays([pa.array(x[:, i].copy()) for i in range(3)], ["key", "id", "n"])

    def run(batches):
        part, heads, stars, size = None, [], [], 0
        for batch in batches:
            for p, star, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != part and part is not None:
                    yield members(part, heads, stars)
                    heads, stars, size = [], [], 0
                part = p
                (stars if star else heads).append(data)
                size += len(data) if star else 0
                if size > 64 << 20:  # rows of stars need no neighbours
                    yield members(part, [], stars)
                    stars, size = [], 0
        if part is not None and (heads or stars):
            yield members(part, heads, stars)

    return blobs.repartition("part").sortWithinPartitions("part").mapInArrow(run, "key long, id long, n long").groupBy("key", "id").agg(F.max("n").alias("n"))


@lru_cache(8)
def bounds(threshold: float, miss: float, n: int = SIGNATURE, step: int = STEP) -> tuple[int, ...]:
    """Least matches after each batch of a signature: with fewer, P(similarity >= threshold | matches) < miss under a flat prior."""

    def at_most(m: int, k: int) -> float:  # P(Binomial(k + 1, threshold) <= m), the posterior's tail
        return sum(exp(lgamma(k + 2) - lgamma(i + 1) - lgamma(k + 2 - i) + i * log(threshold) + (k + 1 - i) * log(1 - threshold)) for i in range(m + 1))

    return tuple(next(m for m in range(k + 2) if at_most(m, k) >= miss) for k in range(step, n + 1, step))


def surviving(a: np.ndarray, b: np.ndarray, least: tuple[int, ...], step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of signature rows survive all batches, and their matches."""
    at = np.arange(len(a))
    same = np.zeros(len(a), np.int32)
    for i, m in enumerate(least):
        same = same + (a[at, i * step : (i + 1) * step] == b[at, i * step : (i + 1) * step]).sum(1)
        ok = same >= m
        at, same = at[ok], same[ok]
        if not len(at):
            break
    return at, same


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (a, b): rows (id, root), the root being the smallest id. Alternates large and small stars."""
    edges = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(edges)
    while state[0]:
        before = edges
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = materialize(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        edges = large.join(small, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).distinct()
        edges = materialize(edges)
        release(before, least, large)
        last, state = state, _state(edges)
        if last == state:
            break
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("sum(cast(xxhash64(a, b) as decimal(20, 0)))")).first())


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    return np.array([minhash(x, n) for x in sets], np.uint32).reshape(-1, n)


class Sets:
    """How a set's bytes are read: sorted distinct hashes, signatures of many, and whether pairs are linked."""

    small = False
    length = SIGNATURE

    def decode(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data, W.U)

    def sign(self, data: list[bytes], n: int) -> np.ndarray:
        return signatures([self.decode(x) for x in data], n)

    def linked(self, x: list[bytes], y: list[bytes], percent: int) -> np.ndarray:
        return np.array([linked(self.decode(a), self.decode(b), percent) for a, b in zip(x, y, strict=True)], bool)


def _signed(sets: DataFrame, bands: int, rows: int, how: Sets) -> DataFrame:
    """Adds ``sig``: the low bytes of a longer signature (equal with at least the similarity's probability), and band keys."""

    def run(batches):
        for batch in batches:
            for part in W.slices(batch, 1, 4 * W.SLICE):
                full = how.sign(part.column(1).to_pylist(), max(how.length, bands * rows))
                sigs = [x.tobytes() for x in full[:, : how.length].astype(np.uint8)]
                keys = [x.tobytes() for x in band_keys(full[:, : bands * rows], rows)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sigs, pa.binary()), pa.array(keys, pa.binary())], ["id", "set", "sig", "bands"])

    return sets.select("id", "set").mapInArrow(run, "id long, set binary, sig binary, bands binary")


def _pruned(pairs: DataFrame, sets: DataFrame, least: tuple[int, ...]) -> DataFrame:
    """Pairs (a, b) that the signatures do not exclude."""

    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, len(least) * STEP), np.uint8) for i in (2, 3))
            at = pa.array(surviving(a, b, least)[0])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["a", "b"])

    one, two = sets.select(F.col("id").alias("a"), F.col("sig").alias("sa")), sets.select(F.col("id").alias("b"), F.col("sig").alias("sb"))
    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sorted distinct hashes."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    at = np.searchsorted(x, y)
    at[at == len(x)] = 0
    both = int((x[at] == y).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, how: Sets) -> DataFrame:
    """Pairs that are linked by their full sets."""

    def run(batches):
        for batch in batches:
            for part in W.slices(batch, 2, 4 * W.SLICE):
                keep = pa.array(np.flatnonzero(how.linked(part.column(2).to_pylist(), part.column(3).to_pylist(), percent)))
                yield pa.RecordBatch.from_arrays([part.column(0).take(keep), part.column(1).take(keep)], ["a", "b"])

    one, two = sets.select(F.col("id").alias("a"), F.col("set").alias("x")), sets.select(F.col("id").alias("b"), F.col("set").alias("y"))
    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _stars(shared: DataFrame) -> DataFrame:
    """Pairs (a, b): each item with the CENTERS centers that it shares most buckets with."""
    weight = materialize(shared.groupBy("id").agg(F.sum("n").alias("weight")))
    centers = shared.select("key", "id").join(weight, "id").groupBy("key").agg(F.max(F.struct("weight", "id")).alias("c")).select("key", F.col("c.id").alias("b"), F.col("c.weight").alias("weight"))
    # An item has at most one row a band: one exchange by id serves the count and the ranking.
    met = shared.select("key", "id").join(centers, "key").where("id != b").repartition("id").groupBy("id", "b", "weight").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), F.desc("weight"), "b"))
    out = materialize(met.withColumn("place", place).where(F.col("place") <= CENTERS).select(F.col("id").alias("a"), "b"))
    release(weight)
    return out


def _several(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (key, band, id, root) of keys with several components, and per key its largest one and the numbers of rows."""
    # Of buckets with the same members, the one of the lowest band is enough: any pair in it shares no earlier band.
    members = (F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
    keys = rows.groupBy("key", "band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), *members).where("lo < hi")
    mixed = materialize(keys.groupBy("n", "x", "y").agg(F.min(F.struct("band", "key")).alias("k")).select("k.key"))
    rows = materialize(join_checked(rows, mixed, "key"))
    main = rows.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "root")).alias("main"), F.sum("n").alias("all"))
    main = materialize(main.select("key", F.col("main.root").alias("main"), F.col("main.n").alias("n_main"), (F.col("all") - F.col("main.n")).alias("others")))
    release(mixed)
    return rows, main


def _split(rows: DataFrame, sets: DataFrame, percent: int, how: Sets) -> DataFrame:
    """Rows of large mixed buckets under the keys (bucket, shingle) of their prefixes."""

    def shingles(batches):
        for batch in batches:
            for part in W.slices(batch, 3, W.SLICE // 4):
                x = [how.decode(v) for v in part.column(3).to_pylist()]
                at = np.repeat(np.arange(len(x)), [len(v) for v in x])
                each = np.concatenate(x).view(np.int64)
                size = pa.array(np.array([len(v) for v in x], np.int32)[at])
                at = pa.array(at)
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(at) for i in range(3)), size, pa.array(each)], ["key", "id", "root", "size", "shingle"])

    every = rows.join(sets.select("id", "set"), "id").select("key", "id", "root", "set").mapInArrow(shingles, "key long, id long, root long, size int, shingle long")
    every = materialize(every)
    often = materialize(every.groupBy("key", "shingle").agg(F.count("*").alias("often")).where("often > 1"))
    # Shingles of one row link nothing, but hold their places at the head of the order.
    ranked = every.join(often, ["key", "shingle"]).groupBy("key", "id", "root", "size").agg(F.sort_array(F.collect_list(F.struct("often", "shingle"))).alias("s"))
    first = F.col("size") - F.ceil(F.col("size") * percent / 100) + 1 - (F.col("size") - F.size("s"))
    out = ranked.select("key", "id", "root", F.explode(F.slice("s", 1, F.greatest(first, F.lit(0)).cast("int"))).alias("s"))
    out = materialize(out.select((F.xxhash64("key", "s.shingle").bitwiseAND(F.lit(~31))).alias("key"), F.lit(0).alias("band"), "id", "root"))
    release(every, often)
    return out


def _mixed(shared: DataFrame, roots: DataFrame, sets: DataFrame, percent: int, how: Sets, many: int) -> DataFrame:
    """Rows (key, band, id, root, block, lo, hi) of buckets with several components, dealt to pairs of blocks."""
    rows = shared.select("key", "id").join(roots, "id", "left").select("key", F.expr("cast(key & 31 as int)").alias("band"), "id", F.coalesce("root", "id").alias("root"))
    rows, main = _several(rows)
    if main.where(F.col("others") > many).limit(1).count():
        large = main.where(F.col("others") > many).select("key")
        anew, their = _several(_split(rows.join(large, "key", "left_semi"), sets, percent, how))
        rows, main = rows.join(large, "key", "left_anti").unionByName(anew), main.where(F.col("others") <= many).unionByName(their)
    # Rows of a bucket's largest component meet only the others; these meet each other too.
    main = materialize(main.select("key", "main", F.ceil(F.col("n_main") / BLOCK).alias("main_blocks"), F.ceil(F.col("others") / BLOCK).alias("blocks")))
    rows = join_checked(rows, main, "key").withColumn("is_main", F.expr("root = main"))
    # Block numbers: the others 0, 1, ...; the main component's -1, -2, ...
    rows = rows.withColumn("block", F.expr("pmod(xxhash64(id), if(is_main, main_blocks, blocks))")).withColumn("block", F.expr("if(is_main, -1 - block, block)"))
    rows = rows.withColumn("meets", F.expr("if(is_main, sequence(0L, blocks - 1), concat(sequence(0L, blocks - 1), transform(sequence(0L, main_blocks - 1), x -> -1L - x)))"))
    rows = rows.select("key", "band", "id", "root", "block", F.explode("meets").alias("other"))
    return materialize(rows.select("key", "band", "id", "root", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")))


class _Block:
    """Rows of one bucket in one pair of blocks."""

    def __init__(self, band: int, lo: int, hi: int, rows: list[tuple]):
        known: dict[int, int] = {}
        self.ids = [r[0] for r in rows]
        self.names = [r[1] for r in rows]
        self.root = np.array([known.setdefault(r[1], len(known)) for r in rows])
        self.block = np.array([r[2] for r in rows])
        self.sig = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(len(rows), -1)
        self.bands = np.frombuffer(b"".join(r[4] for r in rows), np.int64).reshape(len(rows), -1)
        self.band, self.lo, self.hi = band, lo, hi

    def pairs(self, least: tuple[int, ...]):
        """Pairs between components, in their first shared bucket, that the signatures do not exclude: rows and matches."""
        n = len(self.ids)
        if self.lo == self.hi:
            i, j = np.triu_indices(n, 1)
        else:
            i, j = (x.reshape(-1) for x in np.meshgrid(np.flatnonzero(self.block == self.lo), np.flatnonzero(self.block == self.hi), indexing="ij"))
        ok = self.root[i] != self.root[j]
        i, j = i[ok], j[ok]
        out = [[], [], []]
        for at in range(0, len(i), PAIRS):
            a, b = i[at : at + PAIRS], j[at : at + PAIRS]
            if self.band:
                ok = ~(self.bands[a, : self.band] == self.bands[b, : self.band]).any(1)
                a, b = a[ok], b[ok]
            ok, same = surviving(self.sig[a], self.sig[b], least)
            for to, x in zip(out, (a[ok], b[ok], same), strict=True):
                to.append(x)
        a, b, same = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
        best = np.argsort(-same, kind="stable")
        return a[best].tolist(), b[best].tolist()

    def forest(self, pairs, ok=None) -> list[tuple[int, int]]:
        """Pairs that join components, in order, if ``ok`` holds for them; the components' roots with ``ok``, else the ids."""
        up = list(range(int(self.root.max()) + 1))

        def find(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        out = []
        for i, j in zip(*pairs, strict=True):
            a, b = find(self.root[i]), find(self.root[j])
            if a != b and (ok is None or ok(i, j)):
                up[a] = b
                out.append((self.ids[i], self.ids[j]) if ok is None else (self.names[i], self.names[j]))
        return out


def _blocks(batches, width: int):
    """Groups of rows (key, lo, hi, band, ...) in the sorted stream of a partition."""
    group, held = None, []
    for batch in batches:
        for key, lo, hi, band, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if group != (key, lo, hi, band):
                if len(held) > 1:
                    yield group, held
                group, held = (key, lo, hi, band), []
            held.append(tuple(rest[:width]))
    if len(held) > 1:
        yield group, held


def _wide(column, kind) -> np.ndarray:
    """A binary column of one width as rows of numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _live(batches, least: tuple[int, ...], percent: int, how: Sets):
    """Batches (key, lo, hi, band, id, root, block, sig, bands, set) without the groups that hold no link between components.

    Pairs of many small groups are excluded and verified at once; larger groups stay.
    """
    tail = None
    for batch in chain(batches, [None]):
        if batch is not None:
            batch = pa.concat_batches([tail, batch]) if tail is not None and tail.num_rows else batch
        else:
            batch = tail
        if batch is None or not batch.num_rows:
            continue
        group = np.stack([batch.column(i).to_numpy() for i in range(4)], 1)
        cut = np.append(0, np.flatnonzero((group[1:] != group[:-1]).any(1)) + 1)
        if batch is tail:
            cut, tail = np.append(cut, batch.num_rows), None
        else:  # the last group may go on
            batch, tail = batch.slice(0, cut[-1]), batch.slice(cut[-1])
        size, start = np.diff(cut), cut[:-1]
        if not len(size):
            continue
        band, apart = group[:, 3], group[:, 1] != group[:, 2]
        root, block = (batch.column(i).to_numpy() for i in (5, 6))
        sig, bands = _wide(batch.column(7), np.uint8), _wide(batch.column(8), np.int64)
        stays = size > FEW
        for n in np.unique(size[(size > 1) & (size <= FEW)]).tolist():
            some, (i, j) = np.flatnonzero(size == n), np.triu_indices(n, 1)
            for at in range(0, len(some), max(1, PAIRS // len(i))):
                own = some[at : at + max(1, PAIRS // len(i))]
                a, b = ((start[own][:, None] + x).reshape(-1) for x in (i, j))
                own = np.repeat(own, len(i))
                ok = (root[a] != root[b]) & ~(apart[a] & (block[a] == block[b]))
                a, b, own = a[ok], b[ok], own[ok]
                ok, _ = surviving(sig[a], sig[b], least)
                a, b, own = a[ok], b[ok], own[ok]
                ok = ~((bands[a] == bands[b]) & (np.arange(bands.shape[1]) < band[a][:, None])).any(1)
                x, y = (batch.column(9).take(pa.array(v[ok])).to_pylist() for v in (a, b))
                stays[own[ok][how.linked(x, y, percent)]] = True
        yield batch.take(pa.array(np.flatnonzero(np.repeat(stays, size))))


def _in_groups(found, names: list[str], kinds: list, most: int = 20_000):
    out: list[tuple] = []
    for rows in found:
        out += rows
        if len(out) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
            out = []
    columns = zip(*out, strict=True) if out else [[] for _ in kinds]
    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names)


ORDER = ["key", "lo", "hi", "band"]


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(*ORDER).sortWithinPartitions(*ORDER)


def _forest(rows: DataFrame, sets: DataFrame, least: tuple[int, ...]) -> DataFrame:
    def run(batches):
        blocks = (_Block(g[3], g[1], g[2], rows) for g, rows in _blocks(batches, 5))
        yield from _in_groups((b.forest(b.pairs(least)) for b in blocks), ["a", "b"], [pa.int64()] * 2)

    rows = rows.join(sets.select("id", "sig", "bands"), "id").select(*ORDER, "id", "root", "block", "sig", "bands")
    return _dealt(rows).mapInArrow(run, "a long, b long").distinct()


def _open(rows: DataFrame, sets: DataFrame, least: tuple[int, ...]) -> DataFrame:
    """Rows that still have a pair which the signatures do not exclude."""

    def run(batches):
        def some():
            for (key, lo, hi, band), rows in _blocks(batches, 5):
                block = _Block(band, lo, hi, rows)
                yield [(key, lo, hi, band, *rows[i][:3]) for i in sorted(set().union(*block.pairs(least)))]

        yield from _in_groups(some(), [*ORDER, "id", "root", "block"], [pa.int64()] * 3 + [pa.int32()] + [pa.int64()] * 3)

    rows = rows.join(sets.select("id", "sig", "bands"), "id").select(*ORDER, "id", "root", "block", "sig", "bands")
    return _dealt(rows).mapInArrow(run, "key long, lo long, hi long, band int, id long, root long, block long")


def _rest(rows: DataFrame, sets: DataFrame, least: tuple[int, ...], percent: int, how: Sets) -> DataFrame:
    """Links between components (a, b: their roots), verified inside the blocks."""

    def run(batches):
        def found():
            for (_, lo, hi, band), rows in _blocks(_live(batches, least, percent, how), 6):
                block = _Block(band, lo, hi, rows)
                full = lru_cache(None)(lambda i, rows=rows: how.decode(rows[i][5]))
                yield block.forest(block.pairs(least), lambda i, j, full=full: linked(full(i), full(j), percent))

        yield from _in_groups(found(), ["a", "b"], [pa.int64()] * 2)

    rows = rows.join(sets.select("id", "sig", "bands", "set"), "id").select(*ORDER, "id", "root", "block", "sig", "bands", "set")
    return _dealt(rows).mapInArrow(run, "a long, b long")


def near_components(blobs: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int, bands: int, rows: int, miss: float = 1e-8, how: Sets | None = None, many: int = MANY) -> DataFrame:
    """Components of items with 100 * intersection >= percent * union: (id, root) of linked items.

    ``blobs`` are the items' packed band rows; an id may repeat. ``sets_of(ids)`` gives (id, set) once for each of some
    ids; ``how`` reads a set's bytes.
    """
    how = how or Sets()
    if bands > 32:
        raise ValueError("at most 32 bands")
    least = bounds(percent / 100, miss, how.length)
    shared = materialize(shared_buckets(blobs))
    ids = materialize(shared.select("id").distinct())
    sets = materialize(_signed(sets_of(ids), bands, rows, how))
    stars = _stars(shared)
    near = stars if how.small else _pruned(stars, sets, least)
    edges = materialize(_verified(near, sets, percent, how))
    roots = materialize(components(edges))
    mixed = _mixed(shared, roots, sets, percent, how, many)
    release(ids, stars)
    if how.small:  # sets about as large as signatures: what is left is verified at once
        still = mixed
    else:
        forest = materialize(_forest(mixed, sets, least))
        more = materialize(_verified(forest, sets, percent, how))
        if more.limit(1).count():
            before = (mixed, roots)
            edges = materialize(edges.unionByName(more))
            roots = materialize(components(edges))
            mixed = _mixed(shared, roots, sets, percent, how, many)
            release(*before)
        still = materialize(_open(mixed, sets, least))
        release(forest, mixed)
    last = materialize(_rest(still, sets, least, percent, how))
    if last.limit(1).count():
        joined = materialize(components(last))
        joined = joined.select(F.col("id").alias("root"), F.col("root").alias("top"))
        lone = joined.join(roots.select("root").distinct(), "root", "left_anti").select(F.col("root").alias("id"), "top")
        roots = materialize(roots.join(joined, "root", "left").select("id", F.coalesce("top", "root").alias("root")).unionByName(lone.select("id", F.col("top").alias("root"))))
    release(shared, sets, still)
    return roots
