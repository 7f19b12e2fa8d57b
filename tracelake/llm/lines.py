"""Line dedup: fuzzy lines by MinHash over character shingles.

Lines are cut at line feeds; lines without anything but ASCII white space always stay and are never compared. A line's
set is its distinct ``shingle``-character shingles (a shorter line is one shingle). Equal lines are one item;
``bands`` bands of ``rows`` MinHash values give candidates (22 of 7 miss a pair at 0.8 with probability 0.006, at 0.85
with 0.0002; unlike lines of prose have similarities of 0.1 to 0.2, and with fewer rows many share a band), which are verified by exact Jaccard similarity; distributed union-find joins them, and the first line
of each component stays: the smallest (doc_id, line number).

Texts are read three times: for the hashes of all lines, for the band keys of a task's distinct lines, and for the lines
that share a band. Neither texts nor band keys are written to tables.

Defined cases: null texts have no lines and an empty text has one blank line; an empty table gives an empty result;
very long lines are one item each, whatever their length; a null doc_id comes before all others; rows that repeat a
document's id and text share its lines and are one row of the result; of equal places none is dropped; extra columns
are ignored; a doc_id that is no integer is an error of the cast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm import _words as W
from tracelake.llm._io import join_checked, materialize, release
from tracelake.llm._linkage import BLOBS, PART_ROWS, Sets, band_keys, factors, near_components, packed

LINES = "doc_id long, row long, n_lines long, line array<int>, id array<long>"
CHUNK = 1 << 17
FACTORS = factors(72)[64:]


def line_sets(lines: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all lines, and where each line's begin; repeats stay in."""
    text = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(W.U)
    size = np.array([len(x) for x in lines], np.int64)
    h = W._mix(text + W.U(1))
    every = W.grams(h, k)
    first = np.append(0, np.cumsum(size))
    count = np.maximum(size - k + 1, 1)
    out = np.empty(int(count.sum()), W.U)
    at = np.append(0, np.cumsum(count))
    long = size >= k
    place = np.repeat(first[:-1][long] - at[:-1][long], count[long])
    target = np.flatnonzero(np.repeat(long, count))
    out[target] = every[target + place]
    for n in np.unique(size[~long]).tolist():
        some = np.flatnonzero(size == n)
        out[at[some]] = W.grams(h, n)[first[some]]
    return out, at[:-1]


def line_hashes(lines: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The same shingles by hashes of 32 bits, for signatures only."""
    text = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.array([len(x) for x in lines], np.int64)
    first = np.append(0, np.cumsum(size))
    # A shingle at every place, the last k - 1 of a line left out; places behind the end count as nothing.
    x = np.zeros(len(text), np.uint32)
    for j in range(min(k, len(text))):
        x[: len(text) - j] += (text[j:] + np.uint32(1)) * FACTORS[j % len(FACTORS)]
    for n in np.unique(size[size < k]).tolist():
        some = first[:-1][size == n]
        x[some] = 0
        for j in range(n):
            x[some] += (text[some + j] + np.uint32(1)) * FACTORS[j % len(FACTORS)]
    if len(lines) > 1:
        count = np.maximum(size - k + 1, 1)
        inside = np.ones(len(text), bool)
        for j in range(1, k):
            at = first[1:] - j
            inside[at[at > first[:-1]]] = False
        x = x[inside]
        first = np.append(0, np.cumsum(count))
    else:
        x = x[: max(1, len(x) - k + 1)]
        first = np.array([0, len(x)])
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x, first[:-1]


def _minima(x: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """Signatures of runs of shingles."""
    out, h = np.empty((len(first), n), np.uint32), np.empty_like(x)
    for j, a in enumerate(factors(n)):
        np.multiply(x, a, out=h)
        out[:, j] = np.minimum.reduceat(h, first)
    return out


def _chunks(lines: list[str]):
    at, size = 0, 0
    for i, x in enumerate(lines):
        size += len(x)
        if size >= CHUNK:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(lines):
        yield at, len(lines)


class LineSets(Sets):
    """Sets kept as the lines themselves."""

    small = True
    length = 128

    def __init__(self, k: int):
        self.k = k

    def decode(self, data: bytes) -> np.ndarray:
        return np.unique(line_sets([data.decode()], self.k)[0])

    def sign(self, data: list[bytes], n: int) -> np.ndarray:
        lines = [x.decode() for x in data]
        return np.concatenate([np.zeros((0, n), np.uint32), *(_minima(*line_hashes(lines[a:b], self.k), n) for a, b in _chunks(lines))])

    def linked(self, x: list[bytes], y: list[bytes], percent: int) -> np.ndarray:
        one, two = [v.decode() for v in x], [v.decode() for v in y]
        out = [np.zeros(0, bool)]
        for a, b in _chunks([v + w for v, w in zip(one, two, strict=True)]):
            (p, left), (q, right) = (self._marked(v[a:b]) for v in (one, two))
            at = np.minimum(np.searchsorted(p, q), len(p) - 1)
            n, m, both = (np.bincount(v, minlength=b - a) for v in (left, right, right[p[at] == q]))
            out.append(100 * both >= percent * (n + m - both))
        return np.concatenate(out)

    def _marked(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles of all lines, told apart by their line's place, and these places."""
        h, first = line_sets(lines, self.k)
        owner = np.repeat(np.arange(len(lines)), np.diff(np.append(first, len(h))))
        h, at = np.unique(W._mix(h + owner.astype(W.U) * W.U(0x9E3779B97F4A7C15)), return_index=True)
        return h, owner[at]


def _lines_of(column: pa.Array):
    """Lines of each text; none for a null."""
    for text in column.cast(pa.large_binary()).to_pylist():
        yield [] if text is None else text.split(b"\n")


def line_id(line: bytes) -> int:
    return xxhash.xxh3_64_intdigest(line) - (1 << 63)


def _found(docs: DataFrame) -> DataFrame:
    """Per document: number of lines, and numbers and ids of those that are not blank."""

    def run(batches):
        for batch in batches:
            for part in W.slices(batch):
                n, cuts, number, ids = [], [0], [], []
                for lines in _lines_of(part.column(1)):
                    n.append(len(lines))
                    some = [i for i, x in enumerate(lines) if x.strip()]
                    number += some
                    ids += [line_id(lines[i]) for i in some]
                    cuts.append(len(ids))
                lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x, t)) for x, t in ((number, pa.int32()), (ids, pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n, pa.int64()), *lists], ["doc_id", "row", "n_lines", "line", "id"])

    return docs.mapInArrow(run, LINES)


def _distinct(batches, wanted: np.ndarray | None = None):
    """Ids and lines of a task (of the ``wanted`` ids, which ascend, if given), each once until the memory of ids is full."""
    seen: set[int] = set()
    for batch in batches:
        for part in W.slices(batch):
            lines = [x for some in _lines_of(part.column(1)) for x in some]
            ids = np.fromiter(map(line_id, lines), np.int64, len(lines))
            if wanted is not None:
                at = np.searchsorted(wanted, ids)
                some = np.flatnonzero(wanted[np.minimum(at, len(wanted) - 1)] == ids) if len(wanted) else np.zeros(0, np.int64)
                lines, ids = [lines[i] for i in some], ids[some]
            new = {}
            for one, x in zip(ids.tolist(), lines, strict=True):
                if one not in seen and x.strip():
                    seen.add(one)
                    new[one] = x
            yield np.fromiter(new, np.int64, len(new)), list(new.values())
            if len(seen) > 1_000_000:
                seen.clear()


def _blobs(docs: DataFrame, k: int, bands: int, rows: int, parts: int) -> DataFrame:
    def keys(batches):
        for ids, lines in _distinct(batches):
            lines = [x.decode() for x in lines]
            for a, b in _chunks(lines):
                yield ids[a:b], band_keys(_minima(*line_hashes(lines[a:b], k), bands * rows), rows)

    return docs.mapInArrow(lambda batches: packed(keys(batches), parts), BLOBS)


def _texts(docs: DataFrame, ids: DataFrame, most: int = 2_000_000) -> DataFrame:
    """The line of each wanted id; up to ``most`` ids are sent to the tasks, beyond that lines and ids are shuffled."""
    few = ids.limit(most + 1).count() <= most
    wanted = docs.sparkSession.sparkContext.broadcast(np.sort(ids.toArrow().column("id").to_numpy().astype(np.int64)) if few else None)

    def run(batches):
        for some, lines in _distinct(batches, wanted.value if few else None):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(lines, pa.binary())], ["id", "set"])

    out = docs.mapInArrow(run, "id long, set binary")
    return (out if few else out.join(ids, "id")).dropDuplicates(["id"])


def _lines(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "row", F.explode(F.arrays_zip("line", "id")).alias("x")).select("doc_id", "row", "x.line", "x.id")


def _named(docs: DataFrame, shingle: int, percent: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """Lines of documents, and (id, root, first place) of the ids that stand at several places or have a near copy."""
    found = materialize(_found(docs))
    most = found.agg(F.coalesce(F.sum(F.size("id")), F.lit(0))).first()[0]
    blobs = _blobs(docs, shingle, bands, rows, max(1, most * bands // PART_ROWS))
    roots = near_components(blobs, lambda ids: _texts(docs, ids), percent, bands, rows, how=LineSets(shingle))
    each = _lines(found).groupBy("id").agg(F.min(F.struct("doc_id", "row", "line")).alias("place"), F.count("*").alias("n"))
    several = each.join(roots, "id", "left").where("n > 1 or root is not null")
    several = materialize(several.select("id", "place", F.coalesce("root", "id").alias("root")))
    best = materialize(several.groupBy("root").agg(F.min("place").alias("first")))
    named = materialize(several.select("id", "root").join(best, "root").select("id", "root", "first"))
    release(several, best, roots)
    return found, named


KEPT = "first is null or struct(doc_id, row, line) <=> first"


def line_groups(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = 22, rows: int = 7) -> DataFrame:
    """Per line that is not blank: doc_id, row (hash of the text), line, id, root (the component) and whether it stays."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", F.xxhash64("text"))
    found, named = _named(docs, shingle, percent, bands, rows)
    return _lines(found).join(named, "id", "left").select("doc_id", "row", "line", "id", F.coalesce("root", "id").alias("root"), F.expr(KEPT).alias("kept"))


def _dropped(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = 22, rows: int = 7) -> tuple[DataFrame, DataFrame]:
    found, named = _named(docs, shingle, percent, bands, rows)
    gone = join_checked(_lines(found), named, "id").where(f"not ({KEPT})")
    return found, gone.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("line")).alias("dropped"))


def document_lines(docs: DataFrame, **parameters) -> DataFrame:
    """Per document (rows that repeat id and text are one): lines, dropped lines and their numbers from 0."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", F.xxhash64("text"))
    found, gone = _dropped(docs, **parameters)
    a, b = found.select("doc_id", "row", "n_lines").distinct(), gone.select(F.col("doc_id").alias("d"), F.col("row").alias("r"), "dropped")
    out = a.join(b, (a["row"] == b["r"]) & a["doc_id"].eqNullSafe(b["d"]), "left").withColumn("dropped", F.coalesce("dropped", F.array().cast("array<int>")))
    return out.select("doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), F.array_join("dropped", ",").alias("dropped_lines"))


def without_repeats(docs: DataFrame, **parameters) -> DataFrame:
    """(doc_id, text): every document's text without its dropped lines."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", F.xxhash64("text"))
    _, gone = _dropped(docs, **parameters)
    gone = gone.select(F.col("doc_id").alias("d"), F.col("row").alias("r"), "dropped")
    out = docs.join(gone, (docs["row"] == gone["r"]) & docs["doc_id"].eqNullSafe(gone["d"]), "left")
    kept = F.expr("array_join(filter(split(text, '\\n', -1), (x, i) -> not array_contains(dropped, i)), '\\n')")
    return out.select("doc_id", F.when(F.col("dropped").isNull(), F.col("text")).otherwise(kept).alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    from tracelake.llm._io import table

    return document_lines(table(spark, sf_dir, "documents"))
