"""Quality classifier: a byte-level convolutional network in numpy.

The whole text is cut into overlapping chunks. A first layer of filters over ``width`` bytes (one learned
vector for each byte value and place, so that a filter is a sum of table rows) is rectified and pooled in each chunk,
by maximum and by mean; a second layer combines a chunk's pooled filters into features; features are max-pooled
and averaged over all chunks of the document and combined into one probability.

Training is stochastic gradient descent (Adam) on at most ``sample`` labelled rows, chosen by the smallest hashes of
their doc_id: the documented bound. Scoring covers whole texts of all rows, batch by batch, in bounded memory.

Inputs are bytes only. Labels come from rows whose crc32(doc_id as text) mod 5 is not 0. Defined cases: null counts as
empty, an empty text is one chunk of padding; null doc_ids are held out; without labelled rows of both kinds
every score is the share of label 1 (0.5 without any); an empty table gives an empty result; very long texts are scored
whole, chunk by chunk; repeated rows repeat; extra columns are ignored; a doc_id that is no integer is an error of the cast.
The bound on bytes holds before any text reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelake.llm import _words as W

RESULT = "doc_id long, held_out boolean, score double, predicted int"
THRESHOLD = 0.3
CHUNK, STRIDE, WIDTH = 256, 224, 5
FILTERS, HIDDEN = 12, 16


class Network:
    def __init__(self, seed: int = 7, base: float = 0.5):
        r = np.random.default_rng(seed)
        f = np.float32
        self.base = base
        self.p = {
            "table": (r.standard_normal((WIDTH, 256, FILTERS)) * 0.3).astype(f),
            "b0": np.zeros(FILTERS, f),
            "w1": (r.standard_normal((2 * FILTERS, HIDDEN)) * (1 / np.sqrt(2 * FILTERS))).astype(f),
            "b1": np.zeros(HIDDEN, f),
            "w2": (r.standard_normal(2 * HIDDEN) * (1 / np.sqrt(2 * HIDDEN))).astype(f),
            "b2": np.zeros(1, f),
        }
        self.trained = False

    def chunks(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Padded chunks (n, CHUNK) of rows data[cuts[i]:cuts[i+1]], and the row of each."""
        size = np.diff(cuts)
        many = np.maximum(1, -(-(size - CHUNK) // STRIDE) + 1)
        row = np.repeat(np.arange(len(size)), many)
        number = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        start = cuts[:-1][row] + number * STRIDE
        left = np.minimum(CHUNK, cuts[1:][row] - start)
        at = np.minimum(start[:, None] + np.arange(CHUNK), max(0, len(data) - 1))
        body = data[at] if len(data) else np.zeros((len(row), CHUNK), np.uint8)
        return np.where(np.arange(CHUNK) < left[:, None], body, np.uint8(0)), row

    def filters(self, x: np.ndarray) -> np.ndarray:
        """Rectified filters at all places: (n, CHUNK - WIDTH + 1, FILTERS)."""
        n = CHUNK - WIDTH + 1
        z = self.p["table"][0][x[:, :n]]
        for j in range(1, WIDTH):
            z += self.p["table"][j][x[:, j : j + n]]
        z += self.p["b0"]
        return np.maximum(z, 0, out=z)

    def score(self, data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Probabilities of rows; chunks are taken in runs of bounded size."""
        rows = len(cuts) - 1
        if not self.trained:
            return np.full(rows, self.base)
        top = np.zeros((rows, HIDDEN), np.float32)
        total, count = np.zeros((rows, HIDDEN), np.float64), np.zeros(rows)
        for a, b, d, c in _runs(data, cuts):
            x, row = self.chunks(d, c)
            for i in range(0, len(x), 96):
                z = self.filters(x[i : i + 96])
                u = np.concatenate([z.max(1), z.mean(1)], 1)
                h = np.maximum(u @ self.p["w1"] + self.p["b1"], 0)
                r = row[i : i + 96] + a
                first = np.flatnonzero(np.append(True, np.diff(r) > 0))
                one = r[first]
                top[one] = np.maximum(top[one], np.maximum.reduceat(h, first))
                total[one] += np.add.reduceat(h, first)
                count[one] += np.diff(np.append(first, len(r)))
        v = np.concatenate([top, (total / np.maximum(count, 1)[:, None]).astype(np.float32)], 1)
        return 1 / (1 + np.exp(-(v @ self.p["w2"] + self.p["b2"]).astype(np.float64)))

    def train(self, texts: list[bytes], labels: np.ndarray, epochs: int = 3, rate: float = 0.01, seed: int = 7) -> Network:
        """Gradient descent over batches of documents; long ones take part with all their chunks."""
        r = np.random.default_rng(seed)
        p, first, second, step = self.p, {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0
        weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-6), 0.5 / max(1 - labels.mean(), 1e-6)).astype(np.float32)
        weight = np.sqrt(weight)
        for epoch in range(epochs):
            for some in np.array_split(r.permutation(len(texts)), max(1, len(texts) // 32)):
                data = np.frombuffer(b"".join(texts[i] for i in some), np.uint8)
                cuts = np.append(0, np.cumsum([len(texts[i]) for i in some]))
                x, row = self.chunks(data, cuts)
                n = len(some)
                z = self.filters(x)
                best = z.argmax(1)
                u = np.concatenate([np.take_along_axis(z, best[:, None], 1)[:, 0], z.mean(1)], 1)
                h = np.maximum(u @ p["w1"] + p["b1"], 0)
                bound = np.flatnonzero(np.append(True, np.diff(row) > 0))
                many = np.diff(np.append(bound, len(row)))
                top = np.maximum.reduceat(h, bound)
                v = np.concatenate([top, np.add.reduceat(h, bound) / many[:, None]], 1)
                y = 1 / (1 + np.exp(-(v @ p["w2"] + p["b2"])))
                dy = ((y - labels[some]) * weight[some] / n).astype(np.float32)
                g = {"w2": v.T @ dy, "b2": dy.sum(keepdims=True)}
                dv = dy[:, None] * p["w2"]
                is_top = (h == top[row]) & (h > 0)
                dh = np.where(is_top, dv[row, :HIDDEN], 0) + dv[row, HIDDEN:] / many[row][:, None]
                dh *= h > 0
                g["w1"], g["b1"] = u.T @ dh, dh.sum(0)
                du = dh @ p["w1"].T
                places = z.shape[1]
                dz = np.repeat(du[:, None, FILTERS:] / places, places, 1)
                np.put_along_axis(dz, best[:, None], np.take_along_axis(dz, best[:, None], 1) + du[:, None, :FILTERS], 1)
                dz *= z > 0
                g["b0"] = dz.sum((0, 1))
                flat = dz.reshape(-1, FILTERS)
                g["table"] = np.empty_like(p["table"])
                for j in range(WIDTH):
                    at = x[:, j : j + places].reshape(-1)
                    for k in range(FILTERS):
                        g["table"][j, :, k] = np.bincount(at, flat[:, k], 256)
                step += 1
                fade = rate * (1 - 0.8 * epoch / epochs)
                for k in p:
                    first[k] += 0.1 * (g[k] - first[k])
                    second[k] += 0.01 * (g[k] ** 2 - second[k])
                    p[k] -= (fade * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        self.trained = True
        return self


def _runs(data: np.ndarray, cuts: np.ndarray, most: int = 1 << 20):
    """Rows a to b with about ``most`` bytes; a longer row comes in pieces that keep the chunks' places."""
    a = 0
    while a < len(cuts) - 1:
        b = max(a + 1, int(np.searchsorted(cuts, cuts[a] + most, "right")) - 1)
        if b == a + 1 and cuts[b] - cuts[a] > most:
            step = most // STRIDE * STRIDE
            n = int(cuts[b] - cuts[a])
            for s in range(0, max(1, n - (CHUNK - STRIDE)), step):
                d = data[cuts[a] + s : min(cuts[b], cuts[a] + s + step + CHUNK - STRIDE)]
                yield a, b, d, np.array([0, len(d)])
        else:
            yield a, b, data[cuts[a] : cuts[b]], cuts[a : b + 1] - cuts[a]
        a = b


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the cuts between rows."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset :]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _fold(parts: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts))


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", sample: int = 6000, sample_bytes: int = 24 << 20) -> Network:
    """Train on at most ``sample`` labelled rows of the training folds, smallest hashes first, and at most ``sample_bytes``."""
    marked = labels.select(F.col("doc_id").alias("l_doc"), F.col(target).cast("int").alias("label")).where("l_doc is not null and label in (0, 1)")
    marked = marked.groupBy("l_doc").agg(F.max("label").alias("label"))
    known = marked.withColumnRenamed("l_doc", "doc_id").where(_fold(5) != 0)
    # The bound comes before the texts are fetched: hashes and ids are sorted, the first ones keep their texts.
    chosen = known.select("doc_id", "label", F.xxhash64("doc_id", F.lit(11)).alias("h")).orderBy("h", "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("h", "doc_id", "label", F.coalesce("text", F.lit("")).alias("text"))
    # The bound on bytes comes before any text reaches the driver; a first text beyond it comes alone.
    order = Window.orderBy("h", "doc_id", "text").rowsBetween(Window.unboundedPreceding, 0)
    sums = (F.sum(F.octet_length("text")).over(order).alias("bytes"), F.count("*").over(order).alias("n"))
    rows = rows.orderBy("h", "doc_id", "text").limit(sample).select("*", *sums).where((F.col("bytes") <= sample_bytes) | (F.col("n") == 1))
    some = sorted(rows.select("h", "doc_id", "text", "label").collect())
    texts, given = [r.text.encode() for r in some], [r.label for r in some]
    y = np.array(given, np.float32)
    net = Network(base=float(y.mean()) if len(y) else 0.5)
    return net.train(texts, y) if len(y) and 0 < y.mean() < 1 else net


def score_quality(docs: DataFrame, net: Network) -> DataFrame:
    """Per document: fold, probability and decision."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        net = shared.value
        for batch in batches:
            for part in W.slices(batch):
                score = net.score(*_bytes(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(score, pa.float64()), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(_fold(5) == 0, F.lit(True))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held_out")).mapInArrow(run, RESULT)


def keep_good(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    text = docs.columns.index("text")

    def run(batches):
        net = shared.value
        for batch in batches:
            for part in W.slices(batch, text):
                yield part.filter(pa.array(net.score(*_bytes(part.column(text))) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    from tracelake.llm._io import table

    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit(docs, table(spark, sf_dir, "labels")))
