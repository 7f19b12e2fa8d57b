"""LM scoring: a causal self-attention model in numpy on subword ids, mixed with word counts.

Subwords come from a public byte-level merge file, one word at a time with its leading space, so that subword ids spell
words uniquely. The network reads windows of ``SPAN`` ids: embeddings and places, one masked attention head, a residual
connection, a rectified layer and a softmax over CLASSES classes of subwords; inside a class, subwords have their
shares in the training counts. Windows overlap: the first scores all its ids, each later one the ids after its first
``SPAN - HOP``, so that every id is scored once, in batches, with at least that much context.
The network's probability of a word is that of its first subword among all that begin a word, times those of its other
subwords, times that of the word closing there: the next subword begins a word too. So its probabilities of words and
the end sum to 1, as the shares of training tokens do, and so does a word's probability here, at every size:
weight * share + (1 - weight) * network. A text's score is the sum of log10 over its words and its end.
The weight is learned by deleted interpolation: it makes the words of training documents likeliest, where each word's own
occurrence is taken from its count, so that words that stand once are left to the network. In the query all training
documents teach it; ``slice_of`` can name those of one remainder. Held-out documents have no part in it.

What is learned covers all training documents whole: word counts, subword counts, and the gradient steps, on
consecutive windows in which every id of every training document is predicted. Windows are dealt to ROUNDS rounds by a
hash; in each, trainers of about PER_TRAINER windows, as many as it takes, start from the same weights, make PASSES
passes over theirs in a fixed order, and their weights are averaged by block. Rounds, passes and windows a trainer are
the same at every size, and nothing is trained on the driver.
Word counts are joined exactly, for both scores and for the weight: the most frequent words, at most ``FREQUENT``, are
broadcast, and every occurrence of another word is shuffled with its network probability.

Defined cases: null counts as empty, an empty text is its end alone; a null doc_id is held out; without training rows
counts are 0 and the score is the network's start; without rows that teach it the weight is 1/2; an empty table gives an empty result; very long texts are cut into
windows like all others; repeated rows repeat; extra columns are ignored; a doc_id that is no integer is an error of the cast.
"""

from __future__ import annotations

import base64
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm import _words as W
from tracelake.llm._io import materialize, release

END = 50256
NONE = 65535
SPAN, HOP, WIDE, CLASSES, INPUTS, LAYER = 32, 28, 16, 64, 4096, 32
FREQUENT = 300_000
ROUNDS, PASSES = 4, 1
PER_TRAINER = 200_000
CHUNK = 64
SLICE_OF = 1
BINS_A_UNIT, WIDEST = 16, 960
ALONE = WIDEST + 1
HIGHEST = np.float32(60)
BLOCKS = 16
END_KEY = 1
MOST_WORDS = 800_000
PART_WORDS = 200_000
PART_TOKENS = 1 << 17


def load(path: str):
    """The merge file as an encoder of single words."""
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    return tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


_PIECES: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    """One cache a worker: it outlives a task."""
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def spare(pieces: bool = False) -> None:
    """Give back what a worker, which outlives its tasks, holds and does not use: freed batches, and its ``pieces`` too."""
    if pieces:
        _PIECES.clear()
    pa.default_memory_pool().release_unused()


def word_starts(path: str) -> np.ndarray:
    """Which ids begin a word; the end counts as one."""
    out = np.zeros(END + 1, bool)
    for token, i in map(bytes.split, Path(path).read_bytes().splitlines()):
        out[int(i)] = base64.b64decode(token).startswith(b" ")
    out[END] = True
    return out


class Numbers:
    """Numbers of 64-bit hashes in the order they were put in: open addressing with linear steps, at most half full."""

    def __init__(self, most: int):
        self.bits = max(4, (2 * most - 1).bit_length())
        self.key, self.number, self.have = np.zeros(1 << self.bits, W.U), np.full(1 << self.bits, -1, np.int32), 0

    def _slots(self, h: np.ndarray) -> np.ndarray:
        """Each hash's slot, or the empty one where it would go."""
        at = (h >> W.U(64 - self.bits)).astype(np.int64)
        other = np.flatnonzero((self.key[at] != h) & (self.number[at] >= 0))
        while len(other):
            at[other] = to = (at[other] + 1) & ((1 << self.bits) - 1)
            other = other[(self.key[to] != h[other]) & (self.number[to] >= 0)]
        return at

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers, -1 for hashes that are not there."""
        return self.number[self._slots(h)]

    def put(self, h: np.ndarray) -> None:
        """Take in distinct new hashes."""
        number, left = np.arange(self.have, self.have + len(h), dtype=np.int32), np.arange(len(h))
        self.have += len(h)
        while len(left):
            at = self._slots(h[left])
            self.number[at] = number[left]
            won = self.number[at] == number[left]  # of several for one slot, one
            self.key[at[won]] = h[left[won]]
            left = left[~won]


class Pieces:
    """Subword ids of words by hash: numbers of words and their runs in one array."""

    def __init__(self, path: str):
        self.one = load(path)._core_bpe.encode_single_piece
        self.clear()

    def clear(self):
        self.words, self.at, self.size, self.flat = Numbers(MOST_WORDS), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint16)

    def sequence(self, words: W.Words) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and the number of ids of each word."""
        parts = [self._part(words, i, i + PART_WORDS) for i in range(0, len(words.hash), PART_WORDS)]
        return tuple(np.concatenate([np.zeros(0, t), *x]) for t, x in zip((np.uint16, np.int64), zip(*parts) if parts else ((), ()), strict=True))

    def _part(self, words: W.Words, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        h = words.hash[lo:hi]
        number = self.words.find(h)
        new = np.flatnonzero(number < 0)
        if len(new):
            known, first = np.unique(h[new], return_index=True)
            if self.words.have + len(known) > MOST_WORDS:
                self.clear()
                known, first = np.unique(h, return_index=True)
            else:
                first = new[first]
            data, one = words.data, self.one
            ids = [one(b" " + data[a:b].tobytes()) for a, b in zip(words.start[lo:hi][first].tolist(), words.end[lo:hi][first].tolist(), strict=True)]
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            self.at = np.append(self.at, len(self.flat) + np.append(0, np.cumsum(size)[:-1]))
            self.size = np.append(self.size, size)
            self.flat = np.append(self.flat, np.fromiter(chain.from_iterable(ids), np.uint16, int(size.sum())))
            self.words.put(known)
            number = self.words.find(h)
        size = self.size[number]
        place = np.repeat(self.at[number] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return self.flat[place], size


class Attention:
    """The network. ``inputs`` maps ids to embedding rows, ``classes`` to classes, ``share`` is log p(id | class)."""

    def __init__(self, counts: np.ndarray, starts: np.ndarray, seed: int = 5):
        r, f = np.random.default_rng(seed), np.float32
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(counts), np.int64)
        rank[order] = np.arange(len(counts))
        self.inputs = np.where(rank < INPUTS - 256, rank, INPUTS - 256 + rank % 256).astype(np.int32)
        smooth = counts + 0.05
        # Equal masses in the order of counts, word starts apart from the rest; a frequent id gets a class of its own.
        order = np.lexsort((-counts, ~starts))
        mass = np.cumsum(smooth[order]) / smooth.sum()
        self.classes = np.empty(len(counts), np.int32)
        c, used, start, split = 0, 0.0, 0, int(starts.sum())
        while start < len(order):
            goal = used + (1 - used) / (CLASSES - c)
            to = len(order) if c == CLASSES - 1 else max(start + 1, int(np.searchsorted(mass, goal, "right")))
            to = split if start < split < to else to
            self.classes[order[start:to]] = c
            used, start, c = float(mass[to - 1]), to, min(c + 1, CLASSES - 1)
        total = np.bincount(self.classes, smooth, CLASSES)
        self.starts = np.zeros(CLASSES, np.float32)
        self.starts[self.classes[starts]] = 1
        self.share = np.log(smooth / total[self.classes]).astype(f)
        draw = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(f)
        self.p = {
            "e": (r.standard_normal((INPUTS, WIDE)) * 0.3).astype(f), "place": (r.standard_normal((SPAN, WIDE)) * 0.1).astype(f),
            "qkv": draw(WIDE, 3 * WIDE), "w": draw(WIDE, LAYER), "b": np.zeros(LAYER, f),
            "o": draw(LAYER, CLASSES), "c": np.log(total / total.sum()).astype(f),
        }
        self.most = np.where(np.tril(np.ones((SPAN, SPAN), bool)), HIGHEST, -1e9).astype(f)

    def hidden(self, ids: np.ndarray):
        """Rows of all places: inputs, the parts of attention (weights ``s`` before division by their sums ``a``), and the layer's values."""
        p, (n, t) = self.p, ids.shape
        at = self.inputs[ids.reshape(-1)]
        x = p["e"][at]
        x.reshape(n, t, WIDE)[:] += p["place"][:t]
        y = (x @ p["qkv"]).reshape(n, t, 3 * WIDE)
        q, k, v = y[..., :WIDE] * np.float32(WIDE**-0.5), y[..., WIDE : 2 * WIDE], y[..., 2 * WIDE :]
        s = q @ k.transpose(0, 2, 1)
        np.minimum(s, self.most[:t, :t], out=s)
        np.exp(s, out=s)
        a = (s.reshape(-1, t) @ np.ones(t, np.float32)).reshape(n, t, 1)
        h = s @ v
        h /= a
        h = h.reshape(-1, WIDE)
        h += x
        u = h @ p["w"]
        u += p["b"]
        np.maximum(u, 0, out=u)
        return at, x, q, k, v, s, a, h, u

    def masses(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """exp of the logits of classes, which are bounded by HIGHEST from above, and their sums."""
        z = u @ self.p["o"]
        z += self.p["c"]
        np.minimum(z, HIGHEST, out=z)
        np.exp(z, out=z)
        return z, z @ np.ones(CLASSES, np.float32)

    def log(self, ids: np.ndarray, target: np.ndarray, skip: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Natural log probabilities of ``target`` ids after ``ids``, and of any word beginning there; without the first ``skip`` places."""
        n, t = ids.shape
        u = self.hidden(ids)[-1].reshape(n, t, LAYER)[:, skip:].reshape(-1, LAYER)
        z, total = self.masses(u)
        goal = target[:, skip:].reshape(-1)
        own = z.reshape(-1)[np.arange(len(goal)) * CLASSES + self.classes[goal]]
        total = np.log(total)
        with np.errstate(divide="ignore"):
            found = np.maximum(np.log(own), -1e4) - total + self.share[goal], np.maximum(np.log(z @ self.starts), -1e4) - total
        return tuple(x.reshape(n, -1) for x in found)

    def step(self, ids: np.ndarray, target: np.ndarray, real: np.ndarray) -> tuple[dict, float]:
        """Gradients of the mean loss over real places."""
        p, (n, t) = self.p, ids.shape
        at, x, q, k, v, s, a, h, u = self.hidden(ids)
        s /= a
        z, total = self.masses(u)
        own, flat = np.arange(n * t) * CLASSES + self.classes[target.reshape(-1)], z.reshape(-1)
        real = (real.reshape(-1) / max(1, int(real.sum()))).astype(np.float32)
        loss = float((real * (np.log(total) - np.log(flat[own] + np.float32(1e-30)))).sum())
        z *= (real / total)[:, None]
        flat[own] -= real
        one = np.ones(n * t, np.float32)
        g = {"o": u.T @ z, "c": one @ z}
        du = z @ p["o"].T
        du *= u > 0
        g["w"], g["b"] = h.T @ du, one @ du
        dh = du @ p["w"].T
        back = dh.reshape(n, t, WIDE)
        ds = back @ v.transpose(0, 2, 1)
        ds -= ((ds * s).reshape(-1, t) @ np.ones(t, np.float32)).reshape(n, t, 1)
        ds *= s
        dy = np.empty((n, t, 3 * WIDE), np.float32)
        np.multiply(ds @ k, np.float32(WIDE**-0.5), out=dy[..., :WIDE])
        dy[..., WIDE : 2 * WIDE] = ds.transpose(0, 2, 1) @ q
        dy[..., 2 * WIDE :] = s.transpose(0, 2, 1) @ back
        dy = dy.reshape(-1, 3 * WIDE)
        g["qkv"] = x.T @ dy
        dh += dy @ p["qkv"].T
        g["place"] = np.zeros_like(p["place"])
        g["place"][:t] = (np.ones(n, np.float32) @ dh.reshape(n, -1)).reshape(t, WIDE)
        order = np.argsort(at.astype(np.uint16), kind="stable")
        at = at[order]
        cut = np.append(0, np.flatnonzero(np.diff(at)) + 1)
        g["e"] = (at[cut], np.add.reduceat(dh[order], cut))
        return g, loss

    def train(self, windows: np.ndarray, epochs: int = 1, rate: float = 0.01, batch: int = 64, seed: int = 5) -> float:
        """Adagrad over windows (n, SPAN + 1) of ids, padded with -1."""
        r = np.random.default_rng(seed)
        if not hasattr(self, "sums"):
            self.sums = {k: np.full(x.shape, 1e-3, np.float32) for k, x in self.p.items()}
        loss = 0.0
        for _ in range(epochs):
            for some in _steps(r.permutation(len(windows)), batch):
                w = windows[some]
                real = w[:, 1:] >= 0
                w = np.maximum(w, 0)
                g, one = self.step(w[:, :-1], w[:, 1:], real)
                loss = 0.98 * loss + 0.02 * one if loss else one
                for k, d in g.items():
                    at, d = d if k == "e" else (slice(None), d)
                    self.sums[k][at] += d * d * (400 * len(some) / batch)
                    self.p[k][at] -= rate * 20 * d / np.sqrt(self.sums[k][at])
        return loss


def _steps(order: np.ndarray, batch: int):
    """Batches of a pass: of few windows first, then of ``batch``."""
    at = 0
    for size, upto in ((2, 64), (16, 1024), (batch, len(order))):
        while at < min(upto, len(order)):
            yield order[at : at + size]
            at += size


def score_ids(net: Attention, ids: np.ndarray, cuts: np.ndarray, batch: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Natural log probability of every id of rows ids[cuts[i]:cuts[i+1]], each row read after an end symbol, and of a word's beginning there."""
    out, begin = np.empty(len(ids), np.float32), np.empty(len(ids), np.float32)
    size = np.diff(cuts)
    live = np.flatnonzero(size)
    many = 1 + np.maximum(0, -(-(size[live] - SPAN) // HOP))
    row = np.repeat(live, many)
    number = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    start = cuts[:-1][row] + number * HOP  # the window predicts ids[start : start + SPAN]
    place = start[:, None] + np.arange(SPAN)
    real = place < cuts[1:][row][:, None]
    place = np.minimum(place, len(ids) - 1)
    before = ids[np.maximum(place - 1, 0)].astype(np.int64)
    before[number == 0, 0] = END
    target = ids[place].astype(np.int64)
    for some, skip in ((np.flatnonzero(number == 0), 0), (np.flatnonzero(number > 0), SPAN - HOP)):
        for i in range(0, len(some), batch):
            w = some[i : i + batch]
            found, start = net.log(before[w], target[w], skip)
            ok = real[w, skip:]
            to = place[w, skip:][ok]
            out[to], begin[to] = found[ok], start[ok]
    return out, begin


def word_logs(logs: np.ndarray, begin: np.ndarray, n: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Log probabilities of tokens of n ids each: rows are tokens first[i]:first[i+1], the last one an end."""
    if not len(n):
        return np.zeros(0)
    at = np.append(0, np.cumsum(n)[:-1])
    inner = np.add.reduceat(logs.astype(np.float64), at)
    opened = begin[at].astype(np.float64)
    closed = np.append(opened[1:], 0.0)
    closed[first[1:] - 1] = 0.0  # nothing follows an end
    return inner - opened + closed


def _with_ends(ids: np.ndarray, size: np.ndarray, words: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids with an end after each row, numbers of ids by token (an end is one), and each row's first token."""
    rows = np.diff(words.first)
    first = words.first + np.arange(len(words.first))
    n = np.ones(int(first[-1]), np.int64)
    inside = np.arange(len(size)) + np.repeat(np.arange(len(rows)), rows)
    n[inside] = size
    out = np.full(int(n.sum()), END, np.uint16)
    is_word = np.ones(len(n), bool)
    is_word[first[1:] - 1] = False
    out[np.repeat(is_word, n)] = ids
    return out, n, first


def windows_of(ids: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Consecutive windows of rows ids[cuts[i]:cuts[i+1]], and their number in each row: the id before SPAN ids, then these."""
    many = -(-np.diff(cuts) // SPAN)
    row = np.repeat(np.arange(len(many)), many)
    start = cuts[:-1][row] + (np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)) * SPAN
    place = start[:, None] + np.arange(-1, SPAN)
    out = np.where(place < cuts[1:][row][:, None], ids[np.clip(place, 0, max(0, len(ids) - 1))], NONE).astype(np.uint16)
    out[start == cuts[:-1][row], 0] = END
    return out, many


def _unpacked(windows: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(windows), np.uint16).reshape(-1, SPAN + 1).astype(np.int32)
    x[x == NONE] = -1
    return x


GATHERED = "kind int, key long, n long, ids binary"


def _gather(docs: DataFrame, path: str) -> DataFrame:
    """Counts of words (kind 0) and subwords (1) of each task, and the windows of each document (2)."""

    def run(batches):
        pieces, counts = pieces_of(path), np.zeros(END + 1, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            h, at = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
            return h, np.bincount(at, np.concatenate([x[1] for x in held])).astype(np.int64)

        def rows(kind, key, n, ids=None):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key), pa.array(n), pa.nulls(len(key), pa.binary()) if ids is None else ids], ["kind", "key", "n", "ids"])

        ends = 0
        for batch in batches:
            for part in W.slices(batch, 0, W.SLICE // 4):
                words = W.scan(part.column(0), W.SPACES, True)
                ids, size = pieces.sequence(words)
                ids, n, first = _with_ends(ids, size, words)
                counts += np.bincount(ids, minlength=END + 1)
                ends += part.num_rows
                held.append(np.unique(words.hash, return_counts=True))
                if sum(len(x[0]) for x in held) > 3 * MOST_WORDS // 2:
                    held[:] = [merged()]
                    if len(held[0][0]) > MOST_WORDS:
                        yield rows(0, held[0][0].view(np.int64), held[0][1])
                        held.clear()
                ids, many = windows_of(ids, np.append(0, np.cumsum(n))[first])
                # Chunks of a document's windows, keyed by document and place.
                chunks = -(-many // CHUNK)
                row = np.repeat(np.arange(len(many)), chunks)
                number = np.arange(len(row)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
                start = (np.cumsum(many) - many)[row] + number * CHUNK
                n = np.minimum(CHUNK, many[row] - number * CHUNK)
                h = part.column(1).to_numpy().astype(W.U)[row]
                keys = W._mix(h + number.astype(W.U) * W.U(0x9E3779B97F4A7C15)).view(np.int64)
                width = ids.itemsize * (SPAN + 1)
                at = pa.array((np.append(start, len(ids)) * width).astype(np.int32))
                yield rows(2, keys, n.astype(np.int64), pa.Array.from_buffers(pa.binary(), len(row), [None, at.buffers()[1], pa.py_buffer(ids.tobytes())]))
        if held:
            yield rows(0, *(lambda x: (x[0].view(np.int64), x[1]))(merged()))
        if ends:
            yield rows(0, np.array([END_KEY]), np.array([ends]))
        some = np.flatnonzero(counts)
        yield rows(1, some, counts[some])
        spare()

    return docs.select("text", F.pmod(F.xxhash64("text", "doc_id"), F.lit(1 << 40)).alias("h")).mapInArrow(run, GATHERED)


def fit(docs: DataFrame, path: str) -> tuple[Attention, DataFrame, int, int]:
    """The network, the word counts (key, n), all tokens and distinct tokens of the training documents."""
    found = materialize(_gather(docs, path))
    counts = materialize(found.where("kind = 0").groupBy("key").agg(F.sum("n").alias("n")))
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    pieces = np.zeros(END + 1)
    for k, n in found.where("kind = 1").groupBy("key").agg(F.sum("n")).collect():
        pieces[k] = n
    net = Attention(pieces, word_starts(path))
    net.sums = {k: np.full(x.shape, 1e-3, np.float32) for k, x in net.p.items()}
    windows = found.where("kind = 2").select("key", "n", "ids", F.pmod(F.shiftright("key", 8), F.lit(ROUNDS)).alias("round"))
    sizes = dict(windows.groupBy("round").agg(F.sum("n")).collect())
    for i in range(ROUNDS):
        if sizes.get(i):
            _round(net, windows.where(F.col("round") == i).select("key", "ids"), -(-sizes[i] // PER_TRAINER), i)
    release(found)
    return net, counts, total, distinct


def _round(net: Attention, windows: DataFrame, trainers: int, seed: int) -> None:
    """Train from the same weights on shares of the windows, and put in the means by numbers of windows."""
    shared = windows.sparkSession.sparkContext.broadcast(net)
    names = sorted(net.p)

    def run(batches):
        spare(pieces=True)
        own, done = shared.value, 0
        own.p, own.sums = {k: x.copy() for k, x in own.p.items()}, {k: x.copy() for k, x in own.sums.items()}
        for batch in batches:
            for part in W.slices(batch, 1):
                some = _unpacked(part.column(1).to_pylist())
                own.train(some, PASSES, seed=seed)
                done += len(some)
        flat = np.concatenate([d[k].reshape(-1) for d in (own.p, own.sums) for k in names])
        for i, x in enumerate(np.array_split(flat, BLOCKS) if done else ()):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() // 256], pa.int32()), pa.array([i], pa.int32()), pa.array([done], pa.int64()), pa.array([x.tobytes()], pa.binary())], ["part", "block", "n", "x"])

    def mean(group):
        group = group.sort_values(["n", "x"])  # sums of floats depend on their order
        x, n = np.zeros(len(group["x"].iloc[0]) // 4), group["n"].to_numpy(np.float64)
        for k, v in zip(n, group["x"], strict=True):
            x += k * np.frombuffer(v, np.float32)
        return group.head(1)[["block"]].assign(n=int(n.sum()), x=[(x / n.sum()).astype(np.float32).tobytes()])

    # Chunks come in the order of their keys: the same steps in every run. A batch of rows is trained on before the next.
    dealt = windows.repartition(trainers, "key").sortWithinPartitions("key", "ids")
    trained = materialize(dealt.mapInArrow(run, "part int, block int, n long, x binary"))
    # Means of at most 256 trainers, then of those.
    halves = trained.groupBy("part", "block").applyInPandas(mean, "block int, n long, x binary")
    blocks = sorted((r.block, r.x) for r in halves.groupBy("block").applyInPandas(mean, "block int, n long, x binary").collect())
    release(trained)
    flat, at = np.concatenate([np.frombuffer(x, np.float32) for _, x in blocks]), 0
    for to in (net.p, net.sums):
        for k in names:
            to[k] = flat[at : at + to[k].size].reshape(to[k].shape).copy()
            at += to[k].size


def _frequent(counts: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """The least count of the broadcast words, at most FREQUENT of them, with their counts."""
    steps = counts.groupBy(F.floor(F.log2("n") * 4).cast("int").alias("s")).agg(F.count("*").alias("words"), F.min("n").alias("least")).collect()
    least, have = 1 << 62, 0
    for _, words, low in sorted(steps, reverse=True):
        have += words
        if have > FREQUENT:
            break
        least = low
    rows = counts.where(F.col("n") >= least).toArrow()
    key, n = rows.column("key").to_numpy().astype(np.int64).view(W.U), rows.column("n").to_numpy().astype(np.int64)
    by = np.argsort(key)
    return least, key[by], n[by]


class Reader:
    """What tasks need to read words: the network, and the frequent words with their counts."""

    def __init__(self, net: Attention, keys: np.ndarray, ns: np.ndarray):
        self.net, self.keys, self.ns = net, keys, ns

    def parts(self, batches, path: str):
        """Slices of texts (column 1) with their tokens' hashes, network log probabilities, counts (0 if not frequent) and first tokens."""
        pieces, frequent = pieces_of(path), Numbers(len(self.keys))
        frequent.put(self.keys)
        ns = np.append(self.ns, 0)
        for batch in batches:
            for part in W.slices(batch, 1, W.SLICE // 4):
                words = W.scan(part.column(1), W.SPACES, True)
                ids, size = pieces.sequence(words)
                ids, n, first = _with_ends(ids, size, words)
                inner = word_logs(*score_ids(self.net, ids, np.append(0, np.cumsum(n))[first]), n, first)
                token, rows = np.full(len(n), END_KEY, W.U), np.diff(words.first)
                token[np.arange(len(words.hash)) + np.repeat(np.arange(len(rows)), rows)] = words.hash
                yield part, token, inner, ns[frequent.find(token)], first
        spare()


def best_weight(over: np.ndarray, n: np.ndarray, alone: int) -> float:
    """The share's weight w that maximises sum n * log(w + (1 - w) * over) + (alone + 1) * log(1 - w) + log(w)."""
    lo, hi = 0.0, 1.0
    for _ in range(60):
        w = (lo + hi) / 2
        rising = (n * (1 - over) / (w + (1 - w) * over)).sum() + 1 / w - (alone + 1) / (1 - w)
        lo, hi = (w, hi) if rising > 0 else (lo, w)
    return (lo + hi) / 2


READ = "uid long, doc_id long, held_out boolean, teaches boolean, n_tokens long, sure long, base double, words array<long>, logs array<float>, counts array<long>, inner array<float>, over array<int>, times array<long>"
SUMS = "uid long, doc_id long, held_out boolean, n_tokens long, sure long, base double, score double"


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """A list column's values and where its rows' values begin and end."""
    cuts = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy()[cuts[0] : cuts[-1]], cuts - cuts[0]


def _runs(batch: pa.RecordBatch, column: str):
    """Runs of rows with about PART_TOKENS values of a list column, at least one row each."""
    cuts, at = batch.column(column).offsets.to_numpy(), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(cuts, int(cuts[at]) + PART_TOKENS, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def over_shares(c: np.ndarray, log: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Network over deleted share of words that stand c times, in steps of logarithms, ALONE for c = 1: distinct ones and how often."""
    step = np.round(np.maximum(log.astype(float), -1000.0) * BINS_A_UNIT)
    over = np.round(step - np.log(np.maximum(c - 1, 1) / max(1, total - 1)) * BINS_A_UNIT)
    over, n = np.unique(np.where(c > 1, np.clip(over, -WIDEST, WIDEST), ALONE), return_counts=True)
    return over.astype(np.int32), n.astype(np.int64)


def _weight(read: DataFrame, tail: DataFrame, total: int) -> float:
    """The weight for the words of documents that teach it, each word's own occurrence deleted from the counts."""
    # Tasks have added up frequent words by step: at most some thousand rows a slice of texts, whatever the corpus.
    each = read.where(F.size("over") > 0).select(F.explode(F.arrays_zip("over", "times")).alias("x")).select(F.nullif(F.col("x.over"), F.lit(ALONE)).cast("double").alias("over"), F.col("x.times").alias("n"))
    step = F.rint(F.greatest("log", F.lit(-1000.0)) * BINS_A_UNIT)
    over = F.when(F.col("n") > 1, F.round(step - F.log((F.col("n") - 1) / max(1, total - 1)) * BINS_A_UNIT))
    over = F.when(over.isNotNull(), F.greatest(F.lit(-float(WIDEST)), F.least(F.lit(float(WIDEST)), over)))
    rare = tail.where("teaches and n is not null").select(over.alias("over"), F.lit(1).cast("long").alias("n"))
    rows = each.unionByName(rare).groupBy("over").agg(F.sum("n").alias("n")).collect()
    some = sorted((r.over, r.n) for r in rows if r.over is not None)
    return best_weight(np.exp(np.array([x for x, _ in some]) / BINS_A_UNIT), np.array([n for _, n in some], float), sum(r.n for r in rows if r.over is None))


def score_texts(docs: DataFrame, path: str, slice_of: int | None = SLICE_OF) -> DataFrame:
    """Per document: fold, tokens, base score, model score, and the weight of word shares in it.

    ``slice_of``: the remainder of the training documents that teach the weight; None: all of them do, as in the query.
    """
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(fold, F.lit(0)).alias("fold"))
    net, counts, total, distinct = fit(docs.where("fold <> 0"), path)
    least, keys, ns = _frequent(counts)
    reader = docs.sparkSession.sparkContext.broadcast(Reader(net, keys, ns))
    teaches = F.col("fold") != 0 if slice_of is None else F.col("fold") == slice_of

    def run(batches):
        uid = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        for part, token, inner, c, first in reader.value.parts(batches, path):
            cut, sure = first[:-1], c > 0
            inner = inner.astype(np.float32)
            base = np.where(sure, np.log10(c + 0.1), 0.0)
            # Frequent words go on with their counts, every other occurrence with its hash: its count comes from the join.
            at = [pa.array(np.append(0, np.cumsum(x))[first].astype(np.int32)) for x in (~sure, sure)]
            lists = [pa.ListArray.from_arrays(at[k], pa.array(x)) for k, x in ((0, token.view(np.int64)[~sure]), (0, inner[~sure]), (1, c[sure]), (1, inner[sure]))]
            sums = [pa.array(np.add.reduceat(x, cut)) for x in (sure.astype(np.int64), base)]
            # What the weight needs of frequent words stands in a slice's first row.
            taught = np.repeat(part.column(3).to_numpy(zero_copy_only=False), np.diff(first)) & sure
            over = over_shares(c[taught], inner[taught], total)
            at = pa.array(np.append(0, np.full(len(cut), len(over[0]))).astype(np.int32))
            lists += [pa.ListArray.from_arrays(at, pa.array(x)) for x in over]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(uid, uid + len(cut))), part.column(0), part.column(2), part.column(3), pa.array(np.diff(first)), *sums, *lists], [x.split()[0] for x in READ.split(", ")])
            uid += len(cut)

    # The network reads each text once: its word probabilities are kept, since the weight depends on all training text.
    read = materialize(docs.select("doc_id", "text", (F.col("fold") == 0).alias("held_out"), teaches.alias("teaches")).mapInArrow(run, READ))
    tail = read.select("uid", "teaches", F.explode(F.arrays_zip("words", "logs")).alias("w")).select("uid", "teaches", F.col("w.words").alias("key"), F.col("w.logs").cast("double").alias("log"))
    tail = materialize(tail.join(counts.where(F.col("n") < least), "key", "left").drop("key"))
    mix = _weight(read, tail, total) if total else 0.0

    def mixed(batches):
        for batch in batches:
            for part in _runs(batch, "counts"):
                (c, cuts), (inner, _) = (_flat(part.column(k)) for k in ("counts", "inner"))
                log = np.append(np.log10(np.maximum(mix * (c / max(1, total)) + (1 - mix) * np.exp(inner.astype(float)), 1e-300)), 0.0)
                sums = np.where(np.diff(cuts) > 0, np.add.reduceat(log, cuts[:-1]), 0.0)
                yield pa.RecordBatch.from_arrays([*part.columns[:6], pa.array(sums)], [x.split()[0] for x in SUMS.split(", ")])

    scored = read.drop("teaches", "words", "logs", "over", "times").mapInArrow(mixed, SUMS)
    p = F.coalesce("n", F.lit(0)) / max(1, total) * mix + F.exp("log") * (1 - mix)
    tail = tail.groupBy("uid").agg(F.count("n").alias("rare"), F.sum(F.log10(F.col("n") + 0.1)).alias("rare_base"), F.sum(F.log10(F.greatest(p, F.lit(1e-300)))).alias("rare_score"))
    out = scored.join(tail, "uid", "left").withColumn("n_known", F.col("sure") + F.coalesce("rare", F.lit(0)))
    unknown = (F.col("n_tokens") - F.col("n_known")) * float(np.log10(0.1))
    base = F.col("base") + F.coalesce("rare_base", F.lit(0.0)) + unknown - F.col("n_tokens") * float(np.log10(total + 0.1 * (distinct + 1)))
    score = F.col("score") + F.coalesce("rare_score", F.lit(0.0))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"), F.lit(mix).alias("share_weight"))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def query(spark, sf_dir: str) -> DataFrame:
    from tracelake.llm._io import table

    return score_texts(table(spark, sf_dir, "documents"), default_path(), slice_of=None)
