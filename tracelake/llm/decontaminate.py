"""Benchmark decontamination: prefix-filtered set join of item windows with whole documents.

A window (``window`` consecutive words of an item, or all words of a shorter item) is contained in a
document only if all its words are, so one prefix token is necessary: its rarest word, by counts over
all documents. Documents are probed by these tokens alone; the token's place in the window gives the
only possible start (positional bound), the document's end the length bound, and survivors are
verified word by word and then byte by byte.

The benchmark is the stated query set: it is dealt into blocks of about ``block_bytes``, each of which
is indexed on the driver and broadcast; documents stream past a block without a shuffle of texts. One block is held at a
time: with several, what the documents met so far is written between them and the block before is destroyed.

Defined cases: null or empty texts have no words and no hits; items without words are ignored; items
with a null id are ignored; repeated rows give repeated results; null doc_ids are carried through;
extra columns are ignored; an empty benchmark contaminates nothing; no documents give an empty result; very long texts are
read whole, by slices of rows; a doc_id that is no integer is an error of the cast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm import _words as W
from tracelake.llm._io import materialize, release

COUNTS = "word long, n long"
STATE = "doc_id long, text string, spans array<long>, items array<string>, n_words long"
RESULT = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start: long, words: long>>, contaminated boolean"
CANDIDATES = 1 << 20


class Index:
    """Windows of one block of items by their rarest word."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.width = window
        words = W.scan(pa.array([t for _, t in items], pa.string()), W.MARKS, lower=True)
        self.words = words
        seen: dict[bytes, int] = {}
        self.items: list[set[str]] = []
        self.text: list[bytes] = []
        spans = []
        for i, (item, _) in enumerate(items):
            a, b = int(words.first[i]), int(words.first[i + 1])
            n = min(window, b - a)
            for s in range(a, b - n + 1) if n else ():
                text = b" ".join(words.data[x:y].tobytes() for x, y in zip(words.start[s : s + n], words.end[s : s + n], strict=True))
                k = seen.setdefault(text, len(self.text))
                if k == len(self.text):
                    self.text.append(text)
                    self.items.append(set())
                    spans.append((s, n))
                self.items[k].add(item)
        self.start = np.array([s for s, _ in spans], np.int64)
        self.length = np.array([n for _, n in spans], np.int64)
        self.vocabulary = np.unique(words.hash)

    def order(self, counts: dict[int, int]) -> Index:
        """Choose each window's prefix: its rarest word, the first of equals."""
        rare = np.array([counts.get(int(h), 0) for h in self.vocabulary], np.int64)
        h = self.words.hash
        place = np.minimum(self.start[:, None] + np.arange(self.width), max(0, len(h) - 1))
        self.hashes = h[place] if len(h) else np.zeros((0, self.width), W.U)
        n = rare[np.searchsorted(self.vocabulary, self.hashes)] if len(h) else self.hashes.astype(np.int64)
        n = np.where(np.arange(self.width) < self.length[:, None], n, np.iinfo(np.int64).max)
        self.offset = n.argmin(1) if len(n) else np.zeros(0, np.int64)
        key = self.hashes[np.arange(len(n)), self.offset]
        by = np.argsort(key, kind="stable")
        self.by, (self.keys, first) = by, np.unique(key[by], return_index=True)
        self.first = np.append(first, len(by))
        del self.words, self.vocabulary
        return self

    def find(self, words: W.Words) -> tuple[np.ndarray, np.ndarray]:
        """Starts (word numbers) and windows of all verified occurrences."""
        none = np.zeros(0, np.int64)
        if not len(self.keys) or not len(words.hash):
            return none, none
        at = np.searchsorted(self.keys, words.hash)
        at[at == len(self.keys)] = 0
        place = np.flatnonzero(self.keys[at] == words.hash)
        at = at[place]
        many = self.first[at + 1] - self.first[at]
        total = np.cumsum(many)
        starts, found, lo = [], [], 0
        while lo < len(place):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + CANDIDATES, "right")))
            m = many[lo:hi]
            k = np.repeat(self.first[at[lo:hi]] - np.cumsum(m) + m, m) + np.arange(m.sum())
            w, p = self.by[k], np.repeat(place[lo:hi], m)
            s, row = p - self.offset[w], np.searchsorted(words.first, p, "right") - 1
            ok = (s >= words.first[row]) & (s + self.length[w] <= words.first[row + 1])
            s, w = s[ok], w[ok]
            for j in range(self.width):
                inside = np.flatnonzero(j < self.length[w])
                same = np.ones(len(s), bool)
                same[inside] = words.hash[s[inside] + j] == self.hashes[w[inside], j]
                s, w = s[same], w[same]
            starts.append(s)
            found.append(w)
            lo = hi
        s, w = (np.concatenate(x) if x else none for x in (starts, found))
        exact = np.fromiter((b" ".join(words.data[x:y].tobytes() for x, y in zip(words.start[a : a + n], words.end[a : a + n], strict=True)) == self.text[k] for a, k, n in zip(s.tolist(), w.tolist(), self.length[w].tolist(), strict=True)), bool, len(s))
        return s[exact], w[exact]


def _blocks(bench: DataFrame, window: int, block_bytes: int):
    """Indexes of the blocks, one after the other, and whether it is the last."""
    rows = bench.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes) or 1
    for b in range(n):
        block = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        yield Index(sorted(map(tuple, block.collect())), window), b == n - 1


def _count(docs: DataFrame, vocabulary: np.ndarray) -> dict[int, int]:
    """How often each word of the benchmark stands in all documents."""
    if not len(vocabulary):
        return {}
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        known = shared.value
        n = np.zeros(len(known), np.int64)
        for batch in batches:
            for part in W.slices(batch, 0):
                h = W.scan(part.column(0), W.MARKS, lower=True).hash
                at = np.searchsorted(known, h)
                at[at == len(known)] = 0
                n += np.bincount(at[known[at] == h], minlength=len(known))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(known[some].view(np.int64)), pa.array(n[some])], ["word", "n"])

    rows = docs.select("text").mapInArrow(run, COUNTS).groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {int(np.int64(w).view(W.U)): n for w, n in rows}


def _probe(df: DataFrame, shared, first: bool, last: bool) -> DataFrame:
    def run(batches):
        index = shared.value
        for batch in batches:
            for part in W.slices(batch, 1):
                words = W.scan(part.column(1), W.MARKS, lower=True)
                s, w = index.find(words)
                row = np.searchsorted(words.first, s, "right") - 1
                n = part.num_rows
                spans: list[list[int]] = [[] for _ in range(n)] if first else part.column(2).to_pylist()
                items: list = [set() for _ in range(n)] if first else [set(x) for x in part.column(3).to_pylist()]
                for r, a, k in zip(row.tolist(), (s - words.first[row]).tolist(), w.tolist(), strict=True):
                    spans[r] += (a, a + int(index.length[k]))
                    items[r] |= index.items[k]
                many = np.diff(words.first)
                if not last:
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(spans, pa.list_(pa.int64())), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(many)], ["doc_id", "text", "spans", "items", "n_words"])
                    continue
                merged = [_merge(x) for x in spans]
                hit = np.array([sum(b - a for a, b in x) for x in merged], np.int64)
                kind = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(many), pa.array(hit), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array([[{"start": a, "words": b - a} for a, b in x] for x in merged], kind), pa.array(hit > 0)], ["doc_id", "n_words", "n_hit", "items", "spans", "contaminated"])

    return df.mapInArrow(run, RESULT if last else STATE)


def _merge(flat: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(flat[::2], flat[1::2], strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _past(docs: DataFrame, df: DataFrame, bench: DataFrame, window: int, block_bytes: int, step) -> DataFrame:
    """``df`` after each block; all but the last are written, so that no two blocks are held at once."""
    first, before = True, None
    for index, last in _blocks(bench, window, block_bytes):
        index.order(_count(docs, index.vocabulary))
        shared = docs.sparkSession.sparkContext.broadcast(index)
        df = step(df, shared, first, last)
        if not last:
            df = materialize(df)
            shared.destroy()
            if before is not None:
                release(before)
            before = df
        first = False
    return df


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = 10, block_bytes: int = 4 << 20) -> DataFrame:
    """Per document: words, hit words, the items with occurring windows, the hit word spans."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _past(docs, df, bench, window, block_bytes, _probe)


def keep_clean(docs: DataFrame, bench: DataFrame, window: int = 10, block_bytes: int = 4 << 20) -> DataFrame:
    """The rows of ``docs``, all columns, without any occurrence of an item's window."""
    text = docs.columns.index("text")
    return _past(docs, docs, bench, window, block_bytes, lambda df, shared, first, last: _drop(df, shared, text))


def _drop(df: DataFrame, shared, text: int) -> DataFrame:
    def run(batches):
        index = shared.value
        for batch in batches:
            for part in W.slices(batch, text):
                words = W.scan(part.column(text), W.MARKS, lower=True)
                keep = np.ones(part.num_rows, bool)
                keep[np.searchsorted(words.first, index.find(words)[0], "right") - 1] = False
                yield part.filter(pa.array(keep))

    return df.mapInArrow(run, df.schema)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), "contaminated")


def query(spark, sf_dir: str) -> DataFrame:
    from tracelake.llm._io import table

    return digest(decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""
