"""Substring dedup by relative Lempel-Ziv parsing over words.

Reference blocks are the documents themselves, each serving the documents with larger ids. The index of
reference positions is restricted to where a factor can exist at all: every window of ``window`` words
has one minimizer among its ``seed``-word grams, and only windows whose minimizer stands in two documents
are indexed. The index keeps, for every window, the smallest document that holds it and the first place there.

A document is parsed greedily against it. A factor starts at the first word whose window is indexed and is extended in the
document that the index names there, word by word, as long as that document goes on with the same words. Where
it ends, the parse looks the next window up again, so that windows that straddle the end of a factor are checked and
factors may overlap there. Factors (start, words, doc, place) have at least ``window`` words, hold in their
reference from end to end, and are the duplicate spans.

Consecutive hits on one diagonal (same document, same distance of places) are one segment and need no look at the
reference; behind a segment that meets another one, the reference's window hashes are fetched, at most REACH of them: longer
factors are cut into several that touch. Windows are compared by 64-bit hashes of their word sequences.
Documents with the same word sequence are collapsed first: all but the smallest id are one factor.

Defined cases: null texts have no words; texts with fewer than ``window`` words lose nothing; a null doc_id is
neither a reference nor parsed; rows that share a doc_id do not serve each other, repeated rows have equal results; an
empty table gives an empty result; very long texts are parsed whole; extra columns are ignored; a doc_id that is no
integer is an error of the cast.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelake.llm import _words as W
from tracelake.llm._io import materialize, release

SEEDS = "doc_id long, row long, whole long, seed array<long>"
WINDOWS = "doc_id long, row long, hash array<long>, place array<int>"
ASKED = "doc_id long, row long, o_doc long, o_row long, lo int, n int"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, spans array<struct<start: long, words: long, doc: long, place: long>>"
REACH = 4096


def _minimizers(h: np.ndarray, window: int, seed: int) -> np.ndarray:
    return W.sliding_min(W.grams(h, seed), window - seed + 1)


def _rows(batches, text: int):
    for batch in batches:
        for part in W.slices(batch, text):
            yield part, W.scan(part.column(text), W.SPACES)


def _seeds(docs: DataFrame, window: int, seed: int) -> DataFrame:
    def run(batches):
        for part, words in _rows(batches, 1):
            some, whole, found = [], [], []
            for i in range(part.num_rows):
                h = words.hash[words.first[i] : words.first[i + 1]]
                if len(h) >= window:
                    some.append(i)
                    whole.append(int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=8).digest(), "little", signed=True))
                    found.append(np.unique(_minimizers(h, window, seed)).view(np.int64))
            some = pa.array(some, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0).take(some), part.column(2).take(some), pa.array(whole, pa.int64()), _lists(found, np.int64)], ["doc_id", "row", "whole", "seed"])

    return docs.where("doc_id is not null").mapInArrow(run, SEEDS)


def _lists(arrays: list[np.ndarray], kind) -> pa.Array:
    ends = np.cumsum([0] + [len(a) for a in arrays]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, kind)))


def _windows(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """docs: doc_id, text, row, and the shared seeds of each document."""

    def run(batches):
        for part, words in _rows(batches, 1):
            some, hashes, places = [], [], []
            for i, shared in enumerate(part.column(3)):
                h = words.hash[words.first[i] : words.first[i + 1]]
                known = np.sort(np.asarray(shared.values).view(W.U))
                m = _minimizers(h, window, seed)
                at = np.searchsorted(known, m)
                at[at == len(known)] = 0
                place = np.flatnonzero(known[at] == m)
                if len(place):
                    some.append(i)
                    hashes.append(W.grams(h, window)[place].view(np.int64))
                    places.append(place.astype(np.int32))
            some = pa.array(some, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0).take(some), part.column(2).take(some), _lists(hashes, np.int64), _lists(places, np.int32)], ["doc_id", "row", "hash", "place"])

    return docs.mapInArrow(run, WINDOWS)


def segments(hits: DataFrame, key: list[str]) -> DataFrame:
    """Hits (place, o_doc, o_row, o_place) on one diagonal at consecutive places: per document, sorted (start, last, o_doc, o_row, o_place)."""
    line = ["o_doc", "o_row", "diagonal"]
    hits = hits.withColumn("diagonal", F.col("o_place") - F.col("place"))
    hits = hits.withColumn("run", F.col("place") - F.row_number().over(Window.partitionBy(*key, *line).orderBy("place")))
    found = hits.groupBy(*key, *line, "run").agg(F.min("place").alias("start"), F.max("place").alias("last"))
    one = F.struct("start", "last", "o_doc", "o_row", (F.col("start") + F.col("diagonal")).alias("o_place"))
    return found.groupBy(*key).agg(F.sort_array(F.collect_list(one)).alias("segments"))


def _asked(parsed: DataFrame) -> DataFrame:
    """Places of references that the parse may have to read behind segments that meet another one."""

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for doc, row, some in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                wanted: dict[tuple[int, int], list[tuple[int, int]]] = {}
                end = len(some)
                ends = [0] * end
                for i in range(end - 1, -1, -1):  # where the run of hits ends
                    meets = i + 1 < end and some[i + 1]["start"] == some[i]["last"] + 1
                    ends[i] = ends[i + 1] if meets else some[i]["last"]
                for x, last in zip(some, ends, strict=True):
                    if last > x["last"]:
                        lo = x["o_place"] + x["last"] - x["start"] + 1
                        wanted.setdefault((x["o_doc"], x["o_row"]), []).append((lo, lo + min(REACH, last - x["last"])))
                for (o_doc, o_row), spans in wanted.items():
                    spans.sort()
                    lo, hi = spans[0]
                    for a, b in [*spans[1:], (1 << 31, 1 << 31)]:
                        if a > hi:
                            out.append((doc, row, o_doc, o_row, lo, hi - lo))
                            lo, hi = a, b
                        hi = max(hi, b)
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, [pa.int64()] * 4 + [pa.int32()] * 2, strict=True)], ["doc_id", "row", "o_doc", "o_row", "lo", "n"])

    return parsed.select("doc_id", "row", "segments").mapInArrow(run, ASKED)


def _answers(asked: DataFrame, windows: DataFrame) -> DataFrame:
    """Per document, the window hashes of its references from the asked places on."""
    source = windows.select(F.col("doc_id").alias("o_doc"), F.col("row").alias("o_row"), F.col("hash"), F.col("place")).dropDuplicates(["o_doc", "o_row"])
    found = asked.join(source, ["o_doc", "o_row"]).withColumn("at", F.expr("cast(array_position(place, lo) as int)")).where("at > 0")
    cut = F.struct("o_doc", "o_row", "lo", F.expr("slice(place, at, n)").alias("place"), F.expr("slice(hash, at, n)").alias("hash"))
    return found.groupBy("doc_id", "row").agg(F.collect_list(cut).alias("answers"))


def parse(segments: list[dict], hashes: np.ndarray, answers: list[dict], window: int) -> list[tuple[int, int, int, int]]:
    """Greedy factors (start, words, doc, place). ``hashes`` are those of the document's windows."""
    known: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
    for x in answers:
        place = np.asarray(x["place"])
        whole = place == x["lo"] + np.arange(len(place))  # the reference's places, as far as they are consecutive
        n = len(place) if whole.all() else int(whole.argmin())
        known.setdefault((x["o_doc"], x["o_row"]), []).append((x["lo"], np.asarray(x["hash"], np.int64)[:n].view(W.U)))
    out, at = [], 0
    for i, x in enumerate(segments):
        if x["last"] < at:
            continue
        start, last = max(at, x["start"]), x["last"]
        if i + 1 < len(segments) and segments[i + 1]["start"] == last + 1:
            place = x["o_place"] + last - x["start"] + 1
            for lo, theirs in known.get((x["o_doc"], x["o_row"]), ()):
                if lo <= place < lo + len(theirs):
                    own = hashes[last + 1 : last + 1 + REACH]
                    theirs = theirs[place - lo :][: len(own)]
                    same = own[: len(theirs)] == theirs
                    last += len(same) if same.all() else int(same.argmin())
                    break
        out.append((start, last - start + window, x["o_doc"], x["o_place"] + start - x["start"]))
        at = last + 1
    return out


def _cut(docs: DataFrame, window: int, with_text: bool) -> DataFrame:
    """docs: doc_id, text, whole document (smaller id with the same words), its segments and answers."""

    def run(batches):
        for part, words in _rows(batches, 1):
            out: list[list] = [[] for _ in range(6)]
            for i, (doc, same, hits, answers) in enumerate(zip(part.column(0).to_pylist(), *(part.column(j).to_pylist() for j in (2, 3, 4)), strict=True)):
                a, b = int(words.first[i]), int(words.first[i + 1])
                n = b - a
                if same is not None and n >= window:
                    factors = [(0, n, same, 0)]
                elif hits is not None:
                    factors = parse(hits, W.grams(words.hash[a:b], window), answers or [], window)
                else:
                    factors = []
                keep = np.ones(n, bool)
                for s, k, *_ in factors:
                    keep[s : s + k] = False
                kept = _text(words, a, b, keep)
                for to, x in zip(out, (doc, n, n - int(keep.sum()), hashlib.sha256(kept).hexdigest(), kept if with_text else None, [{"start": s, "words": k, "doc": d, "place": p} for s, k, d, p in factors]), strict=True):
                    to.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "words", "doc", "place")])))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "spans"])

    return docs.mapInArrow(run, RESULT)


def _text(words: W.Words, a: int, b: int, keep: np.ndarray) -> bytes:
    """Kept words joined by one space: their bytes, each with one separator after it."""
    s, e = words.start[a:b][keep], words.end[a:b][keep]
    if not len(s):
        return b""
    lo, hi = int(s[0]), int(e[-1])
    mark = np.zeros(hi - lo + 2, np.int8)
    mark[s - lo] += 1
    mark[e - lo + 1] -= 1
    body = np.append(words.data[lo:hi], np.uint8(32))[np.flatnonzero(np.cumsum(mark[:-1], dtype=np.int8))].copy()
    body[np.cumsum(e - s + 1) - 1] = 32
    return body[:-1].tobytes()


def remove_repeats(docs: DataFrame, window: int = 50, seed: int = 10, with_text: bool = True) -> DataFrame:
    """Per document: words, removed words, the kept text and the duplicate spans with their reference."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("row"))
    key = ["doc_id", "row"]
    seeds = materialize(_seeds(docs, window, seed))
    # Equal word sequences: the smallest id represents them.
    same = seeds.groupBy("whole").agg(F.min("doc_id").alias("same"), F.max("doc_id").alias("most")).where("same < most").select("whole", "same")
    same = materialize(same)  # joins of plain exchanges: Spark splits a hot key's rows
    marked = materialize(seeds.join(same, "whole", "left").select(*key, "seed", F.expr("if(same < doc_id, same, null)").alias("same")))
    copies = marked.where("same is not null").select(*key, "same").distinct()
    owners = marked.where("same is null").select(*key, F.explode("seed").alias("seed"))
    shared = owners.groupBy("seed").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("seed")
    shared = materialize(shared)
    wanted = owners.join(shared, "seed").groupBy(*key).agg(F.collect_set("seed").alias("seed"))
    windows = materialize(_windows(docs.join(wanted, key).select("doc_id", "text", "row", "seed"), window, seed))
    each = windows.select(*key, F.explode(F.arrays_zip("hash", "place")).alias("w")).select(*key, F.col("w.hash").alias("hash"), F.col("w.place").alias("place"))
    index = each.groupBy("hash").agg(F.min(F.struct("doc_id", "row", "place")).alias("o"), F.max("doc_id").alias("most")).where("o.doc_id < most")
    index = materialize(index.select("hash", F.col("o.doc_id").alias("o_doc"), F.col("o.row").alias("o_row"), F.col("o.place").alias("o_place")))
    hits = each.distinct().join(index, "hash").where("o_doc < doc_id").drop("hash")
    parsed = materialize(segments(hits, key))
    answers = _answers(_asked(parsed), windows)
    release(seeds, same, shared, index)
    rows = docs.join(copies, key, "left").join(parsed, key, "left").join(answers, key, "left")
    return _cut(rows.select("doc_id", "text", "same", "segments", "answers"), window, with_text)


def query(spark, sf_dir: str) -> DataFrame:
    from tracelake.llm._io import table

    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
o AS (SELECT h, min(doc_id) AS owner FROM g GROUP BY h),
p AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM g JOIN o ON g.h = o.h WHERE owner < doc_id),
r AS (SELECT doc_id, count(*) AS n, list(p) AS ps FROM p GROUP BY doc_id),
k AS (SELECT t.doc_id, string_agg(t.x, ' ' ORDER BY t.i) AS kept FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d) t LEFT JOIN p ON p.doc_id = t.doc_id AND p.p = t.i WHERE p.p IS NULL GROUP BY t.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(r.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r ON r.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id
"""
