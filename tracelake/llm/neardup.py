"""MinHash near-dedup of documents with sequential Bayesian verification.

A document's set is its distinct ``shingle``-word shingles. Equal sets are one item; items get ``bands`` of
``rows`` MinHash values, candidates of shared bands are compared in batches of their signatures and dropped
once the posterior probability of reaching the threshold is below ``miss``; survivors are verified on their
full sets. At the threshold of 0.8, 32 bands of 4 rows miss a pair with probability 5e-8.

Defined cases: a text without words is an item of its own, linked with nothing; a text with fewer words than a
shingle has its whole sequence as one; rows with a null doc_id take part, and the smallest doc_id that is not null
names the component (null if there is none); repeated rows share a set; an empty table gives an empty result; very long
texts are one set each; extra columns are ignored; a doc_id that is no integer is an error of the cast.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm import _words as W
from tracelake.llm._io import join_checked, materialize
from tracelake.llm._linkage import BLOBS, PART_ROWS, band_keys, minhash, near_components, packed

ITEMS = "doc_id long, row long, n_shingles long, id long, bands array<long>"


def shingle_set(h: np.ndarray, k: int) -> np.ndarray:
    """Distinct shingles of a document's word hashes, sorted."""
    if not len(h):
        return h
    return np.unique(W.grams(h, min(k, len(h))))


def set_id(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _items(docs: DataFrame, lower: bool, k: int, bands: int, rows: int) -> DataFrame:
    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for part in W.slices(batch):
                words = _scan(part.column(1), lower)
                size, ids, keys, have = [], [], [], []
                for i in range(part.num_rows):
                    s = shingle_set(words.hash[words.first[i] : words.first[i + 1]], k)
                    size.append(len(s))
                    one = set_id(s.tobytes()) if len(s) else None
                    ids.append(one)
                    new = one is not None and one not in seen
                    have.append(new)
                    if new:
                        seen.add(one)
                        keys.append(band_keys(minhash(s, bands * rows), rows))
                if len(seen) > 1_000_000:
                    seen.clear()
                ends = np.append(0, np.cumsum(np.array(have, np.int32) * bands)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(size, pa.int64()), pa.array(ids, pa.int64()), lists], ["doc_id", "row", "n_shingles", "id", "bands"])

    return docs.mapInArrow(run, ITEMS)


def _blobs(items: DataFrame, bands: int, parts: int) -> DataFrame:
    def run(batches):
        rows = ((b.column(0).to_numpy(), b.column(1).flatten().to_numpy().reshape(-1, bands)) for b in batches)
        yield from packed(rows, parts)

    return items.select("id", "bands").mapInArrow(run, BLOBS)


def _scan(column: pa.Array, lower: bool) -> W.Words:
    return W.scan(column, W.SPACES, lower)


def _sets(docs: DataFrame, wanted: DataFrame, lower: bool, k: int) -> DataFrame:
    """wanted: row, id; the set of one document of each id."""

    def run(batches):
        for batch in batches:
            for part in W.slices(batch):
                words = _scan(part.column(1), lower)
                sets = [shingle_set(words.hash[words.first[i] : words.first[i + 1]], k).tobytes() for i in range(part.num_rows)]
                ok = [set_id(s) == one for s, one in zip(sets, part.column(0).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["id", "set"]).filter(pa.array(ok))

    return join_checked(docs.select("text", "row"), wanted, "row").select("id", "text").mapInArrow(run, "id long, set binary").dropDuplicates(["id"])


def near_groups(docs: DataFrame, shingle: int = 5, percent: int = 80, lower: bool = True, bands: int = 32, rows: int = 4, miss: float = 1e-8) -> DataFrame:
    """Per document: row key (hash of its text), size of its set, component and whether it stays."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", F.xxhash64("text"))
    found = materialize(_items(docs, lower, shingle, bands, rows))
    items = found.where("size(bands) > 0").select("id", "bands")
    source = found.where("id is not null").groupBy("id").agg(F.min("row").alias("row"))

    def sets_of(ids: DataFrame) -> DataFrame:
        wanted = materialize(source.join(ids, "id").select("row", "id"))
        return _sets(docs, wanted, lower, shingle)

    parts = max(1, items.count() * bands // PART_ROWS)
    roots = near_components(_blobs(items, bands, parts), sets_of, percent, bands, rows, miss)
    least = found.where("id is not null").groupBy("id").agg(F.min("doc_id").alias("least")).join(roots, "id", "left").select("id", "least", F.coalesce("root", "id").alias("root"))
    least = materialize(least)
    named = materialize(least.select("id", "root").join(materialize(least.groupBy("root").agg(F.min("least").alias("component"))), "root").select("id", "component"))
    out = found.select("doc_id", "row", "n_shingles", "id").join(named, "id", "left")
    component = F.when(F.col("id").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "row", "n_shingles", component.alias("component_id")).withColumn("kept", F.expr("doc_id <=> component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    from tracelake.llm._io import table

    return near_groups(table(spark, sf_dir, "documents"), shingle=2).drop("row")


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 1), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_n FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM x JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * both_n >= 80 * (p.n + q.n - both_n)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS id, doc_id AS c FROM d UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id),
c AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.c AS component_id, c.c = d.doc_id AS kept FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.id = d.doc_id
"""
