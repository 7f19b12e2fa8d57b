"""Corpus pipeline: quality, exact and near duplicates, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns
of documents. Decisions: documents that the classifier rejects go; of equal texts the largest doc_id stays; of near
copies (five-word shingles, similarity 0.8) the smallest; documents with a benchmark passage go.

Defined cases, at every stage: a null text counts as empty (it stays if the classifier keeps empty texts; equal to other
empty ones, near to none, free of passages, without tokens); a null doc_id takes part, and of equal texts stays only where
no row has an id; repeated rows of a kept document become one in the exact stage; very long texts are read whole; an empty
table stays empty, with the same columns; extra columns go through untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import bpe, decontaminate, exact, neardup, quality
from tracelake.llm._io import materialize, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key, sha = F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.sha2(F.coalesce("text", F.lit("")), 256)
    kept = exact.exact_groups(docs).where("kept").select(F.col("text_sha256").alias("sha"), key.alias("key"))
    # One exchange serves the join and the repeated rows of a kept document; copies are spread by their ids. Rows travel
    # as one column, so that no name of theirs can clash.
    rows = docs.select(F.struct("*").alias("row"), sha.alias("sha"), key.alias("key"))
    return rows.join(kept, ["sha", "key"], "left_semi").dropDuplicates(["sha", "key"]).select("row.*")


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = neardup.near_groups(docs)
    kept = found.where("kept").select(F.col("row").alias("hash"), F.col("doc_id").alias("id")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64("text").alias("hash"), F.col("doc_id").cast("long").alias("id"))
    return rows.join(kept, (rows["hash"] == kept["hash"]) & rows["id"].eqNullSafe(kept["id"]), "left_semi").select("row.*")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_corpus(docs, bpe.default_path())


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("MinHash near-dedup", minhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("BPE encoding and decoding", bpe_tokens),
]

#: The classifier and the tokens have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
