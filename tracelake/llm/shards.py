"""Sharding by proportional stratified interleaving, with DataFrame operations only.

Rows of each source are put in a seeded random order (``rank``): by a hash of their text's checksum, then of their doc_id, so
that equal texts of a source are neighbours. A row's place in the whole is its fractional rank (rank + a seeded shift of
the source) / rows of the source, and equal cuts of that order are the shards. Each shard then holds every source's
share within one row, shards differ by one row at most, and equal texts of a source share a shard but where a cut parts them.

Ranks are counts of the rows before, without bringing a source, a group of copies or the whole into one task. Rows equal in
all that counts are one row with a number until they are placed. Texts are dealt into buckets of about ``bucket_rows`` by a
prefix of their hash, and a text's start is the sum of the buckets before plus that of its bucket; a text with more copies
than a bucket is dealt once more by its rows' own hashes. The fraction's order is cut into cells in the same way.

Law: ``rows``. Defined cases: a null text has size 1 and checksum 0; a null source counts as ''; null doc_ids hash as an
empty text; very long texts are read for size and checksum alone; a doc_id that is no integer is an error of the cast;
repeated rows are separate rows next to each other in their source's order; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelake.llm._io import join_checked, materialize, release

GROUP = 1024


def _before(counts: DataFrame, order: str) -> DataFrame:
    """Adds the rows in buckets before; sums inside groups of GROUP buckets and over groups."""
    counts = counts.withColumn("part", (F.col(order) / GROUP).cast("long"))
    parts = counts.groupBy("part").agg(F.sum("n").alias("part_n"))
    parts = parts.select("part", (F.sum("part_n").over(Window.orderBy("part")) - F.col("part_n")).alias("part_before"))
    own = F.sum("n").over(Window.partitionBy("part").orderBy(order)) - F.col("n")
    return counts.withColumn("own", own).join(parts, "part").select(order, (F.col("own") + F.col("part_before")).alias("before"))


def _cut(h: str, parts) -> Column:
    """Which of ``parts`` equal stretches of hashes a hex hash lies in."""
    return F.floor(F.conv(F.substring(h, 1, 8), 16, 10).cast("long") * parts / F.lit(4294967296)).cast("long")


def interleave(docs: DataFrame, shards: int = 8, seed: int = 42, bucket_rows: int = 1000) -> DataFrame:
    """Per row: size, checksum, shard and slot."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    hashed = lambda c: F.md5(F.concat(F.lit(f"{seed}:"), c).cast("binary"))
    own = ["source", "doc_id", "size", "text_crc32"]
    kept = materialize(rows.groupBy(*own).agg(F.count("*").alias("m")))
    n = kept.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    buckets = max(1, min(1 << 20, -(-n // bucket_rows)))
    rows = kept.withColumns({"ht": hashed(F.col("text_crc32").cast("string")), "hd": hashed(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))})

    # Where each text of a source starts.
    starts = materialize(rows.groupBy("source", "ht").agg(F.sum("m").alias("copies")).withColumn("bucket", _cut("ht", buckets)))
    counts = starts.groupBy("source", "bucket").agg(F.sum("copies").alias("n"))
    source = Window.partitionBy("source")
    counts = materialize(counts.select("source", "bucket", (F.sum("n").over(source.orderBy("bucket")) - F.col("n")).alias("before"), F.sum("n").over(source).alias("of")))
    inside = F.sum("copies").over(Window.partitionBy("source", "bucket").orderBy("ht")) - F.col("copies")
    texts = starts.withColumn("inside", inside).join(counts, ["source", "bucket"]).select("source", "ht", "copies", (F.col("before") + F.col("inside")).alias("start"), "of")

    # Where each row stands in its text; texts of many copies by parts.
    stands = materialize(rows.join(texts, ["source", "ht"]).withColumn("part", _cut("hd", F.ceil(F.col("copies") / bucket_rows))))
    parts = stands.where(F.col("copies") > bucket_rows).groupBy("source", "ht", "part").agg(F.sum("m").alias("n"))
    parts = parts.select("source", "ht", "part", (F.sum("n").over(Window.partitionBy("source", "ht").orderBy("part")) - F.col("n")).alias("ahead"))
    place = F.sum("m").over(Window.partitionBy("source", "ht", "part").orderBy("hd", "doc_id", "size")) - F.col("m")
    placed = stands.withColumn("place", place).join(parts, ["source", "ht", "part"], "left")
    first = F.col("start") + F.coalesce("ahead", F.lit(0)) + F.col("place")
    shift = F.expr(f"cast(conv(substr(md5(cast(concat('{seed}:', source) as binary)), 1, 8), 16, 10) as double) / 4294967296D")
    each = placed.select(*own, "of", F.explode(F.sequence(first, first + F.col("m") - 1)).alias("rank"))
    ranked = materialize(each.select(*own, ((F.col("rank").cast("double") + shift) / F.col("of")).alias("fraction")))
    release(kept, starts, counts, stands)

    ranked = ranked.withColumn("cell", F.least(F.floor(F.col("fraction") * buckets), F.lit(buckets - 1)).cast("long"))
    cells = materialize(_before(ranked.groupBy("cell").agg(F.count("*").alias("n")), "cell"))
    within = F.row_number().over(Window.partitionBy("cell").orderBy("fraction", "source"))
    placed = join_checked(ranked.withColumn("within", within), cells, "cell").withColumn("at", F.col("before") + F.col("within") - 1)
    placed = placed.withColumn("shard", F.expr(f"at * {shards} div {max(n, 1)}"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.expr(f"at - (shard * {n} + {shards - 1}) div {shards}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "source",
    )


def query(spark, sf_dir: str) -> DataFrame:
    from tracelake.llm._io import table

    return interleave(table(spark, sf_dir, "documents"))


SQL = """
WITH crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) r(i))),
d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
e AS (SELECT doc_id, source, strlen(text) + 1 AS size, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, 2 * strlen(text)::BIGINT, 2), lambda i: ('0x' || substr(hex(encode(text)), i, 2))::BIGINT)), lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1])), 4294967295) AS crc FROM d, crc),
f AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY ht, hd, doc_id, size) - 1 + ('0x' || substr(md5('42:' || source), 1, 8))::BIGINT / 4294967296) / count(*) OVER (PARTITION BY source) AS fraction FROM (SELECT *, md5('42:' || crc) AS ht, md5('42:' || coalesce(doc_id::VARCHAR, '')) AS hd FROM e)),
g AS (SELECT *, row_number() OVER (ORDER BY fraction, source) - 1 AS pos, count(*) OVER () AS n FROM f)
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, (pos * 8 // n)::INTEGER AS shard, pos - ((pos * 8 // n) * n + 7) // 8 AS slot, NULL::INTEGER AS grown_shard, source FROM g
"""
