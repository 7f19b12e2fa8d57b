"""Windows over large groups stay linear, and keep their results."""

import random
import time

from pyspark.sql import functions as F

from tracelake.functions import scalars
from tracelake.operators import images, tables


def test_bh_fdr_of_one_large_group(spark):
    n = 200_000
    df = spark.range(n).select("id", (F.pmod(F.col("id") * 7919, F.lit(n)) / n).alias("p"))
    at = time.time()
    assert tables.bh_fdr(df, "p").agg(F.max("q")).first()[0] <= 1
    assert time.time() - at < 30


def test_bh_fdr_against_plain_python(spark):
    r = random.Random(2)
    p = [(i, r.choice([0.0, 0.01, 0.02, 0.5, r.random()])) for i in range(200)]
    order, q, least = sorted(p, key=lambda x: (x[1], x[0])), {}, 1.0
    for rank in range(len(order), 0, -1):
        i, x = order[rank - 1]
        least = min(least, x * len(order) / rank)
        q[i] = least
    got = {x.id: x.q for x in tables.bh_fdr(spark.createDataFrame(p, "id long, p double"), "p").collect()}
    assert all(abs(got[i] - q[i]) < 1e-12 for i in q)


def test_fill_missing_of_one_long_unit(spark):
    n = 200_000
    df = spark.range(n).select(F.lit(1).alias("unit"), F.col("id").alias("frame"), F.when((F.col("id") % 1000 == 0) & (F.col("id") < n // 2), F.col("id").cast("double")).alias("v"))
    at = time.time()
    last = tables.fill_missing(df, ["unit"], "frame", "v").where("frame in (500, 199999)").orderBy("frame").collect()
    assert [x.filled for x in last] == [500.0, 99000.0]
    assert time.time() - at < 30


def test_auroc_does_not_depend_on_cells(spark):
    r = random.Random(1)
    rows = [(r.randint(0, 1), r.choice([0.5, -3.25, r.random()])) for _ in range(300)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    for grain in (0.1, 7.0, 4096.0):
        assert abs(tables.auroc(spark.createDataFrame(rows, "y int, s double"), "y", "s", grain).first()[0] - want) < 1e-12


def test_preview_is_scaled_by_recording(spark):
    px = spark.createDataFrame([(rec, 0, 0, x, v) for rec, scale in (("a", 1), ("b", 1000)) for x, v in enumerate(range(0, 100 * scale, scale))], "rec_id string, frame int, y int, x int, v int")
    got = images.preview(px, 1, keys=("rec_id",)).groupBy("rec_id").agg(F.sum("grey").alias("s"), F.max("grey").alias("m")).collect()
    assert len({x.s for x in got}) == 1 and {x.m for x in got} == {255}


def test_messages_of_memory_running_out(spark):
    texts = ["std::bad_alloc", "Cannot allocate memory", "CUDA_ERROR_OUT_OF_MEMORY", "cudaErrorMemoryAllocation", "CUBLAS_STATUS_ALLOC_FAILED", "MemoryError", "disk full", None]
    df = spark.createDataFrame([(t,) for t in texts], "m string")
    assert [x[0] for x in df.select(scalars.out_of_memory("m")).collect()] == [True] * 6 + [False] * 2
