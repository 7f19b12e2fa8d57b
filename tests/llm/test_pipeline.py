"""The pipeline's stages against plain Python on the smallest tables."""

import re

D = "/root/testdata/sf0.001"


def test_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns = docs.columns
    text = {r.doc_id: r.text for r in docs.collect()}
    good = p.quality_classifier(spark, docs, D)
    assert good.columns == columns and good.count() > 0.7 * len(text)

    one = {r.doc_id for r in p.exact_dedup(spark, docs.unionByName(docs.limit(3)), D).collect()}
    largest = {}
    for i, t in text.items():
        largest[t] = max(i, largest.get(t, i))
    assert one == set(largest.values())

    near = {r.doc_id for r in p.minhash_near_dedup(spark, docs, D).collect()}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in text.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(lower))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in text}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in text:
        for j in text:
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    assert near == {i for i in text if find(i) == i}

    words = lambda t: " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(lower))) + " "
    grams = set()
    for r in spark.read.parquet(f"{D}/benchmark.parquet").collect():
        w = words(r.text).split()
        grams |= {" " + " ".join(w[j : j + 10]) + " " for j in range(max(1, len(w) - 9))}
    clean = {i for i, t in text.items() if not any(g in words(t) for g in grams)}
    assert {r.doc_id for r in p.benchmark_decontamination(spark, docs, D).collect()} == clean
    assert p.bpe_tokens(spark, docs, D).count() == len(text)
    assert p.run(spark, D).count() > 0
