"""The quality network against plain loops and differences, and order of copies in shards."""

import numpy as np
import pytest

from tracelake.llm import quality, shards


def plain_score(p, text: bytes) -> float:
    """The network by its definition, chunk by chunk, in loops."""
    starts = [0]
    while starts[-1] + quality.CHUNK < len(text):
        starts.append(starts[-1] + quality.STRIDE)
    features = []
    for s in starts:
        chunk = text[s : s + quality.CHUNK].ljust(quality.CHUNK, b"\0")
        z = np.array([[max(0.0, p["b0"][f] + sum(float(p["table"][j, chunk[i + j], f]) for j in range(quality.WIDTH))) for f in range(quality.FILTERS)] for i in range(quality.CHUNK - quality.WIDTH + 1)])
        u = np.concatenate([z.max(0), z.mean(0)])
        features.append(np.maximum(u @ p["w1"] + p["b1"], 0))
    v = np.concatenate([np.max(features, 0), np.mean(features, 0)])
    return float(1 / (1 + np.exp(-(v @ p["w2"] + p["b2"][0]))))


def network(seed=3):
    r = np.random.default_rng(seed)
    net = quality.Network(seed)
    for k in ("b0", "b1", "b2"):
        net.p[k] = (r.standard_normal(net.p[k].shape) * 0.2).astype(np.float32)
    net.trained = True
    return net, r


def joined(texts):
    return np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts]))


def test_forward_is_the_definition():
    net, r = network()
    texts = [b"", b"a", b"word " * 9, *(r.bytes(n) for n in (255, 256, 257, 480, 481, 900))]
    want = [plain_score(net.p, t) for t in texts]
    assert np.allclose(net.score(*joined(texts)), want, atol=1e-5)
    assert np.allclose([net.score(*joined([t]))[0] for t in texts], want, atol=1e-5)


def test_long_texts_are_scored_whole(monkeypatch):
    net, r = network()
    text = r.bytes((5 << 19) + 77)
    runs = list(quality._runs(*joined([text, b"x"])))
    assert len(runs) > 2
    split = net.score(*joined([text, b"x"]))
    whole = quality._runs
    monkeypatch.setattr(quality, "_runs", lambda data, cuts: whole(data, cuts, 1 << 40))
    assert np.allclose(split, net.score(*joined([text, b"x"])), atol=1e-6)


@pytest.mark.parametrize("seed", [1, 2])
def test_steps_go_down_the_gradient(seed):
    """The first step of the optimiser moves each weight against the sign of its gradient, here a difference of losses."""
    net, r = network(seed)
    texts = [bytes(r.integers(97, 110, n).astype(np.uint8)) for n in (40, 300, 700, 520)]
    labels = np.array([0, 1, 1, 1], np.float32)
    weight = np.sqrt(np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean())))

    def loss(p):
        y = np.array([plain_score(p, t) for t in texts])
        return float(-(weight * np.where(labels == 1, np.log(y), np.log(1 - y))).mean())

    before = {k: x.astype(np.float64).copy() for k, x in net.p.items()}
    net.train(texts, labels, epochs=1, rate=1e-3)
    checked = 0
    for k, x in before.items():
        live = np.argwhere(net.p[k].astype(np.float64) != x)
        for at in map(tuple, live[r.permutation(len(live))[:5]]):
            low, high = ({**before, k: x.copy()} for _ in range(2))
            low[k][at] -= 1e-5
            high[k][at] += 1e-5
            slope = (loss(high) - loss(low)) / 2e-5
            if abs(slope) > 1e-4:
                assert np.sign(net.p[k][at] - x[at]) == -np.sign(slope), (k, at)
                checked += 1
    assert checked > 12


def test_long_words_and_texts_leave_in_runs(monkeypatch):
    from tracelake.llm import bpe

    own = bpe.codec(open(bpe.default_path()).read())
    for text in ("x" * 30_000, "né" * 9_000, "a few words 12 " * 6_000, "Σ中 " * 30_000):
        runs = list(own.runs(text))
        assert max(map(len, runs)) < bpe.RUN + bpe.KEPT * 4
        whole = [i for r in runs for i in r]
        monkeypatch.setattr(bpe, "LISTED", 0)
        monkeypatch.setattr(bpe, "RUN", 7)
        assert own.encode(text) == whole
        monkeypatch.undo()


def test_copies_are_neighbours_in_shards(spark):
    rows = [(i % 400 if i % 3 else None, "same text" if i % 2 else f"text {i % 150}", f"s{i % 2}") for i in range(2000)] + [(7, "twice", "s0")] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    a, b = (sorted(map(tuple, shards.interleave(df, bucket_rows=n).collect()), key=repr) for n in (10, 10_000))
    assert a == b and len(a) == 2300
    by, of = {}, {}
    for doc_id, size, crc, _, shard, slot, _, source in a:
        by.setdefault(shard, []).append(slot)
        of.setdefault((source, crc), {}).setdefault(shard, []).append(slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    # Copies of one source and text lie in neighbouring shards, with whole shards between the first and the last one.
    assert all(sorted(v) == list(range(min(v), max(v) + 1)) for v in of.values())
    assert sum(len(v) == 1 for v in of.values()) > 0.9 * len(of)
