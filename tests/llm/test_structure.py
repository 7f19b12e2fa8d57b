"""Centroid clustering, conversation repair and quality rules against brute force, with nulls, ties, copies and empty tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tracelake.llm import clusters, repair, rules


# --- centroid clustering ---


def plain_clusters(rows, k, rounds, seed, dim):
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    cents = [list(v) for _, v in first]
    near = lambda v: min(range(len(cents)), key=lambda c: (sum((a - b) ** 2 for a, b in zip(v, cents[c])), c))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[near(v)].append(v)
        for c, vs in own.items():
            cents[c] = [sum(col) // len(vs) for col in zip(*vs)]
    return [(i, near(v), sum((a - b) ** 2 for a, b in zip(v, cents[near(v)]))) for i, v in kept], cents


@pytest.mark.parametrize("k", [3, 7])
def test_clusters(spark, k, monkeypatch):
    r = random.Random(k)
    middle = [[r.uniform(-1, 1) for _ in range(4)] for _ in range(5)]
    rows = [(i, [m + r.gauss(0, 0.1) for m in middle[i % 5]]) for i in range(300)]
    rows += [(1000 + i, [0.5, 0.25, 0.0, -0.25]) for i in range(200)]  # copies: a node of width 0
    rows += [(2000 + i, [float(i % 3), 0.0, 0.0, 0.0]) for i in range(30)]  # ties
    rows += [(None, [0.1] * 4), (None, [0.1] * 4), (7, [0.2] * 4), (3000, None), (3001, [0.1] * 3), (3002, [0.1, None, 0.1, 0.1]), (3003, [float("nan"), 0.0, 0.0, 0.0]), (3004, [float("inf")] * 4), (3005, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster string")
    got, cents = clusters.cluster(df, k=k, rounds=4, seed=2, dim=4)
    want, plain = plain_clusters(rows, k, 4, 2, 4)
    assert cents.tolist() == plain
    assert sorted(map(repr, ((g.vec_id, g.cluster, g.distance) for g in got.collect()))) == sorted(map(repr, want))


def test_clusters_of_few_or_none(spark):
    schema = "vec_id long, embedding array<float>"
    one = spark.createDataFrame([(5, [0.5] * 64), (6, [1e30] * 64)], schema)
    found, cents = clusters.cluster(one)
    assert len(cents) == 2 and {r.distance for r in found.collect()} == {0} and abs(cents).max() == clusters.LIMIT
    assert clusters.cluster(spark.createDataFrame([], schema))[0].count() == 0


def test_walk_prunes_and_is_exact():
    r = np.random.default_rng(0)
    middle = r.integers(-200, 200, (8, 3))
    points = (middle[r.integers(0, 8, 4000)] + r.integers(-9, 10, (4000, 3))).astype(np.int32)
    order, tree = clusters.build(points)
    assert sorted(order) == list(range(4000))
    cents = np.concatenate([middle, middle[:2]]).astype(np.int64)  # two equal centroids: the smaller number wins
    own, far = clusters.labels(tree, cents)
    every = ((tree.points[:, None].astype(np.int64) - cents[None]) ** 2).sum(2)
    assert (own == every.argmin(1)).all() and (far == every.min(1)).all()
    pieces = list(clusters.walk(tree, cents))
    assert any(node is not None and b - a > clusters.LEAF for node, a, b, _ in pieces)
    counts, sums = np.zeros(10, np.int64), np.zeros((10, 3), np.int64)
    clusters.totals(tree, cents, counts, sums)
    assert (counts == np.bincount(own, minlength=10)).all()
    assert all((sums[c] == tree.points[own == c].sum(0)).all() for c in range(10))


# --- conversation repair ---

NEXT = {0: 2, 1: 2, 2: 3, 3: 2}
STEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def plain_repair(turns):
    """Best (cost, audit) and repaired rows of sorted (role, text); also the first faults."""
    seen, faults = set(), []
    for role, text in turns:
        said = BLANK.findall(text)
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {0: (0, "", [])}

    def insert(best):
        for _ in range(2):
            for q, (c, a, rows) in list(best.items()):
                new = (c + 5, a + "I", [*rows, ("assistant" if q == 2 else "user", "")])
                if NEXT[q] not in best or new[:2] < best[NEXT[q]][:2]:
                    best[NEXT[q]] = new

    insert(best)
    for (role, text), fault in zip(turns, faults):
        after = {}
        for q, (c, a, rows) in best.items():
            late = 5 * (fault == "truncated")
            edits = [(q, (c + 2, a + "D", rows))]
            if fault in ("", "truncated"):
                edits.append((NEXT[q], (c + 1 + late, a + "R", [*rows, ("assistant" if q == 2 else "user", text)])))
                if q in STEP.get(role[:1], {}):
                    edits.append((STEP[role[:1]][q], (c + late, a + "K", [*rows, (role, text)])))
            for to, new in edits:
                if to not in after or new[:2] < after[to][:2]:
                    after[to] = new
        best = after
        insert(best)
    cost, audit, rows = min((best[q] for q in (0, 3) if q in best), key=lambda x: x[:2])
    return faults, cost, audit, rows


def plain_summary(rows):
    out = {}
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(f"{r[2]}\0{r[3]}".encode()).hexdigest()))
        faults, cost, audit, fixed = plain_repair([r[2:] for r in own])
        known = [r[1] for r in own if r[1] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        text = "\n".join(f"{role}:{t}" for role, t in fixed)
        out[key] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def conversations(seed=5):
    r = random.Random(seed)
    rows = []
    for c in [*range(60), None, 100]:
        n = r.randint(1, 9) if c != 100 else 700
        for t in range(n):
            role = "system" if t == 0 and r.random() < 0.4 else ("user", "assistant")[t % 2]
            if r.random() < 0.2:
                role = r.choice(["system", "user", "assistant", "tool", "", None])
            text = r.choice([f"said {t}.", f"asked {r.randrange(3)}?", f"é cut {t}", "done!\n", "", " \t", None, "same.", "x." * 50])
            rows.append((c, None if r.random() < 0.05 else t + r.choice([0, 0, 0, 3]), role, text))
            if r.random() < 0.1:
                rows.append(rows[-1])
    return rows


def as_text(rows):
    return [(c, t, " " if role is None else role, " " if text is None else text) for c, t, role, text in rows]


SCHEMA = "conv_id long, turn long, role string, text string, key string, kind int, plan string"


def test_repair(spark, monkeypatch):
    rows = conversations()
    df = spark.createDataFrame([(*r, "k", 1, "p") for r in rows], SCHEMA).repartition(5)
    want = plain_summary(as_text(rows))
    got = {g.conv_id: tuple(g)[1:] for g in repair.summary(df).collect()}
    assert got == want
    monkeypatch.setattr(repair, "SEGMENT", 3)  # a conversation in many pieces
    assert {g.conv_id: tuple(g)[1:] for g in repair.summary(df).collect()} == want
    out = defaultdict(list)
    for g in repair.repaired(df).orderBy("conv_id", "position").collect():
        out[g.conv_id].append(f"{g.role}:{g.text}")
    assert all(hashlib.sha256("\n".join(out[c]).encode()).hexdigest() == w[-1] for c, w in want.items())
    assert all(re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines)) for lines in out.values())


def test_damage_and_repair(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], f"word {c} {t}!") for c in range(240) for t in range(1 + c % 3)] + [(None, None, None, None)]
    hurt = []
    for c, t, role, text in as_text(rows):
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if h:
            hurt += [(c, t, "user" if h == 4 else role, "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text)] * (1 + (h == 3))
    df = spark.createDataFrame([(*r, "k", 1, "p") for r in rows], SCHEMA)
    want = plain_summary(hurt)
    got = {g.conv_id: tuple(g)[1:] for g in repair.summary(repair.damage(df), df).collect()}
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {c: want.get(c, none) for c in {r[0] for r in rows}} and none in got.values()
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.summary(repair.damage(empty), empty).count() == 0 and repair.repaired(empty).count() == 0


def test_layers_of_long_conversations():
    r = random.Random(9)
    kinds = {0: ("x", "."), 1: ("s", "."), 2: ("u", "."), 3: ("a", ".")}
    for n in (1, 2, 127, 128, 129, 400, 1100):
        codes = np.array([r.choice([0, 1, 2, 3, 2, 3, 2, 3, 4, 10, 18, 19]) for _ in range(n)], np.uint8)
        # Distinct texts stand for each turn; duplicates repeat an earlier one of their own.
        turns, seen = [("u", "again.")], []
        for j, c in enumerate(codes):
            role = kinds[int(c) & 3][0]
            turns.append((role, "" if c & 4 else "again." if c & 8 else f"{j}" if c & 16 else f"{j}."))
        codes = np.concatenate([[2], codes]).astype(np.uint8)
        faults, cost, audit, _ = plain_repair(turns)
        assert [bool(f) for f in faults] == [bool(c & 28) for c in codes] and not seen
        assert repair.solve([codes, codes[:1]])[0] == (cost, audit.encode())


# --- quality rules ---


def plain_rules(text, shortest=8, longest=64):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)

    def windows(m):
        at = defaultdict(list)
        for i in range(len(w) - m + 1):
            at[tuple(w[i : i + m])].append(i)
        return [v for v in at.values() if len(v) > 1]

    cover = lambda m: len({j for v in windows(m) for i in v for j in range(i, i + m)})
    m = 0
    while windows(m + 1):
        m += 1
    lines = [x for x in text.split("\n") if BLANK.search(x)]
    n5, n8 = cover(5), cover(shortest)
    base = len(w) < 10 or 100 * n5 > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), n5, n8, base, not base and n8 <= 0.2 * len(w) and m <= longest


def texts(seed=4):
    r = random.Random(seed)
    word = lambda n: " ".join(r.choice("abcdefgé") + str(r.randrange(n)) for _ in range(r.randint(1, 120)))
    out = [None, "", " \n\t ", "one", "a " * 40, "a b " * 30, "# * | <b> $5 & 7%", "x\ny\nx\n\n\ny \n", "中文 é\r\n中文 é\r\n", "z" * 100_000]
    for i in range(120):
        t = word(r.choice([2, 3, 10, 1000, 10**6]))
        out.append(t)
        if i % 4 == 0:
            out.append(t + "\n" + word(10**6) + "\n" + t)
    passage = " ".join(f"p{i}" for i in range(70))
    rest = lambda n: " ".join(f"q{r.randrange(10**9)}" for _ in range(n))
    out += [rest(500) + " " + " ".join(passage.split()[:n]) + " " + rest(500) + " " + " ".join(passage.split()[:n]) for n in (4, 5, 8, 64, 65)]
    out.append(rest(60_000))
    return out


def test_rules(spark):
    every = texts()
    df = spark.createDataFrame([(None if i == 3 else i // 2, t, 1, "c") for i, t in enumerate(every)], "doc_id long, text string, n_words int, kept string").repartition(3)
    got = rules.rules(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "base_failed", "kept")
    want = [(None if i == 3 else i // 2, *plain_rules(t)) for i, t in enumerate(every)]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert rules.rules(df.limit(0)).count() == 0


def test_maximal_repeats(spark):
    for text in texts()[:90]:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        if len(w) > 130:
            continue
        at = defaultdict(list)
        for i in range(len(w)):
            for j in range(i + 2, len(w) + 1):
                at[tuple(w[i:j])].append(i)
        want = set()
        for s, v in at.items():
            if len(v) > 1:
                left = {w[i - 1] if i else i for i in v}
                right = {w[i + len(s)] if i + len(s) < len(w) else i for i in v}
                if len(left) > 1 and len(right) > 1:
                    want.add((s, len(v), min(v)))
        if w:
            from tracelake.llm._words import words_hash

            found = rules.Suffixes(words_hash([x.encode() for x in w]), np.array([0, len(w)]), 2)
            low, high, words = found.maximal()
            got = [(tuple(w[found.order[a] : found.order[a] + n]), b - a + 1, found.order[a : b + 1].min()) for a, b, n in zip(low, high, words)]
            assert len(got) == len(want) and set(got) == want
    df = spark.createDataFrame([(1, "a b c d x a b c d y"), (2, None), (3, "a b c d")], "doc_id long, text string")
    assert [tuple(r) for r in rules.passages(df, 3).collect()] == [(1, 4, 2, 0, "a b c d")]
