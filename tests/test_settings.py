"""Typed settings against plain Python: round trips, merges and coerced edits at any depth."""

import json
import random
from copy import deepcopy

from tracelake.operators import settings as ops

HARD = [
    {"a": {"n": 7, "ok": True, "l": [1, 2]}, "b": {"c": {"d": 1.5}}},
    {"x": None, "s": "", "q": 'he said "{" \\ {', "e": {}, "l": [{"in": 1}, []], "é": {"中": {"deep": {"er": {"est": [None, False]}}}}},
    {"dotted.key": 1, "dotted": {"key": 2}, "a": 10**17, "neg": -3, "big": 1e30},
    {"one": 1},
]


def made(r, depth=4):
    leaf = lambda: r.choice([r.randrange(100), r.random() < 0.5, None, [1, "a"], "text", 2.25, {}])
    return {r.choice("abcdef"): made(r, depth - 1) if depth and r.random() < 0.5 else leaf() for _ in range(r.randint(1, 4))}


def plain_merge(a, b):
    for k, v in b.items():
        if isinstance(v, dict) and isinstance(a.get(k), dict):
            plain_merge(a[k], v)
        else:
            a[k] = v
    return a


def frame(spark, objects):
    return spark.createDataFrame([(i, json.dumps(o, ensure_ascii=False) if not isinstance(o, (str, type(None))) else o) for i, o in enumerate(objects)], "rec int, settings string")


def read(df):
    return {r.rec: json.loads(r.settings) for r in df.collect()}


def test_round_trip(spark):
    r = random.Random(3)
    objects = [*HARD, *(made(r, 6) for _ in range(40))]
    df = frame(spark, [*objects, None, "no json", "[1]", "{}", '{"cut":'])
    leaves = ops.flatten(df, ["rec"], "settings")
    assert read(ops.nest(leaves, ["rec"])) == dict(enumerate(objects))
    rows = {(x.rec, x.path): (x.group, x.value) for x in ops.as_text(leaves).collect()}
    assert rows[0, "a.l"] == ("a", "[1,2]") and rows[0, "b.c.d"] == ("b", "1.5") and rows[3, "one"] == ("Top-level", "1") and rows[1, "s"] == ("Top-level", "")
    assert rows[1, "e"] == ("Top-level", "{}") and rows[1, "x"] == ("Top-level", "null")
    shallow = {x.path for x in ops.flatten(df.where("rec = 0"), ["rec"], "settings", depth=1).collect()}
    assert shallow == {"a", "b"}


def test_merge(spark):
    r = random.Random(4)
    pairs = [(made(r), made(r)) for _ in range(60)]
    pairs += [({"a": {"b": 1}}, {"a": 2}), ({"a": 1}, {"a": {"b": 2}}), ({"a": {"b": 1}}, {"a": {}}), ({"a": 1}, {"a": {}}), ({"a": {}}, {"a": {"b": 1}}), ({"a": {}}, {"a": {}})]
    base, over = (ops.flatten(frame(spark, side), ["rec"], "settings") for side in zip(*pairs))
    assert read(ops.nest(ops.merge(base, over, ["rec"]), ["rec"])) == {i: plain_merge(deepcopy(a), b) for i, (a, b) in enumerate(pairs)}


CASES = [
    (5, "7.9", 7), (5, "-7.9", -7), (5, "nan", 5), (5, "1e30", 10**30), (5, "1e300", 5), (5, "x", 5), (5, 5.0, 5), (5, None, 5), (5, [1], 5), (5, True, 1),
    (1.5, "2", 2.0), (1.5, "x", 1.5), (1.5, "1.50", 1.5), (True, "false", False), (True, "", False), (False, "yes", True), (False, 1, True), (True, 0, False), (True, [], False),
    ([1], "[1, 2]", [1, 2]), ([1], "(1, 2,)", [1, 2]), ([1], "none", None), ([1], " ", None), ([1], "['a', True]", ["a", True]), ([1], "((", [1]), ([1], [3], [3]),
    (None, "None", None), (None, "4", 4), ("s", "7", "7"), ("s", 7, 7), ("s", "s", "s"),
]


def test_coercion(spark):
    base, edit = (ops.flatten(frame(spark, [{"p": {"v": c[k]}} for c in CASES]), ["rec"], "settings", depth=2) for k in (0, 1))
    got = {k: v["p"]["v"] for k, v in read(ops.nest(ops.changed(edit, base, ["rec"]), ["rec"])).items()}
    assert got == {i: want for i, (base, _, want) in enumerate(CASES) if not (want == base and type(want) is type(base))}


def test_unknown_paths(spark):
    base, edit = (ops.flatten(frame(spark, [x]), ["rec"], "settings") for x in ({"a": 1}, {"b": "none", "c": "3", "d": {"e": "[1]"}}))
    assert read(ops.nest(ops.changed(edit, base, ["rec"]), ["rec"])) == {0: {"c": 3, "d": {"e": [1]}}}


def test_merge_needs_no_join(spark, capsys):
    r = random.Random(6)
    pairs = [(made(r), made(r)) for _ in range(30)]
    pairs += [*pairs[:5], ({"a": {"b": 1, "b.c": 2}, "a.b": 3}, {"a": {"b": {"c": 5}}}), ({"a": {"b": {}}, "ab": 1}, {"a": {"b": {}}, "ab": {}})]
    rows = lambda side: [(i % 32 if i < 35 else None if i == 36 else i, json.dumps(p[side])) for i, p in enumerate(pairs)]
    pairs[32:35] = pairs[0:3]  # copies of a key's row
    base, over = (ops.flatten(spark.createDataFrame(rows(side), "rec int, settings string"), ["rec"], "settings") for side in (0, 1))
    merged = ops.merge(base, over, ["rec"])
    merged.explain()
    assert "Join" not in capsys.readouterr().out
    got = sorted((r.rec or -1, r.path, r.value) for r in ops.as_text(merged).collect())
    keys = [k for k, _ in rows(0)]
    whole = spark.createDataFrame([(n, k, json.dumps(plain_merge(deepcopy(a), b))) for n, (k, (a, b)) in enumerate(zip(keys, pairs))], "n int, rec int, settings string")
    assert got == sorted((r.rec or -1, r.path, r.value) for r in ops.as_text(ops.flatten(whole, ["n", "rec"], "settings")).collect())
