"""Exact dedup with Patricia tries.

Partitions are ranges of length (powers of two) and of content hash. Full byte strings are inserted into compressed
radix tries, one a partition, whose labels hold the texts; terminal nodes carry members. Each task first inserts its rows
into tries of its own, so that of many copies one text with its member ids leaves the task: beyond ``budget`` bytes the
heaviest subtree of the largest trie is spilled downstream, which costs a repeated text in the shuffle and changes no
result. The texts are then shuffled by partition and inserted in order; sorted insertion closes every subtree left of the
current path for good, and it is spilled at once, so that a task holds one root-to-leaf path. Terminals carry
the id that stays and the group's size. There are as many hash ranges as it takes for ``target`` bytes of text each.

Defined cases: null counts as empty; copies keep their largest (or smallest) doc_id; null doc_ids are members
but never stay unless all are null; rows that repeat the kept id all count as kept; an empty table gives an empty result;
a very long text is one key of its trie; extra columns are ignored; a doc_id that is no integer is an error of the cast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm import _words as W
from tracelake.llm._io import materialize

LOCAL = "rep long, length long, sha string, text binary, members array<long>"
COST = 400
OWNED = "rep long, keep_id long, group_size long"


class Node:
    __slots__ = ("label", "below", "value")

    def __init__(self, label: bytes, value=None):
        self.label, self.below, self.value = label, {}, value


class Trie:
    """Compressed radix trie over byte strings; ``insert`` returns the terminal node. ``size``: bytes of labels and nodes."""

    def __init__(self):
        self.root = Node(b"")
        self.size = 0

    def insert(self, key: bytes) -> Node:
        node, at = self.root, 0
        while at < len(key):
            child = node.below.get(key[at])
            if child is None:
                child = node.below[key[at]] = Node(key[at:])
                self.size += len(child.label) + COST
                return child
            label = child.label
            if not key.startswith(label, at):
                n = _common(label, key, at)
                upper = node.below[label[0]] = Node(label[:n])
                child.label = label[n:]
                upper.below[child.label[0]] = child
                self.size += COST
                child = upper
            node, at = child, at + len(child.label)
        return node

    def spill(self, key: bytes | None) -> Iterator[tuple[bytes, object]]:
        """Remove subtrees that lie left of ``key`` (all, if it is None): their texts and values."""
        node, at = self.root, 0
        while True:
            step = key[at] if key is not None and at < len(key) else None
            for c in sorted(node.below):
                if key is None or step is None or c < step:
                    yield from _terminals(node.below.pop(c), key[:at] if at else b"")
            if step not in node.below:
                return
            label = node.below[step].label
            if not key.startswith(label, at):
                if label < key[at : at + len(label)]:
                    yield from _terminals(node.below.pop(step), key[:at])
                return
            node, at = node.below[step], at + len(node.below[step].label)

    def heaviest(self) -> Iterator[tuple[bytes, object]]:
        """Remove the heaviest subtree below the first branching: its texts and values."""
        node, prefix = self.root, b""
        while len(node.below) == 1 and node.value is None:
            (child,) = node.below.values()
            if not child.below:
                break
            node, prefix = child, prefix + child.label
        if not node.below:
            return
        c = max(node.below, key=lambda c: _weight(node.below[c]))
        cut = node.below.pop(c)
        self.size -= _weight(cut)
        yield from _terminals(cut, prefix)

    def rest(self) -> Iterator[tuple[bytes, object]]:
        """Everything, the empty text included."""
        if self.root.value is not None:
            yield b"", self.root.value
            self.root.value = None
        yield from self.spill(None)
        self.size = 0


def _common(label: bytes, key: bytes, at: int) -> int:
    lo, hi = 0, min(len(label), len(key) - at)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if key.startswith(label[:mid], at):
            lo = mid
        else:
            hi = mid - 1
    return lo


def _terminals(node: Node, prefix: bytes) -> Iterator[tuple[bytes, object]]:
    stack = [(node, prefix)]
    while stack:
        node, prefix = stack.pop()
        text = prefix + node.label
        if node.value is not None:
            yield text, node.value
        stack.extend((x, text) for x in node.below.values())


def _weight(node: Node) -> int:
    total, stack = 0, [node]
    while stack:
        node = stack.pop()
        total += len(node.label) + COST
        stack.extend(node.below.values())
    return total


def _local(docs: DataFrame, budget: int) -> DataFrame:
    """Distinct texts of each task with their member ids."""

    def run(batches):
        seq, members = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36, 0
        tries: dict[tuple[int, str], Trie] = {}

        def rows(found):
            nonlocal seq
            out: list[list] = [[] for _ in range(5)]
            size = 0
            for text, (sha, ids) in found:
                for to, x in zip(out, (seq, len(text), sha, text, ids), strict=True):
                    to.append(x)
                seq += 1
                size += len(text)
                if size >= W.SLICE:
                    yield _batch(out)
                    out, size = [[] for _ in range(5)], 0
            yield _batch(out)

        def spill():
            # Down to half the budget, so that weighing subtrees is rare.
            while sum(t.size for t in tries.values()) > budget // 2:
                heavy = max(tries.values(), key=lambda t: t.size)
                before = heavy.size
                yield from heavy.heaviest()
                if heavy.size == before:
                    yield from heavy.rest()

        for batch in batches:
            for part in W.slices(batch):
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                    text = text or b""
                    sha = hashlib.sha256(text).hexdigest()
                    trie = tries.setdefault((len(text).bit_length(), sha[0]), Trie())
                    node = trie.insert(text)
                    if node.value is None:
                        node.value = (sha, [])
                    node.value[1].append(doc)
                    members += 1
                if 40 * members > budget:
                    for trie in tries.values():
                        yield from rows(trie.rest())
                    members = 0
                elif sum(t.size for t in tries.values()) > budget:
                    yield from rows(spill())
        for trie in tries.values():
            yield from rows(trie.rest())

    return docs.mapInArrow(run, LOCAL)


def _batch(out: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["rep", "length", "sha", "text", "members"])


def _owners(reps: DataFrame, largest: bool) -> DataFrame:
    """reps: rep, span, range, text, id, n; sorted by span, range and text in each partition."""
    best = max if largest else min

    def run(batches):
        key, trie = None, Trie()
        out: list[list] = [[], [], []]

        def close(found):
            for _, (members, keep, n) in found:
                out[0].extend(members)
                out[1].extend([keep] * len(members))
                out[2].extend([n] * len(members))

        def ready():
            batch = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["rep", "keep_id", "group_size"])
            for x in out:
                x.clear()
            return batch

        for batch in batches:
            for part in W.slices(batch, 3):
                for rep, span, at, text, doc, many in zip(*(part.column(i).to_pylist() for i in range(6)), strict=True):
                    if key != (span, at):
                        close(trie.rest())
                        key, trie = (span, at), Trie()
                    close(trie.spill(text))
                    node = trie.insert(text)
                    if node.value is None:
                        node.value = ([rep], doc, many)
                    else:
                        members, keep, size = node.value
                        members.append(rep)
                        node.value = (members, doc if keep is None else keep if doc is None else best(doc, keep), size + many)
                yield ready()
        close(trie.rest())
        yield ready()

    return reps.mapInArrow(run, OWNED)


def exact_groups(docs: DataFrame, keep: str = "largest", budget: int = 48 << 20, target: int = 4 << 20) -> DataFrame:
    """Per document: the id that stays, the group's size, whether the row stays, and the text's SHA-256."""
    if keep not in ("largest", "smallest"):
        raise ValueError(keep)
    local = materialize(_local(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), budget))
    ranges = 1 + (local.agg(F.sum("length")).first()[0] or 0) // target
    span = F.when(F.col("length") > 0, F.floor(F.log2("length")) + 1).otherwise(0).cast("int")
    at = F.shiftright(F.conv(F.substring("sha", 1, 7), 16, 10).cast("long") * F.lit(ranges), 28)
    pick = F.array_max if keep == "largest" else F.array_min
    reps = local.select("rep", span.alias("span"), at.alias("range"), "text", pick("members").alias("id"), F.size("members").cast("long").alias("n"))
    owned = _owners(reps.repartition("span", "range").sortWithinPartitions("span", "range", "text"), keep == "largest")
    rows = local.select("rep", "sha", "members").join(owned, "rep")
    return rows.select(F.explode("members").alias("doc_id"), "keep_id", "group_size", F.col("sha").alias("text_sha256")).select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256")


def query(spark, sf_dir: str) -> DataFrame:
    from tracelake.llm._io import table

    return exact_groups(table(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
