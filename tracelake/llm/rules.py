"""Quality rules: counts of a text's surface, and repetition inside it by suffix arrays.

The symbols of a suffix array are words, known by 64-bit hashes. Texts of a slice share one array: a word's symbol is mixed
with its row, so that suffixes of different rows never agree. Ranks by the first 1, 2, 4, ... words come from sorting only
what is still tied; they also give the longest common prefix of neighbours, by going down the powers. Intervals of the
array with a common prefix of ``shortest`` words or more are the repeated substrings that can't be extended to the right,
and those whose copies differ in the word before are maximal. A word is covered if a maximal repeat's copy (any of them,
the first too) spans it. A text fails if more than ``most_covered`` of its words are covered, or if its longest repeat has over
``longest`` words.

Work is done row by row in Arrow batches, without a shuffle; memory is that of the largest text (about 100 bytes a word) or
of a slice of 4 MB.

Defined cases: a null or empty text has no words and fails the base rule (fewer than 10 words); a null doc_id and repeated
rows are rows as others; very long texts are taken whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracelake.llm._words import SPACES, U, _mix, scan, slices

WINDOW = 5
_BREAK = np.zeros(256, bool)
_BREAK[10] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


class Suffixes:
    """Suffix array of rows of words (``first[i]:first[i + 1]`` is row i) and its repeats of ``shortest`` words or more."""

    def __init__(self, hashes: np.ndarray, first: np.ndarray, shortest: int):
        self.row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        self.end, self.start = first[1:][self.row], first[:-1][self.row]
        self.symbol = _mix(hashes + self.row.astype(U) * U(0x9E3779B97F4A7C15))
        self._sort()
        self._prefixes(shortest)

    def _sort(self) -> None:
        n = len(self.symbol)
        order = np.argsort(self.symbol, kind="stable")
        sorted_ = self.symbol[order]
        head = np.ones(n, bool)
        head[1:] = sorted_[1:] != sorted_[:-1]
        slot = np.arange(n)
        rank, ranks, k, who = np.empty(n, np.int32), [], 1, order
        while True:
            # Groups of equal prefixes keep their slots; a rank is the first slot of its group.
            heads = np.flatnonzero(head)
            size = np.diff(np.append(heads, len(who)))
            rank = rank.copy()
            rank[who] = np.repeat(slot[heads], size)
            ranks.append(rank)
            tied = np.repeat(size > 1, size)
            who, slot = who[tied], slot[tied]
            if not len(who):
                break
            then = who + k
            tail = np.where(then < self.end[who], rank[np.minimum(then, n - 1)].astype(np.int64) + 1, 0)
            key = rank[who].astype(np.int64) * (n + 2) + tail
            by = np.argsort(key, kind="stable")
            who, key = who[by], key[by]
            order[slot] = who
            head = np.ones(len(key), bool)
            head[1:] = key[1:] != key[:-1]
            k *= 2
        self.order, self.ranks = order, ranks

    def _prefixes(self, shortest: int) -> None:
        """``slots`` of the array whose common prefix with the slot before has ``shortest`` words or more, and ``common``."""
        order, ranks, n = self.order, self.ranks, len(self.order)
        level = max(0, min(shortest.bit_length() - 1, len(ranks) - 1))
        near = ranks[level][order[1:]] == ranks[level][order[:-1]]
        slots = np.flatnonzero(near) + 1
        a, b, common = order[slots - 1], order[slots], np.zeros(len(slots), np.int64)
        for t in range(len(ranks) - 2, -1, -1):
            x, y = a + common, b + common
            inside = (x < self.end[a]) & (y < self.end[b])
            common += (inside & (ranks[t][np.minimum(x, n - 1)] == ranks[t][np.minimum(y, n - 1)])).astype(np.int64) << t
        enough = common >= shortest
        self.slots, self.common = slots[enough], common[enough]

    def maximal(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal repeats as intervals of slots: first, last, words. Intervals nest, so a stack finds them."""
        found: list[tuple[int, int, int]] = []
        stack: list[tuple[int, int]] = []
        last = -1
        for slot, words in zip(self.slots.tolist(), self.common.tolist()):
            low = slot - 1
            while stack and (slot != last + 1 or stack[-1][1] > words):
                low_, deep = stack.pop()
                found.append((low_, last, deep))
                low = low_ if slot == last + 1 else slot - 1
            if not stack or stack[-1][1] < words:
                stack.append((low, words))
            last = slot
        found += [(low, last, deep) for low, deep in reversed(stack)]
        if not found:
            none = np.zeros(0, np.int64)
            return none, none, none
        low, high, words = np.array(found, np.int64).T
        at = self.order
        opens = at == self.start[at]
        before = self.symbol[np.maximum(at - 1, 0)]
        other = np.zeros(len(at), np.int64)
        other[1:] = (before[1:] != before[:-1]) | opens[1:] | opens[:-1]
        change = np.cumsum(other)
        wide = change[high] > change[low]
        return low[wide], high[wide], words[wide]

    def reach(self) -> np.ndarray:
        """Words of the longest repeat that starts at each word, 0 if shorter than ``shortest``."""
        out = np.zeros(len(self.order), np.int64)
        np.maximum.at(out, self.order[self.slots], self.common)
        np.maximum.at(out, self.order[self.slots - 1], self.common)
        return out


def covered(reach: np.ndarray, shortest: int) -> np.ndarray:
    """Words inside a repeat of ``shortest`` words or more: the union of spans, as each lies within a maximal one."""
    at = np.flatnonzero(reach >= shortest)
    step = np.zeros(len(reach) + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + reach[at], -1)
    return np.cumsum(step[:-1]) > 0


def _per_row(flags: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[cuts[1:]] - sums[cuts[:-1]]


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat", "n_repeats")


def counts(column: pa.Array, shortest: int) -> dict[str, np.ndarray]:
    """The counts of each text of a column."""
    column = column.cast(pa.large_string())
    words, rows = scan(column, SPACES), len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, rows + 1 + column.offset)[column.offset :]
    cuts = offsets - offsets[0]
    inside = ~SPACES[words.data]
    out = {"n_words": np.diff(words.first), "word_chars": _per_row(inside & (words.data & 0xC0 != 0x80), cuts), "n_symbols": _per_row(_SYMBOL[words.data], cuts)}

    lines = scan(column, _BREAK)
    seen = np.zeros(len(words.data) + 1, np.int64)
    np.cumsum(inside, out=seen[1:])
    row = np.repeat(np.arange(rows), np.diff(lines.first))
    some = seen[lines.end] > seen[lines.start]
    row, line = row[some], _mix(lines.hash[some] + row[some].astype(U) * U(0x9E3779B97F4A7C15))
    by = np.argsort(line, kind="stable")
    again = by[1:][line[by][1:] == line[by][:-1]]
    out["n_dup_lines"] = np.bincount(row[again], minlength=rows)

    if not len(words.hash):
        return out | {c: np.zeros(rows, np.int64) for c in COUNTS[4:]}
    found = Suffixes(words.hash, words.first, min(WINDOW, shortest))
    reach = found.reach()
    out["n_repeat_words"] = _per_row(covered(reach, WINDOW), words.first)
    out["n_covered"] = _per_row(covered(reach, shortest), words.first)
    low, _, length = found.maximal()
    of = found.row[found.order[low]]
    longest = np.zeros(rows, np.int64)
    np.maximum.at(longest, of, length)
    out["longest_repeat"], out["n_repeats"] = longest, np.bincount(of[length >= shortest], minlength=rows)
    return out


def measure(docs: DataFrame, shortest: int = 8) -> DataFrame:
    """Per row: doc_id and the counts. ``longest_repeat`` and ``n_repeats`` are of maximal repeats."""

    def task(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = counts(part.column(1), shortest)
                yield pa.record_batch([part.column(0), *(pa.array(found[c].astype(np.int64)) for c in COUNTS)], ["doc_id", *COUNTS])

    rows = docs.selectExpr("cast(doc_id AS long) AS doc_id", "coalesce(text, '') AS text")
    return rows.mapInArrow(task, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def passages(docs: DataFrame, shortest: int = 8) -> DataFrame:
    """Maximal repeats of each row: doc_id, words, copies, first_word (of the earliest copy) and its text."""

    def task(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = scan(part.column(1), SPACES)
                if not len(words.hash):
                    continue
                found = Suffixes(words.hash, words.first, shortest)
                low, high, length = found.maximal()
                if not len(low):
                    continue
                at = np.array([found.order[a : b + 1].min() for a, b in zip(low, high)])
                text = [words.data[words.start[p] : words.end[p + n - 1]].tobytes().decode() for p, n in zip(at, length)]
                cells = [part.column(0).take(pa.array(found.row[at])), pa.array(length), pa.array(high - low + 1), pa.array(at - found.start[at]), pa.array(text)]
                yield pa.record_batch(cells, ["doc_id", "words", "copies", "first_word", "text"])

    rows = docs.selectExpr("cast(doc_id AS long) AS doc_id", "coalesce(text, '') AS text")
    return rows.mapInArrow(task, "doc_id long, words long, copies long, first_word long, text string")


def rules(docs: DataFrame, shortest: int = 8, most_covered: float = 0.2, longest: int = 64) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` of each row."""
    out = measure(docs, shortest)
    out = out.selectExpr("*", "n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed")
    return out.selectExpr("*", f"NOT base_failed AND n_covered <= {most_covered!r}D * n_words AND longest_repeat <= {longest} AS kept")


def query(spark, sf_dir: str) -> DataFrame:
    from tracelake.llm._io import table

    found = rules(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "base_failed", "kept")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
v AS (SELECT r, m, i, array_to_string(w[i:i + m - 1], ' ') AS t FROM d, (VALUES (5), (8), (65)) z(m), range(1, greatest(len(w) - m + 2, 1)) y(i)),
t AS (SELECT r, m, i FROM (SELECT r, m, i, count(*) OVER (PARTITION BY r, m, md5(t)) AS n FROM v) WHERE n > 1),
c AS (SELECT r, m, sum(least(m, coalesce(nxt - i, m))) AS n FROM (SELECT *, lead(i) OVER (PARTITION BY r, m ORDER BY i) AS nxt FROM t) GROUP BY r, m),
s AS (SELECT r, coalesce(max(n) FILTER (m = 5), 0)::BIGINT AS c5, coalesce(max(n) FILTER (m = 8), 0)::BIGINT AS c8, count(*) FILTER (m = 65) AS c65 FROM c GROUP BY r),
f AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(c5, 0) AS n_repeat_words, coalesce(c8, 0) AS n_covered, coalesce(c65, 0) AS c65 FROM d LEFT JOIN l USING (r) LEFT JOIN s USING (r))
SELECT * EXCLUDE (c65), n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_covered <= 0.2 * n_words AND c65 = 0 AS kept FROM f
"""
