"""Secret scans over a trigram inverted index, with DataFrame operations only.

``trigram_query`` derives from a regular expression the Boolean query over trigrams that every matching
text satisfies. The index holds one posting (trigram, row) for each trigram that any rule names, of texts
in lower case. Postings are intersected by row, the queries give each rule's candidate rows, and the
expressions run on candidates only. A rule without mandatory trigrams scans all texts.

A row is known by its doc_id and the hash of its text. Defined cases: null counts as empty; repeated rows have
equal results; null doc_ids are scanned like others; an empty table gives an empty result; very long texts are scanned
whole; any number of trigrams is folded into masks of BITS bits; extra columns are ignored; a doc_id that is no integer
is an error of the cast.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``value`` is the group that needs ``least`` characters, or the match is dropped."""

    kind: str
    pattern: str
    value: int = 0
    least: int = 1


#: The contract's kinds in their order, then those that this method adds.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
BASE = 3

Query = tuple  # ("all",), ("gram", g), ("and", ...) or ("or", ...)
ALL: Query = ("all",)
MOST = 64
BITS = 62


def _and(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(p for p in parts if p != ALL))
    return ALL if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _or(parts: list[Query]) -> Query:
    if not parts or ALL in parts:
        return ALL
    parts = list(dict.fromkeys(parts))
    parts = [p for p in parts if not any(q != p and _grams(q) and _grams(q) < _grams(p) for q in parts)]
    return parts[0] if len(parts) == 1 else ("or", *parts)


def _grams(query: Query) -> frozenset:
    """The trigrams of a plain conjunction; a smaller one makes a larger one redundant."""
    some = (query,) if query[0] == "gram" else query[1:] if query[0] == "and" else ()
    return frozenset(q[1] for q in some) if all(q[0] == "gram" for q in some) else frozenset()


def _of_strings(strings: set[str]) -> Query:
    return _or([_and([("gram", s[i : i + 3]) for i in range(len(s) - 2)]) for s in sorted(strings)])


def _sequence(nodes) -> tuple[set[str] | None, Query]:
    """The strings that a sequence matches, if they are few, and its query."""
    now, parts, exact = {""}, [], True
    for node in nodes:
        strings, query = _node(node)
        if strings is not None and len(now) * len(strings) <= MOST:
            now = {a + b for a in now for b in strings}
            continue
        exact = False
        parts += [_of_strings(now), query]
        now = {""} if strings is None else strings
    if exact:
        return now, _of_strings(now)
    return None, _and([*parts, _of_strings(now)])


def _node(node) -> tuple[set[str] | None, Query]:
    kind, x = node
    if kind is C.LITERAL:
        return {chr(x).lower()}, ALL
    if kind is C.IN:
        if all(k is C.LITERAL for k, _ in x):
            return {chr(c).lower() for _, c in x}, ALL
        return None, ALL
    if kind is C.SUBPATTERN:
        return _sequence(x[-1])
    if kind is C.BRANCH:
        each = [_sequence(s) for s in x[1]]
        strings = None if any(s is None for s, _ in each) else set().union(*(s for s, _ in each))
        return strings if strings is None or len(strings) <= MOST else None, _or([q for _, q in each])
    if kind in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        least, most, inner = x
        strings, query = _sequence(inner)
        if strings is not None and least == most and len(strings) ** most <= MOST and most <= 16:
            return reduce(lambda a, b: {p + q for p in a for q in b}, [strings] * most, {""}), ALL
        if strings is not None and (least, most) == (0, 1):
            return strings | {""}, ALL
        return None, query if least else ALL
    if kind is C.AT:
        return {""}, ALL
    return None, ALL


def trigram_query(pattern: str) -> Query:
    """What trigrams a text in lower case must have to match."""
    return _sequence(_parser.parse(pattern))[1]


def grams_of(query: Query) -> set[str]:
    return {query[1]} if query[0] == "gram" else set().union(*(grams_of(q) for q in query[1:])) if query != ALL else set()


def _holds(query: Query, masks: list[Column], bit: dict[str, int]) -> Column:
    if query[0] == "gram":
        word, at = divmod(bit[query[1]], BITS)
        return masks[word].bitwiseAND(F.lit(1 << at)) != 0
    each = [_holds(q, masks, bit) for q in query[1:]]
    return reduce((lambda a, b: a & b) if query[0] == "and" else (lambda a, b: a | b), each)


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """The inverted index: one row (gram, doc_id, row) for each trigram of a text."""
    low = F.lower("text")
    found = F.array(*(F.when(F.contains(low, F.lit(g)), F.lit(i)) for i, g in enumerate(grams)))
    return docs.select("doc_id", "row", F.explode(F.array_compact(found)).alias("gram"))


def _spans(rule: Rule, number: int, wanted: Column) -> Column:
    """Spans (start, number, end) of a rule's matches, code points; the gaps between matches give the places."""
    pattern = "'" + rule.pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    found = f"regexp_extract_all(text, {pattern}, 0)"
    each = f"zip_with(zip_with({found}, regexp_extract_all(text, {pattern}, {rule.value}), (m, v) -> struct(m, v)), slice(split(text, {pattern}, -1), 1, size({found})), (x, g) -> struct(length(g) as gap, length(x.m) as len, length(x.v) >= {rule.least} as good))"
    fold = f"aggregate({each}, struct(0 as at, cast(array() as array<struct<start: int, number: int, end: int>>) as out), (a, x) -> struct(a.at + x.gap + x.len as at, if(x.good, array_append(a.out, struct(a.at + x.gap as start, {number} as number, a.at + x.gap + x.len as end)), a.out) as out), a -> a.out)"
    none = "cast(array() as array<struct<start: int, number: int, end: int>>)"
    return F.when(wanted & F.expr(f"rlike(text, {pattern})"), F.expr(fold)).otherwise(F.expr(none))


def _joined(column: str) -> Column:
    kinds = "array(" + ", ".join(f"'{r.kind}'" for r in RULES) + ")"
    return F.expr(f"array_join(transform(array_sort({column}), x -> concat_ws(':', element_at({kinds}, x.number), x.start, x.end)), ',')")


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per document: spans by kind number, sorted, and their digest."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.xxhash64("text"))
    queries = [trigram_query(r.pattern) for r in rules]
    grams = sorted(set().union(*map(grams_of, queries)))
    bit = {g: i for i, g in enumerate(grams)}
    words = range(-(-max(1, len(grams)) // BITS))
    folded = (F.expr(f"bit_or(if(gram div {BITS} = {w}, shiftleft(1L, gram % {BITS}), 0L))").alias(f"mask_{w}") for w in words)
    rows = postings(docs, grams).groupBy("doc_id", "row").agg(*folded)
    masks = [F.col(f"mask_{w}") for w in words]
    rows = rows.select(F.col("doc_id").alias("c_doc"), F.col("row").alias("c_row"), *(_holds(q, masks, bit).alias(f"may_{r.kind}") for r, q in zip(rules, queries, strict=True) if q != ALL))
    some = [F.col(f"may_{r.kind}") for r, q in zip(rules, queries, strict=True) if q != ALL]
    rows = rows.where(reduce(lambda a, b: a | b, some))
    both = docs.join(rows, (docs["row"] == rows["c_row"]) & docs["doc_id"].eqNullSafe(rows["c_doc"]), "left")
    spans = [_spans(r, i + 1, F.lit(True) if q == ALL else F.coalesce(f"may_{r.kind}", F.lit(False))).alias(f"s_{r.kind}") for i, (r, q) in enumerate(zip(rules, queries, strict=True))]
    return both.select("doc_id", *spans)


def query(spark, sf_dir: str) -> DataFrame:
    from tracelake.llm._io import table

    found = scan_secrets(table(spark, sf_dir, "documents"))
    found = found.withColumn("base", F.concat(*(f"s_{r.kind}" for r in RULES[:BASE]))).withColumn("every", F.concat(*(f"s_{r.kind}" for r in RULES)))
    return found.select("doc_id", *(F.size(f"s_{r.kind}").cast("long").alias(f"n_{r.kind}") for r in RULES[:BASE]), F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("every").alias("spans"))


def _any_case(pattern: str) -> str:
    """(?i:...) spelled out, so that no engine folds letters outside ASCII."""
    return re.sub(r"\(\?i:(\((?:[^()]*)\))\)", lambda m: re.sub("[a-z]", lambda c: f"[{c[0].upper()}{c[0]}]", m[1]), pattern)


def _sql() -> str:
    parts = []
    for i, r in enumerate(RULES):
        p = _any_case(r.pattern).replace("'", "''").replace(r"\x20", " ")
        parts.append(f"SELECT doc_id, {i} AS k, '{r.kind}' AS kind, regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '{p}', {r.value}) AS v, regexp_split_to_array(text, '{p}') AS g, {r.least} AS least FROM d")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join(parts)}),
u AS (SELECT doc_id, k, kind, unnest(m) AS m, unnest(v) AS v, unnest(g[:len(m)]) AS g, unnest(range(len(m))) AS i, least FROM f WHERE len(m) > 0),
p AS (SELECT *, sum(length(g) + length(m)) OVER (PARTITION BY doc_id, k ORDER BY i)::BIGINT AS e FROM u),
s AS (SELECT doc_id, k, e - length(m) AS st, kind || ':' || (e - length(m)) || ':' || e AS t FROM p WHERE length(v) >= least),
a AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, string_agg(t, ',' ORDER BY st, k) FILTER (k < {BASE}) AS base, string_agg(t, ',' ORDER BY st, k) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a ON a.doc_id = d.doc_id
"""


SQL = _sql()
