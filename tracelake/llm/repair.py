"""Conversation structure repair by layers of cost.

A conversation should read ``(s?(ua)+)?`` in the initials of its roles. Edits: Keep a turn (0), Rerole it to user or
assistant (1), Delete it (2; the only edit for blank and duplicate turns), Insert an empty user or assistant turn (5); a
truncated turn that stays adds 5. For each cost 0, 1, 2, ... a layer holds, at every turn, the bitset of grammar states
from which the rest can be accepted at just that cost; a layer follows from earlier layers by table look-ups, as all edits
are shifts of layers and turns. The first layer with the start state at turn 0 is the cost, and a walk over the bits that
tries D, I, K, R in this order gives the least audit.

Turns travel as one byte each, for many conversations as columns of one array. Conversations over ``BLOCK`` turns are cut:
bitsets then hold pairs (state before, state after), layers give each block's cost for every pair, and the sums over
blocks say what remains behind each.

Spark's part: facts of turns without texts are counted by turn and text (map side first), matched with the first turn of
the same role and text (a join that splits hot keys), sorted by range, so that a long conversation spans many tasks, and
packed into bytes; a conversation's bytes and audit, one each a turn, are the largest thing one task holds, as the audit is
one value. Texts move once, sorted, and are streamed into the digest, whatever their number.

Defined cases: nulls count as one space; a null conv_id is one conversation; turns come by turn, nulls first, then role
and md5 of role and text; repeated rows are repeated turns, so all but one are duplicates; roles whose first character is
none of s, u, a (empty ones, too) are kept by no edit but Rerole; a conversation without rows has zeros, an empty
audit and the digest of the empty string; an empty table gives no rows; very long texts are streamed whole; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm._io import materialize, release

BLOCK, SEGMENT, LANES = 128, 1 << 16, 256
BLANK, DUPLICATE, TRUNCATED, PAD = 4, 8, 16, 32
FAR = 1 << 60
#: States: start, after system, after user, after assistant. What an inserted or changed turn leads to, and what a kept
#: s, u or a leads to (-1: nothing).
NEXT = np.array([2, 2, 3, 2])
KEPT = np.array([[-1] * 4, [1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1]])
ACCEPT = np.array([0, FAR, FAR, 0])
D, I, K, R = b"DIKR"


def _before(step: np.ndarray) -> np.ndarray:
    """For each bitset of pairs (q, e), bit 4 * q + e: the pairs whose q steps into one of them."""
    sets = np.arange(1 << 16, dtype=np.uint32)
    out = np.zeros(1 << 16, np.uint32)
    for q, to in enumerate(step):
        if to >= 0:
            out |= ((sets >> np.uint32(4 * to)) & np.uint32(15)) << np.uint32(4 * q)
    return out.astype(np.uint16)


_CHANGE, _KEEP = _before(NEXT), np.stack([_before(k) for k in KEPT])
_SAME = np.uint16(sum(1 << (5 * q) for q in range(4)))


def layers(codes: np.ndarray, whole: bool) -> np.ndarray:
    """Bitsets [cost, turn, lane] of lanes of codes [turn, lane]; ``whole``: until each lane accepts from the start."""
    n, lanes = codes.shape
    pad, gone = codes == PAD, (codes & (BLANK | DUPLICATE)) > 0
    late = (codes & TRUNCATED) > 0
    initial = codes & 3
    none = np.zeros((n + 1, lanes), np.uint16)
    out: list[np.ndarray] = []
    back = lambda c: out[c] if c >= 0 else none
    open_, at = np.ones(lanes, bool), 0
    while at <= 2 * n + 10 and (open_.any() or not whole):
        own = _CHANGE[back(at - 5)]
        own[n] |= _SAME if at == 0 else np.uint16(0)
        drop, change, change_late, keep_late = back(at - 2), back(at - 1), back(at - 6), back(at - 5)
        for i in range(n - 1, -1, -1):
            stay = np.where(late[i], keep_late[i + 1], own[i + 1])
            alter = np.where(late[i], change_late[i + 1], change[i + 1])
            kept = np.where(gone[i], np.uint16(0), _KEEP[initial[i], stay] | _CHANGE[alter])
            own[i] |= np.where(pad[i], own[i + 1], kept | drop[i + 1])
        out.append(own)
        open_ &= (own[0] & 9) == 0  # pairs (start, start) and (start, after assistant)
        at += 1
    return np.stack(out)


def trace(found: np.ndarray, codes: np.ndarray, lane: np.ndarray, size: np.ndarray, state: np.ndarray, left: np.ndarray, behind: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Least audits: per walker its lane, turns, first state, remaining cost, and cost behind the block for each state."""
    n = len(codes)
    i, q, r, w = np.zeros(len(lane), np.int64), state.copy(), left.copy(), np.arange(len(lane))
    wrote, length = np.zeros((len(lane), 2 * n + 12), np.uint8), np.zeros(len(lane), np.int64)

    def can(who, at, to, rest):
        ok = np.zeros(len(who), bool)
        for e in range(4):
            c = rest - behind[who, e]
            fits = (c >= 0) & (c < len(found)) & (to >= 0)
            bits = found[np.where(fits, c, 0), at, lane[who]]
            ok |= fits & ((bits >> (4 * np.maximum(to, 0) + e).astype(np.uint16)) & 1 > 0)
        return ok

    while len(w):
        over = (i[w] == size[w]) & (r[w] == behind[w, q[w]])
        w = w[~over]
        if not len(w):
            break
        end, at = i[w] == size[w], np.minimum(i[w], n - 1)
        code = codes[at, lane[w]]
        gone, late = (code & (BLANK | DUPLICATE)) > 0, 5 * ((code & TRUNCATED) > 0)
        then, kept = np.minimum(i[w] + 1, n), KEPT[code & 3, q[w]]
        drop = ~end & can(w, then, q[w], r[w] - 2)
        insert = ~drop & can(w, i[w], NEXT[q[w]], r[w] - 5)
        keep = ~drop & ~insert & ~end & ~gone & can(w, then, kept, r[w] - late)
        change = ~drop & ~insert & ~keep
        wrote[w, length[w]] = np.select([drop, insert, keep], [D, I, K], R)
        length[w] += 1
        r[w] -= np.select([drop, insert, keep], [2, 5, late], 1 + late)
        q[w] = np.select([keep, insert | change], [kept, NEXT[q[w]]], q[w])
        i[w] += ~insert
    return [wrote[j, : length[j]].tobytes() for j in range(len(lane))], q


def _columns(parts: list[np.ndarray]) -> np.ndarray:
    out = np.full((max(len(p) for p in parts), len(parts)), PAD, np.uint8)
    for j, p in enumerate(parts):
        out[: len(p), j] = p
    return out


def solve(conversations: list[np.ndarray]) -> list[tuple[int, bytes]]:
    """Cost and least audit of each conversation of codes."""
    out: list = [(0, b"")] * len(conversations)
    sizes: dict[int, list[int]] = {}
    for j, codes in enumerate(conversations):
        if 0 < len(codes) <= BLOCK:
            sizes.setdefault(int(len(codes) - 1).bit_length(), []).append(j)
    long = [j for j, codes in enumerate(conversations) if len(codes) > BLOCK]
    for j, found in zip(long, _long([conversations[j] for j in long])):
        out[j] = found
    for size, who in sizes.items():
        step = max(1, LANES * BLOCK**2 >> 2 * size)  # layers take turns x turns for each lane
        for a in range(0, len(who), step):
            some = who[a : a + step]
            codes = _columns([conversations[j] for j in some])
            found = layers(codes, True)
            cost = ((found[:, 0] & 9) > 0).argmax(0)
            lane = np.arange(len(some))
            audits, _ = trace(found, codes, lane, np.array([len(conversations[j]) for j in some]), np.zeros(len(some), np.int64), cost, np.tile(ACCEPT, (len(some), 1)))
            for j, c, audit in zip(some, cost.tolist(), audits):
                out[j] = c, audit
    return out


def _long(conversations: list[np.ndarray]) -> list[tuple[int, bytes]]:
    """The same for conversations of many blocks, whose blocks share lanes."""
    blocks = [codes[a : a + BLOCK] for codes in conversations for a in range(0, len(codes), BLOCK)]
    ends = np.cumsum([-(-len(codes) // BLOCK) for codes in conversations]).tolist()
    costs, kept = np.empty((len(blocks), 4, 4), np.int64), None
    for a in range(0, len(blocks), LANES):
        kept = layers(_columns(blocks[a : a + LANES]), False)
        for q in range(4):
            for e in range(4):
                has = (kept[:, 0] >> np.uint16(4 * q + e)) & 1
                costs[a : a + LANES, q, e] = np.where(has.any(0), has.argmax(0), FAR)
    # Cost that remains before each block, and behind it, for each state.
    before, behind = np.empty((len(blocks), 4), np.int64), np.empty((len(blocks), 4), np.int64)
    last = set(ends)
    for b in range(len(blocks) - 1, -1, -1):
        behind[b] = ACCEPT if b + 1 in last else before[b + 1]
        before[b] = np.minimum((costs[b] + behind[b]).min(1), FAR)
    # Each block is walked from all states that can be completed; the chain of blocks then picks its walks.
    out, audit, q, first, which = [], [], 0, 0, 0
    for a in range(0, len(blocks), LANES):
        some = blocks[a : a + LANES]
        columns = _columns(some)
        b, s = np.nonzero(before[a : a + len(some)] < FAR)
        found = kept if len(blocks) <= LANES else layers(columns, False)
        audits, then = trace(found, columns, b, np.array([len(x) for x in some])[b], s, before[a + b, s], behind[a + b])
        walks = {(int(x), int(y)): (t, int(z)) for x, y, t, z in zip(b, s, audits, then)}
        for x in range(len(some)):
            text, q = walks[x, q]
            audit.append(text)
            if a + x + 1 == ends[which]:
                out.append((int(before[first, 0]), b"".join(audit)))
                audit, q, first, which = [], 0, a + x + 1, which + 1
    return out


def _turns(df: DataFrame) -> DataFrame:
    """Rows as this module reads them; ``key`` stands for conv_id, a space for null."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit(" ")), F.coalesce(F.col("text").cast("string"), F.lit(" "))
    return df.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("key"), F.col("turn").isNotNull().alias("known"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), role.alias("role"), text.alias("text"), F.unhex(F.md5(F.concat_ws("\0", role, text))).alias("sum"),
    )


def _facts(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row for equal rows of a turn: its code without duplicates, whether it is the first of its text, and its number; and the table it reads."""
    bare = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    code = F.when(F.length(bare) == 0, BLANK).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(0)
    initial = F.when(F.col("role").startswith("s"), 1).when(F.col("role").startswith("u"), 2).when(F.col("role").startswith("a"), 3).otherwise(0)
    rows = turns.select("key", "known", "turn", "sum", "role", (code + initial).alias("code"))
    counted = materialize(rows.groupBy(*rows.columns).agg(F.count("*").alias("n")))
    first = counted.groupBy("key", "sum").agg(F.min(F.struct("known", "turn")).alias("first"))
    out = counted.join(first, ["key", "sum"]).withColumn("new", (F.struct("known", "turn") == F.col("first")))
    return out.select("key", "known", "turn", "role", "sum", "code", "new", "n"), counted


SEGMENTS = "key string, part int, seq int, codes binary, first long, last long, distinct long"
PLAN = "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _segments(batches) -> Iterator[pa.RecordBatch]:
    """Sorted facts to bytes of consecutive turns of one conversation; also first, last and number of known turns."""
    seq, key, part, held, size, turns = 0, None, 0, [], 0, []

    def emit():
        nonlocal seq, held, size, turns
        known = np.unique(np.concatenate(turns))
        row = [key, part, seq, b"".join(held), *((int(known[0]), int(known[-1]), len(known)) if len(known) else (None, None, 0))]
        seq, held, size, turns = seq + 1, [], 0, []
        return row

    names = [f.split()[0] for f in SEGMENTS.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    for batch in batches:
        if not batch.num_rows:
            continue
        rows: list[list] = []
        cols = {n: batch.column(n) for n in batch.schema.names}
        n, new = cols["n"].to_numpy(zero_copy_only=False), cols["new"].to_numpy(zero_copy_only=False)
        code, turn, known = cols["code"].to_numpy(zero_copy_only=False).astype(np.uint8), cols["turn"].to_numpy(zero_copy_only=False), cols["known"].to_numpy(zero_copy_only=False)
        keys, where = cols["key"].to_pylist(), int(cols["part"][0].as_py())
        named = cols["key"].dictionary_encode().indices.to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(named[1:] != named[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if held and (keys[a] != key or size >= SEGMENT):
                rows.append(emit())
            key, part = keys[a], where
            often = np.repeat(np.arange(a, b), n[a:b])
            one = code[often]
            again = np.ones(len(often), bool)
            again[np.cumsum(n[a:b]) - n[a:b]] = ~new[a:b]
            one = np.where(again & (one & BLANK == 0), one & 3 | DUPLICATE, one).astype(np.uint8)
            held.append(one.tobytes())
            size += len(one)
            turns.append(np.unique(turn[a:b][known[a:b]]))
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
    if held:
        yield pa.record_batch([pa.array([c], t) for c, t in zip(emit(), kinds)], names)


def _plans(batches) -> Iterator[pa.RecordBatch]:
    legal = np.zeros((4, 4), bool)
    legal[[1, 2, 3], [2, 3, 2]] = True
    names, kinds = [f.split()[0] for f in PLAN.split(", ")], [pa.string(), *[pa.int64()] * 6, pa.string()]
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            keys, codes, rows = [], [], []
            for key, parts in zip(*(batch.column(c).slice(at, 4096).to_pylist() for c in ("key", "parts"))):
                one = np.frombuffer(b"".join(p["codes"] for p in parts), np.uint8)
                known = [p for p in parts if p["distinct"]]
                gaps = known[-1]["last"] - known[0]["first"] + 1 - sum(p["distinct"] for p in known) if known else 0
                gaps += sum(p["last"] == q["first"] for p, q in zip(known, known[1:]))
                keys.append(key)
                codes.append(one)
                initial = one & 3
                rows.append([gaps, *(int((one & flag > 0).sum()) for flag in (BLANK, DUPLICATE, TRUNCATED)), int((~legal[initial[:-1], initial[1:]]).sum())])
            full = [[key, *row, cost, audit.decode()] for key, row, (cost, audit) in zip(keys, rows, solve(codes))]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*full), kinds)], names)


def _plan(turns: DataFrame) -> DataFrame:
    facts, counted = _facts(turns)
    ordered = facts.orderBy("key", "known", "turn", "role", "sum").withColumn("part", F.spark_partition_id())
    segments = materialize(ordered.mapInArrow(_segments, SEGMENTS))
    release(counted)
    whole = segments.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("part", "seq", "codes", "first", "last", "distinct"))).alias("parts"))
    out = materialize(whole.mapInArrow(_plans, PLAN))
    release(segments)
    return out


def plan(df: DataFrame) -> DataFrame:
    """Per conversation with rows: gaps, blank, duplicate, truncated, illegal, cost and audit, by ``key``."""
    return _plan(_turns(df))


def _sorted(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """Every conversation's plan, then its turns in order, in one partition for each conversation."""
    blank = {c: F.lit(None).cast(t) for c, t in (("known", "boolean"), ("turn", "long"), ("role", "string"), ("text", "string"), ("sum", "binary"))}
    heads = plans.select("key", F.lit(0).alias("kind"), *(v.alias(c) for c, v in blank.items()), F.struct(*[c for c in plans.columns if c != "key"]).alias("plan"))
    rows = turns.select("key", F.lit(1).alias("kind"), "known", "turn", "role", "text", "sum", F.lit(None).cast(heads.schema["plan"].dataType).alias("plan"))
    return heads.unionByName(rows).repartition("key").sortWithinPartitions("key", "kind", "known", "turn", "role", "sum").select("key", "kind", "turn", "known", "role", "text", "plan")


def _repaired(batches) -> Iterator[tuple]:
    """(key, plan) at each conversation's start, then (None, edit, role, text, turn) for each turn of the repaired one."""
    audit, at, state = "", 0, 0
    inserted = lambda: (None, "I", ("user", "assistant")[state == 3], "", None)

    def inserts():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            at, state = at + 1, int(NEXT[state])
            yield inserted()

    for batch in batches:
        for key, kind, turn, known, role, text, own in zip(*(c.to_pylist() for c in batch.columns)):
            if kind == 0:
                yield from inserts()
                yield key, own
                audit, at, state = own["audit"], 0, 0
                continue
            yield from inserts()
            edit, at = audit[at], at + 1
            if edit == "D":
                continue
            if edit == "K":
                state = int(KEPT["sua".index(role[0]) + 1, state])
            else:
                state = int(NEXT[state])
                role = ("user", "assistant")[state == 3]
            yield None, edit, role, text, turn if known else None
    yield from inserts()


def repaired(df: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, position, edit (I, K or R), role, text, and the turn that a row came from."""
    turns = _turns(df)

    def task(batches):
        key, n, rows = None, 0, []
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
        make = lambda: pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["key", "position", "edit", "role", "text", "turn"])
        for found in _repaired(batches):
            if found[0] is not None:
                key, n = found[0], 0
                continue
            rows.append((key, n, *found[1:]))
            n += 1
            if len(rows) == 1000:
                yield make()
                rows = []
        if rows:
            yield make()

    out = _sorted(turns, _plan(turns)).mapInArrow(task, "key string, position long, edit string, role string, text string, turn long")
    return out.select(F.expr("try_cast(key AS long)").alias("conv_id"), "position", "edit", "role", "text", "turn")


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def summary(df: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Counts, cost, audit and digest of each conversation of ``df``, and zeros for other conv_ids of ``ids``."""
    turns = _turns(df)
    plans = _plan(turns)
    if ids is not None:
        every = ids.select(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("key")).distinct()
        plans = every.join(plans, "key", "left").select("key", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in COUNTS), F.coalesce("audit", F.lit("")).alias("audit"))

    def task(batches):
        rows, own, digest, first = [], None, None, True
        kinds = [pa.string(), *[pa.int64()] * 6, pa.string(), pa.string()]
        make = lambda: pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["key", *COUNTS, "audit", "repaired_sha256"])
        for found in chain(_repaired(batches), [("", None)]):
            if found[0] is None:
                digest.update(f"{'' if first else chr(10)}{found[2]}:{found[3]}".encode())
                first = False
                continue
            if own:
                rows.append((own[0], *(own[1][c] for c in COUNTS), own[1]["audit"], digest.hexdigest()))
            own, digest, first = found if found[1] else None, hashlib.sha256(), True
            if len(rows) == 1000:
                yield make()
                rows = []
        if rows:
            yield make()

    out = _sorted(turns, plans).mapInArrow(task, PLAN + ", repaired_sha256 string")
    return out.select(F.expr("try_cast(key AS long)").alias("conv_id"), *COUNTS, "audit", "repaired_sha256")


def damage(df: DataFrame) -> DataFrame:
    """Conversations with faults put in by a checksum of conv_id and turn: five of twenty values change a row."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = df.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), h.alias("h")).where("h <> 0")
    words = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), words.alias("text"), F.when(F.col("h") == 3, 2).otherwise(1).alias("n"))
    return rows.withColumn("n", F.explode(F.array_repeat(F.lit(1), F.col("n")))).drop("n")


def query(spark, sf_dir: str) -> DataFrame:
    from tracelake.llm._io import table

    rows = table(spark, sf_dir, "conversations")
    return summary(damage(rows), rows.select("conv_id"))


def _sql() -> str:
    """States (start, after s, u, a) as a list of the least (cost, audit, repaired text), turn by turn."""
    add = lambda s, cost, edit, words: f"CASE WHEN {s} IS NOT NULL THEN {{'c': {s}.c + {cost}, 'a': {s}.a || '{edit}', 't': {s}.t || CASE WHEN {s}.t = '' THEN '' ELSE chr(10) END || {words}}} END"
    drop = lambda s: f"CASE WHEN {s} IS NOT NULL THEN {{'c': {s}.c + 2, 'a': {s}.a || 'D', 't': {s}.t}} END"
    stays = lambda s, role: f"CASE WHEN fault IN (0, 3) THEN {add(s, '1 + 5 * (fault = 3)::INT', 'R', f"""'{role}:' || text""")} END"
    keeps = lambda s, x: f"CASE WHEN fault IN (0, 3) AND x = '{x}' THEN {add(s, '5 * (fault = 3)::INT', 'K', "role || ':' || text")} END"
    to_user = [1, 2, 4]
    edits = [drop("s[1]"), f"list_min([{drop('s[2]')}, {keeps('s[1]', 's')}])"]
    edits.append(f"list_min([{', '.join([drop('s[3]')] + [f(f's[{i}]', y) for i in to_user for f, y in ((stays, 'user'), (keeps, 'u'))])}])")
    edits.append(f"list_min([{drop('s[4]')}, {stays('s[3]', 'assistant')}, {keeps('s[3]', 'a')}])")
    user = ", ".join(add(f"e[{i}]", 5, "I", "'user:'") for i in to_user)
    insert = lambda s: f"SELECT k, pos, [e[1], e[2], list_min([e[3], {user}]), list_min([e[4], {add('e[3]', 5, 'I', chr(39) + 'assistant:' + chr(39))}])] AS e FROM ({s})"
    none = "NULL::STRUCT(c INTEGER, a VARCHAR, t VARCHAR)"
    start = f"SELECT k, 0::BIGINT AS pos, [{{'c': 0, 'a': '', 't': ''}}, {none}, {none}, {none}] AS e FROM (SELECT DISTINCT k FROM f)"
    turn = f"SELECT f.k, f.pos, [{', '.join(edits)}] AS e FROM g JOIN f ON f.k = g.k AND f.pos = g.pos + 1"
    return rf"""
WITH RECURSIVE crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) r(i))),
r AS (SELECT coalesce(conv_id::VARCHAR, ' ') AS k, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS w FROM conversations),
h AS (SELECT k, turn, role, text, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, 2 * strlen(w)::BIGINT, 2), lambda i: ('0x' || substr(hex(encode(w)), i, 2))::BIGINT)), lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1])), 4294967295) % 20 AS h FROM r, crc),
d AS (SELECT k, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM h, range(CASE WHEN h = 3 THEN 2 ELSE 1 END) WHERE h <> 0),
o AS (SELECT *, row_number() OVER w AS pos, substr(role, 1, 1) AS x, lag(substr(role, 1, 1)) OVER w AS y, regexp_replace(text, '[ 	-
]+$', '') AS bare FROM d WINDOW w AS (PARTITION BY k ORDER BY turn NULLS FIRST, role, md5(role || chr(0) || text))),
f AS MATERIALIZED (SELECT *, CASE WHEN bare = '' THEN 1 WHEN row_number() OVER (PARTITION BY k, role, text ORDER BY pos) > 1 THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM o),
g AS ({insert(insert(start)).replace(' AS e FROM', ' AS s FROM', 1)} UNION ALL {insert(insert(turn)).replace(' AS e FROM', ' AS s FROM', 1)}),
b AS (SELECT k, list_min([s[1], s[4]]) AS best FROM (SELECT k, arg_max(s, pos) AS s FROM g GROUP BY k)),
c AS (SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pos > 1 AND y || x NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY k)
SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(best.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, ' ') AS k FROM conversations) i LEFT JOIN c USING (k) LEFT JOIN b USING (k)
"""


SQL = _sql()
