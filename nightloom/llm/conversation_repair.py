"""Repair of conversations: the cheapest edits after which role initials read `(s?(ua)+)?`, found by layers of cost.

A layer holds, for every turn, the set of grammar states from which the rest can be accepted at exactly that cost, as
bits. Layers are built for increasing cost, each from those below it (a kept turn stays in its layer, other edits come from
the layer their price below). The first layer with the start state in its first set gives the cost; a walk forward over the
bits, taking the ASCII-least edit that still reaches the end at what is left to pay, gives the least audit. In every state
one of `u` and `a` is allowed, so an audit fixes all roles.

Four end states are kept side by side, four bits each. That lets a long conversation (over DIRECT turns) be cut into blocks:
a block's layers give its price from each state to each, prices are added up from the last block to the first, and the
walk goes from the first to the last, so that work grows with turns and not with turns times cost. Conversations with the
same sequence of turn kinds share one search.

Rows are dealt by conversation and sorted in Spark; a task reads them as a stream and holds one conversation at a time,
as its repaired text is one string. One conversation is therefore the unit that must fit a task.

Defined results: a null conv_id or turn is one space in the damage key and a null role or text becomes one space; all rows
with a null conv_id are one conversation, with a null conv_id in the result; rows of one turn are ordered by role, then text;
an empty role is no role that can be kept; very long texts and conversations are whole; repeated rows are
duplicates; an empty table has no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightloom.llm import common as C
from nightloom.llm.importance import CRC_SQL, crc_sql

#: Prices of edits and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Grammar states by number, and for a role class (1 s, 2 u, 3 a): the states it may follow, as bits; it leads to the state of its number.
START, S, U, A = range(4)
AFTER = {S: 1 << START, U: 1 << START | 1 << S | 1 << A, A: 1 << U}
FOUR, SAME = 0x1111, 0x8421
#: Turns that are searched in one piece, and turns of a block beyond that.
DIRECT, BLOCK = 512, 64
#: Bits of a turn's kind beside its role class.
MUST_GO, CUT_OFF, GONE = 4, 8, 16
NEVER = 1 << 60


def _before(states: int, role: int) -> int:
    """The states from which a turn of this role leads into `states`, for all four ends."""
    return (states >> role & FOUR) * AFTER[role]


def _layers(kinds: bytes, last: bool, enough) -> list[list[int]]:
    """layers[cost][turn]; built until enough(first sets so far) or nothing new can come. Turns are inserted after the
    last one only where `last`, as the next block inserts before its first."""
    n = len(kinds)
    steps = [(k & 3, k & MUST_GO, TRUNCATED if k & CUT_OFF else 0) for k in kinds]
    out: list[list[int]] = []
    for cost in range(DELETE * n + 3 * INSERT + 1):
        row = [0] * (n + 1)
        gone = out[cost - DELETE] if cost >= DELETE else None
        more = out[cost - INSERT] if cost >= INSERT else None
        out.append(row)
        if cost == 0:
            row[n] = SAME
        elif more and last:
            row[n] = _before(more[n], U) | _before(more[n], A)
        for i in range(n - 1, -1, -1):
            role, must, extra = steps[i]
            x = gone[i + 1] if gone else 0
            if not must and cost >= extra:
                if role:
                    x |= _before(out[cost - extra][i + 1], role)
                if cost > extra:
                    y = out[cost - extra - REROLE][i + 1]
                    x |= _before(y, U) | _before(y, A)
            if more:
                x |= _before(more[i], U) | _before(more[i], A)
            row[i] = x
        if enough(row[0]):
            break
    return out


def _prices(layers: list[list[int]]) -> list[list[int]]:
    """prices[state][end]: the least cost from the first turn to each end."""
    out = [[NEVER] * 4 for _ in range(4)]
    for cost, row in enumerate(layers):
        for bit in range(16):
            if row[0] >> bit & 1:
                out[bit & 3][bit >> 2] = min(out[bit & 3][bit >> 2], cost)
    return out


def _walk(kinds: bytes, layers: list[list[int]], state: int, left: int, after: list[int], last: bool) -> tuple[str, int, int]:
    """The least audit from `state` with `left` to pay; after[e] is what is paid beyond end e. Gives also the end and what is left."""
    audit, i, n = [], 0, len(kinds)

    def reaches(i: int, state: int, left: int) -> bool:
        return any(0 <= left - after[e] < len(layers) and layers[left - after[e]][i] >> (4 * e + state) & 1 for e in range(4))

    while i < n or (last and left != after[state]):
        turn = U if state != U else A
        if i < n and reaches(i + 1, state, left - DELETE):
            audit.append("D")
            i, left = i + 1, left - DELETE
            continue
        if (i < n or last) and reaches(i, turn, left - INSERT):
            audit.append("I")
            state, left = turn, left - INSERT
            continue
        role, extra = kinds[i] & 3, TRUNCATED if kinds[i] & CUT_OFF else 0
        if role and AFTER[role] >> state & 1 and reaches(i + 1, role, left - extra):
            audit.append("K")
            i, state, left = i + 1, role, left - extra
        else:
            audit.append("R")
            i, state, left = i + 1, turn, left - extra - REROLE
    return "".join(audit), state, left


@functools.lru_cache(1 << 16)
def least_edits(kinds: bytes) -> tuple[int, str]:
    """(cost, audit) for a conversation's turn kinds: a role class, plus MUST_GO and CUT_OFF."""
    accept = [0, NEVER, NEVER, 0]
    if len(kinds) <= DIRECT:
        layers = _layers(kinds, True, lambda first: first & (1 | 1 << 4 * A))
        return len(layers) - 1, _walk(kinds, layers, START, len(layers) - 1, accept, True)[0]
    blocks = [kinds[i : i + BLOCK] for i in range(0, len(kinds), BLOCK)]
    after = [accept]  # what is paid beyond the end of each block, from the last block on
    for k in range(len(blocks) - 1, -1, -1):
        prices = _prices(_layers(blocks[k], k == len(blocks) - 1, lambda first: first == 0xFFFF))
        after.append([min(p + a for p, a in zip(prices[s], after[-1], strict=True)) for s in range(4)])
    after.reverse()
    cost = left = after[0][START]
    state, audit = START, []
    for k, block in enumerate(blocks):
        last = k == len(blocks) - 1
        layers = _layers(block, last, lambda first: first == 0xFFFF)
        part, state, left = _walk(block, layers, state, left, after[k + 1], last)
        audit.append(part)
    return cost, "".join(audit)


OUT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired string"
_ROLE = {U: "user", A: "assistant"}
_CLASS = {"s": S, "u": U, "a": A}
_LEGAL = {"su", "ua", "au"}


def _repair(turns: list, kinds: list[int], roles: list[str], texts: list[str]) -> tuple:
    """One conversation's row, without its id. Rows are in order; kinds say what is blank or cut off."""
    seen, counts, codes = set(), [0, 0, 0], bytearray()
    for kind, role, text in zip(kinds, roles, texts, strict=True):
        first = 0 if kind & MUST_GO else 1 if (role, text) in seen else 2 if kind & CUT_OFF else None
        seen.add((role, text))
        if first is not None:
            counts[first] += 1
        codes.append(kind & 3 | (MUST_GO if first in (0, 1) else CUT_OFF if first == 2 else 0))
    known = {t for t in turns if t is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    illegal = sum(a[:1] + b[:1] not in _LEGAL for a, b in zip(roles, roles[1:], strict=False))
    cost, audit = least_edits(bytes(codes))
    lines, state, i = [], START, 0
    for edit in audit:
        turn = U if state != U else A
        if edit == "I":
            lines.append(_ROLE[turn] + ":")
            state = turn
            continue
        if edit == "K":
            state = codes[i] & 3
            lines.append(f"{roles[i]}:{texts[i]}")
        elif edit == "R":
            state = turn
            lines.append(f"{_ROLE[turn]}:{texts[i]}")
        i += 1
    return gaps, *counts, illegal, cost, audit, "\n".join(lines)


def repair(rows: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired (its text, `role:text` a line).

    rows: conv_id, turn, role, text, and optionally gone (true: the conversation is known by this row, but the row is not there)."""
    gone = F.coalesce(F.col("gone").cast("boolean"), F.lit(False)) if "gone" in rows.columns else F.lit(False)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    plain = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), gone.alias("gone"))
    bare, initial = C.strip_blanks(F.col("text")), F.substring("role", 1, 1)
    kind = (
        F.when(initial == "s", S).when(initial == "u", U).when(initial == "a", A).otherwise(0)
        + F.when(bare == "", MUST_GO).otherwise(0) + F.when(F.right(bare, F.lit(1)).isin(".", "!", "?"), 0).otherwise(CUT_OFF) + F.when(F.col("gone"), GONE).otherwise(0)
    )
    dealt = plain.select("conv_id", "turn", "role", "text", kind.cast("int").alias("kind")).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def whole(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of some whole conversations."""
        columns = [pa.chunked_array([p.column(k) for p in parts]).to_pylist() for k in range(5)]
        out, a = [], 0
        ids = columns[0]
        for b in range(1, len(ids) + 1):
            if b == len(ids) or ids[b] != ids[a]:
                there = [i for i in range(a, b) if not columns[4][i] & GONE]
                out.append((ids[a], *_repair(*([columns[k][i] for i in there] for k in (1, 4, 2, 3)))))
                a = b
        yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, r, strict=True)) for r in out], schema=_SCHEMA)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the conversation that is not complete yet
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, tail = batch.column(0), batch.num_rows - 1
            open_id = ids[tail].as_py()
            while tail > 0 and ids[tail - 1].as_py() == open_id:
                tail -= 1
            if held and (tail > 0 or held[0].column(0)[0].as_py() != open_id):
                yield from whole([*held, batch.slice(0, tail)])
                held = []
            elif tail > 0:
                yield from whole([batch.slice(0, tail)])
            held.append(batch.slice(tail))
        if held:
            yield from whole(held)

    return dealt.mapInArrow(stream, OUT)


_NAMES = [c.split()[0] for c in OUT.split(", ")]
_SCHEMA = pa.schema([(n, pa.string() if n in ("audit", "repaired") else pa.int64()) for n in _NAMES])


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: a table of conversations with faults planted by the crc32 of `conv_id:turn` modulo 20:
    0 the row goes, 1 its text is emptied, 2 it loses its sentence ends, 3 it stands twice, 4 its role is user."""
    key = F.concat(*(F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(":") for c in ("conv_id", ":", "turn")))
    code = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    coded = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), code.alias("code"))
    changed = coded.select(
        "conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("code") == 0).alias("gone"), F.when(F.col("code") == 3, 2).otherwise(1).alias("copies"),
    )
    return changed.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).drop("copy", "copies")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repair(damage(C.table(spark, sf_dir, "conversations")))
    return out.select(*_NAMES[:-1], F.sha2(F.encode("repaired", "UTF-8"), 256).alias("repaired_sha256"))


ORACLE = rf"""
WITH RECURSIVE {CRC_SQL},
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS code
  FROM conversations, crc_table),
c AS (SELECT conv_id, row_number() OVER () AS cid FROM (SELECT DISTINCT conv_id FROM conversations)),
d AS (SELECT cid, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM k JOIN c ON k.conv_id IS NOT DISTINCT FROM c.conv_id, LATERAL (SELECT unnest(range(CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)))),
o AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, role, text) AS i, trim(text, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)) AS bare FROM d),
f AS (SELECT cid, i, turn, role, text, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY cid, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  i > 1 AND lag(left(role, 1)) OVER (PARTITION BY cid ORDER BY i) || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal FROM o),
ins(s, t, x) AS (VALUES (0, 0, ''), (0, 2, 'I'), (0, 3, 'II'), (1, 1, ''), (1, 2, 'I'), (1, 3, 'II'), (2, 2, ''), (2, 3, 'I'), (3, 3, ''), (3, 2, 'I')),
edit(s, role, t, e, price) AS (SELECT s, NULL::VARCHAR, s, 'D', {DELETE} FROM range(4) r(s) UNION ALL SELECT s, NULL::VARCHAR, CASE s WHEN 2 THEN 3 ELSE 2 END, 'R', {REROLE} FROM range(4) r(s)
  UNION ALL VALUES (0, 's', 1, 'K', 0), (0, 'u', 2, 'K', 0), (1, 'u', 2, 'K', 0), (3, 'u', 2, 'K', 0), (2, 'a', 3, 'K', 0)),
b AS (SELECT cid, 0::BIGINT AS i, 0 AS s, {{'cost': 0::BIGINT, 'audit': ''}} AS best FROM c
  UNION ALL
  SELECT b.cid, b.i + 1, e.t::INTEGER, min({{'cost': (b.best.cost + {INSERT} * length(n.x) + e.price + CASE WHEN fault = 'truncated' AND e.e <> 'D' THEN {TRUNCATED} ELSE 0 END)::BIGINT, 'audit': b.best.audit || n.x || e.e}})
  FROM b JOIN f ON f.cid = b.cid AND f.i = b.i + 1 JOIN ins n ON n.s = b.s JOIN edit e ON e.s = n.t AND (e.role IS NULL OR e.role = left(f.role, 1)) AND (e.e = 'D' OR fault NOT IN ('blank', 'duplicate'))
  GROUP BY b.cid, b.i + 1, e.t),
z AS (SELECT b.cid, min({{'cost': (b.best.cost + {INSERT} * length(n.x))::BIGINT, 'audit': b.best.audit || n.x}}) AS best
  FROM b JOIN ins n ON n.s = b.s AND n.t IN (0, 3) LEFT JOIN (SELECT cid, count(*) AS n FROM f GROUP BY cid) q ON q.cid = b.cid WHERE b.i = coalesce(q.n, 0) GROUP BY b.cid),
p AS (SELECT cid, pos, substr(best.audit, pos::INTEGER, 1) AS e FROM (SELECT cid, best, unnest(range(1, length(best.audit) + 1)) AS pos FROM z)),
w AS (SELECT *, sum((e <> 'I')::INT) OVER (PARTITION BY cid ORDER BY pos) AS i, sum((e <> 'D')::INT) OVER (PARTITION BY cid ORDER BY pos) AS j FROM p),
y AS (SELECT w.cid, pos, e, j, f.role, f.text, bool_or(e = 'K' AND j = 1 AND left(f.role, 1) = 's') OVER (PARTITION BY w.cid) AS system FROM w LEFT JOIN f ON f.cid = w.cid AND f.i = w.i),
l AS (SELECT cid, string_agg(CASE e WHEN 'K' THEN role || ':' || text ELSE CASE WHEN (j % 2 = 1) <> coalesce(system, false) THEN 'user:' ELSE 'assistant:' END || CASE e WHEN 'R' THEN text ELSE '' END END, chr(10) ORDER BY pos) AS repaired
  FROM y WHERE e <> 'D' GROUP BY cid),
g AS (SELECT cid, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, (count(*) FILTER (WHERE fault = 'blank'))::BIGINT AS blank, (count(*) FILTER (WHERE fault = 'duplicate'))::BIGINT AS duplicate,
  (count(*) FILTER (WHERE fault = 'truncated'))::BIGINT AS truncated, (count(*) FILTER (WHERE illegal))::BIGINT AS illegal FROM f GROUP BY cid)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  z.best.cost AS cost, z.best.audit AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM c JOIN z USING (cid) LEFT JOIN g USING (cid) LEFT JOIN l USING (cid)
"""
