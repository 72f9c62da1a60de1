r"""Conversation structure repair by run-length dynamic programming.

The turns of a conversation should read `(s?(ua)+)?` by the initials of their roles. The cheapest edits that get there are
found over symbols, one per turn (its role and its first fault). Runs of equal symbols are collapsed; a symbol moves the
costs of the four grammar states by a min-plus matrix, whose binary powers are cached, so a run costs as many products
as its length has bits. From the costs to go, known at the end of every run, the choices of each turn are unrolled, the
least letter first, which gives the audit.

Min-plus products are associative, so a conversation of any length is cut into segments: each becomes one matrix, a
backward pass over the matrices gives the costs to go at the end of each segment, and a forward pass over the sorted turns
unrolls segment by segment, with one segment in memory. No turn text is held beyond its segment.

Symbols: a turn that is blank (no `[^\x20\x09-\x0D]`) or repeats role and text of an earlier turn must be deleted; one whose
last such character is not `[.!?]` is truncated. Edits and costs: Keep 0, Rerole to user or assistant 3, Delete 4, Insert an
empty user or assistant turn 3; a truncated turn that is not deleted adds 3.

Defined cases: null roles and texts count as one space, an empty role is as unknown as a space. Turns are taken by turn
number (nulls first), turns of one number by role, then by the digest of role and text. Turns without a conversation id are
a conversation of their own. A conversation without turns needs no edits. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import chain, groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from veil.functions.exprs import join_groups
from veil.llm.common import ship, stored, table
from veil.llm.places import numbered

#: Turns of a segment.
SEGMENT = 4096
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
INF = 1 << 50
#: Grammar states: nothing yet, after s, after u, after a; what a role leads to, and the role that may be made up in a state.
STEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
MADE = ("user", "user", "assistant", "user")
ENDS = (0, INF, INF, 0)
STATES = range(4)
#: A symbol is GONE (must be deleted), or the role's initial and whether the turn is truncated.
GONE = "-"
BLANKS = "".join(map(chr, (32, *range(9, 14))))

Matrix = tuple[tuple[int, ...], ...]


def product(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(a[i][k] + b[k][j] for k in STATES) for j in STATES) for i in STATES)


def applied(m: Matrix, costs: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(min(m[i][k] + costs[k] for k in STATES) for i in STATES)


def made(state: int) -> int:
    return STEP[state][MADE[state][0]]


@cache
def insertions() -> Matrix:
    rows = []
    for state in STATES:
        costs, at, spent = [INF] * 4, state, 0
        while costs[at] == INF:
            costs[at] = spent
            at, spent = made(at), spent + INSERT
        rows.append(tuple(costs))
    return tuple(rows)


def edit_cost(symbol: str, edit: str) -> int:
    extra = TRUNCATED if symbol[1:] == "t" else 0
    return {"D": DELETE, "K": KEEP + extra, "R": REROLE + extra}[edit]


def target(symbol: str, state: int, edit: str) -> int | None:
    """State after an edit of a turn, if the grammar allows it."""
    if edit == "D":
        return state
    if symbol == GONE:
        return None
    return STEP[state].get(symbol[0]) if edit == "K" else made(state)


@cache
def power(symbol: str, k: int) -> Matrix:
    """Transition of 2^k turns of one symbol: any insertions, then the edit of the turn, each time."""
    if k:
        half = power(symbol, k - 1)
        return product(half, half)
    rows = [[INF] * 4 for _ in STATES]
    for state in STATES:
        for edit in "DKR":
            to = target(symbol, state, edit)
            if to is not None:
                rows[state][to] = min(rows[state][to], edit_cost(symbol, edit))
    return product(insertions(), tuple(map(tuple, rows)))


@cache
def run_matrix(symbol: str, n: int) -> Matrix:
    out = None
    for k in range(n.bit_length()):
        if n >> k & 1:
            out = power(symbol, k) if out is None else product(out, power(symbol, k))
    return out


def runs(symbols: list[str]) -> list[tuple[str, int]]:
    return [(s, sum(1 for _ in g)) for s, g in groupby(symbols)]


def transition(symbols: list[str]) -> Matrix:
    """The matrix of a segment, run by run."""
    out = None
    for symbol, n in runs(symbols):
        m = run_matrix(symbol, n)
        out = m if out is None else product(out, m)
    return out


def at_end() -> tuple[int, ...]:
    """Costs to go after the last turn."""
    return applied(insertions(), ENDS)


def inserted(state: int, to_go: tuple[int, ...]) -> bool:
    return INSERT + to_go[made(state)] == to_go[state]


def unroll(symbols: list[str], state: int, to_go: tuple[int, ...]) -> tuple[list[list[tuple[str, str | None]]], int]:
    """Per turn its edits (letter, role that is made up), the least letters among the cheapest, and the state after the segment.

    `to_go` are the costs to go after the segment.
    """
    after = [to_go]
    ends = [to_go]  # costs at the borders of runs come from powers, those inside a run from one step each
    for symbol, n in reversed(runs(symbols)):
        costs = ends[-1]
        for _ in range(n - 1):
            costs = applied(power(symbol, 0), costs)
            after.append(costs)
        ends.append(applied(run_matrix(symbol, n), ends[-1]))
        after.append(ends[-1])
    after.reverse()  # after[i]: before turn i
    out = []
    for i, symbol in enumerate(symbols):
        edits, now, then = [], after[i], after[i + 1]
        while True:
            for edit in "DIKR":
                if edit == "I":
                    if inserted(state, now):
                        edits.append(("I", MADE[state]))
                        state = made(state)
                        break
                else:
                    to = target(symbol, state, edit)
                    if to is not None and edit_cost(symbol, edit) + then[to] == now[state]:
                        edits.append((edit, MADE[state] if edit == "R" else None))
                        state = to
                        break
            if edits[-1][0] != "I":
                break
        out.append(edits)
    return out, state


def closing(state: int) -> list[tuple[str, str]]:
    """Insertions after the last turn."""
    out, to_go = [], at_end()
    while to_go[state]:
        out.append(("I", MADE[state]))
        state = made(state)
    return out


def initial(role: Column) -> Column:
    first = F.left(role, F.lit(1))
    return F.when(first.isin("s", "u", "a"), first).otherwise("x")


def turns(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, turn, role, text, pos, segment, fault, symbol): turns in order, each with its first fault."""
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    end = F.rtrim("text", F.lit(BLANKS))
    rows = rows.withColumns({
        "tail": F.right(end, F.lit(1)),
        "digest": F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256),
    })
    placed = numbered(rows, ["conv_id"], ["turn", "role", "digest"], "turns").drop("group_size")
    firsts = placed.groupBy("conv_id", "digest").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    known = join_groups(placed, firsts, ["conv_id", "digest"], "left")
    fault = F.when(F.col("tail") == "", "blank").when(F.col("pos") > F.col("first"), "duplicate").when(~F.col("tail").isin(".", "!", "?"), "truncated")
    known = known.withColumn("fault", F.coalesce(fault, F.lit("")))
    letter = F.concat(initial(F.col("role")), F.when(F.col("fault") == "truncated", "t").otherwise(""))
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), GONE).otherwise(letter)
    return known.select("conv_id", "turn", "role", "text", "pos", F.expr(f"pos div {segment}").alias("segment"), "fault", symbol.alias("symbol"))


LEGAL = {"su", "ua", "au"}
COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")


def _groups(batches, *keys: str) -> Iterator[list[dict]]:
    """Neighbouring rows with equal keys."""
    held = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and any(row[k] != held[0][k] for k in keys):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 1 << 12) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, size)):
        yield pa.RecordBatch.from_pylist(some, schema=schema)


def _summary(rows: list[dict]) -> dict:
    """One row of a segment: its matrix, its counts, and its ends, which its neighbours need."""
    faults, initials, numbers = ([r[c] for r in rows] for c in ("fault", "initial", "turn"))
    numbers = [t for t in numbers if t is not None]
    return {
        "conv_id": rows[0]["conv_id"], "segment": rows[0]["segment"], "matrix": [c for row in transition([r["symbol"] for r in rows]) for c in row],
        **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])), "turns": len(set(numbers)),
        "first": initials[0], "last": initials[-1], "low": numbers[0] if numbers else None, "high": numbers[-1] if numbers else None,
    }


def _costs_to_go(segments: list[dict]) -> Iterator[dict]:
    """Totals of a conversation on each of its segments, with the costs to go after the segment."""
    to_go, after = at_end(), []
    for s in reversed(segments):
        after.append(list(to_go))
        m = s["matrix"]
        to_go = applied(tuple(tuple(m[4 * i : 4 * i + 4]) for i in STATES), to_go)
    totals = {c: sum(s[c] for s in segments) for c in COUNTS}
    for a, b in zip(segments, segments[1:]):
        totals["illegal"] += a["last"] + b["first"] not in LEGAL
        totals["turns"] -= a["high"] is not None and a["high"] == b["low"]
    low, high = (next((s[c] for s in order if s[c] is not None), None) for c, order in (("low", segments), ("high", segments[::-1])))
    totals |= {"gaps": 0 if low is None else high - low + 1 - totals.pop("turns"), "cost": to_go[0]}
    for s, costs in zip(segments, reversed(after)):
        yield {"conv_id": s["conv_id"], "segment": s["segment"], "to_go": costs, **totals}


def _schema(like: DataFrame, ddl: str) -> StructType:
    return StructType([StructField("conv_id", like.schema["conv_id"].dataType), *StructType.fromDDL(ddl).fields])


MEASURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def planned(conversations: DataFrame, segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """Turns with the costs to go after their segment, and the measures of each conversation."""
    ship(conversations.sparkSession)
    rows = turns(conversations, segment)
    counts = ", ".join(f"{c} long" for c in COUNTS)
    shape = _schema(rows, f"segment long, matrix array<long>, {counts}, first string, last string, low long, high long")
    narrow = rows.select("conv_id", "segment", "pos", "turn", "fault", "symbol", initial(F.col("role")).alias("initial"))
    ends = _schema(rows, f"segment long, to_go array<long>, {', '.join(f'{c} long' for c in MEASURES)}")
    shape_, ends_ = to_arrow_schema(shape), to_arrow_schema(ends)

    def summaries(batches):
        return _batches(map(_summary, _groups(batches, "conv_id", "segment")), shape_)

    def costs(batches):
        return _batches(chain.from_iterable(map(_costs_to_go, _groups(batches, "conv_id"))), ends_)

    # sorted streams, not one call a conversation: most conversations are a few turns
    keys = ["conv_id", "segment"]
    parts = stored(narrow.repartition(*keys).sortWithinPartitions(*keys, "pos").mapInArrow(summaries, shape), "segments")
    segments = stored(parts.repartition("conv_id").sortWithinPartitions(*keys).mapInArrow(costs, ends), "costs")
    joined = join_groups(rows, segments.select("conv_id", "segment", "to_go"), ["conv_id", "segment"])
    return joined, segments.where("segment = 0").drop("segment", "to_go")


def _lines(batches) -> Iterator[tuple[object, bool, list[tuple[str, str | None, str]]]]:
    """(conversation, whether it begins, its next edits as (letter, role or None, text)); a conversation's last item closes it."""
    last, state = None, 0
    for rows in _groups(batches, "conv_id", "segment"):
        conv = rows[0]["conv_id"]
        began = last is None or last[0] != conv
        if began:
            if last:
                yield last[0], False, [(e, r, "") for e, r in closing(state)]
            state = 0
        edits, state = unroll([r["symbol"] for r in rows], state, tuple(rows[0]["to_go"]))
        out = []
        for row, some in zip(rows, edits):
            for letter, role in some:
                out.append((letter, None if letter == "D" else role or row["role"], "" if letter == "I" else row["text"]))
        yield conv, began, out
        last = (conv,)
    if last:
        yield last[0], False, [(e, r, "") for e, r in closing(state)]


def _in_order(joined: DataFrame) -> DataFrame:
    chosen = joined.select("conv_id", "pos", "segment", "role", "text", "symbol", "to_go")
    return chosen.repartition("conv_id").sortWithinPartitions("conv_id", "pos")


BATCH = 4 << 20


def repaired_turns(joined: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the repaired conversations, and deleted turns as edits without a role."""
    schema = _schema(joined, "place long, edit string, role string, text string")
    type_ = to_arrow_schema(joined.select("conv_id").schema).field(0).type

    def run(batches):
        place = 0
        for conv, began, lines in _lines(batches):
            place = 0 if began else place
            n = len(lines)
            edits, roles, texts = zip(*lines) if lines else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array([conv] * n, type_), pa.array(range(place, place + n), pa.int64()), pa.array(edits, pa.string()), pa.array(roles, pa.string()), pa.array(texts, pa.string())],
                names=schema.names,
            )
            place += n

    return _in_order(joined).mapInArrow(run, schema)


def audits(joined: DataFrame) -> DataFrame:
    """(conv_id, audit, repaired_sha256) of every conversation, streamed: the digest of its `role:text` lines is carried along."""
    schema = _schema(joined, "audit string, repaired_sha256 string")
    type_ = to_arrow_schema(joined.select("conv_id").schema).field(0).type

    def run(batches):
        done, size, current = [], 0, None

        def batch():
            convs, letters, digests = zip(*done)
            return pa.RecordBatch.from_arrays([pa.array(convs, type_), pa.array(letters, pa.string()), pa.array(digests, pa.string())], names=schema.names)

        for conv, began, lines in _lines(batches):
            if began:
                if current:
                    done.append((current[0], "".join(current[1]), current[2].hexdigest()))
                    size += len(done[-1][1]) + 100
                    if size > BATCH:
                        yield batch()
                        done, size = [], 0
                current = [conv, [], hashlib.sha256(), False]
            current[1].append("".join(e for e, _, _ in lines))
            for letter, role, text in lines:
                if letter != "D":
                    current[2].update(f"{chr(10) if current[3] else ''}{role}:{text}".encode())
                    current[3] = True
        if current:
            done.append((current[0], "".join(current[1]), current[2].hexdigest()))
            yield batch()

    return _in_order(joined).mapInArrow(run, schema)


def repair_report(conversations: DataFrame, original: DataFrame | None = None, segment: int = SEGMENT) -> DataFrame:
    """Measures, audit and digest of each conversation; those of `original` (conv_id) without turns have none to repair."""
    joined, measures = planned(conversations, segment)
    found = join_groups(measures, audits(joined), ["conv_id"])
    if original is not None:
        found = join_groups(original.select("conv_id").distinct(), found, ["conv_id"], "left")
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return found.select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in MEASURES], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", empty).alias("repaired_sha256"),
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults that depend on conversation and turn: dropped, emptied, stripped of ends, repeated, given the role user."""
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    kind = F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")) % 20
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    hurt = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    rows = conversations.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), hurt.alias("text"), copies.alias("copies"))
    return rows.where("copies > 0").select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy")).drop("copy")


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damages all conversations and repairs them."""
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return repair_report(damaged(rows), rows)


def _moves() -> str:
    """Rows (symbol, state, letters, cost, next state, roles of insertions, role made up) of all insertions and one edit."""
    rows = []
    for symbol in (GONE, *(r + t for r in "suax" for t in ("", "t"))):
        for state in STATES:
            at, letters, roles = state, "", []
            for n in range(3):
                for edit in "DKR":
                    to = target(symbol, at, edit)
                    if to is not None:
                        kept = {"D": "NULL", "K": "''", "R": f"'{MADE[at]}'"}[edit]
                        lines = "".join(f"{r}:\n" for r in roles).replace("\n", "' || chr(10) || '")
                        rows.append(f"('{symbol}', {state}, '{letters}{edit}', {INSERT * n + edit_cost(symbol, edit)}, {to}, '{lines}', {kept})")
                letters, roles, at = letters + "I", [*roles, MADE[at]], made(at)
    return ", ".join(rows)


def _ends() -> str:
    """Rows (state, letters, cost, lines) of insertions that end a conversation."""
    rows = []
    for state in STATES:
        at, roles = state, []
        for n in range(3):
            if not ENDS[at]:
                lines = "".join(f"{r}:\n" for r in roles).replace("\n", "' || chr(10) || '")
                rows.append(f"({state}, '{'I' * n}', {INSERT * n}, '{lines}')")
            roles, at = [*roles, MADE[at]], made(at)
    return ", ".join(rows)


_KEY = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
#: crc32 of the key, eight steps a character: the first of them takes the character in.
_CRC = f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({_KEY}, ''),
     lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda s, c: xor(xor(s, c) >> 1, CASE WHEN xor(s, c) % 2 = 1 THEN 3988292384 ELSE 0 END)))"""
ORACLE = f"""
WITH RECURSIVE h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC} % 20 AS kind FROM conversations),
c AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
   CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
   unnest(CASE WHEN kind = 0 THEN [] WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM h),
e AS (SELECT *, sha256(strlen(role) || ':' || role || text) AS digest, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS tail FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, digest, copy) AS i FROM e),
f AS (SELECT *, CASE WHEN tail = '' THEN 'blank' WHEN i > min(i) OVER (PARTITION BY conv_id, digest) THEN 'duplicate' WHEN tail NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
   CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS initial FROM o),
g AS (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN '{GONE}' WHEN fault = 'truncated' THEN initial || 't' ELSE initial END AS symbol,
   lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM f),
m AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
   count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
   count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id),
moves(symbol, state, letters, cost, next, made, role) AS (VALUES {_moves()}),
ends(state, letters, cost, lines) AS (VALUES {_ends()}),
v AS (SELECT m.conv_id, m.n AS i, ends.state, (arg_min({{'c': ends.cost, 'a': ends.letters, 'l': ends.lines}}, (ends.cost, ends.letters))) AS best FROM m, ends GROUP BY ALL
  UNION ALL SELECT v.conv_id, v.i - 1, moves.state, arg_min({{'c': moves.cost + v.best.c, 'a': moves.letters || v.best.a,
     'l': moves.made || CASE WHEN moves.role IS NULL THEN '' ELSE CASE WHEN moves.role = '' THEN g.role ELSE moves.role END || ':' || g.text || chr(10) END || v.best.l}},
     (moves.cost + v.best.c, moves.letters || v.best.a))
   FROM v JOIN g ON v.conv_id IS NOT DISTINCT FROM g.conv_id AND v.i = g.i JOIN moves ON moves.symbol = g.symbol AND moves.next = v.state GROUP BY v.conv_id, v.i, moves.state),
r AS (SELECT conv_id, best FROM v WHERE i = 0 AND state = 0)
SELECT d.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(left(best.l, length(best.l) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN m ON d.conv_id IS NOT DISTINCT FROM m.conv_id LEFT JOIN r ON d.conv_id IS NOT DISTINCT FROM r.conv_id
"""
