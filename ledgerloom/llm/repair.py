"""Repair of the turn order of conversations by Hirschberg's divide and conquer.

A repaired conversation is a list of role initials ``(s?(ua)+)?``.  Four states
follow it: nothing yet, after ``s``, after ``u``, after ``a``.  Edits and their
costs: Keep 0, Rerole to user or assistant 1, Delete 2, Insert an empty turn 5;
a truncated row that is not deleted costs 5 more, and blank rows and duplicates
must be deleted.  Of the cheapest edit strings the least in ASCII is taken.

Insertions are counted with the row they precede, so the edit strings of two
paths over the same rows are never each other's beginning: their order at any
row decides the order of whatever follows, and four ranks beside the four costs
are all that ties need.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import session, shuffle_partitions, table, written

# Costs of the edits and of a truncated row that stays.
COSTS = {"K": 0, "R": 1, "D": 2, "I": 5}
TRUNCATED_COST = 5
WHITE = " \t\n\v\f\r"
NONE = 1 << 60
#: Rows and characters of a segment, which is one stored row.
SEGMENT_ROWS = 4096
SEGMENT_CHARS = 1 << 20
# What a kind of row is: initial (other, s, u, a) + 4 * fault class.
INITIALS = {"s": 1, "u": 2, "a": 3}
STAYS, TRUNCATED, GOES = 0, 1, 2
#: The state that the next turn of the pattern leads to; it is after "u" or "a".
NEXT = (2, 2, 3, 2)
NAMES = {2: "user", 3: "assistant"}
#: What completes a conversation from each state.
TAILS = ("", "II", "I", "")

Vector = tuple[tuple[int, ...], tuple[int, ...]]


@cache
def steps(kind: int) -> tuple[tuple[int, int, str, int], ...]:
    """(from, to, edits, cost) of the ways past a row: insertions, then one edit of it."""
    initial, fault = kind % 4, kind // 4
    made = []
    for start in range(4):
        state, inserted = start, ""
        for _ in range(3):
            ways = [("D", state)]
            if fault != GOES:
                ways.append(("R", NEXT[state]))
                if initial == 1 and state == 0:
                    ways.append(("K", 1))
                elif initial and initial == NEXT[state]:
                    ways.append(("K", initial))
            for edit, to in ways:
                stays = TRUNCATED_COST if fault == TRUNCATED and edit != "D" else 0
                made.append((start, to, inserted + edit, sum(COSTS[e] for e in inserted + edit) + stays))
            state, inserted = NEXT[state], inserted + "I"
    return tuple(made)


def start_vector(state: int) -> Vector:
    return tuple(0 if s == state else NONE for s in range(4)), (0, 0, 0, 0)


def _less_least(costs: list[int]) -> tuple[int, tuple[int, ...]]:
    least = min(costs)
    return (least, tuple(c - least if c < NONE else NONE for c in costs)) if least < NONE else (0, tuple(costs))


@cache
def _ahead(kind: int, costs: tuple[int, ...], ranks: tuple[int, ...]) -> tuple[int, Vector]:
    best: list[tuple] = [(NONE, 9, "")] * 4
    for a, b, edits, cost in steps(kind):
        if costs[a] < NONE:
            best[b] = min(best[b], (costs[a] + cost, ranks[a], edits))
    order = sorted({x[1:] for x in best})
    least, rest = _less_least([x[0] for x in best])
    return least, (rest, tuple(order.index(x[1:]) for x in best))


@cache
def _back(kind: int, costs: tuple[int, ...]) -> tuple[int, tuple[int, ...]]:
    best = [NONE] * 4
    for a, b, _, cost in steps(kind):
        if costs[b] < NONE:
            best[a] = min(best[a], costs[b] + cost)
    return _less_least(best)


def forward(kinds: np.ndarray, lo: int, hi: int, vector: Vector) -> tuple[int, Vector]:
    """Costs (less their least, which comes first) and ranks of the best edits per state.

    Costs without their least differ by little, so few vectors occur, and a row
    is a lookup.
    """
    total = 0
    for kind in kinds[lo:hi].tolist():
        least, vector = _ahead(kind, *vector)
        total += least
    return total, vector


def backward(kinds: np.ndarray, lo: int, hi: int, state: int) -> tuple[int, ...]:
    """Costs per state, but for a constant, of the rest when it ends in ``state``."""
    costs = start_vector(state)[0]
    for kind in kinds[lo:hi][::-1].tolist():
        costs = _back(kind, costs)[1]
    return costs


def hirschberg(kinds: np.ndarray, lo: int, hi: int, start: int, end: int) -> Iterator[str]:
    """Edits of each row on the best way from ``start`` to ``end``, in linear space."""
    if hi - lo == 1:
        yield min((cost, edits) for a, b, edits, cost in steps(int(kinds[lo])) if (a, b) == (start, end))[1]
        return
    mid = (lo + hi) // 2
    costs, ranks = forward(kinds, lo, mid, start_vector(start))[1]
    rest = backward(kinds, mid, hi, end)
    crossing = min((costs[s] + rest[s], ranks[s], s) for s in range(4))[2]
    yield from hirschberg(kinds, lo, mid, start, crossing)
    yield from hirschberg(kinds, mid, hi, crossing, end)


def best_end(costs: list[int] | tuple[int, ...], ranks: list[int] | tuple[int, ...]) -> int:
    """The state in which a conversation ends best before its tail."""
    return min((costs[s] + COSTS["I"] * len(TAILS[s]), ranks[s], s) for s in range(4))[2]


def edits_of(kinds: np.ndarray, start: int, end: int | None, last: bool) -> list[str]:
    """Edits of a segment's rows; those of the last end with the conversation's tail."""
    if end is None:
        end = best_end(*forward(kinds, 0, len(kinds), start_vector(start))[1])
    made = list(hirschberg(kinds, 0, len(kinds), start, end))
    return made[:-1] + [made[-1] + TAILS[end]] if last else made


def repaired(edits: list[str], roles: list[str], texts: list[str], start: int) -> tuple[list[str], list[str], list[int]]:
    """Roles and texts after the edits, and the row that each comes from (-1: inserted)."""
    state, out = start, ([], [], [])

    def put(role: str, text: str, row: int) -> None:
        for column, value in zip(out, (role, text, row)):
            column.append(value)

    for row, ways in enumerate(edits):
        for edit in ways:
            if edit == "D":
                continue
            if edit == "K":
                state = INITIALS[roles[row][0]]
                put(roles[row], texts[row], row)
            else:
                state = NEXT[state]
                put(NAMES[state], texts[row] if edit == "R" else "", row if edit == "R" else -1)
    return out


SEGMENT = (
    "part int, seg int, turns array<bigint>, roles array<string>, texts array<string>, kinds array<tinyint>, faults string, digests array<binary>"
)


def _digest(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()


def segments(turns: DataFrame) -> DataFrame:
    """Rows ``id, turn, role, text`` sorted and packed into bounded segments.

    One range exchange by conversation, turn, role and text; rows that are
    alike in all are dealt out by a number, so neither a long conversation nor
    a repeated row gathers in one task.  Faults are known but for duplicates
    whose first occurrence is in another partition.  ``digests`` holds those of
    the rows that are the first of their kind in the partition.
    """
    spark = session(turns)
    keyed = turns.withColumns(
        {"k1": F.substring("role", 1, 64), "k2": F.substring("text", 1, 64), "k3": F.xxhash64("role", "text"), "k4": F.monotonically_increasing_id()}
    )
    order = ["id", "turn", "k1", "k2", "k3", "k4"]
    ranged = keyed.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).select("id", "turn", "role", "text")
    names = [ranged.schema["id"], *T.StructType.fromDDL(SEGMENT).fields]
    arrow = {"turns": pa.list_(pa.int64()), "roles": pa.list_(pa.string()), "texts": pa.list_(pa.string()), "kinds": pa.list_(pa.int8()), "digests": pa.list_(pa.binary())}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, seg, now, chars = TaskContext.get().partitionId(), set(), 0, None, 0
        held: dict[str, list] = {}

        def batch(kind: pa.DataType) -> pa.RecordBatch:
            columns = [pa.array([now], kind), pa.array([part], pa.int32()), pa.array([seg], pa.int32())]
            columns += [pa.array([held[n]], arrow[n]) for n in ("turns", "roles", "texts", "kinds")]
            return pa.RecordBatch.from_arrays([*columns, pa.array(["".join(held["faults"])]), pa.array([held["digests"]], arrow["digests"])], [f.name for f in names])

        for b in batches:
            for key, turn, role, text in zip(*(c.to_pylist() for c in b.columns)):
                fresh = not held or key != now
                if held and (fresh or len(held["kinds"]) == SEGMENT_ROWS or chars > SEGMENT_CHARS):
                    yield batch(b.schema.types[0])
                    seg, held, chars = (0 if fresh else seg + 1), {}, 0
                if fresh:
                    now, seen, seg = key, set(), 0
                if not held:
                    held = {n: [] for n in (*arrow, "faults")}
                body, mark = text.strip(WHITE), _digest(role, text)
                fault = "b" if not body else "d" if mark in seen else "t" if body[-1] not in ".!?" else "-"
                kind = INITIALS.get(role[:1], 0) + 4 * (GOES if fault in "bd" else TRUNCATED if fault == "t" else STAYS)
                for n, value in zip(("turns", "roles", "texts", "kinds", "faults", "digests"), (turn, role, text, kind, fault, None if mark in seen else mark)):
                    held[n].append(value)
                seen.add(mark)
                chars += len(text)
        if held:
            yield batch(b.schema.types[0])

    return written(ranged.mapInArrow(pack, T.StructType(names)), "turns")


def _joined_on(*pairs: tuple) -> F.Column:
    on = pairs[0][0].eqNullSafe(pairs[0][1])
    for a, b in pairs[1:]:
        on &= a == b
    return on


def far_duplicates(packed: DataFrame) -> DataFrame:
    """``(id, part, seg, far)``: rows whose first occurrence lies in an earlier partition.

    Only conversations over a partition's border are looked at, and of each
    kind of row one per partition, so no group exceeds the number of partitions.
    """
    ends = packed.groupBy("id").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select(F.col("id").alias("of"))
    rows = packed.join(ends, F.col("id").eqNullSafe(F.col("of")), "left_semi").select("id", "part", "seg", F.posexplode("digests").alias("row", "digest"))
    rows = rows.where("digest IS NOT NULL").withColumn("first", F.min("part").over(Window.partitionBy("id", "digest")))
    return rows.where("part > first").groupBy("id", "part", "seg").agg(F.collect_list("row").alias("far"))


def _kinds(row: dict) -> tuple[np.ndarray, str]:
    """Kinds and faults of a segment with its far duplicates; blank rows stay blank."""
    kinds, faults = np.array(row["kinds"], np.int64), list(row["faults"])
    for k in row["far"] or ():
        if faults[k] != "b":
            faults[k], kinds[k] = "d", kinds[k] % 4 + 4 * GOES
    return kinds, "".join(faults)


def routes(packed: DataFrame) -> DataFrame:
    """``(id, part, seg, start, end)`` for conversations of several segments.

    Each segment gives the costs and ranks from each state to each; these
    4 x 4 tables, a few per conversation, are streamed in order, the best
    predecessor of each state is kept, and the best way read backwards.
    """
    key_type = packed.schema["id"].dataType
    names = ["id", "part", "seg"]
    schema = T.StructType([T.StructField("id", key_type), *T.StructType.fromDDL("part int, seg int, costs array<bigint>, ranks array<int>").fields])

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            costs, ranks = [], []
            for row in b.to_pylist():
                kinds, _ = _kinds(row)
                made = [forward(kinds, 0, len(kinds), start_vector(s)) for s in range(4)]
                costs.append([least + c if c < NONE else NONE for least, (cs, _) in made for c in cs])
                ranks.append([r for _, (_, rs) in made for r in rs])
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(costs, pa.list_(pa.int64())), pa.array(ranks, pa.list_(pa.int32()))], schema.names)

    out = T.StructType([T.StructField("id", key_type), *T.StructType.fromDDL("part int, seg int, start tinyint, end tinyint, last boolean").fields])

    def through(rows: list[tuple]) -> list[tuple]:
        """The way of one conversation: its rows are (part, seg, costs, ranks)."""
        costs, ranks, came = [0, NONE, NONE, NONE], [0] * 4, []
        for _, _, c, r in rows:
            best = [min((min(costs[s] + c[4 * s + t], NONE), ranks[s], r[4 * s + t], s) for s in range(4)) for t in range(4)]
            order = sorted({x[1:3] for x in best})
            costs, ranks = [x[0] for x in best], [order.index(x[1:3]) for x in best]
            came.append(bytes(x[3] for x in best))
        end, way = best_end(costs, ranks), []
        for k in reversed(range(len(rows))):
            way.append((*rows[k][:2], came[k][end], end, k == len(rows) - 1))
            end = came[k][end]
        return way

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = ((b.schema.types[0], r) for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        for (kind, key), group in itertools.groupby(stream, lambda x: (x[0], x[1][0])):
            way = through([r[1:] for _, r in group])
            columns = [pa.array([key] * len(way), kind)]
            columns += [pa.array(c, t) for c, t in zip(zip(*way), (pa.int32(), pa.int32(), pa.int8(), pa.int8(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays(columns, out.names)

    made = packed.select("id", "part", "seg", "kinds", "faults", "far").mapInArrow(tables, schema)
    return made.repartition("id").sortWithinPartitions("id", "part", "seg").mapInArrow(follow, out)


REPAIRED = (
    "part int, seg int, audit string, cost bigint, n_rows bigint, faults string, initials string, turns array<bigint>, "
    "roles array<string>, texts array<string>, rows array<int>"
)


def repair_conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Conversations edited at least cost into ``(s?(ua)+)?``, a row per segment.

    ``(id, part, seg, audit, cost, n_rows, faults, initials, turns, roles,
    texts, rows)``: segments of a conversation in order of ``part, seg``, with
    their part of the edit string, a fault per row (``b``lank, ``d``uplicate,
    ``t``runcated or ``-``), the turns of its rows, and the repaired turns with
    the row they come from (-1: inserted).  ``repaired_turns`` gives them one
    by one, ``repair_report`` a row per conversation.

    Rows are taken by turn, null turns first, then role and text (their first 64
    characters, then a hash).  Null ids are one conversation, null roles and
    texts one space; repeated rows are duplicates; an empty table gives no
    rows; other columns are not read.  The rows move once, in a range exchange
    that cuts long conversations as well, are stored once in the shared
    folder, and a task holds one segment (``SEGMENT_ROWS`` rows at most) of them.
    """
    clean = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col(id_col).alias("id"), F.col(turn_col).cast("long").alias("turn"), clean(role_col).alias("role"), clean(text_col).alias("text"))
    packed = segments(rows)
    keys = packed.select("id", "part", "seg", "kinds", "faults", "digests")
    far = written(far_duplicates(keys), "duplicates")
    far_of = far.select(F.col("id").alias("f_id"), F.col("part").alias("f_part"), F.col("seg").alias("f_seg"), "far")
    on_far = lambda d: _joined_on((d["id"], F.col("f_id")), (d["part"], F.col("f_part")), (d["seg"], F.col("f_seg")))
    several = packed.groupBy("id").count().where("count > 1").select(F.col("id").alias("of"))
    narrow = packed.select("id", "part", "seg", "kinds", "faults")
    long_ = narrow.join(several, F.col("id").eqNullSafe(F.col("of")), "left_semi")
    way = routes(long_.join(far_of, on_far(long_), "left").drop("f_id", "f_part", "f_seg"))
    known = way.join(far_of, on_far(way), "left").select(
        F.col("id").alias("w_id"), F.col("part").alias("w_part"), F.col("seg").alias("w_seg"), "start", "end", "last", "far"
    )
    # far duplicates lie in conversations of several segments
    joined = packed.drop("digests").join(
        written(known, "ways"), _joined_on((packed["id"], F.col("w_id")), (packed["part"], F.col("w_part")), (packed["seg"], F.col("w_seg"))), "left"
    )
    joined = joined.drop("w_id", "w_part", "w_seg")
    schema = T.StructType([packed.schema["id"], *T.StructType.fromDDL(REPAIRED).fields])

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made: list[tuple] = []
            for row in b.to_pylist():
                kinds, faults = _kinds(row)
                start = row["start"] or 0
                edits = edits_of(kinds, start, row["end"], row["last"] is not False)
                roles, texts, sources = repaired(edits, row["roles"], row["texts"], start)
                stays = sum(f == "t" and "D" not in e for f, e in zip(faults, edits))
                audit = "".join(edits)
                cost = sum(COSTS[e] for e in audit) + TRUNCATED_COST * stays
                initials = "".join(r[0] if r else "." for r in row["roles"])
                made.append((audit, cost, len(kinds), faults, initials, row["turns"], roles, texts, sources))
            kinds_ = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int32()))
            columns = zip(*made) if made else [()] * 9
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("part"), b.column("seg"), *(pa.array(c, t) for c, t in zip(columns, kinds_))], schema.names)

    return joined.mapInArrow(edit, schema).withColumnRenamed("id", id_col)


def repaired_turns(edited: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """``(id, part, seg, position, role, text, row)``: the repaired turns one by one."""
    return edited.select(id_col, "part", "seg", F.posexplode(F.arrays_zip("roles", "texts", "rows")).alias("position", "t")).select(
        id_col, "part", "seg", "position", F.col("t.roles").alias("role"), F.col("t.texts").alias("text"), F.col("t.rows").alias("row")
    )


REPORT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
LEGAL = ("su", "ua", "au")


def repair_report(edited: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """A row per conversation: gaps in its turns, faults, illegal neighbours, cost, audit, digest.

    The segments of a conversation are streamed in order through one task,
    which keeps sums, the digest's state and the edit string: a SHA-256 of a
    whole conversation cannot be put together from parts.
    """
    rows = edited.select(F.col(id_col).alias("id"), "part", "seg", "audit", "cost", "faults", "initials", "turns", "roles", "texts")
    schema = T.StructType([rows.schema["id"], *T.StructType.fromDDL(REPORT).fields])

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = ((b.schema.types[0], r) for b in batches for r in b.to_pylist())
        for key, group in itertools.groupby(stream, lambda r: r[1]["id"]):
            faults, illegal, cost, audit, sha, before = dict.fromkeys("bdt", 0), 0, 0, [], hashlib.sha256(), ""
            low, high, distinct, separator = None, None, 0, b""
            for kind, r in group:
                for f in faults:
                    faults[f] += r["faults"].count(f)
                initials = before + r["initials"]
                illegal += sum(initials[k : k + 2] not in LEGAL for k in range(len(initials) - 1))
                before = initials[-1:]
                for turn in r["turns"]:
                    if turn is not None and turn != high:
                        low, high, distinct = turn if low is None else low, turn, distinct + 1
                cost += r["cost"]
                audit.append(r["audit"])
                for role, text in zip(r["roles"], r["texts"]):
                    sha.update(separator + f"{role}:{text}".encode())
                    separator = b"\n"
            gaps = 0 if low is None else high - low + 1 - distinct
            values = (gaps, *faults.values(), illegal, cost)
            columns = [pa.array([key], kind), *(pa.array([v], pa.int64()) for v in values), pa.array(["".join(audit)]), pa.array([sha.hexdigest()])]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.repartition("id").sortWithinPartitions("id", "part", "seg").mapInArrow(report, schema).withColumnRenamed("id", id_col)


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with faults drawn by the CRC-32 of ``conv_id:turn`` (nulls: one space)."""
    clean = lambda c: f"coalesce(CAST({c} AS STRING), ' ')"
    drawn = turns.select("conv_id", "turn", F.expr(f"{clean('role')} AS role"), F.expr(f"{clean('text')} AS text"), F.expr(f"crc32(CAST(concat({clean('conv_id')}, ':', {clean('turn')}) AS BINARY)) % 20 AS draw"))
    return drawn.where("draw <> 0").select(
        "conv_id",
        "turn",
        F.expr("if(draw = 4, 'user', role) AS role"),
        F.expr("CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '') ELSE text END AS text"),
        F.expr("explode(if(draw = 3, array(1, 2), array(1))) AS copy"),
    ).drop("copy")


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    made = repair_report(repair_conversations(damaged(turns)))
    ids = turns.select(F.col("conv_id").alias("of")).distinct()
    empty = hashlib.sha256().hexdigest()
    values = {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": empty}
    joined = ids.join(made, F.col("of").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    return joined.select(F.col("of").alias("conv_id"), *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in values.items()])


OP13_SQL = r"""
WITH RECURSIVE
t(i, v, k) AS (SELECT range, range, 0 FROM range(256) UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM t WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS tab FROM t WHERE k = 8),
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
        FROM conversations),
drawn AS (SELECT src.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(key) + 1), lambda j: ascii(key[j])::BIGINT)),
                 lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % 20 AS draw FROM src, tab),
hurt AS (SELECT conv_id, turn, CASE draw WHEN 4 THEN 'user' ELSE role END AS role,
                CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                unnest(CASE draw WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM drawn WHERE draw <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n FROM hurt),
judged AS (SELECT *, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS body, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS seen,
                  role[1:1] AS g, lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM numbered),
faulty AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN seen THEN 'd' WHEN body[-1:] NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault
           FROM judged),
-- q0 to q3: cost and edits after nothing, s, u, a; p2, p3 after insertions too; far: a cost that no way reaches
walk(conv_id, n, q0, q1, q2, q3) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, {c: 0::BIGINT, a: ''}, {c: 1000000000000, a: ''}, {c: 1000000000000, a: ''}, {c: 1000000000000, a: ''} FROM hurt
  UNION ALL
  SELECT conv_id, n,
         {c: p0.c + 2, a: p0.a || 'D'},
         list_min([{c: p1.c + 2, a: p1.a || 'D'}, {c: p0.c + s + CASE WHEN g = 's' THEN 0 ELSE 1000000000000 END, a: p0.a || 'K'}]),
         list_min([{c: p2.c + 2, a: p2.a || 'D'}, {c: o.c + s + CASE WHEN g = 'u' THEN 0 ELSE 1000000000000 END, a: o.a || 'K'}, {c: o.c + s + 1, a: o.a || 'R'}]),
         list_min([{c: p3.c + 2, a: p3.a || 'D'}, {c: p2.c + s + CASE WHEN g = 'a' THEN 0 ELSE 1000000000000 END, a: p2.a || 'K'}, {c: p2.c + s + 1, a: p2.a || 'R'}])
  FROM (SELECT *, list_min([p0, p1, p3]) AS o FROM
         (SELECT w.conv_id, f.n, f.g, CASE f.fault WHEN 't' THEN 5 WHEN '-' THEN 0 ELSE 1000000000000 END AS s, q0 AS p0, q1 AS p1,
                 list_min([q2, {c: q0.c + 5, a: q0.a || 'I'}, {c: q1.c + 5, a: q1.a || 'I'}, {c: q3.c + 5, a: q3.a || 'I'}]) AS p2,
                 list_min([q3, {c: q2.c + 5, a: q2.a || 'I'}, {c: q0.c + 10, a: q0.a || 'II'}, {c: q1.c + 10, a: q1.a || 'II'}]) AS p3
          FROM walk w JOIN faulty f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND f.n = w.n + 1))),
counted AS (SELECT conv_id, max(n) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank,
                   count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
                   count(*) FILTER (WHERE n > 1 AND before || g NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id),
ended AS (SELECT c.*, list_min([q0, q3, {c: q2.c + 5, a: q2.a || 'I'}, {c: q1.c + 10, a: q1.a || 'II'}]) AS best
          FROM counted c JOIN walk w ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.n),
edits AS (SELECT conv_id, i, best.a[i:i] AS e, i - length(replace(best.a[1:i], 'I', '')) AS inserted FROM (SELECT *, unnest(range(1, length(best.a) + 1)) AS i FROM ended)),
stays AS (SELECT e.conv_id, e.i, e.e, CASE e.e WHEN 'K' THEN f.role END AS kept, CASE e.e WHEN 'I' THEN '' ELSE f.text END AS text,
                 row_number() OVER (PARTITION BY e.conv_id ORDER BY e.i) AS pos
          FROM edits e LEFT JOIN faulty f ON e.conv_id IS NOT DISTINCT FROM f.conv_id AND e.e <> 'I' AND f.n = e.i - e.inserted WHERE e.e <> 'D'),
named AS (SELECT *, (pos - CASE WHEN first_value(kept[1:1]) OVER (PARTITION BY conv_id ORDER BY pos) = 's' THEN 1 ELSE 0 END) % 2 AS odd FROM stays),
done AS (SELECT conv_id, string_agg(coalesce(kept, CASE odd WHEN 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY pos) AS body FROM named GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost,
       coalesce(best.a, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN ended e ON o.conv_id IS NOT DISTINCT FROM e.conv_id
LEFT JOIN done d ON o.conv_id IS NOT DISTINCT FROM d.conv_id
"""
