"""Repair of the turn structure of conversations by composition of weighted finite-state machines.

Three machines are composed. The input acceptor is a chain with one symbol for each row: the initial of its role and its
fault. The edit transducer has one state and turns a symbol into none (Delete), itself (Keep) or the initial of user or
assistant (Rerole), or makes one of these of nothing (Insert). The grammar acceptor takes `(s?(ua)+)?`. States of the
composition are pairs (rows read, grammar state), and their arcs are made when a state is visited. The weight of an arc
is (cost, label); weights add up component by component and compare by cost, then by label string.

The composition has no cycle of cost 0, so its states have an order in which shortest distances to the end follow from
each other, last row first. From a grammar state each label has one arc only, so the least label string among the cheapest
paths is read off by always taking the least label that keeps to the shortest distance.

Conversations of up to LONG_ROWS rows and LONG_BYTES bytes are exchanged by conversation and settled one after another.
A longer one (it may hold a third of all rows) is dealt out in its order over many tasks. Each part's costs from
grammar state to grammar state are a matrix of 4 by 4; matrices of a conversation multiply (with min and +) to the distances behind
each part, then parts trace their labels from each of the four states, and the states at their borders choose one
trace. Equal rows of such a conversation collapse to one with a count before that, and whether an equal row came earlier
is found by aggregation. Only what the result holds as one value is made in one task: the digest of a
conversation is a chain through its text, which is streamed.

Defined results: null roles and texts are one space; rows come by turn, null turns first, equal turns by role and text (its first 256
characters, then its MD5); null
conversation ids are one conversation; repeated rows are duplicates; a conversation without rows has an empty report; an
empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewise.llm._common import cut

LONG_ROWS = 5_000
LONG_BYTES = 1 << 26
#: Long conversations up to which their ids are broadcast, at some 20 bytes each.
BROADCAST_IDS = 100_000

#: Costs of edits, and of a truncated row that stays.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: The grammar: start, after system, after user, after assistant. Next states by initial, and the states that may be last.
START, SYSTEM, USER, ASSISTANT = range(4)
GRAMMAR = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
LAST = (START, ASSISTANT)
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
WHOLE, CUT_OFF, GONE = range(3)  # what a row's fault means for its edits: none, dearer if it stays, must be deleted

_NEVER = 1 << 60
_WHITE = " \t\n\x0b\x0c\r"
Costs = tuple[int, ...]
Arc = tuple[str, int, int, str]  # label, next grammar state, cost, initial of what is written


# the composition


def reading_arcs(state: int, initial: str, kind: int) -> Iterator[Arc]:
    """Arcs of the composition that read a row, least label first."""
    yield "D", state, DELETE, ""
    if kind != GONE:
        dearer = TRUNCATED if kind == CUT_OFF else 0
        if (state, initial) in GRAMMAR:
            yield "K", GRAMMAR[state, initial], dearer, initial
        for written in ROLES:
            if (state, written) in GRAMMAR:
                yield "R", GRAMMAR[state, written], REROLE + dearer, written


def inserting_arcs(state: int) -> Iterator[Arc]:
    """Arcs that read nothing."""
    for written in ROLES:
        if (state, written) in GRAMMAR:
            yield "I", GRAMMAR[state, written], INSERT, written


_INSERTS = [list(inserting_arcs(q)) for q in range(4)]
_READS = {(i, k): [list(reading_arcs(q, i, k)) for q in range(4)] for i in ("s", "u", "a", "") for k in range(3)}
Unit = tuple[str, int, int]  # initial ("" if the grammar has none such), kind, number of rows; of several, all are GONE


def closed(costs: Costs) -> Costs:
    """Distances if rows may be inserted first."""
    out = list(costs)
    for _ in range(3):  # no path inserts more than three rows in a place and is cheapest
        for q, arcs in enumerate(_INSERTS):
            for _, to, cost, _ in arcs:
                out[q] = min(out[q], cost + out[to])
    return tuple(out)


END = closed(tuple(0 if q in LAST else _NEVER for q in range(4)))


def distances(units: list[Unit], after: Costs) -> list[Costs]:
    """Shortest distances before each unit, and after the last one."""
    found = [after]
    for initial, kind, n in reversed(units):
        behind = found[-1]
        if kind == GONE:
            found.append(tuple(n * DELETE + c for c in behind))
        else:
            found.append(closed(tuple(min(cost + behind[to] for _, to, cost, _ in arcs) for arcs in _READS[initial, kind])))
    return found[::-1]


def trace(units: list[Unit], after: Costs, state: int, last: bool) -> tuple[list[tuple[str, str]], int]:
    """The (label, what is written) of the cheapest edits with the least labels from a grammar state on, and the state reached.

    Of a unit of several rows there is one label, D. last: no row follows, so rows may be inserted behind the last one.
    """
    far = distances(units, after)
    path, i = [], 0
    while True:
        rest = far[i][state]
        if i == len(units):
            if not last or (state in LAST and rest == 0):
                return path, state
            arcs = iter(_INSERTS[state])
            label, to, cost, written = next(a for a in arcs if a[2] + far[i][a[1]] == rest)
        else:
            initial, kind, n = units[i]
            if n * DELETE + far[i + 1][state] == rest:
                label, to, written = "D", state, ""
            else:
                found = next((a for a in _INSERTS[state] if a[2] + far[i][a[1]] == rest), None)
                found = found or next(a for a in _READS[initial, kind][state] if a[2] + far[i + 1][a[1]] == rest)
                label, to, _, written = found
        path.append((label, written))
        state = to
        i += label != "I"


def _matrix(units: list[Unit]) -> list[int]:
    """Costs through the units from each state (rows) to each state (columns)."""
    ways = [distances(units, tuple(0 if q == e else _NEVER for q in range(4)))[0] for e in range(4)]
    return [min(ways[e][q], _NEVER) for q in range(4) for e in range(4)]


# rows


def damaged(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) with faults put in by the CRC-32 of `conv_id:turn`, modulo 20.

    0 drops the row, 1 empties its text, 2 takes out its full stops, exclamation and question marks, 3 repeats it, 4 makes it the user's.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = (F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20).alias("draw")
    drawn = rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), draw).where("draw <> 0")
    text = F.when(F.col("draw") == 1, F.lit("")).when(F.col("draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("draw") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    role = F.when(F.col("draw") == 4, F.lit("user")).otherwise(F.col("role"))
    return drawn.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_")).drop("_")


def _prepared(rows: DataFrame) -> DataFrame:
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    end = F.right(F.rtrim(text, F.lit(_WHITE)), F.lit(1))
    kind = F.when(end == "", GONE).when(end.isin(".", "!", "?"), WHOLE).otherwise(CUT_OFF)
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"), kind.alias("kind"))


def _order() -> list[Column]:
    """Rows of a conversation: what takes part is short, so that borders of ranges are."""
    return [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.left(F.col("text"), F.lit(256)).asc(), F.md5(F.col("text")).asc()]


def _initial(role: str) -> str:
    return role[:1] if role[:1] in ("s", "u", "a") else ""


_LINE = "struct<at:long,turn:long,role:string,text:string,edit:string>"
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_LINE_TYPE = pa.list_(pa.struct([("at", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())]))


def _mended(rows: list[tuple]) -> tuple:
    """Counts, audit and repaired lines of one conversation's ordered rows (turn, role, text, kind)."""
    seen, units, n = set(), [], [0, 0, 0]
    for _, role, text, kind in rows:
        fault = 0 if kind == GONE else 1 if (role, text) in seen else 2 if kind == CUT_OFF else None
        if fault is not None:
            n[fault] += 1
        seen.add((role, text))
        units.append((_initial(role), GONE if fault in (0, 1) else kind, 1))
    illegal = sum(a[1][:1] + b[1][:1] not in LEGAL for a, b in zip(rows, rows[1:], strict=False))
    turns = {r[0] for r in rows if r[0] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    path, _ = trace(units, END, START, True)
    lines, left = [], iter(rows)
    for at, (label, written) in enumerate(path):
        turn, role, text, _ = (None, "", "", 0) if label == "I" else next(left)
        if label != "D":
            lines.append({"at": at, "turn": turn, "role": role if label == "K" else ROLES[written], "text": text, "edit": label})
    return gaps, *n, illegal, distances(units, END)[0][START], "".join(label for label, _ in path), lines


def _settled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation of rows sorted by conversation."""
    out: list[tuple] = []
    held: list[tuple] = []
    now: object = held  # equal to no id
    size = 0

    def batch_of() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        arrays = [pa.array(c, pa.int64()) for c in columns[:7]]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(columns[7], pa.string()), pa.array(columns[8], _LINE_TYPE)], ["conv_id", *_COUNTS, "audit", "lines"])

    for batch in batches:
        for conv, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if conv != now:
                if held:
                    out.append((now, *_mended(held)))
                if size > 1 << 23:
                    yield batch_of()
                    out, size = [], 0
                held, now = [], conv
            held.append(tuple(row))
            size += len(row[2]) + 100
    if held:
        out.append((now, *_mended(held)))
    if out:
        yield batch_of()


_SETTLED = f"conv_id long, {', '.join(f'{c} long' for c in _COUNTS)}, audit string, lines array<{_LINE}>"


def _same(a: DataFrame, b: DataFrame, *keys: str) -> Column:
    on = a[keys[0]].eqNullSafe(b[keys[0]])
    for k in keys[1:]:
        on &= a[k].eqNullSafe(b[k])
    return on


# long conversations


def _parts(rows: DataFrame) -> DataFrame:
    """Distinct rows of long conversations in order, numbered (part, at), with n copies; again: an equal role and text came before."""
    same = F.md5(F.concat(F.md5(F.col("role")), F.md5(F.col("text"))))
    once = rows.groupBy("conv_id", "turn", "role", "text", "kind").agg(F.count(F.lit(1)).alias("n")).withColumn("same", same)
    when = F.struct(F.col("turn").isNotNull().alias("some"), "turn")
    firsts = once.groupBy("conv_id", "same").agg(F.min(when).alias("first"))
    known = once.join(firsts, _same(once, firsts, "conv_id", "same"), "left").select(once["*"], (when != F.col("first")).alias("again"))
    dealt = known.repartitionByRange(*_order()).sortWithinPartitions(*_order())
    return cut(dealt.drop("same").withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))


def _units(initial: str, kind: int, n: int, again: bool) -> list[Unit]:
    if kind == GONE or again:
        return [(initial, GONE, n)]
    return [(initial, kind, 1)] + ([(initial, GONE, n - 1)] if n > 1 else [])


def _part_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each conversation of a part: its units, costs and counts."""
    names = ["conv_id", "part", "initials", "kinds", "runs", "matrix", "head", "tail", "counts"]
    held, now, part = [], object(), 0

    def row() -> pa.RecordBatch:
        units, n = [], [0, 0, 0, 0]
        for k, (role, kind, copies, again) in enumerate(held):
            units += _units(_initial(role), kind, copies, again)
            stays = kind != GONE and not again
            n[0] += copies * (kind == GONE)
            n[1] += (copies - stays) * (kind != GONE)
            n[2] += stays and kind == CUT_OFF
            n[3] += copies - 1 + (k > 0 and held[k - 1][0][:1] + role[:1] not in LEGAL)
        values = [now, part, "".join(u[0] or "-" for u in units), bytes(u[1] for u in units), np.array([u[2] for u in units], "<i8").tobytes(), _matrix(units), held[0][0][:1], held[-1][0][:1], n]
        types = [pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.string(), pa.string(), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)

    for batch in batches:
        for conv, in_part, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and conv != now:
                yield row()
                held = []
            held.append(tuple(rest))
            now, part = conv, in_part
    if held:
        yield row()


def _unpacked(initials: str, kinds: bytes, runs: bytes) -> list[Unit]:
    return [(i.strip("-"), k, n) for i, k, n in zip(initials, kinds, np.frombuffer(runs, "<i8").tolist(), strict=True)]


def _behind(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, part, after, last) for each part of a row's conversation: distances behind it."""
    for batch in batches:
        for conv, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            after, out = END, []
            for k, p in enumerate(reversed(parts)):
                out.append((conv, p["part"], list(after), k == 0))
                after = tuple(min(p["matrix"][4 * q + e] + after[e] for e in range(4)) for q in range(4))
            arrays = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["conv_id", "part", "after", "last"])


def _traced(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, part, exits, labels, written, audits): what comes of each state at a part's beginning; labels has one for each unit, audits for each row."""
    for batch in batches:
        for conv, part, initials, kinds, runs, after, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            units = _unpacked(initials, kinds, runs)
            ways = [trace(units, tuple(after), q, last) for q in range(4)]
            row = [conv, part, [to for _, to in ways], ["".join(x for x, _ in path) for path, _ in ways], ["".join(w or "-" for _, w in path) for path, _ in ways], []]
            for path, _ in ways:
                left = iter(units)
                row[5].append("".join(label if label == "I" else label * next(left)[2] for label, _ in path))
            types = [pa.int64(), pa.int32(), pa.list_(pa.int32()), *[pa.list_(pa.string())] * 3]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], ["conv_id", "part", "exits", "labels", "written", "audits"])


def _entered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, part, enter): the state at each part's beginning."""
    for batch in batches:
        for conv, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            state, states = START, []
            for p in parts:
                states.append(state)
                state = p["exits"][state]
            n = len(parts)
            yield pa.RecordBatch.from_arrays([pa.array([conv] * n, pa.int64()), pa.array([p["part"] for p in parts], pa.int32()), pa.array(states, pa.int32())], ["conv_id", "part", "enter"])


def _written(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired rows, of rows sorted by part, conversation and at; at -1 brings the part's labels."""
    labels: list[str] = []
    for batch in batches:
        out = []
        for conv, part, at, turn, role, text, kind, n, again, found, written in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at < 0:
                labels, writes, now = list(found), list(written), 0
                own: list[Unit | None] = [None]
            else:
                own = list(_units(_initial(role), kind, n, again))
            sub, end = 0, at < 0
            while own or end:
                if now < len(labels) and labels[now] == "I":  # rows put in before this one, or before the first
                    out.append((conv, part, at, sub, None, ROLES[writes[now]], "", "I"))
                    now += 1
                elif end or not own:
                    break
                else:
                    own.pop(0)
                    label = labels[now]
                    if label != "D":
                        out.append((conv, part, at, sub, turn, role if label == "K" else ROLES[writes[now]], text, label))
                    now += 1
                    end = not own  # what is put in behind it
                sub += 1
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string()]
        arrays = [pa.array([r[k] for r in out], t) for k, t in enumerate(types)]
        yield pa.RecordBatch.from_arrays(arrays, ["conv_id", "part", "at", "sub", "turn", "role", "text", "edit"])


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, repaired_sha256) of lines sorted by conversation."""
    now, state = None, None
    ids, digests = [], []
    for batch in batches:
        for conv, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if state is None or conv != now:
                if state is not None:
                    ids.append(now)
                    digests.append(state.hexdigest())
                now, state = conv, hashlib.sha256()
                state.update(line.encode())
            else:
                state.update(b"\n" + line.encode())
    if state is not None:
        ids.append(now)
        digests.append(state.hexdigest())
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.string())], ["conv_id", "repaired_sha256"])


def _by_conversation(df: DataFrame, fields: list[str], body: Callable, schema: str) -> DataFrame:
    """body over one row for each conversation with its parts in order: as many as there are tasks, at most."""
    return df.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", *fields))).alias("parts")).mapInArrow(body, schema)


def _long(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts and audits of long conversations, and their repaired rows."""
    parts = _parts(rows)
    packed = cut(parts.select("conv_id", "part", "role", "kind", "n", "again").mapInArrow(_part_rows, "conv_id long, part int, initials string, kinds binary, runs binary, matrix array<long>, head string, tail string, counts array<long>"))
    after = cut(_by_conversation(packed, ["matrix"], _behind, "conv_id long, part int, after array<long>, last boolean"))
    both = packed.join(after, _same(packed, after, "conv_id", "part")).select(packed["conv_id"], packed["part"], "initials", "kinds", "runs", "after", "last")
    ways = cut(both.mapInArrow(_traced, "conv_id long, part int, exits array<int>, labels array<string>, written array<string>, audits array<string>"))
    enter = _by_conversation(ways, ["exits"], _entered, "conv_id long, part int, enter int")
    chosen = ways.join(enter, _same(ways, enter, "conv_id", "part")).select(ways["conv_id"], ways["part"], *(F.get(c, "enter").alias(c) for c in ("labels", "written", "audits")))
    columns = ["conv_id", "part", "at", "turn", "role", "text", "kind", "n", "again", "labels", "written"]
    chosen = cut(chosen)
    heads = chosen.withColumn("at", F.lit(-1).cast("long"))
    stream = parts.unionByName(heads, allowMissingColumns=True).select(*columns).repartition("part").sortWithinPartitions("part", F.asc_nulls_first("conv_id"), "at")
    lines = cut(stream.mapInArrow(_written, "conv_id long, part int, at long, sub int, turn long, role string, text string, edit string"))

    c = lambda k: F.sum(F.col("counts")[k])
    audits = chosen.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "audits"))).alias("pieces"))
    audits = audits.select("conv_id", F.array_join(F.col("pieces.audits"), "").alias("audit"))
    per_part = packed.groupBy("conv_id").agg(c(0).alias("blank"), c(1).alias("duplicate"), c(2).alias("truncated"), c(3).alias("inside"), F.sort_array(F.collect_list(F.struct("part", "head", "tail"))).alias("parts"))
    at_borders = F.aggregate(F.sequence(F.lit(2), F.size("parts")), F.lit(0).cast("long"), lambda n, k: n + (~F.concat(F.element_at("parts", k - 1)["tail"], F.element_at("parts", k)["head"]).isin(*LEGAL)).cast("long"))
    counts = per_part.withColumn("illegal", F.col("inside") + F.when(F.size("parts") > 1, at_borders).otherwise(0))
    turns = parts.groupBy("conv_id").agg(F.min("turn").alias("low"), F.max("turn").alias("high"))
    distinct = parts.where("turn IS NOT NULL").select("conv_id", "turn").distinct().groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("n_turns"), F.lit(0).cast("long"))
    turns = turns.join(distinct, _same(turns, distinct, "conv_id"), "left").select(turns["conv_id"], gaps.alias("gaps"))
    first = packed.join(after, _same(packed, after, "conv_id", "part")).select(packed["conv_id"], packed["part"], "matrix", "after")
    cost = first.groupBy("conv_id").agg(F.min_by("matrix", "part").alias("m"), F.min_by("after", "part").alias("v")).select("conv_id", F.array_min(F.zip_with(F.slice("m", 1, 4), "v", lambda x, y: x + y)).alias("cost"))
    counts = counts.join(turns, _same(counts, turns, "conv_id")).drop(turns["conv_id"])
    counts = counts.join(cost, _same(counts, cost, "conv_id")).drop(cost["conv_id"])
    counts = counts.join(audits, _same(counts, audits, "conv_id")).drop(audits["conv_id"])
    return counts.select("conv_id", *_COUNTS, "audit"), lines


# the operator


def _split(rows: DataFrame, long_rows: int, long_bytes: int) -> tuple[DataFrame, DataFrame | None]:
    """Settled conversations, and the rows of those that are too long for one task (None: there is none)."""
    ready = _prepared(rows)
    sizes = ready.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("size"))
    long = cut(sizes.where((F.col("n") > long_rows) | (F.col("size") > long_bytes)).select("conv_id"))
    n_long = long.count()
    picked = F.broadcast(long) if n_long <= BROADCAST_IDS else long
    short = ready.join(picked, _same(ready, picked, "conv_id"), "left_anti") if n_long else ready
    ordered = short.repartition("conv_id").sortWithinPartitions(*_order())
    settled = ordered.select("conv_id", "turn", "role", "text", "kind").mapInArrow(_settled, _SETTLED)
    return settled, ready.join(picked, _same(ready, picked, "conv_id"), "left_semi") if n_long else None


def repair(rows: DataFrame, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES) -> DataFrame:
    """The repaired rows (conv_id, part, at, sub, turn, role, text, edit): in each conversation in order of part, at and sub.

    edit: K kept, R with another role, I put in, with an empty text and no turn.
    """
    settled, rest = _split(rows, long_rows, long_bytes)
    line = settled.select("conv_id", F.explode("lines").alias("x"))
    out = line.select("conv_id", F.lit(0).alias("part"), "x.at", F.lit(0).alias("sub"), "x.turn", "x.role", "x.text", "x.edit")
    return out if rest is None else out.unionByName(_long(rest)[1])


def report(rows: DataFrame, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation that has rows."""
    settled, rest = _split(rows, long_rows, long_bytes)
    text = F.array_join(F.transform("lines", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    out = settled.select("conv_id", *_COUNTS, "audit", F.sha2(text, 256).alias("repaired_sha256"))
    if rest is None:
        return out
    counts, lines = _long(rest)
    kept = lines.select("conv_id", "part", "at", "sub", F.concat("role", F.lit(":"), "text").alias("line"))
    ordered = kept.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "part", "at", "sub")
    digests = ordered.select("conv_id", "line").mapInArrow(_hashed, "conv_id long, repaired_sha256 string")
    whole = counts.join(digests, _same(counts, digests, "conv_id"), "left")
    digest = F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))
    return out.unionByName(whole.select(counts["conv_id"], *_COUNTS, "audit", digest.alias("repaired_sha256")))


def report_all(ids: DataFrame, rows: DataFrame, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES) -> DataFrame:
    """The report of each conversation that ids (conv_id) names, those without rows included."""
    every, found = ids.select(F.col("conv_id").cast("long")).distinct(), report(rows, long_rows, long_bytes)
    values = [F.coalesce(found[c], F.lit(0).cast("long")).alias(c) for c in _COUNTS]
    texts = [F.coalesce(found["audit"], F.lit("")).alias("audit"), F.coalesce(found["repaired_sha256"], F.sha2(F.lit(""), 256)).alias("repaired_sha256")]
    return every.join(found, _same(every, found, "conv_id"), "left").select(every["conv_id"], *values, *texts)
