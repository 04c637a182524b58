"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant in
turn, ending with the assistant. Each source turn is kept, relabelled, or merged
into the turn before; empty turns may be inserted. Dynamic programming over the
automaton of legal turns picks the cheapest repair.

States: B (nothing yet), S (after system), U (after user), A (after assistant).
The automaton's steps are matrices over (min, +), and these compose: turns are
cut into chunks by turn number, and each chunk gives one small matrix. The chunks
are dealt in order over the partitions, and those of one conversation in one
partition give one matrix again, at most one a partition; these are chained to
find the entry and exit state of each, then of each chunk, and a chunk takes its
best path between the two. So no conversation, however long, meets in one task;
turns are only read as (conversation, turn, role, empty or not) until the last
join. All chunks of a batch take their steps together, in numpy.

Result: one row per fragment, in the order (conv_id, turn, source_role, rid,
part), nulls first: role, action (keep, relabel, merge, insert), and rendered. A
fragment that opens a turn begins with the end mark of the turn before, if any,
and its own header; the last one of a conversation ends with the end mark. Joined
in order they are the repaired conversation.

Defined results: null or unknown roles cost a relabel; null text counts as
empty; turns are ordered by turn (null first), equal turns by role and a hash of
the row, in which rows alike in conversation, turn, role and text are numbered, so
that each is a turn; rows with a null conv_id form a conversation; an empty table
gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.groups import attach_groups
from quillon.llm.scratch import written

ROLES = ("system", "user", "assistant")
#: Costs of a repair.
RELABEL, MERGE, INSERT = 2.0, 1.0, 1.5
#: An empty turn costs next to nothing to merge away.
MERGE_EMPTY = 0.25
#: Source turns of one chunk, by turn number.
CHUNK = 64
#: Rows from which on a chunk is cut further, by turn, role and the leading bits of the row's hash.
CROWD = 1024
TAIL = "<|end|>\n"
B, S, U, A = range(4)
_OF = {"system": S, "user": U, "assistant": A}
_FAR = np.inf


def _moves():
    """(from, to, role taken or None for a merge, roles inserted before)."""
    out = []
    for start in (B, S, U, A):
        for role in (S, U, A):
            if role == S and start == B:
                out.append((start, S, S, ()))
            elif role == U and start in (B, S, A):
                out.append((start, U, U, ()))
            elif role == U and start == U:
                out.append((start, U, U, (A,)))
            elif role == A and start == U:
                out.append((start, A, A, ()))
            elif role == A and start in (B, S, A):
                out.append((start, A, A, (U,)))
        if start != B:
            out.append((start, start, None, ()))
    return out


MOVES = _moves()


def costs(role: str | None, empty: bool) -> list[float]:
    """What each move costs for a turn."""
    own, out = _OF.get(role), []
    for start, _, taken, before in MOVES:
        if taken is None:
            if start == own or empty:
                out.append(MERGE_EMPTY if empty else MERGE)
            else:
                out.append(MERGE + RELABEL)
        else:
            out.append((0.0 if taken == own else RELABEL) + INSERT * len(before))
    return out


_TABLE = {(r, e): costs(r, e) for r in (*ROLES, None) for e in (False, True)}


def step(role: str | None, empty: bool) -> np.ndarray:
    m = np.full((4, 4), _FAR)
    for (a, b, _, _), c in zip(MOVES, _TABLE[role if role in _OF else None, empty], strict=True):
        m[a, b] = min(m[a, b], c)
    return m


def product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x[:, :, None] + y[None]).min(axis=1)


#: What ending in a state costs: an assistant turn is put after a user's, and a user's and an assistant's after the system's.
END = {B: 0.0, S: 2 * INSERT, U: INSERT, A: 0.0}
_LAST = {S: (U, A), U: (A,)}


#: By code (place of the role, 3 for others, times 2, plus 1 if empty): the step's matrix, and each move's cost.
_CODES = [(r, e) for r in (*ROLES, None) for e in (False, True)]
_STEPS = np.stack([step(*c) for c in _CODES])
_COSTS = np.array([_TABLE[c] for c in _CODES])
_FROM, _TO = np.array([m[0] for m in MOVES]), np.array([m[1] for m in MOVES])


def sums(code: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The matrix of each chunk: rows first to first + size of ``code``."""
    m = np.where(np.eye(4, dtype=bool), 0.0, _FAR)[None].repeat(len(first), 0)
    for j in range(int(size.max(initial=0))):
        k = np.flatnonzero(size > j)
        m[k] = (m[k][:, :, :, None] + _STEPS[code[first[k] + j]][:, None]).min(axis=2)
    return m


def best_paths(code: np.ndarray, first: np.ndarray, size: np.ndarray, enter: np.ndarray, leave: np.ndarray) -> np.ndarray:
    """Per row the cheapest move (its place in MOVES), on the way of its chunk from one state to another; ties take the first move listed."""
    far = np.full((len(code) + 1, 4), _FAR)  # what the rest of the chunk costs from each state on
    goal = np.where(np.arange(4) == leave[:, None], 0.0, _FAR)
    longest = int(size.max(initial=0))
    for j in range(longest - 1, -1, -1):
        k = np.flatnonzero(size > j)
        row = first[k] + j
        after = np.where((size[k] == j + 1)[:, None], goal[k], far[row + 1])
        far[row] = (_STEPS[code[row]] + after[:, None]).min(axis=2)
    out, at = np.zeros(len(code), np.int64), enter.copy()
    for j in range(longest):
        k = np.flatnonzero(size > j)
        row = first[k] + j
        after = np.where((size[k] == j + 1)[:, None], goal[k], far[row + 1])
        price = np.where(_FROM == at[k][:, None], _COSTS[code[row]] + after[:, _TO], _FAR)
        out[row] = price.argmin(axis=1)
        at[k] = _TO[out[row]]
    return out


#: What tells a chunk: the conversation, the turns, and where those are crowded a segment in the same order.
KEYS = ("conv", "chunk", "seg")


#: Rows held at a time, beside those of one chunk.
HOLD = 1 << 16
_SEG = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("part", pa.int64())])
_KEY_SCHEMA = "conv string, chunk long, seg struct<turn:bigint,role:string,part:bigint>"


def _whole(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Tables of whole groups with the first row and size of each; ``key`` tells neighbouring groups apart."""
    held: list[pa.RecordBatch] = []

    def groups(table: pa.Table) -> np.ndarray:
        k = table.column(key).to_numpy()
        return np.concatenate(([0], np.flatnonzero(k[1:] != k[:-1]) + 1))

    rows = 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows > HOLD:
            table = pa.Table.from_batches(held).combine_chunks()
            first = groups(table)
            if len(first) > 1:
                last = int(first[-1])
                yield table.slice(0, last), first[:-1], np.diff(first)
                table = table.slice(last)
            held, rows = table.to_batches(), len(table)
    if rows:
        table = pa.Table.from_batches(held).combine_chunks()
        first = groups(table)
        yield table, first, np.diff(np.append(first, len(table)))


def _out(table: pa.Table) -> Iterator[pa.RecordBatch]:
    yield from table.combine_chunks().to_batches()


def _costs(m: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(np.minimum(m, 1e18).reshape(-1)), 16).cast(pa.list_(pa.float64()))


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table, first, size in _whole(batches, "ck"):
        m = sums(table.column("code").to_numpy(), first, size)
        yield from _out(table.select(KEYS).take(pa.array(first)).append_column("cost", _costs(m)))


def _read_costs(table: pa.Table) -> np.ndarray:
    return table.column("cost").combine_chunks().flatten().to_numpy().reshape(-1, 4, 4)


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One matrix for the chunks of a conversation in one partition."""
    for table, first, size in _whole(batches, "gk"):
        cost = _read_costs(table)
        m = np.where(np.eye(4, dtype=bool), 0.0, _FAR)[None].repeat(len(first), 0)
        for j in range(int(size.max(initial=0))):
            k = np.flatnonzero(size > j)
            m[k] = (m[k][:, :, :, None] + cost[first[k] + j][:, None]).min(axis=2)
        yield from _out(table.select(["conv", "pid"]).take(pa.array(first)).append_column("cost", _costs(m)))


def _chain(key: str, names: tuple[str, ...], given: bool):
    """Entry and exit state of each row (a matrix) of a group, in order. The group's own states are ``given`` in its rows, or its path starts and ends where a conversation does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first, size in _whole(batches, key):
            cost = _read_costs(table)
            n = len(cost)
            if given:
                enter, leave, close = (table.column(c).to_numpy(zero_copy_only=False) for c in ("enter", "leave", "last"))
                at = enter[first].astype(np.int64)
                goal = np.where(np.arange(4) == leave[first][:, None], 0.0, _FAR)
                close = close[first].astype(bool)
            else:
                at = np.full(len(first), B)
                goal = np.array([[END[s] for s in range(4)]]).repeat(len(first), 0)
                close = np.ones(len(first), bool)
            far = np.full((n + 1, 4), _FAR)
            longest = int(size.max(initial=0))
            enter_, leave_, last = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n, bool)
            for j in range(longest - 1, -1, -1):
                k = np.flatnonzero(size > j)
                row = first[k] + j
                after = np.where((size[k] == j + 1)[:, None], goal[k], far[row + 1])
                far[row] = (cost[row] + after[:, None]).min(axis=2)
            for j in range(longest):
                k = np.flatnonzero(size > j)
                row = first[k] + j
                after = np.where((size[k] == j + 1)[:, None], goal[k], far[row + 1])
                to = (cost[row, at[k]] + after).argmin(axis=1)
                enter_[row], leave_[row], last[row] = at[k], to, close[k] & (size[k] == j + 1)
                at[k] = to
            rest = {"enter": pa.array(enter_), "leave": pa.array(leave_), "last": pa.array(last)}
            out = table.select(names)
            for name, x in rest.items():
                out = out.append_column(name, x)
            yield from _out(out)

    return run


_NAME = {S: "system", U: "user", A: "assistant"}


_DECISION = "conv string, rid long, new_role string, action string, first boolean, before array<string>, after array<string>"
_ROLE_NAMES = pa.array([_NAME.get(s) for s in range(4)], pa.string())
_BEFORE = pa.array([[_NAME[b] for b in m[3]] for m in MOVES], pa.list_(pa.string()))
_AFTER = pa.array([[_NAME[b] for b in _LAST.get(s, ())] for s in range(4)], pa.list_(pa.string()))


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per source turn: its role, action, whether it is the first, and what is inserted before and after it."""
    merge = np.array([m[2] is None for m in MOVES])
    taken = np.array([-1 if m[2] is None else m[2] for m in MOVES])
    own_state = np.array([_OF.get(r, -2) for r, _ in _CODES])
    for table, first, size in _whole(batches, "ck"):
        code = table.column("code").to_numpy()
        enter, leave = (table.column(c).to_numpy()[first].astype(np.int64) for c in ("enter", "leave"))
        close = table.column("last").to_numpy(zero_copy_only=False)[first].astype(bool)
        pick = best_paths(code, first, size, enter, leave)
        action = np.where(merge[pick], "merge", np.where(own_state[code] == taken[pick], "keep", "relabel"))
        # Only the last turn is followed by insertions, which close an unanswered conversation.
        after = np.full(len(code), -1)
        after[(first + size - 1)[close]] = leave[close]
        cols = [table.column("conv").combine_chunks(), table.column("rid").combine_chunks(), _ROLE_NAMES.take(pa.array(_TO[pick])), pa.array(action.tolist(), pa.string()), pa.array(_FROM[pick] == B),
                _BEFORE.take(pa.array(pick)), _AFTER.take(pa.array(after, mask=after < 0))]
        yield from _out(pa.Table.from_arrays(cols, ["conv", "rid", "new_role", "action", "first", "before", "after"]))


def _numbered(base: DataFrame) -> DataFrame:
    """``base`` with a hash of its own for each of the rows that are alike. Those of one input partition are numbered together, so a row repeated very often is dealt over many tasks."""
    many = written(base.groupBy("rid").agg(F.count(F.lit(1)).alias("group_size")).where("group_size > 1"), "chat-repeats")
    total = many.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    if not total:
        return base
    alike = written(attach_groups(base.withColumn("pid", F.spark_partition_id()), many, "rid", total).drop("group_size"), "chat-alike")
    some = alike.groupBy("rid", "pid").agg(F.count(F.lit(1)).alias("c"))
    ahead = Window.partitionBy("rid").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    some = some.select("rid", "pid", F.coalesce(F.sum("c").over(ahead), F.lit(0)).alias("ahead"))
    k = F.col("ahead") + F.row_number().over(Window.partitionBy("rid", "pid").orderBy("pid")) - 1
    own = alike.join(some, ["rid", "pid"]).withColumn("k", k).withColumn("rid", F.when(F.col("k") == 0, F.col("rid")).otherwise(F.xxhash64("rid", "k")))
    return base.join(many.select("rid"), "rid", "left_anti").select(*base.columns).unionByName(written(own.select(*base.columns), "chat-copies"))


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The repaired conversations, a row a fragment: conv_id, turn, source_role, rid, part, role, action, rendered."""
    base = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.lower(F.trim(F.col(role_col))).alias("source_role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    ).withColumn("rid", F.xxhash64("conv_id", "turn", "source_role", "text"))
    # The mark in front keeps a null conversation apart from any other.
    key = F.concat(F.when(F.col("conv_id").isNull(), "0").otherwise("1"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    base = _numbered(base).withColumn("conv", key)
    chunk = F.coalesce(F.floor(F.col("turn") / CHUNK).cast("long"), F.lit(-(1 << 60)))
    place = F.coalesce(F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.col("source_role")).cast("int"), F.lit(0))
    code = F.when(place == 0, 6).otherwise((place - 1) * 2) + (F.trim("text") == "").cast("int")
    narrow = base.select("conv", chunk.alias("chunk"), "turn", F.col("source_role").alias("role"), code.alias("code"), "rid")
    crowded = narrow.groupBy("conv", "chunk").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD)
    crowd = F.col("n").isNotNull()
    # Enough leading bits to leave half a crowd a segment, were all rows of one turn and role; shifts keep the order.
    part = F.floor(F.col("rid") / F.pow(F.lit(2.0), 64 - F.ceil(F.log2(2.0 * F.coalesce("n", F.lit(1)) / CROWD)))).cast("long")
    seg = F.struct(F.when(crowd, F.col("turn").cast("long")).alias("turn"), F.when(crowd, F.col("role")).alias("role"), F.when(crowd, part).alias("part"))
    narrow = narrow.join(crowded, ["conv", "chunk"], "left").withColumn("seg", seg).drop("n").withColumn("ck", F.xxhash64(*KEYS))
    order = [*KEYS, "turn", "role", "rid"]
    chunks = narrow.repartition(*KEYS).sortWithinPartitions(*order).select(*KEYS, "code", "ck").mapInArrow(_matrices, f"{_KEY_SCHEMA}, cost array<double>")
    chunks = written(chunks, "chat-chunks").repartitionByRange(*KEYS).withColumn("pid", F.spark_partition_id()).withColumn("gk", F.xxhash64("conv", "pid"))
    chunks = written(chunks, "chat-chunks-dealt")
    sorted_ = lambda df, by, *more: df.repartition(*by).sortWithinPartitions(*by, *more)
    groups = sorted_(chunks, ("conv", "pid"), *KEYS[1:]).mapInArrow(_spans, "conv string, pid int, cost array<double>")
    ends = sorted_(groups.withColumn("hk", F.xxhash64("conv")), ("conv",), "pid").mapInArrow(_chain("hk", ("conv", "pid"), False), "conv string, pid int, enter int, leave int, last boolean")
    inner = sorted_(chunks.join(ends, ["conv", "pid"]), ("conv", "pid"), *KEYS[1:])
    states = inner.mapInArrow(_chain("gk", KEYS, True), f"{_KEY_SCHEMA}, enter int, leave int, last boolean")
    solved = narrow.join(written(states, "chat-states"), list(KEYS)).repartition(*KEYS).sortWithinPartitions(*order)
    return _render(base, solved.mapInArrow(_decide, _DECISION))


def _render(base: DataFrame, plan: DataFrame) -> DataFrame:
    rows = base.join(plan, ["conv", "rid"])

    def opening(role: Column, first: Column) -> Column:
        return F.concat(F.when(first, "").otherwise(F.lit(TAIL)), F.lit("<|"), role, F.lit("|>\n"))

    def inserted(role: Column, first: Column) -> Column:
        return F.struct(role.alias("role"), F.lit("insert").alias("action"), opening(role, first).alias("rendered"))

    alone = F.col("first") & (F.size("before") == 0)
    head = F.when(F.col("action") == "merge", "").otherwise(opening(F.col("new_role"), alone))
    own = F.struct(F.col("new_role").alias("role"), "action", F.concat(head, "text", F.lit("\n")).alias("rendered"))
    parts = F.concat(
        F.transform("before", lambda r, i: inserted(r, F.col("first") & (i == 0))), F.array(own), F.transform(F.coalesce("after", F.array().cast("array<string>")), lambda r: inserted(r, F.lit(False)))
    )
    out = rows.select("conv_id", "turn", "source_role", "rid", F.size(parts).alias("n"), F.col("after").isNotNull().alias("last"), F.posexplode(parts).alias("part", "f"))
    closed = F.concat("f.rendered", F.when(F.col("last") & (F.col("part") == F.col("n") - 1), TAIL).otherwise(""))
    return out.select("conv_id", "turn", "source_role", "rid", "part", "f.role", "f.action", closed.alias("rendered"))
