"""Chat formatting: role repair at least cost, then rendering.

Legal conversations are an optional system turn, then user and assistant in turn, ending
with the assistant.  A turn can be kept, merged into the turn before it, given another
role, or get empty turns put before it; dynamic programming over the role of the last
turn finds the cheapest way.  A turn acts on the costs of the four states as a min-plus
matrix, so a conversation can be cut anywhere: turns are range-partitioned by
conversation and turn, and only the stretches at the ends of the parts, at most two for
each part, are put together on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.llm.common import materialize

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("", "system", "user", "assistant")
#: Names under which the roles also go.
ALIASES = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT, "human": USER, "bot": ASSISTANT, "gpt": ASSISTANT, "model": ASSISTANT, "ai": ASSISTANT}
#: May the turn of the second state follow that of the first?
FOLLOWS = {(START, SYSTEM), (START, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
MERGE, INSERT, RELABEL = 1, 2, 3
FAR = 1 << 40


def _insertions() -> dict[tuple[int, int], tuple[int, ...]]:
    """The fewest empty turns that lead from one state to another (the first in order of roles)."""
    best: dict[tuple[int, int], tuple[int, ...]] = {(s, s): () for s in range(4)}
    for _ in range(4):
        for (a, b), path in sorted(best.items()):
            for c in range(4):
                if (b, c) in FOLLOWS and ((a, c) not in best or len(best[a, c]) > len(path) + 1):
                    best[a, c] = (*path, c)
    return best


INSERTED = _insertions()


def _moves() -> list[dict[tuple[int, int], tuple[int, tuple[int, ...], bool]]]:
    """For each input role (0: none of the known) and pair of states: cost, empty turns before, merged?"""
    out = []
    for role in range(4):
        ways: dict[tuple[int, int], tuple[int, tuple[int, ...], bool]] = {}
        for to in (SYSTEM, USER, ASSISTANT):
            named = RELABEL * (to != role)
            for at in range(4):
                found = []
                if at == to:
                    found.append((named + MERGE, (), True))
                for mid in range(4):
                    if (at, mid) in INSERTED and (mid, to) in FOLLOWS:
                        found.append((named + INSERT * len(INSERTED[at, mid]), INSERTED[at, mid], False))
                if found:
                    ways[at, to] = min(found, key=lambda w: (w[0], w[2], w[1]))
        out.append(ways)
    return out


MOVES = _moves()
COST = np.full((4, 4, 4), FAR, np.int64)  # input role, state before, state after
for _r, _ways in enumerate(MOVES):
    for _pair, _way in _ways.items():
        COST[_r][_pair] = _way[0]
#: What it costs to end in each state: empty turns up to an assistant's.
CLOSE = np.array([0 if s == START else INSERT * len(INSERTED[s, ASSISTANT]) for s in range(4)])


def role_code(role: str | None) -> int:
    return ALIASES.get((role or "").strip().lower(), 0)


def summary(roles: list[int]) -> np.ndarray:
    """The least cost from each state to each over ``roles``."""
    m = np.where(np.eye(4, dtype=bool), 0, FAR)
    for r in roles:
        m = np.minimum((m[:, :, None] + COST[r][None]).min(1), FAR)
    return m


def forward(start: np.ndarray, roles: list[int]) -> tuple[np.ndarray, list[list[int]]]:
    """Costs after ``roles`` from ``start``, and each state's best state before each turn (the first of equal ones)."""
    back, d = [], start.tolist()
    cost = [c.tolist() for c in COST]
    for r in roles:
        c = cost[r]
        step = [min(range(4), key=lambda s, t=t: (d[s] + c[s][t], s)) for t in range(4)]
        d = [min(d[step[t]] + c[step[t]][t], FAR) for t in range(4)]
        back.append(step)
    return np.array(d), back


def trace(back: list[list[int]], end: int) -> list[int]:
    """The states before the first turn and after each, ending in ``end``."""
    states = [end]
    for step in reversed(back):
        states.append(step[states[-1]])
    return states[::-1]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple]]]:
    """Conversation by conversation, the rows of a part."""
    rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
    for key, own in groupby(rows, key=lambda r: (r[0], r[1])):
        yield key, list(own)


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts: int | None = None,
           opened: str = "<|{role}|>\n", closed: str = "<|end|>\n", joint: str = "\n\n") -> DataFrame:
    """The repaired, rendered turns: conv_id, position, piece, role, action, rendered.

    Rows of a conversation in order of position, then piece, concatenate to its rendering.
    position is the turn's place in the input (turns with equal numbers by role, then
    text, nulls first; repeated rows are turns of their own); empty turns put before it
    have pieces 0, 1, ... and action insert, the turn itself comes after them with action
    keep, merge, relabel or relabel+merge.  Empty turns at the end stand at the place after
    the last turn.  Of equally cheap ways the one whose states come first from the end is
    taken, so the result doesn't depend on how turns are partitioned.  A null conv_id is a
    conversation like any other, null text is empty, an unknown or null role always counts
    as relabelled; an empty table gives no rows; other columns aren't read."""
    spark = turns.sparkSession
    names = {"conv_id": conv_col, "turn": turn_col, "role": role_col, "text": text_col}
    own = turns.select(*[F.col(f"`{c}`").alias(n) for n, c in names.items()])
    order = ["conv_id", "turn", "role", "text"]
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = own.schema["conv_id"].dataType.simpleString()
    laid = materialize(own.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id().cast("long")), "turns")
    # Files may be cut or joined when they are read back; each part is brought together again.
    laid = laid.repartition(n, "part").sortWithinPartitions("part", *order)

    def per_part(f):
        """Run ``f`` on the batches of one part after the other."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pieces = (b.slice(s, e - s) for b in batches for p in [b.column(0).to_numpy()] for cuts in [np.flatnonzero(p[1:] != p[:-1]) + 1]
                      for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(p)]) if e > s)
            for _, own in groupby(pieces, key=lambda b: b.column(0)[0].as_py()):
                yield from f(own)
        return run

    def collect_ends(run, fields: list[str]) -> list:
        schema = f"part long, last boolean, conv_id {kind}, " + ", ".join(f"{x} array<long>" for x in fields)

        def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # Only the first and the last conversation of a part can go on in another part.
            kept = []
            for key, rows in _runs(batches):
                roles = [role_code(r[2]) for r in rows]
                kept = [(key, roles)] if not kept else [kept[0], (key, roles)]
            for last, ((part, conv), roles) in enumerate(kept):
                found = run(part, bool(last), roles)
                yield pa.RecordBatch.from_pylist([{"part": part, "last": bool(last), "conv_id": conv} | dict(zip(fields, found))], schema=out)

        out = to_arrow_schema(spark.createDataFrame([], schema).schema)
        return laid.select("part", "conv_id", "role").mapInArrow(per_part(ends), schema).collect()  # at most two rows for each part

    heads = sorted(collect_ends(lambda p, last, roles: [summary(roles).reshape(-1).tolist(), [len(roles)]], ["costs", "n"]), key=lambda r: (r["part"], r["last"]))
    zero = np.array([0, FAR, FAR, FAR])
    starts: dict[tuple[int, bool], np.ndarray] = {}
    places: dict[tuple[int, bool], int] = {}
    goes_on: dict[tuple[int, bool], bool] = {}
    before = None
    for r in heads:
        key = (r["part"], r["last"])
        same = before is not None and before[0] == r["conv_id"] and before[3][0] != r["part"]
        starts[key], places[key] = (before[1], before[2]) if same else (zero, 0)
        if same:
            goes_on[before[3]] = True
        d = np.minimum((starts[key][:, None] + np.array(r["costs"]).reshape(4, 4)).min(0), FAR)
        before = (r["conv_id"], d, places[key] + r["n"][0], key)
    doors = {(r["part"], r["last"]): r["entry"] for r in collect_ends(lambda p, last, roles: [[trace(forward(starts[p, last], roles)[1], e)[0] for e in range(4)]], ["entry"])} if goes_on else {}
    exits: dict[tuple[int, bool], int] = {}
    after = None
    for r in reversed(heads):  # from the last stretch of a conversation back to its first
        key = (r["part"], r["last"])
        if goes_on.get(key):
            exits[key] = doors[after][exits[after]]
        else:
            d = np.minimum((starts[key][:, None] + np.array(r["costs"]).reshape(4, 4)).min(0), FAR)
            exits[key] = int(np.argmin(d + CLOSE))
        after = key

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        pending = None

        def emit(part: int, conv: object, rows: list[tuple], key: tuple[int, bool] | None) -> None:
            roles = [role_code(r[2]) for r in rows]
            d, back = forward(starts[key] if key else zero, roles)
            states = trace(back, exits[key] if key else int(np.argmin(d + CLOSE)))
            place = places[key] if key else 0
            for k, (row, role, s, t) in enumerate(zip(rows, roles, states, states[1:])):
                _, empty, merged = MOVES[role][s, t]
                piece, at = 0, s
                for e in empty:
                    held.append((conv, place + k, piece, ROLES[e], "insert", (closed if at else "") + opened.format(role=ROLES[e])))
                    piece, at = piece + 1, e
                head = joint if merged else (closed if at else "") + opened.format(role=ROLES[t])
                action = "+".join(["relabel"] * (t != role) + ["merge"] * merged) or "keep"
                held.append((conv, place + k, piece, ROLES[t], action, head + (row[3] or "")))
            if not (key and goes_on.get(key)):
                s = states[-1]
                for piece, e in enumerate(INSERTED[s, ASSISTANT]):
                    held.append((conv, place + len(rows), piece, ROLES[e], "insert", closed + opened.format(role=ROLES[e])))
                if held:
                    *rest, text = held[-1]
                    held[-1] = (*rest, text + closed)

        def drain() -> Iterator[pa.RecordBatch]:
            nonlocal held
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), result.types)], schema=result)
                held = []

        for count, ((part, conv), rows) in enumerate(_runs(batches)):
            if pending:
                emit(*pending, (pending[0], False) if count == 1 else None)
                if len(held) > 5000:
                    yield from drain()
            pending = (part, conv, rows)
            alone = count == 0
        if pending:
            emit(*pending, (pending[0], not alone))
        yield from drain()

    schema = f"conv_id {kind}, position bigint, piece int, role string, action string, rendered string"
    result = to_arrow_schema(spark.createDataFrame([], schema).schema)
    return laid.select("part", "conv_id", "role", "text").mapInArrow(per_part(finish), schema)
