"""Packing pieces of documents into windows by non-negative least squares.

Lengths fall into ``bins`` steps of the window.  Combinations of up to three steps that
fill the window are the columns of a matrix; least squares with non-negative counts says
how often to use each so that the histogram of lengths is met.  Counts are rounded down,
what is left over is packed greedily.  All of this works on the histogram, whose size does
not depend on the data; the pieces themselves are only ranked within their step and look
up their place in the plan.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import materialize
from millrace.llm.tokens import word_bpe_path, word_tokenizer


def fill_patterns(present: np.ndarray, bins: int) -> np.ndarray:
    """Rows (a, b, c), a >= b >= c >= 0, of steps in ``present`` with a + b + c = bins; 0 is no piece."""
    have = np.zeros(bins + 1, bool)
    have[present] = True
    have[0] = True
    a, b = np.meshgrid(np.arange(bins + 1), np.arange(bins + 1), indexing="ij")
    c = bins - a - b
    ok = (a >= b) & (b >= c) & (c >= 0) & (a > 0)
    rows = np.stack([a[ok], b[ok], c[ok]], 1)
    return rows[have[rows].all(1)]


def nnls(matrix: np.ndarray, target: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """argmin |matrix x - target| over x >= 0, by active sets."""
    n = matrix.shape[1]
    x, used = np.zeros(n), np.zeros(n, bool)
    scale = max(float(np.abs(target).max(initial=0)), 1.0)
    for _ in range(rounds):
        slope = matrix.T @ (target - matrix @ x)
        slope[used] = -np.inf
        best = int(np.argmax(slope)) if n else 0
        if not n or slope[best] <= 1e-9 * scale:
            break
        used[best] = True
        while True:
            at = np.flatnonzero(used)
            z = np.linalg.lstsq(matrix[:, at], target, rcond=None)[0]
            if (z > 1e-12 * scale).all():
                x[:] = 0
                x[at] = z
                break
            bad = z <= 1e-12 * scale
            step = np.min(np.where(bad, x[at] / np.maximum(x[at] - z, 1e-300), np.inf))
            x[at] += min(step, 1.0) * (z - x[at])
            drop = at[bad & (x[at] <= 1e-12 * scale)]
            if not len(drop):
                drop = at[bad][:1]
            x[drop] = 0
            used[drop] = False
    return x


def plan(counts: np.ndarray) -> list[tuple[list[int], int]]:
    """For counts[k] pieces of k steps (k from 1 to the number of steps of the window): how
    often each combination of steps is used.  All pieces are placed, none twice."""
    bins = len(counts) - 1
    left = counts.astype(np.int64).copy()
    out: list[tuple[list[int], int]] = []
    if left[bins]:  # whole windows
        out.append(([bins], int(left[bins])))
        left[bins] = 0
    rows = fill_patterns(np.flatnonzero(left), bins)
    rows = rows[rows[:, 0] < bins]
    if len(rows):
        matrix = np.zeros((bins + 1, len(rows)))
        for k in range(3):
            np.add.at(matrix, (rows[:, k], np.arange(len(rows))), 1)
        matrix[0] = 0
        repeat = np.floor(nnls(matrix, left.astype(float)) + 1e-9).astype(np.int64)
        for k in np.argsort(-repeat, kind="stable"):
            steps = [int(v) for v in rows[k] if v]
            most = min(int(left[v]) // steps.count(v) for v in set(steps))
            times = min(int(repeat[k]), most)
            if times <= 0:
                continue
            for v in steps:
                left[v] -= times
            out.append((steps, times))
    while left.any():  # greedily: the largest, then the largest that still fits, as often as it goes
        room, steps, rest = bins, [], left.copy()
        while True:
            fits = np.flatnonzero(rest[:room + 1])
            if not len(fits):
                break
            v = int(fits[-1])
            steps.append(v)
            rest[v] -= 1
            room -= v
        times = min(int(left[v]) // steps.count(v) for v in set(steps))
        for v in steps:
            left[v] -= times
        out.append((steps, times))
    return out


def places(made: list[tuple[list[int], int]], bins: int) -> tuple[np.ndarray, ...]:
    """The plan as intervals of ranks, sorted by (step, first rank): step, first rank, first window, slot."""
    used, rows, window = [0] * (bins + 1), [], 0
    for steps, times in made:
        for slot, v in enumerate(steps):
            rows.append((v, used[v], window, slot))
            used[v] += times
        window += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return tuple(table[:, k] for k in range(4))


def cut_pieces(docs: DataFrame, window: int, bins: int, end_id: int, tokenizer: str, id_col: str, text_col: str) -> DataFrame:
    """Documents as ids, cut every ``window`` ids: one row per piece with its step of length,
    and its rank among the pieces of that step in its part of the input."""
    step = window // bins

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        ranks = np.zeros(bins + 1, np.int64)
        end = np.array([end_id], "<u4").tobytes()
        encode = word_tokenizer(tokenizer).encode_all
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
                rows = []
                for doc, ids in zip(batch.column(0).to_pylist(), encode(texts)):
                    ids += end
                    n = len(ids) // 4
                    for start in range(0, n, window):
                        length = min(window, n - start)
                        k = -(-length // step)
                        rows.append((doc, start, length, zlib.crc32(ids[4 * start:4 * (start + length)]), n, part, k, int(ranks[k])))
                        ranks[k] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [batch.column(0).type] + [pa.int64()] * 7)], schema=None, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "step", "local"]
    schema = f"doc_id {kind}, " + ", ".join(f"{n} bigint" for n in names[1:])
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")).mapInArrow(cut, schema)


def pack(docs: DataFrame, window: int = 2048, bins: int = 256, end_id: int = 1, tokenizer: str | None = None,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its token ids and ``end_id``; so null and empty texts are one id.  It is
    cut every ``window`` ids, and each piece lies in one sequence.  Repeated rows are
    packed as often as they come; an empty table gives no rows."""
    if window % bins:
        raise ValueError("bins must divide window")
    pieces = materialize(cut_pieces(docs, window, bins, end_id, tokenizer or word_bpe_path(), id_col, text_col), "pieces")
    by_part = materialize(pieces.groupBy("part", "step").agg(F.count(F.lit(1)).alias("n")), "by_part")
    counts = np.zeros(bins + 1, np.int64)
    for k, n in by_part.groupBy("step").agg(F.sum("n")).collect():  # at most ``bins`` rows
        counts[k] = n
    table = places(plan(counts), bins)
    prior = Window.partitionBy("step").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_part.select(F.col("part").alias("p"), F.col("step").alias("s"), F.coalesce(F.sum("n").over(prior), F.lit(0)).alias("before"))
    with_rank = pieces.join(starts, (pieces["part"] == starts["p"]) & (pieces["step"] == starts["s"])).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "step", (F.col("local") + F.col("before")).alias("rank"))
    fields = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, firsts, windows, slots = table
        wide = int(firsts.max(initial=0)) + 1
        keys = steps * wide + firsts
        for b in batches:
            step, rank = b.column(5).to_numpy(), b.column(6).to_numpy()
            at = np.searchsorted(keys, step * wide + np.minimum(rank, wide - 1), "right") - 1
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(5)), pa.array(windows[at] + rank - firsts[at]), pa.array(slots[at])], names=[*fields, "sequence_id", "slot"])

    kind = pieces.schema["doc_id"].dataType.simpleString()
    placed = with_rank.mapInArrow(place, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, slot bigint")
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")).select(*fields, "sequence_id", "offset")
