"""Token-id matrices: best-fit-decreasing packing of documents into fixed rows.

A task takes the documents of its part of the input in shards of about SHARD_TOKENS ids; a
shard packs its pieces by best fit in order of decreasing length, finding the fullest row
with enough room in a segment tree over row capacities.  A document longer than a row is
split where a row ends, so no id is lost.  Nothing is shuffled, and no key can be hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.tokens import word_bpe_path, word_tokenizer

#: Ids that are packed together; the document that reaches it is the shard's last.
SHARD_TOKENS = 1 << 22


class CapacityTree:
    """Rooms 0..width with how many rows have each; finds the smallest room of at least n."""

    def __init__(self, width: int):
        self.size = 1 << width.bit_length()
        self.most = [0] * (2 * self.size)

    def add(self, room: int, by: int) -> None:
        k = room + self.size
        while k:
            self.most[k] += by
            k >>= 1

    def smallest(self, least: int) -> int:
        """The smallest room >= ``least`` that a row has, or -1."""
        k = least + self.size
        if self.most[k]:
            return least
        while k > 1:
            if not k & 1 and self.most[k + 1]:  # k is a left child: look right of it
                k += 1
                while k < self.size:
                    k = 2 * k if self.most[2 * k] else 2 * k + 1
                return k - self.size
            k >>= 1
        return -1


def best_fit(lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and offset of each piece, longest pieces first, each in the fullest row that it fits."""
    tree, rows_with = CapacityTree(width), [[] for _ in range(width + 1)]
    row, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    made = 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[k])
        room = tree.smallest(n)
        if room < 0:
            r, room = made, width
            made += 1
        else:
            r = rows_with[room].pop()
            tree.add(room, -1)
        row[k], offset[k] = r, width - room
        if room > n:
            rows_with[room - n].append(r)
            tree.add(room - n, 1)
    return row, offset


def _packed(shard: int, docs_of: list, ids: list[bytes], width: int, pad_id: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows of a shard, some hundred at a time."""
    whole = [np.frombuffer(i, "<u4") for i in ids]
    pieces = [(d, s, x[s:s + width]) for d, x in zip(docs_of, whole) for s in range(0, len(x), width)]
    row, offset = best_fit(np.array([len(p) for *_, p in pieces], np.int64), width)
    by_row: list[list[int]] = [[] for _ in range(int(row.max()) + 1)]
    for k in np.lexsort((offset, row)).tolist():
        by_row[row[k]].append(k)
    for first in range(0, len(by_row), 512):
        own = by_row[first:first + 512]
        matrix = np.full((len(own), width), pad_id, "<u4")
        for m, r in zip(matrix, own):
            for k in r:
                m[offset[k]:offset[k] + len(pieces[k][2])] = pieces[k][2]
        starts = [[int(offset[k]) for k in r] for r in own]
        used = [s[-1] + len(pieces[r[-1]][2]) for s, r in zip(starts, own)]
        columns = [
            [shard] * len(own), range(first, first + len(own)), used, [m.tobytes() for m in matrix], [[*s, u] for s, u in zip(starts, used)],
            starts, [[pieces[k][0] for k in r] for r in own], [[pieces[k][1] for k in r] for r in own]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def packed_rows(docs: DataFrame, width: int = 2048, pad_id: int = 0, end_id: int = 1, tokenizer: str | None = None,
                id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per packed row: shard, row, n_tokens, ids (binary: ``width`` little-endian
    uint32, padded with ``pad_id``), cu_seqlens (0 and the end of each segment), resets (the
    position of each token within its segment starts anew at these offsets), doc_ids,
    doc_starts (where in its document each segment starts).

    Null and empty texts are one id, the end; repeated rows are packed as often as they
    come; an empty table gives no rows; other columns aren't read.  Which documents share a
    shard follows from how the input is parted; shard is the part's number and the shard's in it."""
    id_type = docs.schema[id_col].dataType.simpleString()
    path = tokenizer or word_bpe_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = word_tokenizer(path).encode_all, np.array([end_id], "<u4").tobytes()
        shard, held, docs_of, size, schema = TaskContext.get().partitionId() << 32, [], [], 0, None
        for whole in batches:
            kind = whole.schema.field(0).type
            schema = pa.schema([("shard", pa.int64()), ("row", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())),
                                ("resets", pa.list_(pa.int32())), ("doc_ids", pa.list_(kind)), ("doc_starts", pa.list_(pa.int64()))])
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                for d, ids in zip(b.column(0).to_pylist(), encode([(t or "").encode() for t in b.column(1).to_pylist()])):
                    held.append(ids + end)
                    docs_of.append(d)
                    size += len(ids) // 4 + 1
                    if size >= shard_tokens:
                        yield from _packed(shard, docs_of, held, width, pad_id, schema)
                        shard, held, docs_of, size = shard + 1, [], [], 0
        if held:
            yield from _packed(shard, docs_of, held, width, pad_id, schema)

    schema = f"shard bigint, row bigint, n_tokens bigint, ids binary, cu_seqlens array<int>, resets array<int>, doc_ids array<{id_type}>, doc_starts array<bigint>"
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")).mapInArrow(run, schema)


def write_rows(rows: DataFrame, path: str) -> None:
    """Write packed rows as Parquet under ``path``; a row's ids are a row of the id matrix, byte for byte."""
    rows.write.mode("errorifexists").parquet(path)
