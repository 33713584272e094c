"""Removal of passages of ``LENGTH`` bytes that an earlier document has, by sorted suffixes.

Not every suffix is needed.  Of the grams of ``GRAM`` bytes in a window of ``LENGTH``
bytes, those with the least hash are anchors; equal windows have equal anchors at equal
places, so it is enough to compare the suffixes that start at anchors, and up to
``LENGTH - GRAM`` bytes to their left.

1. Each block of documents lists hashes of its anchors' grams, a few bytes each; a gram
   that only one document has is done with.
2. What stands around the other anchors is range-partitioned by the leading bytes of the
   suffix, and where those agree by all that follows and the bytes to the left, between
   splitters from a sample.  A bucket sorts its suffixes by multikey quicksort, eight bytes
   at a time, compares neighbours, and tells for each window around an anchor whether an
   earlier document has it.
3. Suffixes that agree in their first bytes with a splitter can have their like across the
   boundary, however many buckets the run of them spans: their windows that are the
   earliest of their bucket are compared with those of the other buckets.  So a string
   that many different texts follow is cut into as many buckets as it needs, and one
   surrounding alone is a row for each block.
4. Each block marks the bytes that such windows cover.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialize

LENGTH = 50
GRAM = 24
LEFT = LENGTH - GRAM  # bytes kept to the left of an anchor
WIDTH = LENGTH + LEFT  # a suffix, and the bytes to its left
BLOCK_BYTES = 8 << 20
CHUNK = 1 << 20
#: Bytes of a block's documents that a row holds; rows much larger fragment the executors' heaps.
PIECE = 1 << 18
#: Suffixes that splitters are taken from, at most, and one of how many anchors of a block is a candidate.
SAMPLE, SAMPLE_EVERY = 1 << 15, 256
#: Runs of suffixes that the quicksort leaves to an ordinary sort.
SMALL = 24
NO_ID = np.iinfo(np.int64).max  # a null id is later than any other

DOCS, KEYS, SPLIT, AROUND, EDGE, FIX = "docs", "keys", "split", "around", "edge", "fix"
_DDL = "block string, kind string, bucket bigint, payload binary"
_SCHEMA = pa.schema([("block", pa.string()), ("kind", pa.string()), ("bucket", pa.int64()), ("payload", pa.binary())])


def _row(block: str, kind: str, bucket: int, payload: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((block, kind, bucket, payload), _SCHEMA.types)], schema=_SCHEMA)


def _squeeze(a: np.ndarray) -> bytes:
    """An array, byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _stretch(b: bytes, n: int, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(-1, n).T).view(kind).reshape(-1) if n else np.zeros(0, kind)


def _join(*parts: bytes) -> bytes:
    return np.array([len(parts), *map(len, parts)], "<i8").tobytes() + b"".join(parts)


def _parts(b: bytes) -> list[bytes]:
    n = int(np.frombuffer(b, "<i8", 1)[0])
    sizes = np.frombuffer(b, "<i8", n, 8)
    ends = np.cumsum(sizes) + 8 * (n + 1)
    return [b[e - s:e] for s, e in zip(sizes.tolist(), ends.tolist())]


class Block:
    """Documents of a block, one after another, with room for a surrounding at either end."""

    def __init__(self, ids: np.ndarray, texts: list[bytes]):
        self.ids = ids
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.starts = LEFT + np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(bytes(LEFT) + b"".join(texts) + bytes(WIDTH + 64), np.uint8)
        self.end = LEFT + int(self.lengths.sum())

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of anchors and the hashes of their grams."""
        places, hashes = [], []
        span = LENGTH - GRAM + 1  # grams of a window
        starts_ok = np.zeros(len(self.bytes) + 1, np.int8)
        long_enough = self.lengths >= LENGTH
        np.add.at(starts_ok, self.starts[long_enough], 1)
        np.add.at(starts_ok, (self.starts + self.lengths - LENGTH + 1)[long_enough], -1)
        starts_ok = np.cumsum(starts_ok, dtype=np.int8)
        words = np.ndarray((len(self.bytes) - 7,), "<u8", self.bytes, strides=(1,))
        for a in range(LEFT, self.end, CHUNK):
            # Hashes from span - 1 before the chunk to span - 1 behind it: all windows that reach into it.
            lo, hi = max(a - span + 1, 0), min(a + CHUNK, self.end)
            n = hi + span - 1 - lo
            h = words[lo:lo + n] * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
            h += words[lo + 8:lo + 8 + n]
            h *= np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(29)
            h += words[lo + 16:lo + 16 + n]
            h *= np.uint64(0xA0761D6478BD642F)
            h ^= h >> np.uint64(32)
            h |= np.uint64(1)
            least = _slide(h, span, np.minimum)  # over the window that starts here
            least[starts_ok[lo:lo + len(least)] == 0] = 0
            # The largest least of the windows that hold a gram is its hash if it is an anchor of one.
            most = _slide(np.r_[np.zeros(span - 1, np.uint64), least], span, np.maximum)
            at = np.flatnonzero(most == h[:len(most)])
            at = at[(at + lo >= a) & (at + lo < hi)]
            places.append(at + lo)
            hashes.append(h[at])
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return np.concatenate(places), np.concatenate(hashes)

    def of_doc(self, places: np.ndarray) -> np.ndarray:
        """The document of each place; empty ones have none."""
        full = np.flatnonzero(self.lengths)
        return full[np.searchsorted(self.starts[full], places, "right") - 1]

    def around(self, places: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Rows of WIDTH + 2 bytes: LENGTH bytes from each place, LEFT bytes before it, zero outside
        of its document, and how many bytes before and from it are its document's."""
        out = np.empty((len(places), WIDTH + 2), np.uint8)
        view = np.lib.stride_tricks.sliding_window_view
        out[:, :LENGTH], out[:, LENGTH:WIDTH] = view(self.bytes, LENGTH)[places], view(self.bytes, LEFT)[places - LEFT]
        before = np.minimum(places - self.starts[doc], LEFT)
        after = np.minimum(self.starts[doc] + self.lengths[doc] - places, LENGTH)
        edge = np.flatnonzero((before < LEFT) | (after < LENGTH))
        out[edge, :LENGTH] *= np.arange(LENGTH) < after[edge, None]
        out[edge, LENGTH:WIDTH] *= np.arange(LEFT) >= LEFT - before[edge, None]
        out[:, WIDTH], out[:, WIDTH + 1] = before, after
        return out


def _slide(x: np.ndarray, span: int, best: np.ufunc) -> np.ndarray:
    """best over x[i:i + span] for each i."""
    width, y = 1, x
    while 2 * width <= span:
        y = best(y[:-width], y[width:])
        width *= 2
    return best(y[:len(x) - span + 1], y[span - width:span - width + len(x) - span + 1]) if width < span else y


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of bytes, sorted, and the place of each row among them."""
    if not len(rows):
        return rows, np.zeros(0, np.int64)
    order = suffix_order(rows)
    ranked = rows[order]
    new = np.r_[True, (ranked[1:] != ranked[:-1]).any(1)]
    at = np.empty(len(rows), np.int64)
    at[order] = np.cumsum(new) - 1
    return ranked[new], at


def suffix_order(rows: np.ndarray) -> np.ndarray:
    """The order of ``rows`` by their bytes: three-way multikey quicksort, whose characters are words of
    eight bytes.  All runs that are still unsorted are parted at once, each around the middle of
    three of its words: what is smaller and larger stays at its word, what is equal goes on with the next."""
    n, width = rows.shape
    wide = np.zeros((n, -(-width // 8) * 8), np.uint8)
    wide[:, :width] = rows
    words = np.ascontiguousarray(wide.view(">u8").astype(np.uint64))
    order = np.arange(n)
    start, size, depth = np.zeros(1, np.int64), np.array([n]), np.zeros(1, np.int64)
    rest: list[tuple[np.ndarray, np.ndarray]] = []
    while True:
        small = (size > 1) & (size <= SMALL)
        rest.append((start[small], size[small]))
        big = size > SMALL
        start, size, depth = start[big], size[big], depth[big]
        if not len(start):
            break
        first = np.cumsum(size) - size  # of each run, among the places that are looked at
        run = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(run)) + (start - first)[run]
        w = words[order[place], depth[run]]
        three = np.sort(np.stack([w[first], w[first + size // 2], w[first + size - 1]]), axis=0)[1]
        side = (w >= three[run]).astype(np.int64) + (w > three[run])
        count = np.bincount(run * 3 + side, minlength=3 * len(size)).reshape(-1, 3)
        begin = start[:, None] + np.cumsum(count, axis=1) - count
        to = np.empty(len(run), np.int64)
        for s in range(3):
            of = side == s
            seen = np.cumsum(of) - of
            to[of] = (begin[run, s] + seen - seen[first][run])[of]
        order[to] = order[place]
        start, size, depth = begin.reshape(-1), count.reshape(-1), (depth[:, None] + [0, 1, 0]).reshape(-1)
        size = np.where(depth < words.shape[1], size, 0)  # runs that are equal to the end are done
    start, size = (np.concatenate(x) for x in zip(*rest))
    if len(start):
        run = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(run)) + (start - (np.cumsum(size) - size))[run]
        own = words[order[place]]
        order[place] = order[place][np.lexsort((*own.T[::-1], run))]
    return order


def _shared_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading bytes rows share."""
    differ = a != b
    return np.where(differ.any(1), differ.argmax(1), differ.shape[1])


def has_window(rows: np.ndarray, a: int) -> np.ndarray:
    """Is the window that starts ``a`` bytes before the anchor inside of the document?"""
    return (rows[:, WIDTH] >= a) & (rows[:, WIDTH + 1] >= LENGTH - a)


def windows(rows: np.ndarray, a: int) -> np.ndarray:
    """The bytes of those windows."""
    return np.hstack([rows[:, WIDTH - a:WIDTH], rows[:, :LENGTH - a]])


def earlier_windows(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each surrounding of ``rows``, sorted, whose earliest document is ``first``, the windows that a document
    before that has: bit a is the window that starts a bytes before the anchor."""
    n = len(rows)
    found = np.zeros(n, np.uint32)
    if n < 2:
        return found
    common = _shared_bytes(rows[1:, :LENGTH], rows[:-1, :LENGTH])
    left = rows[:, LENGTH:WIDTH][:, ::-1]
    by_left = suffix_order(left)
    common_left = _shared_bytes(left[by_left[1:]], left[by_left[:-1]])
    past = np.empty(n, np.int64)
    for a in range(LEFT + 1):
        run = np.r_[0, np.cumsum(common < LENGTH - a)]  # agree from the anchor on
        past[by_left] = np.r_[0, np.cumsum(common_left < a)]  # agree before it
        ok = np.flatnonzero(has_window(rows, a) & (np.bincount(run)[run] > 1))
        if len(ok) < 2:
            continue
        key = run[ok] * n + past[ok]
        at = np.argsort(key, kind="stable")
        head = np.flatnonzero(np.r_[True, key[at[1:]] != key[at[:-1]]])
        least = np.repeat(np.minimum.reduceat(first[ok[at]], head), np.diff(np.r_[head, len(at)]))
        found[ok[at[least < first[ok[at]]]]] |= np.uint32(1 << a)
    return found


def edge_rows(every: np.ndarray, bits: np.ndarray, sides: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """For each a, the surroundings whose window a is the earliest of the bucket but whose run goes up to one
    of ``sides``, the splitters around the bucket."""
    if not sides:
        return
    reach = np.max([_shared_bytes(every[:, :LENGTH], s[None, :LENGTH]) for s in sides], axis=0)
    for a in range(LEFT + 1):
        own = np.flatnonzero((reach >= LENGTH - a) & (bits >> np.uint32(a) & np.uint32(1) == 0) & has_window(every, a))
        if len(own):
            yield a, own


def _build(id_and_text: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, size = TaskContext.get().partitionId(), 0, 0
        texts: list[bytes] = []
        ids: list[int] = []
        nulls: list[bool] = []

        def flush() -> Iterator[pa.RecordBatch]:
            name = f"{part}-{number}"
            sink = pa.BufferOutputStream()
            table = pa.table({"id": pa.array(ids, pa.int64()), "null": nulls, "text": pa.array(texts, pa.binary())})
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=5))) as w:
                w.write_table(table)
            packed = sink.getvalue().to_pybytes()
            for k in range(0, len(packed), PIECE):
                yield _row(name, DOCS, k, packed[k:k + PIECE])
            del table, sink, packed
            block = Block(np.array(ids, np.int64), texts)
            places, hashes = block.anchors()
            key, many, _ = _block_keys(block, places, hashes)
            cuts = np.searchsorted(key, (np.arange(buckets + 1, dtype=np.uint64) << np.uint64(40)) // np.uint64(buckets))
            for b, (s, e) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())):
                if e > s:
                    steps = np.diff(key[s:e], prepend=np.uint64(0))
                    yield _row(name, KEYS, b, _join(np.array([e - s], "<i8").tobytes(), _squeeze(steps), np.packbits(many[s:e]).tobytes()))
            some = places[::SAMPLE_EVERY]
            yield _row(name, SPLIT, len(some), block.around(some, block.of_doc(some))[:, :WIDTH].tobytes())

        for batch in batches:
            for k, (i, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
                t = (t.as_py() or "").encode()
                if texts and size + len(t) > BLOCK_BYTES:
                    yield from flush()
                    texts, ids, nulls, size, number = [], [], [], 0, number + 1
                texts.append(t)
                ids.append(NO_ID if i is None else i)
                nulls.append(i is None)
                size += len(t)
        if texts:
            yield from flush()

    return id_and_text.mapInArrow(run, _DDL)


def _block_keys(block: Block, places: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct 40-bit hashes of a block, sorted; whether several of its documents have it; and each anchor's place among them."""
    key, at = np.unique(hashes >> np.uint64(24), return_inverse=True)
    doc = block.of_doc(places)
    low, high = np.full(len(key), len(block.ids), np.int64), np.full(len(key), -1, np.int64)
    np.minimum.at(low, at, doc)
    np.maximum.at(high, at, doc)
    return key, low != high, at


def _shared(asks: DataFrame) -> DataFrame:
    """For each ask, a bit for each hash: do several documents have it?"""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        keys, flags = [], []
        for p in group.column("payload").to_pylist():
            n, steps, many = _parts(p)
            n = int(np.frombuffer(n, "<i8")[0])
            keys.append(np.cumsum(_stretch(steps, n, "<u8"), dtype=np.uint64))
            flags.append(np.unpackbits(np.frombuffer(many, np.uint8), count=n))
        every, at = np.unique(np.concatenate(keys), return_inverse=True)
        hit = (np.bincount(at, minlength=len(every)) > 1) | (np.bincount(at, np.concatenate(flags), len(every)) > 0)
        ends = np.cumsum([len(k) for k in keys])
        out = [np.packbits(hit[at[e - len(k):e]]).tobytes() for k, e in zip(keys, ends)]
        names = group.column("block").to_pylist()
        return pa.Table.from_arrays([pa.array(names), pa.array([KEYS] * len(names)), pa.array([key[0].as_py()] * len(names), pa.int64()), pa.array(out, pa.binary())], schema=_SCHEMA)

    return asks.groupBy("bucket").applyInArrow(run, _DDL)


def _across(edges: DataFrame) -> DataFrame:
    """For the windows at the boundaries, those that a document before has in another bucket: for each block and
    bucket, pairs of a row's place and a."""

    def open_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, bucket, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                a, n, raw, least, place = _parts(p)
                n = int(np.frombuffer(n, "<i8")[0])
                raw = zstandard.ZstdDecompressor().decompress(raw)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * n), pa.array([bucket] * n, pa.int64()), pa.array([raw[k * LENGTH:(k + 1) * LENGTH] for k in range(n)], pa.binary()),
                     pa.array(_stretch(least, n, "<i8")), pa.array(_stretch(place, n, "<i8")), pa.array([a[0]] * n, pa.int64())],
                    names=["block", "bucket", "window", "least", "place", "a"])

    def close(key: tuple, group: pa.Table) -> pa.Table:
        pairs = np.stack([group.column("place").to_numpy(), group.column("a").to_numpy()], 1).astype("<i8")
        return pa.Table.from_arrays([pa.array([v], t) for v, t in zip((key[0].as_py(), FIX, key[1].as_py(), pairs.tobytes()), _SCHEMA.types)], schema=_SCHEMA)

    rows = materialize(edges.select("block", "bucket", "payload").mapInArrow(open_, "block string, bucket bigint, window binary, least bigint, place bigint, a bigint"), "edges")
    first = rows.groupBy("window").agg(F.min("least").alias("first"), F.max("least").alias("last")).where(F.col("first") < F.col("last"))
    late = rows.join(first, "window").where(F.col("least") > F.col("first"))
    return materialize(late.groupBy("block", "bucket").applyInArrow(close, _DDL), "fixes")


class _Candidates:
    """The anchors of a block whose grams several documents have, and what stands around them."""

    def __init__(self, own: pa.Table, replies: dict[tuple[str, int], bytes], buckets: int):
        packed = b"".join(own.sort_by("bucket").column("payload").to_pylist())
        self.table = pa.ipc.open_stream(packed).read_all().combine_chunks()
        self.texts = self.table.column("text").to_pylist()
        self.block = Block(self.table.column("id").to_numpy(), self.texts)
        places, hashes = self.block.anchors()
        key, _, at = _block_keys(self.block, places, hashes)
        cuts = np.searchsorted(key, (np.arange(buckets + 1, dtype=np.uint64) << np.uint64(40)) // np.uint64(buckets))
        shared = np.zeros(len(key), bool)
        for b, (s, e) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())):
            if e > s:
                shared[s:e] = np.unpackbits(np.frombuffer(replies[KEYS, b], np.uint8), count=e - s)
        self.places = places[shared[at]]
        self.doc = self.block.of_doc(self.places)
        self.rows, self.at = _distinct(self.block.around(self.places, self.doc))
        self.first = np.full(len(self.rows), NO_ID, np.int64)
        np.minimum.at(self.first, self.at, self.block.ids[self.doc])

    def ranges(self, splitters: np.ndarray) -> np.ndarray:
        return np.searchsorted(splitters, np.ascontiguousarray(self.rows[:, :WIDTH]).view(f"S{WIDTH}").reshape(-1), "right")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept.

    A text is its UTF-8 bytes, null is empty.  A byte is removed if a string of LENGTH
    bytes covers it that also starts in a document with a smaller id, as the texts were
    given; kept are the others, in order.  Ids are integers; rows with the same id don't
    count as earlier for each other, null ids are later than all others.  Texts shorter
    than LENGTH stay whole; an empty table gives no rows; other columns aren't read."""
    spark = docs.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    parts = materialize(_build(own, n), "blocks", by="kind")  # documents, keys and samples are read apart
    shared = materialize(_shared(parts.where(F.col("kind") == KEYS)), "shared")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([p[k:k + WIDTH] for k in range(0, len(p), WIDTH)], pa.binary())], names=["lead"])

    offered = parts.where(F.col("kind") == SPLIT)
    # The share of hashes is cut first, so that tasks don't each send as many as are taken in all.
    share = min(2 * SAMPLE / max(offered.agg(F.sum("bucket")).first()[0] or 0, 1), 1)
    leads = offered.select("payload").mapInArrow(spread, "lead binary").where(F.shiftrightunsigned(F.xxhash64("lead"), 34) < F.lit(int(share * (1 << 30))))
    sample = leads.orderBy(F.xxhash64("lead")).limit(SAMPLE).toPandas()["lead"]
    lead = np.unique(np.array(sample.map(bytes).tolist(), f"S{WIDTH}"))
    splitters = np.unique(lead[np.arange(1, n) * len(lead) // n]) if len(lead) else lead
    bounds = [np.frombuffer(bytes(x).ljust(WIDTH, b"\0"), np.uint8) for x in splitters]

    def replies(got: pa.Table) -> dict[tuple[str, int], bytes]:
        return dict(zip(zip(got.column("kind").to_pylist(), got.column("bucket").to_pylist()), got.column("payload").to_pylist()))

    def surround(key: tuple, block: pa.Table, got: pa.Table) -> pa.Table:
        c = _Candidates(block, replies(got), n)
        of = c.ranges(splitters)
        cuts = np.searchsorted(of, np.arange(len(splitters) + 2))
        out = [(key[0].as_py(), AROUND, b, _join(np.array([e - s], "<i8").tobytes(), zstandard.ZstdCompressor(level=3).compress(c.rows[s:e].tobytes()), _squeeze(c.first[s:e])))
               for b, (s, e) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())) if e > s]
        return pa.Table.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(_SCHEMA.types)], schema=_SCHEMA)

    blocks = parts.where(F.col("kind") == DOCS).groupBy("block")
    around = blocks.cogroup(shared.groupBy("block")).applyInArrow(surround, _DDL)

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        rows, first = [], []
        for p in group.column("payload").to_pylist():
            m, r, f = _parts(p)
            m = int(np.frombuffer(m, "<i8")[0])
            rows.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(r), np.uint8).reshape(m, WIDTH + 2))
            first.append(_stretch(f, m, "<i8"))
        every, at = _distinct(np.concatenate(rows))
        least = np.full(len(every), NO_ID, np.int64)
        np.minimum.at(least, at, np.concatenate(first))
        bits = earlier_windows(every, least)
        # Where an earlier block has the same surrounding, all of its windows are repeats.
        mask = np.where(least[at] < np.concatenate(first), np.uint32(1 << 31), bits[at]).astype("<u4")
        ends = np.cumsum([len(f) for f in first])
        out = [_join(np.array([len(f)], "<i8").tobytes(), _squeeze(mask[e - len(f):e])) for f, e in zip(first, ends)]
        names, bucket = group.column("block").to_pylist(), key[0].as_py()
        rows = [(name, AROUND, bucket, p) for name, p in zip(names, out)]
        # What has to be compared across the boundaries: rows of the earliest documents, with their windows.
        begin = ends - [len(f) for f in first]
        earliest = np.concatenate(first) == least[at]
        for a, own in edge_rows(every, bits, [bounds[k] for k in (bucket - 1, bucket) if 0 <= k < len(bounds)]):
            marked = np.zeros(len(every), bool)
            marked[own] = True
            r = np.flatnonzero(marked[at] & earliest)
            of = np.searchsorted(ends, r, "right")
            cuts = np.searchsorted(of, np.arange(len(names) + 1))
            rows += [(names[k], EDGE, bucket, _join(bytes([a]), np.array([e - s], "<i8").tobytes(), zstandard.ZstdCompressor(level=1).compress(windows(every[at[r[s:e]]], a).tobytes()), _squeeze(least[at[r[s:e]]]), _squeeze(r[s:e] - begin[k])))
                     for k, (s, e) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())) if e > s]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SCHEMA.types)], schema=_SCHEMA)

    masks = materialize(around.groupBy("bucket").applyInArrow(compare, _DDL), "masks")
    answers = shared.unionByName(masks.where(F.col("kind") == AROUND))
    edges = masks.where(F.col("kind") == EDGE)
    if not edges.isEmpty():
        answers = answers.unionByName(_across(edges))

    def finish(key: tuple, block: pa.Table, got: pa.Table) -> pa.Table:
        reply = replies(got)
        c = _Candidates(block, reply, n)
        of = c.ranges(splitters)
        mask = np.zeros(len(c.rows), np.uint32)
        cuts = np.searchsorted(of, np.arange(len(splitters) + 2))
        for b, (s, e) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())):
            if e > s:
                m, squeezed = _parts(reply[AROUND, b])
                mask[s:e] = _stretch(squeezed, e - s, "<u4")
                if (FIX, b) in reply:
                    more = np.frombuffer(reply[FIX, b], "<i8").reshape(-1, 2)
                    np.bitwise_or.at(mask, s + more[:, 0], (1 << more[:, 1]).astype(np.uint32))
        every = np.zeros(len(c.rows), np.uint32)
        for a in range(LEFT + 1):
            every |= np.where(has_window(c.rows, a), np.uint32(1 << a), np.uint32(0))
        whole = (mask[c.at] >> np.uint32(31) > 0) | (c.block.ids[c.doc] > c.first[c.at])
        own_mask = np.where(whole, every[c.at], mask[c.at] & np.uint32((1 << 31) - 1))
        marks = np.zeros(len(c.block.bytes) + 1, np.int32)
        for a in range(LEFT + 1):
            at = np.unique(c.places[(own_mask >> np.uint32(a)) & np.uint32(1) > 0] - a)
            marks[at] += 1
            marks[at + LENGTH] -= 1
        gone = np.cumsum(marks[:-1]) > 0
        rows = []
        for s, t, ident, null in zip(c.block.starts.tolist(), c.texts, c.block.ids.tolist(), c.table.column("null").to_pylist()):
            g = gone[s:s + len(t)]
            removed = int(g.sum())
            kept = c.block.bytes[s:s + len(t)][~g].tobytes() if removed else t
            spans = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()) if removed else 0
            rows.append((None if null else ident, len(t), removed, spans, hashlib.sha256(kept).hexdigest(), kept))
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows), result.types)], schema=result)

    result = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
    return blocks.cogroup(answers.groupBy("block")).applyInArrow(finish, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
