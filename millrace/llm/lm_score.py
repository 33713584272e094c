"""Scoring texts by prediction by partial matching (PPM) over bytes, trained on the corpus.

The model is a trie of byte contexts up to ``order`` long.  It is never held in one place:
each block of documents lists the distinct (context, byte) grams and words that it has,
with their counts in its training documents; buckets of grams add these up over all
blocks, work out a log-probability for each, and answer every block that asked.  A gram's
whole chain of shorter contexts down to two bytes ends in the same two bytes, by which
buckets are dealt, so a bucket needs no other; contexts of one byte and none are a table
of 65,536 counts that all buckets get.  Two bytes may be in every text: so a bucket's asks
are added up ASKS blocks at a time, up a tree, and answered ASKS blocks at a time; what
meets in one task is the bucket's distinct grams, not what all blocks ask.

Escapes are estimated by absolute discounting: a context seen T times with D distinct
bytes gives a byte seen c times (c - DISCOUNT)/T and leaves DISCOUNT * D/T to the next
shorter context, where the bytes that the longer one has are excluded from T and D.  After
the empty context, bytes never seen are equally likely.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialize

#: Text bytes of a block; a longer document is a block of its own.
BLOCK_BYTES = 8 << 20
#: Blocks whose asks of a bucket meet in one task; with more, counts are added up a tree.
ASKS = 128
#: What each seen byte of a context gives up for those not seen.
DISCOUNT = 0.4
END = b"\n"  # no word holds it; it ends each document and is the context before its start
_WORD_SEED = 7

DOCS, WORDS, GRAMS, PAIRS = "docs", "words", "grams", "pairs"
_PART = pa.schema([("block", pa.string()), ("kind", pa.string()), ("bucket", pa.int64()), ("payload", pa.binary())])
_PART_DDL = "block string, kind string, bucket bigint, payload binary"


def _planes(a: np.ndarray) -> bytes:
    """An array of 8-byte numbers, byte plane by byte plane, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8).T).tobytes())


def _from_planes(b: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view(kind).reshape(-1)


def _pack(*arrays: np.ndarray) -> bytes:
    parts = [_planes(a) for a in arrays]
    return np.array([len(parts), *map(len, parts)], "<i8").tobytes() + b"".join(parts)


def _unpack(payload: bytes, *kinds: str) -> list[np.ndarray]:
    sizes = np.frombuffer(payload, "<i8", len(kinds), 8)
    ends = np.cumsum(sizes) + 8 * (1 + len(kinds))
    return [_from_planes(payload[e - s:e], k) for s, e, k in zip(sizes.tolist(), ends.tolist(), kinds)]


def _pack_counts(code: np.ndarray, count: np.ndarray) -> bytes:
    """Ascending codes, as steps, and their counts."""
    return _pack(np.diff(code, prepend=code.dtype.type(0)), count)


def _unpack_counts(payload: bytes, kind: str) -> tuple[np.ndarray, np.ndarray]:
    steps, count = _unpack(payload, kind, "<i8")
    return np.cumsum(steps, dtype=kind), count


def _normal(text: bytes) -> bytes:
    """Words in lower case with one space between: what is coded, before the end mark."""
    return b" ".join(text.lower().split())


def _grams(normal: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The gram of each coded byte of all documents, in order, and how many each document has."""
    pad = END * order
    whole = np.frombuffer(pad + (END + pad).join(normal) + END, np.uint8)
    n = len(whole) - order
    code = np.zeros(n, np.int64)
    for k in range(order + 1):
        code <<= 8
        code |= whole[k:k + n]
    lengths = np.array([len(t) + 1 for t in normal], np.int64)
    starts = np.cumsum(lengths + order) - (lengths + order)
    keep = np.zeros(n + 1, np.int32)
    np.add.at(keep, starts, 1)
    np.add.at(keep, starts + lengths, -1)
    return code[np.cumsum(keep[:-1]) > 0], lengths


def _word_codes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, _WORD_SEED) for w in words), np.uint64, len(words))


def _spread(code: np.ndarray, buckets: int) -> np.ndarray:
    return ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % buckets


def _gram_bucket(code: np.ndarray, buckets: int) -> np.ndarray:
    return _spread((code >> 8) & 0xFFFF, buckets)


def blocks(docs: DataFrame, order: int, buckets: int, id_col: str, text_col: str, folds: int, held: int) -> DataFrame:
    """The blocks and what they ask: (block, kind, bucket, payload)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        texts: list[bytes] = []
        ids: list[pa.Array] = []
        test: list[bool] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            name = f"{part}-{number}"
            is_test = np.array(test, bool)
            normal = [_normal(t) for t in texts]
            sink = pa.BufferOutputStream()
            table = pa.table({"doc_id": pa.concat_arrays(ids), "held": pa.array(is_test), "text": pa.array(normal, pa.binary())})
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(table)
            rows = [(name, DOCS, 0, sink.getvalue().to_pybytes())]
            trained: Counter[bytes] = Counter()
            asked: set[bytes] = set()
            for t, h in zip(normal, test):
                (asked if h else trained).update(t.split())
            words = list(trained.keys() | asked)
            code = _word_codes(words)
            count = np.fromiter((trained[w] for w in words), np.int64, len(words))
            rows += dealt(name, WORDS, code, count, _spread(code, buckets))
            gram, lengths = _grams(normal, order)
            trains = np.repeat(~is_test, lengths)
            known, n = np.unique(gram[trains], return_counts=True)
            every = np.union1d(known, gram[~trains])
            count = np.zeros(len(every), np.int64)
            count[np.searchsorted(every, known)] = n
            rows += dealt(name, GRAMS, every, count, _gram_bucket(every, buckets))
            pair = np.zeros(1 << 16, np.int64)
            np.add.at(pair, every & 0xFFFF, count)
            rows.append((name, PAIRS, 0, _pack(pair)))
            for row in rows:
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _PART.types)], schema=_PART)

        def dealt(name: str, kind: str, code: np.ndarray, count: np.ndarray, bucket: np.ndarray) -> list[tuple]:
            at = np.lexsort((code, bucket))
            code, count, bucket = code[at], count[at], bucket[at]
            ends = np.flatnonzero(np.r_[bucket[1:] != bucket[:-1], len(bucket) > 0]) + 1
            return [(name, kind, int(bucket[a]), _pack_counts(code[a:b], count[a:b])) for a, b in zip(np.r_[0, ends[:-1]], ends)]

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                for k, t in enumerate(piece.column(1).to_pylist()):
                    t = (t or "").encode()
                    if texts and size + len(t) > BLOCK_BYTES:
                        yield from flush()
                        texts, ids, test, size, number = [], [], [], 0, number + 1
                    texts.append(t)
                    ids.append(piece.column(0).slice(k, 1))
                    test.append(piece.column(2)[k].as_py())
                    size += len(t)
        if texts:
            yield from flush()

    fold = F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))) % folds == held
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string"), fold).mapInArrow(build, _PART_DDL)


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and for each element the place of its key."""
    found, at = np.unique(keys, return_inverse=True)
    return found, at


def gram_scores(code: np.ndarray, count: np.ndarray, order: int, pairs: np.ndarray) -> np.ndarray:
    """log10 probability of each gram of ``code`` (distinct; all that share their contexts'
    last two bytes are here) given counts, with ``pairs`` the counts of (byte, next byte)."""
    n = len(code)
    out, open_ = np.zeros(n), np.ones(n, bool)
    over_t, over_d = np.zeros(n), np.zeros(n)  # counts and number of the bytes excluded
    after = pairs.sum(0)
    for k in range(order, -1, -1):
        mask = (1 << (8 * (k + 1))) - 1
        gram = code & mask
        if k >= 2:
            grams, of_gram = _groups(gram)
            c = np.bincount(of_gram, count, len(grams))
            contexts, of_context = _groups(grams >> 8)
            t = np.bincount(of_context, c, len(contexts))[of_context][of_gram]
            d = np.bincount(of_context, c > 0, len(contexts))[of_context][of_gram]
            c = c[of_gram]
        elif k == 1:
            c, ctx = pairs.reshape(-1)[gram].astype(float), gram >> 8
            t, d = pairs.sum(1)[ctx].astype(float), (pairs > 0).sum(1)[ctx].astype(float)
        else:
            c, t, d = after[gram].astype(float), np.full(n, after.sum(), float), np.full(n, (after > 0).sum(), float)
        t_left, d_left = t - over_t, d - over_d
        hit = open_ & (c > 0)
        out[hit] += np.log10((c[hit] - DISCOUNT) / t_left[hit])
        open_ &= ~hit
        miss = open_ & (d_left > 0)
        out[miss] += np.log10(DISCOUNT * d_left[miss] / t_left[miss])
        if k:  # what the context of this order has is excluded in the next: its bytes, with their counts there
            below = code & (mask >> 8)
            if k - 1 >= 2:
                lower, at = _groups(below)
                c_low = np.bincount(at, count, len(lower))[at]
            elif k == 2:
                c_low = pairs.reshape(-1)[below].astype(float)
            else:
                c_low = after[below].astype(float)
            if k >= 2:
                first = np.zeros(len(grams), np.int64)
                first[of_gram] = np.arange(n)
                seen = np.bincount(of_gram, count, len(grams)) > 0
                over_t = np.bincount(of_context, np.where(seen, c_low[first], 0.0), len(contexts))[of_context][of_gram]
            else:
                over_t = ((pairs > 0) * after).sum(1)[gram >> 8].astype(float)
            over_d = d
    rest = 256 - int((after > 0).sum())
    out[open_] += -np.log10(max(rest, 1))
    return out


def _unpack_values(payload: bytes) -> np.ndarray:
    every, at = _unpack(payload, "<f8", "<i8")
    return every[at]


def _kind_of(kind: str) -> str:
    return "<u8" if kind == WORDS else "<i8"


def _added(payloads: list[bytes], kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes of several asks, ascending, and the sums of their counts."""
    code, count = (np.concatenate(x) for x in zip(*(_unpack_counts(p, kind) for p in payloads)))
    every, at = np.unique(code, return_inverse=True)
    return every, np.bincount(at, count, len(every)).astype(np.int64)


def _model(asks: DataFrame, order: int, pairs: np.ndarray, groups: int) -> DataFrame:
    """(kind, bucket, payload): for each bucket its codes and their values, a log-probability
    for a gram and a count for a word, and a row of kind stat with numbers of words.  Counts of
    ``groups`` groups of blocks are added up, ASKS of them at a time."""

    def add(key: tuple, group: pa.Table) -> pa.Table:
        kind = key[0].as_py()
        total = _pack_counts(*_added(group.column("payload").to_pylist(), _kind_of(kind)))
        return pa.table({"kind": [kind], "bucket": pa.array([key[1].as_py()], pa.int64()), "salt": pa.array([key[2].as_py()], pa.int64()), "payload": pa.array([total], pa.binary())})

    def packed(code: np.ndarray, value: np.ndarray) -> bytes:
        every, at = np.unique(value, return_inverse=True)
        return _pack(np.diff(code, prepend=code.dtype.type(0)), every, at)

    def close(key: tuple, group: pa.Table) -> pa.Table:
        kind, bucket = key[0].as_py(), key[1].as_py()
        code, count = _added(group.column("payload").to_pylist(), _kind_of(kind))
        if kind == WORDS:
            out = [(WORDS, bucket, packed(code, count.astype("<f8"))), ("stat", bucket, _pack(np.array([(count > 0).sum(), count.sum()], "<f8")))]
        else:
            out = [(GRAMS, bucket, packed(code, gram_scores(code, count, order, pairs)))]
        return pa.table({"kind": [r[0] for r in out], "bucket": pa.array([r[1] for r in out], pa.int64()), "payload": pa.array([r[2] for r in out], pa.binary())})

    rows = asks.select("kind", "bucket", "salt", "payload")
    while groups > 1:
        rows = rows.groupBy("kind", "bucket", "salt").applyInArrow(add, "kind string, bucket bigint, salt bigint, payload binary")
        rows = materialize(rows.withColumn("salt", F.floor(F.col("salt") / ASKS)), "sums")
        groups = -(-groups // ASKS)
    return materialize(rows.groupBy("kind", "bucket").applyInArrow(close, "kind string, bucket bigint, payload binary"), "model")


def _answers(asks: DataFrame, model: DataFrame, groups: int) -> DataFrame:
    """For each ask the values of its codes, in its order.  A bucket's model goes to each group of blocks."""

    def answer(key: tuple, group: pa.Table, known: pa.Table) -> pa.Table:
        if not group.num_rows:
            return _PART.empty_table()
        kind = key[0].as_py()
        code, every, at = _unpack(known.column("payload")[0].as_py(), _kind_of(kind), "<f8", "<i8")
        code = np.cumsum(code, dtype=_kind_of(kind))
        out = []
        for p in group.column("payload").to_pylist():
            own = at[np.searchsorted(code, _unpack_counts(p, _kind_of(kind))[0])]
            used = np.zeros(len(every), bool)
            used[own] = True
            out.append(_pack(every[used], (np.cumsum(used) - 1)[own]))
        return pa.Table.from_arrays([*(group.column(c).combine_chunks() for c in ("block", "kind", "bucket")), pa.array(out, pa.binary())], schema=_PART)

    each = model.where(F.col("kind") != "stat").select("kind", "bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("salt"), "payload")
    keys = ("kind", "bucket", "salt")
    return materialize(asks.groupBy(*keys).cogroup(each.groupBy(*keys)).applyInArrow(answer, _PART_DDL), "answers")


def _look_up(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """values at ``asked``, all of which are in ``keys``: through a table of slots; the few keys
    that another one has taken the slot of are searched for."""
    bits = max(int(len(keys)).bit_length() + 2, 4)
    slot = lambda x: ((x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
    owner = np.zeros(1 << bits, np.int32)
    owner[slot(keys)] = np.arange(len(keys), dtype=np.int32)
    at = owner[slot(asked)]
    wrong = np.flatnonzero(keys[at] != asked)
    at[wrong] = np.searchsorted(keys, asked[wrong])
    return values[at]


def score(docs: DataFrame, order: int = 5, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2, buckets: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score, n_bytes.

    Texts are lower-cased (A-Z) and cut into words at ASCII white space; each document ends
    with one end token.  ``score`` is the log10 probability of the words, one space between
    them, and the end under the byte model; ``base_score`` that under word frequencies with
    one added.  Both learn from the rows whose crc32(id as text) mod ``folds`` isn't
    ``held`` (a null id counts as an empty text).  A null or empty text is the end token
    alone.  Repeated rows are scored and counted as often as they come."""
    spark = docs.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = materialize(blocks(docs, order, n, id_col, text_col, folds, held), "blocks")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total = sum((_unpack(p.as_py(), "<i8")[0] for p in b.column(0)), np.zeros(1 << 16, np.int64))
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["pair", "n"])

    pairs = np.zeros((256, 256), np.int64)
    for pair, count in parts.where(F.col("kind") == PAIRS).select("payload").mapInArrow(spread, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n")).collect():  # at most 65,536 rows
        pairs[pair >> 8, pair & 255] = count
    n_blocks = parts.where(F.col("kind") == DOCS).count()
    groups = max(-(-n_blocks // ASKS), 1)
    asks = parts.where(F.col("kind").isin(WORDS, GRAMS)).withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(groups)))
    model = _model(asks, order, pairs, groups)
    answers = _answers(asks, model, groups)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.column(0):
                v, t = _unpack(p.as_py(), "<f8")[0].tolist()
                yield pa.RecordBatch.from_arrays([pa.array([int(v)]), pa.array([int(t)])], names=["v", "t"])

    ends = parts.where(F.col("kind") == DOCS).select("payload").mapInArrow(_count_training, "n bigint").agg(F.sum("n")).first()[0] or 0
    stat = model.where("kind = 'stat'").select("payload").mapInArrow(add_up, "v bigint, t bigint").agg(F.sum("v"), F.sum("t")).first()
    vocabulary, tokens = (stat[0] or 0) + (ends > 0), (stat[1] or 0) + ends
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, n_bytes bigint"

    def finish(key: tuple, own: pa.Table, got: pa.Table) -> pa.Table:
        table = pa.ipc.open_stream(own.column("payload")[0].as_py()).read_all().combine_chunks()
        normal = table.column("text").to_pylist()
        reply = {(k, b): p for k, b, p in zip(got.column("kind").to_pylist(), got.column("bucket").to_pylist(), got.column("payload").to_pylist())}
        values = lambda k, bucket: np.concatenate([_unpack_values(reply[k, b]) for b in np.unique(bucket).tolist()] or [np.zeros(0)])
        split = [t.split() for t in normal]
        words = list({w for s in split for w in s})
        code = _word_codes(words)
        bucket = _spread(code, n)
        # An ask holds each code once: two words of one code (there are none to speak of) share it.
        at = np.lexsort((code, bucket))
        count = np.zeros(len(words))
        count[at] = values(WORDS, bucket)
        cost = dict(zip(words, np.log10(count + 1).tolist()))
        unknown = {w for w, c in zip(words, count.tolist()) if not c}
        gram, lengths = _grams(normal, order)
        every = np.unique(gram)
        bucket = _gram_bucket(every, n)
        at = np.lexsort((every, bucket))
        value = np.zeros(len(every))
        value[at] = values(GRAMS, bucket)
        score_ = np.add.reduceat(_look_up(every, value, gram), np.cumsum(lengths) - lengths)
        n_tokens = np.array([len(s) + 1 for s in split])
        known = np.array([len(s) - sum(map(unknown.__contains__, s)) for s in split]) + (ends > 0)
        base = np.array([sum(map(cost.__getitem__, s)) for s in split]) + np.log10(ends + 1) - n_tokens * np.log10(tokens + vocabulary + 1)
        columns = [table.column("doc_id"), table.column("held"), pa.array(n_tokens), pa.array(known), pa.array(np.full(len(split), tokens)), pa.array(base), pa.array(score_), pa.array(lengths - 1)]
        return pa.table(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes"])

    own = parts.where(F.col("kind") == DOCS).groupBy("block")
    return own.cogroup(answers.where(F.col("kind").isin(WORDS, GRAMS)).groupBy("block")).applyInArrow(finish, schema)


def _count_training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for p in b.column(0):
            held = pa.ipc.open_stream(p.as_py()).read_all().column("held")
            yield pa.RecordBatch.from_arrays([pa.array([len(held) - (held.to_pylist().count(True))])], names=["n"])
