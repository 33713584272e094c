"""SimHash near-dedup: fingerprints, a grid range-join on segment popcounts, components.

A fingerprint of 64 bits is seen as 32 segments of two bits, and embedded as the number of
set bits of each (0 to 2).  The Manhattan distance of two embeddings is never more than
the number of bits in which the fingerprints differ.  If it is at most r, and the segments
are dealt into g > r groups, then at least g - r groups are equal in both: so each
fingerprint goes into one grid cell for every choice of g - r groups, and any two within r
meet in a cell.  There, the difference of the popcounts of whole fingerprints and then the
Manhattan distance of all segments are lower bounds of the distance, and what is left is
compared exactly.  A cell gives a spanning forest of its links, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations
from math import comb, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import components, hook, lookup, materialize, stay, unused

SEED = 42
SEGMENTS = 32
#: Fingerprints that meet in one task; a cell with more is split into blocks that meet two by two.
CELL = 4096
#: Bits of information in an embedded segment: two random ones are equal with probability 3/8.
SEGMENT_BITS = -np.log2(3 / 8)


def _spread_table() -> np.ndarray:
    """For each byte its bits, one in each byte of a 64-bit word."""
    return np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view("<u8").reshape(-1)


SPREAD = _spread_table()


def shingle_hashes(text: bytes, words: int) -> list[int]:
    """XXH64 of each run of ``words`` words, lower-cased and joined by one space; of all of a shorter text."""
    split = text.lower().split()
    if not split:
        return []
    if len(split) <= words:
        return [xxhash.xxh64_intdigest(b" ".join(split), SEED)]
    whole = b" ".join(split)
    lengths = np.fromiter(map(len, split), np.int64, len(split)) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths).tolist()
    h = xxhash.xxh64_intdigest
    return [h(whole[s:e], SEED) for s, e in zip(starts, (ends[words - 1:] - 1).tolist())]


def majority(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The fingerprint of each document: bit set if it is in over half of its hashes."""
    out = np.zeros(len(lengths), np.uint64)
    full = np.flatnonzero(lengths)
    if not len(full):
        return out
    n = lengths[full]
    first = np.cumsum(n) - n
    runs = -(-n // 255)  # a byte counts to 255
    of = np.repeat(np.arange(len(n)), runs)
    starts = first[of] + 255 * (np.arange(len(of)) - np.repeat(np.cumsum(runs) - runs, runs))
    raw = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    bits = np.zeros((len(n), 64), bool)
    heads = np.cumsum(runs) - runs
    for k in range(8):
        sums = np.add.reduceat(SPREAD[raw[:, k]], starts)
        counts = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), heads)
        bits[:, 8 * k:8 * k + 8] = 2 * counts > n[:, None]
    out[full] = np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(-1)
    return out


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                each = [shingle_hashes((t or "").encode(), words) for t in b.column(1).to_pylist()]
                lengths = np.fromiter(map(len, each), np.int64, len(each))
                hashes = np.fromiter((h for e in each for h in e), np.uint64, int(lengths.sum()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(majority(hashes, lengths).view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")).mapInArrow(run, f"doc_id {kind}, fp bigint")


def embed(fps: np.ndarray) -> np.ndarray:
    """The popcount of each two-bit segment in its place, written 00, 01 or 11: so the Manhattan distance of
    two embeddings is the number of bits in which they differ."""
    low = np.uint64(0x5555555555555555)
    a, b = fps & low, (fps >> np.uint64(1)) & low
    return (a | b) | ((a & b) << np.uint64(1))


def _group_count(distinct: int, radius: int) -> int:
    """The fewest groups whose cells hold about a thousand of ``distinct`` random fingerprints, or fewer."""
    g = radius + 1
    while g < SEGMENTS and distinct / 2 ** (SEGMENT_BITS * SEGMENTS * (g - radius) / g) > 1000:
        g += 1
    return g


def _cell_masks(groups: int, radius: int) -> list[int]:
    edges = [SEGMENTS * k // groups for k in range(groups + 1)]
    part = [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(edges, edges[1:])]
    return [sum(part[k] for k in chosen) for chosen in combinations(range(groups), groups - radius)]


def link_cell(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among ``fps``: pairs of fingerprints."""
    weight = np.bitwise_count(fps).astype(np.int64)
    at = np.argsort(weight, kind="stable")
    fps, weight = fps[at], weight[at]
    e = embed(fps)
    label = np.arange(len(fps))
    for k in range(0, len(fps), 128):
        rows = slice(k, min(k + 128, len(fps)))
        last = np.searchsorted(weight, weight[rows.stop - 1] + radius, "right")  # a lower bound of the distance
        i, j = np.nonzero(np.bitwise_count(e[rows, None] ^ e[None, k:last]) <= radius)  # and a closer one
        keep = i < j
        i, j = i[keep], j[keep]
        keep = np.bitwise_count(fps[k + i] ^ fps[k + j]) <= radius
        if keep.any():
            label = hook(label, i[keep] + k, j[keep] + k)
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return fps[moved], fps[label[moved]]


def link(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """Links (a, b) between the fingerprints of ``distinct`` (fp): all that are within
    ``radius`` bits are connected by them, and none that isn't reached through such pairs."""
    spark = distinct.sparkSession
    n = distinct.count()
    groups = _group_count(n, radius)
    masks = np.array(_cell_masks(groups, radius), np.uint64)
    assert len(masks) == comb(groups, radius)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mix = np.uint64(0x9E3779B97F4A7C15)
        for b in batches:
            fps = b.column(0).to_numpy().view(np.uint64)
            e = embed(fps)
            for k, m in enumerate(masks):
                key = ((e & m) + np.uint64(k)) * mix  # cells whose keys are equal by chance just meet
                key ^= key >> np.uint64(29)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fps.view(np.int64))], names=["cell", "fp"])

    rows = materialize(distinct.select("fp").mapInArrow(cells, "cell bigint, fp bigint"), "cells")
    hot = materialize(rows.groupBy("cell").count().where(F.col("count") > CELL).select("cell", F.ceil(F.col("count") / CELL).alias("m")), "hot-cells")
    few = hot.count() <= 4096
    dealt = rows.join(F.broadcast(hot) if few else hot, "cell", "left").select("cell", "fp", F.coalesce("m", F.lit(1)).cast("int").alias("m"))
    own = F.pmod(F.xxhash64("fp"), F.col("m")).cast("int")
    dealt = dealt.select("cell", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("other")).select(
        "cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = dealt.repartition(parts, "cell", "i", "j").sortWithinPartitions("cell", "i", "j")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            fps = np.unique(np.concatenate(held)).view(np.uint64)
            if len(fps) > 1:
                a, b = link_cell(fps, radius)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            cell, i, j, fp = (batch.column(k).to_numpy() for k in range(4))
            cuts = np.flatnonzero((cell[1:] != cell[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            for s, e in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(cell)].tolist()):
                if s == e:
                    continue
                now = (cell[s], i[s], j[s])
                if held and now != key:
                    yield from close()
                    held = []
                key = now
                held.append(fp[s:e])
        if held:
            yield from close()

    return sorted_.mapInArrow(meet, "a bigint, b bigint").distinct()


def near_groups(docs: DataFrame, words: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id, component_size.

    Fingerprints of runs of ``words`` words, repeats counted; a text of fewer words is one
    run, a null or empty one has fingerprint 0 and links like any other.  Documents whose
    fingerprints differ in at most ``radius`` bits are linked; component_id is the smallest
    id that can be reached (null if all of a component are null)."""
    fps = materialize(fingerprints(docs, words, id_col, text_col), "fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "distinct")
    labels = components(link(distinct, radius))
    nodes = materialize(distinct.join(labels, distinct["fp"] == labels["node"], "left").select("fp", "first", "n", F.coalesce("label", "fp").alias("label")), "nodes")
    found = materialize(nodes.groupBy("label").agg(F.min("first").alias("component_id"), F.sum("n").alias("component_size"), F.count(F.lit(1)).alias("members")), "components")
    table = materialize(lookup(nodes, found, "label", "members").select("fp", "n", "component_id", "component_size"), "by-fingerprint")
    return lookup(fps, table, "fp", "n").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "component_size")


# Similarity of sets instead of a number of bits: fingerprints and least hashes give candidates, the sets decide.

#: Least hashes that a table's cells are made of: sets of similarity s share a cell of it with probability s ** LEAST.
LEAST = 8
#: Of pairs just as similar as asked for, the share that no table brings together.
MISSED = 0.001
#: Documents, and shingles, that candidates' blocks hold; two blocks meet in a task.
BLOCK, BLOCK_SHINGLES = 256, 1 << 18
#: Of a group of more than a block, so many documents are compared with all others first.
LEADERS = 32


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(np.array(shingle_hashes((text or "").encode(), words), np.uint64))


def table_count(similarity: float) -> int:
    """As many tables as bring together all but MISSED of the pairs at ``similarity``."""
    return int(np.ceil(log(MISSED) / log(1 - similarity ** LEAST))) if similarity < 1 else 1


def least_cells(sets: list[np.ndarray], tables: int) -> np.ndarray:
    """For each set, none of them empty, its cell in each table: a hash of LEAST least hashes."""
    factors = np.random.default_rng(SEED).integers(1, 1 << 63, (tables, LEAST), np.uint64) * np.uint64(2) + np.uint64(1)
    hashes = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), tables), np.uint64)
    for t, own in enumerate(factors):
        key = np.full(len(sets), t + 1, np.uint64)
        for f in own:
            key = (key ^ np.minimum.reduceat(hashes * f, starts)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        out[:, t] = key
    return out


def shingle_nodes(docs: DataFrame, words: int, tables: int, id_col: str, text_col: str) -> DataFrame:
    """(id, digest, node, n, cells, fp): digest is a hash of the text, node one of its set of n shingles,
    cells has its cell in each table (none for an empty set), fp is the fingerprint of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                b = whole.slice(at, 200)
                sets = [shingle_set(t, words) for t in b.column(2).to_pylist()]
                n = np.array([len(s) for s in sets], np.int64)
                node = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
                full = [s for s in sets if len(s)]
                flat = least_cells(full, tables).reshape(-1).view(np.int64) if full else np.zeros(0, np.int64)
                ends = np.r_[0, np.cumsum((n > 0) * tables)].astype(np.int32)
                fp = majority(np.concatenate([np.zeros(0, np.uint64), *full]), n).view(np.int64)
                cells = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(node), pa.array(n), cells, pa.array(fp)], names=["id", "digest", "node", "n", "cells", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`"), F.xxhash64(text), text).mapInArrow(run, f"id {kind}, digest bigint, node bigint, n bigint, cells array<bigint>, fp bigint")


def link_sets(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of ``sets``, none of them empty, whose Jaccard similarity is ``similarity`` or more.

    A set meets all that aren't reached yet, so a group of copies costs a row each; only sets
    that aren't linked meet all others."""
    p, q = Fraction(str(similarity)).as_integer_ratio()
    left = np.argsort([len(s) for s in sets], kind="stable")
    size = np.array([len(s) for s in sets], np.int64)
    every, flat = np.unique(np.concatenate([sets[k] for k in left]), return_inverse=True)
    inside = np.zeros(len(every), np.int64)
    links, reached = [], []
    while len(left):
        ends = np.cumsum(size[left])
        if reached:
            k, own = reached.pop()
        else:
            k, own, left, flat, ends = int(left[0]), flat[:ends[0]], left[1:], flat[ends[0]:], ends[1:] - ends[0]
        n = size[left]
        lo, hi = np.searchsorted(n * q, p * size[k]), np.searchsorted(n * p, q * size[k], "right")
        if lo >= hi:
            continue
        starts = ends - n
        inside[own] = 1
        both = np.add.reduceat(inside[flat[starts[lo]:ends[hi - 1]]], starts[lo:hi] - starts[lo])
        inside[own] = 0
        near = lo + np.flatnonzero(both * q >= p * (size[k] + n[lo:hi] - both))
        if len(near):
            links += [(k, x) for x in left[near].tolist()]
            reached += [(x, flat[s:e]) for x, s, e in zip(left[near].tolist(), starts[near].tolist(), ends[near].tolist())]
            stays = np.ones(len(left), bool)
            stays[near] = False
            left, flat = left[stays], flat[np.repeat(stays, n)]
    return links


def candidate_groups(found: DataFrame, radius: int) -> DataFrame:
    """(node, label): the nodes of ``found`` that share a cell, directly or through others.

    Fingerprints that ``link`` connects are a cell, too.  A cell gives a star around its
    smallest node.  It is no more than a candidate: sets with one label meet later, whether
    they share a cell or not."""
    sets = found.groupBy("node").agg(F.first("fp").alias("fp"))
    near = materialize(components(link(found.select("fp").distinct(), radius)), "near-fingerprints")
    alike = sets.join(near, sets["fp"] == near["node"], "left").select(sets["node"], F.xxhash64(F.lit("fingerprint"), F.coalesce("label", "fp")).alias("cell"))
    rows = materialize(found.select("node", F.explode("cells").alias("cell")).unionByName(alike), "cells")
    heads = rows.groupBy("cell").agg(F.min("node").alias("head"), F.max("node").alias("last"), F.count(F.lit(1)).alias("rows")).where("head <> last")
    heads = materialize(heads.select("cell", "head", "rows"), "heads")
    return components(lookup(rows, heads, "cell", "rows").select(F.col("head").alias("a"), F.col("node").alias("b")))


def _by_group(rows: DataFrame, keys: list[str], then: list[str] = ()) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *keys).sortWithinPartitions(*keys, *then)


def _texts(docs: DataFrame, dealt: DataFrame) -> DataFrame:
    """(node, text) of the rows of ``dealt`` (node, own_id, own_digest).  All texts are shuffled for it, once and at any size."""
    own = dealt.select("node", "own_id", "own_digest").hint("merge")
    return materialize(docs.join(own, (F.col("digest") == F.col("own_digest")) & F.col("id").eqNullSafe(F.col("own_id"))).select("node", "text"), "candidates")


def _links(pairs: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    if pairs:
        yield pa.RecordBatch.from_arrays([pa.array(ends, pa.int64()) for ends in zip(*pairs)], names=["a", "b"])


def _meet(texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links among the documents of each (label, i, j) of ``texts`` (label, i, j, node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}

        def close() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                nodes = list(held)
                yield from _links([(nodes[x], nodes[y]) for x, y in link_sets(list(held.values()), similarity)])

        for b in batches:
            for *now, node, t in zip(*(b.column(k).to_pylist() for k in range(5))):
                if now != key:
                    yield from close()
                    key, held = now, {}
                if node not in held:  # a row can be there twice
                    held[node] = shingle_set(t, words)
        yield from close()

    return _by_group(texts.select("label", "i", "j", "node", "text"), ["label", "i", "j"]).mapInArrow(run, "a bigint, b bigint")


def _led(texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links between the documents of each (label, i) of ``texts`` (label, i, place, node, text) and its leaders, which
    have place 0: a document is linked to one leader of each group of linked leaders that it is similar to."""
    p, q = Fraction(str(similarity)).as_integer_ratio()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sets, group, found = None, [], [], None, []
        for b in batches:
            for label, i, place, node, t in zip(*(b.column(k).to_pylist() for k in range(5))):
                if (label, i) != key:
                    key, nodes, sets, group = (label, i), [], [], None
                own = shingle_set(t, words)
                if place == 0:
                    nodes.append(node)
                    sets.append(own)
                    continue
                if group is None:  # all leaders are there
                    ends = np.array(link_sets(sets, similarity), np.int64).reshape(-1, 2)
                    group = hook(np.arange(len(sets)), ends[:, 0], ends[:, 1])
                    found += [(nodes[x], nodes[y]) for x, y in ends.tolist()]
                done = set()
                for k, other in enumerate(sets):
                    if group[k] in done or not p * max(len(own), len(other)) <= q * min(len(own), len(other)):
                        continue
                    both = np.intersect1d(own, other, assume_unique=True).size
                    if both * q >= p * (len(own) + len(other) - both):
                        done.add(group[k])
                        found.append((node, nodes[k]))
            yield from _links(found)
            found = []

    return _by_group(texts.select("label", "i", "place", "node", "text"), ["label", "i"], ["place"]).mapInArrow(run, "a bigint, b bigint")


def similar_sets(docs: DataFrame, groups: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links (a, b) between nodes: all whose sets are so similar and that have one label are connected
    by them, and none that isn't reached through such pairs.  ``docs`` has (id, digest, text),
    ``groups`` (node, label, id, digest, n), whose first texts these are.

    A label of one block meets in a task.  Of one with more documents or shingles, all are first
    compared with LEADERS of them, which connects most of what can be; then those outside of the
    largest connected part meet all others, block by block.  So a group of copies costs a comparison
    or a few for each, and only what isn't alike costs more."""
    sizes = groups.groupBy("label").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    sized = materialize(sizes.select("label", "members", blocks.alias("m")), "sizes")
    dealt = lookup(groups, sized, "label", "members").select("node", "label", F.col("id").alias("own_id"), F.col("digest").alias("own_digest"), "m", F.pmod(F.xxhash64("node"), F.col("m")).cast("int").alias("own"))
    dealt = materialize(dealt, "dealt")
    texts = _texts(docs, dealt)
    with_text = lambda rows: texts.join(rows.hint("merge"), "node")
    small, large = (dealt.where(f"m {sign} 1") for sign in ("=", ">"))
    todo = small.select("label", F.lit(0).alias("i"), F.lit(0).alias("j"), "node")
    if large.isEmpty():
        return _meet(with_text(todo), words, similarity)
    first = large.groupBy("label", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(LEADERS)).alias("k")).agg(F.min(F.struct("node", "m")).alias("x"))
    leaders = first.select("label", F.explode(F.sequence(F.lit(0), F.col("x.m") - 1)).alias("i"), F.lit(0).alias("place"), "x.node")
    members = large.select("label", F.col("own").alias("i"), F.lit(1).alias("place"), "node")
    led = materialize(_led(with_text(leaders.unionByName(members)), words, similarity), "led")
    parts = components(led).select(F.col("node").alias("end"), F.col("label").alias("part"))
    parted = materialize(large.join(parts, large["node"] == parts["end"], "left").select(large["*"], F.coalesce("part", "node").alias("part")), "parted")
    counts = parted.groupBy("label", "part").agg(F.count(F.lit(1)).alias("n"))
    most = counts.groupBy("label").agg(F.max_by("part", F.struct("n", "part")).alias("largest"), (F.sum("n") - F.max("n")).alias("rest")).where("rest > 0")
    most = materialize(most.select(F.col("label").alias("of"), "largest", F.ceil(F.col("rest") / BLOCK).cast("int").alias("u")), "open")
    # A row for each label of more than a block that isn't one part: fewer than documents by BLOCK.
    still = parted.join(most, parted["label"] == most["of"])
    every = still.select("label", F.explode(F.sequence(F.lit(0), F.col("u") - 1)).alias("i"), F.col("own").alias("j"), "node")
    outside = still.where("part <> largest").select("label", F.pmod(F.xxhash64("node", F.lit(2)), F.col("u")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("j"), "node")
    todo = todo.unionByName(every).unionByName(outside)
    return _meet(with_text(todo), words, similarity).unionByName(led)


def drop_near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without its near duplicates, all columns kept: of documents that are linked,
    directly or through others, the one with the smallest id stays (null last).

    Linked are documents whose sets of ``words``-word shingles have a Jaccard similarity of
    ``similarity`` or more, by the sets of 64-bit hashes themselves.  Candidates are those
    whose fingerprints differ in at most ``radius`` bits, found on the grid of popcounts, and,
    as similar sets can differ in more bits than the grid can bridge, those that meet in
    tables of least hashes, in which all but MISSED of pairs just so similar do.  All that are
    reached from each other through either are compared.  Texts of fewer words are one
    shingle, empty and null ones are alike; of repeated rows one stays."""
    found = materialize(shingle_nodes(docs, words, table_count(similarity), id_col, text_col), "shingles")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest")).alias("first")
    nodes = materialize(found.groupBy("node").agg(F.first("n").alias("n"), first), "nodes")
    groups = materialize(candidate_groups(found, radius).join(nodes, "node").select("node", "label", "first.id", "first.digest", "n"), "groups")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("digest"), text.alias("text"))
    labels = components(similar_sets(texts, groups, words, similarity))
    own = nodes.join(labels, "node", "left").select(F.coalesce("label", "node").alias("label"), "first")
    chosen = own.groupBy("label").agg(F.min("first").alias("first")).select(F.col("first.id").alias("id"), F.col("first.digest").alias("digest"))
    digest = unused(docs, "__digest")
    kept = stay(docs.withColumn(digest, F.xxhash64(text)), id_col, digest, materialize(chosen, "chosen"))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
