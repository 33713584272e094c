"""Approximate nearest neighbours by learned partitions.

On a bounded sample, a graph of nearest neighbours is cut into equal parts by recursive
bisection (the second eigenvector of each piece, refined by swaps).  A softmax classifier
learns the parts of a vector and its neighbours; it puts every row into its most probable
part.  A part that is still too large is cut in the same way by a classifier of its own,
fitted on a sample of its rows, so that parts keep their size however many rows there are.

How many parts a query is sent to is set on held-out queries, none of which the classifier
at the root was fitted on: their exact neighbours in the whole table must be found with
the recall asked for.  In the parts, candidates are ranked by exact inner products.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import lookup, materialize

#: Distinct vectors that a classifier is fitted on, at most (about: below the root).
SAMPLE = 8192
#: Held-out queries that set how many parts are visited.
HELD_OUT = 256
#: A classifier tells 2 ** FAN_BITS parts apart, at most.
FAN_BITS = 8
#: Tables of a row for each part are broadcast up to so many parts (16 bytes each).
FEW_PARTS = 1 << 16
#: Candidates and queries that meet in one task.
BLOCK = 4096
#: Rows that a part has on average.
PART_ROWS = 1024


def neighbour_graph(x: np.ndarray, k: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Edges (i, j) of the symmetric graph of the ``k`` largest inner products of each row."""
    n = len(x)
    k = min(k, n - 1)
    if k < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    near = np.empty((n, k), np.int64)
    for a in range(0, n, 1024):
        s = x[a:a + 1024] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        near[a:a + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    i, j = np.repeat(np.arange(n), k), near.reshape(-1)
    pairs = np.unique(np.concatenate([i * n + j, j * n + i]))
    return pairs // n, pairs % n


def _bisect(nodes: np.ndarray, i: np.ndarray, j: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """True for the half of ``nodes`` (numbered 0.. in the edges) on the right of a small balanced cut."""
    n = len(nodes)
    degree = np.maximum(np.bincount(i, minlength=n), 1)
    root = np.sqrt(degree)
    first = root / np.linalg.norm(root)
    v = rng.standard_normal(n)
    for _ in range(60):
        v -= first * (first @ v)
        v = v + np.bincount(i, (v / root)[j], n) / root  # (1 + normalised adjacency) / 2, up to scale
        v /= max(np.linalg.norm(v), 1e-12)
    side = np.zeros(n, bool)
    side[np.argsort(v / root, kind="stable")[n // 2:]] = True
    for _ in range(8):  # swap the nodes that have most neighbours on the other side
        across = np.bincount(i, side[i] != side[j], n)
        gain = 2 * across - np.bincount(i, minlength=n)
        left, right = (np.flatnonzero(side == s) for s in (False, True))
        left, right = (at[np.argsort(-gain[at], kind="stable")] for at in (left, right))
        m = min(len(left), len(right))
        good = int((gain[left[:m]] + gain[right[:m]] > 2).sum())
        if not good:
            break
        good = max(good // 2, 1)
        side[left[:good]], side[right[:good]] = True, False
    return side


def balanced_parts(n: int, i: np.ndarray, j: np.ndarray, levels: int, seed: int = 42) -> np.ndarray:
    """A part from 0 to 2**levels - 1 for each of ``n`` nodes, equal in size."""
    rng = np.random.default_rng(seed)
    part = np.zeros(n, np.int64)
    for _ in range(levels):
        new = part * 2
        for p in np.unique(part):
            nodes = np.flatnonzero(part == p)
            where = np.full(n, -1)
            where[nodes] = np.arange(len(nodes))
            own = (where[i] >= 0) & (where[j] >= 0)
            new[nodes] += _bisect(nodes, where[i[own]], where[j[own]], rng)
        part = new
    return part


def train_softmax(x: np.ndarray, target: np.ndarray, rounds: int = 60, decay: float = 1e-4) -> np.ndarray:
    """Weights (dimensions + 1, parts) of a softmax regression on the target distributions."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros((a.shape[1], target.shape[1]))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        s = a @ w
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = a.T @ (p - target) / len(a) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def fit_router(x: np.ndarray, bits: int) -> np.ndarray:
    """Weights (dimensions + 1, parts) of the classifier of ``2 ** bits`` parts, learned on the sample ``x``;
    of one part where the sample is too small to cut."""
    if bits <= 0 or len(x) < 4 << bits:
        return np.zeros((x.shape[1] + 1, 1))
    i, j = neighbour_graph(x)
    part = balanced_parts(len(x), i, j, bits)
    target = np.zeros((len(x), 1 << bits))
    np.add.at(target, (i, part[j]), 1.0)
    target /= np.maximum(target.sum(1, keepdims=True), 1)
    target[np.arange(len(x)), part] += 1
    return train_softmax(x, target / target.sum(1, keepdims=True))


def ranked_parts(weights: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Parts of each row, the most probable first."""
    return np.argsort(-(x @ weights[:-1] + weights[-1]), axis=1, kind="stable")


def _matrix(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    """A column of vectors of ``d`` components as doubles."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def _prepared(table: DataFrame, query: Column, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v, asks, d, key): the rows that take part; key is a digest of the vector, the same for -0 and 0."""
    kind = table.schema[vector_col].dataType.simpleString()
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").alias("v"), F.coalesce(query, F.lit(False)).alias("asks")).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(1)
            flat = v.flatten()
            numbers = flat.to_numpy(zero_copy_only=False) + flat.type.to_pandas_dtype()(0)  # a null is nan here
            ends = np.cumsum(v.value_lengths().to_numpy())
            starts = ends - v.value_lengths().to_numpy()
            if not len(ends):
                continue
            fine = np.logical_and.reduceat(np.isfinite(numbers), starts) & np.logical_or.reduceat(numbers != 0, starts)
            at = np.flatnonzero(fine)
            raw, width = numbers.tobytes(), numbers.itemsize
            key = [hashlib.blake2b(raw[width * s:width * e], digest_size=16).hexdigest() for s, e in zip(starts[at].tolist(), ends[at].tolist())]
            kept = b.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array((ends - starts)[at].astype(np.int32)), pa.array(key)], names=["vec_id", "v", "asks", "d", "key"])

    return rows.mapInArrow(run, f"vec_id bigint, v {kind}, asks boolean, d int, key string")


def _share_of_keys(share: float) -> Column:
    """Is a row's key, a digest, among the first ``share`` of all there can be?"""
    return F.col("key") < F.lit(f"{min(int(share * 16**8), 16**8 - 1):08x}" if share < 1 else "g")


def _sizes(df: DataFrame, name: str) -> DataFrame:
    return materialize(df.groupBy("part").agg(F.count(F.lit(1)).alias("n")), name)


def _with_part(rows: DataFrame, parts: DataFrame, few: bool) -> DataFrame:
    return rows.join(F.broadcast(parts) if few else parts, "part")


def _children(b: pa.RecordBatch | pa.Table, names: list[str], weights: np.ndarray, bits: int, most: int, parent: np.ndarray, toward: int | None) -> pa.RecordBatch:
    """The rows of ``b`` in their ``most`` most probable parts below ``parent``."""
    found = ranked_parts(weights, _matrix(b.column(names.index("v")), len(weights) - 1))[:, :most]
    at = np.repeat(np.arange(b.num_rows), found.shape[1])
    part = (parent[at] << bits) + found.reshape(-1)
    place = np.tile(np.arange(found.shape[1]), b.num_rows)
    if toward is not None:
        right = np.flatnonzero(part == b.column(names.index("home")).to_numpy()[at] >> toward)
        at, part, place = at[right], part[right], place[right]
    whole = b.take(pa.array(at))
    keep = [k for k, n in enumerate(names) if n not in ("part", "place")]
    cols = [whole.column(k).combine_chunks() if isinstance(whole, pa.Table) else whole.column(k) for k in keep]
    return pa.RecordBatch.from_arrays([*cols, pa.array(part, pa.int64()), pa.array(place.astype(np.int32))], names=[*(names[k] for k in keep), "part", "place"])


class PartTree:
    """Classifiers above one another.  ``bits`` says how many parts a classifier of each level tells
    apart; the root's weights are an array, those of a level below a table (part, weights)."""

    def __init__(self, root: np.ndarray, bits: list[int], d: int):
        self.root, self.bits, self.d = root, bits, d
        self.below: list[DataFrame] = []

    def _schema(self, rows: DataFrame) -> str:
        return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("part", "place")) + ", part bigint, place int"

    def enter(self, rows: DataFrame, most: int, toward: int | None = None) -> DataFrame:
        """``rows`` (with v) in their ``most`` most probable parts of the root: part, and place, its rank from 0.
        With ``toward`` only the part that the row's home, so many bits further down, is in."""
        names, weights, bits = rows.columns, self.root, self.bits[0]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k in range(0, b.num_rows, 4096):
                    c = b.slice(k, 4096)
                    yield _children(c, names, weights, bits, most, np.zeros(c.num_rows, np.int64), toward)

        return rows.mapInArrow(run, self._schema(rows))

    def descend(self, rows: DataFrame, level: int, most: int, few: bool, toward: int | None = None) -> DataFrame:
        """``rows`` of parts of the level above in their ``most`` most probable parts of this level, as ``enter``.
        Parts with many rows are dealt to several tasks, each with the weights."""
        names, bits, d = rows.columns, self.bits[level], self.d
        blocks = _sizes(rows, "sizes").select("part", F.ceil(F.col("n") / (16 * BLOCK)).cast("int").alias("m"))
        salted = _with_part(rows, blocks, few).select(*rows.columns, F.pmod(F.xxhash64("key"), F.col("m")).cast("int").alias("salt"))
        weights = _with_part(self.below[level - 1], blocks, few).select("part", "weights", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("salt"))

        def run(_: tuple, own: pa.Table, got: pa.Table) -> pa.Table:
            own = own.select(names)
            w = np.frombuffer(got.column("weights")[0].as_py(), np.float64).reshape(d + 1, -1) if own.num_rows else np.zeros((d + 1, 1))
            return pa.Table.from_batches([_children(own, names, w, bits, most, own.column("part").to_numpy(), toward)])

        return salted.groupBy("part", "salt").cogroup(weights.groupBy("part", "salt")).applyInArrow(run, self._schema(rows))

    def fit_below(self, rows: DataFrame, level: int, sample: int, few: bool) -> None:
        """Fit a classifier for each part of ``rows``, on about ``sample`` rows of it, those with the smallest hash."""
        bits, d = self.bits[level], self.d
        counts = _sizes(rows, "sizes")
        drawn = _with_part(rows, counts, few).where(F.pmod(F.xxhash64("key", F.lit(level)), F.lit(1 << 30)) < F.lit(float(sample << 30)) / F.col("n")).select("part", "key", "v")

        def run(key: tuple, own: pa.Table) -> pa.Table:
            own = own.sort_by("key")
            w = fit_router(_matrix(own.column("v"), d), bits)
            return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "weights": pa.array([w.tobytes()], pa.binary())})

        made = materialize(drawn.groupBy("part").applyInArrow(run, "part bigint, weights binary"), "routers")
        # A part of which nothing was drawn isn't cut.
        whole = counts.join(made, "part", "left_anti").select("part", F.lit(np.zeros(self.d + 1).tobytes()).alias("weights"))
        self.below.append(materialize(made.unionByName(whole), "routers"))

    def walk(self, rows: DataFrame, probes: list[int], few: bool) -> DataFrame:
        """``rows`` in the ``probes`` most probable parts of each level."""
        out = self.enter(rows, probes[0])
        for level in range(1, len(self.bits)):
            out = self.descend(materialize(out, "walk"), level, probes[level], few)
        return out


def part_bits(points: int, part_rows: int) -> list[int]:
    """The bits of each level for parts of about ``part_rows`` of ``points``."""
    bits = max(ceil(log2(max(points / part_rows, 1))), 0)
    depth = max(-(-bits // FAN_BITS), 1)
    return [bits * (k + 1) // depth - bits * k // depth for k in range(depth)]


def _top(q: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, inner product) of the ``k`` best of each query, and of all that may tie with the last:
    a matrix product only chooses, what it may be off by is allowed for."""
    s = q @ c.T
    m = min(k, len(c))
    slack = 4 * q.shape[1] * np.finfo(np.float64).eps * np.linalg.norm(q, axis=1, keepdims=True) * np.linalg.norm(c, axis=1).max()
    least = -np.partition(-s, m - 1, axis=1)[:, m - 1:m]
    i, j = np.nonzero(s >= least - slack)
    return i, j, np.einsum("ij,ij->i", q[i], c[j])


def set_probes(homes: DataFrame, tree: PartTree, held: DataFrame, recall: float, k: int, few: bool) -> list[int]:
    """The fewest parts of each level in which the exact ``k`` nearest of the ``held`` rows (key, v) are found with
    ``recall``.  Their neighbours in the whole of ``homes`` are looked for, partition by partition."""
    asks = held.toPandas()  # HELD_OUT rows
    keys, d = asks["key"].tolist(), tree.d
    q = np.array(asks["v"].tolist(), np.float64).reshape(len(keys), d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[float, int, str]]] = [[] for _ in keys]
        for b in batches:
            part, own = b.column(1).to_numpy(), b.column(2).to_pylist()
            for a in range(0, b.num_rows, 8192):
                i, j, s = _top(q, _matrix(b.column(0).slice(a, 8192), d), k + 1)
                for x, y, z in zip(i.tolist(), (j + a).tolist(), s.tolist()):
                    if own[y] != keys[x]:
                        best[x].append((z, int(part[y]), own[y]))
            best = [sorted(r, reverse=True)[:k] for r in best]
        rows = [(keys[x], s, p) for x, r in enumerate(best) for s, p, _ in r]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.float64(), pa.int64()))], names=["key", "score", "home"])

    near = homes.select("v", "part", "key").mapInArrow(run, "key string, score double, home bigint")
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "home"))
    near = materialize(near.withColumn("n", rank).where(F.col("n") <= k).join(held, "key").select("key", "v", "home"), "held-near")
    out = []
    total = sum(tree.bits)
    rows = near
    for level, bits in enumerate(tree.bits):
        # The rank of the home's own part among those of its parent.
        total -= bits
        reached = tree.enter(rows, 1 << bits, total) if level == 0 else tree.descend(rows, level, 1 << bits, few, total)
        reached = materialize(reached, f"held-{level}")
        share = reached.groupBy("place").count().orderBy("place").collect()  # a row for each of a classifier's parts
        seen = np.cumsum([r["count"] for r in share]) / max(sum(r["count"] for r in share), 1)
        out.append(int(share[int(np.searchsorted(seen, recall ** (1 / len(tree.bits)) - 1e-12))]["place"]) + 1 if share else 1)
        rows = reached.drop("place")
    return out


def search(table: DataFrame, query: Column | None = None, k: int = 20, recall: float = 0.94, id_col: str = "vec_id", vector_col: str = "embedding",
           part_rows: int = PART_ROWS, sample: int = SAMPLE) -> DataFrame:
    """The ``k`` rows with the largest inner product for each row for which ``query`` holds
    (ids divisible by 20 by default): query_id, rank from 1, vec_id, score.

    Rows without a vector, with a null or non-finite component, all zeros, a null id, or
    another dimension than most, take no part.  A row is not its own neighbour; ties go to
    the smaller id; repeated rows (same id and vector) count once.  If there are fewer
    candidates, all are given.  An empty table gives no rows; other columns aren't read."""
    spark = table.sparkSession
    ident = F.col(f"`{id_col}`")
    rows = materialize(_prepared(table, query if query is not None else ident % 20 == 0, id_col, vector_col), "vectors")
    size = rows.groupBy("d").count().orderBy(F.desc("count"), "d").first()
    if size is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    d = size["d"]
    # Of equal vectors only the k + 1 smallest ids can be a neighbour.
    keyed = rows.where(F.col("d") == d)
    lowest = Window.partitionBy("key").orderBy("vec_id")
    ids = keyed.select("key", "vec_id", "v").dropDuplicates(["key", "vec_id"]).withColumn("n", F.row_number().over(lowest)).where(F.col("n") <= k + 1)
    points = ids.groupBy("key").agg(F.first("v").alias("v"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    points = materialize(points, "points")
    asked = materialize(keyed.where("asks").groupBy("key").agg(F.first("v").alias("v"), F.count_distinct("vec_id").alias("n")), "queries")
    n_points = points.count()
    total = keyed.select("vec_id", "key").distinct().count() if n_points <= 4 * k else n_points  # only whether there are k others counts

    # A sample of the smallest digests; the share is cut first, so tasks send no more than is taken.
    drawn = min(sample, -(-n_points * 7 // 8))
    fitted = points.select("key", "v").where(_share_of_keys(2 * drawn / n_points)).orderBy("key").limit(drawn).toPandas()
    x = np.array(fitted["v"].tolist(), np.float64).reshape(len(fitted), d)
    bits = part_bits(n_points, part_rows)
    few = 1 << sum(bits) <= FEW_PARTS
    tree = PartTree(fit_router(x, bits[0]), bits, d)
    homes = materialize(tree.enter(points, 1), "homes")
    for level in range(1, len(bits)):
        tree.fit_below(homes, level, sample, few)
        homes = materialize(tree.descend(homes, level, 1, few), "homes")
    whole = [1 << b for b in bits]
    probes = whole
    last = fitted["key"].max() if len(fitted) else ""
    if sum(bits):
        outside = asked.where(F.col("key") > last)
        held = materialize(outside.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < F.lit(float(HELD_OUT << 21)) / F.lit(max(outside.count(), 1))).orderBy(F.xxhash64("key")).select("key", "v").limit(HELD_OUT), "held-out")
        if not held.isEmpty():
            probes = set_probes(homes, tree, held, recall, k, few)
    best = materialize(_merge(_meet(homes, tree.walk(asked.select("key", "v"), probes, few), d, k, few), k), "best")
    want = min(k + 1, total)
    short = asked.join(best.where(F.size("near") >= want).select("key"), "key", "left_anti").select("key", "v")
    if probes != whole and not short.isEmpty():
        again = _merge(_meet(homes, tree.walk(short, whole, few), d, k, few), k)
        best = materialize(best.where(F.size("near") >= want).unionByName(again), "best")
    who = materialize(keyed.where("asks").select("key", F.col("vec_id").alias("query_id")).distinct(), "who")
    both = lookup(who, materialize(best.join(asked.select("key", "n"), "key"), "answers"), "key", "n")
    near = F.slice(F.filter("near", lambda p: p["vec_id"] != F.col("query_id")), 1, k)
    out = both.select("query_id", F.posexplode(near).alias("at", "p"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "p.vec_id", "p.score")


_NEAR = pa.struct([("away", pa.float64()), ("vec_id", pa.int64())])


def _meet(homes: DataFrame, visits: DataFrame, d: int, k: int, few: bool) -> DataFrame:
    """(key, near): for each query and block of candidates that it meets, its best there.  Blocks of a
    part with many rows meet the blocks of its queries two by two."""
    visits = materialize(visits.select("key", "v", "part"), "visits")
    blocks = lambda df, name, m: _sizes(df, name).select("part", F.ceil(F.col("n") / BLOCK).cast("int").alias(m))
    both = materialize(blocks(homes, "home-sizes", "pm").join(blocks(visits, "visit-sizes", "qm"), "part"), "blocks")
    block = lambda m: F.pmod(F.xxhash64("key"), F.col(m)).cast("int")
    span = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    left = _with_part(homes, both, few).select("key", "v", "ids", "part", block("pm").alias("pb"), span("qm").alias("qb"))
    right = _with_part(visits, both, few).select("key", "v", "part", block("qm").alias("qb"), span("pm").alias("pb"))

    def meet(_: tuple, own: pa.Table, asks: pa.Table) -> pa.Table:
        if not own.num_rows or not asks.num_rows:
            return pa.schema([("key", pa.string()), ("near", pa.list_(_NEAR))]).empty_table()
        c, q = _matrix(own.column("v"), d), _matrix(asks.column("v"), d)
        held = own.column("ids").combine_chunks()
        ids, sizes = held.flatten().to_numpy(), held.value_lengths().to_numpy().astype(np.int64)
        firsts = np.cumsum(sizes) - sizes
        counts, away_all, ids_all = [], [], []
        for a in range(0, len(q), 512):
            i, j, s = _top(q[a:a + 512], c, k + 1)
            n = sizes[j]
            at = np.repeat(firsts[j] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            rows, away, v = np.repeat(i, n), -np.repeat(s, n), ids[at]
            order = np.lexsort((v, away, rows))
            rows, v, away = rows[order], v[order], away[order]
            top = np.arange(len(rows)) - np.searchsorted(rows, rows, "left") <= k
            counts.append(np.bincount(rows[top], minlength=min(512, len(q) - a)))
            away_all.append(away[top])
            ids_all.append(v[top])
        ends = np.r_[0, np.cumsum(np.concatenate(counts))].astype(np.int32)
        pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(away_all)), pa.array(np.concatenate(ids_all))], names=["away", "vec_id"])
        return pa.table({"key": asks.column("key"), "near": pa.ListArray.from_arrays(pa.array(ends), pairs)})

    return left.groupBy("part", "pb", "qb").cogroup(right.groupBy("part", "pb", "qb")).applyInArrow(meet, "key string, near array<struct<away:double,vec_id:bigint>>")


def _merge(found: DataFrame, k: int) -> DataFrame:
    """(key, near): the k + 1 best of each query, best first."""
    # One short list for each block that a query met, so they go into one array.
    best = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k + 1)
    near = F.transform(best, lambda p: F.struct(p["vec_id"].alias("vec_id"), (-p["away"]).alias("score")))
    return found.groupBy("key").agg(near.alias("near"))
