"""What the operators of this folder share: the shared folder, joins that survive
hot keys, ranks over a whole table, and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.storage import materialize, new_path, ranked, scratch, shared_folder  # noqa: F401
from millrace.storage import unused_name as unused  # noqa: F401

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: A key is hot if it holds more than one row in HOT_KEYS; so there are fewer hot keys than this.
HOT_KEYS = 512
#: Links that a task puts together (16 bytes each).
BLOCK_EDGES = 1 << 17


def lookup(rows: DataFrame, table: DataFrame, key: str, weight: str) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has one row per key and, in ``weight``,
    the number of ``rows`` with that key.

    Keys with more than 1/HOT_KEYS of all rows are fewer than HOT_KEYS, so their part of
    ``table`` is broadcast; all others meet in a sort-merge join whose keys are none of
    them hot.  Both inputs are read more than once: hand over materialised ones."""
    total, most = table.agg(F.sum(weight), F.max(weight)).first()
    if not total or most * HOT_KEYS <= total:
        return rows.join(table, key)
    share = F.col(weight) * F.lit(HOT_KEYS) > F.lit(int(total))
    hot = F.broadcast(table.where(share))
    cold = table.where(~share)
    few = rows.join(hot, key)
    rest = rows.join(F.broadcast(table.where(share).select(key)), key, "left_anti").join(cold, key)
    return few.unionByName(rest)


def stay(docs: DataFrame, id_col: str, digest: str, chosen: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id and ``digest`` (a column of theirs) are a row (id, digest)
    of ``chosen``; of repeated rows, one.

    What is joined on is the pair, so a digest that many rows share is no hot key.  The rows are
    shuffled once at any size: a small ``chosen`` isn't broadcast, so that disk grows as the input does."""
    pairs = materialize(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(digest).alias("d")).groupBy("id", "d").count().where("count > 1"), "repeated")
    match = lambda a, b: (a[digest] == b["d"]) & a[id_col].eqNullSafe(b["id"])
    both = docs.join(chosen.hint("merge"), (docs[digest] == chosen["digest"]) & docs[id_col].eqNullSafe(chosen["id"]), "left_semi")
    once = both.join(pairs, match(both, pairs), "left_anti")
    more = both.join(pairs, match(both, pairs), "left_semi").dropDuplicates([digest, id_col])
    return once.unionByName(more)


def hook(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge the labels of linked rows; labels are row numbers, the smallest wins."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components of the edges of one task: each node and the smallest of its component, itself included."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if held:
        a, b = (np.concatenate(x) for x in zip(*held))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        label = hook(np.arange(len(nodes)), at[:len(a)], at[len(a):])
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a long, b long): one row (node, label) per node
    that has an edge; label is the smallest node of its component.

    Edges are dealt to blocks of BLOCK_EDGES, each of which is made a forest of stars in a task;
    while that leaves far fewer, they are dealt again.  If more than a block is left,
    large-star and small-star steps alternate: every step points the neighbours of a node
    at the smallest node around it, so after about log2(size) rounds the edges are stars.
    Each step deals rows by node; a hub's rows are added up with ``min`` before the shuffle
    and joined back through ``lookup``, so no task holds a hub."""
    pair = lambda df: df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialize(pair(edges), "edges")
    m = now.count()
    while True:
        blocks = max(-(-m // BLOCK_EDGES), 1)
        stars = materialize(now.repartition(blocks).mapInArrow(_stars, "a bigint, b bigint"), "stars")
        if blocks == 1:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("label"))
        now = materialize(pair(stars), "edges")
        before, m = m, now.count()
        if m > before * 0.7:
            break
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("w")), "least")
        large = materialize(pair(lookup(both, least, "a", "w").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))), "large")
        down = materialize(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("w")), "down")
        small = lookup(large, down, "a", "w")
        now = materialize(pair(small.select("a", F.col("m").alias("b")).unionByName(small.select(F.col("b").alias("a"), F.col("m").alias("b")))), "small")
        # Stars: every node on the left has one edge, and no centre is on the left.
        ends = now.select(F.col("a").alias("node"), F.lit(1).alias("left"), F.lit(0).alias("right")).unionByName(now.select(F.col("b").alias("node"), F.lit(0).alias("left"), F.lit(1).alias("right")))
        if ends.groupBy("node").agg(F.sum("left").alias("left"), F.max("right").alias("right")).where((F.col("left") > 1) | (F.col("left") == 1) & (F.col("right") == 1)).isEmpty():
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
