"""Runs of neighbours under an order: of equal values, or of values that grow by the same step.

The table is range-partitioned once.  Each part finds its own runs; only the runs at the
edges of parts, two or three of each, are put together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.storage import materialize


def _changes(a: pa.Array) -> np.ndarray:
    """Is an element another one than that before it?  Nulls are equal, and so are NaNs."""
    if len(a) < 2:
        return np.zeros(0, bool)
    now, before = a[1:], a[:-1]
    differ = pc.fill_null(pc.not_equal(now, before), False).to_numpy(zero_copy_only=False)
    if pa.types.is_floating(a.type):
        nan = np.isnan(a.to_numpy(zero_copy_only=False)) & a.is_valid().to_numpy(zero_copy_only=False)
        differ &= ~(nan[1:] & nan[:-1])
    return differ | (now.is_null().to_numpy(zero_copy_only=False) != before.is_null().to_numpy(zero_copy_only=False))


def _steps(a: pa.Array) -> pa.Array:
    """Differences of neighbours, null before the first and where one of the two is null."""
    return pa.concat_arrays([pa.nulls(1, pa.int64()), pc.subtract(a[1:], a[:-1])]) if len(a) else pa.array([], pa.int64())


def _local_runs(df: DataFrame, order: list[str], name: str, steps: bool) -> DataFrame:
    """(part, k, start, length, key, value, last): the runs of each part in order.  With ``steps`` the first
    row of a part is a run of its own, whose key isn't known there."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select((F.col(f"`{name}`").cast("long") if steps else F.col(f"`{name}`")).alias("v"), *[F.col(f"`{o}`").alias(f"o{i}") for i, o in enumerate(order)])
    keys = [f"o{i}" for i in range(len(order))]
    laid = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select("v")
    kind = laid.schema["v"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, k, tail, open_ = TaskContext.get().partitionId(), 0, 0, None, None
        # open_ is the run that may go on: start, its key and its first value, as arrays of one element.
        for b in batches:
            v = b.column(0)
            if not len(v):
                continue
            both = v if tail is None else pa.concat_arrays([tail, v])
            key = _steps(both) if steps else both
            fresh = np.r_[True, _changes(key)]  # does a run start here?
            if steps and tail is None and len(fresh) > 1:
                fresh[1] = True
            if tail is not None:
                fresh[0] = False
                if steps:  # the step to the first new row is compared with the open run's
                    fresh[1] = at == 1 or _changes(pa.concat_arrays([open_[1], key[1:2]]))[0]
            heads = np.flatnonzero(fresh)
            shift = at - (tail is not None)
            if open_ is not None and len(heads):
                yield _rows(part, [k], [open_[0]], [heads[0] + shift - open_[0]], open_[1], open_[2], both[int(heads[0]) - 1:int(heads[0])])
                k += 1
            if len(heads):
                done, last = heads[:-1], int(heads[-1])
                if len(done):
                    ends = heads[1:]
                    yield _rows(part, np.arange(k, k + len(done)), done + shift, ends - done, key.take(pa.array(done)), both.take(pa.array(done)), both.take(pa.array(ends - 1)))
                    k += len(done)
                open_ = (last + shift, key[last:last + 1], both[last:last + 1])
            at += len(v)
            tail = v[len(v) - 1:]
        if open_ is not None:
            yield _rows(part, [k], [open_[0]], [at - open_[0]], open_[1], open_[2], tail)

    def _rows(part: int, k, start, length, key: pa.Array, value: pa.Array, last: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(k), part), pa.int64()), pa.array(k, pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), key, value, last],
            names=["part", "k", "start", "length", "key", "value", "last"])

    return materialize(laid.mapInArrow(run, f"part bigint, k bigint, start bigint, length bigint, key {kind}, value {kind}, last {kind}"), "runs")


def _joined(local: DataFrame, steps: bool) -> DataFrame:
    """(start, value, key, length): the runs of the whole order."""
    by = Window.orderBy("part")  # a row for each part
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    ends = local.groupBy("part").agg(
        F.sum("length").alias("n"), F.count(F.lit(1)).alias("runs"), F.min_by(F.struct("key", "value"), "k").alias("head"), F.max_by(F.struct("key", "last"), "k").alias("end"),
        F.max(F.when(F.col("k") == 1, F.struct("key"))).alias("second"))
    ends = ends.withColumn("first", F.lag(F.lit(False), 1, True).over(by))
    if steps:
        # The step from the part before to the first row, and with it the key of the first run.
        ends = ends.withColumn("key0", F.col("head.value") - F.lag("end.last").over(by))
        ends = ends.withColumn("final", F.when(F.col("runs") == 1, F.col("key0")).otherwise(F.col("end.key")))
        joins_next = (F.col("runs") > 1) & F.col("second.key").eqNullSafe(F.col("key0")) & ~F.col("first")
    else:
        ends = ends.withColumn("key0", F.col("head.key")).withColumn("final", F.col("end.key"))
        joins_next = F.lit(False)
    # With steps, the very first row has no step: it is a run of its own.
    joins = ~F.col("first") & F.col("key0").eqNullSafe(F.lag("final").over(by)) & ~((F.lag("n").over(by) == 1) & F.lag("first").over(by) if steps else F.lit(False))
    ends = ends.withColumn("joins", joins).withColumn("next", joins_next)
    ends = ends.withColumn("base", F.coalesce(F.sum(F.col("runs") - F.col("joins").cast("long") - F.col("next").cast("long")).over(before), F.lit(0)))
    ends = ends.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    rows = local.join(F.broadcast(ends.select("part", "runs", "key0", "joins", "next", "base", "offset")), "part")
    number = F.col("base") + F.col("k") - F.col("joins").cast("long") - F.when(F.col("k") > 0, F.col("next").cast("long")).otherwise(0)
    rows = rows.select(number.alias("number"), (F.col("start") + F.col("offset")).alias("start"), "value", F.when(F.col("k") == 0, F.col("key0")).otherwise(F.col("key")).alias("key"), "length",
                       ((F.col("k") <= 1) | (F.col("k") == F.col("runs") - 1)).alias("edge"))
    row = F.min_by(F.struct("value", "key"), "start").alias("head")
    edges = rows.where("edge").groupBy("number").agg(F.min("start").alias("start"), row, F.sum("length").alias("length")).select("start", "head.value", "head.key", "length")
    return rows.where("NOT edge").select("start", "value", "key", "length").unionByName(edges)


def value_runs(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """(start, value, length): runs of equal neighbours under ``order``, which must tell rows apart."""
    return _joined(_local_runs(df, order, name, False), False).select("start", "value", "length")


def step_runs(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """(start, value, delta, length): runs of rows that differ from the row before by the same number; the first
    row is a run of its own with delta null."""
    return _joined(_local_runs(df, order, name, True), True).select("start", "value", F.col("key").alias("delta"), "length")
