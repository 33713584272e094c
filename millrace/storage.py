"""The folder that driver and executors share, tables written to it, and orders over whole tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session without that setting gets a temporary folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    set_before = spark.sparkContext.getCheckpointDir()
    if set_before:
        return set_before
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
    return spark.sparkContext.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/millrace-{name}-{uuid.uuid4().hex}"


#: What has been written inside of each open ``scratch``, the innermost last.
_open: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialised inside are deleted at the end, unless they are to be kept.  A result that is still
    to be read must be written, or materialised with ``keep``, before that."""
    made: list[str] = []
    _open.append(made)
    try:
        yield
    finally:
        _open.remove(made)
        for path in made:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, name: str, keep: bool = False, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there,
    and a lost executor costs only the tasks that it ran.  See ``scratch`` for how long it stays.
    With ``by``, rows of each value of that column have files of their own, so those of one value are read alone."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    if _open and not keep:
        _open[-1].append(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    return back.select(*[F.col(f"`{c}`") for c in df.columns]) if by else back  # Spark puts that column last


def unused_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ranked(df: DataFrame, order: list[Column], rank: str, sums: dict[str, str] | None = None, partitions: int | None = None) -> DataFrame:
    """Add the 0-based ``rank`` of each row under ``order`` and, for each (name, column) of
    ``sums``, the sum of that column over the rows before it.

    No task sees the whole table: it is range-partitioned once and written, each part adds
    up what it has, and only one row per part goes through a window."""
    sums = sums or {}
    part, local = unused_name(df, "__part"), unused_name(df, "__local")
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = materialize(df.repartitionByRange(n, *order).withColumn(part, F.spark_partition_id()), "ranked")
    inside = Window.partitionBy(part).orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    out = laid.withColumn(local, F.row_number().over(inside) - F.lit(1).cast("long"))
    zero = {c: F.coalesce(F.sum(v).over(before), F.lit(0)) for c, v in sums.items()}
    for c, v in zero.items():
        out = out.withColumn(c, v)
    totals = laid.groupBy(part).agg(F.count(F.lit(1)).alias("__rows"), *[F.sum(v).alias(f"__sum_{c}") for c, v in sums.items()])
    prior = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        part, F.coalesce(F.sum("__rows").over(prior), F.lit(0)).alias("__rows"),
        *[F.coalesce(F.sum(f"__sum_{c}").over(prior), F.lit(0)).alias(f"__sum_{c}") for c in sums])
    out = out.join(F.broadcast(starts), part)
    out = out.withColumn(rank, (F.col("__rows") + F.col(local)).cast("long"))
    for c in sums:
        out = out.withColumn(c, F.col(f"__sum_{c}") + F.col(c))
    return out.drop(part, local, "__rows", *[f"__sum_{c}" for c in sums])


def with_previous(df: DataFrame, order: list[Column], columns: list[str], position: str = "_pos", prefix: str = "prev_") -> DataFrame:
    """Each row's 0-based ``position`` under ``order`` and, in ``prefix`` columns, the values of
    ``columns`` in the row before (null in the first).  Like ``ranked``, no task sees the whole table."""
    part = unused_name(df, "__part")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = materialize(df.repartitionByRange(n, *order).withColumn(part, F.spark_partition_id()), "ordered")
    inside = Window.partitionBy(part).orderBy(*order)
    keep = F.struct(*columns) if columns else F.struct(F.lit(0).alias("none"))
    own = laid.withColumn("__local", F.row_number().over(inside)).withColumn("__lag", F.lag(keep).over(inside)).withColumn("__row", keep)
    ends = own.groupBy(part).agg(F.count(F.lit(1)).alias("__n"), F.max_by("__row", "__local").alias("__end"))
    prior = Window.orderBy(part)  # a row for each part
    starts = F.broadcast(ends.select(
        part, F.coalesce(F.sum("__n").over(prior.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.lag("__end").over(prior).alias("__carry")))
    out = own.join(starts, part)
    before = F.when(F.col("__local") > 1, F.col("__lag")).otherwise(F.col("__carry"))
    out = out.withColumn(position, (F.col("__before") + F.col("__local") - 1).cast("long"))
    for c in columns:
        out = out.withColumn(prefix + c, before[c])
    return out.drop(part, "__local", "__lag", "__row", "__n", "__end", "__before", "__carry")
