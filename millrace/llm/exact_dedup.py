"""Exact dedup against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest.  Documents come in batches; a
batch is reduced to one row per digest before anything is shuffled by it, deduplicated
against the index by a sort-merge anti-join, and what is new is appended.  Which document
of a text stays is what the index says.
"""

from __future__ import annotations

import hashlib
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import SPACE, lookup, materialize, new_path, stay, unused

#: Batches that a call is dealt to, by id, so that later documents meet the earlier ones in the index.
BATCHES = 2
#: Files of a bucket, on average, beyond which the index is compacted.
COMPACT_AT = 8


def text_digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the text with every white-space run made one space; null is empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE, " "), 256)


class DigestIndex:
    """``digest -> keep_id, batch`` under ``path``, kept in ``buckets`` buckets sorted by digest.

    ``buckets`` is fixed when the index is made; open it again with the same number.  A batch
    adds a file to each bucket that it brings something new for; ``compact`` makes them one
    again, in a folder of its own that takes the old one's place when it is complete."""

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path, self.buckets = spark, path, buckets
        self._open(max(self._generations(), default=0))

    def _folder(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _generations(self) -> list[int]:
        """Numbers of the complete folders."""
        fs, at = self._folder(self.path)
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        return [int(n[1:]) for n in names if re.fullmatch("g[0-9]+", n) and (n == "g0" or fs.exists(self._folder(f"{self.path}/{n}/_SUCCESS")[1]))]

    def _name(self, generation: int) -> str:
        return f"digest_index_{hashlib.md5(self.path.encode()).hexdigest()[:16]}_{generation}"

    def _open(self, generation: int) -> None:
        self.generation, self.table = generation, self._name(generation)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest STRING, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/g{generation}'")

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def files(self) -> int:
        fs, at = self._folder(f"{self.path}/g{self.generation}")
        return sum(f.getPath().getName().startswith("part-") for f in fs.listStatus(at)) if fs.exists(at) else 0

    def add(self, groups: DataFrame, batch: str) -> None:
        """Append the digests of ``groups`` (digest, keep_id) that are new, as those of ``batch``.  Running
        it again after a failure, with the same rows and name, appends what is still missing and nothing twice."""
        known = self.read().select("digest").hint("merge")
        fresh = groups.select("digest", "keep_id", F.lit(batch).alias("batch")).join(known, "digest", "left_anti")
        fresh.repartition(self.buckets, "digest").write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)
        if self.files() > COMPACT_AT * self.buckets:
            self.compact()

    def compact(self) -> None:
        """One sorted file for each bucket.  The folder before the last one goes."""
        new = self.generation + 1
        self.read().repartition(self.buckets, "digest").write.mode("overwrite").bucketBy(self.buckets, "digest").sortBy("digest").option("path", f"{self.path}/g{new}").saveAsTable(self._name(new))
        fs, at = self._folder(f"{self.path}/g{self.generation - 1}")
        if fs.exists(at):
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(self.generation - 1)}")
            fs.delete(at, True)
        self._open(new)


def group_digests(digests: DataFrame, index: DigestIndex, batch: str, batches: int = BATCHES) -> DataFrame:
    """One row per digest of ``digests`` (doc_id, digest, and tag, which differs between rows):
    digest, keep_id, group_size, keep_tag (null if an earlier call has brought the text).

    Documents with smaller ids go to the index first, null ids last, in ``batches`` batches."""
    cuts = digests.agg(F.percentile_approx(F.col("doc_id").cast("long"), [k / batches for k in range(1, batches)])).first()[0] if batches > 1 else None
    part = sum((F.coalesce((F.col("doc_id") > F.lit(c)).cast("int"), F.lit(1)) for c in cuts or []), F.lit(0))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")).alias("first")
    groups = materialize(digests.groupBy("digest", part.alias("part")).agg(first, F.count(F.lit(1)).alias("n")), "groups")
    names = [f"{batch}/{k}" for k in range(batches)]
    for k, name in enumerate(names):
        index.add(groups.where(F.col("part") == k).select("digest", F.col("first.doc_id").cast("long").alias("keep_id")), name)
    each = groups.groupBy("digest").agg(F.min("first").alias("first"), F.sum("n").alias("group_size"))
    kept = index.read().select("digest", F.col("keep_id"), F.col("batch").isin(names).alias("new")).hint("merge")
    return materialize(each.join(kept, "digest").select("digest", "keep_id", "group_size", F.when(F.col("new"), F.col("first.tag")).alias("keep_tag")), "verdicts")


def open_index(spark: SparkSession, path: str | None = None, buckets: int | None = None) -> DigestIndex:
    """The index at ``path``, or a new one in the shared folder."""
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return DigestIndex(spark, path or new_path(spark, "digest-index"), n)


def mark_duplicates(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are after ``text_digest``; of equal ones the row with the
    smallest id stays (a null id comes last; of rows with the same id, one).  Ids are
    integers.  With an index of earlier calls, a text that it has is dropped and keep_id is
    the earlier row's; group_size counts this call's rows.  ``batch`` names the call: after a
    failure, the same call under the same name gives what it would have given.  Null and
    empty texts are one group like any other; an empty table gives no rows; further columns
    of ``docs`` are not read."""
    index = index or open_index(docs.sparkSession)
    digests = materialize(
        docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_digest(F.col(f"`{text_col}`")).alias("digest"),
                    F.monotonically_increasing_id().alias("tag")), "digests")
    found = lookup(digests, group_digests(digests, index, batch or uuid.uuid4().hex), "digest", "group_size")
    return found.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("tag") == F.col("keep_tag"), F.lit(False)).alias("kept"), F.col("digest").alias("text_sha256"))


def drop_duplicates(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay under the rules of ``mark_duplicates``, all columns kept."""
    index = index or open_index(docs.sparkSession)
    digest = unused(docs, "__digest")
    digests = materialize(docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_digest(F.col(f"`{text_col}`")).alias("digest"), F.lit(0).cast("long").alias("tag")), "digests")
    chosen = group_digests(digests, index, batch or uuid.uuid4().hex).where("keep_tag is not null").select("digest", F.col("keep_id").alias("id"))
    kept = stay(docs.withColumn(digest, text_digest(F.col(f"`{text_col}`"))), id_col, digest, chosen)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
