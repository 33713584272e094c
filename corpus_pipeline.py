"""A corpus pipeline: quality, exact dedup, near dedup, mixing and packing, in that order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.common import materialize, scratch
from millrace.llm.exact_dedup import drop_duplicates
from millrace.llm.mixing import apply_mix
from millrace.llm.packing import pack
from millrace.llm.quality import fit, keep_good
from millrace.llm.simhash import drop_near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, fitted on the labelled ones, scores 0.3 or more.

    Null and empty texts have the statistics of an empty text, repeated rows are judged alike;
    without labels every score is 0.5, so all stay.  All columns are kept."""
    return keep_good(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same text, white space aside, the one with the smallest doc_id.

    A null id is larger than any other, null and empty texts are one group, of repeated rows
    one stays.  All columns are kept."""
    return drop_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 in five-word shingles, the one with the smallest doc_id.

    A null id is larger than any other; a text of fewer words is one shingle; null and empty
    texts are alike, of repeated rows one stays.  All columns are kept."""
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: not at all, or up to three times.

    Null sources are one source, the last; texts without words are never taken; repeated
    rows are documents of their own.  All columns are kept."""
    return apply_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, repeats included, with their place in sequences of 2048 tokens.

    Null and empty texts are one token, the end; other columns than doc_id and text aren't read."""
    return pack(docs)


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Quality, near dedup, mixing and packing aren't expressible in SQL; tests/llm/test_pipeline.py holds each stage, on what
#: its predecessor has kept, against a plain version, and the run against the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written as Parquet and read again by the next.  An empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch(spark):  # what a stage has written for itself goes when its result is there
            docs = materialize(stage(spark, docs, sf_dir), name, keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
