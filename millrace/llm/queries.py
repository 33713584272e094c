"""The queries of this folder: op1_... to op10_... over the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.chat import repair

    return repair(_table(spark, sf_dir, "conversations"))


def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.substring_dedup import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.simhash import near_groups

    return near_groups(_table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


def op5_ann_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.ann import search

    return search(_table(spark, sf_dir, "embeddings"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.quality import fit, score

    docs = _table(spark, sf_dir, "documents")
    return score(docs, fit(docs, _table(spark, sf_dir, "labels")))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.exact_dedup import mark_duplicates

    return mark_duplicates(_table(spark, sf_dir, "documents"))


def op8_pack_nnls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.lm_score import score

    return score(_table(spark, sf_dir, "documents"))


def op10_token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.binary_rows import packed_rows

    return packed_rows(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_chat_repair, op2_repeated_passages, op3_simhash, op4_mix_sources, op5_ann_partitions, op6_quality_rules, op7_exact_dedup, op8_pack_nnls, op9_lm_score, op10_token_rows)}

ORACLE_SQL = {
    "op7_exact_dedup": r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)""",
}
