"""Business questions over a star: a fact, two dimensions e1 and e2 with names, a measure and a date."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Star:
    """fact has columns k1, k2 (keys), m (measure) and dt; e1 and e2 have key and name."""

    fact: DataFrame
    e1: DataFrame
    e2: DataFrame


def star(fact: DataFrame, k1: str, k2: str, m: str, dt: str, e1: DataFrame, e1_key: str, e1_name: str, e2: DataFrame, e2_key: str, e2_name: str) -> Star:
    dim = lambda df, key, name: df.select(F.col(key).alias("key"), F.col(name).alias("name"))
    # Money is added up as decimals, so that the order of rows doesn't matter.
    f = fact.select(F.col(k1).alias("k1"), F.col(k2).alias("k2"), F.col(m).cast("decimal(18,2)").alias("m"), F.col(dt).alias("dt"))
    return Star(f, dim(e1, e1_key, e1_name), dim(e2, e2_key, e2_name))


def _top(df: DataFrame, key: str, by: Column) -> DataFrame:
    """The key with the most, ties by the smaller key: one row."""
    return df.groupBy(F.col(key).alias("key")).agg(by.alias("x")).orderBy(F.desc("x"), "key").limit(1)


def _named(top: DataFrame, dim: DataFrame) -> DataFrame:
    return top.join(dim, "key", "left").select(F.coalesce("name", F.col("key").cast("string")).alias("answer"))


def _money(c: Column) -> Column:
    return F.round(c.cast("double"), 2).alias("answer")


N = F.count


def q01_count(s: Star) -> DataFrame:
    return s.fact.agg(N(F.lit(1)).alias("answer"))


def q02_top_e2(s: Star) -> DataFrame:
    return _named(_top(s.fact, "k2", N(F.lit(1))), s.e2)


def q03_distinct_e1(s: Star) -> DataFrame:
    return s.fact.agg(F.count_distinct("k1").alias("answer"))


def q04_sum(s: Star) -> DataFrame:
    return s.fact.agg(_money(F.sum("m")))


def q05_e1_of_max(s: Star) -> DataFrame:
    return _named(s.fact.where("m IS NOT NULL").orderBy(F.desc("m"), "k1").limit(1).select(F.col("k1").alias("key")), s.e1)


def q06_max(s: Star) -> DataFrame:
    return s.fact.agg(_money(F.max("m")))


def q07_mean_of_all(s: Star) -> DataFrame:
    """The sum over all rows, also those without a measure."""
    return s.fact.agg(_money(F.sum("m").cast("double") / N(F.lit(1))))


def q08_sum_in_top_month(s: Star) -> DataFrame:
    month = s.fact.groupBy(F.date_format("dt", "yyyy-MM").alias("month")).agg(N(F.lit(1)).alias("n"), F.sum("m").alias("m"))
    return month.orderBy(F.desc("n"), "month").limit(1).select(_money(F.col("m")))


def q09_rows_of_top_e1(s: Star) -> DataFrame:
    name = _named(_top(s.fact, "k1", N(F.lit(1))), s.e1).withColumnRenamed("answer", "name")
    keys = s.e1.join(F.broadcast(name), "name", "left_semi")  # one name
    return s.fact.join(keys, s.fact["k1"] == keys["key"], "left_semi").agg(N(F.lit(1)).alias("answer"))


def q10_busy_e1(s: Star) -> DataFrame:
    per = s.fact.groupBy("k1").agg(N(F.lit(1)).alias("n"))
    limit = per.agg(F.greatest(F.lit(1), F.floor(F.avg("n"))).alias("limit"))
    return per.crossJoin(F.broadcast(limit)).where("n > limit").agg(N(F.lit(1)).alias("answer"))  # one row


def q11_e2_of_max_sum(s: Star) -> DataFrame:
    return _named(_top(s.fact, "k2", F.sum("m")), s.e2)


def q12_e1_above_mean_sum(s: Star) -> DataFrame:
    per = s.fact.groupBy("k1").agg(F.sum("m").alias("m"))
    mean = per.agg(F.avg(F.col("m").cast("double")).alias("mean"))
    return per.crossJoin(F.broadcast(mean)).where(F.col("m").cast("double") > F.col("mean")).agg(N(F.lit(1)).alias("answer"))  # one row


def q13_e2_of_top_e1(s: Star) -> DataFrame:
    top = _top(s.fact, "k1", N(F.lit(1))).select("key")
    own = s.fact.join(F.broadcast(top), s.fact["k1"] == top["key"], "left_semi")  # one row
    return _named(_top(own, "k2", N(F.lit(1))), s.e2)


def q14_e2_most_e1(s: Star) -> DataFrame:
    return _named(_top(s.fact, "k2", F.count_distinct("k1")), s.e2)


STAR_QUESTIONS: dict[str, Callable[[Star], DataFrame]] = {
    f.__name__: f
    for f in (q01_count, q02_top_e2, q03_distinct_e1, q04_sum, q05_e1_of_max, q06_max, q07_mean_of_all, q08_sum_in_top_month, q09_rows_of_top_e1, q10_busy_e1,
              q11_e2_of_max_sum, q12_e1_above_mean_sum, q13_e2_of_top_e1, q14_e2_most_e1)
}


def table_questions(df: DataFrame, number: str, group: str, kind: str, label: str, value: str, only: str) -> dict[str, Callable[[], DataFrame]]:
    """q15 to q21 over one table: count, mean and largest ``number``, distinct ``kind``, most frequent
    ``group``, rows whose ``label`` is ``value``, mean ``number`` where ``group`` is ``only``."""
    x = F.col(number)
    return {
        "q15_count": lambda: df.agg(N(F.lit(1)).alias("answer")),
        "q16_mean": lambda: df.agg(_money(F.avg(x))),
        "q17_max": lambda: df.agg(_money(F.max(x))),
        "q18_distinct": lambda: df.agg(F.count_distinct(kind).alias("answer")),
        "q19_top_group": lambda: df.groupBy(group).agg(N(F.lit(1)).alias("n")).orderBy(F.desc("n"), group).limit(1).select(F.col(group).alias("answer")),
        "q20_count_label": lambda: df.where(F.col(label) == value).agg(N(F.lit(1)).alias("answer")),
        "q21_mean_where": lambda: df.where(F.col(group) == only).agg(_money(F.avg(x))),
    }


def extract_sql(text: str) -> str:
    """The SQL in a fenced text, or the text itself, without a last semicolon."""
    found = re.search(r"```(?:sql)?\s*(.*?)```", text, re.S | re.I)
    return (found[1] if found else text).strip().rstrip(";").strip()


def score_answer(spark: SparkSession, sql: str, truth: object, contains: bool = False) -> bool:
    """Is the first cell of the result right?  Texts are equal but for case (or contain it), counts are
    equal rounded, other numbers within 2 % or 0.5."""
    try:
        row = spark.sql(extract_sql(sql)).first()
    except Exception:  # noqa: BLE001  whatever a generated query does wrong, it is wrong
        return False
    if row is None or row[0] is None:
        return truth is None
    got = row[0]
    if isinstance(truth, str):
        a, b = truth.strip().lower(), str(got).strip().lower()
        return a in b if contains else a == b
    try:
        if isinstance(truth, int):
            return round(float(got)) == truth
        return abs(float(got) - truth) <= max(0.02 * abs(truth), 0.5)
    except (TypeError, ValueError):
        return False


def sql_structure(spark: SparkSession, sql: str, tables: set[str]) -> dict[str, bool]:
    """What a query is made of, and whether it only reads known tables."""
    text = extract_sql(sql)
    has = lambda p: bool(re.search(p, text, re.I | re.S))
    read = {t.lower() for _, t in re.findall(r"\b(from|join)\s+([a-z_]\w*)", text, re.I)}
    ctes = {t.lower() for t in re.findall(r"\b([a-z_]\w*)\s+as\s*\(", text, re.I)}
    return {
        "join": has(r"\bjoin\b"), "on": has(r"\bon\b"), "no_star": not has(r"select\s+\*"), "known_tables": read - ctes <= {t.lower() for t in tables},
        "subquery": has(r"\(\s*select\b"), "cte": has(r"^\s*with\b"), "having": has(r"\bhaving\b"), "one_column": _one_column(spark, text),
    }


def _one_column(spark: SparkSession, text: str) -> bool:
    try:
        return len(spark.sql(text).columns) == 1
    except Exception:  # noqa: BLE001
        return False


def accuracy_tier(predicted: Column, truth: Column) -> Column:
    """T1 to T4 by relative error up to 1, 5, 15 and 50 %, else T5."""
    e = F.abs(predicted - truth) / F.greatest(F.abs(truth), F.lit(1e-12))
    return F.when(predicted.isNull(), "T5").when(e <= 0.01, "T1").when(e <= 0.05, "T2").when(e <= 0.15, "T3").when(e <= 0.5, "T4").otherwise("T5")


def last_number(c: Column) -> Column:
    """The last number in a text, as double."""
    return F.try_element_at(F.regexp_extract_all(c, F.lit(r"(-?[0-9]+(?:\.[0-9]+)?)"), F.lit(1)), F.lit(-1)).cast("double")


def first_by_key(df: DataFrame, keys: list[str], order: str, last: bool = False) -> DataFrame:
    """Of rows with the same keys the first, or the last, by ``order``."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    pick = F.max_by(row, order) if last else F.min_by(row, order)
    return df.groupBy(*keys).agg(pick.alias("__row")).select("__row.*")
