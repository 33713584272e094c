"""Reports over records of answers: segments, cross tables, latencies, seeds, invariants, and what a table looks like to who asks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.statistics import wilson
from millrace.plans.workload import accuracy_tier, last_number


def segments(records: DataFrame, by: list[str], ok: str = "ok", confidence: float = 0.95) -> DataFrame:
    """For each combination of ``by``: n, ok, acc and its Wilson interval low to high.  A null value is "?"."""
    names = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("?")).alias(c) for c in by]
    counted = records.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(ok)).alias("ok"))
    w = wilson(F.col("ok"), F.col("n"), confidence)
    return counted.withColumn("acc", F.col("ok") / F.col("n")).withColumn("w", w).select(*by, "n", "ok", "acc", F.col("w.low").alias("low"), F.col("w.high").alias("high"), (F.col("w.high") - F.col("w.low")).alias("width"))


def cross_table(records: DataFrame, rows: str, columns: str, values: list[str], ok: str = "ok", confidence: float = 0.95) -> DataFrame:
    """A row for each value of ``rows`` and, for each of ``values`` of ``columns``, the share that is ok in per cent
    and half the width of its Wilson interval (null where there are no records)."""
    cell = segments(records, [rows, columns], ok, confidence).select(rows, columns, F.round(100 * F.col("acc"), 1).alias("acc"), F.round(50 * F.col("width"), 1).alias("half"))
    wide = cell.groupBy(rows).pivot(columns, values).agg(F.first("acc").alias("acc"), F.first("half").alias("half"))
    return wide


def means(records: DataFrame, by: str, fields: list[str]) -> DataFrame:
    """For each value of ``by``: n and the mean of each of ``fields``, of true-or-false ones in per cent; nulls don't count."""
    kinds = dict(records.dtypes)
    mean = lambda f: F.avg(F.col(f).cast("double")) * (100 if kinds[f] == "boolean" else 1)
    return records.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *[mean(f).alias(f) for f in fields])


def latency_and_cost(records: DataFrame, by: str, time: str, size: str, ok: str = "ok") -> DataFrame:
    """For each value of ``by``: n, the middle ``time`` and ``size`` (of two the larger; null and 0 left out), and
    ``size`` in all for each ok (null if none is).

    Values are counted first and ranked by their counts, so no task holds all values of a group."""
    base = records.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.when(F.count_if(F.col(ok)) > 0, F.sum(size) / F.count_if(F.col(ok))).alias("per_ok"))
    out = base
    for name in (time, size):
        out = out.join(middle(records.where(F.col(name) != 0), by, name, f"middle_{name}"), by, "left")
    return out.select(by, "n", f"middle_{time}", f"middle_{size}", "per_ok")


def middle(df: DataFrame, by: str, name: str, out: str) -> DataFrame:
    """(by, out): the element at place n // 2 of the sorted non-null values of each group."""
    from millrace.operators.profile import at_ranks

    found = at_ranks(df.select(F.col(by).alias("column"), F.col(name).alias("value")), lambda n: {out: F.floor(n / 2)})
    return found.select(F.col("column").alias(by), out)


def repeats(times: DataFrame, by: str, time: str) -> DataFrame:
    """For each value of ``by``: n, median, p95 (nearest rank), min and max of ``time`` over repeated runs."""
    from millrace.operators.profile import at_ranks

    found = at_ranks(times.select(F.col(by).alias("column"), F.col(time).alias("value")), lambda n: {
        "low": F.floor((n - 1) / 2), "high": F.floor(n / 2), "p95": F.greatest(F.ceil(F.lit(0.95) * n) - 1, F.lit(0))})
    ends = times.groupBy(by).agg(F.count(time).alias("n"), F.min(time).alias("min"), F.max(time).alias("max"))
    return ends.join(found, F.col(by) == F.col("column")).select(by, "n", ((F.col("low") + F.col("high")) / 2).alias("median"), "p95", "min", "max")


def bootstrap(df: DataFrame, value: str, key: str, times: int = 1000, confidence: float = 0.95, seed: int = 0) -> DataFrame:
    """One row: the mean of ``value`` and its percentile interval over ``times`` Poisson bootstraps.

    Each row counts 0, 1, 2, ... times in a round, by a Poisson number that a hash of the round and ``key`` gives; so
    rounds are sums over the table, added up where the rows are, and only ``times`` sums are gathered."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("round"), F.col(key)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    # The inverse of the distribution function with mean 1, up to where a double ends.
    total, term, counts = 0.0, 0.36787944117144233, F.lit(0)
    for k in range(17):
        total += term
        counts = counts + (u > total).cast("int")
        term /= k + 1
    rows = df.where(F.col(value).isNotNull()).select(F.col(key), F.col(value).cast("double").alias("v"), F.explode(F.sequence(F.lit(1), F.lit(times))).alias("round")).withColumn("w", counts)
    means_ = rows.groupBy("round").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("m")).where("m IS NOT NULL")
    listed = means_.agg(F.sort_array(F.collect_list("m")).alias("m"))  # ``times`` numbers
    at = lambda q: F.get("m", F.least(F.floor(F.lit(q) * F.size("m")), F.size("m") - 1).cast("int"))
    side = (1 - confidence) / 2
    return df.agg(F.avg(F.col(value).cast("double")).alias("mean")).crossJoin(listed).select("mean", at(side).alias("low"), at(1 - side).alias("high"))  # one row each


def execution_status(error: Column, tokens: Column, seconds: Column, response: Column, kind: Column) -> Column:
    """TIMEOUT or ERROR (an exception, without or with tokens or time), EMPTY, UNPARSEABLE (a number was asked for and none is there) or RESPONDED."""
    nothing = (F.coalesce(tokens, F.lit(0)) == 0) & (F.coalesce(seconds, F.lit(0.0)) == 0)
    return (
        F.when(error == "exception", F.when(nothing, "TIMEOUT").otherwise("ERROR")).when(F.trim(F.coalesce(response, F.lit(""))) == "", "EMPTY")
        .when(kind.isin("numeric", "count") & last_number(spoken(response)).isNull(), "UNPARSEABLE").otherwise("RESPONDED"))


def spoken(response: Column) -> Column:
    """An answer without what was thought aloud."""
    return F.trim(F.regexp_replace(response, r"(?s)<think>.*?</think>", ""))


def accuracy_report(records: DataFrame, by: list[str], response: str, truth: str) -> DataFrame:
    """For each combination of ``by`` (a model and a format, say): n, mae, mape in per cent (over truths other than 0)
    and how many answers are in each tier.  The answer is the last number of ``response``."""
    said, t = last_number(spoken(F.col(response))), F.col(truth).cast("double")
    tier = F.when(said.isNull(), "T5").when(t == 0, F.when(F.abs(said) < 1, "T1").otherwise("T5")).otherwise(accuracy_tier(said, t))
    off = F.abs(said - t)
    return records.withColumns({"__tier": tier, "__off": off, "__rel": F.when(t != 0, off / F.abs(t))}).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("__off").alias("mae"), (100 * F.avg("__rel")).alias("mape"), *[F.count_if(F.col("__tier") == f"T{k}").alias(f"t{k}") for k in range(1, 6)])


def across_seeds(records: DataFrame, mode: str, seed: str, ok: str = "ok") -> DataFrame:
    """For each ``mode``: seeds, the mean and spread of the share that is ok over seeds, the least and the most (all in
    per cent), and the Wilson interval over all records."""
    per = records.groupBy(mode, seed).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(ok)).alias("k"))
    acc = 100 * F.col("k") / F.col("n")
    out = per.groupBy(mode).agg(
        F.count(F.lit(1)).alias("seeds"), F.avg(acc).alias("mean"), F.coalesce(F.stddev_samp(acc), F.lit(0.0)).alias("spread"), F.min(acc).alias("least"), F.max(acc).alias("most"), F.sum("k").alias("k"), F.sum("n").alias("n"))
    return out.withColumn("w", wilson(F.col("k"), F.col("n"))).select(mode, "seeds", "mean", "spread", "least", "most", (100 * F.col("w.low")).alias("low"), (100 * F.col("w.high")).alias("high"))


def last_of_key(records: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of records with the same key the last by ``order``."""
    from millrace.plans.workload import first_by_key

    return first_by_key(records, key, order, last=True)


# Invariants of wrong answers --------------------------------------------------------------------

def invariant(answer: DataFrame, bound: DataFrame, kind: str) -> DataFrame:
    """One row (answer, breaks): does an answer (one row, column answer) break what holds of any right one?  ``bound``
    has one row and a column bound for kind "at_most", where a number may be one per cent above, or the
    names there are in a column name for kind "known_name", in any case.  An empty or unreadable answer breaks nothing."""
    said = answer.select(F.col("answer").cast("string").alias("answer"))
    if kind == "at_most":
        number = F.col("answer").try_cast("double")
        return said.crossJoin(F.broadcast(bound.select(F.col("bound").cast("double").alias("bound")))).select("answer", F.coalesce(number > F.col("bound") * 1.01, F.lit(False)).alias("breaks"))  # one row each
    if kind != "known_name":
        raise ValueError(kind)
    asked = said.withColumn("__name", F.lower(F.trim("answer")))
    known = bound.select(F.lower(F.col("name").cast("string")).alias("__known")).distinct()
    found = asked.join(known, F.col("__name") == F.col("__known"), "left")
    return found.select("answer", (F.col("__known").isNull() & (F.coalesce("__name", F.lit("")) != "")).alias("breaks"))


def star_bounds(star, question: str) -> tuple[DataFrame, str] | None:
    """What holds of any answer to a question over a star: a bound and its kind, or None where nothing is known."""
    fact = star.fact
    one = lambda c: fact.agg(c.alias("bound"))
    if question in ("q10_busy_e1", "q12_e1_above_mean_sum"):
        return one(F.count_distinct("k1")), "at_most"
    if question == "q09_rows_of_top_e1":
        return one(F.count(F.lit(1))), "at_most"
    if question == "q08_sum_in_top_month":
        return one(F.sum(F.abs("m"))), "at_most"
    if question in ("q11_e2_of_max_sum", "q14_e2_most_e1"):
        return star.e2.select("name"), "known_name"
    if question == "q13_e2_of_top_e1":
        top = fact.groupBy("k1").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "k1").limit(1).select("k1")
        own = fact.join(F.broadcast(top), "k1", "left_semi").select(F.col("k2").alias("key")).distinct()  # one row
        return star.e2.join(own, "key", "left_semi").select("name"), "known_name"
    return None


# Ground truth ----------------------------------------------------------------------------------

def ground_truth(spark: SparkSession, questions: dict[str, str]) -> DataFrame:
    """(question, answer, error): the first cell of each SQL question over the registered views; one that fails has its
    error's first line.  Questions are few; each is a job of its own."""
    rows = []
    for name, text in questions.items():
        try:
            row = spark.sql(text).first()
            rows.append((name, None if row is None or row[0] is None else str(row[0]), None))
        except Exception as e:  # noqa: BLE001  whatever is wrong with a question is told in its row
            rows.append((name, None, str(e).splitlines()[0][:200]))
    return spark.createDataFrame(rows, "question string, answer string, error string")


def scale_invariance(spark: SparkSession, questions: dict[str, str], scales: dict[str, dict[str, DataFrame]], check: Callable[[str, dict[str, DataFrame]], object], right: Callable[[SparkSession, str, object], bool]) -> DataFrame:
    """(scale, tested, ok): the same SQL over tables of several sizes, each answer held against ``check`` by ``right``."""
    rows = []
    for scale, tables in scales.items():
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
        marks = [right(spark, text, check(q, tables)) for q, text in questions.items()]
        rows.append((scale, len(marks), sum(marks)))
    return spark.createDataFrame(rows, "scale string, tested bigint, ok bigint")


# What a table looks like -------------------------------------------------------------------------

def key_hint(column: str, tables: list[str]) -> str | None:
    """The table that a column named id_<table> or <table>_id, or its plural, refers to."""
    for mark in (column.removeprefix("id_") if column.startswith("id_") else None, column.removesuffix("_id") if column.endswith("_id") else None):
        if mark:
            return next((t for t in (mark, f"{mark}s") if t in tables), None)
    return None


def profile_block(df: DataFrame, table: str, tables: list[str] = (), key: str | None = None, shown: int = 3) -> DataFrame:
    """(table, column, kind, is_key, refers_to, low, high, mean, cardinality, iso_dates, samples): for a number its range
    and mean, for anything else the ``shown`` smallest texts, and whether they all begin like an ISO date."""
    out = []
    for f in df.schema:
        c, number = F.col(f"`{f.name}`"), isinstance(f.dataType, T.NumericType)
        text = c.cast("string")
        # Distinct texts first, so that nothing is counted distinct, or gathered, in one place.
        per = df.where(c.isNotNull()).groupBy(text.alias("v")).agg(F.count(F.lit(1)).alias("n"), (F.sum(c.cast("double")) if number else F.lit(None).cast("double")).alias("s"))
        x = F.col("v").cast("double") if number else F.lit(None).cast("double")
        row = per.agg(
            F.min(x).alias("low"), F.max(x).alias("high"), (F.sum("s") / F.sum("n")).alias("mean"), F.count(F.lit(1)).alias("cardinality"),
            F.bool_and(F.col("v").rlike(r"^\d{4}-\d{2}-\d{2}")).alias("iso"), F.lit(None).cast("string").alias("none"))
        top = per.orderBy("v").limit(shown).agg(F.array_sort(F.collect_list("v")).alias("samples"))  # a few rows
        kind = ("integer" if isinstance(f.dataType, T.IntegralType) else "real") if number else "text"
        out.append(row.crossJoin(F.broadcast(top)).select(  # one row each
            F.lit(table).alias("table"), F.lit(f.name).alias("column"), F.lit(kind).alias("kind"), F.lit(f.name == key).alias("is_key"), F.lit(key_hint(f.name, list(tables))).cast("string").alias("refers_to"),
            "low", "high", "mean", "cardinality", (F.lit(not number) & F.coalesce("iso", F.lit(False))).alias("iso_dates"), F.when(F.lit(not number), F.col("samples")).alias("samples")))
    return reduce(DataFrame.unionByName, out)
